"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import fingerprints, licenses, mixing, neardup, packing, pages, quality, repeats, secrets, toxicity
from panelspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, _row string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "the", "ä", "é", "o"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(20, 160))) for _ in range(40)]
    texts = [None, "", "  \n\t ", "one", "a b c", "a b a b a b a b"] + base
    texts += base[:4] + base[:2]  # exact copies
    for t in base[4:10]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [base[20][:300] + base[21][:450] + "x" + base[22][:500], base[21][:450] + base[20][:300]]
    texts += ['Password = "s3cr3tABC" token: ab token:abcdef+/=', "key AKIA" + "A" * 20 + " é " + "0af" * 9, "api_key='zzzzzzz' " + "b" * 23 + " " + "c" * 24]
    texts += ["Released under the MIT License.\nMIT license here. General public License", "Licensed under the Apache License, Version 2.0.", "é MIT\nlicense apache-LICENSE"]
    texts += [" ".join(word() for _ in range(6000))]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, "text without id " * 40, "en", "s1", 3, "x", "y", "z"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# quality rules

def measures(t):
    w = SPACE.findall(t or "")
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, rows):
    m = quality.measured(docs)
    got = m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", quality.base_failed().alias("b")).collect()
    want = [(r[0], *(k := measures(r[1])), k[0] < 50 or 100 * k[4] > 50 * k[0]) for r in rows]
    same([tuple(x) for x in got], want)


def test_binomial_tail(spark):
    cases = [(0, 50, 0.05), (3, 400, 0.02), (900, 100_000, 0.01), (5, 6, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = float(sum(Fraction(comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))) if n < 1000 else None
        if k >= n * p:
            assert got == 1.0
        elif want is not None:
            assert abs(got - want) < 1e-9 * want
        else:
            assert 0 < got < 0.01


def test_quality_filter(spark, docs, empty):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1, None, None, None) for i in range(2000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{k}###" for k in range(60)), "en", "s", 1, None, None, None) for i in range(200)]
    d = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.quality_filter(d, labels)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2000))
    none = labels.where("false")
    assert quality.quality_filter(d, none).count() == 2200 and quality.quality_filter(empty, labels).count() == 0
    cut = quality.calibrate(quality.labelled(quality.measured(d.select("doc_id", "text", F.col("lang").alias("stratum"))), labels), "stratum", "_good").collect()
    assert cut and all(c.good_lost == 0 for c in cut)


def test_verdict_equals_slow_calibration(spark):
    """Cutoffs and ``kept`` against a direct count, strata with a null and a lookalike of it, joined with and without a broadcast."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(4800):
        good = rng.random() < 0.6
        odd = rng.random() < (0.001 if good else 0.9)
        letters = lambda: "".join(rng.choice("ABCDEF" if rng.random() < (0.7 if odd else 0.02) else "abcdef") for _ in range(4))
        words = [f"{letters()}{rng.randrange(1000)}" + "#" * (rng.random() < (0.5 if odd else 0.03)) for _ in range(60)]
        rows.append((i, " ".join(words), rng.choice(["en", None, "\0null"])))
        labels.append((i, int(good)))
    measures_of = {}
    for i, t, _ in rows:
        w = t.split()
        measures_of[i] = {"symbols_per_word": t.count("#") / len(w), "shouts_per_word": 0.0, "capital_share": sum(c.isupper() for c in t) / sum(map(len, w)),
                          "dup_line_share": 0.0, "repeat_share": measures(t)[4] / len(w)}
    assert set(measures_of[0]) == set(quality.CUTOFFS)
    risk = error = 0.05
    want = {}
    for stratum in {r[2] for r in rows}:
        of = [(measures_of[r[0]], dict(labels)[r[0]]) for r in rows if r[2] == stratum]
        n_good, n_bad = sum(g for _, g in of), sum(1 - g for _, g in of)
        for rule, cuts in quality.CUTOFFS.items():
            best = None
            for c in cuts:
                lost, caught = sum(g for m, g in of if m[rule] > c), sum(1 - g for m, g in of if m[rule] > c)
                p = risk / len(quality.CUTOFFS)
                if lost >= p * n_good or sum(comb(n_good, k) * p ** k * (1 - p) ** (n_good - k) for k in range(lost + 1)) > error / (3 * len(quality.CUTOFFS)):
                    break
                gain = caught / n_bad - quality.LOSS_WEIGHT * lost / n_good
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, c)
            if best:
                want[stratum, rule] = best[1]
    assert {r for _, r in want} >= {"symbols_per_word", "capital_share"}
    d = spark.createDataFrame(rows, "doc_id long, text string, stratum string")
    scored = quality.measured(d)
    cut = quality.calibrate(quality.labelled(scored, spark.createDataFrame(labels, "doc_id long, quality int")), "stratum", "_good")
    assert {(r.stratum, r.rule): r.cutoff for r in cut.collect()} == want
    kept = {i: all(measures_of[i][rule] <= want.get((s, rule), 9e9) for rule in quality.CUTOFFS) for i, _, s in rows}
    for few in (10_000, 0):
        quality.FEW_STRATA = few
        assert {r.doc_id: r.kept for r in quality.judged(scored, cut, "stratum").collect()} == kept
    quality.FEW_STRATA = 10_000


# near duplicates

def simhash(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = SPACE.findall(w)
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [2000, 10])  # every fingerprint is hot; only those of more than a tenth of the rows are
def test_near_duplicates(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    fps = [simhash(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = [(r[0], f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(rows)]
    same([tuple(x) for x in neardup.near_duplicates(docs).collect()], want)
    one = neardup.one_of_each_group(docs)
    assert one.columns == docs.columns
    groups = {find(i) for i in range(len(rows))}
    assert sorted((r.doc_id is None, r.doc_id) for r in one.collect()) == sorted((not least[g], min(least[g], default=None)) for g in groups)
    assert neardup.near_duplicates(empty).count() == 0


def test_trees_find_every_link(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(300)]
    pts = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(3)}
    core = rng.getrandbits(64)
    pts |= {core ^ sum(1 << k for k in rng.sample(range(20), rng.randint(0, 6))) for _ in range(600)}  # one dense group
    pts = sorted(pts)
    signed = [p - (1 << 64) if p >> 63 else p for p in pts]
    for shard, sample, large in ((64, 20_000, 1 << 21), (20, 20_000, 1 << 21), (64, 100, 1 << 21), (20, 100, 50)):
        monkeypatch.setattr(neardup, "SHARD", shard)
        monkeypatch.setattr(neardup, "SAMPLE", sample)
        monkeypatch.setattr(neardup, "LARGE", large)
        monkeypatch.setattr(neardup, "BLOCK", 256)
        got = components(neardup.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3))).collect()
        part = {r.node: r.root for r in got}
        arr = np.array(pts, np.uint64)
        label = list(range(len(pts)))
        for i in range(len(pts)):
            for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
                a, b = label[i], label[int(j)]
                if a != b:
                    label = [a if x == b else x for x in label]
        classes, mine = defaultdict(set), defaultdict(set)
        for i, p in enumerate(signed):
            classes[label[i]].add(p)
            mine[part.get(p, p)].add(p)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (None, 3)], "a long, b long")
    got = components(links).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


# secrets

def secret_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(docs, rows, empty):
    names = ("assign", "access", "hex")
    want = []
    for r in rows:
        s = secret_spans(r[1])
        want.append((r[0], *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()))
    got = secrets.scanned(docs, drop_text=True).select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.base_sha256").collect()
    same([tuple(x) for x in got], want)
    assert sum(w[1] for w in want) >= 3 and sum(w[3] for w in want) >= 2
    red = secrets.redacted_documents(docs)
    assert red.columns == docs.columns and not any(secret_spans(r.text) for r in red.collect())
    assert secrets.redacted_documents(empty).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == frozenset([frozenset()])
    assert secrets.trigram_query("AKIA[A-Z]+") == frozenset([frozenset([b"aki", b"kia"])])
    q = secrets.trigram_query(secrets.BASE[0].pattern)
    assert frozenset() not in q and frozenset([b"tok", b"oke", b"ken"]) in q and any(b"i_k" in way for way in q)
    texts = [b"x", b"", b"AkIa zz", b"aki", b"kia"]
    assert secrets.batch_candidates(texts, [secrets.trigram_query("AKIA"), secrets.trigram_query("[a-z]")]) == [[2], [0, 1, 2, 3, 4]]


# mixing and packing

def test_mixing(docs, rows, empty):
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, goal = Counter(), Counter(), {}
    by_id = {(r[0], len(SPACE.findall(r[1] or ""))): r[3] for r in rows}
    for g in got:
        s = by_id[g.doc_id, g["size"]]
        assert 0 <= g.taken <= 3 * g["size"]
        sizes[s] += g["size"]
        taken[s] += g.taken
        goal[s] = g.target
        assert g.source_size >= g["size"]
    total = sum(len(SPACE.findall(r[1] or "")) for r in rows)
    assert sum(sizes.values()) == total and abs(sum(goal.values()) - total) < 1
    assert all(abs(taken[s] - goal[s]) < 1 and goal[s] <= 3 * sizes[s] for s in goal if sizes[s])
    same([tuple(x) for x in mixing.taken(docs.coalesce(1)).collect()], [tuple(x) for x in got])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.taken(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_and_permutations():
    assert mixing.targets([100, 1, 50], [1, 2, 3]) == [Fraction(37), Fraction(3), Fraction(111)]
    for n in (1, 2, 5, 1000):
        p = mixing.permuted(np.arange(n), n, 7, 1)
        assert sorted(p.tolist()) == list(range(n)) and (mixing.unpermuted(p, n, 7, 1) == np.arange(n)).all()
    slots = np.array([5, 0, 1000, 37])
    parts = [mixing.shard_counts(slots, 7, k) for k in range(7)]
    assert (sum(c for _, c in parts) == slots).all() and max(c.sum() for _, c in parts) - min(c.sum() for _, c in parts) <= 1
    assert all((parts[k][0] + parts[k][1] == parts[k + 1][0]).all() for k in range(6))
    for size, goal in ((1000, 700), (513, 513), (512, 1536), (100, 250), (5000, 9999), (0, 0), (3, 1)):
        p = mixing.plan(size, Fraction(goal), 3, 64)
        order = [int(mixing.permuted(np.array([k % p["blocks"]]), p["blocks"], 3, k // p["blocks"])[0]) for k in range(p["slots"])]
        words = [min(64, size - 64 * b) for b in order]
        if p["last"]:
            words[-1] = min(words[-1], p["last"])
        assert sum(words) == (goal if size else 0)


def test_packing(docs, rows, empty):
    got = packing.packed(docs, capacity=300, group=50).collect()
    words, room, seen = Counter(), defaultdict(int), set()
    by = {r[0]: (r[3], r[1]) for r in rows}
    for g in sorted(got, key=lambda g: (g.group, g.bin, g.bin_offset)):
        assert g.bin_offset == room[g.group, g.bin]
        room[g.group, g.bin] += g.n_words
        words[g.doc_id] += g.n_words
        for mark in (("source", by[g.doc_id][0]), ("text", by[g.doc_id][1] or "")):
            if g.doc_id is not None:
                assert (g.group, g.bin, mark) not in seen
                seen.add((g.group, g.bin, mark))
    assert max(room.values()) <= 300
    want = Counter()
    for r in rows:
        want[r[0]] += len(SPACE.findall(r[1] or ""))
    assert words == want and packing.packed(empty).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([6, 5, 3, 3], [0, 1, 0, 2], [-1] * 4, 10) == [(0, 0), (1, 0), (1, 5), (0, 6)]
    rng = random.Random(1)
    n = 200
    sizes, src, clu = [rng.randint(1, 40) for _ in range(n)], [rng.randint(-1, 5) for _ in range(n)], [rng.randint(-1, 30) for _ in range(n)]
    bins, got = [], packing.best_fit(sizes, src, clu, 100)
    for s, a, c, (b, at) in zip(sizes, src, clu, got):
        fits = [x for x in bins if x[0] >= s and not (a >= 0 and a in x[1]) and not (c >= 0 and c in x[2])]
        if fits:
            assert bins[b][0] == min(x[0] for x in fits) and bins[b] in fits
        else:
            assert b == len(bins)
            bins.append([100, set(), set()])
        assert at == 100 - bins[b][0]
        bins[b][0] -= s
        bins[b][1].add(a)
        bins[b][2].add(c)


# licenses

def test_licenses(docs, rows, empty):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = []
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        want.append((r[0], len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    out = licenses.licensed(docs).collect()
    same([tuple(x)[:6] for x in out], want)
    assert sum(w[2] for w in want) >= 5 and all(0 <= x.score <= 1 and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) for x in out)
    assert licenses.licensed(empty).count() == 0


def test_license_join_is_complete(spark):
    rng, t = random.Random(3), licenses.TEMPLATES[5][1].split()
    lines = [" ".join([w for w in t if rng.random() < p] + rng.sample(["one", "two", "of", "the", "public"], 3)) for p in (0.6, 0.7, 0.8, 0.85, 0.9, 1) for _ in range(10)]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: "bsd" in r.labels.split(",") for r in licenses.licensed(d).collect()}
    assert got == {i: len(set(x.split()) & set(t)) >= 0.8 * len(set(t)) for i, x in enumerate(lines)} and any(got.values()) and not all(got.values())


def test_wrapped_licenses(spark):
    def wrapped(text, width, start="", gap="\n"):
        lines = [""]
        for w in text.split():
            lines += [""] if len(lines[-1]) + len(w) > width else []
            lines[-1] += w + " "
        return "Some words before.\n\n" + gap.join(start + x for x in lines) + "\n\nSome words after."

    texts = [(label, wrapped(t, width, start, gap)) for label, t in licenses.TEMPLATES for width in (30, 60)
             for start, gap in (("", "\n"), (" * ", "\r\n"), ("# ", "\n\n"), ("", "\n \t\n\n"))]
    far = licenses.TEMPLATES[5][1].split()
    texts.append(("", "\n\n".join(" ".join([w] + ["far"] * 9) for w in far)))  # no block holds enough of it
    texts.append(("", wrapped(" ".join(far[:8]), 30)))
    rng = random.Random(4)
    mixed = [[rng.choice(far) if rng.random() < p else "far" for _ in range(90)] for p in (0.7, 0.8, 0.9, 1) for _ in range(10)]
    span = -(-3 * len(far) // 2)
    held = lambda w: max(len(set(w[i:i + span]) & set(far)) for i in range(len(w))) >= 0.8 * len(set(far))
    texts += [("bsd" if held(w) else "", "\n\n".join(w)) for w in mixed]
    assert {held(w) for w in mixed} == {True, False}
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licensed(d).collect()}
    for i, (label, _) in enumerate(texts):
        assert got[i].labels == label and (got[i].score >= 0.8) == bool(label), texts[i]


# fingerprints

def test_fingerprints(spark, docs, rows, empty):
    uniq = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [r for r in uniq if r[0] is not None]
    out = fingerprints.fingerprinted(docs).collect()
    assert len(out) == len(rows) and fingerprints.fingerprinted(empty).count() == 0
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    for (i, t), (_, nxt) in zip(ids, ids[1:]):
        cut = len(t) // 4
        edit = t[:len(t) - cut] + nxt[:cut]
        assert by[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest() and by[i].n_chars == len(t)
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    prints = {}
    for r in rows:
        if r[0] is not None:
            assert prints.setdefault(r[1] or "", by[r[0]].fingerprint) == by[r[0]].fingerprint
    full = [int(r.fingerprint, 16) for r in out]
    for r in out:
        if r.doc_id is not None and r.doc_id % 50 == 0:
            assert r.n_within == sum((int(r.fingerprint, 16) ^ f).bit_count() <= 3 for f in full)


def test_block_tables(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    pts = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(5)})
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    d = spark.createDataFrame([(sign(p),) for p in pts], "fp long")
    got = fingerprints.within_radius(d.select(F.col("fp").alias("q")), d).collect()
    want = [(sign(a), sign(b)) for a in pts for b in pts if (a ^ b).bit_count() <= 3]
    same([tuple(x) for x in got], want)


# repeats

def test_longest_previous_factors():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(2, 12)
        texts = [bytes(rng.choice([0, 1, 255]) for _ in range(rng.randint(n, 40))) for _ in range(rng.randint(1, 6))]
        data = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8)
        size = np.array([len(x) for x in texts])
        base = np.cumsum(size + 1) - size - 1
        starts = np.concatenate([np.arange(o, o + k - n + 1) for o, k in zip(base, size)])
        rest = [texts[r][s - base[r]:] for r, k in enumerate(size) for s in range(base[r], base[r] + k - n + 1)]
        longest, _ = repeats.longest_previous(data, base + size, starts, n)
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for j, got in enumerate(longest.tolist()):
            want = max((shared(rest[j], rest[i]) for i in range(j)), default=0)
            assert got == want or n <= got <= want
        for first in (True, False):
            hit = repeats.repeated_starts(data, base + size, starts, n, first)
            for j, got in enumerate(hit.tolist()):
                assert got == any(rest[i][:n] == rest[j][:n] for i in range(j if first else len(rest)) if i != j)


@pytest.mark.parametrize("hot, common", [(2048, 2000), (1, 2000), (2048, 10 ** 9)])
def test_repeats(docs, rows, empty, hot, common, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "COMMON", common)
    n, raw = 120, [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    want = []
    for r, b in zip(rows, raw):
        gone = {k for i in range(len(b) - n + 1) if seen[b[i:i + n]] > 1 for k in range(i, i + n)}
        spans = sum(k - 1 not in gone for k in gone)
        want.append((r[0], len(b), len(gone), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    same([tuple(x) for x in repeats.removed(docs, n).collect()], want)
    assert repeats.removed(empty, n).count() == 0


def test_repeats_keep_first(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(500)) for _ in range(2))
    d = spark.createDataFrame([(1, a), (2, b + a), (3, a + a[:200]), (4, b)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.removed(d, 120, keep_first=True).collect()}
    assert got == {1: 0, 2: 500, 3: 700, 4: 500}


def test_repeats_of_a_long_periodic_text(spark):
    d = spark.createDataFrame([(1, " " * 300_000), (2, "ab" * 400 + "c" * 399)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.removed(d).collect()} == {1: 300_000, 2: 800}


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_of_hot_anchors_make_few_rows(spark, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1)
    rng, n = random.Random(9), 200
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    short, long = word(150), word(300)
    texts = [word(rng.randint(0, 300)) + (short if i % 4 else long) + word(rng.randint(0, 300)) for i in range(60)] + [short, long]
    texts += [texts[4], texts[8][40:] + "x", "y" + texts[9][:-30]]
    made = spark.sparkContext.accumulator(0)
    for name in ("mapInArrow", "mapInPandas"):
        def step(df, f, shape, call=getattr(type(spark.range(1)), name)):
            def counted(batches):
                for b in f(batches):
                    made.add(len(b))
                    yield b
            return call(df, counted, shape)

        monkeypatch.setattr(type(spark.range(1)), name, step)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.removed(docs, n, keep_first).collect()}
    seen, first = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1)), set()
    for j, t in enumerate(texts):
        gone = set()
        for i in range(len(t) - n + 1):
            k = t[i:i + n]
            if seen[k] > 1 and (k in first or not keep_first):
                gone |= set(range(i, i + n))
            first.add(k)
        assert got[j] == len(gone), j
    # a row per string would be some thousands
    strings = sum(max(0, len(t) - n + 1) for t in texts)
    assert made.value < strings / 10, (made.value, strings)


# pages

def test_pages(spark):
    html = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy</div>'
            '<article><h1>Head &amp; more</h1><p><b>First\n  part.<br><p>Second&nbsp;part &lt;x&gt;.</p></article><footer>&copy; end</footer></body></html>')
    rows = [(1, "u", html, 7), (2, "u", None, 7), (3, None, "", 7), (4, "u", "<p>alone", 7), (1, "u", html, 7), (None, "u", html[:html.index("</article>")], 7)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    good = "Head & more First part. Second part <x>."
    assert [r.text for r in got if r.page_id in (1, None)] == [good] * 3
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""] and all(r.n_chars_ == len(r.text) and r.n_chars == 7 for r in got)


def test_marginals_are_exact():
    model = pages.fitted()
    nodes, _ = pages.parsed("<body><div class='main'><p>Some text, here.</p><ul><li>x</li></ul></div></body>")
    n, like = len(nodes), [model._potential(x) for x in nodes]
    total, content = 0.0, [0.0] * n
    for code in range(3 ** n):
        y = [code // 3 ** k % 3 for k in range(n)]
        p = model.root[y[0]] * like[0][y[0]]
        for i in range(1, n):
            p *= model.edge[y[nodes[i].parent]][y[i]] * like[i][y[i]]
        total += p
        for i in range(n):
            content[i] += p * (y[i] == pages.CONTENT)
    assert np.allclose(model.marginals(nodes), [c / total for c in content])


def test_hand_labelled_pages_without_their_own_labels():
    model = pages.fitted()
    for h in pages.HAND:
        nodes, _ = pages.parsed(h)
        want = [y == pages.CONTENT for y in pages.hand_labels(nodes)]
        got = [p >= 0.5 for p in model.marginals(nodes)]
        assert sum(a == b for a, b in zip(want, got)) >= 0.85 * len(want)


# toxicity

def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "re", "ou"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(5, 150))]
        bad = i % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vileword", "vilething", "nasty"])
        rows.append((i, " ".join(w), "held"))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, "x"), (5000, "", "x"), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = toxicity.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score_ <= 1 and r.predicted == (r.score_ >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.85
    none = toxicity.scored(d.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def test_windows_hold_every_passage_of_half_their_length():
    for n in (1, 16, 32, 33, 48, 49, 200):
        starts = toxicity.window_starts(n)
        for at in range(max(1, n - 15)):
            assert any(s <= at and min(at + 16, n) <= s + toxicity.WINDOW for s in starts)


def test_training_sample_with_repeated_ids(spark, monkeypatch):
    rows = [(i, f"text {i} {k}") for i in range(60) for k in range(1 if i % 3 else 20)] + [(3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2}
    own = lambda: [(int(r.text.split()[1]), r.toxic) for r in toxicity.training_rows(d, labels).collect()]
    assert sorted(own()) == sorted((i, int(i % 3 == 0)) for i in kept)
    monkeypatch.setattr(toxicity, "TOXIC_DOCS", 5)
    monkeypatch.setattr(toxicity, "CLEAN_DOCS", 7)
    got = own()
    assert len(got) == len(set(got)) == 12 and sum(t for _, t in got) == 5


def test_grams_reach_the_end_of_a_word():
    def bucket(g):
        h = len(g)
        for x in g:
            h = (h ^ ord(x)) * 16777619 % 2**32
        return (h ^ h >> 15) % toxicity.BUCKETS

    vocabulary = ["x", "ab", "toxicity", "überlangesgrundwort", "清除所有数据"]
    gram, count = toxicity.gram_table(vocabulary)
    want = [[bucket(m[i:i + n]) for n in (3, 4, 5) for i in range(len(m) - n + 1)] for m in (f"^{w}$" for w in vocabulary)]
    assert gram.tolist() == sum(want, []) and count.tolist() == [len(w) for w in want]
    assert toxicity.grams_of(gram, count, np.array([3, 1]))[0].tolist() == want[3] + want[1]
    table = np.random.default_rng(1).random((toxicity.BUCKETS, 2))
    assert np.allclose(toxicity.gram_sums(table, gram, count), [table[w].sum(axis=0) for w in want])
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "re", "ou"]) for _ in range(rng.randint(1, 6)))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = word() + "vilestuff"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    scorer = toxicity.trained(texts, labels)
    assert not {"kindergartenvilestuff", "understandvilestuff"} & set(scorer.net.vocabulary)
    for w in ("kindergarten", "understand"):
        bad, good = scorer.scores([f"an er re {w}vilestuff tion ou", f"an er re {w}harmless tion ou"])
        assert bad > 0.6 and good < 0.3


def test_gradients():
    net = toxicity.Network({"a": 1, "b": 2}, seed=1)
    ids, gram, count = toxicity._coded(net, ["a", "b", "word"])
    place, live = np.array([[0, 1], [2, 0], [1, 2]]), np.array([[1, 1], [1, 1], [1, 0]], np.float32)
    y = np.array([1.0, 0.0], np.float32)

    def loss():
        xs = net.vectors(ids, gram, count)[place]
        p = toxicity.sigmoid(net.run(np.stack([xs @ net.p["w"][d] + net.p["b"][d] for d in (0, 1)]), live).astype(np.float64))
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    before = {k: v.copy() for k, v in net.p.items()}
    memory = {k: np.full_like(v, 1e12) for k, v in net.p.items()}  # steps of gradient / 1e6
    net.p = {k: v.astype(np.float64) for k, v in before.items()}
    numeric = {}
    for k, at in (("u", (0, 1, 2)), ("u", (1, 0, 15)), ("w", (0, 3, 1)), ("q", (2,)), ("v", (4,)), ("b", (1, 7)), ("word", (1, 2))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        numeric[k, at] = (up - loss()) / 2e-3
        net.p[k][at] = old
    net.p = {k: v.astype(np.float64) for k, v in before.items()}
    start = {k: v.copy() for k, v in net.p.items()}
    net.step(ids, gram, count, place, live, y, 1e6, memory)
    for (k, at), g in numeric.items():
        assert abs((start[k][at] - net.p[k][at]) - g) < 1e-3 + 0.03 * abs(g)


def test_first_names_pack_symbols():
    rng = random.Random(5)
    texts = [bytes(rng.choice([0, 255]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    data = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    symbols = data.astype(np.int64) + len(ends)
    symbols[ends] = np.arange(len(ends))
    names = repeats.suffix_names(data, ends, 20)
    # three sorts for 20 symbols, not six; places have one name where the symbols from there on are the same
    assert len(names) <= 3
    for k, name in enumerate(names):
        words = [tuple(symbols[i:i + (repeats.FIRST << k)]) for i in range(len(data))]
        assert len(set(zip(name.tolist(), words))) == len(set(words)) == len(set(name.tolist()))
