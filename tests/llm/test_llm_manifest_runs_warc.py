"""Merkle manifest, periodic runs and web archives against brute force."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from oracle_check import compare, connect
from panelspark.llm import manifest, mixing, periodic, warc
from panelspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Merkle manifest

def brute_tree(leaves):
    """Root and, for each leaf, the siblings level by level with the leaf's place."""
    steps, level, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, above = [], []
        for k in range(0, len(level), 8):
            run = level[k:k + 8]
            for j in range(len(run)):
                for i in under[k + j]:
                    steps[i].append((j, run[:j] + run[j + 1:]))
            up.append(SHA("".join(run)))
            above.append(sum(under[k:k + 8], []))
        level, under = up, above
    return level[0], steps


def brute_fold(leaf, steps):
    for at, sib in steps:
        leaf = SHA("".join(sib[:at] + [leaf] + sib[at:]))
    return leaf


def brute_manifest(rows):
    """(group, key, leaf) rows to sorted (key, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for g, k, d in rows:
        groups[g].append((k is not None, k or 0, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([d for *_, d in sorted(groups[g])]) for g in order}
    root, tops = brute_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (has, k, d), own in zip(sorted(groups[g]), trees[g][1]):
            steps = own + top
            assert brute_fold(d, steps) == root
            out.append((k if has else None, d, trees[g][0], root, SHA("".join(s for _, sib in steps for s in sib))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes, levels", [([1], 4), ([1, 1], 4), ([8, 9, 1, 64, 65, 513], 4), ([700, 3, 65, 1, 520], 1), ([600, 64, 1], 2), ([3] * 70, 1)])
def test_manifest_equals_brute_force(spark, sizes, levels):
    """Small blocks make several rounds of block roots."""
    rng = random.Random(3)
    rows = [(None if g == 1 else f"g{g:03d}é" if g % 2 else f"g{g:03d}", rng.choice([i, i // 2, None]), SHA(f"{g} {i // 3}")) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(3)
    got = manifest.sealed(df, "lang", ["doc_id"], levels=levels).withColumn("proof", manifest.proof(F.col("witness"))).withColumn("again", manifest.folded(F.col("leaf"), F.col("witness"))).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=repr) == brute_manifest(rows)
    assert all(r.again == r.root for r in got)


def test_manifest_of_no_rows_and_of_clashing_names(spark):
    df = spark.createDataFrame([], "lang string, doc_id long, leaf string")
    assert manifest.sealed(df, "lang", ["doc_id"]).collect() == []
    df = spark.createDataFrame([(1, "x", "a", 7), (None, "x", None, None)], "doc_id long, lang string, text string, n long").withColumn("leaf", manifest.row_digest(F.col("doc_id"), F.col("text"), F.col("n")))
    got = {r.doc_id: r.leaf for r in manifest.sealed(df, "lang", ["doc_id"]).collect()}
    assert got == {1: SHA("1:11:a1:7"), None: SHA("---")}


def test_manifest_query(spark):
    """Against its SQL, and against the definition."""
    got = QUERIES["op11_merkle_manifest"](spark, SF)
    assert compare(got, connect(SF), ORACLES["op11_merkle_manifest"]) == ""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {r.doc_id: SHA("".join(map(one, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))) for r in rows}
    want = brute_manifest([(r.lang, r.doc_id, leaf[r.doc_id]) for r in rows])
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got.collect()], key=repr) == want
    low = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and re.search("[A-Z]", r.text or "")}
    assert {r.doc_id for r in got.collect() if not r.verified} == low and low


# periodic runs

def brute_runs(w):
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e - i + q >= max(24, 3 * q) and not any(all(w[x] == w[x + p] for x in range(i, e + q - p)) for p in range(1, q)):
                found.append((i, e - i + q, q))
            i = e
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_lists():
    rng = random.Random(9)
    yield from ([], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, ["a", "b"] * 12, ["a", "b"] * 200 + ["a"])
    for _ in range(150):
        out = []
        while len(out) < rng.randint(30, 400):
            p = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 33, 40, 65]))]
            if rng.random() < 0.5 and len(p) > 4:  # a period that repeats within itself
                p = p[:len(p) // 2] * 3 + p[len(p) // 2:]
            out += (p * rng.randint(1, 12))[:rng.randint(1, 300)]
        yield out
    for k in (8, 9, 10):
        a, b = "a", "b"
        while len(a) < 2**k // 3:  # Fibonacci words: runs inside runs
            a, b = a + b, a
        yield list(a)


def test_runs_equal_brute_force():
    for w in word_lists():
        names = {x: i for i, x in enumerate(dict.fromkeys(w))}
        assert periodic.runs(np.array([names[x] for x in w], np.int64)) == brute_runs(w), w


def test_long_repeats_take_linear_time():
    word = np.tile(np.arange(3000), 100)
    assert periodic.runs(word) == [(0, 300_000, 3000)]
    assert periodic.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_query(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or "")) if doc_id is not None else re.findall(r"[^\x20\x09-\x0D]+", text or "")
    names = {x: i for i, x in enumerate(dict.fromkeys(w))}
    found = brute_runs([names[x] for x in w]) if len(w) < 600 else periodic.runs(np.array([names[x] for x in w], np.int64))
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, SHA("".join(f"{s},{n},{q}\n" for s, n, q in found)), SHA(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_query(spark, tmp_path):
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()]
    want = [brute_query(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0]) and sum(r[1] > 0 for r in got) > 10
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one", "a b " * 30, "ä\x00 é\x0b" * 40, " x " * 60, "w " * 50_000] + ["x y z " * 20] * 12)] + [(7, "a b c"), (7, "a b c"), (None, "q " * 40), (None, None)]
    spark.createDataFrame([(*r, 1, "c", "t") for r in rows], "doc_id long, text string, runs int, collapsed string, top string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute_query(*r)) for r in rows)
    out = periodic.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert out.columns == ["doc_id", "runs", "collapsed", "top", "runs_", "collapsed_"] and out.where("doc_id is null").count() == 2
    assert periodic.periodic_runs(out.limit(0).withColumnRenamed("top", "text")).collect() == []


# web archives

def brute_records(pages):
    best = defaultdict(list)
    for k, (page_id, url, html) in enumerate(pages):
        best[html or ""].append((page_id is not None, page_id or 0, k))
    out = []
    for html, group in best.items():
        top = max(group)
        payload = html.encode()
        for has, page_id, k in group:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            own = (page_id if has else None, len(payload), digest)
            out.append((*own, "response", None) if k == top[2] else (*own, "revisit", top[1] if top[0] else None))
    return sorted(map(repr, out))


PAGES = [(i, f"http://e/{i}", f"<p>é {i % 7}</p>" * (i % 5)) for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", ""), (None, "n", "only"), (None, "n", "only"), (200, "same", "one\x1f\x8b\x08"), (200, "same", "one\x1f\x8b\x08"), (200, "other", "one\x1f\x8b\x08"), (3, "long", "word " * 200_000)]


@pytest.mark.parametrize("broadcast_rows", [250_000, 0])
def test_archives_round_trip(spark, tmp_path, broadcast_rows):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, _n int").repartition(3)
    records = warc.records_of(df, broadcast_rows=broadcast_rows, hot_share=0.1)
    path = warc.written(records, str(tmp_path))
    for split in (1 << 20, 4000, 173):
        out = warc.read(spark, path, split_bytes=split).where("record_type != 'warcinfo'").cache()
        got = out.select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to"))).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute_records(PAGES)
        assert out.select("record_id").distinct().count() == len(PAGES)
        payloads = {r.payload.decode() for r in out.where("record_type = 'response'").collect()}
        assert payloads == {p[2] or "" for p in PAGES}
        out.unpersist()
    # nothing but gzip members of records, for other readers too
    store, _ = fs.FileSystem.from_uri(path)
    for f in store.get_file_info(fs.FileSelector(path)):
        if f.path.endswith(".warc.gz"):
            assert gzip.open(f.path).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_least_payload(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    page = lambda x: x and int(x.split(":")[2])
    got = {page(r.record_id): (r.record_type, page(r.refers_to)) for r in warc.records_of(df, least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 4: ("response", None), 3: ("revisit", 4)}


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.written(warc.records_of(none), str(tmp_path / "a"))
    assert warc.read(spark, path).where("record_type != 'warcinfo'").count() == 0


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at:self.at + n]


def test_every_split_owns_its_records_even_of_nested_archives():
    """Records whose payload is an archive that deflate stores as it is."""
    rng = random.Random(1)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    inner = b"".join(warc.member(warc.record("response", f"urn:inner:{i}", None, noise(900), 900), 6) for i in range(300))
    assert len(inner) > 2 * warc.STORED
    records = [warc.record("response", f"urn:page:{i}", "u", p, len(p)) for i, p in enumerate([b"a", inner, warc.MAGIC * 50, b"", inner[:2000], noise(3000)])]
    data = b"".join(warc.member(r, level) for r in records for level in (0, 6))
    whole = [r for r in records for _ in range(2)]
    for split in (len(data), 100_003, 9_999, 4_001):
        got = [r for a in range(0, len(data), split) for r in warc.owned(warc.Window(Bytes(data), len(data)), a, min(a + split, len(data)))]
        assert got == whole
    with pytest.raises(ValueError):
        list(warc.owned(warc.Window(Bytes(b"plain"), 5), 0, 5))


def test_damaged_records_raise():
    r = warc.record("response", "urn:page:1", "u", b"abc", 3, warc.base32_sha1(b"abc"))
    assert warc.parsed(r)[3:6] == (b"abc", 3, warc.base32_sha1(b"abc"))
    with pytest.raises(ValueError):
        warc.parsed(r.replace(b"abc", b"abd"))


def test_warc_query(spark):
    got = sorted(repr(tuple(r)) for r in QUERIES["op13_warc"](spark, SF).collect())
    assert got == brute_records([(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])


# mixing at sizes that numpy's draws don't take

def test_shards_of_very_large_mixes():
    slots = np.array([6 * 10**11, 3 * 10**11, 10**11 - 7, 7, 0, 12_345], np.int64)
    parts = [mixing.shard_counts(slots, 7, k) for k in range(7)]
    assert (sum(n for _, n in parts) == slots).all() and all((f + n == g).all() for (f, n), (g, _) in zip(parts, parts[1:]))
    assert all(abs(int(n.sum()) - int(slots.sum()) // 7) <= 7 and (n >= 0).all() for _, n in parts)
    first, n = mixing.shard_counts(slots, 10**6 * 5, 123_456)
    again = mixing.shard_counts(slots, 10**6 * 5, 123_456)
    assert (first == again[0]).all() and (n == again[1]).all() and abs(int(n.sum()) - 200_000) < 60
    assert abs(n[0] - 120_000) < 2500 and abs(n[1] - 60_000) < 2000


def test_large_draws_look_like_exact_ones():
    left = np.array([400_000_000, 590_000_000, 20_000_000, 50], np.int64)
    draws = np.array([mixing.without_replacement(np.random.default_rng(i), left, 300_000_000) for i in range(300)])
    p = 300_000_000 / left.sum()
    assert (draws.sum(1) == 300_000_000).all() and (draws <= left).all()
    want = left * p * (1 - p) * (left.sum() - left) / (left.sum() - 1)
    assert (abs(draws.mean(0) - left * p) < 5 * np.sqrt(want / 300)).all() and (abs(draws.var(0) / want - 1) < 0.5).all()
