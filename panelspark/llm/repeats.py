"""Repeated byte strings across a corpus: longest previous factors in suffix order, within groups that can match.

A suffix array of the whole corpus would need the corpus in one task.  Every string of LENGTH bytes is filed under its
anchor instead, the 32-byte gram of least hash in it: equal strings have equal anchors at equal offsets, so matches
meet in the group of their anchor.  Neighbouring strings mostly share an anchor; the bytes they cover together are its
context.  Contexts found twice settle all their strings at once, by counting.  Where one anchor has several contexts,
the bytes of one example of each are put in suffix order.  In that order the nearest smaller positions before and after
a suffix hold its longest match with anything earlier, so their common prefixes give the longest-previous-factor array:
a string at least LENGTH long there has an earlier copy, and the place that gave it a later one.  An anchor with very
many contexts is not gathered: its contexts are cut into blocks of strings, filed under the bytes that all strings of a
block share, and settled by counting again.  Only where such bytes lie in different blocks do strings go by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from .common import partitions

LENGTH = 400
GRAM = 32
#: Symbols of the first names (9 bits each in one word).
FIRST = 7
#: Bytes hashed in one numpy block (positions need 20 bits).
CHUNK = 1 << 19
#: Contexts of one anchor beyond which they are cut into blocks.
HOT = 2048
#: Starts in a block, which share LENGTH + 1 - STEP bytes.
STEP = 32
#: A context found in more than one of so many places is common; there are fewer common ones than that.
COMMON = 2000
TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 11) for i in range(256)], np.uint64)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each ``width`` bytes (any width), by doubling."""
    with np.errstate(over="ignore"):
        power, h, have = np.uint64(0x9E3779B97F4A7C15), TABLE[data], 1
        out, todo = None, width
        while todo:
            if todo & 1:
                if out is None:
                    out, span = h, have
                else:
                    m = len(data) - span - have + 1
                    out, span = out[:m] * power + h[span:span + m], span + have
            todo >>= 1
            if todo:
                m = len(data) - 2 * have + 1
                h = h[:m] * power + h[have:have + m]
                power, have = power * power, have * 2
        x = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, anchor position, first start, last start) of the runs of strings that share an anchor.

    ``data`` holds documents one after another; ``ends`` are their ends.  Positions are in ``data``.
    """
    starts = np.concatenate(([0], ends[:-1]))
    valid = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(starts, ends) if e - s >= length] or [np.zeros(0, np.int64)])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 5
    hashes = gram_hashes(data, GRAM)
    low = np.uint64((1 << 20) - 1)
    m = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if width > have:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have:])
    at = (m[valid] & low).astype(np.int64)
    doc = np.searchsorted(ends, valid, side="right")
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(valid)])) - 1
    return doc[new], hashes[at[new]].view(np.int64), at[new], valid[new], valid[last]


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(document numbers, bytes, ends) in blocks of about CHUNK bytes; a longer text is cut with an overlap of length - 1."""
    nums, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[s:s + CHUNK + length - 1]
            if size + len(part) > CHUNK + length and parts:
                yield nums, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                nums, parts, size = [], [], 0
            nums.append((i, s))
            parts.append(part)
            size += len(part)
    if parts:
        yield nums, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            blocks = [np.zeros((0, 5), np.int64)]
            for nums, data, ends in _blocks(texts, length):
                raw = data.tobytes()
                starts = np.concatenate(([0], ends[:-1]))
                d, a, at, lo, hi = anchors(data, ends, length)
                c = np.array([xxhash.xxh64_intdigest(raw[x:y + length], p - x) for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())], np.uint64)
                i, shift = np.array(nums, np.int64).T
                blocks.append(np.stack((i[d], a, c.view(np.int64), lo - starts[d] + shift[d], hi - starts[d] + shift[d]), axis=1))
            cols = np.concatenate(blocks)
            offsets = np.searchsorted(cols[:, 0], np.arange(len(texts) + 1))
            # an array per field: as structs they would take nearly twice the room when written
            items = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cols[:, k])) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), *items],
                ["doc_id", "h", "n", "sha", "a", "c", "lo", "hi"])
    return run


def blocks_of(raw: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(core hash, block hash, first start, last start) of a context's strings by STEP starts, counted from the anchor.

    Equal strings lie in blocks of equal core, the bytes shared by any strings at these distances from the anchor; blocks of
    equal hash hold equal strings at equal distances.
    """
    m = len(raw) - length + 1
    # as anchors() chose it
    at = int(np.argmin(gram_hashes(np.frombuffer(raw, np.uint8)[:length], GRAM) & ~np.uint64((1 << 20) - 1)))
    out, lo = [], 0
    while lo < m:
        k = (at - lo) // STEP
        hi = at - k * STEP
        core, hi = raw[hi:hi + length + 1 - STEP], min(hi, m - 1)
        out.append((_signed(xxhash.xxh64_intdigest(core, k)), _signed(xxhash.xxh64_intdigest(raw[lo:hi + length], at - lo)), lo, hi))
        lo = hi + 1
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocked(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_buffer().to_pybytes() for x in b.column(4)]
            found = [blocks_of(x, length) for x in raw]
            keys = [gram_hashes(np.frombuffer(x, np.uint8), length).view(np.int64) for x in raw]
            take = np.repeat(np.arange(len(found)), np.array([len(x) for x in found], np.int64))
            core, c, lo, hi = np.array([y for x in found for y in x], np.int64).reshape(-1, 4).T
            # blocks follow each other without gaps, so their strings' hashes stand in order
            k = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(hi - lo + 1))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            base = b.column(3).to_numpy()[take]
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(take)) for j in range(2)), pa.array(base + lo), pa.array(base + hi + length), b.column(2).take(pa.array(take)),
                                              pa.array(core), pa.array(c), k], ["doc_id", "h", "lo", "end", "a", "core", "c", "k"])
    return run


def suffix_names(data: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """The doubled names of all places; the last ones order them by at least ``width`` symbols from there on.

    A symbol is a byte, or a text's end, which equals no other end.  ``names[k]`` tells whether two places have the same
    FIRST * 2^k symbols, and orders them: a name is the number of places before the first of its group.  The first names
    come from one sort of packed symbols.  Places alone in their group keep their name, so only the others are sorted again.
    """
    n = len(data)
    key = np.concatenate((data.astype(np.int64) + 1, np.zeros(FIRST - 1, np.int64)))
    key[ends] = 0
    key = sum(key[k:n + k] << (9 * (FIRST - 1 - k)) for k in range(FIRST))
    ending = np.zeros(n, bool)
    for k in range(FIRST):
        at = ends - k
        ending[at[at >= 0]] = True
    name, shared, names, have = np.zeros(n, np.int32), np.arange(n), [], FIRST
    while True:
        order = np.argsort(key)
        ordered, group = key[order], name[shared[order]]
        first = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        if not names:
            # what holds a text's end equals nothing; the bytes packed behind it are another text's
            new |= ending[order]
        at = first(new)
        name = name.copy()
        name[shared[order]] = group + (at - first(np.concatenate(([True], group[1:] != group[:-1]))))
        names.append(name)
        if have >= width:
            break
        several = np.bincount(at, minlength=len(at))[at] > 1
        shared = shared[order[several]]
        if not len(shared):
            break
        after = np.zeros(len(shared), np.int64)
        inside = shared + have < n
        after[inside] = name[shared[inside] + have] + 1
        key = name[shared].astype(np.int64) * (n + 1) + after
        have *= 2
    return names


def common_prefix(symbols: np.ndarray, names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``i`` and ``j`` share, up to what the names reach.  Each text ends in a symbol of its
    own, so no prefix runs past it."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        same += (names[k][i + same] == names[k][j + same]).astype(np.int64) * (FIRST << k)
    left = np.arange(len(i))
    for _ in range(FIRST - 1):
        left = left[symbols[i[left] + same[left]] == symbols[j[left] + same[left]]]
        same[left] += 1
    return same


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 where there is none, through a tree of minima."""
    tree = [x]
    while len(tree[-1]) > 1:
        if len(tree[-1]) % 2:
            tree[-1] = np.append(tree[-1], np.iinfo(x.dtype).max)
        tree.append(np.minimum(tree[-1][::2], tree[-1][1::2]))
    node, level, todo = np.full(len(x), -1), np.zeros(len(x), np.int64), np.arange(len(x))
    for k, low in enumerate(tree[:-1]):
        left = (todo >> k) - 1  # of the sibling, for a right child
        hit = left % 2 == 0
        hit[hit] = low[left[hit]] < x[todo[hit]]
        node[todo[hit]], level[todo[hit]] = left[hit], k
        todo = todo[~hit]
    for k in range(len(tree) - 1, 0, -1):
        i = np.flatnonzero((level == k) & (node >= 0))
        node[i] = 2 * node[i] + (tree[k - 1][2 * node[i] + 1] < x[i])
        level[i] = k - 1
    return node


def longest_previous(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` the longest match with an earlier start, and that start (-1: none).

    ``data`` holds texts, each with one byte more that stands for its end (``ends``: the places of these).  Matches end
    with their texts; those of more than ``length`` bytes may be given shorter, but not below ``length``.
    """
    symbols = data.astype(np.int64) + len(ends)
    symbols[ends] = np.arange(len(ends))
    names = suffix_names(data, ends, length + 1)
    number = np.full(len(data), -1)
    number[starts] = np.arange(len(starts))
    # starts in suffix order, ties by place
    place = np.sort(names[-1][starts].astype(np.int64) * len(data) + starts) % len(data)
    by = number[place]
    sides = [previous_smaller(place), len(place) - 1 - previous_smaller(place[::-1])[::-1]]
    sides[1][sides[1] == len(place)] = -1
    longest, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for near in sides:
        has = np.flatnonzero(near >= 0)
        match = common_prefix(symbols, names, place[has], place[near[has]])
        better = match > longest[by[has]]
        longest[by[has[better]]], source[by[has[better]]] = match[better], place[near[has[better]]]
    return longest, source


def repeated_starts(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, first: bool) -> np.ndarray:
    """True where the string at a start occurs again, or with ``first`` where it occurs at an earlier start."""
    longest, source = longest_previous(data, ends, starts, length)
    hit = longest >= length
    if not first:
        # the least place of a string is the only earlier one of the next, which names it
        named = np.zeros(len(data), bool)
        named[source[hit]] = True
        hit |= named[starts]
    return hit


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """A row per document with its repeated stretches: doc_id, h, n, sha, runs (sorted [lo, end) in bytes, may touch or overlap).

    Every byte covered by a string of ``length`` bytes that starts elsewhere too is in a run; with ``keep_first`` only
    where an occurrence at a smaller (doc_id, text hash, offset) exists, so that the first copy stays.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = reliable(own.mapInArrow(_digest(length), f"doc_id {kind}, h long, n long, sha string, a array<bigint>, c array<bigint>, lo array<bigint>, hi array<bigint>"))
    seen = digest.select("doc_id", "h", F.explode(F.arrays_zip("a", "c", "lo", "hi")).alias("x")).select("doc_id", "h", "x.*")
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h", "lo")
    kinds = seen.groupBy("a", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(place.alias("place"), "hi")).alias("at"))
    several = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # most anchors are met once: they end here
    contexts = reliable(kinds.join(several, "a", "left").where("times > 1 or kinds > 1"))
    twice = contexts.where("times > 1").select("a", "c", "times", F.col("at.place").alias("first_place"))
    most = (digest.agg(F.sum(F.size("a"))).first()[0] or 0) / COMMON
    common = F.broadcast(twice.where(F.col("times") > most).drop("times"))
    # places of a common context stay where they are, so no task gathers them
    settled = seen.join(common, ["a", "c"]).unionByName(
        seen.join(common.select("a", "c"), ["a", "c"], "left_anti").join(twice.where(F.col("times") <= most).drop("times"), ["a", "c"]))
    if keep_first:
        settled = settled.where(place > F.col("first_place"))
    runs = settled.select("doc_id", "h", "lo", (F.col("hi") + length).alias("end"))

    examples = contexts.where("kinds > 1").select("kinds", F.col("at.place.doc_id").alias("e_id"), F.col("at.place.h").alias("e_h"), F.struct(
        "a", F.col("at.place.lo").alias("lo"), F.col("at.hi").alias("hi")).alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (t, xs) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                raw = t.as_buffer().to_pybytes()
                rows += [(i, x["a"], x["lo"], raw[x["lo"]:x["hi"] + length]) for x in xs]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                                             ["doc_id", "h", "a", "lo", "bytes"])

    def pieces(part: DataFrame) -> DataFrame:
        # equal rows of the table give equal pieces, which count once
        wanted = part.groupBy("e_id", "e_h").agg(F.collect_list("x").alias("wanted"))
        found = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("h") == F.col("e_h"))).select("doc_id", "h", "text", "wanted")
        return found.mapInArrow(cut, f"doc_id {kind}, h long, a long, lo long, bytes binary")

    bucket = F.pmod(F.col("a"), F.lit(16 * partitions(docs.sparkSession)))

    def match(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        # rows of one anchor stay together; a bucket is worked off in slices of whole anchors
        b = b.drop_duplicates(["a", "doc_id", "h", "lo"])
        b = b.assign(_none=b["doc_id"].notna()).sort_values(["a", "_none", "doc_id", "h", "lo"]).reset_index(drop=True)
        size = b["bytes"].str.len().to_numpy()
        last = np.flatnonzero(b["a"].to_numpy()[1:] != b["a"].to_numpy()[:-1]) + 1
        total, out, s = np.concatenate(([0], np.cumsum(size))), [], 0
        while s < len(b):
            k = np.searchsorted(total[last], total[s] + CHUNK)
            e = int(last[k]) if k < len(last) else len(b)
            part, n = b.iloc[s:e], size[s:e]
            data = np.frombuffer(b"".join(x + b"\0" for x in part["bytes"]), np.uint8)
            base = np.cumsum(n + 1) - n - 1
            starts = np.concatenate([np.arange(o, o + k - length + 1) for o, k in zip(base, n)])
            row = np.repeat(np.arange(len(part)), n - length + 1)
            # the sort has put places in order, so positions in ``data`` compare as (doc_id, h, offset) do
            hit = repeated_starts(data, base + n, starts, length, keep_first)
            if hit.any():
                at, r = (starts - base[row])[hit], row[hit]
                edge = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(r) != 0))))
                stop = np.concatenate((edge[1:], [len(at)])) - 1
                lo = part["lo"].to_numpy()[r[edge]]
                out.append(pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[r[edge]], "h": part["h"].to_numpy()[r[edge]], "lo": lo + at[edge], "end": lo + at[stop] + length}))
            s = e
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "h": [], "lo": [], "end": []})

    shape = f"doc_id {kind}, h long, lo long, end long"
    found = pieces(examples.where(F.col("kinds") <= HOT)).withColumn("bucket", bucket).groupBy("bucket").applyInPandas(match, shape)
    blocked = pieces(examples.where(F.col("kinds") > HOT)).mapInArrow(_blocked(length), f"{shape}, a long, core long, c long, k array<bigint>")
    # written together, so that texts move once for both and each piece is read once
    found = reliable(found.unionByName(blocked, allowMissingColumns=True))
    runs = runs.unionByName(found.where("a is null").select("doc_id", "h", "lo", "end"))
    blocks = found.where("a is not null").distinct()
    sorts = blocks.groupBy("a", "core", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(place.alias("place"), "k")).alias("at"))
    same = blocks.join(sorts.where("times > 1").select("a", "core", "c", F.col("at.place").alias("first_place")), ["a", "core", "c"])
    # where several sorts share a core, their first blocks' strings are compared
    several = sorts.groupBy("a", "core").agg(F.count(F.lit(1)).alias("sorts")).where("sorts > 1")
    strings = sorts.join(several, ["a", "core"]).select("a", "at.place.doc_id", "at.place.h", F.col("at.place.lo").alias("start"), F.posexplode("at.k").alias("i", "k")).select(
        "a", "k", "doc_id", "h", (F.col("start") + F.col("i")).alias("lo")).withColumn("end", F.col("lo") + length)
    again = strings.groupBy("a", "k").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first_place")).where("times > 1")
    for more in (same, strings.join(again, ["a", "k"])):
        if keep_first:
            more = more.where(place > F.col("first_place"))
        runs = runs.unionByName(more.select("doc_id", "h", "lo", "end"))
    lists = runs.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("lo", "end"))).alias("runs"))
    keys = digest.select("doc_id", "h", "n", "sha")
    l2 = lists.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "runs")
    return keys.join(l2, keys.doc_id.eqNullSafe(l2.r_id) & (keys.h == l2.r_h), "left").drop("r_id", "r_h")


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in runs:
        if out and r["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["end"])
        else:
            out.append([r["lo"], r["end"]])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join(parts) + raw[at:]


def removed(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes left) of every row.

    Null and short texts lose nothing; repeated rows count as places of their own, so equal texts of ``length`` bytes
    or more go whole (but for the first, with ``keep_first``).  Only texts that keep a part are read again.
    """
    rows = reliable(repeats(docs, length, keep_first))
    fold = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("spans"), F.lit(-1).cast("long").alias("end")), lambda s, r: F.struct(
        (s["gone"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["lo"], s["end"]))).alias("gone"),
        (s["spans"] + F.when(r["lo"] > s["end"], 1).otherwise(0)).alias("spans"), F.greatest(s["end"], r["end"]).alias("end")))
    told = rows.withColumn("f", fold).select("doc_id", "h", F.col("n").alias("n_bytes"), F.coalesce("f.gone", F.lit(0)).cast("long").alias("n_removed"),
                                            F.coalesce("f.spans", F.lit(0)).cast("long").alias("n_spans"), "sha", "runs")
    whole = told.where("n_removed = 0 or n_removed = n_bytes").select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(
        F.col("n_removed") == 0, F.col("sha")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    part = told.where("n_removed > 0 and n_removed < n_bytes").select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "n_bytes", "n_removed", "n_spans", "runs").dropDuplicates(["r_id", "r_h"])
    both = own.join(part, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256(without(t.as_buffer().to_pybytes(), merged(r))).hexdigest() for t, r in zip(b.column(4), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sha, pa.string())], [*b.schema.names[:4], "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.unionByName(both.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
