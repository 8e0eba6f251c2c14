"""Near-duplicate documents: SimHash fingerprints linked through vantage-point trees.

Distances of random 64-bit fingerprints crowd around 32, where a radius of 4 prunes nothing.  The trees therefore
measure Hamming distance on a third of the bits first: two fingerprints at 4 or fewer differing bits differ in at
most one bit of some third, so each third has a tree of its own with radius 1 and the union of their finds is
complete.  Where a third cannot divide the points (many share it), the tree goes on with all 64 bits and radius 4.
Any masked distance obeys the triangle inequality, so a point farther than the radius from the boundary of a node
needs one side only; a point nearer is sent to both.  The top of each tree is made from a sample and names the
shards; every fingerprint has a home shard in each tree and is a guest in the shards across boundaries.  In a
shard the tree goes on in numpy until a block is small, and exact distances decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from .common import fresh, kept_rows
from .components import components

RADIUS = 4
FULL = (1 << 64) - 1
#: Bits 0-21, 22-42, 43-63.
THIRDS = ((1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43)
#: Fingerprints used to place the top of the trees; all are routed through them.
SAMPLE = 20_000
#: Home fingerprints wanted in a shard.
SHARD = 4096
#: Home fingerprints of a shard beyond which it is dealt in chunks even where its tree can go on inside the task.
LARGE = 1 << 21
#: Pairs compared in one numpy block.
BLOCK = 1 << 20
#: A fingerprint of more than one in so many rows is hot; there are fewer hot ones than that.
HOT = 2000


def fingerprint(text: bytes, n: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist())])
    grid = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    votes = sum((np.unpackbits(grid[i:i + 65_536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(grid), 65_536)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(votes * 2 > len(grid)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.array(out, np.uint64).view(np.int64))], [*b.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Columns ``keep`` (name -> SQL expression) and ``fp`` (long) of each document; a null text is empty."""
    rows = docs.select(F.col(text).alias("_text"), *[F.expr(e).alias(k) for k, e in keep.items()])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_fingerprints, f"{fields}, fp long")


def distance(a: np.ndarray, b, mask: int = FULL) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask))


def _cut(points: np.ndarray, mask: int, radius: int):
    """(vantage point, mu, share of rows sent on) of the best of a few vantage points; None if none divides."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = distance(points, v, mask)
        for mu in {int(np.median(d)), int(np.median(d)) - 1}:
            left, extra = int((d <= mu).sum()), int(((d > mu - radius) & (d <= mu)).sum())
            most = max(left, len(points) - left + extra)
            if 0 < left < len(points) and most < 0.9 * len(points) and (best is None or most < best[2]):
                best = (v, mu, most)
    return best


class Tree:
    """Top of a vantage-point tree: node i sends points to children[i], a negative child -k-1 is shard k."""

    def __init__(self, sample: np.ndarray, mask: int, leaf: int) -> None:
        self.nodes: list[list] = []
        self.shards = 0
        self.dense: set[int] = set()  # shards that no vantage point divides
        self.root = self._grow(sample, [(mask, 1), (FULL, RADIUS)], leaf)

    def _grow(self, points: np.ndarray, metrics: list[tuple[int, int]], leaf: int) -> int:
        if len(points) > leaf:
            for k, (mask, radius) in enumerate(metrics):
                if cut := _cut(points, mask, radius):
                    v, mu, _ = cut
                    d = distance(points, v, mask)
                    i = len(self.nodes)
                    self.nodes.append([v, mask, radius, mu, None, None])
                    self.nodes[i][4] = self._grow(points[d <= mu], metrics[k:], leaf)
                    self.nodes[i][5] = self._grow(points[d > mu], metrics[k:], leaf)
                    return i
            self.dense.add(self.shards)
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, home points, guests).  Of two points that a node parts, the left one visits the right side."""
        todo = [(self.root, points, points[:0])]
        while todo:
            i, home, guest = todo.pop()
            if not len(home) and not len(guest):
                continue
            if i < 0:
                yield -i - 1, home, guest
                continue
            left, right = _parted(self.nodes[i][:4], home, guest)
            todo += [(self.nodes[i][4], *left), (self.nodes[i][5], *right)]


def _parted(node, home: np.ndarray, guest: np.ndarray):
    v, mask, radius, mu = node
    d, g = distance(home, v, mask).astype(np.int16), distance(guest, v, mask).astype(np.int16)
    left = (home[d <= mu], guest[g - radius <= mu])
    right = (home[d > mu], np.concatenate((guest[g + radius > mu], home[(d <= mu) & (d + radius > mu)])))
    return left, right


def block_links(home: np.ndarray, guest: np.ndarray) -> list[np.ndarray]:
    """Links within ``home`` and from ``guest`` to ``home``, as (n, 2) arrays: enough of them to join all that link.

    Blocks with many pairs give spanning links only, so the output never exceeds 8 rows a point.
    """
    out = []
    both = np.concatenate((home, guest))
    step = max(1, BLOCK // max(1, len(home)))
    for s in range(0, len(both), step):
        part = both[s:s + step]
        q, h = np.nonzero(np.bitwise_count(part[:, None] ^ home[None, :]) <= RADIUS)
        keep = part[q] != home[h]
        q, h = part[q[keep]], home[h[keep]]
        if len(q) > 8 * (len(part) + len(home)):
            out += spanning(np.unique(q), np.unique(h))
        elif len(q):
            out.append(np.stack((q, h), axis=1))
    return out


def spanning(q: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Links of a search tree over the links between q and h, each point visited once."""
    out, rest = [], [q, h]
    while len(rest[0]):
        todo = [(0, rest[0][0])]
        rest[0] = rest[0][1:]
        while todo:
            side, p = todo.pop()
            far = distance(rest[1 - side], p) > RADIUS
            found, rest[1 - side] = rest[1 - side][~far], rest[1 - side][far]
            if len(found):
                out.append(np.stack((np.full(len(found), p), found), axis=1))
                todo += [(1 - side, x) for x in found]
    return out


def shard_links(home: np.ndarray, guest: np.ndarray, mask: int) -> list[np.ndarray]:
    todo, out = [(home, guest, [(mask, 1), (FULL, RADIUS)])], []
    while todo:
        home, guest, metrics = todo.pop()
        if not len(home) or len(home) + len(guest) < 2:
            continue
        if len(home) * (len(home) + len(guest)) > BLOCK:
            for k, (m, radius) in enumerate(metrics):
                if cut := _cut(home, m, radius):
                    left, right = _parted((cut[0], m, radius, cut[1]), home, guest)
                    todo += [(*left, metrics[k:]), (*right, metrics[k:])]
                    break
            else:
                out += block_links(home, guest)
        else:
            out += block_links(home, guest)
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column ``fp``) at RADIUS or fewer differing bits.

    Shards hold about SHARD home points, or n / SAMPLE times a few where that is more; the tree of a larger shard goes on
    inside its task.  A shard that no vantage point divides is dealt as a grid of chunk pairs of SHARD points each, so
    that no task grows with the densest group, and any other one in chunks of LARGE.
    """
    n = fps.count()
    # about SAMPLE of any number of fingerprints, those of least hash
    some = fps.select(F.xxhash64("fp", F.lit(7)).alias("order"), "fp")
    if n > SAMPLE:
        some = some.where(F.col("order") < int((SAMPLE / n - 0.5) * 2.0 ** 64))
    sample = np.array([r.fp for r in sorted(some.collect())], np.int64).view(np.uint64)
    trees = [Tree(sample, m, max(2, len(sample) * SHARD // max(n, 1))) for m in THIRDS]
    base = np.cumsum([0] + [t.shards for t in trees])

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            yield pd.DataFrame([(int(base[k]) + s, len(h)) for k, t in enumerate(trees) for s, h, _ in t.route(x)], columns=["shard", "n"])

    sizes = fps.mapInPandas(homes, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    dense = {int(b) + s for b, t in zip(base, trees) for s in t.dense}
    size = lambda shard: SHARD if shard in dense else LARGE
    chunks = {r.shard: -(-r.n // size(r.shard)) for r in sizes if r.n > 4 * size(r.shard)}

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            for k, t in enumerate(trees):
                for s, home, guest in t.route(x):
                    shard, c = int(base[k]) + s, chunks.get(int(base[k]) + s, 1)
                    h = (home * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(c)
                    for i in range(c):
                        for j in range(i, c):
                            # cell (i, j): chunk j at home, chunk i as guests; (i, i) also has the guests of the shard
                            inside, across = home[h == j], home[h == i][: None if i < j else 0]
                            visit = np.concatenate((across, guest)) if i == j else across
                            pts = np.concatenate((inside, visit))
                            yield pd.DataFrame({"shard": shard, "cell": i * c + j, "k": k, "guest": np.arange(len(pts)) >= len(inside), "fp": pts.view(np.int64)})

    def joined(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = b["fp"].to_numpy().view(np.uint64)
        g = b["guest"].to_numpy()
        found = shard_links(x[~g], np.unique(x[g]), THIRDS[int(b["k"].iloc[0])])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        return pd.DataFrame(pairs.view(np.int64), columns=["a", "b"])

    rows = fps.mapInPandas(routed, "shard long, cell long, k int, guest boolean, fp long")
    return rows.groupBy("shard", "cell").applyInPandas(joined, "a long, b long")


def grouped(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` (kept on disk; ``key`` and ``fp``) with ``component_id``, the smallest key reachable.

    Rows of one fingerprint are linked; null keys have no part in the minimum (null if a component has no other).
    Rows of hot fingerprints, of which there are fewer than HOT at any size, meet their component by broadcast and
    stay where they are; the others are joined by shuffle.
    """
    points = reliable(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")))
    most = (points.agg(F.sum("n")).first()[0] or 0) / HOT
    tree = reliable(components(links(points.select("fp"))))
    tops = tree.join(points, tree.node == points.fp).groupBy("root").agg(F.min("first").alias("top"))
    member = tree.join(tops, "root").select(F.col("node").alias("fp"), "top")
    of = reliable(points.join(member, "fp", "left").select("fp", (F.col("n") > most).alias("hot"), F.coalesce("top", "first").alias("component_id")))
    hot = F.broadcast(of.where("hot").drop("hot"))
    rest = rows.join(hot, "fp", "left_anti").join(of.where("not hot").drop("hot"), "fp")
    return rows.join(hot, "fp").unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts have fingerprint 0 and form one component with texts near it; repeated rows stay.
    """
    rows = grouped(kept_rows(fingerprints(docs, {"doc_id": "doc_id"})))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns.

    Null ids come last, ties go to the text with the smallest hash, and of equal rows one stays.
    """
    h, d = fresh(docs, "_hash", "_id")
    rows = kept_rows(fingerprints(docs, {"doc_id": "doc_id", "text_hash": "xxhash64(text)"}))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = grouped(rows.withColumn("id", first), "id").groupBy("component_id").agg(F.first("component_id.doc_id").alias("doc_id"), F.first("component_id.text_hash").alias("text_hash"))
    keep = best.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    named = docs.withColumn(h, F.xxhash64("text")).withColumn(d, F.col("doc_id"))
    return named.dropDuplicates([d, h]).join(keep, named[d].eqNullSafe(keep[d]) & (named[h] == keep[h]), "left_semi").select(
        *[f"`{c}`" for c in docs.columns])
