"""Mixing sources to target weights from fixed-length blocks.

The words of a source, document after document, are cut into blocks of ``BLOCK`` words (the last is shorter).  A source
is taken in epochs; epoch e visits its blocks in a pseudorandom order (a keyed permutation of the block numbers), so
the slots 0, 1, 2, ... of a source name blocks without any table.  The last slot is cut so that the source's total is
its target.  Output shards get their source counts by multinomial draws conditioned on the sources' slot totals: a
binary tree over the shards splits the totals by multivariate hypergeometric draws, each node seeded by its place,
so any task can draw its shard alone and reruns agree.  Slots and document pieces are joined by block number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_totals
from .common import fresh, kept_rows, n_words, words

BLOCK = 512
SHARD_SLOTS = 4096
WEIGHTS = (1, 2, 3)
MOST = 3


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; the excess goes to the others."""
    total, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        share = total / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            total -= out[i]
        open_ -= full
    return out


def plan(size: int, target: Fraction, key: int, block: int = BLOCK) -> dict:
    """Epochs, blocks and slots that give floor(target) words of a source with ``size`` words."""
    want = int(target)
    if size == 0:
        return {"blocks": 0, "slots": 0, "last": 0}
    blocks = -(-size // block)
    short = size - (blocks - 1) * block
    epochs, rest = divmod(want, size)
    # words of the first k slots of the last epoch; one of them may be the short block
    place = int(unpermuted(np.array([blocks - 1]), blocks, key, epochs)[0])
    given = lambda k: k * block - (block - short if place < k else 0)
    k = ceil(rest / block)
    if given(k) < rest:
        k += 1
    last = rest - given(k - 1) if rest else 0
    return {"blocks": blocks, "slots": epochs * blocks + k, "last": last}


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rounds(x: np.ndarray, n: int, key: int, epoch: int, back: bool) -> np.ndarray:
    """Four Feistel rounds over the least even number of bits that holds ``n`` values; strays walk on until they are below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    h, low = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [key * 31 + epoch * 1_000_003 + r * 7919 for r in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> h, v & low
        for k in reversed(keys) if back else keys:
            a, b = (b ^ (_mix(a, k) & low), a) if back else (b, a ^ (_mix(b, k) & low))
        return (a << h) | b

    out = once(x.astype(np.uint64))
    while (stray := out >= n).any():
        out[stray] = once(out[stray])
    return out.astype(np.int64)


def permuted(place: np.ndarray, n: int, key: int, epoch: int) -> np.ndarray:
    """Block at each place of the epoch's order, a permutation of 0..n-1."""
    return _rounds(place, n, key, epoch, False)


def unpermuted(block: np.ndarray, n: int, key: int, epoch: int) -> np.ndarray:
    return _rounds(block, n, key, epoch, True)


#: Numpy's exact draws need totals below this.
EXACT_TOTAL = 10**9


def without_replacement(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` items drawn without replacement come from each kind, of which ``left`` are there.

    From ``EXACT_TOTAL`` items on, kind by kind: where few of a kind are there each is taken or not by itself, else the
    count is a rounded normal with the mean and variance of the exact draw, which it then cannot be told from.
    """
    total = int(left.sum())
    if total < EXACT_TOTAL:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros(len(left), np.int64)
    for i, good in enumerate(left.tolist()):
        bad = total - good
        if total < EXACT_TOTAL:
            k = int(rng.hypergeometric(good, bad, n)) if n else 0
        elif good < 10_000:
            k = int(rng.binomial(good, n / total))
        else:
            p = n / total
            k = round(good * p + rng.standard_normal() * (good * p * (1 - p) * (bad / max(1, total - 1))) ** 0.5)
        out[i] = k = min(max(k, 0, n - bad), good, n)
        n, total = n - k, bad
    return out


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of each source in an output shard."""
    lo, hi, first, left = 0, shards, np.zeros(len(slots), np.int64), slots.astype(np.int64).copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take = without_replacement(rng, left, int(left.sum()) * (mid - lo) // (hi - lo))
        if shard < mid:
            hi, left = mid, take
        else:
            lo, first, left = mid, first + take, left - take
    return first, left


def mixture(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sources, slices) for ``rows`` (kept on disk: _row, source, order columns doc_id, size).

    sources: source, number, source_size, target.  slices: one per document piece and slot that takes it: _row, epoch,
    shard, slot, start (first word in the document), n (words).  Documents of a source are laid out by doc_id through
    range partitions, so a hot source spans many.  Only one row per source reaches the driver.
    """
    spark = rows.sparkSession
    by = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").isNull(), "source").collect()
    goal = targets([r["size"] for r in by], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(by))])
    plans = [plan(r["size"], g, i, block) for i, (r, g) in enumerate(zip(by, goal))]
    schema = "source string, number int, source_size long, target double, blocks long, slots long, last long"
    sources = spark.createDataFrame([(r["source"], i, r["size"], float(g), p["blocks"], p["slots"], p["last"])
                                     for i, (r, g, p) in enumerate(zip(by, goal, plans))], schema)
    slots = np.array([p["slots"] for p in plans], np.int64)
    blocks = [p["blocks"] for p in plans]
    shards = max(1, -(-int(slots.sum()) // SHARD_SLOTS)) if len(slots) else 0

    def shard_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"].tolist():
                first, count = shard_counts(slots, shards, shard)
                for s in np.flatnonzero(count).tolist():
                    k = np.arange(first[s], first[s] + count[s])
                    for e in np.unique(k // blocks[s]).tolist():
                        own = k[k // blocks[s] == e]
                        yield pd.DataFrame({"number": s, "block": permuted(own % blocks[s], blocks[s], s, e), "epoch": e, "shard": shard, "slot": own})

    drawn = spark.range(0, shards, 1, max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInPandas(
        shard_slots, "number int, block long, epoch long, shard long, slot long")
    placed = rows.where("size > 0").join(sources.select("source", "number", "slots", "last"), rows.source.eqNullSafe(sources.source)).select(
        "_row", "number", "slots", "last", "size", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("place"))
    laid = running_totals(placed, ["number"], "place", ["size"]).withColumn("at", F.col("cum_size") - F.col("size"))
    piece = laid.select("_row", "number", "slots", "last", "at", "size", F.explode(
        F.sequence((F.col("at") / block).cast("long"), ((F.col("cum_size") - 1) / block).cast("long"))).alias("block"))
    piece = piece.withColumn("from", F.greatest("at", F.col("block") * block)).withColumn(
        "to", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block))
    # the planner takes the slots to be as few as the shards: they must not be broadcast
    hits = piece.join(drawn.hint("merge"), ["number", "block"])
    # the last slot of a source is cut
    upto = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("last") > 0), F.least("to", F.col("block") * block + F.col("last"))).otherwise(F.col("to"))
    slices = hits.withColumn("n", upto - F.col("from")).where("n > 0").select(
        "_row", "epoch", "shard", "slot", (F.col("from") - F.col("at")).alias("start"), "n")
    return sources, slices


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    Null texts have size 0; a null source is a source; repeated rows are documents of their own.
    """
    rows = kept_rows(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")))
    sources, slices = mixture(rows)
    got = slices.groupBy("_row").agg(F.sum("n").alias("taken"))
    return rows.join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).join(
        got, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each epoch of a document gives one row, its taken words in document order.

    Whole texts stay as they are; of a text taken in part, the taken words are joined by one space.  Columns are those
    of ``docs``; ``n_chars``, where there is one, is counted anew.  Rows equal in doc_id and text count once.
    Texts are shuffled once, to meet their slices.
    """
    h, d, w, s = fresh(docs, "_hash", "_id", "_words", "_slices")
    base = docs.withColumn(h, F.xxhash64("text")).withColumn(d, F.col("doc_id")).dropDuplicates([d, h])
    key = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = kept_rows(key.dropDuplicates(["doc_id", "hash"]))
    _, slices = mixture(rows)
    spans = slices.groupBy("_row", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"), F.sum("n").alias("n"))
    spans = spans.join(rows, "_row").select(F.col("doc_id").alias(f"{d}2"), F.col("hash").alias(f"{h}2"), "epoch", F.when(F.col("n") < F.col("size"), F.col("spans")).alias(s))
    out = base.join(spans, base[d].eqNullSafe(spans[f"{d}2"]) & base[h].eqNullSafe(spans[f"{h}2"])).withColumn(w, F.when(F.col(s).isNotNull(), words(F.col("text"))))
    part = F.concat_ws(" ", F.flatten(F.transform(s, lambda x: F.slice(w, (x["start"] + 1).cast("int"), x["n"].cast("int")))))
    out = out.withColumn("text", F.when(F.col(s).isNull(), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
