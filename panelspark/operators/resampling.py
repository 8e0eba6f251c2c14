"""Bootstrap and cross-validation of the concordance index.

Counting follows ``survival.concordance``: two scores first differ at one bit of their dense rank, so pairs are counted
by running totals over duration within (bit, higher bits).  Here every subject carries a vector of weights, one for each
replicate, made from a hash of its key wherever it is needed, so that only keys are shuffled.  A subject enters a group
twice: it asks for the weight of the events before it, and, if it has an event, adds its own.  Asking comes first at
equal times, so rows of one time may lie in any partitions.  Partitions are cumulated locally in one pass; a first pass
leaves one vector a partition, from which each gets the total of the group it begins in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import total
from ..functions.ranks import value_ranks
from ..session import reliable
from .survival import E, T, c, concordance, cox, with_risk

_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])
# draws by the first 12 of 53 bits; in the few cells that hold a step of the distribution the other bits decide
_CELLS = np.arange(1 << 12, dtype=np.uint64) << np.uint64(41)
_DRAWS = np.searchsorted(_CDF, _CELLS / float(1 << 53), side="right").astype(float)
_SPLIT = _DRAWS != np.searchsorted(_CDF, (_CELLS + np.uint64((1 << 41) - 1)) / float(1 << 53), side="right")


def poisson_weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """Keys x (1 + draws): ones (the sample itself), then Poisson(1) weights by a hash of key and replicate."""
    z = keys.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = (z ^ (z >> np.uint64(31))) >> np.uint64(11)
    cell = (z >> np.uint64(41)).astype(np.intp)
    out = np.ones((len(keys), 1 + draws))
    out[:, 1:] = _DRAWS[cell]
    i, j = np.nonzero(_SPLIT[cell])
    out[i, j + 1] = np.searchsorted(_CDF, z[i, j] / float(1 << 53), side="right")
    return out


def _entries(df: DataFrame, score: str, key: str | Column) -> DataFrame:
    """Rows (bit, group, time, role, hash, high): role 0 asks, role 1 adds; bit -1 counts all comparable pairs."""
    d = reliable(df.where(c(score).isNotNull() & c(T).isNotNull()).select(c(T).alias("t"), c(E).alias("e"), c(score).alias("_s"), (F.xxhash64(key) if isinstance(key, str) else key.cast("long")).alias("key")))
    r = value_ranks(d, [], "_s").select("_s", "dense", "n_distinct")
    lv = F.sequence(F.lit(-1), F.ceil(F.log2(c("n_distinct") + 1.0)).cast("int"))
    e = d.join(r, "_s").withColumn("bit", F.explode(lv)).withColumn("role", F.explode(F.when(c("e") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    high = F.when(c("bit") < 0, c("role") == 1).otherwise(F.expr("shiftright(dense, greatest(bit, 0)) & 1L") == 1)
    return e.select("bit", F.when(c("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(dense, greatest(bit, 0) + 1)")).alias("grp"), "t", "role", "key", high.alias("high"))


def _pieces(b: pd.DataFrame, weigh: Callable, rows: int) -> Iterator[tuple]:
    """Slices of a partition with the weights, and for each row the totals so far (its own included) of the events of
    its group on the high and on the low side, as far as they are in this partition.

    Slices are small enough for a processor's cache to hold their rows x replicates."""
    same = np.r_[False, (b["bit"].to_numpy()[1:] == b["bit"].to_numpy()[:-1]) & (b["grp"].to_numpy()[1:] == b["grp"].to_numpy()[:-1])]
    base = None
    for s in range(0, len(b), rows):
        x = b.iloc[s:s + rows]
        w = weigh(x["key"].to_numpy())
        add, high = (x["role"].to_numpy() == 1), x["high"].to_numpy(bool)
        sums = [np.cumsum(w * (add & side)[:, None], axis=0) for side in (high, ~high)]
        begins = np.flatnonzero(~same[s:s + rows])
        base = [np.zeros(w.shape[1])] * 2 if base is None else base
        # a group's sum begins anew where it begins in this slice, and goes on from the slice before where it doesn't
        for k in range(2):
            if not len(begins):
                sums[k] += base[k]
                continue
            at = np.searchsorted(begins, np.arange(len(x)), side="right") - 1
            start = np.where((begins > 0)[:, None], sums[k][np.maximum(begins - 1, 0)], 0.0)
            level = np.concatenate([-base[k][None], start])
            sums[k] = sums[k] - level[at + 1]
        base = [m[-1] for m in sums]
        yield s, x, w, add, high, sums


def weighted_concordance(df: DataFrame, score: str, key: str | Column, weigh: Callable[[np.ndarray], np.ndarray], rows: int = 256) -> DataFrame:
    """One row for each column of ``weigh(keys)`` (hashes of a named key, the values of a given column): ``b``, weights of concordant, discordant and comparable pairs, and C.

    A pair weighs the product of its subjects' weights.  Ties of the score count half; equal times aren't compared.
    """
    spark = df.sparkSession
    e = _entries(df, score, key)
    order = ["bit", "grp", "t", "role", "key"]
    # rows equal in all of these may be anywhere: repeated keys are told apart by a number
    placed = reliable(e.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, "_tie")
                      .sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("part", F.spark_partition_id()))

    def ended(b: pd.DataFrame) -> pd.DataFrame:
        """The group a partition begins with, the one it ends with, and the total of that one in it."""
        b = b.sort_values(order).reset_index(drop=True)
        # only events of the last group count, so only these need weights
        last = ((b["bit"] == b["bit"].iloc[-1]) & (b["grp"] == b["grp"].iloc[-1]) & (b["role"] == 1)).to_numpy()
        hi = lo = weigh(b["key"].to_numpy()[:0]).sum(axis=0)
        x = b[last]
        for s in range(0, len(x), rows):
            w, high = weigh(x["key"].to_numpy()[s:s + rows]), x["high"].to_numpy(bool)[s:s + rows]
            hi, lo = hi + high @ w, lo + ~high @ w
        return pd.DataFrame({"part": b["part"].iloc[:1], "bit0": b["bit"].iloc[0], "grp0": b["grp"].iloc[0], "bit": b["bit"].iloc[-1], "grp": b["grp"].iloc[-1],
                             "hi": [hi], "lo": [lo]})

    kind = "part int, bit0 int, grp0 long, bit int, grp long, hi array<double>, lo array<double>"
    ends = reliable(placed.groupBy("part").applyInPandas(ended, kind))
    flat = ends.select("part", "bit", "grp", F.posexplode(F.arrays_zip("hi", "lo")).alias("i", "v")).select("part", "bit", "grp", "i", "v.hi", "v.lo")
    upto = Window.partitionBy("bit", "grp", "i").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    cum = flat.select("part", "bit", "grp", "i", F.sum("hi").over(upto).alias("hi"), F.sum("lo").over(upto).alias("lo"))
    cum = cum.groupBy("bit", "grp", "part").agg(*[F.array_sort(F.collect_list(F.struct("i", x)))[x].alias(x) for x in ("hi", "lo")])
    # a partition begins in the group that the one before it with rows ended with, or it begins a group
    before = ends.select("part", c("bit0").alias("bit"), c("grp0").alias("grp"), F.lag("part").over(Window.orderBy("part")).alias("prev"))  # one row a partition
    offsets = before.join(cum.withColumnRenamed("part", "prev"), ["bit", "grp", "prev"], "left").select("part", "hi", "lo")

    def count(b: pd.DataFrame, off: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({"b": [], "concordant": [], "discordant": [], "comparable": []})
        b = b.sort_values(order).reset_index(drop=True)
        carry = [np.asarray(off[x].iloc[0], float) if len(off) and off[x].iloc[0] is not None else 0.0 for x in ("hi", "lo")]
        begin = ((b["bit"] == b["bit"].iloc[0]) & (b["grp"] == b["grp"].iloc[0])).to_numpy()
        out = 0.0
        for s, x, w, add, high, sums in _pieces(b, weigh, rows):
            mine, ask, all_ = begin[s:s + len(x)], ~add, (x["bit"].to_numpy() < 0)
            # a row that asks needs one side only
            picks = ((ask & ~high & ~all_, 0), (ask & high & ~all_, 1), (ask & all_, 0))
            out = out + np.stack([np.einsum("ij,ij->j", w[r], sums[k][r]) + (mine[r] @ w[r]) * carry[k] for r, k in picks])
        return pd.DataFrame({"b": np.arange(out.shape[1]), "concordant": out[0], "discordant": out[1], "comparable": out[2]})

    parts = placed.groupBy("part").cogroup(offsets.groupBy("part")).applyInPandas(count, "b long, concordant double, discordant double, comparable double")
    g = parts.groupBy("b").agg(*[F.sum(x).alias(x) for x in ("concordant", "discordant", "comparable")])
    tied = c("comparable") - c("concordant") - c("discordant")
    return g.withColumn("c_index", (c("concordant") + 0.5 * tied) / F.nullif(c("comparable"), F.lit(0.0)))


def concordance_interval(df: DataFrame, score: str, key: str, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """C with its bootstrap error and percentile interval; subjects are drawn by Poisson weights, in one pass."""
    r = weighted_concordance(df, score, key, lambda keys: poisson_weights(keys, draws))
    a = (1 - level) / 2
    drawn = F.when(c("b") > 0, c("c_index"))
    return r.agg(F.max(F.when(c("b") == 0, c("c_index"))).alias("c_index"), F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("se"),
                 F.percentile(drawn, F.lit(a)).alias("lower"), F.percentile(drawn, F.lit(1 - a)).alias("upper"), F.count(drawn).alias("draws"))


def fold(key: str | Column, folds: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def cross_validated_concordance(df: DataFrame, xs: list[str], key: str, folds: int = 5) -> DataFrame:
    """C of the hazards model on each fold, fitted on the others; ``fold`` is a hash of the key. Mean in every row."""
    d = reliable(df.dropna(subset=[T, E, *xs]).select(key, T, E, *xs, fold(key, folds).alias("fold")))
    fits = [cox(d.where(c("fold") != k), xs) for k in range(folds)]
    risk = total([F.when(c("fold") == k, total([c(x) * float(b) for x, b in zip(xs, f.coef)])).otherwise(0.0) for k, f in enumerate(fits)])
    out = reliable(concordance(d.withColumn("risk", risk), "risk", ["fold"]))
    return out.crossJoin(F.broadcast(out.agg(F.avg("c_index").alias("mean_c"))))


def interval_of_fit(df: DataFrame, xs: list[str], key: str, draws: int = 1000) -> DataFrame:
    """The interval of C of the model fitted on all rows; the model is not fitted again for each draw."""
    d = reliable(df.dropna(subset=[T, E, *xs]).select(key, T, E, *xs))
    return concordance_interval(with_risk(d, cox(d, xs)), "risk", key, draws)


# ---- means --------------------------------------------------------------------------------------------

def bootstrap_means(df: DataFrame, key: str, value: str, by: list[str] | None = None, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """Mean of ``value`` per group with its bootstrap error and percentile interval; nulls are left out.

    Rows of one key are drawn together (a cluster bootstrap).  Weights are made where the rows are: a task sums weighted
    values of all replicates at once, so rows are neither copied for each replicate nor shuffled.
    """
    by = by or []
    d = df.where(c(value).isNotNull()).select(*by, F.xxhash64(key).alias("_key"), c(value).cast("double").alias("_v"))
    kind = ", ".join([*[f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by], "n long, s array<double>, w array<double>"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for name, g in b.groupby(by, dropna=False) if by else [((), b)]:
                name = name if isinstance(name, tuple) else (name,)
                name = tuple(None if v != v else v for v in name)
                for s in range(0, len(g), 2048):
                    w, v = poisson_weights(g["_key"].to_numpy()[s:s + 2048], draws), g["_v"].to_numpy()[s:s + 2048]
                    old = sums.get(name, (0, 0.0, 0.0))
                    sums[name] = (old[0] + len(v), old[1] + v @ w, old[2] + w.sum(axis=0))
            if len(sums) > 1000:
                yield _frame(sums, by)
                sums = {}
        if sums:
            yield _frame(sums, by)

    parts = d.mapInPandas(part, kind)
    flat = parts.select(*by, "n", F.posexplode(F.arrays_zip("s", "w")).alias("b", "x")).groupBy(*by, "b").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.w").alias("w"))
    m = flat.withColumn("m", c("s") / F.nullif(c("w"), F.lit(0.0)))
    drawn, a = F.when(c("b") > 0, c("m")), (1 - level) / 2
    return m.groupBy(*by).agg(F.max(F.when(c("b") == 0, c("n"))).alias("n"), F.max(F.when(c("b") == 0, c("m"))).alias("mean"), F.stddev_samp(drawn).alias("se"),
                              F.percentile(drawn, F.lit(a)).alias("lower"), F.percentile(drawn, F.lit(1 - a)).alias("upper"))


def _frame(sums: dict, by: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({"n": [v[0] for v in sums.values()], "s": [v[1] for v in sums.values()], "w": [v[2] for v in sums.values()]})
    for i, b in reversed(list(enumerate(by))):
        out.insert(0, b, [k[i] for k in sums])
    return out
