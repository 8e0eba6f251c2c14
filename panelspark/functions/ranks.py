"""Exact ranks, running totals and quantiles of groups of any size.

A window over a whole market would put the market in one task.  Here the
distinct values are counted first (with map-side combine), range-partitioned on
(group, value) so that a hot group spans many partitions, and each partition is
cumulated locally; partition totals (at most one row per partition and group)
supply the offsets.  The range assignment is checkpointed because offsets and
rows must see the same partition bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable


def running_totals(df: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``tot_<s>`` per group, ordered by ``order``.

    ``df`` must be unique on ``by + [order]``.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable(
        df.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id())
    )
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    offsets = totals.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_s_{s}").over(upto), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    local = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.select("*", *[F.sum(s).over(local).alias(f"_l_{s}") for s in sums])
    out = out.join(offsets, [*by, "_part"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_l_{s}") + F.col(f"_o_{s}"))
    return out.drop("_part", *[f"_l_{s}" for s in sums], *[f"_o_{s}" for s in sums])


def running_extreme(df: DataFrame, by: list[str], order: str, value: str, name: str, largest: bool = True,
                    inclusive: bool = True) -> DataFrame:
    """Running maximum or minimum of ``value`` in ``order`` per group, in the same two levels as the totals.

    The maximum of a struct led by the order column is the latest non-null value,
    which makes this the as-of and previous-row primitive for groups of any size.
    """
    agg, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable(
        df.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id())
    )
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(*by, "_part").agg(agg(value).alias("_m")).select(
        *by, "_part", agg("_m").over(upto).alias("_before"))
    end = 0 if inclusive else -1
    local = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    out = placed.withColumn("_l", agg(value).over(local)).join(tops, [*by, "_part"])
    return out.withColumn(name, pick("_l", "_before")).drop("_part", "_l", "_before")


def running_min(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    return running_extreme(df, by, order, value, name, largest=False)


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per distinct (group, value): ``cnt``, ``lt``, ``le``, ``n``, ``dense``, ``avg_rank``."""
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("cnt"), F.lit(1).alias("one"))
    )
    r = running_totals(counts, by, value, ["cnt", "one"])
    return r.select(
        *by, value, "cnt",
        (F.col("cum_cnt") - F.col("cnt")).alias("lt"), F.col("cum_cnt").alias("le"),
        F.col("tot_cnt").alias("n"), F.col("cum_one").alias("dense"), F.col("tot_one").alias("n_distinct"),
        (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"),
    )


def with_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Attach the rank columns of ``value_ranks`` to every row with a value.

    Rows and ranks read one written input: a second evaluation may give sums of doubles other last bits, and the
    join on the value would lose those rows.
    """
    df = reliable(df)
    return df.join(value_ranks(df, by, value), [*by, value])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, no group held in one task."""
    r = value_ranks(df, by, value)
    aggs: list[Column] = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n") - 1)
        aggs += [
            F.min(F.when(F.col("le") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("le") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
        ]
    g = r.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n") - 1)
        g = g.withColumn(
            name,
            F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (pos - F.floor(pos)),
        ).drop(f"_lo_{name}", f"_hi_{name}")
    return g


def quantiles_long(df: DataFrame, by: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns at once: one row per (group, metric)."""
    return exact_quantiles(long(df, by, cols), [*by, "metric"], "value", probs)


def long(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Wide to long with every value as a double."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        keys, cols, "metric", "value"
    )


def ks_distance(df: DataFrame, by: list[str], value: str, in_a: Column, in_b: Column) -> DataFrame:
    """Largest gap between two empirical distributions per group, from cumulative counts.

    ``in_a`` and ``in_b`` select the (possibly overlapping) samples.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.sum(in_a.cast("long")).alias("a"), F.sum(in_b.cast("long")).alias("b"))
    r = running_totals(counts, by, value, ["a", "b"])
    gap = F.abs(F.col("cum_a") / F.nullif(F.col("tot_a"), F.lit(0)) - F.col("cum_b") / F.nullif(F.col("tot_b"), F.lit(0)))
    return r.groupBy(*by).agg(F.max(gap).alias("ks"), F.max("tot_a").alias("n_a"), F.max("tot_b").alias("n_b"))
