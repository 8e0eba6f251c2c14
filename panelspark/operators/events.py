"""Event-ledger joins and sessions that hold when one entity owns a third of all events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_extreme, running_totals

c = F.col


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, cols: list[str]) -> DataFrame:
    """Attach the latest right row at or before the left row's time.

    Both sides lie on one time axis per key; the running maximum of
    (time, values) is the as-of row, whatever the size of the key.
    """
    lcols = [x for x in left.columns if x not in (*by, time)]
    # a right row sorts before a left row of the same time
    r = right.select(*by, time, F.lit(0).alias("_side"), F.struct(c(time).alias("_t"), *cols).alias("_v"),
                     F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    lf = left.select(*by, time, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    u = r.unionByName(lf).withColumn("_ord", F.struct(time, "_side"))
    out = running_extreme(u, by, "_ord", "_v", "_last").where("_side = 1")
    return out.select(*by, time, *[c(f"_row.{x}").alias(x) for x in lcols], c("_last._t").alias(f"{time}_matched"), *[c(f"_last.{x}").alias(x) for x in cols])


def sessionize(df: DataFrame, entity: str, ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Number the sessions of every entity: a new one starts ``gap_seconds`` or more after the previous event."""
    d = df.withColumn("_ord", F.struct(ts, tie))
    d = running_extreme(d, [entity], "_ord", ts, "_prev", inclusive=False)
    gap = c(ts).cast("double") - c("_prev").cast("double")
    d = d.withColumn("_start", F.when(c("_prev").isNull() | (gap >= gap_seconds), 1).otherwise(0))
    return running_totals(d, [entity], "_ord", ["_start"]).withColumnRenamed("cum__start", "session").drop("_ord", "_prev", "_start", "tot__start")


def interval_rows(df: DataFrame, events: DataFrame, key: str, period: str, before: int, after: int) -> DataFrame:
    """Rows within [event - before, event + after] of the entity's events, labelled pre / at / post.

    The event side is exploded to its periods, so the join is a plain equality on
    (entity, period): no range comparison over a hot entity's rows.
    """
    ev = events.select(key, c(period).alias("event_period"), F.explode(F.sequence(c(period) - before, c(period) + after)).alias(period))
    j = df.join(ev, [key, period])
    return j.withColumn("side", F.when(c(period) < c("event_period"), "pre").when(c(period) > c("event_period"), "post").otherwise("at"))
