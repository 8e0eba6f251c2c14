"""Alignment of panels to a calendar grid, lifetimes and survival weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ladder, with_totals
from ..functions.windows import W, last_known, next_known


def align(panel: DataFrame, entities: DataFrame, start: int, end: int, entity: str = "company_id",
          period: str = "year", carry: list[str] | None = None) -> DataFrame:
    """Entity x year grid with the data joined on; ``exists_flag`` marks the lifetime.

    The grid is exploded from the entity rows, so it needs no cross join.
    """
    carry = carry or ["start_year", "end_year"]
    grid = entities.select(entity, *carry).withColumn(period, F.explode(F.sequence(F.lit(start), F.lit(end))))
    return grid.join(panel, [entity, period], "left").withColumn(
        "exists_flag", F.col(period).between(F.col("start_year"), F.col("end_year"))
    )


def lifetime_stage(df: DataFrame, period: str = "year") -> DataFrame:
    """Normalized lifetime t = (y - start) / max(n - 1, 1) and its stage."""
    span = F.greatest(F.col("end_year") - F.col("start_year"), F.lit(1))
    t = F.when(F.col("exists_flag"), (F.col(period) - F.col("start_year")) / span)
    d = df.withColumn("lifetime", t)
    t = F.col("lifetime")
    return d.withColumn("life_stage", ladder(
        [(t.isNull(), "non_existent"), (t <= 0.2, "startup"), (t <= 0.6, "growth"), (t <= 0.9, "mature")],
        "decline_or_stable"))


def availability(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of non-null values, zero outside the lifetime."""
    share = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) / len(cols)
    return df.withColumn("data_availability", share * F.col("exists_flag").cast("int"))


def yearly_survival_weight(df: DataFrame, entity: str = "company_id", period: str = "year") -> DataFrame:
    """1 / max(existing / total, 0.1) for existing rows; counts are aggregated per year first."""
    total = df.select(entity).distinct().agg(F.count(F.lit(1)).alias("total_entities"))
    per = df.groupBy(period).agg(F.sum(F.col("exists_flag").cast("int")).alias("existing"))
    rate = F.col("existing") / F.col("total_entities")
    # one row per calendar period
    w = with_totals(per, total).select(
        period, F.when(rate > 0.1, 1.0 / rate).otherwise(10.0).alias("_w"))
    return df.join(F.broadcast(w), period, "left").withColumn(
        "survival_weight", F.when(F.col("exists_flag"), F.col("_w")).otherwise(0.0)).drop("_w")


def panel_ids(df: DataFrame, entity: str = "company_id", period: str = "year") -> DataFrame:
    """Dense ids for entity and period; numbering runs over distinct keys by range partitions."""
    from ..functions.ranks import value_ranks

    ent = value_ranks(df.select(entity).distinct(), [], entity).select(
        entity, F.col("dense").alias("entity_id"))
    per = df.select(period).distinct()
    # one row per calendar period
    per = per.select(period, F.dense_rank().over(Window.orderBy(period)).alias("period_id"))
    return df.join(ent, entity).join(F.broadcast(per), period)


def linear_fill(c: str, entity: str = "company_id", period: str = "year") -> Column:
    """Interpolate between the nearest known values on the period axis; ends stay null."""
    known_p = F.when(F.col(c).isNotNull(), F.col(period))
    p0, p1 = last_known(known_p, entity, period), next_known(known_p, entity, period)
    v0, v1 = last_known(c, entity, period), next_known(c, entity, period)
    return F.coalesce(F.col(c), v0 + (v1 - v0) * (F.col(period) - p0) / F.nullif(p1 - p0, F.lit(0)))


def limited_fill(c: str, limit: int, forward: bool = True, entity: str = "company_id",
                 period: str = "year") -> Column:
    """Carry the last (or next) known value at most ``limit`` rows."""
    w = W(entity, period)
    if forward:
        return F.last(F.col(c), ignorenulls=True).over(w.rowsBetween(-limit, 0))
    return F.first(F.col(c), ignorenulls=True).over(w.rowsBetween(0, limit))
