"""Window vocabulary of the panel.

Entity windows are safe at any scale because a panel is unique on
(entity, period): a partition holds one row per period, never raw facts.
Markets, categories and other large groups are *not* windowed row by row; see
``functions.ranks`` and the aggregate-then-join operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .cols import col


def W(entity: str = "company_id", period: str = "year") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(period)


def rows(k: int, end: int = 0, entity: str = "company_id", period: str = "year") -> WindowSpec:
    """The last ``k`` rows up to ``end``."""
    return W(entity, period).rowsBetween(-k + 1 if end == 0 else -k, end)


def years(lo: int, hi: int, entity: str = "company_id", period: str = "year") -> WindowSpec:
    """Calendar frame [t+lo, t+hi] on the integer period."""
    return W(entity, period).rangeBetween(lo, hi)


def whole(entity: str = "company_id") -> WindowSpec:
    return Window.partitionBy(entity)


def year_lag(c: str | Column, k: int = 1, **kw) -> Column:
    """Value exactly ``k`` periods earlier; null when that period has no row."""
    return F.max(col(c)).over(years(-k, -k, **kw))


def full_window(agg: Column, c: str | Column, w: WindowSpec, k: int) -> Column:
    """Rolling aggregate that is null until ``k`` non-null rows are present."""
    return F.when(F.count(col(c)).over(w) >= k, agg.over(w))


def growth(c: str | Column, k: int = 1, **kw) -> Column:
    """Relative change against ``k`` rows earlier."""
    c = col(c)
    prev = F.lag(c, k).over(W(**kw))
    return c / F.nullif(prev, F.lit(0.0)) - 1.0


def latest_rows(df: DataFrame, entity: str = "company_id", period: str = "year") -> DataFrame:
    """The row of each entity's last period, whichever period that is."""
    row = F.max_by(F.struct(*df.columns), period).alias("_row")
    return df.where(F.col(period).isNotNull()).groupBy(F.col(entity).alias("_entity")).agg(row).select("_row.*")


def runs(df: DataFrame, value: Column, entity: str = "company_id", period: str = "year",
         name: str = "run_id") -> DataFrame:
    """Number consecutive rows of equal ``value`` (gaps and islands)."""
    w = W(entity, period)
    tmp = "_run_value"
    d = df.withColumn(tmp, value)
    change = F.when(F.lag(tmp).over(w).eqNullSafe(F.col(tmp)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return (
        d.withColumn("_chg", change)
        .withColumn(name, F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("_chg", tmp)
    )


def last_known(c: str | Column, entity: str = "company_id", period: str = "year") -> Column:
    """As-of value: latest non-null at or before the row."""
    return F.last(col(c), ignorenulls=True).over(
        W(entity, period).rowsBetween(Window.unboundedPreceding, 0)
    )


def next_known(c: str | Column, entity: str = "company_id", period: str = "year") -> Column:
    return F.first(col(c), ignorenulls=True).over(
        W(entity, period).rowsBetween(0, Window.unboundedFollowing)
    )
