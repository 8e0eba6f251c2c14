"""Outlier findings: (company_id, year, metric, value, method, severity, confidence, action)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ladder
from ..functions.ranks import exact_quantiles
from ..session import reliable

c = F.col
COLS = ["company_id", "year", "metric", "value", "method", "severity", "confidence", "action"]

# fixed values: expected relative change by event and metric
EXPECTED_CHANGE = {
    "merger": {"total_assets": 0.5, "revenue": 0.3, "employees": 0.4, "rd_expenses": 0.2},
    "acquisition": {"total_assets": 0.3, "revenue": 0.25, "debt_ratio": 0.1},
    "divestiture": {"total_assets": -0.2, "revenue": -0.3, "employees": -0.25},
    "spinoff": {"total_assets": -0.15, "revenue": -0.2, "employees": -0.3},
    "bankruptcy": {"equity_ratio": -0.5, "current_ratio": -0.4, "interest_coverage": -0.8},
    "ipo": {"equity_ratio": 0.3, "cash_ratio": 0.5},
    "delisting": {"market_value": -0.6, "trading_volume": -0.8},
}
# fixed values: tolerated volatility by stage
STAGE_TOLERANCE = {"startup": 3.0, "maturity": 1.0, "decline": 2.0, "extinction": 5.0, "restructure": 4.0}


def _out(df: DataFrame, method: str, severity: Column, confidence: float, action: str | Column) -> DataFrame:
    a = action if isinstance(action, Column) else F.lit(action)
    return df.select("company_id", "year", "metric", "value", F.lit(method).alias("method"),
                     F.least(severity, F.lit(1.0)).alias("severity"), F.lit(confidence).alias("confidence"),
                     a.alias("action"))


def iqr(v: DataFrame, by: list[str], k: float = 1.5) -> DataFrame:
    """Outside the k x IQR fences of (metric, category); severity is the distance in IQR / k."""
    q = exact_quantiles(v, by, "value", {"q1": 0.25, "q3": 0.75}).drop("n")
    j = v.join(q, by)
    r = c("q3") - c("q1")
    lo, hi = c("q1") - k * r, c("q3") + k * r
    dist = F.greatest(lo - c("value"), c("value") - hi) / F.nullif(r, F.lit(0.0)) / k
    return _out(j.where((c("value") < lo) | (c("value") > hi)), "iqr", dist, 0.8, "investigate")


def zscore(v: DataFrame, by: list[str], t: float = 3.0) -> DataFrame:
    """|z| above t with the population deviation of the group."""
    st = v.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    j = v.join(st, by).withColumn("_z", F.abs(c("value") - c("_m")) / F.nullif(c("_s"), F.lit(0.0)))
    return _out(j.where(c("_z") > t), "zscore", c("_z") / t / 2.0, 0.85,
                F.when(c("_z") < t * 1.5, "flag").otherwise("investigate"))


def modified_zscore(v: DataFrame, by: list[str], t: float = 3.5) -> DataFrame:
    """0.6745 (x - median) / MAD, both medians exact; the input is read four times, so it is written once."""
    v = reliable(v)
    med = exact_quantiles(v, by, "value", {"med": 0.5}).drop("n")
    j = v.join(med, by).withColumn("_d", F.abs(c("value") - c("med")))
    mad = exact_quantiles(j, by, "_d", {"mad": 0.5}).drop("n")
    j = j.join(mad, by).withColumn("_z", 0.6745 * c("_d") / F.nullif(c("mad"), F.lit(0.0)))
    return _out(j.where(c("_z") > t), "modified_z", c("_z") / t / 2.0, 0.9,
                F.when(c("_z") > t * 1.2, "investigate").otherwise("flag"))


def _series() -> Window:
    return Window.partitionBy("company_id", "metric").orderBy("year")


def rolling(v: DataFrame, window: int = 5, t: float = 2.5) -> DataFrame:
    """Centered rolling z of full windows (one entity's series per partition)."""
    h = window // 2
    w = _series().rowsBetween(-h, h)
    full = F.count("value").over(w) >= window
    z = F.abs(c("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    j = v.withColumn("_z", F.when(full, z))
    return _out(j.where(c("_z") > t), "rolling", c("_z") / t / 2.0, 0.8, "investigate")


def change_rate(v: DataFrame, t: float = 3.0, min_n: int = 5, stage: str = "stage") -> DataFrame:
    """Changes beyond t standard deviations of the series' own changes, severity softened by stage."""
    w, all_ = _series(), Window.partitionBy("company_id", "metric")
    p = F.lag("value").over(w)
    d = v.withColumn("_r", (c("value") - p) / (F.abs(p) + 1e-6)).withColumn("_n", F.count("value").over(all_))
    d = d.withColumn("_s", F.stddev_pop("_r").over(all_))
    tol = ladder([(c(stage) == k, x) for k, x in STAGE_TOLERANCE.items()], 1.0)
    sev = F.least(F.abs(c("_r")) / F.nullif(t * c("_s"), F.lit(0.0)) / tol, F.lit(1.0))
    d = d.where((c("_n") >= min_n) & (c("_s") > 0) & (F.abs(c("_r")) > t * c("_s")))
    return _out(d, "change_rate", sev, 0.7, ladder([(sev > 0.8, "remove"), (sev > 0.5, "investigate")], "flag"))


def expected_change_table(spark) -> DataFrame:
    rows = [(e, m, x) for e, ms in EXPECTED_CHANGE.items() for m, x in ms.items()]
    return spark.createDataFrame(rows, "event_type string, metric string, expected double")


def event_context(v: DataFrame, events: DataFrame, k: int = 3, min_rows: int = 3, t: float = 2.0) -> DataFrame:
    """Event-year value against the mean of the years before, shifted by the expected change.

    The interval join keeps the entity as its equality key, so it stays hash partitioned.
    """
    ev = events.select("company_id", "event_type", c("year").alias("event_year"))
    j = v.join(ev, "company_id").where(c("year").between(c("event_year") - k, c("event_year") + k))
    pre, at = c("year") < c("event_year"), c("year") == c("event_year")
    g = j.groupBy("company_id", "metric", "event_type", "event_year").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(pre.cast("int")).alias("_np"),
        F.avg(F.when(pre, c("value"))).alias("_b"), F.stddev_samp(F.when(pre, c("value"))).alias("_s"),
        F.max(F.when(at, c("value"))).alias("value"))
    # fixed-size table of expected changes
    g = g.join(F.broadcast(expected_change_table(v.sparkSession)), ["event_type", "metric"], "left")
    exp = c("_b") * (1.0 + F.coalesce(c("expected"), F.lit(0.0)))
    g = g.withColumn("_dev", F.abs(c("value") - exp) / (c("_s") + 1e-6)).withColumn("year", c("event_year"))
    g = g.where((c("_n") >= min_rows) & (c("_np") >= 2) & (c("_s") != 0) & (c("_dev") > t))
    sev = F.least(c("_dev") / 5.0, F.lit(1.0))
    return _out(g, "event_context", sev, 0.85, F.when(sev > 0.6, "investigate").otherwise("flag"))


def accounting_change(v: DataFrame, change_years: list[int], limit: float = 0.5) -> DataFrame:
    """Changes above the limit from year-1 into a change year; adds ``before_value``."""
    p = F.max("value").over(_series().rangeBetween(-1, -1))
    d = v.withColumn("before_value", p).where(c("year").isin(change_years))
    r = F.abs((c("value") - c("before_value")) / F.nullif(c("before_value"), F.lit(0.0)))
    d = d.withColumn("_r", r).where((F.abs(c("before_value")) > 1e-6) & (c("_r") > limit))
    return _out(d, "accounting_change", c("_r"), 0.9, "transform")


def mahalanobis(df: DataFrame, cols: list[str], limit: float) -> DataFrame:
    """Squared distance from the mean under the sample covariance; rows above ``limit``.

    Mean and covariance come from one aggregate; only the k x k inverse is made on the driver.
    """
    from ..functions.finish import inverse

    k = len(cols)
    st = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(cols)],
                *[F.covar_samp(cols[i], cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    inv = inverse([[st[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    dev = [c(x) - float(st[f"m{i}"]) for i, x in enumerate(cols)]
    dist = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            dist = dist + dev[i] * dev[j] * float(inv[i][j])
    return df.withColumn("distance2", dist).withColumn("outlier", c("distance2") > limit)


def consolidate(findings: DataFrame) -> DataFrame:
    """One row per (entity, year, metric): largest severity with its action, confidence, methods."""
    return findings.groupBy("company_id", "year", "metric").agg(
        F.max("severity").alias("severity"), F.max("confidence").alias("confidence"),
        F.max_by("action", F.struct("severity", "confidence", "method")).alias("action"),
        F.concat_ws(",", F.sort_array(F.collect_set("method"))).alias("methods"), F.max("value").alias("value"))


def treat(v: DataFrame, found: DataFrame, strategy: str = "conservative") -> DataFrame:
    """Apply findings: remove rows, flag, or replace by the mean of the value before and after."""
    pick = {"conservative": c("severity") > 0.8, "aggressive": c("severity") > 0.5}.get(strategy, F.lit(True))
    how = c("action") if strategy != "conservative" else F.when(c("action") == "remove", "remove").otherwise("flag")
    f = found.where(pick).select("company_id", "year", "metric", "severity", how.alias("_how"))
    key = ["company_id", "year", "metric"]
    prev = F.lag("value").over(_series())
    j = v.withColumn("_prev", prev).join(f, key, "left").where(F.coalesce(c("_how"), F.lit("")) != "remove")
    return j.select(
        *key, F.when(c("_how") == "transform", (c("_prev") + c("value")) / 2.0).otherwise(c("value")).alias("value"),
        F.coalesce(c("_how"), F.lit("keep")).alias("treatment"))
