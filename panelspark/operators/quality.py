"""Validation as DataFrames of findings: (company_id, year, rule, severity, field, value).

Rules are column predicates or aggregates with map-side combine; nothing is
collected.  Per-entity statistics are bounded by the number of periods, global
quantiles go through ``functions.ranks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, sd, total, with_totals
from ..functions.ranks import exact_quantiles, ks_distance, long, quantiles_long
from ..functions.windows import W
from ..session import reliable

c = F.col
FINDING = ["company_id", "year", "rule", "severity", "field", "value"]

# fixed ranges of valid values
RANGES = {
    "total_assets": (0.0, None), "revenue": (0.0, None), "equity_ratio": (0.0, 1.0), "roe": (-1.0, 3.0),
}


def finding(df: DataFrame, check: str, severity: str | Column, field: str | Column, value: Column,
            year: str | Column = "year") -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    fld = field if isinstance(field, Column) else F.lit(field)
    yr = year if isinstance(year, Column) else c(year)
    return df.select("company_id", yr.cast("int").alias("year"), F.lit(check).alias("rule"), sev.alias("severity"),
                     fld.alias("field"), value.cast("double").alias("value"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Required columns that the schema lacks, one row each."""
    missing = [r for r in required if r not in df.columns]
    return df.sparkSession.createDataFrame([(m,) for m in missing], "field string")


def type_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-numeric values per field."""
    bad = [F.sum(flag(c(x).isNotNull() & c(x).cast("string").try_cast("double").isNull())).cast("long").alias(x)
           for x in cols]
    return df.agg(*bad).unpivot([], cols, "field", "n_bad")


def range_check(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]] = RANGES) -> DataFrame:
    """Per entity and field: count, min and max of the values outside the range."""
    v = long(df, ["company_id"], list(ranges))
    bad = F.lit(False)
    for f, (lo, hi) in ranges.items():
        out = F.lit(False)
        out = out | (c("value") < lo) if lo is not None else out
        out = out | (c("value") > hi) if hi is not None else out
        bad = bad | ((c("metric") == f) & out)
    return v.where(bad).groupBy("company_id", "metric").agg(
        F.count("value").alias("n_bad"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def continuity(panel: DataFrame, entities: DataFrame, start: int, end: int, max_gap: int = 3,
               min_points: int = 5) -> DataFrame:
    """Missing years inside the expected span, longest missing run, severity."""
    lo = F.greatest(F.lit(start), c("start_year"))
    hi = F.least(F.lit(end), F.coalesce(F.year("extinction"), F.lit(end)))
    grid = entities.where(lo <= hi).select("company_id", F.explode(F.sequence(lo, hi)).alias("year"))
    have = panel.select("company_id", "year").distinct()
    gaps = grid.join(have, ["company_id", "year"], "left_anti")
    runs = gaps.withColumn("_isle", c("year") - F.row_number().over(W())).groupBy("company_id", "_isle").agg(
        F.count(F.lit(1)).alias("run"))
    per = runs.groupBy("company_id").agg(F.sum("run").alias("missing"), F.max("run").alias("longest"))
    pts = have.groupBy("company_id").agg(F.count(F.lit(1)).alias("points"))
    sev = F.when((c("longest") > max_gap) | (c("points") < min_points), "critical").when(
        c("missing") > 0, "warning").otherwise("ok")
    return (entities.select("company_id").join(per, "company_id", "left").join(pts, "company_id", "left")
            .na.fill(0, ["missing", "longest", "points"]).withColumn("severity", sev))


def identities(df: DataFrame, tol: float = 0.01) -> DataFrame:
    """Balance sheet and gross profit identities outside the tolerance."""
    bal = F.abs(c("total_assets") - (c("total_liabilities") + c("shareholders_equity"))) / F.nullif(
        c("total_assets"), F.lit(0.0))
    gp = F.abs(c("gross_profit") - (c("revenue") - c("cost_of_sales"))) / F.nullif(F.abs(c("gross_profit")), F.lit(0.0))
    d = df.select("*", bal.alias("_bal"), gp.alias("_gp"))
    return union_all([
        finding(d.where(c("_bal") > tol), "balance_sheet", "warning", "total_assets", c("_bal")),
        finding(d.where(c("_gp") > tol), "gross_profit", "warning", "gross_profit", c("_gp"))])


def lifecycle_rows(df: DataFrame, grace: int = 2) -> DataFrame:
    """Rows before establishment or later than extinction + grace years."""
    born, gone = F.year("established"), F.year("extinction")
    return union_all([
        finding(df.where(c("year") < born), "before_establishment", "warning", "year", born - c("year")),
        finding(df.where(c("year") > gone + grace), "after_extinction", "critical", "year", c("year") - gone)])


def metadata_rules(e: DataFrame, today: str, oldest: int = 1900) -> DataFrame:
    """Future dates, extinct without date, start on or after end, implausible years."""
    t = F.lit(today).cast("date")
    y = F.year("established")
    out = [
        finding(e.where(c("established") > t), "future_establishment", "critical", "established", y, y),
        finding(e.where(c("extinction") > t), "future_extinction", "critical", "extinction", F.year("extinction"), y),
        finding(e.where((c("status") == "extinct") & c("extinction").isNull()), "extinct_without_date", "critical",
                "extinction", F.lit(0.0), y),
        finding(e.where(c("established") >= c("extinction")), "start_after_end", "critical", "established", y, y),
        finding(e.where(y < oldest), "implausible_year", "warning", "established", y, y)]
    return union_all(out)


def extreme_values(df: DataFrame, cols: list[str], k: float = 3.0, min_n: int = 4) -> DataFrame:
    """Values outside k x IQR of their own entity and column (series are one row per period)."""
    v = long(df, ["company_id", "year"], cols).where(c("value").isNotNull())
    w = Window.partitionBy("company_id", "metric")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(w)
    v = v.withColumn("_q", q).withColumn("_n", F.count("value").over(w))
    iqr = (c("_q")[1] - c("_q")[0]) * k
    bad = (c("value") < c("_q")[0] - iqr) | (c("value") > c("_q")[1] + iqr)
    return finding(v.where((c("_n") >= min_n) & bad), "extreme_value", "info", c("metric"), c("value"))


def market_share_rules(df: DataFrame, max_share: float = 100.0, max_total: float = 105.0, ratio: float = 3.0,
                       jump: float = 50.0) -> DataFrame:
    """Shares out of range, market-year totals, global against domestic, jumps between adjacent years.

    Input columns: company_id, year, market, share_pct, global_pct.
    """
    d = df.withColumn("_p", F.max("share_pct").over(
        Window.partitionBy("company_id", "market").orderBy("year").rangeBetween(-1, -1)))
    mk = c("market").cast("string")
    tot = df.groupBy("market", "year").agg(F.sum("share_pct").alias("t")).where(c("t") > max_total)
    chg = F.abs(c("share_pct") - c("_p"))
    return union_all([
        finding(d.where((c("share_pct") < 0) | (c("share_pct") > max_share)), "share_range", "critical", mk, c("share_pct")),
        finding(d.where(c("global_pct") > c("share_pct") * ratio), "global_over_domestic", "warning", mk, c("global_pct")),
        finding(d.where(chg > jump), "share_jump", "warning", mk, chg),
        finding(tot.withColumn("company_id", F.lit(None).cast("long")), "share_total", "warning", mk, c("t"))])


def survival_consistency(panel: DataFrame, entities: DataFrame, now: int, lag: int = 2, grace: int = 1,
                         before: int = 3) -> DataFrame:
    """Stale active entities, rows after extinction, extinct entities that never lost money at the end."""
    e = entities.select("company_id", "status", F.year("extinction").alias("gone"))
    p = panel.join(e, "company_id").groupBy("company_id", "status", "gone").agg(
        F.max("year").alias("last"),
        F.sum((c("year") >= c("gone") - before).cast("int")).alias("n_end"),
        F.sum(((c("year") >= c("gone") - before) & (c("net_profit") < 0)).cast("int")).alias("n_loss"))
    last = c("last")
    return union_all([
        finding(p.where((c("status") == "active") & (last < now - lag)), "stale_active", "warning", "year", last, last),
        finding(p.where((c("status") == "extinct") & (last > c("gone") + grace)), "rows_after_extinction", "critical",
                "year", last, last),
        finding(p.where((c("status") == "extinct") & (c("n_end") >= 2) & (c("n_loss") == 0)), "extinct_without_loss",
                "info", "net_profit", c("n_end"), last)])


def entrant_patterns(df: DataFrame, first_revenue: float = 1e9, growth: float = 10.0, assets: float = 5e10) -> DataFrame:
    """Spin-offs with large first revenue or early growth; large assets in the establishment year."""
    early = df.where(c("parent_id").isNotNull() & (c("year") <= c("start_year") + 3))
    g = early.withColumn("_p", F.lag("revenue").over(W())).groupBy("company_id").agg(
        F.min_by("revenue", "year").alias("first"), F.min("year").alias("year"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(c("_p") > 0, (c("revenue") - c("_p")) / c("_p"))).alias("g"))
    return union_all([
        finding(g.where((c("n") >= 2) & (c("first") > first_revenue)), "large_first_revenue", "info", "revenue", c("first")),
        finding(g.where((c("n") >= 3) & (c("g") > growth)), "extreme_growth", "warning", "revenue", c("g")),
        finding(df.where((c("year") == c("start_year")) & (c("total_assets") > assets)), "large_first_assets", "warning",
                "total_assets", c("total_assets"))])


def quality_score(findings: DataFrame, entities: DataFrame, ready_at: float = 70.0) -> DataFrame:
    """max(0, 100 - 20 critical - 5 warning); ready without criticals and at the score limit."""
    g = findings.groupBy("company_id").agg(
        F.sum((c("severity") == "critical").cast("int")).alias("critical"),
        F.sum((c("severity") == "warning").cast("int")).alias("warning"))
    d = entities.select("company_id").join(g, "company_id", "left").na.fill(0, ["critical", "warning"])
    s = F.greatest(100.0 - 20.0 * c("critical") - 5.0 * c("warning"), F.lit(0.0))
    return d.withColumn("score", s).withColumn("ready", (c("critical") == 0) & (c("score") >= ready_at))


def collector_score(panel: DataFrame, factor_cols: list[str], critical_cols: list[str], start: int, end: int) -> DataFrame:
    """.3 completeness + .25 continuity + .25 factor coverage + .2 critical columns per entity."""
    step = (c("year") == F.lag("year").over(W()) + 1).cast("int")
    g = panel.withColumn("_s", step).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_s").alias("s"),
        *[F.max(c(x).isNotNull().cast("int")).alias(f"_h_{x}") for x in dict.fromkeys(factor_cols + critical_cols)])
    cont = F.when(c("n") > 1, F.coalesce(c("s"), F.lit(0)) / (c("n") - 1)).otherwise(1.0)
    cover = total([c(f"_h_{x}") for x in factor_cols]) / len(factor_cols)
    crit = total([c(f"_h_{x}") for x in critical_cols]) / len(critical_cols)
    s = c("n") / float(end - start + 1) * 0.3 + cont * 0.25 + cover * 0.25 + crit * 0.2
    return g.select("company_id", F.least(s, F.lit(1.0)).alias("score"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by check and severity."""
    return findings.groupBy("rule").pivot("severity", ["critical", "warning", "info"]).count().na.fill(
        0, ["critical", "warning", "info"])


def completeness(df: DataFrame, cols: list[str], full: int) -> DataFrame:
    """Non-null share, revenue >= operating profit share and years per entity, one row."""
    per = df.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n"), total([F.count(x) for x in cols]).alias("filled"),
        F.sum((c("revenue") >= c("operating_profit")).cast("int")).alias("ok"),
        F.count(F.when((c("revenue") >= c("operating_profit")).isNotNull(), 1)).alias("known"))
    return per.agg(
        (F.sum("filled") / (F.sum("n") * len(cols))).alias("completeness"),
        (F.sum("ok") / F.sum("known")).alias("consistency"), F.avg("n").alias("avg_years"),
        F.min("n").alias("min_years"), F.max("n").alias("max_years"),
        F.sum((c("n") >= full).cast("int")).alias("full_coverage"))


def dedup(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key by an explicit order, by a min over the ordering struct.

    An aggregate combines copies on the map side, so a key copied many times
    never meets in one task the way a row_number window would force it to.
    """
    names = [f"_o{i}" for i in range(len(order))]
    d = df.select("*", *[o.alias(n) for o, n in zip(order, names)])
    rest = [x for x in df.columns if x not in key]
    return d.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*names)).alias("_r")).select(*key, "_r.*")


def missing_profile(df: DataFrame, cols: list[str], events: Column, near: int = 1, limit: float = 0.7) -> DataFrame:
    """Null share per column, overall and within ``near`` periods of the event year; structural or random."""
    v = df.select(
        "company_id", "year", (F.abs(c("year") - events) <= near).alias("_near"),
        *[c(x).cast("double").alias(x) for x in cols]).unpivot(["company_id", "year", "_near"], cols, "metric", "value")
    miss = c("value").isNull().cast("int")
    g = v.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(miss).alias("null_share"),
        F.avg(F.when(c("_near"), miss)).alias("near_share"),
        F.avg(F.when(F.coalesce(c("_near"), F.lit(False)), None).otherwise(miss)).alias("far_share"))
    return g.withColumn("pattern", F.when(c("near_share") > limit, "structural").otherwise("random"))


def missing_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Null share per key over the given columns."""
    return df.groupBy(key).agg((1.0 - total([F.count(x) for x in cols]) / (F.count(F.lit(1)) * len(cols)))
                               .alias("null_share"))


def imputation_quality(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: nulls removed, values outside the original fences, distribution similarity, jumps, shifts."""
    key = ["company_id", "year"]
    b = long(before, key, cols).withColumnRenamed("value", "old")
    a = long(after, key, cols).withColumnRenamed("value", "new")
    # three passes follow: write the joined table once instead of deriving both sides again
    j = reliable(b.join(a, [*key, "metric"]))
    q = exact_quantiles(j, ["metric"], "old", {"q1": 0.25, "q3": 0.75})
    # one row per column of the panel
    j = j.join(F.broadcast(q.select("metric", "q1", "q3")), "metric")
    iqr = 1.5 * (c("q3") - c("q1"))
    out = c("old").isNull() & ((c("new") < c("q1") - iqr) | (c("new") > c("q3") + iqr))
    prev = F.last("new", True).over(
        Window.partitionBy("company_id", "metric").orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("_jump", F.abs(c("new") / F.nullif(prev, F.lit(0.0)) - 1.0) > 2.0)
    g = j.groupBy("metric").agg(
        F.sum(c("old").isNull().cast("int") - c("new").isNull().cast("int")).alias("filled"),
        F.avg(c("new").isNotNull().cast("int")).alias("completeness"),
        F.sum(F.coalesce(out, F.lit(False)).cast("int")).alias("outliers_added"),
        F.sum((c("new") < 0).cast("int")).alias("negatives"),
        F.sum(F.coalesce(c("_jump"), F.lit(False)).cast("int")).alias("jumps"),
        F.abs(F.avg("old") - F.avg("new")).alias("_dm"), F.avg("old").alias("_m"),
        F.abs(F.stddev_samp("old") - F.stddev_samp("new")).alias("_ds"), F.stddev_samp("old").alias("_s"))
    both = j.select("metric", c("old").alias("v"), F.lit(True).alias("is_old")).unionByName(
        j.select("metric", c("new").alias("v"), F.lit(False).alias("is_old")))
    ks = ks_distance(both, ["metric"], "v", c("is_old"), ~c("is_old")).select("metric", "ks")
    return g.join(ks, "metric").select(
        "metric", "filled", "completeness", "outliers_added", "negatives", "jumps", sd("_dm", "_m").alias("mean_shift"),
        sd("_ds", "_s").alias("std_shift"), (1.0 - c("ks")).alias("similarity"))


def survival_feature_checks(surv: DataFrame, cols: list[str]) -> DataFrame:
    """One row: null share, 1.5 IQR outlier share, invalid durations and flags, event rate."""
    q = quantiles_long(surv, [], cols, {"q1": 0.25, "q3": 0.75}).select("metric", "q1", "q3")
    v = long(surv, ["company_id"], cols).join(F.broadcast(q), "metric")
    iqr = 1.5 * (c("q3") - c("q1"))
    out = (c("value") < c("q1") - iqr) | (c("value") > c("q3") + iqr)
    per = v.groupBy("metric").agg(F.avg(c("value").isNull().cast("int")).alias("null_share"),
                                  F.avg(F.coalesce(out, F.lit(False)).cast("int")).alias("outlier_share"))
    flags = surv.agg(F.sum((c("duration") < 0).cast("int")).alias("negative_durations"),
                     F.sum((~c("event").isin(0, 1)).cast("int")).alias("bad_flags"),
                     F.avg("event").alias("event_rate"))
    return with_totals(per, flags).withColumn(
        "warning", (c("null_share") > 0.5) | (c("outlier_share") > 0.1))


def factor_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing and outlier share, zero or constant columns per factor, with the overall score."""
    q = quantiles_long(df, [], cols, {"q1": 0.25, "q3": 0.75}).select("metric", "q1", "q3")
    v = long(df, ["company_id"], cols).join(F.broadcast(q), "metric", "left")
    iqr = 1.5 * (c("q3") - c("q1"))
    out = (c("value") < c("q1") - iqr) | (c("value") > c("q3") + iqr)
    g = v.groupBy("metric").agg(
        F.avg(c("value").isNull().cast("int")).alias("missing_rate"),
        F.avg(F.coalesce(out, F.lit(False)).cast("int")).alias("outlier_rate"),
        F.max(F.abs("value")).alias("_mx"), F.var_samp("value").alias("_var"))
    g = g.select("metric", "missing_rate", "outlier_rate",
                 (F.coalesce(c("_mx"), F.lit(0.0)) == 0).alias("all_zero"),
                 (F.coalesce(c("_var"), F.lit(0.0)) < 1e-6).alias("constant"))
    tot = g.agg(clip(1.0 - (F.avg("missing_rate") * 0.6 + F.avg("outlier_rate") * 0.4), 0, 1).alias("data_quality_score"))
    return with_totals(g, tot)
