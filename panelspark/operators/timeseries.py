"""Window and time-series features of panel series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, ladder, mean_of, safe_corr, sd, total
from ..functions.windows import W, full_window, growth, rows, runs, whole

c = F.col


def rolling_pooled(df: DataFrame, y: str, x: str, w: int, first: int, last: int, min_n: int = 10) -> DataFrame:
    """Pooled correlation and slope of all entities in sliding calendar windows of w years.

    Each row is exploded to the windows it belongs to (w copies), then one groupBy.
    """
    lo = F.greatest(c("year"), F.lit(first))
    hi = F.least(c("year") + (w - 1), F.lit(last))
    d = df.where((lo <= hi) & c(x).isNotNull() & c(y).isNotNull()).select(x, y, F.explode(F.sequence(lo, hi)).alias("last_year"))
    return d.groupBy("last_year").agg(F.count(F.lit(1)).alias("n"), safe_corr(y, x).alias("r"),
                                      F.regr_slope(y, x).alias("slope")).where(c("n") >= min_n)


def _corr0(x: Column) -> Column:
    """Correlation with undefined values as zero."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def indexed(df: DataFrame, value: str) -> DataFrame:
    """Non-null series with row index ``i`` (from 0), length ``n``, previous value ``p`` and return ``r``."""
    d = df.where(c(value).isNotNull()).select("company_id", "year", c(value).cast("double").alias("v"))
    d = d.select("*", (F.row_number().over(W()) - 1).alias("i"), F.count("v").over(whole()).alias("n"),
                 F.lag("v").over(W()).alias("p"))
    return d.withColumn("r", (c("v") - c("p")) / F.nullif(F.abs("p"), F.lit(0.0)))


def trend_pack(df: DataFrame, value: str, min_n: int = 3) -> DataFrame:
    """Slope, intercept, r2, monotonic share, mean second difference, residual spread and thirds' slopes."""
    d = indexed(df, value).where(c("n") >= min_n)
    d = d.withColumn("dv", c("v") - c("p")).withColumn("ddv", c("v") - c("p") - F.lag("dv").over(W()))
    a, b = F.floor(c("n") / 3), F.floor(2 * c("n") / 3)
    third = ladder([(c("i") < a, 0), (c("i") < b, 1)], 2)
    d = d.withColumn("third", third).withColumn("_e", c("v") - F.regr_slope("v", "i").over(whole()) * c("i"))
    g = d.groupBy("company_id").agg(
        F.max("n").alias("n"), F.regr_slope("v", "i").alias("slope"), F.regr_intercept("v", "i").alias("intercept"),
        safe_corr("v", "i").alias("_r"), F.sum((c("dv") > 0).cast("int")).alias("_up"), F.sum((c("dv") < 0).cast("int")).alias("_dn"),
        F.avg("ddv").alias("acceleration"),
        F.stddev_pop("_e").alias("residual_std"),
        *[x for t in range(3) for x in (
            F.min_by(F.when(c("third") == t, c("v")), F.when(c("third") == t, c("i"))).alias(f"_f{t}"),
            F.max_by(F.when(c("third") == t, c("v")), F.when(c("third") == t, c("i"))).alias(f"_l{t}"),
            F.sum((c("third") == t).cast("int")).alias(f"_n{t}"))])
    n = c("n").cast("double")
    return g.select(
        "company_id", "n", "slope", "intercept", (_corr0(c("_r")) * _corr0(c("_r"))).alias("r2"),
        (F.greatest("_up", "_dn") / (n - 1)).alias("monotonic"), "acceleration",
        "residual_std",
        *[F.when(c(f"_n{t}") >= 2, (c(f"_l{t}") - c(f"_f{t}")) / c(f"_n{t}")).otherwise(0.0).alias(f"trend_{nm}")
          for t, nm in enumerate(("early", "mid", "late"))])


def volatility_pack(df: DataFrame, value: str) -> DataFrame:
    """Population spread, CV, range, IQR, return and downside spread, run clustering, |r| persistence."""
    d = indexed(df, value).where(c("n") >= 2).withColumn("r", (c("v") - c("p")) / F.nullif(c("p"), F.lit(0.0)))
    a = F.abs("r")
    d = d.withColumn("_q", F.percentile(a, F.lit(0.75)).over(whole())).withColumn("_pa", F.lag(a).over(W()))
    hi = F.coalesce(a > c("_q"), F.lit(False))
    d = runs(d, hi, name="run").withColumn("hi", hi)
    run = d.where("hi").groupBy("company_id", "run").agg(F.count(F.lit(1)).alias("len")).groupBy("company_id").agg(
        F.sum(c("len") * c("len")).alias("_cl"))
    g = d.groupBy("company_id").agg(
        F.max("n").alias("n"), F.stddev_pop("v").alias("std"), F.avg("v").alias("_m"), (F.max("v") - F.min("v")).alias("range"),
        (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"), F.stddev_pop("r").alias("returns_std"),
        F.stddev_pop(F.when(c("r") < 0, c("r"))).alias("_ds"), safe_corr(a, "_pa").alias("_pers"), F.count("r").alias("_nr"))
    g = g.join(run, "company_id", "left")
    return g.select("company_id", "n", "std", sd("std", F.abs("_m")).alias("cv"), "range", "iqr",
                    F.coalesce(c("returns_std"), F.lit(0.0)).alias("returns_std"), F.coalesce(c("_ds"), F.lit(0.0)).alias("downside_std"),
                    F.when(c("_nr") >= 3, F.coalesce(c("_cl"), F.lit(0)) / c("_nr")).otherwise(0.0).alias("clustering"),
                    _corr0(c("_pers")).alias("persistence"))


def growth_pack(df: DataFrame, value: str) -> DataFrame:
    """CAGR and the distribution, acceleration and consistency of growth rates."""
    d = indexed(df, value).where(c("n") >= 2).withColumn("_pr", F.lag("r").over(W()))
    r = c("r")
    g = d.groupBy("company_id").agg(
        F.max("n").alias("n"), F.min_by("v", "i").alias("_a"), F.max_by("v", "i").alias("_z"), F.avg("r").alias("mean_growth"),
        F.percentile("r", F.lit(0.5)).alias("median_growth"), F.stddev_pop("r").alias("growth_std"), F.max("r").alias("max_growth"),
        F.min("r").alias("min_growth"), F.count("r").alias("_n"), F.sum((r > 0).cast("int")).alias("_up"),
        F.sum((r < 0).cast("int")).alias("_dn"), F.avg(r - c("_pr")).alias("_acc"))
    ratio = c("_z") / F.nullif(c("_a"), F.lit(0.0))
    return g.select("company_id", "n", F.when((c("_a") > 0) & (ratio > 0), F.pow(ratio, 1.0 / (c("n") - 1)) - 1.0).otherwise(0.0).alias("cagr"),
                    "mean_growth", "median_growth", "growth_std", "max_growth", "min_growth",
                    sd(c("_up").cast("double"), c("_n").cast("double")).alias("positive_share"),
                    F.coalesce(c("_acc"), F.lit(0.0)).alias("acceleration"),
                    F.when(c("_n") >= 2, F.greatest("_up", "_dn") / c("_n")).otherwise(0.5).alias("consistency"))


def growth_link(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of the growth rates of two series and the difference of their means."""
    w = W()
    ga = (c(a) - F.lag(a).over(w)) / F.nullif(F.abs(F.lag(a).over(w)), F.lit(0.0))
    gb = (c(b) - F.lag(b).over(w)) / F.nullif(F.abs(F.lag(b).over(w)), F.lit(0.0))
    g = df.select("company_id", ga.alias("ga"), gb.alias("gb")).groupBy("company_id").agg(
        safe_corr("ga", "gb").alias("r"), (F.avg("ga") - F.avg("gb")).alias("mean_gap"), F.count("ga").alias("n"))
    return g.select("company_id", "n", _corr0(c("r")).alias("growth_corr"), "mean_gap")


def cycle_pack(df: DataFrame, value: str, max_lag: int = 10, min_n: int = 4) -> DataFrame:
    """Largest autocorrelation, its decay, peaks and troughs, zero crossings and spread of the detrended series."""
    d = indexed(df, value).where(c("n") >= min_n)
    w = W()
    lags = range(1, max_lag + 1)
    d = d.select("*", *[F.lag("v", k).over(w).alias(f"_l{k}") for k in lags], F.lead("v").over(w).alias("_nx"),
                 F.regr_slope("v", "i").over(whole()).alias("_s"), F.regr_intercept("v", "i").over(whole()).alias("_c"))
    d = d.withColumn("_e", c("v") - c("_s") * c("i") - c("_c"))
    peak, trough = (c("v") > c("p")) & (c("v") > c("_nx")), (c("v") < c("p")) & (c("v") < c("_nx"))
    d = d.withColumn("_pk", F.when(peak, c("i"))).withColumn("_tr", F.when(trough, c("i")))
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_pg", c("_pk") - F.last("_pk", True).over(upto)).withColumn("_tg", c("_tr") - F.last("_tr", True).over(upto))
    g = d.groupBy("company_id").agg(
        F.max("n").alias("n"), *[safe_corr("v", f"_l{k}").alias(f"_c{k}") for k in lags], F.count("_pk").alias("_np"), F.count("_tr").alias("_nt"),
        F.avg("_pg").alias("_pm"), F.stddev_pop("_pg").alias("_ps"), F.avg("_tg").alias("_tm"), F.stddev_pop("_tg").alias("_ts"),
        F.stddev_pop("_e").alias("amplitude"), F.array_sort(F.collect_list(F.struct("i", "_e"))).alias("_es"))
    ac = F.array(*[F.when(F.lit(k) <= F.least(F.floor(c("n") / 2), F.lit(max_lag)), _corr0(c(f"_c{k}"))) for k in lags])
    g = g.withColumn("_ac", F.filter(ac, lambda x: x.isNotNull()))
    g = g.withColumn("_sig", F.filter("_ac", lambda x: F.abs(x) > 0.1))
    crossings = F.size(F.filter(F.transform("_es", lambda x, i: F.when((i > 0) & (x["_e"] * F.get(c("_es"), i - 1)["_e"] < 0), 1)),
                                lambda x: x.isNotNull()))
    reg = ((1 - c("_ps") / c("_pm")) + (1 - c("_ts") / c("_tm"))) / 2
    decay = F.when(F.size("_ac") < 2, 0.0).when(F.size("_sig") < 2, 1.0).otherwise(
        F.least(F.abs(F.element_at("_sig", -1) / F.element_at("_sig", 1)), F.lit(1.0)))
    long_ = c("n") >= 5
    return g.select("company_id", "n", F.array_max("_ac").alias("max_autocorr"), decay.alias("autocorr_decay"),
                    F.when(long_, c("_np") / c("n")).otherwise(0.0).alias("peak_frequency"),
                    F.when(long_, c("_nt") / c("n")).otherwise(0.0).alias("trough_frequency"),
                    F.when(long_ & (c("_np") > 1) & (c("_nt") > 1), clip(reg, 0, 1)).otherwise(0.0).alias("regularity"),
                    (crossings / c("n")).alias("crossing_rate"), "amplitude")


def _stability(x: str | Column, min_n: int) -> Column:
    """1 / (1 + sample CV) as an aggregate; zero for short or zero-mean series."""
    m = F.avg(x)
    return F.when((F.count(x) >= min_n) & (m != 0), 1.0 / (1.0 + F.stddev_samp(x) / F.nullif(F.abs(m), F.lit(0.0)))).otherwise(0.0)


def lifecycle_pack(df: DataFrame, value: str, growth_col: str, margin: str, roe: str, now: int) -> DataFrame:
    """Age, coverage, four equal row blocks (mean, growth, spread), growth-class changes and maturity."""
    d = df.where(c(value).isNotNull())
    d = d.withColumn("_i", F.row_number().over(W()) - 1).withColumn("_n", F.count(F.lit(1)).over(whole()))
    block = F.least(F.floor(c("_i") / F.greatest(F.floor(c("_n") / 4), F.lit(1))), F.lit(3))
    cls = F.when(c(growth_col).isNotNull(), ladder([(c(growth_col) > 0.15, "high"), (c(growth_col) > 0.05, "stable"),
                                                    (c(growth_col) > 0, "low")], "decline"))
    d = d.withColumn("_b", block).withColumn("_k", cls)
    d = d.withColumn("_pk", F.last("_k", True).over(W().rowsBetween(Window.unboundedPreceding, -1)))
    names = ("startup", "growth", "maturity", "decline")
    aggs = []
    for i, nm in enumerate(names):
        v = F.when(c("_b") == i, c(value))
        y = F.when(c("_b") == i, c("year"))
        first, last = F.min_by(v, y), F.max_by(v, y)
        aggs += [F.avg(v).alias(f"{nm}_mean"), F.when(F.count(v) >= 2, (last - first) / F.nullif(F.abs(first), F.lit(0.0))).otherwise(0.0).alias(f"{nm}_growth"),
                 F.stddev_samp(v).alias(f"{nm}_std")]
    ng = F.count(growth_col)
    g = d.groupBy("company_id").agg(
        F.max("_n").alias("n"), F.max("start_year").alias("_s"), F.max(F.year("extinction")).alias("_x"), *aggs,
        F.when(ng >= 5, F.sum((c("_k") != c("_pk")).cast("int"))).otherwise(0).alias("stage_transitions"),
        F.when(ng >= 5, F.sum((c("_k") == "decline").cast("int")) / ng).otherwise(0.0).alias("decline_share"),
        ((_stability(growth_col, 3) + _stability(margin, 3) + _stability(roe, 3)) / 3.0).alias("maturity"))
    age = F.coalesce(c("_x"), F.lit(now)) - c("_s")
    era = ladder([(c("_s") < 1945, "pre_war"), (c("_s") < 1970, "post_war_recovery"), (c("_s") < 1990, "high_growth_era"),
                  (c("_s") < 2000, "bubble_collapse"), (c("_s") < 2010, "digital_transformation")], "modern_era")
    return g.select("*", age.alias("age"), F.when(age > 0, c("n") / age).otherwise(0.0).alias("coverage"), era.alias("era")).drop("_s", "_x")


def longest_run(df: DataFrame, cond: Column, keys: str = "company_id") -> DataFrame:
    """Longest and number of runs of a condition per entity."""
    d = runs(df.withColumn("_c", F.coalesce(cond, F.lit(False))), c("_c"), name="_run")
    g = d.where("_c").groupBy(keys, "_run").agg(F.count(F.lit(1)).alias("_len"))
    return g.groupBy(keys).agg(F.max("_len").alias("longest"), F.count(F.lit(1)).alias("runs"))


def survival_pack(df: DataFrame, growth_col: str, margin: str, roe: str, revenue: str) -> DataFrame:
    """Financial, growth-streak and stability risks, last-5 slopes and the survival estimate."""
    def risk(x: str) -> Column:
        m = F.avg(x)
        ext = F.when(m != 0, F.stddev_samp(x) / F.nullif(F.abs(m), F.lit(0.0))).otherwise(1.0)
        neg = F.sum((c(x) < 0).cast("int")) / F.count(x)
        return F.when(F.count(x) >= 2, F.least(neg * 0.7 + F.least(ext / 2.0, F.lit(0.3)), F.lit(1.0))).otherwise(0.5)

    d = df.withColumn("_back", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year"))))
    last = c("_back") <= 5
    stab = [F.when(F.count(x) > 2, _stability(x, 3)) for x in (revenue, margin, roe)]
    g = d.groupBy("company_id").agg(
        risk(margin).alias("margin_risk"), risk(roe).alias("roe_risk"), F.count(growth_col).alias("_ng"),
        F.array(*stab).alias("_st"),
        F.regr_slope(F.when(last, c(margin)), -c("_back")).alias("_ms"), F.regr_slope(F.when(last, c(growth_col)), -c("_back")).alias("_gs"),
        ((_stability(F.when(last, c(margin)), 2) + _stability(F.when(last, c(roe)), 2)) / 2.0).alias("recent_stability"))
    streak = longest_run(df.where(c(growth_col).isNotNull()), c(growth_col) < 0)
    g = g.join(streak, "company_id", "left")
    ok = F.filter("_st", lambda x: x.isNotNull())
    mean_st = F.aggregate(ok, F.lit(0.0), lambda a, x: a + x) / F.size(ok)
    g = g.select(
        "company_id", "margin_risk", "roe_risk",
        F.when(c("_ng") < 3, 0.5).otherwise(F.coalesce(c("longest"), F.lit(0)) / c("_ng")).alias("growth_risk"),
        F.when(F.size(ok) > 0, 1.0 - mean_st).otherwise(0.5).alias("stability_risk"),
        F.coalesce(c("_ms"), F.lit(0.0)).alias("margin_slope"), F.coalesce(c("_gs"), F.lit(0.0)).alias("growth_slope"), "recent_stability")
    overall = (c("margin_risk") + c("roe_risk") + c("growth_risk") + c("stability_risk")) / 4.0
    trend = lambda s: F.when(s > 0, 1.0).when(s == 0, 0.5).otherwise(0.0)
    prob = clip(trend(c("margin_slope")) * 0.4 + trend(c("growth_slope")) * 0.3 + c("recent_stability") * 0.3, 0, 1)
    return g.select("*", overall.alias("overall_risk"), prob.alias("survival_estimate"))


def emergence_pack(df: DataFrame, revenue: str, growth_col: str, margin: str, roe: str, value_added: str) -> DataFrame:
    """First min(5, n/2) rows, rapid-growth runs, era, growth pattern, competitiveness and success estimate."""
    d = df.withColumn("_i", F.row_number().over(W())).withColumn("_n", F.count(F.lit(1)).over(whole()))
    k = F.least(F.floor(c("_n") / 2), F.lit(5))
    ini = c("_i") <= F.when(k > 0, k).otherwise(c("_n"))
    rv, ry = F.when(ini, c(revenue)), F.when(ini, c("year"))
    a, z, m = F.min_by(rv, ry), F.max_by(rv, ry), F.count(rv)
    comp = [F.least(F.greatest(F.avg(x), F.lit(0.0)) * f, F.lit(1.0)) for x, f in ((margin, 5.0), (growth_col, 2.0), (roe, 2.0), (value_added, 1.0))]
    g = d.groupBy("company_id").agg(
        F.max("_n").alias("n"), F.max("start_year").alias("_s"),
        F.when((m >= 2) & (a > 0) & (z > 0), F.pow(z / F.nullif(a, F.lit(0.0)), 1.0 / F.nullif(m - 1, F.lit(0))) - 1.0).otherwise(0.0).alias("initial_growth"),
        F.avg(F.when(ini, c(margin))).alias("initial_margin"),
        ((_stability(F.when(ini, c(margin)), 2) + _stability(F.when(ini, c(roe)), 2)) / 2.0).alias("initial_stability"),
        F.avg(growth_col).alias("_g"), F.regr_slope(growth_col, "year").alias("_gs"), F.array(*comp).alias("_cp"),
        F.avg(value_added).alias("_va"), F.regr_slope(value_added, "year").alias("_vs"),
        F.avg((c(growth_col) > 0).cast("int")).alias("growth_sustainability"), F.avg((c(margin) > 0).cast("int")).alias("financial_sustainability"))
    rapid = longest_run(df.where(c(growth_col).isNotNull()), c(growth_col) > 0.20)
    g = g.join(rapid, "company_id", "left")
    cp = F.filter("_cp", lambda x: x.isNotNull())
    comp_score = F.when(F.size(cp) > 0, F.aggregate(cp, F.lit(0.0), lambda s, x: s + x) / F.size(cp)).otherwise(0.5)
    pattern = ladder([((c("_g") > 0.2) & (c("_gs") > 0), "accelerating"), (c("_g") > 0.2, "rapid"), (c("_g") > 0.05, "steady"),
                      (c("_g") > 0, "slow")], "declining")
    diff = F.least(c("_va") + F.greatest(F.coalesce(c("_vs"), F.lit(0.0)), F.lit(0.0)) * 2.0, F.lit(1.0))
    g = g.select("company_id", "n", "initial_growth", "initial_margin", "initial_stability",
                 F.coalesce(c("longest"), F.lit(0)).alias("rapid_duration"), F.coalesce(c("runs"), F.lit(0)).alias("rapid_runs"),
                 ladder([(c("_s") < 2000, "early_digital"), (c("_s") < 2010, "digital_transformation"), (c("_s") < 2020, "mobile_internet")], "ai_iot_era").alias("era"),
                 pattern.alias("growth_pattern"), comp_score.alias("competitiveness"), diff.alias("differentiation"),
                 F.coalesce(c("growth_sustainability"), F.lit(0.0)).alias("growth_sustainability"), "financial_sustainability")
    return g.withColumn("success_estimate", c("growth_sustainability") * 0.3 + c("competitiveness") * 0.3
                        + c("financial_sustainability") * 0.2 + c("differentiation") * 0.2)


# ---- row features -----------------------------------------------------------------

def rolling_slope(x: str, k: int, entity: str = "company_id") -> Column:
    """OLS slope over the last k rows (row position as the regressor), null unless full."""
    w = rows(k, entity=entity)
    return F.when(F.count(x).over(w) >= k, F.regr_slope(c(x), F.col("_row")).over(w))


def with_row(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", F.row_number().over(W()))


def change_eps(x: str | Column, k: int, eps: float = 1e-6) -> Column:
    """Change over k rows with the eps-guarded denominator; sign flipped by the caller for reductions."""
    x = c(x) if isinstance(x, str) else x
    p = F.lag(x, k).over(W())
    return (x - p) / (p + eps)


def decline_counters(df: DataFrame, x: str, k: int = 3) -> DataFrame:
    """Consecutive-decline counter, flag at k in a row, and the entity's longest decline."""
    down = c(x) < F.lag(x).over(W())
    d = df.withColumn("_dn", F.coalesce(down, F.lit(False)))
    d = runs(d, c("_dn"), name="_run")
    pos = F.row_number().over(Window.partitionBy("company_id", "_run").orderBy("year"))
    d = d.withColumn("decline_count", F.when(c("_dn"), pos).otherwise(0))
    return d.select("*", flag(c("decline_count") >= k).alias("consecutive_decline"),
                    F.max("decline_count").over(whole()).alias("longest_decline")).drop("_dn", "_run")


def stress_scores(df: DataFrame, x: str, k: int = 5) -> DataFrame:
    """Compression, stagnation, deceleration, delay against peers, burden and consistency."""
    w = rows(k)
    m = full_window(F.avg(x), x, w, k)
    s = full_window(F.stddev_samp(x), x, w, k)
    peers = df.groupBy("market", "year").agg(F.avg(x).alias("_pm"))
    d = df.withColumn("_gr", growth(x)).join(peers, ["market", "year"])
    cv = sd(F.stddev_samp(x).over(whole()), F.abs(F.avg(x).over(whole())))
    return d.select("*", ((m - c(x)) / (m + 1e-6)).alias("compression"), flag(s < F.stddev_samp(x).over(whole()) * 0.1).alias("stagnation"),
                    (c("_gr") - F.lag("_gr").over(W())).alias("deceleration"), ((c("_pm") - c(x)) / (c("_pm") + 1e-6)).alias("delay"),
                    F.log1p(F.greatest(c(x), F.lit(0.0))).alias("burden"), (1.0 / (1.0 + cv)).alias("consistency")).drop("_gr", "_pm")


def volatility_anomaly(df: DataFrame, x: str, k: int = 5, q: float = 0.9) -> DataFrame:
    """Rolling spread above the entity's own q-quantile of rolling spread."""
    d = df.withColumn("_v", full_window(F.stddev_samp(x), x, rows(k), k))
    return d.withColumn("volatility_anomaly", flag(c("_v") > F.percentile("_v", F.lit(q)).over(whole()))).withColumnRenamed("_v", "rolling_std")


def sudden_changes(df: DataFrame, cols: list[str], limit: float = 0.3) -> DataFrame:
    return df.withColumn("sudden_changes", total([flag(F.abs(growth(x)) > limit) for x in cols]))


def entity_trend(df: DataFrame, x: str, min_n: int = 3, cv_limit: float = 0.3) -> DataFrame:
    """Slope, deteriorating flag, CV and volatility flags per entity."""
    g = df.where(c(x).isNotNull()).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(c(x), c("year")).alias("slope"), F.stddev_samp(x).alias("_s"), F.avg(x).alias("_m"))
    g = g.where(c("n") >= min_n).withColumn("cv", sd("_s", F.abs("_m")))
    return g.select("company_id", "n", "slope", flag(c("slope") < 0).alias("deteriorating"), "cv",
                    flag(c("cv") > 1.0).alias("very_volatile"), flag(c("cv") > cv_limit).alias("volatile"))


def momentum(df: DataFrame, cols: list[str], w: int = 3) -> DataFrame:
    """Slopes of the last w rows and their mean."""
    d = df.withColumn("_b", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year")))).where(c("_b") <= w)
    g = d.groupBy("company_id").agg(*[F.regr_slope(c(x), -c("_b")).alias(f"m_{x}") for x in cols])
    return g.withColumn("momentum", mean_of([c(f"m_{x}") for x in cols]))


def centered_mean(x: str | Column, h: int) -> Column:
    return F.avg(x).over(W().rowsBetween(-h, h))


def growth_frame(df: DataFrame, h: int = 1) -> DataFrame:
    """Growth, its volatility and acceleration, productivity, stability and expansion, centered-smoothed."""
    d = df.withColumn("growth", growth("revenue"))
    d = d.select("*", F.stddev_samp("growth").over(rows(3)).alias("growth_vol"), (c("growth") - F.lag("growth").over(W())).alias("growth_acc"),
                 sd("revenue", "employees").alias("productivity"), growth("total_assets").alias("expansion"))
    m = sd("operating_profit", "revenue")
    d = d.withColumn("stability", 1.0 / (1.0 + F.stddev_samp(m).over(rows(3))))
    cols = ["growth", "growth_vol", "growth_acc", "productivity", "expansion", "stability"]
    return d.select(*[x for x in d.columns if x not in cols], *[centered_mean(x, h).alias(x) for x in cols])


def series_array(df: DataFrame, value: str) -> DataFrame:
    """Ordered array of an entity's series (one element per period)."""
    return df.where(c(value).isNotNull()).groupBy("company_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("year", c(value).cast("double").alias("v")))), lambda s: s["v"]).alias("a"))


def resample(df: DataFrame, value: str, m: int, least: int = 2) -> DataFrame:
    """Linear resampling of every series of ``least`` values or more to m points (one value is repeated): (company_id, j, value)."""
    g = series_array(df, value).where(F.size("a") >= least)
    d = g.select("company_id", "a", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    pos = c("j") * (F.size("a") - 1) / float(m - 1)
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    v0, v1 = F.get("a", lo), F.get("a", hi)
    return d.select("company_id", "j", (v0 + (v1 - v0) * (pos - lo)).alias("value"))


def turning_points(df: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Rows whose second difference exceeds k deviations of the series' second differences."""
    w = W()
    d2 = F.lead(value).over(w) - 2 * c(value) + F.lag(value).over(w)
    d = df.select("company_id", "year", c(value).alias("value"), d2.alias("d2"))
    s = F.stddev_pop("d2").over(whole())
    return d.withColumn("_s", s).where(F.abs("d2") > k * c("_s")).drop("_s")


def peaks(df: DataFrame, value: str, h: int = 1, distance: int = 2) -> DataFrame:
    """Peaks of the smoothed series; of peaks closer than ``distance`` rows the highest is kept."""
    w = W()
    d = df.select("company_id", "year", centered_mean(value, h).alias("s"), F.row_number().over(w).alias("i"))
    d = d.withColumn("_p", F.lag("s").over(w)).withColumn("_n", F.lead("s").over(w)).where((c("s") > c("_p")) & (c("s") > c("_n")))
    gap = F.coalesce(c("i") - F.lag("i").over(w), F.lit(distance))
    d = d.withColumn("_g", F.sum((gap >= distance).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("company_id", "_g").agg(F.max_by("year", F.struct("s", -c("year"))).alias("year"), F.max("s").alias("height")).drop("_g")


def trend_label(df: DataFrame, value: str, min_n: int = 3) -> DataFrame:
    """volatile (r2 < .3), stable (|slope| < .01) or the slope's sign, with strength."""
    d = indexed(df, value).where(c("n") >= min_n)
    g = d.groupBy("company_id").agg(F.max("n").alias("n"), F.regr_slope("v", "i").alias("slope"), safe_corr("v", "i").alias("_r"), safe_corr("v", "p").alias("_ac"),
                                    F.stddev_pop("v").alias("_s"), F.avg("v").alias("_m"))
    r2 = _corr0(c("_r")) * _corr0(c("_r"))
    g = g.withColumn("r2", r2)
    label = ladder([(c("r2") < 0.3, "volatile"), (F.abs("slope") < 0.01, "stable"), (c("slope") > 0, "increasing")], "decreasing")
    cv = F.coalesce(sd("_s", F.abs("_m")), F.lit(0.0))
    return g.select("company_id", "n", "slope", "r2", label.alias("trend"), clip(_corr0(c("_ac")) + 1.0 - cv / 2.0, 0, 1).alias("strength"))


def seasonality(df: DataFrame, entity: str, period: str, value: str, p: int) -> DataFrame:
    """Additive decomposition: centered moving average trend, mean by phase, strength of the seasonal part."""
    h = p // 2
    w = Window.partitionBy(entity).orderBy(period)
    full = F.count(value).over(w.rowsBetween(-h, h)) == 2 * h + 1
    ends = (F.lag(value, h).over(w) + F.lead(value, h).over(w)) / 2.0
    ma = (F.sum(value).over(w.rowsBetween(-h + 1, h - 1)) + ends) / p if p % 2 == 0 else F.avg(value).over(w.rowsBetween(-h, h))
    d = df.withColumn("_t", F.when(full, ma)).withColumn("_d", c(value) - c("_t")).withColumn("phase", F.pmod(c(period), F.lit(p)))
    s = d.groupBy(entity, "phase").agg(F.avg("_d").alias("_s"))
    # one row per entity and phase
    s = s.withColumn("seasonal", c("_s") - F.avg("_s").over(Window.partitionBy(entity))).drop("_s")
    j = d.join(s, [entity, "phase"])
    g = j.groupBy(entity).agg(F.var_pop(c("_d") - c("seasonal")).alias("_vr"), F.var_pop("_d").alias("_vd"))
    return s.join(g.select(entity, F.greatest(1.0 - sd("_vr", "_vd"), F.lit(0.0)).alias("strength")), entity)


def breaks_t(df: DataFrame, value: str, w: int, alpha: float = 0.05) -> DataFrame:
    """Pooled t-test between the w rows before and the w rows from each row; adjacent breaks merged."""
    from ..functions.finish import t_two_sided

    dof = 2 * w - 2
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, dof) > alpha else (lo, mid)
    a, b = W().rowsBetween(-w, -1), W().rowsBetween(0, w - 1)
    full = (F.count(value).over(a) == w) & (F.count(value).over(b) == w)
    sp = F.sqrt((F.var_samp(value).over(a) + F.var_samp(value).over(b)) / 2.0 * (2.0 / w))
    t = F.when(full, (F.avg(value).over(b) - F.avg(value).over(a)) / F.nullif(sp, F.lit(0.0)))
    d = df.select("company_id", "year", F.row_number().over(W()).alias("i"), t.alias("t")).where(F.abs("t") > hi)
    d = d.withColumn("_g", c("i") - F.row_number().over(W()))
    return d.groupBy("company_id", "_g").agg(F.max_by("year", F.abs("t")).alias("year"), F.max(F.abs("t")).alias("t"),
                                             F.count(F.lit(1)).alias("merged")).drop("_g")


def cusum(df: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Largest |cumulative deviation| against k std sqrt(n), and where it occurs."""
    m, s = F.avg(value).over(whole()), F.stddev_pop(value).over(whole())
    d = df.withColumn("_e", c(value) - m).withColumn("_s", s)
    d = d.withColumn("_c", F.abs(F.sum("_e").over(W().rowsBetween(Window.unboundedPreceding, 0))))
    g = d.groupBy("company_id").agg(F.max("_c").alias("cusum"), F.max_by("year", F.struct("_c", -c("year"))).alias("year"),
                                    F.max("_s").alias("_s"), F.count(F.lit(1)).alias("n"))
    lim = k * c("_s") * F.sqrt(c("n").cast("double"))
    return g.select("company_id", "n", "cusum", lim.alias("threshold"), "year", (c("cusum") > lim).alias("break_found"))


def regimes(df: DataFrame, value: str, is_break: Column) -> DataFrame:
    """Characteristics of the segments between change points."""
    d = df.withColumn("regime", F.sum(F.coalesce(is_break, F.lit(False)).cast("int")).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("company_id", "regime").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n"),
                                                 F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def dominant_cycle(df: DataFrame, value: str, min_period: float = 2.0) -> DataFrame:
    """Frequency with the largest power of the demeaned series by a DFT join over k = 1..n/2."""
    d = indexed(df, value).where(c("n") >= 4)
    d = d.withColumn("_x", c("v") - F.avg("v").over(whole()))
    e = d.select("company_id", "n", "i", "_x", F.explode(F.sequence(F.lit(1), F.floor(c("n") / 2).cast("int"))).alias("k"))
    ang = F.lit(6.283185307179586) * c("k") * c("i") / c("n")
    p = e.groupBy("company_id", "k").agg(F.max("n").alias("n"), F.sum(c("_x") * F.cos(ang)).alias("_re"), F.sum(c("_x") * F.sin(ang)).alias("_im"))
    p = p.withColumn("power", c("_re") * c("_re") + c("_im") * c("_im"))
    g = p.groupBy("company_id").agg(F.max("n").alias("n"), F.max_by("k", F.struct(F.round("power", 6), -c("k"))).alias("k"), F.max("power").alias("power"),
                                    F.avg("power").alias("_m"))
    per = c("n") / c("k")
    return g.select("company_id", "n", per.alias("period"), "power",
                    ((per >= min_period) & (per <= c("n") / 2) & (c("power") > 2 * c("_m"))).alias("detected"))


def trend_signals(df: DataFrame, cols: list[str], last_year: int, rising: bool = False, r2: float = 0.5, span: int = 5,
                  keep: float = 1.5, strong: float = 2.5, top: int = 20) -> DataFrame:
    """+1 per metric with a falling (rising) trend above the r2 cut, +.5 for a large change; top list."""
    v = df.where(c("year") > last_year - span).select("company_id", "year", *[c(x).cast("double").alias(x) for x in cols]).unpivot(
        ["company_id", "year"], cols, "metric", "value")
    prev = F.lag("value").over(Window.partitionBy("company_id", "metric").orderBy("year"))
    v = v.withColumn("_g", F.abs(c("value") / F.nullif(prev, F.lit(0.0)) - 1.0))
    g = v.groupBy("company_id", "metric").agg(F.count("value").alias("n"), F.regr_slope("value", "year").alias("s"), F.regr_r2("value", "year").alias("r"),
                                              F.max("_g").alias("g"))
    hit = ((c("s") > 0) if rising else (c("s") < 0)) & (c("r") > r2)
    g = g.where(c("n") >= 3).groupBy("company_id").agg(
        F.sum(flag(hit) + 0.5 * (flag(c("r") > 0.7) * flag(hit) if rising else flag(c("g") > 0.3))).alias("score"))
    g = g.where(c("score") >= keep).withColumn("level", F.when(c("score") >= strong, "high").otherwise("medium"))
    return g.orderBy(F.desc("score"), "company_id").limit(top)


def sequence_windows(df: DataFrame, value: str, k: int) -> DataFrame:
    """k past values as an array and the current value as the target."""
    past = F.collect_list(value).over(W().rowsBetween(-k, -1))
    return df.select("company_id", "year", past.alias("past"), c(value).alias("target")).where(F.size("past") == k)
