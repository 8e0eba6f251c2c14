"""New entities, succession events, spin-offs and growth curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, ladder, mean_of, safe_corr, sd, total, with_totals
from ..functions.ranks import exact_quantiles, value_ranks
from ..session import reliable

c = F.col


def new_entities(e: DataFrame, base_year: int) -> DataFrame:
    return e.where(F.year("established") > base_year)


def timing_features(e: DataFrame, now: str, eras: dict[str, tuple[int, int]]) -> DataFrame:
    """Age, era flags, entry rank in the segment, pioneer and early follower."""
    r = value_ranks(e, ["market"], "established").select("market", "established", (c("lt") + 1).alias("entry_rank"), c("n").alias("_n"))
    y = F.year("established")
    return e.join(r, ["market", "established"]).select(
        "company_id", "market", (F.datediff(F.lit(now).cast("date"), "established") / 365.25).alias("age"), "entry_rank",
        *[y.between(a, b).alias(f"era_{k}") for k, (a, b) in eras.items()], (c("entry_rank") == 1).alias("pioneer"),
        ((c("entry_rank") > 1) & (c("entry_rank") <= c("_n") * 0.2)).alias("early_follower"))


def parent_dependency(df: DataFrame, links: DataFrame) -> DataFrame:
    """Latest-row ratios of child to parent and the independence score .4 / .3 / .3."""
    last = df.groupBy("company_id").agg(*[F.max_by(x, "year").alias(x) for x in ("revenue", "total_assets", "employees")])
    par = last.select(c("company_id").alias("parent_id"), *[c(x).alias(f"_p_{x}") for x in ("revenue", "total_assets", "employees")])
    j = links.select("company_id", "parent_id").join(last, "company_id").join(par, "parent_id")
    r = {x: sd(x, f"_p_{x}") for x in ("revenue", "total_assets", "employees")}
    ind = clip(r["revenue"], 0, 1) * 0.4 + clip(r["total_assets"], 0, 1) * 0.3 + clip(r["employees"], 0, 1) * 0.3
    return j.select("company_id", "parent_id", *[v.alias(f"{k}_ratio") for k, v in r.items()], ind.alias("independence"))


def initial_resources(df: DataFrame, capital: tuple[float, float], staff: tuple[float, float, float]) -> DataFrame:
    """Bands and score of the first year's assets and staff."""
    g = df.groupBy("company_id").agg(F.min_by("total_assets", "year").alias("capital"), F.min_by("employees", "year").alias("staff"))
    cs = ladder([(c("capital") >= capital[1], 1.0), (c("capital") >= capital[0], 0.6)], 0.3)
    ss = ladder([(c("staff") >= staff[2], 1.0), (c("staff") >= staff[1], 0.8), (c("staff") >= staff[0], 0.5)], 0.2)
    return g.select("company_id", "capital", "staff", ladder([(c("capital") >= capital[1], "large"), (c("capital") >= capital[0], "medium")], "small").alias("capital_band"),
                    ((cs + ss) / 2).alias("resource_score"))


def innovation_potential(df: DataFrame) -> DataFrame:
    """.3 R&D, .2 intangibles, .3 growth, .2 segments on the latest row, each clipped to 0-1."""
    g = df.groupBy("company_id").agg(F.max_by(F.struct("rd_ratio", "intangible_fixed_assets", "total_assets", "growth", "segments_count"), "year").alias("_r")).select("company_id", "_r.*")
    s = (clip(c("rd_ratio") / 10, 0, 1) * 0.3 + clip(sd("intangible_fixed_assets", "total_assets") * 5, 0, 1) * 0.2
         + clip(F.coalesce(c("growth"), F.lit(0.0)) / 100, 0, 1) * 0.3 + clip(c("segments_count") / 5, 0, 1) * 0.2)
    return g.select("company_id", s.alias("innovation_potential"))


def early_growth(df: DataFrame, k: int = 5, productivity: float = 1e7) -> DataFrame:
    """First k years: revenue and staff CAGR, margin change, productivity, composite and speed class."""
    d = df.where(c("year") <= c("start_year") + k)
    s = F.struct("revenue", "operating_profit", "employees", "total_assets", "year")
    g = d.groupBy("company_id").agg(F.min_by(s, "year").alias("a"), F.max_by(s, "year").alias("z"), F.count(F.lit(1)).alias("n")).where(c("n") >= 2)
    yrs = c("z.year") - c("a.year")
    cg = lambda x: F.when((c(f"a.{x}") > 0) & (c(f"z.{x}") > 0) & (yrs > 0), F.pow(c(f"z.{x}") / c(f"a.{x}"), 1.0 / yrs) - 1).otherwise(0.0)
    g = g.select("company_id", "n", cg("revenue").alias("revenue_cagr"), cg("employees").alias("employee_cagr"),
                 (sd("z.operating_profit", "z.revenue") - sd("a.operating_profit", "a.revenue")).alias("margin_change"), sd("z.revenue", "z.employees").alias("productivity"))
    comp = (clip(c("revenue_cagr"), 0, 1) * 0.4 + clip(F.coalesce(c("margin_change"), F.lit(0.0)) + 0.1, 0, 1) * 0.3
            + F.least(F.coalesce(c("productivity"), F.lit(0.0)) / productivity, F.lit(1.0)) * 0.3)
    return g.select("*", comp.alias("composite"), ladder([(c("revenue_cagr") > 0.3, "high"), (c("revenue_cagr") > 0.1, "medium")], "low").alias("speed"))


def success_score(df: DataFrame, targets: tuple[float, float, float] = (1e9, 100.0, 5.0)) -> DataFrame:
    """.4 revenue + .3 staff + .3 age against capped targets; sigmoid probability and class .8 / .5."""
    g = df.groupBy("company_id", "market").agg(F.max_by("revenue", "year").alias("_r"), F.max_by("employees", "year").alias("_e"),
                                               (F.max("year") - F.min("start_year")).cast("double").alias("_a"), F.min("start_year").alias("start_year"))
    s = F.least(c("_r") / targets[0], F.lit(1.0)) * 0.4 + F.least(c("_e") / targets[1], F.lit(1.0)) * 0.3 + F.least(c("_a") / targets[2], F.lit(1.0)) * 0.3
    d = g.select("company_id", "market", "start_year", s.alias("score"))
    return d.select("*", (1 / (1 + F.exp(-5 * (c("score") - 0.5)))).alias("probability"), ladder([(c("score") >= 0.8, "high"), (c("score") >= 0.5, "medium")], "low").alias("success_class"))


def success_labels(df: DataFrame, horizon: int, growth: float, share: float, profit_years: int, cut: float = 0.6) -> DataFrame:
    """Weighted criteria: CAGR over the horizon, peak share, years to profit, survival."""
    g = df.groupBy("company_id").agg(
        F.min_by("revenue", "year").alias("_a"), F.max_by("revenue", "year").alias("_z"), F.min("year").alias("_y0"), F.max("year").alias("_y1"), F.max("share").alias("_sh"),
        F.min(F.when(c("margin") > 0, c("year"))).alias("_py"), F.max(c("year") - c("start_year")).alias("_age"))
    cg = F.when((c("_a") > 0) & (c("_z") > 0) & (c("_y1") > c("_y0")), F.pow(c("_z") / c("_a"), 1.0 / (c("_y1") - c("_y0"))) - 1).otherwise(0.0)
    s = flag(cg >= growth) * 0.3 + flag(c("_sh") >= share) * 0.25 + flag(c("_py") - c("_y0") <= profit_years) * 0.25 + flag(c("_age") >= horizon) * 0.2
    return g.select("company_id", cg.alias("cagr"), s.alias("weighted"), (s >= cut).cast("int").alias("label"))


def success_by(d: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.avg(flag(c(score) >= 0.5)).alias("success_rate"))


def importance_by_correlation(d: DataFrame, target: str, cols: list[str], top: int = 20) -> DataFrame:
    """Largest |corr| with the target after one unpivot."""
    v = d.select(c(target).cast("double").alias("_y"), *[c(x).cast("double").alias(x) for x in cols]).unpivot(["_y"], cols, "factor", "v")
    g = v.groupBy("factor").agg(safe_corr("v", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("importance", F.abs("r")).orderBy(F.desc("importance"), "factor").limit(top)


def success_model(d: DataFrame, label: str, xs: list[str], period: str, split: int, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), seed: int = 42):
    """Robust-scaled LR, forest and boosting fitted before ``split``; weighted probability and AUC after it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import RobustScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # the scaler, three fits, the quality and the result read the rows again
    d = reliable(d.select("company_id", period, label, *xs).na.fill(0.0, xs))
    prep = Pipeline(stages=[VectorAssembler(inputCols=xs, outputCol="_x"), RobustScaler(inputCol="_x", outputCol="_f", withCentering=True)])
    train = d.where(c(period) < split)
    pm = prep.fit(train)
    out, tr = pm.transform(d), pm.transform(train)
    models = [("lr", LogisticRegression(maxIter=50)), ("rf", RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed)), ("gbt", GBTClassifier(maxIter=15, maxDepth=3, seed=seed))]
    for n, m in models:
        m.setFeaturesCol("_f").setLabelCol(label).setProbabilityCol(f"_p{n}").setRawPredictionCol(f"_r{n}").setPredictionCol(f"_c{n}")
        out = m.fit(tr).transform(out).withColumn(n, vector_to_array(f"_p{n}")[1])
    out = out.withColumn("probability", total([c(n) * w for (n, _), w in zip(models, weights)]))
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label).evaluate(out.where(c(period) >= split))
    return out.select("company_id", period, label, "lr", "rf", "gbt", "probability"), float(auc)


def entry_scan(d: DataFrame, horizon: int = 10) -> DataFrame:
    """Score of entering k = 0..horizon years ahead: growth decays, competition rises, size compounds; best year."""
    e = d.select("market", "growth", "competition", "size", "age", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("wait"))
    g = c("growth") * F.exp(-0.1 * c("wait"))
    comp = F.least(c("competition") + 0.05 * c("wait"), F.lit(1.0))
    size = c("size") * F.pow(1 + c("growth"), c("wait").cast("double"))
    ms = e.groupBy("market").agg(F.max(size).alias("_ms"))
    e = e.join(ms, "market")
    s = clip(clip(g * 5, 0, 1) * 0.4 + (1 - comp) * 0.3 + clip(size / F.nullif(c("_ms"), F.lit(0.0)), 0, 1) * 0.3, 0, 1)
    ph = ladder([(c("age") + c("wait") < 2, "pioneer"), (c("age") + c("wait") < 7, "growth"), (c("age") + c("wait") < 15, "mature")], "late")
    e = e.select("market", "wait", s.alias("score"), ph.alias("phase"))
    w = Window.partitionBy("market").orderBy(F.desc("score"), "wait")  # horizon + 1 rows per market
    return e.withColumn("rank", F.row_number().over(w))


def startup_score(d: DataFrame, blocks: dict[str, float], top: float = 0.7) -> DataFrame:
    """Min-max scaled weighted blocks; success = top 30%."""
    st = d.agg(*[x for b in blocks for x in (F.min(b).alias(f"_lo_{b}"), F.max(b).alias(f"_hi_{b}"))])
    e = with_totals(d, st)
    s = total([F.coalesce(sd(c(b) - c(f"_lo_{b}"), c(f"_hi_{b}") - c(f"_lo_{b}")), F.lit(0.0)) * w for b, w in blocks.items()])
    e = e.select(*d.columns, s.alias("score"))
    q = exact_quantiles(e, [], "score", {"_q": top}).drop("n")
    return with_totals(e, q).withColumn("success", flag(c("score") >= c("_q"))).drop("_q")


def entity_metrics(df: DataFrame) -> DataFrame:
    """CAGR, years to profit, slopes, stability, age and R&D x growth; score .3/.25/.25/.2; levels at quantiles."""
    g = df.groupBy("company_id", "market").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("revenue", "year").alias("_a"), F.max_by("revenue", "year").alias("_z"), F.min("year").alias("_y0"), F.max("year").alias("_y1"),
        F.min(F.when(c("margin") > 0, c("year"))).alias("_py"), F.regr_slope("margin", "year").alias("margin_slope"), F.avg("margin").alias("_m"), F.stddev_samp("growth").alias("_gs"),
        F.avg(c("rd_ratio") * c("growth")).alias("rd_growth"))
    cg = F.when((c("_a") > 0) & (c("_y1") > c("_y0")), F.pow(c("_z") / c("_a"), 1.0 / (c("_y1") - c("_y0"))) - 1).otherwise(0.0)
    stab = 1 / (1 + F.coalesce(c("_gs"), F.lit(0.0)) / 100)
    age = F.least((c("_y1") - c("_y0")) / 10.0, F.lit(1.0))
    s = clip(cg, 0, 1) * 0.3 + clip(c("_m") / 20, 0, 1) * 0.25 + stab * 0.25 + age * 0.2
    d = g.select("company_id", "market", "n", cg.alias("cagr"), (c("_py") - c("_y0")).alias("years_to_profit"), "margin_slope", stab.alias("stability"), "rd_growth", s.alias("score"))
    q = exact_quantiles(d, [], "score", {"_q4": 0.4, "_q6": 0.6, "_q8": 0.8}).drop("n")
    return with_totals(d, q).withColumn("level", ladder([(c("score") >= c("_q8"), "excellent"), (c("score") >= c("_q6"), "good"), (c("score") >= c("_q4"), "average")], "low")).drop("_q4", "_q6", "_q8")


# ---- growth curves -------------------------------------------------------------------

def _bases(n: int) -> tuple[np.ndarray, list[tuple[str, int, int]]]:
    """Every candidate curve on ``n`` places between 0 and 1 (a row each), and the rows of each family."""
    x = np.arange(n) / (n - 1)
    fams = [("linear", [x]), ("logarithmic", [np.log1p(x)]), ("exponential", [np.exp(r * x) for r in np.linspace(0.25, 8, 32)]),
            ("decline", [np.exp(-r * x) for r in np.linspace(0.25, 8, 32)]),
            ("s_curve", [1 / (1 + np.exp(-r * (x - m))) for r in np.linspace(2, 20, 10) for m in np.linspace(0.1, 0.9, 9)])]
    ends = np.cumsum([0, *[len(f) for _, f in fams]])
    return np.concatenate([f for _, f in fams]), [(k, int(i), int(j)) for (k, _), i, j in zip(fams, ends, ends[1:])]


def _best_curves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, r2 and both coefficients of the best of linear, logarithmic, exponential, decline and S curve for series
    of one length (a row each) on 0-1 scaled data; all series are fitted to all curves by one product."""
    lo, hi = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
    s = (y - lo) / (hi - lo)
    f, fams = _bases(y.shape[1])
    e, z = f - f.mean(axis=1, keepdims=True), s - s.mean(axis=1, keepdims=True)
    slope = (z @ e.T) / (e * e).sum(axis=1)
    r2 = slope * slope * (e * e).sum(axis=1) / (z * z).sum(axis=1)[:, None]
    each = np.stack([i + r2[:, i:j].argmax(axis=1) for _, i, j in fams], axis=1)
    rows = np.arange(len(y))
    # a richer curve must beat the straight line clearly
    win = (r2[rows[:, None], each] - np.array([0.0 if k == "linear" else 0.02 for k, _, _ in fams])).argmax(axis=1)
    at = each[rows, win]
    b = slope[rows, at]
    return np.array([k for k, _, _ in fams])[win], r2[rows, at], s.mean(axis=1) - b * f.mean(axis=1)[at], b


def _curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Series (key, values by year) to fits; series of one length are fitted together, at most 2^20 values at once."""
    for b in batches:
        series = b.column("series")
        n, v = pc.list_value_length(series).to_numpy(zero_copy_only=False).astype(np.int64), series.flatten().to_numpy(zero_copy_only=False)
        at = np.cumsum(n) - n
        lo, hi = (np.array(f.reduceat(v, at)) if len(n) else np.zeros(0) for f in (np.minimum, np.maximum))
        curve, fits = np.full(len(n), "none", dtype=object), np.full((3, len(n)), np.nan)
        ok = (n >= 3) & (hi != lo)
        for k in np.unique(n[ok]):
            same = np.flatnonzero(ok & (n == k))
            for i in range(0, len(same), max((1 << 20) // int(k), 1)):
                w = same[i:i + max((1 << 20) // int(k), 1)]
                curve[w], *fit = _best_curves(v[at[w][:, None] + np.arange(k)])
                fits[:, w] = fit
        yield pa.RecordBatch.from_arrays([b.column("company_id"), pa.array(n), pa.array(curve, pa.string()), *[pa.array(x) for x in (*fits, lo, hi)]],
                                         names=["company_id", "n", "curve", "r2", "a", "b", "lo", "hi"])


def growth_curves(df: DataFrame, value: str) -> DataFrame:
    """Curve fit per entity; an entity's rows (one per period) become one ordered array, and whole batches are fitted."""
    g = df.where(c(value).isNotNull()).groupBy(c("company_id").cast("long").alias("company_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("year", c(value).cast("double").alias("v")))), lambda r: r["v"]).alias("series"))
    return g.mapInArrow(_curves, "company_id long, n long, curve string, r2 double, a double, b double, lo double, hi double")


def linear_projection(df: DataFrame, value: str, horizon: int, min_n: int = 3) -> DataFrame:
    """Fitted line evaluated on future years with r2 as confidence."""
    g = df.where(c(value).isNotNull()).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(c(value), c("year")).alias("_s"), F.regr_intercept(c(value), c("year")).alias("_i"),
                                                                 F.regr_r2(c(value), c("year")).alias("confidence"), F.max("year").alias("_y")).where(c("n") >= min_n)
    e = g.select("*", F.explode(F.sequence(c("_y") + 1, c("_y") + horizon)).alias("year"))
    return e.select("company_id", "year", (c("_i") + c("_s") * c("year")).alias("predicted"), "confidence")


# ---- succession and spin-offs -----------------------------------------------------------

def pre_post(df: DataFrame, events: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """Means of k years before and after the event year (excluded) and change in percent of |before|."""
    ev = events.select("company_id", "event_type", "event_year")
    j = df.select("company_id", "year", *cols).join(ev, "company_id").where(c("year").between(c("event_year") - k, c("event_year") + k))
    pre, post = c("year") < c("event_year"), c("year") > c("event_year")
    g = j.groupBy("company_id", "event_type", "event_year").agg(*[a for x in cols for a in (F.avg(F.when(pre, c(x))).alias(f"{x}_pre"), F.avg(F.when(post, c(x))).alias(f"{x}_post"))])
    g = g.where(c(f"{cols[0]}_pre").isNotNull() & c(f"{cols[0]}_post").isNotNull())
    return g.select("*", *[((c(f"{x}_post") - c(f"{x}_pre")) / F.nullif(F.abs(c(f"{x}_pre")), F.lit(0.0)) * 100).alias(f"{x}_change") for x in cols])


def share_change(df: DataFrame, events: DataFrame) -> DataFrame:
    """Share the year before against two years after the event (keys shifted, plain equality)."""
    ev = events.select("company_id", "event_year")
    j = df.select("company_id", "year", "share").join(ev, "company_id").where(c("year").isin(c("event_year") - 1, c("event_year") + 2))
    g = j.groupBy("company_id", "event_year").agg(F.max(F.when(c("year") < c("event_year"), c("share"))).alias("_a"), F.max(F.when(c("year") > c("event_year"), c("share"))).alias("_z"))
    return g.select("company_id", "event_year", (c("_z") - c("_a")).alias("share_change"), F.when(c("_a") > 0, (c("_z") - c("_a")) / c("_a") * 100).alias("share_change_rate"))


def integration_score(pp: DataFrame, share: DataFrame, industry_growth: float = 3.0) -> DataFrame:
    """Synergies and the .4 financial + .3 synergy + .2 market + .1 risk score."""
    n50 = lambda x: clip(x, -50, 50) / 50 * 100
    rs, cs = c("revenue_change") - industry_growth, c("operating_profit_change") - c("revenue_change")
    turn = lambda t: sd(f"revenue_{t}", f"total_assets_{t}")
    d = pp.join(share, ["company_id", "event_year"], "left")
    fin = mean_of([n50(c("revenue_change")), n50(c("operating_profit_change")), n50(c("roa_change"))])
    syn = mean_of([n50(rs), n50(cs), n50(c("roa_change"))])
    mk = clip(c("share_change_rate") * 2, -100, 100)
    rk = 50 + F.coalesce(clip(c("shareholders_equity_change"), -50, 50), F.lit(0.0))
    return d.select("company_id", "event_type", "event_year", rs.alias("revenue_synergy"), cs.alias("cost_synergy"), ((turn("post") - turn("pre")) / turn("pre") * 100).alias("scale_effect"),
                    (fin * 0.4 + syn * 0.3 + F.coalesce(mk, F.lit(0.0)) * 0.2 + rk * 0.1).alias("score"), "revenue_change", "operating_profit_change")


def effectiveness(scores: DataFrame) -> DataFrame:
    return scores.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.avg("revenue_change").alias("revenue_change"))


def succession_factors(scores: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """|corr| of the values in the year before the event with the integration score."""
    b = df.select("company_id", (c("year") + 1).alias("event_year"), *cols)
    return importance_by_correlation(scores.select("company_id", "event_year", "score").join(b, ["company_id", "event_year"]), "score", cols, len(cols))


def spinoff_success(pp: DataFrame) -> DataFrame:
    """.3 revenue + .25 profit + .25 assets + .2 staff change, clipped, and the risk-adjusted score."""
    z = lambda x: clip(c(x) / 100, -1, 1)
    s = z("revenue_change") * 0.3 + F.coalesce(z("operating_profit_change"), F.lit(0.0)) * 0.25 + z("total_assets_change") * 0.25 + z("employees_change") * 0.2
    d = pp.select("company_id", "event_type", "event_year", s.alias("score"), F.abs(c("revenue_change") - c("total_assets_change")).alias("_r"))
    return d.select("company_id", "event_type", "event_year", "score", (c("score") / (1 + c("_r") / 100)).alias("risk_adjusted"))


def spinoff_patterns(scores: DataFrame, entities: DataFrame, crisis: tuple[int, ...], boom: tuple[int, ...]) -> DataFrame:
    """Success by segment and timing class."""
    t = ladder([(c("event_year").isin(*crisis), "crisis"), (c("event_year").isin(*boom), "growth")], "normal")
    j = scores.join(entities.select("company_id", "market"), "company_id")
    return j.groupBy("market", t.alias("timing")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg(flag(c("score") > 0)).alias("success_rate"))


def emergence_progress(df: DataFrame, as_of: int) -> DataFrame:
    """Growth trajectory and success indicators per company, from its yearly rows.

    Mean and spread of its yearly growths (those that are given and not zero), and three scores between 0 and 1: five
    years of age are a full survival score, a margin of 20% a full profitability score and R&D of 10% of revenue a full
    innovation score, both at the latest row; ``overall`` is their mean, a score without a value counting as 0.
    """
    g = F.when(c("growth") != 0, c("growth"))
    r = df.groupBy("company_id", "market").agg(F.min("year").alias("entry_year"), F.max("year").alias("last_year"), F.avg(g).alias("mean_growth"), F.stddev_pop(g).alias("growth_spread"),
                                               F.max_by(F.struct("margin", "rd_ratio"), "year").alias("_l"), F.regr_slope("margin", "year").alias("margin_trend"))
    share = lambda v, full: F.coalesce(clip(v / full, 0, 1), F.lit(0.0))
    r = r.withColumns({"survival": share((F.lit(as_of) - c("entry_year")).cast("double"), 5.0), "profitability": share(c("_l.margin"), 20.0), "innovation": share(c("_l.rd_ratio"), 10.0)})
    return r.drop("_l").withColumn("overall", (c("survival") + c("profitability") + c("innovation")) / 3)


def extinction_process(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cause (debt ratio above .7), salvage value .8 x assets and record quality at the last row before the event."""
    ev = ledger.select("company_id", "event_type", F.year("event_date").alias("_y"))
    last = df.join(ev, "company_id").where(c("year") <= c("_y")).groupBy("company_id", "event_type", "_y").agg(
        F.max_by(F.struct("total_assets", "total_liabilities", "net_profit", "year"), "year").alias("_r"), F.count(F.lit(1)).alias("n"))
    debt = sd("_r.total_liabilities", "_r.total_assets")
    return last.select("company_id", "event_type", debt.alias("debt_ratio"), F.when(debt > 0.7, "excess_debt").when(c("_r.net_profit") < 0, "losses").otherwise("other").alias("cause"),
                       (c("_r.total_assets") * 0.8).alias("value"), (F.least(c("n") / 5.0, F.lit(1.0)) * 0.5 + flag(c("_y") - c("_r.year") <= 1) * 0.5).alias("record_quality"))


def register(existing: DataFrame, incoming: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Upsert by key: the newest record wins (max_by combines copies before the shuffle)."""
    u = existing.unionByName(incoming, allowMissingColumns=True)
    rest = [x for x in u.columns if x not in key]
    return u.groupBy(*key).agg(F.max_by(F.struct(*rest), stamp).alias("_r")).select(*key, "_r.*")
