"""Scaling, clustering, PCA, forecasts, ensembles and scenarios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, sd, total, with_totals
from ..functions.windows import W, whole
from ..session import reliable

c = F.col


def features(df: DataFrame, cols: list[str], scaler: str = "standard", emphasis: dict[str, float] | None = None) -> DataFrame:
    """Assembled and scaled vector ``features``; emphasized columns are multiplied after standardizing.

    Scalers, fits and results each read the rows again, so these are written once: give it the needed columns only."""
    from pyspark.ml.feature import ElementwiseProduct, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
    from pyspark.ml.linalg import Vectors

    d = VectorAssembler(inputCols=cols, outputCol="_raw").transform(reliable(df.na.drop(subset=cols)))
    s = {"standard": lambda: StandardScaler(inputCol="_raw", outputCol="_sc", withMean=True), "minmax": lambda: MinMaxScaler(inputCol="_raw", outputCol="_sc"),
         "robust": lambda: RobustScaler(inputCol="_raw", outputCol="_sc", withCentering=True)}[scaler]()
    d = s.fit(d).transform(d)
    e = ElementwiseProduct(scalingVec=Vectors.dense([float((emphasis or {}).get(x, 1.0)) for x in cols]), inputCol="_sc", outputCol="features")
    return e.transform(d).drop("_raw", "_sc")


def fit_clusters(d: DataFrame, kind: str, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans

    est = {"kmeans": KMeans, "hierarchy": BisectingKMeans, "mixture": GaussianMixture}[kind](k=k, seed=seed)
    return est.setFeaturesCol("features").setPredictionCol("cluster").fit(d).transform(d)


def choose_k(df: DataFrame, cols: list[str], ks: tuple[int, ...] = tuple(range(2, 11)), kind: str = "kmeans", scaler: str = "standard", seed: int = 42):
    """Clusters for the k with the best silhouette; the scores come back as a table."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    d = features(df, cols, scaler).persist()
    ev = ClusteringEvaluator(predictionCol="cluster")
    scores, best = [], None
    for k in ks:
        p = fit_clusters(d, kind, k, seed)
        s = float(ev.evaluate(p)) if p.select("cluster").distinct().count() > 1 else -1.0
        scores.append((k, s))
        if best is None or s > best[0]:
            best = (s, p)
    d.unpersist()
    return best[1].drop("features", "probability"), df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def quality(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from group sums, simplified silhouette to centres, composite score."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in cols], *[F.var_pop(x).alias(f"v_{x}") for x in cols])
    d = df.join(g, cluster)
    own = F.sqrt(total([F.pow(c(x) - c(f"m_{x}"), F.lit(2.0)) for x in cols]))
    spread = d.groupBy(cluster).agg(F.avg(own).alias("s"))
    g = g.join(spread, cluster)
    mean = df.agg(*[F.avg(x).alias(f"g_{x}") for x in cols], F.count(F.lit(1)).alias("_tot"))
    gm = with_totals(g, mean)
    bw = gm.agg(F.sum(c("n") * total([F.pow(c(f"m_{x}") - c(f"g_{x}"), F.lit(2.0)) for x in cols])).alias("b"), F.sum(c("n") * total([c(f"v_{x}") for x in cols])).alias("w"),
                F.count(F.lit(1)).alias("k"), F.max("_tot").alias("_tot"))
    o = g.select(c(cluster).alias("_o"), c("s").alias("_s"), *[c(f"m_{x}").alias(f"_m_{x}") for x in cols])
    # k centres against k centres
    pr = g.join(F.broadcast(o), c(cluster) != c("_o"))
    dist = F.sqrt(total([F.pow(c(f"m_{x}") - c(f"_m_{x}"), F.lit(2.0)) for x in cols]))
    db = pr.groupBy(cluster).agg(F.max((c("s") + c("_s")) / dist).alias("_r")).agg(F.avg("_r").alias("davies_bouldin"))
    r = with_totals(bw, db)
    ch = (c("b") / (c("k") - 1)) / (c("w") / (c("_tot") - c("k")))
    return r.select("k", ch.alias("calinski_harabasz"), "davies_bouldin")


def composite(q: DataFrame, silhouette: float) -> DataFrame:
    return q.withColumn("composite", 0.6 * silhouette + 0.3 * F.least(c("calinski_harabasz") / 1000, F.lit(1.0)) + 0.1 / (1 + c("davies_bouldin")))


def cluster_stats(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Size, means, active share and the feature that differs most from the overall mean (in deviations)."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in cols])
    t = df.agg(*[F.avg(x).alias(f"_g_{x}") for x in cols], *[F.stddev_samp(x).alias(f"_s_{x}") for x in cols])
    d = with_totals(g, t)
    z = [F.struct(F.abs(sd(c(x) - c(f"_g_{x}"), f"_s_{x}")).alias("z"), F.lit(x).alias("f")) for x in cols]
    return d.select(cluster, "n", *cols, F.array_max(F.array(*z))["f"].alias("dominant"))


def pca(df: DataFrame, cols: list[str], k: int):
    """Scores and explained shares of the first k components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    d = features(df, cols)
    m = PCA(k=k, inputCol="features", outputCol="_pc").fit(d)
    out = m.transform(d).withColumn("_a", vector_to_array("_pc"))
    return out.select(*df.columns, *[c("_a")[i].alias(f"pc{i + 1}") for i in range(k)]), [float(x) for x in m.explainedVariance]


def lifecycle_features(df: DataFrame, growth_cols: list[str]) -> DataFrame:
    """Mean, spread and slope across several growth columns of a row, and stability."""
    arr = F.array(*[c(x) for x in growth_cols])
    n = len(growth_cols)
    m = total([c(x) for x in growth_cols]) / n
    s = F.sqrt(total([F.pow(c(x) - m, F.lit(2.0)) for x in growth_cols]) / n)
    xm = (n - 1) / 2
    sl = total([(c(x)) * (i - xm) for i, x in enumerate(growth_cols)]) / sum((i - xm) ** 2 for i in range(n))
    return df.select("*", F.size(arr).alias("_k"), m.alias("growth_mean"), s.alias("growth_std"), sl.alias("growth_slope"), (1 / (1 + s)).alias("growth_stability")).drop("_k")


def survival_features(df: DataFrame) -> DataFrame:
    """Health .3/.3/.2/.2, trailing losses and decline of the last 3 against the first 3 rows."""
    d = df.withColumn("_i", F.row_number().over(W())).withColumn("_b", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year"))))
    pos = F.when(c("net_profit") >= 0, c("_b"))
    g = d.groupBy("company_id").agg(
        (F.avg(clip(sd("shareholders_equity", "total_assets"), 0, 1)) * 0.3 + F.avg(clip(sd("operating_profit", "revenue") * 5, 0, 1)) * 0.3
         + F.avg(clip(sd("current_assets", "current_liabilities") / 2, 0, 1)) * 0.2 + F.avg(clip(sd("operating_cash_flow", "revenue") * 5, 0, 1)) * 0.2).alias("health"),
        F.coalesce(F.min(pos) - 1, F.count(F.lit(1))).alias("trailing_losses"), F.avg(F.when(c("_i") <= 3, c("revenue"))).alias("_a"), F.avg(F.when(c("_b") <= 3, c("revenue"))).alias("_z"))
    return g.select("company_id", "health", (1 - c("health")).alias("risk"), "trailing_losses", ((c("_a") - c("_z")) / F.nullif(c("_a"), F.lit(0.0))).alias("decline"))


# ---- ensembles ---------------------------------------------------------------------------

def ensemble(df: DataFrame, y: str, xs: list[str], period: str, split: int, seed: int = 42):
    """Linear, forest and boosting on earlier periods; voting mean, weights 1/error on the first hold-out
    period (adaptive) and a linear stack fitted there."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    from .regression import ols, prediction

    # every model, the weights and the result read the rows again
    d = VectorAssembler(inputCols=xs, outputCol="_f").transform(reliable(df.na.drop(subset=[y, *xs])))
    train = d.where(c(period) < split)
    names = []
    for n, m in (("lin", LinearRegression()), ("rf", RandomForestRegressor(numTrees=15, maxDepth=5, seed=seed)), ("gbt", GBTRegressor(maxIter=10, maxDepth=3, seed=seed))):
        d = m.setFeaturesCol("_f").setLabelCol(y).setPredictionCol(n).fit(train).transform(d)
        names.append(n)
    hold = d.where(c(period) == split)
    err = hold.agg(*[F.avg((c(n) - c(y)) * (c(n) - c(y))).alias(n) for n in names]).first()
    w = np.array([1 / max(err[n], 1e-12) for n in names])
    w /= w.sum()
    stack = ols(hold, y, names, ridge=1e-6)
    return d.drop("_f").select("*", (total([c(n) for n in names]) / len(names)).alias("voting"), total([c(n) * float(x) for n, x in zip(names, w)]).alias("adaptive"),
                               prediction(stack).alias("stacked"))


# ---- forecasts ------------------------------------------------------------------------------

def linear_forecast(df: DataFrame, value: str, horizon: int, z: float = 1.959963984540054, min_n: int = 3) -> DataFrame:
    """Trend line ahead with a residual band growing with the square root of the step."""
    d = df.where(c(value).isNotNull()).select("company_id", "year", c(value).alias("v"), (F.row_number().over(W()) - 1).alias("i"))
    g = d.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", "i").alias("s"), F.regr_intercept("v", "i").alias("c0"), F.regr_syy("v", "i").alias("syy"),
                                    F.regr_sxy("v", "i").alias("sxy"), F.max("year").alias("last")).where(c("n") >= min_n)
    se = F.sqrt(F.greatest(c("syy") - c("s") * c("sxy"), F.lit(0.0)) / F.greatest(c("n") - 2, F.lit(1)))
    e = g.select("*", se.alias("se"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    f = c("c0") + c("s") * (c("n") - 1 + c("step"))
    band = z * c("se") * F.sqrt(c("step").cast("double"))
    return e.select("company_id", "step", (c("last") + c("step")).alias("year"), f.alias("forecast"), (f - band).alias("lower"), (f + band).alias("upper"))


def ar_forecast(df: DataFrame, value: str, horizon: int, min_n: int = 5) -> DataFrame:
    """AR(1) on first differences per series by lag sums, iterated; AIC against the drift-only model decides."""
    w = W()
    d = df.where(c(value).isNotNull()).select("company_id", "year", c(value).alias("v"), (c(value) - F.lag(value).over(w)).alias("d"))
    d = d.withColumn("p", F.lag("d").over(w))
    g = d.groupBy("company_id").agg(F.count("p").alias("n"), F.regr_slope("d", "p").alias("phi"), F.regr_intercept("d", "p").alias("mu"), F.regr_syy("d", "p").alias("syy"),
                                    F.regr_sxy("d", "p").alias("sxy"), F.avg("d").alias("drift"), F.max_by("v", "year").alias("last"), F.max_by("d", "year").alias("dl"), F.max("year").alias("year"))
    g = g.where((c("n") >= min_n - 2) & (c("syy") > 0))
    n = F.nullif(c("n").cast("double"), F.lit(0.0))
    rss1 = F.greatest(c("syy") - c("phi") * c("sxy"), F.lit(1e-12))
    use = (n * F.ln(rss1 / n) + 4 < n * F.ln(c("syy") / n) + 2) & (F.abs("phi") < 1)
    g = g.withColumn("order", F.when(use, 1).otherwise(0))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    path = F.aggregate(steps, F.struct(c("last").alias("v"), c("dl").alias("d"), F.array().cast("array<double>").alias("a")), lambda s, k: F.struct(
        (s["v"] + F.when(c("order") == 1, c("mu") + c("phi") * s["d"]).otherwise(c("drift"))).alias("v"),
        F.when(c("order") == 1, c("mu") + c("phi") * s["d"]).otherwise(c("drift")).alias("d"),
        F.concat(s["a"], F.array(s["v"] + F.when(c("order") == 1, c("mu") + c("phi") * s["d"]).otherwise(c("drift")))).alias("a")))
    g = g.withColumn("_p", path["a"])
    return g.select("company_id", "order", "year", F.posexplode("_p").alias("_i", "forecast")).select("company_id", "order", (c("_i") + 1).alias("step"), (c("year") + c("_i") + 1).alias("year"), "forecast")


def autoregression(df: DataFrame, value: str, horizon: int, most: int = 3, differences: int = 1) -> DataFrame:
    """AR(p) per series by Levinson-Durbin on autocovariances; p from 0 to ``most`` by the corrected AIC.

    Series are differenced first (0 or 1 times), and forecasts are summed up again.  An order needs three more values
    than it has coefficients; a series needs two differences.  All of it is plain expressions on one row a series.
    """
    w = W()
    x = c(value).cast("double")
    d = df.where(c(value).isNotNull()).select("company_id", "year", x.alias("v"), (x - F.lag(x).over(w) if differences else x).alias("x")).where(c("x").isNotNull())
    d = d.withColumn("_e", c("x") - F.avg("x").over(whole()))
    d = d.withColumns({f"_p{k}": c("_e") * (F.lag("_e", k).over(w) if k else c("_e")) for k in range(most + 1)})
    g = d.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), F.max_by("v", "year").alias("last"), F.max("year").alias("year"),
                                    F.transform(F.slice(F.sort_array(F.collect_list(F.struct("year", "_e")), False), 1, most), lambda s: s["_e"]).alias("past"),
                                    *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_r{k}") for k in range(most + 1)]).where(c("n") >= 2)
    n = c("n").cast("double")
    g = g.withColumns({f"_r{k}": c(f"_r{k}") / n for k in range(most + 1)}).withColumns({"_s0": c("_r0"), "_a0": F.array().cast("array<double>")})
    for p in range(1, most + 1):  # reflection coefficient, coefficients and innovation variance of order p from order p - 1
        prev = c(f"_a{p - 1}")
        k = (c(f"_r{p}") - total([F.lit(0.0), *[F.get(prev, F.lit(i)) * c(f"_r{p - 1 - i}") for i in range(p - 1)]])) / F.nullif(c(f"_s{p - 1}"), F.lit(0.0))
        g = g.withColumn(f"_k{p}", F.coalesce(k, F.lit(0.0)))
        g = g.withColumn(f"_a{p}", F.concat(F.zip_with(prev, F.reverse(prev), lambda a, b: a - c(f"_k{p}") * b) if p > 1 else prev, F.array(f"_k{p}")))
        g = g.withColumn(f"_s{p}", c(f"_s{p - 1}") * (1 - c(f"_k{p}") * c(f"_k{p}")))
    score = lambda p: F.when(n > p + 2, n * F.ln(F.greatest(c(f"_s{p}"), F.lit(1e-12))) + 2.0 * (p + 1) * n / (n - p - 2))
    g = g.withColumns({f"_c{p}": score(p) for p in range(most + 1)})
    # a null score sorts first: only scored orders take part
    best = F.array_min(F.filter(F.array(*[F.struct(c(f"_c{p}").alias("c"), F.lit(p).alias("p")) for p in range(most + 1)]), lambda s: s["c"].isNotNull()))
    g = g.withColumn("order", F.coalesce(best["p"], F.lit(0)))
    coef = F.array().cast("array<double>")
    for p in range(1, most + 1):
        coef = F.when(c("order") == p, c(f"_a{p}")).otherwise(coef)
    g = g.withColumn("_a", coef)
    start = F.struct(c("past").alias("h"), (c("last") if differences else F.lit(0.0)).alias("v"), F.array().cast("array<double>").alias("f"))

    def ahead(s: Column, _: Column) -> Column:
        e = F.aggregate(F.zip_with(F.col("_a"), F.slice(s["h"], F.lit(1), F.size("_a")), lambda a, h: a * h), F.lit(0.0), lambda t, v: t + v)
        v = (s["v"] + c("mu") + e) if differences else (c("mu") + e)
        return F.struct(F.concat(F.array(e), s["h"]).alias("h"), v.alias("v"), F.concat(s["f"], F.array(v)).alias("f"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, ahead, lambda s: s["f"])
    out = g.select("company_id", "order", "year", F.posexplode(path).alias("_i", "forecast"))
    return out.select("company_id", "order", (c("_i") + 1).alias("step"), (c("year") + c("_i") + 1).alias("year"), "forecast")


def forest_forecast(df: DataFrame, value: str, horizon: int, lags: int = 3, seed: int = 42) -> DataFrame:
    """One pooled forest on lags, mean, spread and elapsed years, applied recursively; band from residual quantiles."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    w = W()
    cols = [f"l{k}" for k in range(1, lags + 1)]
    base = df.where(c(value).isNotNull()).select("company_id", "year", c(value).alias("v"), *[F.lag(value, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)],
                                                 (c("year") - F.min("year").over(whole())).cast("double").alias("t"))
    feats = lambda d: d.withColumn("mean", total([c(x) for x in cols]) / lags).withColumn("slope", c("l1") - c(cols[-1]))
    asm = VectorAssembler(inputCols=[*cols, "t", "mean", "slope"], outputCol="_f")
    train = asm.transform(feats(base.na.drop(subset=cols)))
    model = RandomForestRegressor(featuresCol="_f", labelCol="v", predictionCol="yhat", numTrees=15, maxDepth=5, seed=seed).fit(train)
    q = model.transform(train).select((c("v") - c("yhat")).alias("r")).agg(F.percentile_approx("r", F.array(F.lit(0.025), F.lit(0.975)), 1000).alias("_q"))
    cur = base.groupBy("company_id").agg(F.max_by(F.struct("year", "v", *cols, "t"), "year").alias("_r")).select("company_id", "_r.*").na.drop(subset=cols[:-1])
    out = None
    for h in range(1, horizon + 1):
        nxt = cur.select("company_id", (c("year") + 1).alias("year"), c("v").alias("l1"), *[c(f"l{k - 1}").alias(f"l{k}") for k in range(2, lags + 1)], (c("t") + 1).alias("t"))
        p = model.transform(asm.transform(feats(nxt))).select("company_id", "year", c("yhat").alias("v"), *cols, "t")
        row = p.select("company_id", F.lit(h).alias("step"), "year", c("v").alias("forecast"))
        out = row if out is None else out.unionByName(row)
        cur = p
    s = F.sqrt(c("step").cast("double"))
    return with_totals(out, q).select("company_id", "step", "year", "forecast", (c("forecast") + c("_q")[0] * s).alias("lower"), (c("forecast") + c("_q")[1] * s).alias("upper"))


def market_outlook(fc: DataFrame, base: DataFrame) -> DataFrame:
    """Slope of the mean forecast per market; risk = .7 relative decline + .3 CV."""
    j = fc.join(base.select("company_id", "market", "last_value"), "company_id")
    m = j.groupBy("market", "step").agg(F.avg("forecast").alias("f"), F.avg("last_value").alias("b"))
    g = m.groupBy("market").agg(F.regr_slope("f", "step").alias("slope"), F.max_by("f", "step").alias("_z"), F.max("b").alias("_b"), F.stddev_pop("f").alias("_s"), F.avg("f").alias("_m"))
    return g.select("market", "slope", (0.7 * F.greatest((c("_b") - c("_z")) / c("_b"), F.lit(0.0)) + 0.3 * sd("_s", F.abs("_m"))).alias("risk"))


def average_forecasts(parts: list[DataFrame]) -> DataFrame:
    u = parts[0].select("company_id", "step", "forecast")
    for p in parts[1:]:
        u = u.unionByName(p.select("company_id", "step", "forecast"))
    return u.groupBy("company_id", "step").agg(F.avg("forecast").alias("forecast"), F.count(F.lit(1)).alias("models"))


# fixed scenario parameters: drift shift, volatility factor, yearly shock probability and size
SCENARIOS = {"base": (0.0, 1.0, 0.05, -0.1), "optimistic": (0.03, 0.8, 0.02, -0.05), "pessimistic": (-0.04, 1.3, 0.10, -0.2), "disruption": (-0.02, 2.0, 0.15, -0.35)}


def simulate(units: DataFrame, unit: str, sims: int, years: int, seed: int = 42, floor: float = 0.5) -> DataFrame:
    """Yearly growth paths from (unit, mu, sigma) under each scenario; draws are hashes of their keys.

    Paths are an exploded sequence, one product window of ``years`` rows per path.
    """
    sc = F.array(*[F.struct(F.lit(k).alias("scenario"), *[F.lit(float(x)).alias(n) for x, n in zip(v, ("shift", "vol", "ps", "size"))]) for k, v in SCENARIOS.items()])
    d = units.select(unit, "mu", "sigma", F.explode(sc).alias("_s")).select(unit, "mu", "sigma", "_s.*")
    d = d.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(years))))
    u = lambda tag: (F.pmod(F.xxhash64(c(unit), c("scenario"), c("sim"), c("step"), F.lit(tag), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    nrm = F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * np.pi * u("b"))
    g = c("mu") + c("shift") + c("sigma") * c("vol") * nrm + F.when(u("c") < c("ps"), c("size")).otherwise(0.0)
    w = Window.partitionBy(unit, "scenario", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(unit, "scenario", "sim", "step", F.exp(F.sum(F.ln(F.greatest(1 + g, F.lit(0.01)))).over(w)).alias("value")).withColumn("extinct", flag(c("value") < floor))


def scenario_summary(paths: DataFrame, unit: str, at: int) -> DataFrame:
    """Percentiles, value at risk, expected shortfall and extinction probability at a horizon (sims rows per group)."""
    d = paths.where(c("step") == at)
    q = d.groupBy(unit, "scenario").agg(F.percentile("value", F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)])).alias("_q"), F.avg("value").alias("mean"), F.avg("extinct").alias("extinction"))
    s = d.join(q.select(unit, "scenario", "_q"), [unit, "scenario"]).groupBy(unit, "scenario").agg(F.avg(F.when(c("value") <= c("_q")[0], c("value"))).alias("_t"))
    return q.join(s, [unit, "scenario"]).select(unit, "scenario", "mean", c("_q")[0].alias("p05"), c("_q")[1].alias("p50"), c("_q")[2].alias("p95"), (1 - c("_q")[0]).alias("value_at_risk"),
                                                (1 - c("_t")).alias("shortfall"), "extinction")
