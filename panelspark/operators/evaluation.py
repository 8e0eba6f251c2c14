"""Model evaluation, cross-validation folds, model comparison and bias checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from ..functions.cols import clip, flag, safe_corr, sd, with_totals
from ..functions.ranks import value_ranks
from ..functions.windows import W

c = F.col


def regression_metrics(df: DataFrame, y: str, p: str, k: int = 1, by: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R2, adjusted R2, MAPE, Pearson and residual moments in one aggregate."""
    by = by or []
    e = c(y) - c(p)
    g = df.where(c(y).isNotNull() & c(p).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"), F.avg(F.abs(e / F.nullif(c(y), F.lit(0.0)))).alias("mape"),
        safe_corr(y, p).alias("pearson"), F.avg(e).alias("residual_mean"), F.stddev_samp(e).alias("residual_std"), F.skewness(e).alias("residual_skew"))
    r2 = 1 - sd("mse", "_v")
    return g.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), (1 - (1 - r2) * (c("n") - 1) / (c("n") - k - 1)).alias("adj_r2"), "mape", "pearson",
                    "residual_mean", "residual_std", "residual_skew")


def direction_accuracy(df: DataFrame, y: str, p: str, tol: float = 0.1, extreme: float = 0.5) -> DataFrame:
    """Share of right change directions, of errors within tol and of extreme relative errors."""
    w = W()
    d = df.select("company_id", (c(y) - F.lag(y).over(w)).alias("_a"), (c(p) - F.lag(y).over(w)).alias("_b"), F.abs((c(y) - c(p)) / F.nullif(c(y), F.lit(0.0))).alias("_r"))
    return d.agg(F.avg(F.when(c("_a").isNotNull() & c("_b").isNotNull(), flag(F.signum("_a") == F.signum("_b")))).alias("direction"), F.avg(flag(c("_r") <= tol)).alias("within_tol"),
                 F.avg(flag(c("_r") > extreme)).alias("extreme"), F.count("_a").alias("n"))


def classification_metrics(df: DataFrame, y: str, p: str, cut: float = 0.5) -> DataFrame:
    """Precision, recall, F1, Brier from counts and AUC by rank sums."""
    d = df.where(c(y).isNotNull() & c(p).isNotNull())
    pos, hit = c(y) == 1, c(p) >= cut
    g = d.agg(F.sum((pos & hit).cast("double")).alias("tp"), F.sum((~pos & hit).cast("double")).alias("fp"), F.sum((pos & ~hit).cast("double")).alias("fn"),
              F.sum((~pos & ~hit).cast("double")).alias("tn"), F.avg((c(p) - c(y)) * (c(p) - c(y))).alias("brier"))
    d = reliable(d)
    r = value_ranks(d, [], p).select(p, "avg_rank")
    a = d.join(r, p).agg(F.sum(F.when(pos, c("avg_rank"))).alias("_r"))
    m, n = c("tp") + c("fn"), c("fp") + c("tn")
    pr, rc = sd("tp", c("tp") + c("fp")), sd("tp", m)
    return with_totals(g, a).select("tp", "fp", "fn", "tn", pr.alias("precision"), rc.alias("recall"), sd(2 * pr * rc, pr + rc).alias("f1"), "brier",
                                    sd(c("_r") - m * (m + 1) / 2, m * n).alias("auc"))


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(c(p) * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(c(y).cast("double")).alias("y"))
    return g.agg((F.sum(c("n") * F.abs(c("p") - c("y"))) / F.sum("n")).alias("ece"), F.count(F.lit(1)).alias("bins"))


def top_precision(df: DataFrame, y: str, p: str, k: int, key: str = "company_id") -> DataFrame:
    """Hit rate among the k highest scores."""
    return df.orderBy(F.desc(p), key).limit(k).agg(F.avg(c(y).cast("double")).alias("precision_at_k"), F.count(F.lit(1)).alias("k"))


def coverage(df: DataFrame, truth: str, est: str, lo: str, hi: str) -> DataFrame:
    """Interval coverage, bias and mean width of effect estimates."""
    return df.agg(F.avg(flag((c(truth) >= c(lo)) & (c(truth) <= c(hi)))).alias("coverage"), F.avg(c(est) - c(truth)).alias("bias"), F.avg(c(hi) - c(lo)).alias("width"), F.count(F.lit(1)).alias("n"))


def compare_models(df: DataFrame, y: str, preds: list[str], by: list[str] | None = None) -> DataFrame:
    """Metrics of every prediction column [per group] after one unpivot, overall score .5 R2 + .3 (1-MAPE) + .2 Pearson and rank."""
    by = by or []
    v = df.select(*by, c(y).alias("_y"), *[c(x).cast("double").alias(x) for x in preds]).unpivot([*by, "_y"], preds, "model", "_p")
    m = regression_metrics(v, "_y", "_p", by=[*by, "model"])
    s = 0.5 * clip("r2", 0, 1) + 0.3 * (1 - clip("mape", 0, 1)) + 0.2 * clip("pearson", 0, 1)
    m = m.withColumn("score", s)
    # one row per group and model
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "model")))


def stability(by_group: DataFrame) -> DataFrame:
    """1 - CV of a model's score across groups."""
    return by_group.groupBy("model").agg(F.count(F.lit(1)).alias("groups"), (1 - sd(F.stddev_samp("score"), F.avg("score"))).alias("stability"))


# ---- folds --------------------------------------------------------------------------------

def hash_fold(key: list[str], k: int, seed: int = 42) -> Column:
    """Fold by key hash; rows of one key stay together (group folds)."""
    return F.pmod(F.xxhash64(*[c(x) for x in key], F.lit(seed)), F.lit(k)).cast("int")


def stratified_fold(df: DataFrame, key: str, stratum: str, k: int) -> DataFrame:
    """Folds that split every stratum evenly: position in hash order modulo k, by distributed ranks."""
    d = df.withColumn("_h", F.xxhash64(c(key)))
    r = value_ranks(d, [stratum], "_h").select(stratum, "_h", F.pmod(c("dense") - 1, F.lit(k)).cast("int").alias("fold"))
    return d.join(r, [stratum, "_h"]).drop("_h")


def time_folds(df: DataFrame, period: str, first: int, last: int) -> DataFrame:
    """Expanding windows: for every test period, all earlier rows train."""
    d = df.withColumn("fold", F.explode(F.sequence(F.lit(first), F.lit(last)))).where(c(period) <= c("fold"))
    return d.withColumn("part", F.when(c(period) < c("fold"), "train").otherwise("test"))


def nested_folds(df: DataFrame, key: str, outer: int, inner: int) -> DataFrame:
    return df.withColumn("outer_fold", hash_fold([key], outer, 1)).withColumn("inner_fold", hash_fold([key], inner, 2))


# ---- bias ------------------------------------------------------------------------------------

def bias_checks(panel: DataFrame, entities: DataFrame, recent_from: int, by: str = "nation", limit: float = 0.5) -> DataFrame:
    """One row per check: largest group share, recent-row share, survivors, size of the top decile, market HHI."""
    grp = entities.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    src = with_totals(grp, grp.agg(F.sum("n").alias("t"))).agg(F.max(c("n") / c("t")).alias("v")).withColumn("rule", F.lit("group_concentration"))
    rec = panel.agg(F.avg(flag(c("year") >= recent_from)).alias("v")).withColumn("rule", F.lit("recency"))
    sur = entities.agg(F.avg(flag(c("status") == "active")).alias("v")).withColumn("rule", F.lit("survivorship"))
    mk = entities.groupBy("market").agg(F.count(F.lit(1)).alias("n"))
    hhi = mk.agg((F.sum(c("n") * c("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("v")).withColumn("rule", F.lit("market_concentration"))
    size = panel.groupBy("company_id").agg(F.avg("revenue").alias("r")).agg((F.stddev_samp("r") / F.avg("r")).alias("v")).withColumn("rule", F.lit("size_dispersion"))
    out = src
    for x in (rec, sur, hhi, size):
        out = out.unionByName(x)
    return out.select("rule", c("v").alias("value"), (c("v") > limit).alias("biased"))


def track(history: DataFrame, run: DataFrame) -> DataFrame:
    """Append a run and return the best score per model."""
    u = history.unionByName(run)
    return u.groupBy("model").agg(F.max_by(F.struct("run_id", "score"), F.struct("score", "run_id")).alias("_b"), F.count(F.lit(1)).alias("runs")).select("model", "_b.*", "runs")
