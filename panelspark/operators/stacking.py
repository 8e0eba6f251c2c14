"""Extinction risk from four members (logistic, forest, boosting, hazards model), combined out of fold.

Rows fall into folds by a hash of their key.  Fold 0 is never trained on.  Each other fold is scored by members that
were fitted on the rest of them; those scores train the combining model, and members fitted on all of them score fold 0.
So every risk is of a row that its members have not seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, sd, total
from ..functions.ranks import exact_quantiles, value_ranks
from ..session import reliable
from .resampling import fold
from .survival import E, T, c, concordance, cox

MEMBERS = ("logistic", "forest", "boosting", "cox")


def percentile_features(df: DataFrame, key: str, by: str, xs: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with ``<x>_pct`` (share of the group's values at or below x, ties in the middle) and ``<x>_low`` (below a
    quarter), null for a null x; and the new names.  One pass for all columns; groups may be of any size."""
    df = reliable(df)
    long = df.select(key, by, *[c(x).cast("double").alias(x) for x in xs]).unpivot([key, by], xs, "metric", "value").where(c("value").isNotNull() & c(by).isNotNull())
    r = value_ranks(long, [by, "metric"], "value").select(by, "metric", "value", ((c("lt") + c("le") + 1) / (2.0 * c("n"))).alias("pct"))
    wide = long.join(r, [by, "metric", "value"]).groupBy(key).agg(*[F.max(F.when(c("metric") == x, c("pct"))).alias(f"{x}_pct") for x in xs])
    out = df.join(wide, key, "left").withColumns({f"{x}_low": F.when(c(f"{x}_pct").isNotNull(), flag(c(f"{x}_pct") < 0.25)) for x in xs})
    return out, [n for x in xs for n in (f"{x}_pct", f"{x}_low")]


def _filled(df: DataFrame, xs: list[str], train: Column) -> DataFrame:
    """Features centred and scaled by training rows; a null becomes their mean."""
    m = df.where(train).agg(*[f(x).alias(f"{p}_{x}") for x in xs for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({x: F.coalesce((c(x) - float(m[f"m_{x}"] or 0.0)) / float(m[f"s_{x}"] or 1.0), F.lit(0.0)) for x in xs})


def _together(spark, jobs: list) -> list:
    """Results of functions that each start Spark jobs, in order.  Fits are long rows of short jobs, which leave most
    cores idle one at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(len(jobs)) as pool:
        return [r.get() for r in [pool.apply_async(inheritable_thread_target(spark)(j)) for j in jobs]]


def fit_members(train: DataFrame, label: str, xs: list[str], trees: int, rounds: int, depth: int, seed: int):
    """A function that adds a score between 0 and 1 for each member.

    The hazards model's score is its chance of an exit by the mean duration of the training rows.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    asm = VectorAssembler(inputCols=xs, outputCol="_f")
    vec = asm.transform(train)
    kw = {"featuresCol": "_f", "labelCol": label, "predictionCol": "_pred"}
    models = {"logistic": LogisticRegression(maxIter=100, regParam=1e-4, **kw), "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **kw),
              "boosting": GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed, **kw)}
    fits = [lambda e=e: e.setProbabilityCol("_p").setRawPredictionCol("_raw").fit(vec) for e in models.values()]
    # a small penalty: percentiles and values of one measure go together
    *fitted, hazard = _together(train.sparkSession, [*fits, lambda: cox(train, xs, penalty=1.0)])
    models = dict(zip(models, fitted))
    risk = total([c(x) * float(b) for x, b in zip(xs, hazard.coef)])
    at = train.agg(F.avg(T)).first()[0]
    base = train.groupBy(T).agg(F.sum(c(E).cast("double")).alias("d"), F.sum(F.exp(risk)).alias("w"))
    from ..functions.ranks import running_totals

    steps = running_totals(base, [], T, ["w"]).where(c(T) <= at)
    h0 = steps.agg(F.coalesce(F.sum(c("d") / (c("tot_w") - c("cum_w") + c("w"))), F.lit(0.0))).first()[0]

    def scored(df: DataFrame) -> DataFrame:
        out = asm.transform(df)
        for n, m in models.items():
            out = m.transform(out).withColumn(n, vector_to_array("_p")[1]).drop("_p", "_raw", "_pred")
        return out.drop("_f").withColumn("cox", 1 - F.exp(-float(h0) * F.exp(clip(risk, -30, 30))))

    return scored


def _logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def stacked_risk(df: DataFrame, label: str, xs: list[str], key: str, folds: int = 5, trees: int = 100, rounds: int = 100, depth: int = 5,
                 weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), seed: int = 42) -> DataFrame:
    """Every row with the members' scores, ``average`` (by ``weights``), ``stacked`` and ``held_out`` (fold 0).

    ``df`` has the label (0 or 1), ``duration`` and ``event``.  Each fold's training rows need both labels.
    """
    if folds < 3:
        raise ValueError("three folds or more: one held out, two or more to stack on")
    d = df.where(c(label).isNotNull()).withColumns({"_y": c(label).cast("double"), "_fold": fold(key, folds, seed)})
    d = reliable(_filled(d, xs, c("_fold") > 0))

    def part(k: int) -> DataFrame:
        train = d.where(c("_fold") != k) if k == 0 else d.where((c("_fold") != k) & (c("_fold") > 0))
        return fit_members(train, "_y", xs, trees, rounds, depth, seed)(d.where(c("_fold") == k))

    out = reliable(reduce(DataFrame.unionByName, _together(df.sparkSession, [lambda k=k: part(k) for k in range(folds)])))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    asm = VectorAssembler(inputCols=[f"_{n}" for n in MEMBERS], outputCol="_f")
    vec = asm.transform(out.withColumns({f"_{n}": _logit(c(n)) for n in MEMBERS}))
    # members agree, so no one of them may count against the risk
    meta = LogisticRegression(featuresCol="_f", labelCol="_y", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", maxIter=200,
                              lowerBoundsOnCoefficients=_zeros(len(MEMBERS))).fit(vec.where(c("_fold") > 0))
    out = meta.transform(vec).withColumn("stacked", vector_to_array("_p")[1])
    mean = total([c(n) * w for n, w in zip(MEMBERS, weights)]) / sum(weights)
    return out.select(*df.columns, *MEMBERS, mean.alias("average"), "stacked", (c("_fold") == 0).alias("held_out"))


def _zeros(k: int):
    from pyspark.ml.linalg import Matrices

    return Matrices.dense(1, k, [0.0] * k)


def member_quality(scored: DataFrame, label: str, names: tuple[str, ...] = (*MEMBERS, "average", "stacked")) -> DataFrame:
    """Held-out AUC, C and Brier score of each member and of both combinations."""
    d = reliable(scored.where("held_out").select(T, E, c(label).cast("double").alias("_y"), *names))
    long = d.unpivot([T, E, "_y"], list(names), "member", "score").where(c("score").isNotNull())
    r = value_ranks(long, ["member"], "score").select("member", "score", "avg_rank")
    g = long.join(r, ["member", "score"]).groupBy("member").agg(
        F.sum(F.when(c("_y") == 1, c("avg_rank"))).alias("r"), F.sum("_y").alias("m"), F.count(F.lit(1)).cast("double").alias("n"), F.avg((c("score") - c("_y")) * (c("score") - c("_y"))).alias("brier"))
    auc = sd(c("r") - c("m") * (c("m") + 1) / 2, c("m") * (c("n") - c("m")))
    return g.select("member", auc.alias("auc"), "brier", c("n").cast("long").alias("n")).join(concordance(long, "score", ["member"]).select("member", "c_index"), "member")


def risk_by_group(scored: DataFrame, by: str, risk: str = "stacked", high: float = 0.5) -> DataFrame:
    """Mean, median and high-risk share of a group, its observed exits, and mean survival 1 - risk."""
    q = exact_quantiles(scored, [by], risk, {"median_risk": 0.5}).drop("n")
    g = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(risk).alias("mean_risk"), F.avg(flag(c(risk) > high)).alias("high_share"), F.sum(flag(c(risk) > high)).cast("long").alias("n_high"),
                               F.min(1 - c(risk)).alias("least_survival"), F.avg(c(E).cast("double")).alias("observed"))
    return g.join(q, by)
