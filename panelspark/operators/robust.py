"""Robust (sandwich) errors and tests of the proportional hazards model.

A subject's score residual needs two distributed running totals over durations: sums over the risk set (from the
latest duration back) and sums over the events so far.  Both run on one row per distinct duration and are range
partitioned, so durations may be continuous.  Residuals are Breslow's, so fits here use Breslow's ties.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finish
from ..functions.cols import total
from ..functions.ranks import running_totals
from ..session import reliable
from .survival import Cox, E, T, c, cox


def score_residuals(df: DataFrame, xs: list[str], beta: list[float], keep: list[str]) -> DataFrame:
    """``keep`` and a residual ``r_<x>`` for each covariate; rows without a covariate or a duration are left out.

    Event times x minus its risk set mean, less what the events up to the subject's own time expect of it.
    """
    d = df.select(*keep, c(T).cast("double").alias(T), c(E).cast("double").alias(E), *[c(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    d = d.dropna(subset=[T, E, *[f"_x{i}" for i in range(len(xs))]])
    means = d.agg(*[F.avg(f"_x{i}").alias(f"m{i}") for i in range(len(xs))]).first()
    d = d.select(*keep, T, E, *[(c(f"_x{i}") - float(means[i] or 0.0)).alias(f"_x{i}") for i in range(len(xs))])
    d = reliable(d.withColumn("_w", F.exp(total([c(f"_x{i}") * float(b) for i, b in enumerate(beta)]))))
    g = d.groupBy(T).agg(F.sum(E).alias("d"), F.sum("_w").alias("s"), *[F.sum(c("_w") * c(f"_x{i}")).alias(f"s{i}") for i in range(len(xs))])
    names = ["s", *[f"s{i}" for i in range(len(xs))]]
    risk = running_totals(g, [], T, names).select(T, "d", *[(c(f"tot_{n}") - c(f"cum_{n}") + c(n)).alias(n) for n in names])
    steps = risk.withColumn("a", c("d") / c("s")).withColumns({f"b{i}": c("d") * c(f"s{i}") / (c("s") * c("s")) for i in range(len(xs))})
    past = running_totals(steps, [], T, ["a", *[f"b{i}" for i in range(len(xs))]])
    j = d.join(past.select(T, "s", "cum_a", *[n for i in range(len(xs)) for n in (f"s{i}", f"cum_b{i}")]), T)
    return j.select(*keep, *[(c(E) * (c(f"_x{i}") - c(f"s{i}") / c("s")) - c("_w") * (c(f"_x{i}") * c("cum_a") - c(f"cum_b{i}"))).alias(f"r_{x}") for i, x in enumerate(xs)])


def _meat(res: DataFrame, xs: list[str], cluster: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the residuals, and of their products within clusters (rows, where no cluster is named)."""
    if cluster:
        res = res.groupBy(cluster).agg(*[F.sum(f"r_{x}").alias(f"r_{x}") for x in xs])
    k = len(xs)
    r = res.agg(*[F.sum(f"r_{x}").alias(f"u{i}") for i, x in enumerate(xs)],
                *[F.sum(c(f"r_{xs[i]}") * c(f"r_{xs[j]}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return np.array([r[f"u{i}"] for i in range(k)], float), np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)


def robust_cox(df: DataFrame, xs: list[str], cluster: str | None = None, fit: Cox | None = None) -> DataFrame:
    """Coefficients with model based and robust errors; rows of one cluster may depend on each other.

    ``fit`` is the model of the same rows and covariates with Breslow's ties, where there is one already.  With fewer clusters than covariates the robust errors are not of full rank and tests on them mean little.
    """
    fit = fit or cox(df.dropna(subset=[T, E]), xs, ties="breslow")
    keep = [cluster] if cluster else []
    _, meat = _meat(score_residuals(df, xs, [float(b) for b in fit.coef], keep), xs, cluster)
    cov = fit.cov @ meat @ fit.cov
    rows = []
    for i, x in enumerate(xs):
        b, se, rse = float(fit.coef[i]), math.sqrt(float(fit.cov[i, i])), math.sqrt(max(float(cov[i, i]), 0.0))
        z = b / rse if rse else None
        rows.append((x, b, se, rse, z, finish.norm_two_sided(z) if z is not None else None))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, robust_se double, z double, p double")


def robust_score_test(df: DataFrame, xs: list[str], cluster: str | None = None) -> dict:
    """Whether any covariate matters, from the score at zero and its robust variance; nothing is fitted."""
    u, meat = _meat(score_residuals(df, xs, [0.0] * len(xs), [cluster] if cluster else []), xs, cluster)
    chi2 = float(u @ np.linalg.pinv(meat) @ u)
    return {"chi2": chi2, "df": len(xs), "p": finish.chi2_tail(chi2, len(xs))}
