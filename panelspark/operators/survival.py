"""Survival analysis on (duration, event) tables.

Durations are whole days, so after counting exits per distinct duration a group
has at most as many rows as the observation span has days; cumulative windows
run on that table, never on subjects.  Iterative fits keep the subjects
persisted and make one aggregate pass per step; only sums reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from ..functions import finish
from ..functions.cols import clip, flag, ladder, sd, total, with_totals
from ..functions.ranks import exact_quantiles, running_totals, value_ranks

c = F.col
T, E = "duration", "event"


# ---- tables ---------------------------------------------------------------------

def survival_table(panel: DataFrame, events: DataFrame, study_end: int, min_duration: int = 0) -> DataFrame:
    """Subject rows in years: first data year to the first extinction event or the last data year."""
    span = panel.groupBy("company_id").agg(F.min("year").alias("start"), F.max("year").alias("last"))
    ev = events.groupBy("company_id").agg(F.min(F.year("event_date")).alias("gone"))
    d = span.join(ev, "company_id", "left")
    end = F.coalesce("gone", F.least("last", F.lit(study_end)))
    d = d.select("company_id", "start", end.alias("end"), (end - c("start")).alias(T), c("gone").isNotNull().cast("int").alias(E))
    return d.where(c(T) >= min_duration)


def person_period(surv: DataFrame, panel: DataFrame, covariates: list[str]) -> DataFrame:
    """One row per subject-year at risk with that year's covariates; event in the last interval."""
    d = surv.select("company_id", "start", "end", E, F.explode(F.sequence("start", F.greatest("start", "end"))).alias("year"))
    d = d.withColumn("time_from_start", c("year") - c("start")).withColumn("event_occurred", (c("year") == c("end")).cast("int") * c(E))
    return d.join(panel.select("company_id", "year", *covariates), ["company_id", "year"], "left")


def recent_means(panel: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """Means of the last k rows per entity."""
    w = Window.partitionBy("company_id").orderBy(F.desc("year"))
    return panel.withColumn("_b", F.row_number().over(w)).where(c("_b") <= k).groupBy("company_id").agg(
        *[F.avg(x).alias(x) for x in cols])


# ---- product limit -----------------------------------------------------------------

def exits(df: DataFrame, by: list[str]) -> DataFrame:
    """Events, exits and the number at risk per group and distinct duration."""
    g = df.groupBy(*by, T).agg(F.sum(c(E).cast("long")).alias("d"), F.count(F.lit(1)).alias("x"))
    after = Window.partitionBy(*by).orderBy(T).rowsBetween(0, Window.unboundedFollowing)
    return g.withColumn("n", F.sum("x").over(after))


def kaplan_meier(df: DataFrame, by: list[str] | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Product-limit estimate with Greenwood variance and logit bounds.

    ln(0) is null, so S is forced to 0 from the first time everyone at risk has the event.
    """
    by = by or []
    up = Window.partitionBy(*by).orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    q = 1.0 - c("d") / c("n")
    g = exits(df, by).withColumn("_q", q)
    s = F.when(F.min("_q").over(up) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(c("_q") > 0, F.ln("_q"))).over(up)))
    gw = F.sum(F.when(c("n") > c("d"), c("d") / (c("n") * (c("n") - c("d"))))).over(up)
    g = g.select(*by, T, "d", "n", s.alias("s"), gw.alias("_gw"))
    var = c("s") * c("s") * c("_gw")
    inner = (c("s") > 0) & (c("s") < 1)
    lg, se = F.ln(c("s") / (1 - c("s"))), F.sqrt(var) / (c("s") * (1 - c("s")))
    return g.select(*by, T, "d", "n", "s", var.alias("variance"),
                    F.when(inner, 1 / (1 + F.exp(-(lg - z * se)))).otherwise(c("s")).alias("lower"),
                    F.when(inner, 1 / (1 + F.exp(-(lg + z * se)))).otherwise(c("s")).alias("upper"))


def median_survival(km: DataFrame, by: list[str]) -> DataFrame:
    """First time with S below one half (null when never reached)."""
    return km.groupBy(*by).agg(F.min(F.when(c("s") < 0.5, c(T))).alias("median"), F.min("s").alias("final_s"))


def survival_at(km: DataFrame, by: list[str], times: list[int]) -> DataFrame:
    """Right-continuous step lookup S(t): the last estimate at or before t (1 before the first)."""
    d = km.select(*by, T, "s", F.explode(F.array(*[F.lit(t) for t in times])).alias("t"))
    return d.groupBy(*by, "t").agg(F.coalesce(F.max_by("s", F.when(c(T) <= c("t"), c(T))), F.lit(1.0)).alias("s"))


def nelson_aalen(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    up = Window.partitionBy(*by).orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    return exits(df, by).select(*by, T, "d", "n", F.sum(c("d") / c("n")).over(up).alias("hazard"))


# ---- log-rank -------------------------------------------------------------------------

def _wide_counts(df: DataFrame, group: str, values: list) -> DataFrame:
    """Per distinct duration: d_i and n_i of every group."""
    g = df.groupBy(T).agg(*[F.sum(F.when(c(group) == v, c(E).cast("double")).otherwise(0.0)).alias(f"d{i}") for i, v in enumerate(values)],
                          *[F.sum((c(group) == v).cast("double")).alias(f"x{i}") for i, v in enumerate(values)])
    after = Window.orderBy(T).rowsBetween(0, Window.unboundedFollowing)  # one row per distinct day
    return g.select(T, *[f"d{i}" for i in range(len(values))],
                    *[F.sum(f"x{i}").over(after).alias(f"n{i}") for i in range(len(values))])


def logrank(df: DataFrame, group: str, values: list | None = None) -> dict[str, float]:
    """k-sample log-rank from the observed-minus-expected vector and its covariance."""
    values = values or [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    k = len(values)
    if k < 2:
        return {"chi2": 0.0, "df": 0.0, "p": 1.0}
    w = _wide_counts(df, group, values)
    d, n = total([c(f"d{i}") for i in range(k)]), total([c(f"n{i}") for i in range(k)])
    w = w.withColumn("_d", d).withColumn("_n", n).where(c("_d") > 0)
    f = F.when(c("_n") > 1, c("_d") * (c("_n") - c("_d")) / (c("_n") - 1)).otherwise(0.0)
    aggs = [F.sum(c(f"d{i}") - c("_d") * c(f"n{i}") / c("_n")).alias(f"u{i}") for i in range(k)]
    aggs += [F.sum(f * (c(f"n{i}") / c("_n")) * ((1.0 if i == j else 0.0) - c(f"n{j}") / c("_n"))).alias(f"v{i}_{j}")
             for i in range(k) for j in range(i, k)]
    r = w.agg(*aggs).first()
    u = np.array([r[f"u{i}"] for i in range(k - 1)])
    v = np.array([[r[f"v{min(i, j)}_{max(i, j)}"] for j in range(k - 1)] for i in range(k - 1)])
    chi = float(u @ np.linalg.pinv(v) @ u)
    return {"chi2": chi, "df": float(k - 1), "p": float(finish.chi2_tail(chi, k - 1))}


def logrank_pairs(df: DataFrame, group: str, values: list) -> DataFrame:
    """Two-sample log-rank for every pair of the given groups from one pass over the times."""
    if len(values) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, o_minus_e double, chi2 double")
    w = _wide_counts(df, group, values)
    ps = [F.struct(F.lit(str(values[i])).alias("a"), F.lit(str(values[j])).alias("b"), c(f"d{i}").alias("da"), c(f"d{j}").alias("db"),
                   c(f"n{i}").alias("na"), c(f"n{j}").alias("nb")) for i in range(len(values)) for j in range(i + 1, len(values))]
    x = w.select(F.explode(F.array(*ps)).alias("p")).select("p.*").withColumn("d", c("da") + c("db")).withColumn("n", c("na") + c("nb"))
    x = x.where(c("d") > 0)
    var = F.when(c("n") > 1, c("d") * (c("na") / c("n")) * (c("nb") / c("n")) * (c("n") - c("d")) / (c("n") - 1)).otherwise(0.0)
    g = x.groupBy("a", "b").agg(F.sum(c("da") - c("d") * c("na") / c("n")).alias("o_minus_e"), F.sum(var).alias("v"))
    return g.select("a", "b", "o_minus_e", sd(c("o_minus_e") * c("o_minus_e"), "v").alias("chi2"))


# ---- Cox ----------------------------------------------------------------------------------

@dataclass
class Cox:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    null_loglik: float
    n_events: float
    iterations: int
    gradient: np.ndarray
    converged: bool = True

    def table(self, spark) -> DataFrame:
        rows = []
        for i, nm in enumerate(self.names):
            b, s = float(self.coef[i]), math.sqrt(float(self.cov[i, i]))
            rows.append((nm, b, math.exp(b), s, b / s, finish.norm_two_sided(b / s), math.exp(b - 1.959963984540054 * s),
                         math.exp(b + 1.959963984540054 * s)))
        return spark.createDataFrame(rows, "term string, coef double, hr double, se double, z double, p double, lower double, upper double")

    @property
    def aic(self) -> float:
        return 2 * len(self.names) - 2 * self.loglik


def cox(df: DataFrame, xs: list[str], ties: str = "efron", penalty: float = 0.0, tol: float = 1e-9, max_iter: int = 30) -> Cox:
    """Newton's method; every step sums exp(xb), x exp(xb), xx' exp(xb) per duration (map-side combine),
    turns them into risk-set sums by a suffix window over distinct durations and reduces to one row.

    ``converged`` is false where ``max_iter`` steps were not enough."""
    k = len(xs)
    d = df
    for x in xs:
        d = d.where(c(x).isNotNull())
    st = d.agg(*[F.avg(x).alias(x) for x in xs]).first()
    d = d.select(T, c(E).cast("double").alias(E), *[(c(x) - float(st[x])).cast("double").alias(f"x{i}") for i, x in enumerate(xs)])
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    after = Window.orderBy(F.desc(T)).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct day

    def step(beta: np.ndarray):
        eta = total([c(f"x{i}") * float(b) for i, b in enumerate(beta)])
        e = d.withColumn("_w", F.exp(eta)).withColumn("_eta", eta)
        ew = c(E) * c("_w")
        g = e.groupBy(T).agg(
            F.sum(E).alias("d"), F.sum(c(E) * c("_eta")).alias("de"), F.sum("_w").alias("s0"), F.sum(ew).alias("e0"),
            *[a for i in range(k) for a in (F.sum(c("_w") * c(f"x{i}")).alias(f"s_{i}"), F.sum(ew * c(f"x{i}")).alias(f"e_{i}"),
                                            F.sum(c(E) * c(f"x{i}")).alias(f"dx_{i}"))],
            *[a for i, j in pairs for a in (F.sum(c("_w") * c(f"x{i}") * c(f"x{j}")).alias(f"s_{i}_{j}"),
                                            F.sum(ew * c(f"x{i}") * c(f"x{j}")).alias(f"e_{i}_{j}"))])
        cums = ["s0", *[f"s_{i}" for i in range(k)], *[f"s_{i}_{j}" for i, j in pairs]]
        g = g.select("d", "de", "e0", *[f"e_{i}" for i in range(k)], *[f"dx_{i}" for i in range(k)], *[f"e_{i}_{j}" for i, j in pairs],
                     *[F.sum(x).over(after).alias(x) for x in cums]).where(c("d") > 0)
        # Efron removes the fraction l/d of the tied events; Breslow removes none
        g = g.withColumn("_l", F.explode(F.sequence(F.lit(0), c("d").cast("int") - 1)))
        f = c("_l") / c("d") if ties == "efron" else F.lit(0.0)
        z = c("s0") - f * c("e0")
        m = [(c(f"s_{i}") - f * c(f"e_{i}")) / z for i in range(k)]
        aggs = [F.sum(c("de") / c("d") - F.ln(z)).alias("ll"), F.sum(F.lit(1.0)).alias("nd")]
        aggs += [F.sum(c(f"dx_{i}") / c("d") - m[i]).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum((c(f"s_{i}_{j}") - f * c(f"e_{i}_{j}")) / z - m[i] * m[j]).alias(f"h{i}_{j}") for i, j in pairs]
        r = g.agg(*aggs).first()
        grad = np.array([r[f"g{i}"] for i in range(k)]) - penalty * beta
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
        return r["ll"] - penalty * float(beta @ beta) / 2, grad, hess, r["nd"]

    beta = np.zeros(k)
    ll, grad, hess, nd = step(beta)
    null_ll, it, done = ll, 0, False
    for it in range(1, max_iter + 1):
        delta, scale = np.linalg.solve(hess, grad), 1.0
        while True:
            nxt = step(beta + scale * delta)
            if nxt[0] >= ll - 1e-10 or scale < 1e-4:
                break
            scale /= 2
        beta, done = beta + scale * delta, abs(nxt[0] - ll) < tol * (abs(ll) + 1)
        ll, grad, hess, nd = nxt
        if done:
            break
    d.unpersist()
    return Cox(xs, beta, np.linalg.inv(hess), ll, null_ll, nd, it, grad, bool(done))


def with_risk(df: DataFrame, fit: Cox, name: str = "risk") -> DataFrame:
    """Log partial hazard."""
    return df.withColumn(name, total([c(x) * float(b) for x, b in zip(fit.names, fit.coef)]))


def cox_baseline(df: DataFrame, fit: Cox) -> DataFrame:
    """Breslow cumulative baseline hazard per duration."""
    d = with_risk(df, fit).groupBy(T).agg(F.sum(c(E).cast("double")).alias("d"), F.sum(F.exp("risk")).alias("w"))
    down = Window.orderBy(F.desc(T)).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct day
    up = Window.orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_r", F.sum("w").over(down))
    return d.select(T, F.sum(c("d") / c("_r")).over(up).alias("hazard"))


def cox_survival(df: DataFrame, fit: Cox, base: DataFrame, t: int) -> DataFrame:
    """S(t | x) = exp(-H0(t) exp(xb)) for every row."""
    h = base.where(c(T) <= t).agg(F.coalesce(F.max("hazard"), F.lit(0.0)).alias("_h"))
    return with_totals(with_risk(df, fit), h).withColumn("survival", F.exp(-c("_h") * F.exp("risk"))).drop("_h")


def market_hazards(df: DataFrame, xs: list[str], by: str, values: list, alpha: float = 0.05, ratio: float = 1.5) -> DataFrame:
    """Cox per market; a factor matters when significant in two markets and the hazard ratios spread.

    A market without a finite estimate (no events, or too few rows) has nulls.
    """
    kind = "term string, coef double, hr double, se double, z double, p double, lower double, upper double"
    none = df.sparkSession.createDataFrame([(x, *[None] * 7) for x in xs], kind)
    hit = {r[0] for r in df.dropna(subset=xs).groupBy(by).agg(F.sum(E).alias("n")).where("n > 0").select(by).collect()}
    parts = none.where("false").withColumn(by, F.lit(None).cast(df.schema[by].dataType))
    for v in values:
        try:
            t = cox(df.where(c(by) == v), xs).table(df.sparkSession) if v in hit else none
        except (np.linalg.LinAlgError, ValueError, OverflowError):
            t = none
        parts = parts.unionByName(t.withColumn(by, F.lit(v)))
    g = parts.groupBy("term").agg(F.sum((c("p") < alpha).cast("int")).alias("significant_markets"), (F.max("hr") / F.min("hr")).alias("hr_ratio"))
    return parts.join(g.withColumn("differs", (c("significant_markets") >= 2) & (c("hr_ratio") > ratio)), "term")


# ---- discrimination and calibration -------------------------------------------------------------

def concordance(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Harrell's C without comparing pairs: event i before t_j, higher score for i is concordant.

    Scores first differ at one bit of their dense rank, so counting reduces to
    running totals over duration per (bit, higher bits); hot groups are range partitioned.
    """
    by = by or []
    d = df.where(c(score).isNotNull() & c(T).isNotNull()).select(*by, T, E, c(score).alias("_s"))
    d = reliable(d)
    r = value_ranks(d, by, "_s").select(*by, "_s", "dense", "n_distinct")
    d = d.groupBy(*by, T, "_s").agg(F.count(F.lit(1)).alias("w"), F.sum(c(E).cast("long")).alias("ev")).join(r, [*by, "_s"])
    lv = F.sequence(F.lit(0), F.ceil(F.log2(c("n_distinct") + 1.0)).cast("int"))
    e = d.withColumn("_b", F.explode(lv)).withColumn("_g", F.expr("shiftright(dense, _b + 1)")).withColumn("_one", F.expr("shiftright(dense, _b) & 1L"))
    one = c("_one") == 1
    z = F.lit(0).cast("long")
    e = e.groupBy(*by, "_b", "_g", T).agg(
        F.sum(F.when(one, c("ev")).otherwise(z)).alias("e1"), F.sum(F.when(~one, c("ev")).otherwise(z)).alias("e0"),
        F.sum(F.when(one, c("w")).otherwise(z)).alias("w1"), F.sum(F.when(~one, c("w")).otherwise(z)).alias("w0"))
    q = running_totals(e, [*by, "_b", "_g"], T, ["e1", "e0"])
    cnt = q.groupBy(*by).agg(F.sum(c("w0") * (c("cum_e1") - c("e1"))).cast("double").alias("concordant"),
                             F.sum(c("w1") * (c("cum_e0") - c("e0"))).cast("double").alias("discordant"))
    t = d.groupBy(*by, T).agg(F.sum("w").alias("w"), F.sum("ev").alias("ev"))
    up = Window.partitionBy(*by).orderBy(T).rowsBetween(Window.unboundedPreceding, -1)  # distinct days
    tot = t.withColumn("_c", F.coalesce(F.sum("ev").over(up), F.lit(0))).groupBy(*by).agg(F.sum(c("w") * c("_c")).cast("double").alias("comparable"))
    j = cnt.join(tot, by) if by else with_totals(cnt, tot)
    tied = c("comparable") - c("concordant") - c("discordant")
    return j.select(*by, "comparable", "concordant", "discordant", sd(c("concordant") + 0.5 * tied, "comparable").alias("c_index"))


def auc_at(df: DataFrame, score: str, times: list[int]) -> DataFrame:
    """Cumulative/dynamic AUC: event by t against alive after t, by rank sums per horizon."""
    d = df.select(T, E, c(score).alias("_s"), F.explode(F.array(*[F.lit(t) for t in times])).alias("t"))
    d = d.withColumn("_y", F.when((c(T) <= c("t")) & (c(E) == 1), 1).when(c(T) > c("t"), 0)).where(c("_y").isNotNull() & c("_s").isNotNull())
    d = reliable(d)
    r = value_ranks(d, ["t"], "_s").select("t", "_s", "avg_rank")
    g = d.join(r, ["t", "_s"]).groupBy("t").agg(F.sum(F.when(c("_y") == 1, c("avg_rank"))).alias("_r"), F.sum("_y").alias("cases"), F.count(F.lit(1)).alias("n"))
    m = c("cases").cast("double")
    return g.select("t", "cases", (c("n") - c("cases")).alias("controls"), sd(c("_r") - m * (m + 1) / 2, m * (c("n") - m)).alias("auc"))


def brier_at(df: DataFrame, survival: str, times: list[int]) -> DataFrame:
    """Mean squared error of S(t) against alive at t (censored counted as alive)."""
    d = df.select(T, E, c(survival).alias("_s"), F.explode(F.array(*[F.lit(t) for t in times])).alias("t"))
    alive = F.when((c(T) <= c("t")) & (c(E) == 1), 0.0).otherwise(1.0)
    return d.groupBy("t").agg(F.avg((c("_s") - alive) * (c("_s") - alive)).alias("brier"), F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, predicted: str, observed: str, bins: int = 5) -> DataFrame:
    """Mean prediction and observed rate per exact quantile bin."""
    q = exact_quantiles(df, [], predicted, {f"q{i}": i / bins for i in range(1, bins)}).drop("n")
    b = F.lit(1)
    for i in range(1, bins):
        b = b + (c(predicted) > c(f"q{i}")).cast("int")
    return with_totals(df, q).withColumn("bin", b).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("predicted"), F.avg(c(observed).cast("double")).alias("observed"))


# ---- weights and risk summaries --------------------------------------------------------------------

def poisson_weight(key: Column, b: Column) -> Column:
    """Poisson(1) draw from a hash of key and replicate; independent of partitioning."""
    u = (F.pmod(F.xxhash64(key, b), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # cumulative Poisson(1) probabilities
    cdf, p, k = [], math.exp(-1.0), 0
    tot = 0.0
    while tot < 1 - 1e-13:
        tot += p
        cdf.append(tot)
        k += 1
        p /= k
    return total([(u > q).cast("int") for q in cdf])


def bootstrap_mean(df: DataFrame, key: str, value: str, by: list[str] | None = None, draws: int = 200) -> DataFrame:
    """Bootstrap distribution of a (stratified) mean: weights by hash, one groupBy over replicates."""
    by = by or []
    d = df.where(c(value).isNotNull()).select(*by, key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b"))
    d = d.withColumn("w", poisson_weight(c(key), c("b")))
    m = d.groupBy(*by, "b").agg((F.sum(c("w") * c(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    # one row per group and replicate
    return m.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("se"), F.percentile("m", F.lit(0.025)).alias("lower"),
                              F.percentile("m", F.lit(0.975)).alias("upper"))


def future_extinctions(df: DataFrame, horizon: int, limit: float = 0.5) -> DataFrame:
    """1 - S for 1, 3, 5 years, else 1 - exp(ln(S1) year); kept above the limit."""
    d = df.select("company_id", "survival_1y", "survival_3y", "survival_5y", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("ahead"))
    p = (F.when(c("ahead") == 1, 1 - c("survival_1y")).when(c("ahead") == 3, 1 - c("survival_3y")).when(c("ahead") == 5, 1 - c("survival_5y"))
         .otherwise(1 - F.exp(F.ln("survival_1y") * c("ahead"))))
    return d.select("company_id", "ahead", p.alias("probability")).where(c("probability") > limit)


def risk_summary(df: DataFrame, by: str, risk: str, high: float = 0.5) -> DataFrame:
    q = exact_quantiles(df, [by], risk, {"median_risk": 0.5}).drop("n")
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(risk).alias("mean_risk"), F.avg(flag(c(risk) > high)).alias("high_share"))
    return g.join(q, by)


def curve_class(km: DataFrame, by: list[str], early: int, late: int) -> DataFrame:
    """Pattern of a survival curve from S at an early and a late time."""
    s = survival_at(km, by, [early, late])
    g = s.groupBy(*by).agg(F.max(F.when(c("t") == early, c("s"))).alias("s_early"), F.max(F.when(c("t") == late, c("s"))).alias("s_late"))
    return g.withColumn("pattern", ladder([(c("s_late") > 0.8, "stable"), (c("s_early") < 0.7, "early_decline"),
                                           (c("s_early") - c("s_late") > 0.3, "late_decline")], "gradual"))


# ---- model-based hazards and corrections ----------------------------------------------------------------

def hazard_model(pp: DataFrame, xs: list[str], kind: str = "forest", trees: int = 20, depth: int = 4, seed: int = 42):
    """Discrete-time hazard on person-period rows; S is the running product of 1 - h."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    d = reliable(pp.na.fill(0.0, xs))  # the fit makes several passes
    asm = VectorAssembler(inputCols=[*xs, "time_from_start"], outputCol="_f")
    kw = {"featuresCol": "_f", "labelCol": "event_occurred", "predictionCol": "_pred"}
    est = {"forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **kw),
           "boosting": lambda: GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, **kw),
           "logistic": lambda: LogisticRegression(maxIter=50, **kw)}[kind]()
    vec = asm.transform(d)
    model = est.setProbabilityCol("_p").setRawPredictionCol("_raw").fit(vec)
    from pyspark.ml.functions import vector_to_array

    out = model.transform(vec).withColumn("hazard", vector_to_array("_p")[1])
    up = Window.partitionBy("company_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("survival", F.exp(F.sum(F.log1p(-F.least(c("hazard"), F.lit(0.999999)))).over(up))).drop("_f", "_raw", "_p", "_pred"), model


def propensity(df: DataFrame, label: str, xs: list[str], kind: str = "logistic", name: str = "score", seed: int = 42) -> DataFrame:
    """Probability of the label from a classifier fitted on all rows."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vec = VectorAssembler(inputCols=xs, outputCol="_x").transform(reliable(df.na.fill(0.0, xs)))  # scaler, fit and result read it
    vec = StandardScaler(inputCol="_x", outputCol="_f", withMean=True).fit(vec).transform(vec)
    kw = {"featuresCol": "_f", "labelCol": label, "predictionCol": "_pred"}
    est = {"logistic": lambda: LogisticRegression(maxIter=100, tol=1e-10, **kw),
           "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **kw),
           "boosting": lambda: GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **kw)}[kind]()
    est = est.setProbabilityCol("_p").setRawPredictionCol("_raw")
    return est.fit(vec).transform(vec).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_f", "_p", "_raw", "_pred")


def inverse_mills(p: Column) -> Column:
    """phi(x)/p at the normal quantile x of p, by a rational approximation as a plain expression."""
    # fixed coefficients of the standard rational approximation of the normal quantile (tails use sqrt(-2 ln p))
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    t = F.sqrt(-2 * F.ln(F.least(q, 1 - q)))
    num = 2.515517 + t * (0.802853 + t * 0.010328)
    den = 1 + t * (1.432788 + t * (0.189269 + t * 0.001308))
    x = F.when(q < 0.5, -(t - num / den)).otherwise(t - num / den)
    return F.exp(-x * x / 2) / 2.5066282746310002 / q


def heckman(df: DataFrame, selected: str, z: list[str], y: str, xs: list[str]) -> DataFrame:
    """Two-step selection correction: logistic selection, Mills ratio, least squares on the selected."""
    from .regression import ols

    d = propensity(df, selected, z, name="_ps").withColumn("imr", inverse_mills(c("_ps")))
    return ols(d.where(c(selected) == 1), y, [*xs, "imr"]).table(df.sparkSession)


def ipw(df: DataFrame, selected: str, xs: list[str], kind: str = "forest") -> DataFrame:
    """Inverse probability weights of selected rows, normalized to mean one."""
    d = propensity(df, selected, xs, kind, "_ps").where(c(selected) == 1).withColumn("_w", 1.0 / F.least(F.greatest(c("_ps"), F.lit(0.01)), F.lit(0.99)))
    return with_totals(d, d.agg(F.avg("_w").alias("_mw"))).withColumn("weight", c("_w") / c("_mw")).drop("_w", "_mw", "_ps")


def screening(df: DataFrame, xs: list[str]) -> DataFrame:
    """Univariate Cox coefficient and p per feature."""
    t = None
    for x in xs:
        r = cox(df, [x]).table(df.sparkSession)
        t = r if t is None else t.unionByName(r)
    return t.orderBy("p")


def factor_importance(cox_table: DataFrame, ml: dict[str, float]) -> DataFrame:
    """.4 |coef| + .4 model importance + .2 significance, each scaled by its maximum."""
    spark = cox_table.sparkSession
    m = spark.createDataFrame([(k, float(v)) for k, v in ml.items()], "term string, importance double")
    j = cox_table.join(m, "term")
    mx = j.agg(F.max(F.abs("coef")).alias("_c"), F.max("importance").alias("_i"))
    s = 0.4 * F.abs("coef") / c("_c") + 0.4 * c("importance") / c("_i") + 0.2 * flag(c("p") < 0.05)
    return with_totals(j, mx).select("term", "coef", "p", "importance", s.alias("score")).orderBy(F.desc("score"))


def correction_effectiveness(df: DataFrame, original: str, corrected: str, alive: str) -> DataFrame:
    """25 points each: corrected values look normal, survivors and extinct differ, correlation with the
    original above .5, equal spread of both (Brown-Forsythe F below its 5% level)."""
    from .stats import levene, normality, t_test

    spark = df.sparkSession
    df = reliable(df.select(original, corrected, alive))  # every statistic reads it
    jb = normality(df, corrected).first()
    t = t_test(df, alive, corrected).first()
    r = df.agg(F.covar_pop(original, corrected).alias("c"), F.stddev_pop(original).alias("a"), F.stddev_pop(corrected).alias("b")).first()
    corr = r["c"] / (r["a"] * r["b"]) if r["a"] and r["b"] else 0.0
    both = df.select(F.lit("original").alias("g"), c(original).alias("v")).unionByName(df.select(F.lit("corrected").alias("g"), c(corrected).alias("v")))
    lv = levene(both, "g", "v")
    p_t = finish.t_two_sided(t["welch_t"], t["welch_df"])
    pts = [25.0 if ok else 0.0 for ok in (jb["p"] > 0.05, p_t < 0.05, corr > 0.5, lv["p"] > 0.05)]
    return spark.createDataFrame([(float(jb["p"]), float(p_t), float(corr), float(lv["p"]), sum(pts))], "normality_p double, t_p double, corr double, levene_p double, score double")
