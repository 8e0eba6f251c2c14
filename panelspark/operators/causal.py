"""Difference-in-differences, instruments, propensity matching and effects.

Linear estimators solve k x k systems of one-pass moments.  Matching never
emits candidate pairs: units are placed on one score axis by distributed
running counts, and each treated unit looks at the few controls next to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finish
from ..functions.cols import sd, total, with_totals
from ..functions.ranks import exact_quantiles, long, running_totals
from ..functions.windows import W, whole
from ..session import reliable
from . import regression as rg

c = F.col


# ---- difference in differences ------------------------------------------------------

def did_prepare(panel: DataFrame, events: DataFrame) -> DataFrame:
    """treated, post, intensity and their interactions from (company_id, treat_year, intensity)."""
    d = panel.join(events.select("company_id", "treat_year", "intensity"), "company_id", "left")
    tr = c("treat_year").isNotNull()
    post = F.coalesce(c("year") >= c("treat_year"), F.lit(False))
    return d.select("*", tr.cast("double").alias("treated"), post.cast("double").alias("post"),
                    F.coalesce(c("intensity"), F.lit(0.0)).alias("dose")).withColumn("did", c("treated") * c("post")).withColumn(
        "did_dose", c("did") * c("dose"))


def did_2x2(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """Cell means and their double difference, optionally per group."""
    by = by or []
    cell = lambda t, p: F.avg(F.when((c("treated") == t) & (c("after") == p), c(y)))
    g = df.groupBy(*by).agg(cell(1, 1).alias("t1"), cell(1, 0).alias("t0"), cell(0, 1).alias("c1"), cell(0, 0).alias("c0"), F.count(y).alias("n"))
    return g.withColumn("effect", (c("t1") - c("t0")) - (c("c1") - c("c0")))


def did_twfe(df: DataFrame, y: str, controls: list[str] | None = None, periods: list[int] | None = None) -> rg.Fit:
    """Two-way fixed effects with entity-clustered errors."""
    return rg.fixed_effects(df, y, ["did", *(controls or [])], periods=periods)


def did_time_varying(df: DataFrame, y: str, start: int) -> DataFrame:
    """For each post period, rows before it and the period itself: 2x2 effect of treated x period."""
    last = df.agg(F.max("year").alias("_l"))
    d = with_totals(df.where(c(y).isNotNull()).select("treated", c(y).alias("_y"), "year"), last)
    periods = F.when(c("year") >= start, F.array("year")).otherwise(F.sequence(F.lit(start), c("_l")))
    d = d.select("treated", "_y", "year", F.explode(periods).alias("period"))
    d = d.withColumn("after", (c("year") == c("period")).cast("int"))
    return did_2x2(d.withColumnRenamed("_y", y), y, ["period"])


def did_staggered(df: DataFrame, y: str) -> DataFrame:
    """2x2 effect per treatment-year cohort against the never treated."""
    coh = df.where("treated = 1").select(c("treat_year").alias("cohort"), "treated", "year", y)
    cohorts = [r[0] for r in coh.select("cohort").distinct().orderBy("cohort").collect()]  # one per calendar year
    ctl = df.where("treated = 0").select(F.explode(F.array(*[F.lit(x) for x in cohorts])).alias("cohort"), "treated", "year", y)
    d = coh.unionByName(ctl).withColumn("after", (c("year") >= c("cohort")).cast("int"))
    return did_2x2(d, y, ["cohort"])


def event_study(df: DataFrame, y: str, lo: int, hi: int, periods: list[int]) -> DataFrame:
    """Leads and lags of treatment, base -1, two-way fixed effects; end points are binned."""
    rel = F.when(c("treated") == 1, F.least(F.greatest(c("year") - c("treat_year"), F.lit(lo)), F.lit(hi)))
    names = {k: f"rel_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(lo, hi + 1) if k != -1}
    d = df.withColumn("_rel", rel).withColumns({n: F.coalesce((c("_rel") == k).cast("double"), F.lit(0.0)) for k, n in names.items()})
    t = rg.fixed_effects(d, y, list(names.values()), periods=periods).table(df.sparkSession)
    return t.where(c("term").startswith("rel_"))


def parallel_trends(df: DataFrame, y: str) -> DataFrame:
    """Difference of pre-period slopes between treated and control."""
    d = df.where("post = 0 and treated in (0, 1)")
    g = d.agg(*[f(F.when(c("treated") == t, c(y)), F.when(c("treated") == t, c("year"))).alias(f"{n}{t}")
                for t in (0, 1) for n, f in (("slope", F.regr_slope), ("_sxx", F.regr_sxx), ("_syy", F.regr_syy), ("_sxy", F.regr_sxy), ("n", F.regr_count))])
    se2 = total([sd((c(f"_syy{t}") - c(f"slope{t}") * c(f"_sxy{t}")) / (c(f"n{t}") - 2), f"_sxx{t}") for t in (0, 1)])
    return g.select("slope0", "slope1", (c("slope1") - c("slope0")).alias("gap"), ((c("slope1") - c("slope0")) / F.sqrt(se2)).alias("t"), "n0", "n1")


def placebo(df: DataFrame, y: str, shift: int) -> DataFrame:
    """2x2 with treatment moved ``shift`` years earlier on pre-period rows."""
    d = df.where("post = 0")
    start = df.agg(F.min("treat_year").alias("_s"))
    d = with_totals(d, start).withColumn("after", (c("year") >= c("_s") - shift).cast("int"))
    return did_2x2(d, y)


def detect_treatments(df: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Years whose change lies more than k sample deviations from the entity's mean change."""
    d = df.select("company_id", "year", (c(value) / F.nullif(F.lag(value).over(W()), F.lit(0.0)) - 1.0).alias("change"))
    m, s = F.avg("change").over(whole()), F.stddev_samp("change").over(whole())
    d = d.select("*", m.alias("_m"), s.alias("_s")).where(F.abs(c("change") - c("_m")) > k * c("_s"))
    return d.select("company_id", "year", "change", F.when(c("change") > c("_m"), "increase").otherwise("decrease").alias("kind"))


def simplex_projection(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    cs = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    rho = np.nonzero(u > cs)[0][-1]
    return np.maximum(v - cs[rho], 0)


def synthetic_control(df: DataFrame, y: str, treated: str, unit: str, start: int, donors: list) -> tuple[dict, DataFrame]:
    """Donor weights on the simplex from the pre-period Gram matrix (donors x donors), and the gap series.

    Units are aggregates (markets, regions), so the donor list is short by definition.
    """
    wide = df.groupBy("year").agg(F.max(F.when(c(unit) == treated, c(y))).alias("_t"),
                                  *[F.max(F.when(c(unit) == u, c(y))).alias(f"_u{i}") for i, u in enumerate(donors)])
    k = len(donors)
    pre = wide.where(c("year") < start)
    r = pre.agg(*[F.sum(c(f"_u{i}") * c(f"_u{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
                *[F.sum(c(f"_u{i}") * c("_t")).alias(f"b{i}") for i in range(k)]).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([r[f"b{i}"] for i in range(k)])
    w, step = np.full(k, 1.0 / k), 1.0 / np.linalg.eigvalsh(g)[-1]
    for _ in range(20000):
        n = simplex_projection(w - step * (g @ w - b))
        if np.abs(n - w).max() < 1e-13:
            break
        w = n
    syn = total([c(f"_u{i}") * float(x) for i, x in enumerate(w)])
    return dict(zip(donors, map(float, w))), wide.select("year", c("_t").alias("actual"), syn.alias("synthetic"), (c("_t") - syn).alias("gap"))


# ---- instruments ---------------------------------------------------------------------

@dataclass
class IV:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    first_stage_f: float
    n: float

    def table(self, spark) -> DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        return spark.createDataFrame([(nm, float(b), float(s), float(b / s), float(finish.norm_two_sided(b / s)), float(self.first_stage_f))
                                      for nm, b, s in zip(self.names, self.coef, se)], "term string, coef double, se double, z double, p double, first_stage_f double")


def _cross(df: DataFrame, cols: list[Column]) -> tuple[np.ndarray, float]:
    k = len(cols)
    r = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], F.count(F.lit(1)).alias("n")).first()
    return np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float), float(r["n"])


def two_stage(df: DataFrame, y: str, endog: str, exog: list[str], instruments: list[str], gmm: bool = False):
    """2SLS with robust errors and the first-stage F of the instruments; ``gmm`` adds the efficient second step and J."""
    d = rg.complete(df, [y, endog, *exog, *instruments])
    xs, zs = [endog, "_one", *exog], ["_one", *exog, *instruments]
    d = d.withColumn("_one", F.lit(1.0))
    names = list(dict.fromkeys([*xs, *zs, y]))
    m, n = _cross(d, [c(x) for x in names])
    ix = {x: i for i, x in enumerate(names)}
    sub = lambda a, b: m[np.ix_([ix[q] for q in a], [ix[q] for q in b])]
    zz, zx, zy = sub(zs, zs), sub(zs, xs), sub(zs, [y])[:, 0]
    # condition the cross products before inverting
    w = np.linalg.pinv(zz)
    a = zx.T @ w @ zx
    beta = np.linalg.solve(a, zx.T @ w @ zy)
    res = c(y) - total([c(x) * float(b) for x, b in zip(xs, beta)])
    meat, _ = _cross(d.withColumn("_e", res), [c(z) * c("_e") for z in zs])
    ai = np.linalg.inv(a)
    cov = ai @ zx.T @ w @ meat @ w @ zx @ ai
    # first stage: restricted and full residual sums of squares of the endogenous regressor
    def rss(cols):
        s = sub(cols, cols)
        b = np.linalg.solve(s, sub(cols, [endog])[:, 0])
        return float(m[ix[endog], ix[endog]] - b @ sub(cols, [endog])[:, 0])

    full, part = rss(zs), rss(["_one", *exog])
    q = len(instruments)
    f = (part - full) / q / (full / (n - len(zs))) if full > 0 else math.inf
    fit = IV(["endogenous", "intercept", *exog], beta, cov, f, n)
    if not gmm:
        return fit
    s = meat / n
    wi = np.linalg.pinv(s)
    a2 = zx.T @ wi @ zx
    b2 = np.linalg.solve(a2, zx.T @ wi @ zy)
    g = (zy - zx @ b2) / n
    j = float(n * g @ wi @ g)
    return IV(fit.names, b2, np.linalg.inv(a2) * n, f, n), {"j": j, "df": float(len(zs) - len(xs)), "p": float(finish.chi2_tail(j, len(zs) - len(xs))) if len(zs) > len(xs) else 1.0}


def panel_iv(df: DataFrame, y: str, endog: str, exog: list[str], instruments: list[str], entity: str = "company_id") -> IV:
    cols = [y, endog, *exog, *instruments]
    return two_stage(rg.within(rg.complete(df, cols), cols, entity), y, endog, exog, instruments)


def endogeneity_test(df: DataFrame, y: str, endog: str, exog: list[str], instruments: list[str]) -> dict[str, float]:
    """Durbin-Wu-Hausman by the control-function residual's t statistic."""
    d = rg.complete(df, [y, endog, *exog, *instruments])
    first = rg.ols(d, endog, [*exog, *instruments])
    d = rg.residuals(d, endog, first, "_v")
    fit = rg.ols(d, y, [endog, *exog, "_v"])
    t = float(fit.coef[-1] / math.sqrt(fit.cov[-1, -1]))
    return {"t": t, "p": float(finish.t_two_sided(t, fit.dof)), "first_stage_r2": float(first.r2)}


def lag_instruments(df: DataFrame, x: str, by: tuple[str, ...] = ("market", "year")) -> DataFrame:
    """Lags 1 and 2 and the leave-one-out peer mean."""
    peers = df.groupBy(*by).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))
    d = df.join(peers, list(by))
    return d.select(*df.columns, F.lag(x, 1).over(W()).alias(f"{x}_lag1"), F.lag(x, 2).over(W()).alias(f"{x}_lag2"),
                    ((c("_s") - c(x)) / F.nullif(c("_n") - 1, F.lit(0))).alias(f"{x}_peers"))


# ---- propensity and matching -----------------------------------------------------------

def common_support(df: DataFrame, treat: str, score: str) -> DataFrame:
    """Rows inside the overlap of both groups' score ranges."""
    m = df.groupBy(treat).agg(F.min(score).alias("lo"), F.max(score).alias("hi")).agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    return with_totals(df, m).where((c(score) >= c("_lo")) & (c(score) <= c("_hi"))).drop("_lo", "_hi")


def match_nearest(df: DataFrame, treat: str, score: str, unit: str, caliper: float | None = None, k: int = 1) -> DataFrame:
    """k nearest controls with replacement: (treated, control, distance, rank).

    A running count gives every control its position on the score axis and every
    treated unit the number of controls below it; its candidates are the 2k
    positions around that number, joined by position.
    """
    d = df.where(c(score).isNotNull()).select(c(unit).alias("id"), c(score).alias("s"), (c(treat) == 1).alias("t"))
    d = d.withColumn("ord", F.struct("s", "id", "t")).withColumn("ctl", (~c("t")).cast("long"))
    r = running_totals(d, [], "ord", ["ctl"])
    ctl = r.where(~c("t")).select(c("id").alias("control"), c("s").alias("cs"), c("cum_ctl").alias("pos"))
    tr = r.where("t").select(c("id").alias("treated"), c("s").alias("ts"),
                             F.explode(F.sequence(c("cum_ctl") - (k - 1), c("cum_ctl") + k)).alias("pos"))
    j = tr.join(ctl, "pos").withColumn("distance", F.abs(c("ts") - c("cs")))
    j = j.where(c("distance") <= caliper) if caliper is not None else j
    w = Window.partitionBy("treated").orderBy("distance", "control")  # at most 2k rows per treated unit
    return j.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k).select("treated", "control", "distance", "rank")


def match_without_replacement(df: DataFrame, treat: str, score: str, unit: str, caliper: float | None = None) -> DataFrame:
    """Rounds of nearest match: a control keeps its closest treated unit, the others try the remaining controls.

    Each round matches at least the globally closest pair, so it ends; lineage is cut every round.
    """
    left = df.select(c(unit).alias("id"), c(score).alias("s"), (c(treat) == 1).cast("int").alias("t"))
    done = None
    while True:
        m = match_nearest(left, "t", "s", "id", caliper)
        m = m.groupBy("control").agg(F.min_by(F.struct("treated", "distance"), F.struct("distance", "treated")).alias("_b")).select("control", "_b.*")
        m = reliable(m)
        if m.isEmpty():
            break
        done = m if done is None else done.unionByName(m)
        used = m.select(c("control").alias("id")).unionByName(m.select(c("treated").alias("id")))
        left = reliable(left.join(used, "id", "left_anti"))
    if done is None:
        return df.sparkSession.createDataFrame([], "control long, treated long, distance double")
    return done


def kernel_match(df: DataFrame, treat: str, score: str, y: str, unit: str, h: float, order: int = 20) -> DataFrame:
    """Gaussian-kernel mean of all controls for every treated unit, without pairs.

    exp(-(u-v)^2/2) = exp(-u^2/2) sum_k He_k(u) v^k / k!  around the centre of a
    score bucket of width h/2, so controls enter only through bucket moments: at
    most 2 range / h + 1 buckets, each with a few sums.  |v| <= 1/4 makes the
    series exact to double precision.
    """
    width = h / 2.0
    d = df.where(c(score).isNotNull() & c(y).isNotNull())
    v = (c(score) - (F.floor(c(score) / width) + 0.5) * width) / h
    ctl = d.where(c(treat) == 0).withColumn("_b", F.floor(c(score) / width)).withColumn("_v", v)
    mom = ctl.groupBy("_b").agg(F.array(*[F.sum(F.pow("_v", F.lit(float(i))) / math.factorial(i)) for i in range(order)]).alias("m0"),
                                F.array(*[F.sum(F.pow("_v", F.lit(float(i))) / math.factorial(i) * c(y)) for i in range(order)]).alias("m1"))
    table = mom.agg(F.collect_list(F.struct(((c("_b") + 0.5) * width).alias("centre"), "m0", "m1")).alias("_t"))

    def evaluate(u: Column, m: Column) -> Column:
        init = F.struct(F.lit(1.0).alias("a"), u.alias("b"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))
        # Hermite recurrence He_(k+1) = u He_k - k He_(k-1)
        out = F.aggregate(m, init, lambda st, x: F.struct(
            st["b"].alias("a"), (u * st["b"] - (st["k"] + 1) * st["a"]).alias("b"), (st["s"] + x * st["a"]).alias("s"), (st["k"] + 1).alias("k")))
        return out["s"] * F.exp(-u * u / 2)

    t = with_totals(d.where(c(treat) == 1).select(c(unit).alias("treated"), c(score).alias("_s"), c(y).alias("_y")), table)
    e = t.select("treated", "_y", "_s", F.explode("_t").alias("_b")).select(
        "treated", "_y", ((c("_s") - c("_b.centre")) / h).alias("_u"), c("_b.m0").alias("m0"), c("_b.m1").alias("m1")).where(F.abs("_u") < 12)
    g = e.groupBy("treated", "_y").agg(F.sum(evaluate(c("_u"), c("m0"))).alias("weight"), F.sum(evaluate(c("_u"), c("m1"))).alias("_wy"))
    return g.select("treated", c("_y").alias("outcome"), (c("_wy") / F.nullif(c("weight"), F.lit(0.0))).alias("counterfactual"), "weight")


def stratify(df: DataFrame, treat: str, score: str, y: str, k: int = 5) -> DataFrame:
    """Treated-control difference inside exact quantile strata of the score."""
    q = exact_quantiles(df, [], score, {f"q{i}": i / k for i in range(1, k)}).drop("n")
    s = F.lit(1)
    for i in range(1, k):
        s = s + (c(score) > c(f"q{i}")).cast("int")
    g = with_totals(df, q).withColumn("stratum", s).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.sum((c(treat) == 1).cast("long")).alias("n_treated"),
        (F.avg(F.when(c(treat) == 1, c(y))) - F.avg(F.when(c(treat) == 0, c(y)))).alias("effect"))
    return g


def strata_effect(strata: DataFrame) -> DataFrame:
    ok = strata.where(c("effect").isNotNull())
    return ok.agg((F.sum(c("n") * c("effect")) / F.sum("n")).alias("effect"), F.sum("n").alias("n"))


def balance(df: DataFrame, treat: str, cols: list[str], weight: str | None = None) -> DataFrame:
    """Standardized mean difference per covariate."""
    w = c(weight) if weight else F.lit(1.0)
    keys = [treat] + ([weight] if weight else [])
    v = long(df, keys, cols).where(c("value").isNotNull())

    def mean(t: int) -> Column:
        on = c(treat) == t
        return F.sum(F.when(on, w * c("value"))) / F.sum(F.when(on, w))

    g = v.groupBy("metric").agg(mean(1).alias("mean_treated"), mean(0).alias("mean_control"),
                                F.var_samp(F.when(c(treat) == 1, c("value"))).alias("_v1"), F.var_samp(F.when(c(treat) == 0, c("value"))).alias("_v0"))
    return g.select("metric", "mean_treated", "mean_control",
                    sd(c("mean_treated") - c("mean_control"), F.sqrt((c("_v1") + c("_v0")) / 2.0)).alias("smd"))


def matched_effect(matches: DataFrame, outcomes: DataFrame, unit: str, y: str) -> DataFrame:
    """Mean treated-control difference, its t statistic and size."""
    o = outcomes.select(c(unit).alias("_id"), c(y).alias("_y"))
    m = matches.groupBy("treated", "control").agg(F.count(F.lit(1)).alias("_k"))
    j = m.join(o.withColumnRenamed("_y", "yc"), m.control == c("_id")).drop("_id").groupBy("treated").agg(F.avg("yc").alias("yc"))
    j = j.join(o.withColumnRenamed("_y", "yt"), j.treated == c("_id")).withColumn("diff", c("yt") - c("yc"))
    return j.agg(F.avg("diff").alias("att"), (F.avg("diff") / (F.stddev_samp("diff") / F.sqrt(F.count("diff").cast("double")))).alias("t"), F.count("diff").alias("n"))


def matched_differences(matches: DataFrame, outcomes: DataFrame, unit: str, y: str) -> DataFrame:
    """``treated`` and its outcome less the mean outcome of its matches; null where one of them has none."""
    o = outcomes.select(c(unit).alias("_id"), c(y).cast("double").alias("_y"))
    m = matches.select("treated", "control").distinct()
    j = m.join(o.withColumnRenamed("_y", "yc"), m.control == c("_id")).drop("_id").groupBy("treated").agg(F.avg("yc").alias("yc"))
    return j.join(o.withColumnRenamed("_y", "yt"), j.treated == c("_id")).select("treated", (c("yt") - c("yc")).alias("diff"))


def matched_interval(matches: DataFrame, outcomes: DataFrame, unit: str, y: str, by: list[str] | None = None, draws: int = 1000) -> DataFrame:
    """Effect on the treated, per group of theirs, with a bootstrap interval over treated units; matches stay as they are."""
    from .resampling import bootstrap_means

    d = matched_differences(matches, outcomes, unit, y)
    if by:
        d = d.join(outcomes.select(c(unit).alias("treated"), *by), "treated")
    return bootstrap_means(d, "treated", "diff", by, draws)


def balance_after(matches: DataFrame, df: DataFrame, treat: str, unit: str, cols: list[str]) -> DataFrame:
    """Standardized differences before and after matching: matched controls weigh as often as they serve, divided by
    the number of matches of the treated unit they serve.  Spreads are those before matching, so both are on one scale."""
    per = matches.select("treated", "control").distinct()
    share = per.join(per.groupBy("treated").agg(F.count(F.lit(1)).alias("_m")), "treated")
    w = share.groupBy(c("control").alias(unit)).agg(F.sum(1.0 / c("_m")).alias("_w")).unionByName(per.select(c("treated").alias(unit)).distinct().withColumn("_w", F.lit(1.0)))
    d = df.join(w, unit, "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    v = long(d, [treat, "_w"], cols).where(c("value").isNotNull())

    def mean(t: int, weight: Column) -> Column:
        on = F.when(c(treat) == t, weight)
        return F.sum(on * c("value")) / F.nullif(F.sum(on), F.lit(0.0))

    g = v.groupBy("metric").agg(mean(1, F.lit(1.0)).alias("t0"), mean(0, F.lit(1.0)).alias("c0"), mean(1, c("_w")).alias("t1"), mean(0, c("_w")).alias("c1"),
                                F.var_samp(F.when(c(treat) == 1, c("value"))).alias("_v1"), F.var_samp(F.when(c(treat) == 0, c("value"))).alias("_v0"))
    s = F.sqrt((c("_v1") + c("_v0")) / 2.0)
    return g.select("metric", sd(c("t0") - c("c0"), s).alias("smd_before"), sd(c("t1") - c("c1"), s).alias("smd_after"))


def sensitivity(df: DataFrame, treat: str, y: str, gammas: list[float]) -> DataFrame:
    """Mean difference reduced by the worst case (gamma - 1) / gamma x spread of the outcome; not robust
    once less than a tenth of the spread remains."""
    g = df.where(c(y).isNotNull()).agg((F.avg(F.when(c(treat) == 1, c(y))) - F.avg(F.when(c(treat) == 0, c(y)))).alias("base"), F.stddev_pop(y).alias("_s"))
    d = g.select("base", "_s", F.explode(F.array(*[F.lit(float(x)) for x in gammas])).alias("gamma"))
    eff = c("base") - (c("gamma") - 1) / c("gamma") * c("_s")
    return d.select("gamma", "base", eff.alias("effect"), (F.abs(eff) >= 0.1 * c("_s")).alias("robust"))


def interference(df: DataFrame, treat: str, by: str) -> DataFrame:
    """Spread of the treated share across groups (no-interference check)."""
    g = df.groupBy(by).agg(F.avg(c(treat).cast("double")).alias("share"))
    return g.agg(F.stddev_samp("share").alias("share_std"), F.min("share").alias("lo"), F.max("share").alias("hi"))


def t_learner(df: DataFrame, treat: str, y: str, xs: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Outcome forest per arm; the effect is the difference of predictions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    vec = VectorAssembler(inputCols=xs, outputCol="_f").transform(rg.complete(df, [y, *xs]))
    for arm in (1, 0):
        m = RandomForestRegressor(featuresCol="_f", labelCol=y, predictionCol=f"mu{arm}", numTrees=trees, maxDepth=depth, seed=seed)
        vec = m.fit(vec.where(c(treat) == arm)).transform(vec)
    return vec.withColumn("effect", c("mu1") - c("mu0")).drop("_f")
