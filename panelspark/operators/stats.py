"""Correlation and hypothesis tests from grouped moments and exact distributed ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from ..functions import finish
from ..functions.cols import safe_corr, with_totals
from ..functions.ranks import exact_quantiles, ks_distance, long, running_min, running_totals, value_ranks, with_ranks
from ..functions.windows import W

c = F.col


# ---- correlation -------------------------------------------------------------------

def _pairs(xs: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(xs) for b in xs[i + 1:]]


def correlation(df: DataFrame, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Pairwise Pearson in one pass: (x, y, r, n), optionally per group."""
    by = by or []
    ps = _pairs(xs)
    aggs = []
    for a, b in ps:
        both = c(a).isNotNull() & c(b).isNotNull()
        aggs.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), safe_corr(a, b).alias("r"),
                             F.sum(both.cast("long")).alias("n")))
    g = df.groupBy(*by).agg(F.array(*aggs).alias("_p"))
    return g.select(*by, F.explode("_p").alias("_p")).select(*by, "_p.*")


def with_correlation_p(pairs: DataFrame) -> DataFrame:
    """Two-sided p-value of r by the t distribution, computed on the aggregated rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", p double"

    def add(batches):
        for b in batches:
            t = b["r"] * np.sqrt((b["n"] - 2).clip(lower=1) / (1 - b["r"] ** 2).clip(lower=1e-300))
            b["p"] = [finish.t_two_sided(x, n - 2) if n > 2 and x == x else None for x, n in zip(t, b["n"])]
            yield b

    return pairs.mapInPandas(add, schema)


def ranked(df: DataFrame, key: list[str], xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Average ranks of several columns, wide again; ``key`` identifies a row."""
    by = by or []
    v = with_ranks(long(df, [*key, *by], xs), [*by, "metric"], "value")
    return v.groupBy(*key, *by).agg(*[F.max(F.when(c("metric") == x, c("avg_rank"))).alias(x) for x in xs])


def spearman(df: DataFrame, key: list[str], xs: list[str], by: list[str] | None = None) -> DataFrame:
    return correlation(ranked(df, key, xs, by), xs, by)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exact tau-b without comparing pairs.

    Discordant pairs are inversions of y in x order.  Two y values first differ
    at one bit of their dense rank; grouping rows by (bit, higher bits) turns
    inversion counting into running totals, which are range partitioned.
    """
    d = df.where(c(x).isNotNull() & c(y).isNotNull()).select(c(x).alias("_x"), c(y).alias("_y"))
    d = d.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("w"))
    yr = value_ranks(df.where(c(x).isNotNull()), [], y).select(c(y).alias("_y"), "dense", "n_distinct")
    d = d.join(yr, "_y")
    levels = F.sequence(F.lit(0), F.ceil(F.log2(c("n_distinct") + 1.0)).cast("int"))
    e = d.withColumn("_b", F.explode(levels)).select(
        "_b", F.expr("shiftright(dense, _b + 1)").alias("_g"), "_x",
        F.expr("w * (shiftright(dense, _b) & 1L)").alias("one"),
        F.expr("w * (1L - (shiftright(dense, _b) & 1L))").alias("zero"))
    e = e.groupBy("_b", "_g", "_x").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    r = running_totals(e, ["_b", "_g"], "_x", ["one"])
    dis = r.agg(F.sum(c("zero") * (c("cum_one") - c("one"))).cast("double").alias("d"))

    def ties(k: list[str], name: str) -> DataFrame:
        g = d.groupBy(*k).agg(F.sum("w").alias("t"))
        return g.agg((F.sum(c("t") * (c("t") - 1)) / 2.0).alias(name), F.sum("t").alias(f"n_{name}"))

    s = with_totals(with_totals(with_totals(dis, ties(["_x"], "tx")), ties(["_y"], "ty")), ties(["_x", "_y"], "txy"))
    n = c("n_tx").cast("double")
    n0 = n * (n - 1) / 2.0
    con = n0 - c("tx") - c("ty") + c("txy") - c("d")
    return s.select(c("n_tx").alias("n"), c("d").alias("discordant"), con.alias("concordant"),
                    ((con - c("d")) / F.sqrt((n0 - c("tx")) * (n0 - c("ty")))).alias("tau"))


def correlation_array(df: DataFrame, xs: list[str]) -> np.ndarray:
    """k x k matrix on the driver for small-matrix finishers."""
    m = np.eye(len(xs))
    for r in correlation(df, xs).collect():
        i, j = xs.index(r["x"]), xs.index(r["y"])
        m[i, j] = m[j, i] = r["r"]
    return m


def partial_correlation(df: DataFrame, xs: list[str]) -> DataFrame:
    """Correlation of each pair given all the others, from the inverse matrix."""
    d = df
    for x in xs:
        d = d.where(c(x).isNotNull())
    p = np.linalg.pinv(correlation_array(d, xs))
    rows = [(a, b, float(-p[xs.index(a), xs.index(b)] / math.sqrt(p[xs.index(a), xs.index(a)] * p[xs.index(b), xs.index(b)])))
            for a, b in _pairs(xs)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, partial_r double")


def conditional_correlation(df: DataFrame, x: str, y: str, on: str, bands: int = 3) -> DataFrame:
    """corr(x, y) inside exact quantile bands of a conditioning column."""
    probs = {f"q{i}": i / bands for i in range(1, bands)}
    q = exact_quantiles(df, [], on, probs).drop("n")
    band = F.lit(1)
    for p in probs:
        band = band + (c(on) > c(p)).cast("int")
    return with_totals(df.where(c(on).isNotNull()), q).withColumn("band", band).groupBy("band").agg(
        safe_corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def correlation_network(df: DataFrame, xs: list[str], threshold: float) -> DataFrame:
    """Edges between columns with |r| at or above the threshold."""
    return correlation(df, xs).where(F.abs("r") >= threshold).withColumn("weight", F.abs("r"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information of equal-width bins from joint and marginal counts (bins x bins rows)."""
    st = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))

    def cut(v: str, lo: str, hi: str) -> Column:
        return F.least(F.floor((c(v) - c(lo)) / F.nullif(c(hi) - c(lo), F.lit(0.0)) * bins), F.lit(bins - 1))

    d = with_totals(df.where(c(x).isNotNull() & c(y).isNotNull()), st)
    j = d.groupBy(cut(x, "_x0", "_x1").alias("bx"), cut(y, "_y0", "_y1").alias("by_")).agg(
        F.count(F.lit(1)).cast("double").alias("nxy"))
    mx = j.groupBy("bx").agg(F.sum("nxy").alias("nx"))
    my = j.groupBy("by_").agg(F.sum("nxy").alias("ny"))
    j = with_totals(j.join(mx, "bx").join(my, "by_"), j.agg(F.sum("nxy").alias("n")))
    return j.agg(F.sum(c("nxy") / c("n") * F.ln(c("nxy") * c("n") / (c("nx") * c("ny")))).alias("mi"))


def survivor_correlation(df: DataFrame, x: str, y: str, alive: Column) -> DataFrame:
    return df.agg(safe_corr(x, y).alias("r_all"), safe_corr(F.when(alive, c(x)), F.when(alive, c(y))).alias("r_survivors"),
                  F.count(F.lit(1)).alias("n_all"), F.sum(alive.cast("long")).alias("n_survivors"))


# ---- group comparisons ---------------------------------------------------------------

def group_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(c(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def anova(df: DataFrame, group: str, value: str) -> dict[str, float]:
    """One-way and Welch ANOVA with eta squared; group rows are reduced in Spark, one row reaches the driver."""
    g = group_moments(df, [group], value).where((c("n") > 1) & (c("var") > 0)).withColumn("_w", c("n") / c("var"))
    tot = g.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).cast("double").alias("_k"), (F.sum(c("n") * c("mean")) / F.sum("n")).alias("_gm"),
                F.sum("_w").alias("_sw"), (F.sum(c("_w") * c("mean")) / F.sum("_w")).alias("_wm"))
    d, dw, q = c("mean") - c("_gm"), c("mean") - c("_wm"), 1 - c("_w") / c("_sw")
    r = with_totals(g, tot).agg(
        F.max("_n").alias("n"), F.max("_k").alias("k"), F.sum(c("n") * d * d).alias("ssb"), F.sum((c("n") - 1) * c("var")).alias("ssw"),
        F.sum(q * q / (c("n") - 1)).alias("lam"), F.sum(c("_w") * dw * dw).alias("num")).first()
    n, k, ssb, ssw, lam = r["n"], r["k"], r["ssb"], r["ssw"], r["lam"]
    f = ssb / (k - 1) / (ssw / (n - k))
    fw = r["num"] / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    dfw = (k * k - 1) / (3 * lam)
    return {"f": f, "p": finish.f_tail(f, k - 1, n - k), "eta2": ssb / (ssb + ssw), "welch_f": fw, "welch_df": dfw,
            "welch_p": finish.f_tail(fw, k - 1, dfw), "k": k, "n": n}


def kruskal(df: DataFrame, group: str, value: str) -> dict[str, float]:
    """Kruskal-Wallis H with tie correction and epsilon squared."""
    df = reliable(df)
    r = value_ranks(df, [], value)
    d = df.where(c(value).isNotNull()).join(r.select(value, "avg_rank"), value)
    g = d.groupBy(group).agg(F.sum("avg_rank").alias("s"), F.count(F.lit(1)).alias("n"))
    g = g.agg(F.sum(c("s") * c("s") / c("n")).alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ties = r.agg(F.sum(F.pow(c("cnt").cast("double"), F.lit(3.0)) - c("cnt")).alias("t"))
    x = with_totals(g, ties).first()
    n, k = float(x["n"]), float(x["k"])
    h = (12.0 / (n * (n + 1)) * x["q"] - 3 * (n + 1)) / (1 - x["t"] / (n**3 - n))
    return {"h": h, "p": finish.chi2_tail(h, k - 1), "epsilon2": h * (n + 1) / (n * n - 1), "n": n, "k": k}


def t_test(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Pooled and Welch t statistics and Cohen's d of two groups, one row."""
    m = lambda f: F.when(c(flag) == f, c(value))
    g = df.agg(*[a for i in (0, 1) for a in (F.count(m(i)).cast("double").alias(f"n{i}"), F.avg(m(i)).alias(f"m{i}"),
                                             F.var_samp(m(i)).alias(f"v{i}"))])
    n0, n1, d = c("n0"), c("n1"), c("m1") - c("m0")
    sp = ((n0 - 1) * c("v0") + (n1 - 1) * c("v1")) / (n0 + n1 - 2)
    a, b = c("v0") / n0, c("v1") / n1
    return g.select("n0", "n1", "m0", "m1", (d / F.sqrt(sp * (1 / n0 + 1 / n1))).alias("t"), (n0 + n1 - 2).alias("df"),
                    (d / F.sqrt(a + b)).alias("welch_t"),
                    ((a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))).alias("welch_df"),
                    (d / F.sqrt(sp)).alias("cohen_d"))


def with_t_p(df: DataFrame, t: str = "t", dof: str = "df", name: str = "p") -> DataFrame:
    """p-values on aggregated test rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {name} double"

    def add(batches):
        for b in batches:
            b[name] = [finish.t_two_sided(x, n) if x == x and n > 0 else None for x, n in zip(b[t], b[dof])]
            yield b

    return df.mapInPandas(add, schema)


def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """U of group 1 and its tie-corrected normal statistic."""
    d = df.where(c(value).isNotNull() & c(flag).isNotNull())
    d = reliable(d)
    r = value_ranks(d, [], value)
    t = r.agg(F.sum(F.pow(c("cnt").cast("double"), F.lit(3.0)) - c("cnt")).alias("ties"))
    s = d.join(r.select(value, "avg_rank"), value).agg(
        F.sum(F.when(c(flag) == 1, c("avg_rank"))).alias("s1"), F.sum((c(flag) == 1).cast("double")).alias("n1"),
        F.sum((c(flag) == 0).cast("double")).alias("n0"))
    s = with_totals(s, t)
    n0, n1 = c("n0"), c("n1")
    n = n0 + n1
    u = c("s1") - n1 * (n1 + 1) / 2.0
    sd_ = F.sqrt(n0 * n1 / 12.0 * ((n + 1) - c("ties") / (n * (n - 1))))
    return s.select("n0", "n1", u.alias("u"), ((u - n0 * n1 / 2.0) / sd_).alias("z"))


def levene(df: DataFrame, group: str, value: str) -> dict[str, float]:
    """ANOVA of absolute deviations from the group median."""
    med = exact_quantiles(df, [group], value, {"_med": 0.5}).drop("n")
    d = df.join(med, group).withColumn("_dev", F.abs(c(value) - c("_med")))
    return anova(d, group, "_dev")


def ks_test(df: DataFrame, flag: str, value: str) -> DataFrame:
    return ks_distance(df, [], value, c(flag) == 0, c(flag) == 1)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories: statistic, df and Cramer's V from cell counts."""
    cell = df.where(c(a).isNotNull() & c(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra, rb = cell.groupBy(a).agg(F.sum("o").alias("ra")), cell.groupBy(b).agg(F.sum("o").alias("rb"))
    tot = cell.agg(F.sum("o").alias("n"))
    shape = with_totals(ra.agg(F.count(F.lit(1)).alias("ka")), rb.agg(F.count(F.lit(1)).alias("kb")))
    # sum (o-e)^2/e = sum o^2/e - n, so empty cells need no rows
    j = with_totals(cell.join(ra, a).join(rb, b), tot)
    g = j.agg((F.sum(c("o") * c("o") * c("n") / (c("ra") * c("rb"))) - F.max("n")).alias("chi2"), F.max("n").alias("n"))
    g = with_totals(g, shape)
    k = F.least(c("ka"), c("kb")) - 1
    return g.select("chi2", ((c("ka") - 1) * (c("kb") - 1)).cast("double").alias("df"), "n",
                    F.sqrt(c("chi2") / (c("n") * F.nullif(k, F.lit(0)))).alias("cramers_v"))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0, values)


def normality(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Jarque-Bera from skewness and excess kurtosis."""
    by = by or []
    g = df.where(c(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    return g.withColumn("jb", c("n") / 6.0 * (c("skew") * c("skew") + c("kurt") * c("kurt") / 4.0)).withColumn(
        "p", F.exp(-c("jb") / 2.0))


def anderson(df: DataFrame, value: str) -> float:
    """Anderson-Darling A2 against the fitted normal from exact order statistics."""
    st = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    df = reliable(df)
    r = value_ranks(df, [], value)
    z = (c(value) - float(st["m"])) / float(st["s"])
    # normal cdf by the complementary error function series used in tasks on distinct values
    schema = "term double"

    def terms(batches):
        for b in batches:
            lo = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in b["z"]])
            hi = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in b["z"]])
            n, k, a = b["n"].to_numpy(float), b["cnt"].to_numpy(float), b["lt"].to_numpy(float)
            # sum over tied positions i = a+1 .. a+k of (2i-1) ln F + (2(n-i)+1) ln(1-F)
            s1 = k * (2 * a + k)
            yield pd.DataFrame({"term": s1 * np.log(np.maximum(lo, 1e-300)) + (2 * n * k - s1) * np.log(np.maximum(hi, 1e-300))})

    q = r.select(z.alias("z"), "cnt", "lt", "n").mapInPandas(terms, schema).agg(F.sum("term").alias("s")).first()
    n = r.agg(F.max("n").alias("n")).first()["n"]
    return -n - q["s"] / n


# ---- unit roots --------------------------------------------------------------------------

def dickey_fuller(df: DataFrame, value: str, entity: str = "company_id") -> DataFrame:
    """Lag regression dx = a + b x(-1) per series by sums; statistic t(b) and the 5% decision."""
    x = F.lag(value).over(W(entity))
    d = df.withColumn("_x", x).withColumn("_d", c(value) - c("_x")).where(c("_x").isNotNull() & c("_d").isNotNull())
    g = d.groupBy(entity).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.regr_slope("_d", "_x").alias("b"), F.regr_sxx("_d", "_x").alias("sxx"),
        F.regr_syy("_d", "_x").alias("syy"), F.regr_sxy("_d", "_x").alias("sxy"))
    rss = c("syy") - c("b") * c("sxy")
    g = g.where((c("n") > 2) & (c("sxx") > 0))
    t = c("b") / F.sqrt(F.nullif(F.greatest(rss, F.lit(0.0)) / (c("n") - 2) / c("sxx"), F.lit(0.0)))
    # fixed 5% critical value of the constant-only regression
    return g.select(entity, "n", "b", t.alias("adf")).withColumn("stationary", c("adf") < -2.86)


def kpss(df: DataFrame, value: str, entity: str = "company_id") -> DataFrame:
    """Level KPSS per series: sum of squared partial sums over n^2 times the variance (no lag terms)."""
    w = Window.partitionBy(entity)
    e = c(value) - F.avg(value).over(w)
    d = df.withColumn("_e", e).withColumn("_s", F.sum("_e").over(W(entity).rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(entity).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(c("_s") * c("_s")).alias("ss"),
                              F.sum(c("_e") * c("_e")).alias("ee"))
    stat = c("ss") / (c("n") * c("n")) / F.nullif(c("ee") / c("n"), F.lit(0.0))
    # fixed 5% critical value
    return g.select(entity, "n", stat.alias("kpss")).withColumn("stationary", c("kpss") < 0.463)


# ---- multiple testing -----------------------------------------------------------------------

def adjust_p(df: DataFrame, p: str = "p") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over a table of tests."""
    df = reliable(df)
    r = value_ranks(df, [], p)
    # BH is a suffix minimum of p n / rank over the distinct p values
    q = r.select(p, "n", (c(p) * c("n") / c("le")).alias("_raw"), (-c(p)).alias("_neg"))
    bh = running_min(q, [], "_neg", "_raw", "bh").withColumn("bh", F.least(c("bh"), F.lit(1.0)))
    return df.join(bh.select(p, "n", "bh"), p).withColumn(
        "bonferroni", F.least(c(p) * c("n"), F.lit(1.0)))
