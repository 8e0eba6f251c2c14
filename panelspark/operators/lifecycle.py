"""Lifecycle stages, runs, transitions, decline and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, ladder, mean_of, safe_corr, sd, total, with_totals
from ..functions.windows import W, growth, rows, runs, whole
from ..session import reliable

c = F.col

# fixed age ranges of the stages
STAGE_AGES = {"startup": (0, 5), "growth": (3, 15), "maturity": (10, 40), "decline": (30, 60), "transformation": (20, 50)}


def recent(df: DataFrame, k: int) -> DataFrame:
    """The last k rows of every entity, with the distance ``_b`` from the end (1 = latest)."""
    return df.withColumn("_b", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year")))).where(c("_b") <= k)


def stage_probabilities(df: DataFrame, ages: dict[str, tuple[float, float]] = STAGE_AGES, growth_col: str = "growth",
                        roa: str = "roa", rd: str = "rd", k: int = 3) -> DataFrame:
    """Gaussian density on the mid age inside each range, adjusted by recent growth, ROA and R&D, normalized."""
    g = recent(df, k).groupBy("company_id").agg(F.max(c("year") - c("start_year")).cast("double").alias("age"), F.avg(growth_col).alias("_g"),
                                                F.avg(roa).alias("_a"), F.avg(rd).alias("_r"))
    fast, slow = F.coalesce(c("_g") > 0.15, F.lit(False)), F.coalesce(c("_g") < -0.05, F.lit(False))
    hi_roa, lo_roa, hi_rd = c("_a") > 0.10, c("_a") < 0.02, c("_r") > 0.08

    def mult(cases: list[tuple[Column, float]]) -> Column:
        out = F.lit(1.0)
        for cond, f in cases:
            out = out * F.when(cond, f).otherwise(1.0)
        return out

    adj = {"startup": mult([(fast, 1.5), (slow, 0.3), (lo_roa, 1.2), (hi_rd, 1.3)]), "growth": mult([(fast, 1.3), (slow, 0.5)]),
           "maturity": mult([(hi_roa, 1.4)]), "decline": mult([(fast, 0.5), (slow, 2.0), (lo_roa, 1.3)]), "transformation": mult([(hi_rd, 1.4)])}
    dens = {}
    for s, (lo, hi) in ages.items():
        mid, sdv = (lo + hi) / 2, (hi - lo) / 4
        z = (c("age") - mid) / sdv
        dens[s] = F.when(c("age").between(lo, hi), F.exp(-z * z / 2) / (sdv * 2.5066282746310002)).otherwise(0.0) * adj.get(s, F.lit(1.0))
    g = g.select("company_id", "age", *[v.alias(f"_p_{s}") for s, v in dens.items()])
    tot = total([c(f"_p_{s}") for s in ages])
    return g.select("company_id", "age", *[F.when(tot > 0, c(f"_p_{s}") / tot).otherwise(0.0).alias(f"p_{s}") for s in ages])


def phase_rules(g: Column, margin: Column, stability: Column) -> Column:
    """startup / decline / maturity / growth by growth, margin and stability."""
    return ladder([(((g > 0.5) | (g < -0.2)) & (margin < 0.05) & (stability < 0.5), "startup"), ((g < -0.1) & (margin < 0.02), "decline"),
                   ((F.abs(g) < 0.15) & (margin > 0.08) & (stability > 0.7), "maturity")], "growth")


def smoothed_phase(df: DataFrame, growth_col: str, h: int = 1) -> DataFrame:
    """Phases from the centered mean of growth; maturity lies between growth and introduction."""
    s = F.avg(growth_col).over(W().rowsBetween(-h, h))
    d = df.withColumn("smoothed", s)
    x = c("smoothed")
    return d.withColumn("phase", ladder([(x.isNull(), "introduction"), (x > 0.15, "growth"), (x > 0.05, "maturity"), (x > -0.05, "introduction")], "decline"))


def stage_runs(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Start, end and length of every run of one stage."""
    d = runs(df, c(stage), name="run_id")
    return d.groupBy("company_id", "run_id").agg(F.first(stage).alias("stage"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                                                 F.count(F.lit(1)).alias("length"))


def transitions(df: DataFrame, stage: str = "stage", context: list[str] | None = None) -> DataFrame:
    """Rows where the stage differs from the previous row, with the changes of the context columns."""
    w = W()
    d = df.withColumn("from_stage", F.lag(stage).over(w)).withColumn("_y", F.lag("year").over(w))
    return d.select("company_id", "market", "year", "from_stage", c(stage).alias("to_stage"), (c("year") - c("_y")).alias("gap"),
                    *[(c(x) - F.lag(x).over(w)).alias(f"d_{x}") for x in (context or [])]).where(c("from_stage").isNotNull() & (c("from_stage") != c("to_stage")))


def transition_matrix(df: DataFrame, stage: str = "stage", by: list[str] | None = None, changes_only: bool = False) -> DataFrame:
    """Counts and row-normalized probabilities of consecutive stages."""
    by = by or []
    d = df.select("company_id", *by, c(stage).alias("to_stage"), F.lag(stage).over(W()).alias("from_stage")).where(c("from_stage").isNotNull())
    d = d.where(c("from_stage") != c("to_stage")) if changes_only else d
    g = d.groupBy(*by, "from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("p", c("n") / F.sum("n").over(Window.partitionBy(*by, "from_stage")))  # rows: stage x stage


def run_durations(rs: DataFrame) -> DataFrame:
    return rs.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.stddev_samp("length").alias("std"), F.max("length").alias("longest"))


def common_paths(df: DataFrame, lo: int = 3, hi: int = 5, min_count: int = 3, top: int = 10, stage: str = "stage") -> DataFrame:
    """Most frequent stage sequences of length lo..hi."""
    w = W()
    steps = [F.lead(stage, i).over(w).alias(f"s{i}") for i in range(hi)]
    d = df.select("company_id", *steps)
    paths = F.array(*[F.when(c(f"s{k - 1}").isNotNull(), F.concat_ws(">", *[c(f"s{i}") for i in range(k)])) for k in range(lo, hi + 1)])
    g = d.select(F.explode(paths).alias("path")).where(c("path").isNotNull()).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return g.where(c("n") >= min_count).orderBy(F.desc("n"), "path").limit(top)


def markov_forecast(current: DataFrame, matrix: DataFrame, horizon: int) -> DataFrame:
    """Stage distribution per step: current shares times the matrix, h joins of stage-sized tables."""
    m = matrix.select("from_stage", "to_stage", "p")
    d = current.groupBy(c("stage")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    d = d.withColumn("share", c("_n") / F.sum("_n").over(Window.partitionBy())).select(F.lit(0).alias("step"), "stage", "share")  # one row per stage
    out = d
    for h in range(1, horizon + 1):
        d = d.join(F.broadcast(m), c("stage") == c("from_stage")).groupBy(c("to_stage").alias("stage")).agg(  # stage x stage rows
            F.sum(c("share") * c("p")).alias("share")).select(F.lit(h).alias("step"), "stage", "share")
        out = out.unionByName(d)
    return out


def stage_survival(df: DataFrame, span: int = 5, stage: str = "stage") -> DataFrame:
    """Share of entities whose years in a stage span at least ``span``."""
    g = df.groupBy("company_id", stage).agg((F.max("year") - F.min("year")).alias("_s"))
    return g.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg(flag(c("_s") >= span)).alias("rate"))


def risky_transitions(tr: DataFrame, stats: DataFrame, top: int = 10) -> DataFrame:
    """Transitions into decline ranked by count x (100 - mean(margin + 100 - debt))."""
    j = tr.where("to_stage = 'decline'").join(stats.select("company_id", "year", "margin", "debt"), ["company_id", "year"])
    g = j.groupBy("from_stage").agg(F.count(F.lit(1)).alias("n"), F.avg(c("margin") + 100 - c("debt")).alias("_m"))
    return g.select("from_stage", "n", (c("n") * (100 - c("_m"))).alias("risk")).orderBy(F.desc("risk")).limit(top)


def recoveries(tr: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Moves out of decline: rate over entities ever in decline and factor statistics."""
    out = tr.where("from_stage = 'decline'").join(df.select("company_id", "year", *cols), ["company_id", "year"])
    ever = df.where("stage = 'decline'").agg(F.countDistinct("company_id").alias("declined"))
    g = out.agg(F.countDistinct("company_id").alias("recovered"), *[x for v in cols for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))])
    return with_totals(g, ever).withColumn("rate_pct", c("recovered") / c("declined") * 100)


def around_transition(df: DataFrame, tr: DataFrame, x: str, k: int = 2) -> DataFrame:
    """Mean of x in the k years before and after each transition, averaged per stage pair."""
    t = tr.select("company_id", c("year").alias("_y"), "from_stage", "to_stage")
    j = df.select("company_id", "year", x).join(t, "company_id").where(c("year").between(c("_y") - k, c("_y") + k))
    g = j.groupBy("company_id", "_y", "from_stage", "to_stage").agg(F.avg(F.when(c("year") < c("_y"), c(x))).alias("before"), F.avg(F.when(c("year") > c("_y"), c(x))).alias("after"))
    return g.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"), F.avg(c("after") - c("before")).alias("change"))


def stage_history(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Changes, mean and longest run, current run length and time share per stage."""
    r = stage_runs(df, stage)
    names = ("startup", "growth", "maturity", "decline")
    tot = F.sum("length")
    return r.groupBy("company_id").agg(
        (F.count(F.lit(1)) - 1).alias("changes"), F.avg("length").alias("mean_run"), F.max("length").alias("longest_run"), F.max_by("length", "run_id").alias("current_run"),
        F.max_by("stage", "run_id").alias("current_stage"), *[(F.sum(F.when(c("stage") == s, c("length")).otherwise(0)) / tot).alias(f"share_{s}") for s in names])


def maturity_indicators(df: DataFrame) -> DataFrame:
    """Revenue stability, payout, share, equity, diversification, R&D efficiency, margin slope and their mean."""
    d = recent(df.withColumn("_n", F.count(F.lit(1)).over(whole())), 5)
    l3 = lambda x: F.avg(F.when(c("_b") <= 3, x if isinstance(x, Column) else c(x)))
    g = d.groupBy("company_id").agg(
        F.max("_n").alias("_n"), (F.stddev_samp("revenue") / F.avg("revenue")).alias("_cv"), l3("dividend_payout_ratio").alias("_d"), l3(c("share") / 100).alias("_sh"),
        l3(sd("shareholders_equity", "total_assets")).alias("_eq"), l3("segments_count").alias("_sg"), l3(c("growth") / 100).alias("_g"), l3(c("rd_ratio") / 100).alias("_r"),
        F.regr_slope(c("margin") / 100, -c("_b")).alias("_sl"))
    full = c("_n") >= 5
    ind = {"revenue_stability": F.when(full, F.greatest(1 - c("_cv"), F.lit(0.0))), "payout": F.when(c("_d").isNotNull(), F.least(c("_d"), F.lit(1.0))), "share_strength": c("_sh"),
           "equity_stability": c("_eq"), "diversification": F.when(c("_sg").isNotNull(), F.greatest(1 - F.abs(c("_sg") - 3) / 3, F.lit(0.0))),
           "rd_efficiency": F.when(c("_g").isNotNull(), F.least(c("_g") / F.greatest(c("_r"), F.lit(0.001)), F.lit(10.0))), "advantage": F.when(full, F.greatest(c("_sl") + 0.5, F.lit(0.0)))}
    g = g.select("company_id", *[v.alias(k) for k, v in ind.items()])
    return g.withColumn("overall_maturity", mean_of([c(k) for k in ind]))


def stage_anomalies(df: DataFrame, stage: str = "stage", ages: dict[str, tuple[float, float]] = STAGE_AGES) -> DataFrame:
    """Too many changes, age outside the stage's range, growth volatility above .5, margin jump above 10 points."""
    w = W()
    age = c("year") - c("start_year")
    bad_age = F.lit(False)
    for s, (lo, hi) in ages.items():
        bad_age = bad_age | ((c(stage) == s) & ~age.between(lo, hi))
    d = df.withColumn("_chg", F.when(F.lag(stage).over(w).eqNullSafe(c(stage)), 0).otherwise(1)).withColumn("_bad", bad_age)
    d = d.withColumn("_dm", F.abs(c("margin") - F.lag("margin").over(w))).withColumn("_b", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year"))))
    g = d.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_chg").alias("_k"), F.max_by("_bad", "year").alias("age_mismatch"),
                                    F.stddev_samp(F.when(c("_b") <= 3, c("growth"))).alias("growth_volatility"), F.max(F.when(c("_b") == 1, c("_dm"))).alias("margin_jump"))
    rate = c("_k") / c("n")
    return g.select("company_id", "n", rate.alias("change_rate"), (c("_k") > c("n") * 0.3).alias("excessive_changes"), "age_mismatch", "growth_volatility",
                    F.coalesce(c("growth_volatility") > 50, F.lit(False)).alias("volatile_growth"), "margin_jump", F.coalesce(c("margin_jump") > 10, F.lit(False)).alias("dramatic_margin"))


def decline_periods(df: DataFrame, x: str, threshold: float = -0.2, recovery: float = 0.1, min_n: int = 5) -> DataFrame:
    """Peaks of the centered-3 mean whose later minimum falls below the threshold, and the recovery after it.

    One entity's series sits in one window partition (a row per period), held as
    an ordered array so that the suffix minimum and the first recovery are array
    expressions.
    """
    full = F.count(x).over(W().rowsBetween(-1, 1)) == 3
    d = df.where(c(x).isNotNull()).select("company_id", "year", F.when(full, F.avg(x).over(W().rowsBetween(-1, 1))).alias("s"), F.count(F.lit(1)).over(whole()).alias("_n"))
    d = d.where((c("_n") >= min_n) & c("s").isNotNull())
    w = W()
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    d = d.select("*", F.lag("s").over(w).alias("_p"), F.lead("s").over(w).alias("_nx"), F.min(F.struct("s", "year")).over(rest).alias("_m"),
                 F.collect_list(F.struct("year", "s")).over(rest).alias("_rest"))
    pk = d.where((c("s") > c("_p")) & (c("s") > c("_nx")))
    rate = F.when(c("s") > 0, (c("_m.s") - c("s")) / c("s")).otherwise(c("_m.s") - c("s"))
    pk = pk.withColumn("decline_rate", rate).where(c("decline_rate") <= threshold)
    post = F.filter("_rest", lambda r: r["year"] >= c("_m.year"))
    hit = F.filter(post, lambda r: r["s"] >= c("_m.s") * (1 + recovery))
    pk = pk.withColumn("_post", post).withColumn("_hit", F.when(F.size(post) >= 3, hit))
    ok = F.coalesce(F.size("_hit") > 0, F.lit(False))
    first = F.get("_hit", F.lit(0))
    after = F.filter("_post", lambda r: r["year"] >= first["year"])
    nb = F.size(F.filter(after, lambda r: r["s"] < first["s"]))
    mean = F.aggregate(after, F.lit(0.0), lambda a, r: a + r["s"]) / F.size(after)
    sdv = F.sqrt(F.aggregate(after, F.lit(0.0), lambda a, r: a + (r["s"] - mean) * (r["s"] - mean)) / F.size(after))
    sus = F.when(ok & (F.size(after) >= 3), (1 - nb / F.size(after) + F.greatest(1 - F.abs(sdv / first["s"]), F.lit(0.0))) / 2).otherwise(0.0)
    return pk.select("company_id", c("year").alias("peak_year"), c("_m.year").alias("trough_year"), (c("_m.year") - c("year")).alias("duration"), c("s").alias("peak"), c("_m.s").alias("trough"),
                     "decline_rate", ok.alias("recovered"), F.when(ok, first["year"] - c("_m.year")).alias("recovery_years"),
                     F.when(ok, (first["s"] - c("_m.s")) / F.nullif(c("_m.s"), F.lit(0.0))).alias("recovery_rate"), sus.alias("sustainability"))


def rejuvenation_factors(df: DataFrame, periods: DataFrame, cols: list[str]) -> DataFrame:
    """Change of every factor from the decline's start to two years after its end, success against failure:
    Mann-Whitney z, Cohen's d and point-biserial correlation."""
    from .stats import mann_whitney, t_test

    p = periods.select("company_id", "peak_year", "trough_year", "recovered")
    j = df.select("company_id", "year", *cols).join(p, "company_id").where(c("year").between(c("peak_year"), c("trough_year") + 2))
    g = j.groupBy("company_id", "peak_year").agg(F.max(c("recovered").cast("int")).alias("ok"), *[
        (F.max_by(x, "year") - F.min_by(x, "year")).alias(x) for x in cols])
    g = reliable(g)  # three statistics a factor read it
    out = None
    for x in cols:
        r = with_totals(mann_whitney(g, "ok", x).select("z"), t_test(g, "ok", x).select("cohen_d", c("n0").alias("failures"), c("n1").alias("successes")))
        r = with_totals(r, g.agg(safe_corr(c("ok").cast("double"), c(x)).alias("r"))).withColumn("factor", F.lit(x))
        out = r if out is None else out.unionByName(r)
    return out


def resilience(periods: DataFrame, entities: DataFrame) -> DataFrame:
    """Per market: recovery rate, duration, severity, sustainability, frequency per entity and score."""
    n = entities.groupBy("market").agg(F.count(F.lit(1)).alias("_e"))
    g = periods.join(entities.select("company_id", "market"), "company_id").groupBy("market").agg(
        F.count(F.lit(1)).alias("declines"), F.avg(flag(c("recovered"))).alias("rate"), F.avg("recovery_years").alias("_d"), F.avg(F.abs("decline_rate")).alias("severity"),
        F.avg(F.when(c("recovered"), c("sustainability"))).alias("_s")).join(n, "market")
    s = 0.4 * c("rate") + 0.3 / (1 + F.coalesce(c("_d"), F.lit(0.0)) / 5) + 0.3 * F.coalesce(c("_s"), F.lit(0.0))
    return g.select("market", "declines", "rate", c("_d").alias("recovery_years"), "severity", c("_s").alias("sustainability"), (c("declines") / c("_e")).alias("frequency"), s.alias("score"))


def market_maturity(latest: DataFrame, score: str = "overall_maturity") -> DataFrame:
    """High (>= .7), medium and low (< .4) maturity shares per market."""
    x = c(score)
    return latest.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.avg(flag(x >= 0.7)).alias("high"),
                                        F.avg(flag((x >= 0.4) & (x < 0.7))).alias("medium"), F.avg(flag(x < 0.4)).alias("low"))


def current_phase(df: DataFrame, k: int = 3) -> DataFrame:
    """Latest run with success and risk scores weighted by phase."""
    h = stage_history(df).select("company_id", "current_stage", "current_run")
    g = recent(df, k).groupBy("company_id").agg(F.avg("growth").alias("_g"), F.avg("margin").alias("_m"), F.stddev_samp("margin").alias("_s"), F.avg("debt").alias("_d"))
    j = h.join(g, "company_id")
    gr = F.coalesce(c("_g"), F.lit(0.0)) / 100
    # fixed factors by phase
    ok = ladder([(c("current_stage") == "startup", 0.9), (c("current_stage") == "growth", 1.1), (c("current_stage") == "maturity", 1.0)], 0.7)
    rk = ladder([(c("current_stage") == "startup", 1.3), (c("current_stage") == "growth", 1.0), (c("current_stage") == "maturity", 0.8)], 1.5)
    vol = F.coalesce(c("_s"), F.lit(0.0)) / 100
    succ = clip((clip(gr + 0.5, 0, 1) * 0.4 + clip(c("_m") / 20, 0, 1) * 0.4 + clip(1 - vol, 0, 1) * 0.2) * ok, 0, 1)
    risk = clip((clip(-gr, 0, 1) + clip(0.5 - c("_m") / 20, 0, 1) + clip(vol, 0, 1) + clip(c("_d") / 100, 0, 1)) / 4 * rk, 0, 1)
    return j.select("company_id", "current_stage", "current_run", succ.alias("success"), risk.alias("risk"))


def merge_phases(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Each rule run with the model run of the largest year overlap (equality on the entity)."""
    m = model.select("company_id", c("stage").alias("model_stage"), c("first_year").alias("_a"), c("last_year").alias("_z"))
    j = rule.join(m, "company_id").where((c("_a") <= c("last_year")) & (c("_z") >= c("first_year")))
    j = j.withColumn("_s", F.greatest("first_year", "_a")).withColumn("_e", F.least("last_year", "_z")).withColumn("overlap", c("_e") - c("_s") + 1)
    w = Window.partitionBy("company_id", "run_id").orderBy(F.desc("overlap"), "_a")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("company_id", "run_id", "stage", "model_stage", c("_s").alias("first_year"), c("_e").alias("last_year"), "overlap")


def kmeans_stages(df: DataFrame, cols: list[str], ks: tuple[int, ...] = (3, 4, 5), seed: int = 42) -> DataFrame:
    """KMeans with k by silhouette; clusters ordered by mean growth and named by position."""
    from .cluster import choose_k

    d, _ = choose_k(df, cols, ks, seed=seed)
    g = d.groupBy("cluster").agg(F.avg(cols[0]).alias("_g"))
    r = g.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.desc("_g")))).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))  # k rows
    nm = ladder([(c("_r") == 1, "growth"), (c("_r") == c("_k"), "decline")], "maturity")
    return d.join(F.broadcast(r.select("cluster", nm.alias("model_stage"))), "cluster")
