"""Market structure, competition, positioning and entry.

Facts are reduced to (market, period[, entity]) before any window; rankings
inside a market use distributed ranks or bounded top-k aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from ..functions.cols import clip, flag, ladder, safe_corr, sd, total, with_totals
from ..functions.ranks import exact_quantiles, value_ranks, with_ranks
from ..functions.windows import W, growth, rows

c = F.col


def top_k(df: DataFrame, by: list[str], value: str, k: int, entity: str = "company_id") -> DataFrame:
    """The k largest rows per group, ties by entity.

    A first cut per (group, hash bucket) keeps k rows per bucket, so the final
    window sees at most buckets x k rows of even the hottest group.
    """
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("_b", F.pmod(F.xxhash64(entity), F.lit(buckets)))
    o = [F.desc(value), c(entity)]
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*o))).where(c("_r") <= k)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*o))).where(c("_r") <= k).drop("_r", "_b")


def entry_order(e: DataFrame, by: str = "market") -> DataFrame:
    """Dense rank of the establishment date, first movers (<= 3) and late entrants (mean + 1 sd)."""
    st = e.groupBy(by).agg(F.avg("start_year").alias("_m"), F.stddev_samp("start_year").alias("_s"))
    r = value_ranks(e, [by], "established").select(by, "established", c("dense").alias("entry_rank"))
    return e.join(r, [by, "established"]).join(st, by).select(
        *e.columns, "entry_rank", (c("entry_rank") <= 3).alias("first_mover"),
        (c("start_year") > c("_m") + c("_s")).alias("late_entrant"))


# ---- concentration -----------------------------------------------------------------

def concentration(df: DataFrame, by: list[str], value: str, k: int = 3, unit: float = 1.0) -> DataFrame:
    """HHI (shares in ``unit``: 1 or 100), CRk and participants per market [x year].

    HHI needs sum(x^2) and sum(x) only; CRk sums a bounded top-k.
    """
    g = df.groupBy(*by).agg(F.sum(value).alias("_t"), F.sum(c(value) * c(value)).alias("_s"), F.count(F.lit(1)).alias("participants"))
    top = top_k(df, by, value, k).groupBy(*by).agg(F.sum(value).alias("_k"))
    return g.join(top, by).select(*by, "participants", (c("_s") / F.nullif(c("_t") * c("_t"), F.lit(0.0)) * unit * unit).alias("hhi"),
                                  sd("_k", "_t").alias("cr"))


def concentration_class(hhi: Column, points: bool = True) -> Column:
    """1500 / 2500 points or .15 / .25 in unit shares."""
    f = 1.0 if points else 1e-4
    return ladder([(hhi > 2500 * f, "high"), (hhi > 1500 * f, "moderate")], "low")


def competition_structure(hhi: Column, barriers: Column, competition: Column) -> Column:
    return ladder([((hhi > 0.25) & (barriers > 0.7), "oligopoly_high_barriers"), (hhi > 0.25, "oligopoly_low_barriers"),
                   ((hhi > 0.15) & (competition > 0.7), "moderate_high_competition"), (hhi > 0.15, "moderate_low_competition"),
                   (competition > 0.8, "perfect_competition")], "fragmented")


def market_attributes(df: DataFrame, attributes: DataFrame, by: str = "market") -> DataFrame:
    """Attribute table joined on, with the derived intensities."""
    d = df.join(attributes, by, "left")
    tech, comp, bar, mat = c("tech_intensity"), c("competition_level"), c("entry_barriers"), c("maturity")
    speed = 1.0 / (c("cycle_years") + 1.0)
    rd = tech * (1 - mat) * comp
    defence = tech * bar * (1 - comp)
    return d.select("*", (comp * (1 - bar)).alias("competition_intensity"), (tech / (comp + 0.01)).alias("tech_competition"),
                    ((1 - bar) * comp).alias("price_pressure"), speed.alias("adaptation_speed"), (tech * speed).alias("innovation_pressure"),
                    rd.alias("rd_necessity"), ((1 - tech) * speed * comp).alias("obsolescence_risk"), defence.alias("innovation_defence"),
                    ((tech + rd + defence) / 3.0).alias("adaptation_score"))


def timing_fit(maturity: Column, order: Column, entrants: Column) -> Column:
    early = 1 - (order - 1) / F.greatest(entrants, F.lit(1))
    mid = 1 - F.abs(order - entrants * 0.3) / entrants
    return F.greatest(F.when(maturity < 0.3, early).when(maturity < 0.7, mid).otherwise(1 - (order - 1) / 3.0), F.lit(0.0))


def market_position(df: DataFrame, value: str = "revenue") -> DataFrame:
    """Rank in (market, year), ascending percentile, leader flag; entry order and industry position score."""
    r = with_ranks(df, ["market", "year"], value)
    first = df.groupBy("company_id", "market").agg(F.min("start_year").alias("_e"))
    eo = value_ranks(first, ["market"], "_e").select("market", c("_e").alias("start_year"), c("dense").alias("entry_order"))
    d = r.join(eo, ["market", "start_year"])
    rank, pct = c("n_distinct") - c("dense") + 1, c("avg_rank") / c("n")
    return d.select(*df.columns, rank.alias("sales_rank"), pct.alias("sales_percentile"), flag(rank <= 3).alias("leader"), "entry_order",
                    (pct * 0.4 + flag(c("entry_order") <= 3) * 0.3 + flag(rank <= 3) * 0.3).alias("position_score"))


def market_dynamics(df: DataFrame, value: str = "revenue", growth_col: str = "growth") -> DataFrame:
    """Per market-year: age, participants and their change, HHI change class, mean-growth stage."""
    g = df.groupBy("market", "year").agg(F.count(F.lit(1)).alias("participants"), F.sum(value).alias("_t"), F.sum(c(value) * c(value)).alias("_s"),
                                         F.avg(growth_col).alias("mean_growth"))
    w = Window.partitionBy("market").orderBy("year")  # one row per market-year
    hhi = c("_s") / F.nullif(c("_t") * c("_t"), F.lit(0.0))
    g = g.withColumn("hhi", hhi).withColumn("age", c("year") - F.min("year").over(Window.partitionBy("market")))
    g = g.withColumn("entry_rate", c("participants") / F.lag("participants").over(w) - 1).withColumn("hhi_change", c("hhi") / F.lag("hhi").over(w) - 1)
    mg = c("mean_growth")
    return g.select("market", "year", "participants", "hhi", "age", "entry_rate", "hhi_change", mg,
                    ladder([(c("hhi_change") > 0.05, "concentrating"), (c("hhi_change") < -0.05, "fragmenting")], "stable").alias("concentration_trend"),
                    ladder([(mg > 20, "introduction"), (mg > 10, "growth"), (mg > 2, "maturity")], "decline").alias("growth_stage"))


def in_period(df: DataFrame, periods: DataFrame, name: str = "in_shift", by: str = "market") -> DataFrame:
    """Flag rows whose year lies in one of the market's periods (small period table, equality on the market)."""
    p = periods.select(by, c("from_year").alias("_f"), c("to_year").alias("_t"))
    hit = df.select(by, "year").distinct().join(p, by).where(c("year").between(c("_f"), c("_t"))).select(by, "year").distinct().withColumn(name, F.lit(1))
    return df.join(hit, [by, "year"], "left").na.fill(0, [name])


# ---- positioning -------------------------------------------------------------------

def positioning(df: DataFrame) -> DataFrame:
    """Profitability .6 ROE + .4 margin, share and growth with the eight-way class (15 / 5 / 10)."""
    prof = c("roe") * 0.6 + c("margin") * 0.4
    s, g, p = c("share") > 15, F.coalesce(c("growth") > 5, F.lit(False)), prof > 10
    cls = ladder([(s & g & p, "star_leader"), (s & g, "star"), (s & p, "cash_cow_premium"), (s, "cash_cow"), (g & p, "question_mark_premium"),
                  (g, "question_mark"), (p, "niche_premium")], "dog")
    return df.select("*", prof.alias("profitability"), cls.alias("position"))


# fixed order of the positions
POSITION_LEVEL = {"star_leader": 8, "star": 7, "cash_cow_premium": 6, "question_mark_premium": 5, "cash_cow": 4, "question_mark": 3,
                  "niche_premium": 2, "dog": 1}


def position_evolution(df: DataFrame) -> DataFrame:
    """Changes against the previous row (denominator at least 1), movement and score."""
    w = W()
    lvl = ladder([(c("position") == k, v) for k, v in POSITION_LEVEL.items()], 0)
    d = df.withColumn("_l", lvl).withColumn("_pl", F.lag("_l").over(w)).withColumn("from_position", F.lag("position").over(w))
    pp, ps = F.lag("profitability").over(w), F.lag("share").over(w)
    d = d.withColumn("profit_change", (c("profitability") - pp) / F.greatest(F.abs(pp), F.lit(1.0)) * 100).withColumn(
        "share_change", (c("share") - ps) / F.greatest(F.abs(ps), F.lit(1.0)) * 100).where(c("from_position").isNotNull())
    mv = ladder([(c("_l") > c("_pl"), "upward"), (c("_l") < c("_pl"), "downward")], "stable")
    bonus = ladder([(c("_l") > c("_pl"), 10.0), (c("_l") < c("_pl"), -10.0)], 0.0)
    return d.select("company_id", "market", "year", "from_position", "position", "profit_change", "share_change", mv.alias("movement"),
                    (c("profit_change") * 0.4 + c("share_change") * 0.6 + bonus).alias("evolution_score"))


def position_stability(evolution: DataFrame) -> DataFrame:
    g = evolution.groupBy("company_id", "market").agg(F.stddev_samp("share_change").alias("share_vol"), F.stddev_samp("profit_change").alias("profit_vol"),
                                                      F.count(F.lit(1)).alias("changes"))
    g = g.withColumn("stability", F.greatest(100 - (c("share_vol") + c("profit_vol")) / 2, F.lit(0.0))).where(c("share_vol").isNotNull() & c("profit_vol").isNotNull())
    g = reliable(g)  # ranked and joined by value: both must read the same bits
    r = value_ranks(g, ["market"], "stability").select("market", "stability", (c("n") + 1 - c("avg_rank")).alias("stability_rank"))
    return g.join(r, ["market", "stability"])


# ---- intensity ----------------------------------------------------------------------

def market_years(df: DataFrame) -> DataFrame:
    """The yearly moments every intensity measure needs, in one aggregate."""
    return df.groupBy("market", "year").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("margin").alias("margin_var"), F.var_samp("roe").alias("roe_var"), F.sum(c("share") * c("share")).alias("hhi"),
        F.avg("cost_ratio").alias("cost"), F.avg("rd_ratio").alias("rd"), F.var_samp("rd_ratio").alias("rd_var"), F.avg("ad_ratio").alias("ad"),
        F.avg("margin").alias("margin"), F.avg("revenue").alias("revenue"), F.avg(sd("intangible_fixed_assets", "total_assets") * 100).alias("intangible"))


def intensity(my: DataFrame) -> DataFrame:
    s = (c("margin_var") * 0.3 + c("roe_var") * 0.2 + (100 - c("hhi")) * 0.2 + c("cost") * 0.1 + c("rd") * 0.1 + c("ad") * 0.1)
    d = my.where(c("n") >= 2).withColumn("intensity", s)
    return d.withColumn("level", ladder([(c("intensity") > 50, "very_high"), (c("intensity") > 30, "high"), (c("intensity") > 15, "moderate")], "low")).withColumn(
        "concentration", concentration_class(c("hhi")))


def price_innovation(my: DataFrame) -> DataFrame:
    """Price and innovation competition against exactly the year before."""
    w = Window.partitionBy("market").orderBy("year").rangeBetween(-1, -1)
    prev = lambda x: F.max(x).over(w)
    d = my.select("market", "year", (c("cost") - prev("cost")).alias("cost_increase"), (prev("margin") - c("margin")).alias("margin_decline"),
                  (prev("margin_var") - c("margin_var")).alias("margin_convergence"),
                  F.coalesce((c("rd") - prev("rd")) / F.greatest(prev("rd"), F.lit(0.1)), F.lit(0.0)).alias("rd_growth"), "rd", "rd_var", "intangible", "ad")
    return d.select("market", "year", "cost_increase", "margin_decline", "margin_convergence", (c("cost_increase") * 0.6 + c("margin_decline") * 0.4).alias("price_score"),
                    "rd_growth", (c("rd") * 0.4 + c("rd_var") * 0.2 + F.abs("rd_growth") * 0.1 + c("intangible") * 0.2 + c("ad") * 0.1).alias("innovation_score"))


def entry_exit(df: DataFrame, my: DataFrame, study_end: int) -> DataFrame:
    """Entrants, exits, active entities by cumulative sums, turbulence and barrier class per market-year."""
    span = df.groupBy("market", "company_id").agg(F.min("year").alias("_in"), F.max("year").alias("_out"))
    ins = span.groupBy("market", c("_in").alias("year")).agg(F.count(F.lit(1)).alias("entrants"))
    outs = span.where(c("_out") < study_end).groupBy("market", c("_out").alias("year")).agg(F.count(F.lit(1)).alias("exits"))
    g = my.select("market", "year", "hhi", "revenue", "rd").join(ins, ["market", "year"], "left").join(outs, ["market", "year"], "left").na.fill(0, ["entrants", "exits"])
    up = Window.partitionBy("market").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.least(c("revenue") / 1e7, F.lit(50.0)) * 0.5 + c("rd") * 0.3 + (5 - c("entrants")) * 2 * 0.2
    return g.select("market", "year", "entrants", "exits", (c("entrants") - c("exits")).alias("net_change"), F.sum(c("entrants") - c("exits")).over(up).alias("active"),
                    (c("entrants") + c("exits")).alias("turbulence"), "hhi", bar.alias("barrier_score"),
                    ladder([(bar > 60, "very_high"), (bar > 40, "high"), (bar > 20, "moderate")], "low").alias("barriers"))


def cycles(series: DataFrame, value: str = "intensity", k: int = 5) -> DataFrame:
    """Peaks and troughs of the k-row mean, mean gap, amplitude, phase of the last five, regularity per market."""
    w = Window.partitionBy("market").orderBy("year")
    m = F.when(F.count(value).over(w.rowsBetween(-k + 1, 0)) == k, F.avg(value).over(w.rowsBetween(-k + 1, 0)))
    d = series.select("market", "year", c(value).alias("v"), m.alias("_m"), F.row_number().over(Window.partitionBy("market").orderBy(F.desc("year"))).alias("_b"))
    d = d.withColumn("_s", F.coalesce("_m", F.first("_m", True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    d = d.withColumn("_p", F.lag("_s").over(w)).withColumn("_n", F.lead("_s").over(w))
    pk = F.when((c("_s") > c("_p")) & (c("_s") > c("_n")), c("year"))
    d = d.withColumn("_pk", pk).withColumn("_gap", c("_pk") - F.last("_pk", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = d.groupBy("market").agg(
        F.count("_pk").alias("peaks"), F.sum(((c("_s") < c("_p")) & (c("_s") < c("_n"))).cast("int")).alias("troughs"), F.avg("_gap").alias("_gm"),
        F.stddev_pop("_gap").alias("_gs"), F.count("_gap").alias("_gn"), F.stddev_pop("v").alias("amplitude"),
        F.regr_slope(F.when(c("_b") <= 5, c("v")), -c("_b")).alias("_sl"))
    cv = sd("_gs", "_gm")
    return g.select("market", "peaks", "troughs", F.coalesce("_gm", F.lit(0.0)).alias("mean_gap"), "amplitude",
                    ladder([(c("_sl") > 2, "intensifying"), (c("_sl") < -2, "cooling")], "stable").alias("phase"),
                    ladder([(c("_gn") < 2, "insufficient"), (cv < 0.2, "very_regular"), (cv < 0.4, "regular"), (cv < 0.6, "somewhat_irregular")], "irregular").alias("regularity"))


# ---- strategy -------------------------------------------------------------------------

def strategy_scores(df: DataFrame) -> DataFrame:
    """Cost, differentiation, focus and scale scores with the strategic type."""
    cost = (100 - c("cost_ratio")) * 0.7 + F.least(c("revenue") / 1e6, F.lit(100.0)) * 0.3
    diff = c("rd_ratio") * 0.4 + c("ad_ratio") * 0.3 + c("margin") * 0.3
    focus = 100.0 / F.greatest(c("segments_count"), F.lit(1.0)) * 0.6
    scale = F.least(c("revenue") / 1e7, F.lit(50.0)) + c("share")
    d = df.select("*", cost.alias("cost_score"), diff.alias("diff_score"), focus.alias("focus_score"), scale.alias("scale_score"))
    return d.withColumn("strategy", ladder([((c("cost_score") > 60) & (c("scale_score") > 60), "cost_leadership_scale"), (c("diff_score") > 60, "differentiation"),
                                            (c("focus_score") > 60, "focus"), (c("cost_score") > 40, "cost_leadership")], "stuck_in_middle"))


def strategic_groups(df: DataFrame, cols: list[str], k: int, seed: int = 42) -> DataFrame:
    """KMeans on standardized strategy scores; group per row. The scaler, the fit and the result read rows that are written once."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=cols, outputCol="_x").transform(reliable(df))
    v = StandardScaler(inputCol="_x", outputCol="_f", withMean=True).fit(v).transform(v)
    return KMeans(featuresCol="_f", predictionCol="group", k=k, seed=seed).fit(v).transform(v).drop("_x", "_f")


def group_competition(df: DataFrame, cols: list[str]) -> DataFrame:
    """Intra-group (n-1) x 10 / max(mean variance, 1), mean distance to the other group centres, performance.

    Group centres are k rows, so their pairing is tiny.
    """
    g = df.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in cols],
                                (total([F.coalesce(F.var_samp(x), F.lit(0.0)) for x in cols]) / len(cols)).alias("_v"),
                                (F.avg("roe") * 0.3 + F.avg("margin") * 0.3 + F.avg("growth") * 0.2 + F.avg("share") * 0.2).alias("performance"))
    o = g.select(c("group").alias("_g"), *[c(f"m_{x}").alias(f"_o_{x}") for x in cols])
    dist = F.sqrt(total([F.pow(c(f"m_{x}") - c(f"_o_{x}"), F.lit(2.0)) for x in cols]))
    p = g.join(F.broadcast(o), c("group") != c("_g")).groupBy("group").agg(F.avg(F.greatest(100 - 2 * dist, F.lit(0.0))).alias("inter_competition"))
    return g.join(p, "group").select("group", "n", ((c("n") - 1) * 10 / F.greatest(c("_v"), F.lit(1.0))).alias("intra_competition"),
                                     "inter_competition", "performance")


def mobility(df: DataFrame, label: str = "strategy") -> DataFrame:
    """Share of year-to-year changes of the strategic type."""
    d = df.withColumn("_p", F.lag(label).over(W()))
    g = d.groupBy("company_id").agg(F.count("_p").alias("_n"), F.sum((c("_p") != c(label)).cast("int")).alias("_k"))
    return g.where(c("_n") > 0).select("company_id", c("_n").alias("steps"), (c("_k") / c("_n")).alias("mobility"))


def responses(df: DataFrame, leaders: DataFrame, min_years: int = 3) -> DataFrame:
    """Correlation of R&D, capex and margin between market leaders and every rival.

    Pairing all companies of a market would square its size; focal companies are
    the given leaders (a bounded few per market), so pairs stay linear.
    """
    cols = ["rd_ratio", "capex_ratio", "margin"]
    f = df.join(leaders.select("company_id", "market"), ["company_id", "market"], "left_semi").select(
        "market", "year", c("company_id").alias("focal"), *[c(x).alias(f"f_{x}") for x in cols])
    r = df.select("market", "year", c("company_id").alias("rival"), *cols)
    j = r.join(f, ["market", "year"]).where(c("focal") != c("rival"))
    z = lambda x: F.coalesce(F.nanvl(safe_corr(x, f"f_{x}"), F.lit(0.0)), F.lit(0.0))
    g = j.groupBy("market", "focal", "rival").agg(F.count(F.lit(1)).alias("years"), z("rd_ratio").alias("rd_corr"), z("capex_ratio").alias("capex_corr"),
                                                  z("margin").alias("margin_corr")).where(c("years") >= min_years)
    s = (c("rd_corr") + c("capex_corr") + F.abs("margin_corr")) / 3
    return g.withColumn("strength", s).withColumn("relation", ladder([(F.abs("strength") > 0.7, "direct"), (F.abs("strength") > 0.4, "moderate"),
                                                                      (F.abs("strength") > 0.2, "weak")], "independent"))


def imitation(df: DataFrame, x: str = "rd_ratio") -> DataFrame:
    """Slope over years of the relative distance from the market-year mean; score max(0, -10 slope)."""
    m = df.groupBy("market", "year").agg(F.avg(x).alias("_m"))
    d = df.join(m, ["market", "year"]).withColumn("_d", F.abs(c(x) - c("_m")) / F.nullif(F.abs("_m"), F.lit(0.0)))
    g = d.groupBy("company_id").agg(F.count("_d").alias("n"), F.regr_slope("_d", "year").alias("slope")).where(c("n") >= 3)
    return g.withColumn("imitation", F.greatest(-10 * c("slope"), F.lit(0.0)))


def diffusion(df: DataFrame, x: str = "rd_ratio") -> DataFrame:
    """Share of adopters above the first year's median per market-year and its mean yearly gain."""
    first = df.groupBy("market").agg(F.min("year").alias("_y"))
    base = exact_quantiles(df.join(first, "market").where(c("year") == c("_y")), ["market"], x, {"_med": 0.5}).drop("n")
    g = df.join(base, "market").groupBy("market", "year").agg(F.avg(flag(c(x) > c("_med"))).alias("adopters"))
    w = Window.partitionBy("market").orderBy("year")
    return g.withColumn("_d", c("adopters") - F.lag("adopters").over(w)).groupBy("market").agg(F.avg("_d").alias("speed"), F.max("adopters").alias("peak"))


# fixed weights inside the seven dimensions are written out in the expressions
DIMENSIONS = ("innovation", "efficiency", "expansion", "financial", "human", "flexibility", "brand")


def strategy_dimensions(df: DataFrame) -> DataFrame:
    """Seven strategy dimensions as weighted ratios; missing values count zero."""
    med = exact_quantiles(df, [], "margin", {"_mm": 0.5}).drop("n")
    sal = df.agg(F.avg("average_salary").alias("_ms"))
    d = with_totals(with_totals(df, med), sal)
    m = c("margin") / 100
    dims = {
        "innovation": 0.4 * c("rd_ratio") / 100 + 0.3 * sd("intangible_fixed_assets", "revenue"),
        "efficiency": 0.3 * sd("revenue", "total_assets") + 0.3 * sd("revenue", "employees") + 0.2 * sd("revenue", "tangible_fixed_assets")
        + 0.2 * (1 - c("cost_ratio") / 100),
        "expansion": 0.35 * c("overseas_revenue_ratio") + 0.25 * c("segments_count") / 10 + 0.25 * c("growth") / 100
        + 0.15 * (1 - sd("sg_a_expenses", "revenue")),
        "financial": 0.35 * c("roe") / 100 + 0.25 * sd("shareholders_equity", "total_assets") + 0.25 * sd("current_assets", "current_liabilities")
        + 0.15 / (1 + sd("total_liabilities", "shareholders_equity")),
        "human": 0.3 * sd("average_salary", "_ms") + 0.3 * sd("revenue", "employees") + 0.2 / (1 + F.abs(growth("employees"))),
        "flexibility": 0.3 * sd("cash_and_deposits", "total_assets") + 0.3 * sd("capex", "depreciation") + 0.25 * c("segments_count") / 5
        + 0.15 * (1 - sd(c("sg_a_expenses") + c("depreciation"), "revenue")),
        "brand": 0.4 * sd(c("margin"), "_mm") + 0.25 * sd("intangible_fixed_assets", "revenue") + 0.2 * m + 0.15 * c("ad_ratio") / 100,
    }
    return d.select(*df.columns, *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in dims.items()])


def competitive_strength(df: DataFrame, dims: list[str], weights: dict[str, float]) -> DataFrame:
    """In-market percentile of every dimension (average ties), weighted strength and position class."""
    from ..functions.ranks import long

    v = with_ranks(long(df, ["company_id", "year", "market"], dims), ["market", "metric"], "value")
    g = v.groupBy("company_id", "year", "market").agg(
        total([F.sum(F.when(c("metric") == x, c("avg_rank") / c("n") * w)) for x, w in weights.items()]).alias("strength"))
    return g.withColumn("position", ladder([(c("strength") >= 0.8, "leader"), (c("strength") >= 0.6, "challenger"), (c("strength") >= 0.4, "follower")], "niche"))


def strategy_transitions(df: DataFrame, dims: list[str]) -> DataFrame:
    """Euclidean distance between consecutive strategy vectors and the dimension that moved most."""
    w = W()
    d = df.select("company_id", "year", *[(c(x) - F.lag(x).over(w)).alias(f"d_{x}") for x in dims]).where(c(f"d_{dims[0]}").isNotNull())
    dist = F.sqrt(total([c(f"d_{x}") * c(f"d_{x}") for x in dims]))
    big = F.greatest(*[F.abs(c(f"d_{x}")) for x in dims])
    main = ladder([(F.abs(c(f"d_{x}")) == big, F.concat(F.when(c(f"d_{x}") > 0, "increase_").otherwise("decrease_"), F.lit(x))) for x in dims], "none")
    return d.select("company_id", "year", dist.alias("distance"), main.alias("direction"))


# ---- ecosystem -------------------------------------------------------------------------

def ecosystem(df: DataFrame) -> DataFrame:
    """Per year: HHI, count, innovation, age diversity, margins, growth; health score and status."""
    tot = df.groupBy("year").agg(F.sum("revenue").alias("_t"))
    d = df.join(F.broadcast(tot), "year")  # one row per year
    age = (c("year") - c("start_year")).cast("double")
    g = d.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(c("revenue") / c("_t"), F.lit(2.0))).alias("hhi"), F.avg("rd_ratio").alias("innovation"),
                              F.stddev_pop(age).alias("age_std"), F.avg("margin").alias("margin_mean"), F.stddev_pop("margin").alias("margin_std"),
                              F.avg("growth").alias("growth_mean"), F.stddev_pop("growth").alias("growth_std"))
    health = (0.3 * clip(c("innovation") / 10, 0, 1) + 0.25 * (1 - clip(c("hhi"), 0, 1)) + 0.25 * clip(1 - c("margin_std") / 100, 0, 1)
              + 0.2 * clip(F.coalesce(c("growth_mean"), F.lit(0.0)) / 100 + 0.5, 0, 1))
    g = g.withColumn("health", health)
    return g.withColumn("status", ladder([(c("health") >= 0.8, "excellent"), (c("health") >= 0.6, "good"), (c("health") >= 0.4, "fair"), (c("health") >= 0.2, "poor")], "critical"))


# ---- entry ------------------------------------------------------------------------------

def _entry_sums() -> dict[str, Column]:
    """Aggregates over an entity's rows that profile and success share."""
    return {"n": F.count(F.lit(1)), "entry_year": F.min("year"), "last_year": F.max("year"), "entry_revenue": F.min_by("revenue", "year"),
            "_lr": F.max_by("revenue", "year"), "_py": F.min(F.when(c("margin") > 0, c("year")))}


def _profile_sums(k: int) -> dict[str, Column]:
    f = c("_i") <= k
    return _entry_sums() | {
        "entry_margin": F.min_by("margin", "year"), "entry_assets": F.min_by("total_assets", "year"), "capex": F.avg(F.when(f, c("capex_ratio"))),
        "rd": F.avg(F.when(f, c("rd_ratio"))), "ad": F.avg(F.when(f, c("ad_ratio"))), "status": F.max("status")}


def _success_sums(k: int) -> dict[str, Column]:
    y = F.when(c("_i") <= k, c("year"))
    return _entry_sums() | {"_z": F.max_by(F.when(c("_i") <= k, c("revenue")), y), "_m": F.count(y), "_years": F.collect_list(F.struct("year", "revenue"))}


def _entities(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    d = df.withColumn("_i", F.row_number().over(W()))
    return d.groupBy("company_id", "market").agg(*[v.alias(x) for x, v in sums.items()])


def entrants(df: DataFrame, k: int = 3, success_k: int = 10) -> DataFrame:
    """One row per entity with all that profile and success are made of, written once.

    Each further pass over the panel would shuffle all line items again. An entity's years fit its row, as a panel has
    one row per period; together they are smaller than the panel's rows.
    """
    return reliable(_entities(df, _profile_sums(k) | _success_sums(success_k)))


def entry_profile(df: DataFrame, k: int = 3, entities: DataFrame | None = None) -> DataFrame:
    """Per entity: entry metrics, first-k strategy ratios and type, CAGR, years to profit; from ``entities`` (of ``entrants``) if given."""
    g = _entities(df, _profile_sums(k)) if entities is None else entities
    cagr = F.when((c("entry_revenue") > 0) & (c("_lr") > 0), F.pow(c("_lr") / c("entry_revenue"), 1.0 / c("n")) - 1.0).otherwise(0.0)
    typ = ladder([((c("capex") > 15) & (c("rd") > 5), "aggressive_technology"), ((c("ad") > 3) & (c("capex") > 10), "aggressive_market"),
                  ((c("rd") > 8) | (c("ad") > 5), "niche")], "conservative")
    return g.select("company_id", "market", "n", "entry_year", "last_year", "entry_revenue", "entry_margin", "entry_assets", "capex", "rd", "ad", "status",
                    cagr.alias("cagr"), (c("_py") - c("entry_year")).alias("years_to_profit"), typ.alias("entry_type"))


def entry_success(df: DataFrame, min_n: int = 5, k: int = 10, entities: DataFrame | None = None) -> DataFrame:
    """.3 growth (first k rows) + .3 profitability + .25 in-year revenue percentile + .15 sustainability.

    Scores and ranks read the same written rows (``entities`` of ``entrants`` if given); why, see ``with_ranks``.
    """
    g = reliable(_entities(df, _success_sums(k))) if entities is None else entities
    pr = value_ranks(g.select(F.inline("_years")), ["year"], "revenue").select("year", "revenue", ((c("lt") + c("le") + 1) / (2.0 * c("n"))).alias("position"))
    g = g.where(c("n") >= min_n).select("company_id", "market", "n", "entry_year", c("last_year").alias("year"), c("_lr").alias("revenue"), "entry_revenue", "_z", "_m", "_py")
    g = g.join(pr, ["year", "revenue"])
    grow = clip(F.when((c("entry_revenue") > 0) & (c("_z") > 0), F.pow(c("_z") / c("entry_revenue"), 1.0 / c("_m")) - 1).otherwise(0.0), 0, 1)
    prof = F.when(c("_py").isNull(), 0.0).otherwise(F.greatest(1 - (c("_py") - c("entry_year")) / 10.0, F.lit(0.0)))
    sus = F.least(c("n") / 20.0, F.lit(1.0))
    return g.select("company_id", "market", "entry_year", "n", (0.3 * grow + 0.3 * prof + 0.25 * c("position") + 0.15 * sus).alias("success"))


def entry_timing_link(success: DataFrame) -> DataFrame:
    """Correlation of entry year and success and counts of early, mid and late entrants per market."""
    t = exact_quantiles(success.withColumn("entry_year", c("entry_year").cast("double")), ["market"], "entry_year", {"q1": 1 / 3, "q2": 2 / 3}).drop("n")
    d = success.join(t, "market")
    return d.groupBy("market").agg(safe_corr("entry_year", "success").alias("timing_corr"), F.sum((c("entry_year") <= c("q1")).cast("long")).alias("early"),
                                   F.sum(((c("entry_year") > c("q1")) & (c("entry_year") <= c("q2"))).cast("long")).alias("mid"),
                                   F.sum((c("entry_year") > c("q2")).cast("long")).alias("late"))


def entry_patterns(profile: DataFrame, success: DataFrame, hi: float = 0.7, lo: float = 0.4) -> DataFrame:
    """Success and failure groups by entry type: counts, means and the share profitable within 3 years."""
    j = profile.join(success.select("company_id", "success"), "company_id")
    grp = ladder([(c("success") > hi, "success"), (c("success") < lo, "failure")], "middle")
    return j.groupBy(grp.alias("outcome"), "entry_type").agg(F.count(F.lit(1)).alias("n"), F.avg("success").alias("success"), F.avg("cagr").alias("cagr"),
                                                             F.avg(flag(c("years_to_profit") <= 3)).alias("early_profit_share"))


def growth_phases(df: DataFrame) -> DataFrame:
    """Phase per market-year from the growth of the market total, with its entrants."""
    w = Window.partitionBy("market").orderBy("year")
    g = df.groupBy("market", "year").agg(F.sum("revenue").alias("size"), F.sum((c("year") == c("start_year")).cast("long")).alias("entrants"), F.stddev_samp("margin").alias("volatility"))
    gr = c("size") / F.lag("size").over(w) - 1
    return g.withColumn("market_growth", gr).withColumn("phase", ladder([(c("market_growth") > 0.15, "emergence"), (c("market_growth") > 0.05, "growth"),
                                                                         (c("market_growth") > -0.02, "maturity")], "decline"))


def saturation(df: DataFrame) -> DataFrame:
    """Quadratic fit of success-like margin on participants per market: peak of the parabola."""
    from .regression import ols_by

    g = df.groupBy("market", "year").agg(F.count(F.lit(1)).cast("double").alias("x"), F.avg("margin").alias("y")).withColumn("x2", c("x") * c("x"))
    t = ols_by(g, ["market"], "y", ["x", "x2"]).groupBy("market").agg(
        F.max(F.when(c("term") == "x", c("coef"))).alias("b1"), F.max(F.when(c("term") == "x2", c("coef"))).alias("b2"))
    return t.withColumn("optimal_competition", F.when(c("b2") < 0, -c("b1") / (2 * c("b2"))))


def innovation_metrics(df: DataFrame, k: int = 5) -> DataFrame:
    """Last-k means: pipeline, diversity, short and long impact, efficiency, risk-adjusted return."""
    d = df.withColumn("_b", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year")))).where(c("_b") <= k)
    g = d.groupBy("company_id").agg(F.avg("rd_ratio").alias("pipeline"), F.avg("segments_count").alias("diversity"), F.avg("growth").alias("short_impact"),
                                    F.avg("margin").alias("_m"), F.stddev_samp("margin").alias("_s"), F.avg(sd("intangible_fixed_assets", "total_assets")).alias("knowledge"))
    return g.select("company_id", "pipeline", "diversity", "short_impact", "knowledge", sd("_m", "pipeline").alias("efficiency"), sd("_m", "_s").alias("risk_adjusted"))


def entrant_impact(df: DataFrame, entries: DataFrame, k: int = 2) -> DataFrame:
    """Market means k years before and after a market's peak entry year."""
    p = entries.groupBy("market").agg(F.max_by("year", F.struct("entrants", -c("year"))).alias("_e"))
    m = df.groupBy("market", "year").agg(F.avg("margin").alias("margin"), F.avg("share").alias("share")).join(p, "market")
    pre = c("year").between(c("_e") - k, c("_e") - 1)
    post = c("year").between(c("_e") + 1, c("_e") + k)
    g = m.groupBy("market").agg(F.max("_e").alias("entry_year"), *[F.avg(F.when(cond, c(x))).alias(f"{x}_{n}") for x in ("margin", "share") for n, cond in (("before", pre), ("after", post))])
    return g.withColumn("margin_impact", c("margin_after") - c("margin_before"))
