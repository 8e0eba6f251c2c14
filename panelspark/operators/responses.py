"""Timing, intensity and followership of strategic responses.

Pairs are a market's leaders with every rival, so they grow with the rows; a pair has one row a year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ladder, safe_corr

c = F.col
MEASURES = ("rd_ratio", "capex_ratio", "margin")


def _smooth(value: Column, w) -> Column:
    """Centred mean of three rows, a null counting as zero; null at both ends."""
    v, near = F.coalesce(value, F.lit(0.0)), w.rowsBetween(-1, 1)
    return F.when(F.count(F.lit(1)).over(near) == 3, F.avg(v).over(near))


def _with_moves(df: DataFrame, names: dict[str, Column], w) -> DataFrame:
    """Adds a boolean for each name: the smoothed value moved by more than a fifth since the row before.

    Both ends take their neighbour's mean; series of fewer than three rows have no move.
    """
    d = df.withColumns({f"_m_{n}": _smooth(v, w) for n, v in names.items()})
    d = d.withColumns({f"_s_{n}": F.coalesce(f"_m_{n}", F.lead(f"_m_{n}").over(w), F.lag(f"_m_{n}").over(w)) for n in names})
    before = {n: F.lag(f"_s_{n}").over(w) for n in names}
    d = d.withColumns({n: F.coalesce(F.abs((c(f"_s_{n}") - b) / F.greatest(F.abs(b), F.lit(0.1))) > 0.2, F.lit(False)) for n, b in before.items()})
    return d.drop(*[f"_{p}_{n}" for n in names for p in "ms"])


def response_lags(df: DataFrame, leaders: DataFrame, min_years: int = 3, most: int = 3) -> DataFrame:
    """For each (focal, rival): correlations over common years, strength, and the lags of the rival's R&D moves behind the focal's.

    A lag is the years from a move of the focal to a later one of the rival, up to ``most``; all pairs of moves count.
    Without one the lags are 0.  ``relation`` is by strength, and by the mean lag where it is strong.
    """
    f = df.join(leaders.select("company_id", "market"), ["company_id", "market"], "left_semi").select("market", "year", c("company_id").alias("focal"), *[c(x).alias(f"f_{x}") for x in MEASURES])
    r = df.select("market", "year", c("company_id").alias("rival"), *MEASURES)
    w = Window.partitionBy("market", "focal", "rival").orderBy("year")  # one row a year
    j = _with_moves(r.join(f, ["market", "year"]).where(c("focal") != c("rival")), {"mine": c("f_rd_ratio"), "theirs": c("rd_ratio")}, w)
    z = lambda x: F.coalesce(F.nanvl(safe_corr(x, f"f_{x}"), F.lit(0.0)), F.lit(0.0))
    g = j.groupBy("market", "focal", "rival").agg(F.count(F.lit(1)).alias("years"), z("rd_ratio").alias("rd_corr"), z("capex_ratio").alias("capex_corr"), z("margin").alias("margin_corr"),
                                                  F.collect_list(F.when(c("mine"), c("year"))).alias("_a"), F.collect_list(F.when(c("theirs"), c("year"))).alias("_b"))
    lags = F.flatten(F.transform("_a", lambda a: F.transform(F.filter("_b", lambda b: (b > a) & (b <= a + most)), lambda b: b - a)))
    g = g.where(c("years") >= min_years).withColumn("_l", lags).withColumn("n_lags", F.size("_l").cast("long"))
    none = c("n_lags") == 0
    g = g.withColumns({"avg_lag": F.when(none, 0.0).otherwise(F.aggregate("_l", F.lit(0.0), lambda s, x: s + x) / F.greatest(c("n_lags"), F.lit(1))),
                       "min_lag": F.when(none, 0).otherwise(F.array_min("_l")), "max_lag": F.when(none, 0).otherwise(F.array_max("_l")),
                       "strength": (c("rd_corr") + c("capex_corr") + F.abs("margin_corr")) / 3})
    s = F.abs("strength")
    return g.drop("_a", "_b", "_l").withColumn("relation", ladder([((s > 0.7) & (c("avg_lag") <= 1), "simultaneous"), (s > 0.7, "follower_leader"), (s > 0.4, "moderate"), (s > 0.2, "weak")], "independent"))


def response_timing(lags: DataFrame) -> DataFrame:
    """Per focal company: mean lag and strength, their pattern, and the share (in percent) of strong and quick responses."""
    quick = ((c("strength") > 0.5) & (c("avg_lag") <= 1)).cast("double")
    g = lags.groupBy("market", "focal").agg(F.avg("avg_lag").alias("avg_lag"), F.avg("strength").alias("strength"), (F.avg(quick) * 100).alias("aggressiveness"), F.count(F.lit(1)).alias("rivals"))
    soon = c("avg_lag") < 1
    return g.withColumn("pattern", ladder([((c("strength") > 0.6) & soon, "fast_responder"), (c("strength") > 0.6, "strong_follower"), ((c("strength") > 0.3) & soon, "quick_adapter"),
                                           (c("strength") > 0.3, "moderate_follower")], "independent"))


def response_intensity(lags: DataFrame) -> DataFrame:
    """Per focal company: mean size of each correlation, of all three, and the largest (in this order, where equal)."""
    g = lags.groupBy("market", "focal").agg(F.avg(F.abs("rd_corr")).alias("rd"), F.avg(F.abs("capex_corr")).alias("investment"), F.avg(F.abs("margin_corr")).alias("pricing"))
    top = F.greatest("rd", "investment", "pricing")
    return g.withColumn("overall", (c("rd") + c("investment") + c("pricing")) / 3).withColumn("dominant", ladder([(c("rd") == top, "rd"), (c("investment") == top, "investment")], "pricing"))


def innovation_leaders(df: DataFrame, x: str = "rd_ratio", first: int = 1990, years: int = 5, k: int = 3) -> DataFrame:
    """The ``k`` companies with the highest mean of ``x`` in each market and block of years; ties by company."""
    block = (F.floor((c("year") - first) / years) * years + first).cast("int")
    g = df.where(c(x).isNotNull()).groupBy("market", block.alias("block"), "company_id").agg(F.avg(x).alias("mean"))
    # the heads of each group by repeated maxima: no group is sorted in one task
    out, left = None, g
    for rank in range(1, k + 1):
        top = left.groupBy("market", "block").agg(F.min(F.struct((-c("mean")).alias("m"), "company_id")).alias("_t")).select("market", "block", c("_t.company_id").alias("company_id"), (-c("_t.m")).alias("mean"), F.lit(rank).alias("rank"))
        out = top if out is None else out.unionByName(top)
        left = left.join(top.select("market", "block", "company_id"), ["market", "block", "company_id"], "left_anti")
    return out


def followership(df: DataFrame, x: str = "rd_ratio", back: int = 5, rise: float = 1.1) -> DataFrame:
    """Per company: years from the market's first rise of ``x`` in the ``back`` years before to the company's own moves.

    A market rises in a year when its mean grows by more than ``rise`` - 1 until the next one.  Moves without a rise
    before them don't count, and companies without such a move have no row.
    """
    m = df.groupBy("market", "year").agg(F.avg(x).alias("_m"))
    nxt = m.select("market", (c("year") - 1).alias("year"), c("_m").alias("_n"))
    ups = m.join(nxt, ["market", "year"]).where(c("_n") > c("_m") * rise).groupBy("market").agg(F.collect_list("year").alias("_ups"))  # years of a market
    w = Window.partitionBy("market", "company_id").orderBy("year")
    d = _with_moves(df.select("market", "company_id", "year", x), {"moved": c(x)}, w).where("moved").join(ups, "market")
    d = d.withColumn("_at", F.array_min(F.filter("_ups", lambda y: (y >= c("year") - back) & (y < c("year"))))).where(c("_at").isNotNull())
    g = d.groupBy("market", "company_id").agg(F.avg(c("year") - c("_at")).alias("avg_lag"), F.count(F.lit(1)).alias("adoptions"))
    return g.withColumn("kind", ladder([(c("avg_lag") <= 1, "fast"), (c("avg_lag") <= 3, "moderate"), (c("avg_lag") <= 5, "slow")], "late"))
