"""Outcome metrics and classic ratios as Column builders over the panel.

Every builder is a projection or an entity window on a panel unique on
(entity, year), so one select evaluates any number of them with one shuffle.
``METRICS`` is the registry; ``with_metrics`` applies a choice of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, ladder, sd, sigmoid, total
from ..functions.windows import W, full_window, growth, rows, whole

c = F.col


# ---- nine outcome metrics -------------------------------------------------

def revenue_alive() -> Column:
    """Revenue, null after the extinction year."""
    return F.when(c("extinction").isNull() | (c("year") <= F.year("extinction")), c("revenue"))


def revenue_growth() -> Column:
    """Percent change on the previous row; null in the establishment year and, for spin-offs, up to it."""
    born = F.year("established")
    blocked = (c("year") == born) | (c("parent_id").isNotNull() & (c("year") <= born))
    return F.when(~blocked, growth("revenue"))


def pct_ratio(num: str, den: str, lo: float, hi: float) -> Column:
    return clip(sd(num, den) * 100.0, lo, hi)


def value_added_ratio() -> Column:
    return clip(sd(c("revenue") - c("cost_of_sales"), "revenue") * 100.0, 0, 100)


def altman_z() -> Column:
    ta = c("total_assets")
    return (1.2 * sd(c("current_assets") - c("current_liabilities"), ta) + 1.4 * sd("retained_earnings", ta)
            + 3.3 * sd("operating_profit", ta) + 0.6 * sd("shareholders_equity", ta - c("shareholders_equity"))
            + 1.0 * sd("revenue", ta))


def survival_probability() -> Column:
    gone = c("extinction").isNotNull() & (c("year") > F.year("extinction"))
    return F.when(gone, 0.0).otherwise(100.0 * sigmoid(altman_z()))


def _step(x: Column, hi: float, lo: float) -> Column:
    return ladder([(x > hi, 1.0), (x > lo, 0.5)], 0.0)


def new_business_success() -> Column:
    score = (_step(growth("revenue"), 0.1, 0) * 0.3 + _step(sd("operating_profit", "revenue"), 0.05, 0) * 0.3
             + _step(sd("rd_expenses", "revenue"), 0.03, 0.01) * 0.2
             + F.when(c("segments_count") > 1, 0.5).otherwise(0.0) * 0.2)
    return score * F.least((c("year") - c("start_year")) / 5.0, F.lit(1.0)) * 100.0


def with_succession_score(df: DataFrame, name: str = "succession_score") -> DataFrame:
    """Neutral 50 unless the entity is a spin-off; trends are differences of 3-row means."""
    w3, w5, w = rows(3), rows(5), W()
    d = (
        df.withColumn("_g", growth("revenue"))
        .withColumn("_m3", F.avg(sd("operating_profit", "revenue") * 100.0).over(w3))
        .withColumn("_t3", F.avg(sd("revenue", "total_assets")).over(w3))
        .withColumn("_v5", F.stddev_samp("operating_profit").over(w5))
        .withColumn("_mp", F.avg("operating_profit").over(whole()))
        .withColumn("_g3", F.avg("_g").over(w3))
        .withColumn("_dm", c("_m3") - F.lag("_m3").over(w))
        .withColumn("_dt", c("_t3") - F.lag("_t3").over(w))
    )
    score = (ladder([(c("_dm") > 0, 1.0), (c("_dm") >= -1, 0.5)], 0.0) * 0.3
             + ladder([(c("_dt") > 0, 1.0), (c("_dt") >= -0.05, 0.5)], 0.0) * 0.25
             + _step(c("_g3"), 0.05, 0) * 0.25
             + F.when(c("_v5") < c("_mp") * 0.2, 1.0).otherwise(0.5) * 0.2)
    age = F.least((c("year") - c("start_year")) / 3.0, F.lit(1.0))
    out = d.withColumn(name, F.when(c("parent_id").isNull(), 50.0).otherwise(score * age * 100.0))
    return out.drop("_g", "_m3", "_t3", "_v5", "_mp", "_g3", "_dm", "_dt")


# ---- classic metrics ------------------------------------------------------

def cagr(col_: str, k: int) -> Column:
    """Compound growth over k rows; null unless both ends are positive."""
    prev = F.lag(col_, k).over(W())
    return F.when((prev > 0) & (c(col_) > 0), F.pow(c(col_) / prev, F.lit(1.0 / k)) - 1.0)


def rolling_std(x: Column | str, k: int) -> Column:
    return full_window(F.stddev_samp(F.col(x) if isinstance(x, str) else x), x, rows(k), k)


def rolling_mean(x: Column | str, k: int) -> Column:
    return full_window(F.avg(F.col(x) if isinstance(x, str) else x), x, rows(k), k)


def value_added() -> Column:
    return c("revenue") - F.coalesce(c("cost_of_sales"), F.lit(0.0))


METRICS: dict[str, Callable[[], Column]] = {
    "revenue_alive": revenue_alive,
    "revenue_growth": revenue_growth,
    "operating_margin": lambda: pct_ratio("operating_profit", "revenue", -100, 100),
    "net_margin": lambda: pct_ratio("net_profit", "revenue", -200, 200),
    "roe": lambda: pct_ratio("net_profit", "shareholders_equity", -500, 500),
    "value_added_ratio": value_added_ratio,
    "survival_probability": survival_probability,
    "new_business_success": new_business_success,
    "log_revenue": lambda: F.when(c("revenue") > 0, F.ln("revenue")),
    "revenue_per_employee": lambda: sd("revenue", "employees"),
    "growth_2": lambda: growth("revenue", 2),
    "cagr_3": lambda: cagr("revenue", 3),
    "operating_leverage": lambda: sd(growth("operating_profit"), growth("revenue")),
    "profit_quality": lambda: sd("net_profit", "operating_profit"),
    "roe_ratio": lambda: sd("net_profit", "shareholders_equity"),
    "net_profit_margin": lambda: sd("net_profit", "revenue"),
    "asset_turnover": lambda: sd("revenue", "total_assets"),
    "equity_multiplier": lambda: sd("total_assets", "shareholders_equity"),
    "roe_dupont": lambda: sd("net_profit", "revenue") * sd("revenue", "total_assets")
    * sd("total_assets", "shareholders_equity"),
    "sustainable_growth": lambda: sd("net_profit", "shareholders_equity")
    * (1.0 - F.coalesce(c("dividend_payout_ratio"), F.lit(0.0))),
    "value_added": value_added,
    "labor_productivity": lambda: sd(value_added(), "employees"),
    "capital_productivity": lambda: sd(value_added(), "tangible_fixed_assets"),
    "labor_share": lambda: sd(c("employees") * c("average_salary"), value_added()),
    "depreciation_share": lambda: sd("depreciation", value_added()),
    "profit_share": lambda: sd("operating_profit", value_added()),
    # ratio pack; null where the denominator is zero
    "gross_margin": lambda: sd("gross_profit", "revenue"),
    "debt_ratio": lambda: sd("total_liabilities", "total_assets"),
    "current_ratio": lambda: sd("current_assets", "current_liabilities"),
    "interest_coverage": lambda: sd("operating_profit", "interest_expenses"),
    "inventory_turnover": lambda: sd("cost_of_sales", "inventories"),
    "receivables_turnover": lambda: sd("revenue", "accounts_receivable"),
    "rd_intensity": lambda: sd("rd_expenses", "revenue"),
    "capex_intensity": lambda: sd("capex", "revenue"),
    "altman_z": altman_z,
}


def with_metrics(df: DataFrame, *names: str) -> DataFrame:
    """Add the named metrics; all of them when none is named."""
    names = names or tuple(METRICS)
    return df.select("*", *[METRICS[n]().alias(n) for n in names if n not in df.columns])


def rolling_pack(df: DataFrame, k: int = 3) -> DataFrame:
    """Growth volatility, margin stability and margin trend over full k-row windows."""
    d = df.withColumn("_g", growth("revenue")).withColumn("_m", sd("operating_profit", "revenue"))
    return d.select("*", rolling_std("_g", k).alias("growth_volatility"),
                    rolling_std("_m", k).alias("margin_stability"),
                    rolling_mean("_m", k).alias("margin_trend")).drop("_g", "_m")


# ---- survival scores ------------------------------------------------------

def _sd0(a: str | Column, b: str | Column) -> Column:
    """Ratio with zero for a zero denominator or a missing operand."""
    return F.coalesce(sd(a, b), F.lit(0.0))


def _tanh01(x: Column) -> Column:
    return F.tanh(x) * 0.5 + 0.5


def survival_blocks() -> dict[str, Column]:
    quick = _sd0(c("current_assets") - c("inventories"), "current_liabilities")
    liq = _tanh01((_sd0("current_assets", "current_liabilities") - 1.0) * 0.5 + (quick - 0.8) * 0.7
                  + (_sd0("cash_and_deposits", "current_liabilities") - 0.2) * 1.0)
    prof = _tanh01(_sd0("net_profit", "shareholders_equity") * 10.0 + _sd0("net_profit", "total_assets") * 15.0
                   + _sd0("operating_profit", "revenue") * 8.0)
    cover = F.greatest(_sd0("operating_profit", "interest_expenses"), F.lit(-0.999))
    lev = _tanh01((1.0 - _sd0("total_liabilities", "total_assets")) * 2.0 + F.log1p(cover) * 0.3)
    eff = _tanh01(_sd0("revenue", "total_assets") + F.log1p(_sd0("cost_of_sales", "inventories")) * 0.2)
    return {"liquidity": liq, "profitability": prof, "leverage": lev, "efficiency": eff}


# fixed weights of the four blocks
SURVIVAL_WEIGHTS = {"liquidity": 0.25, "profitability": 0.25, "leverage": 0.25, "efficiency": 0.25}


def survival_score(weights: dict[str, float] | None = None) -> Column:
    b = survival_blocks()
    return clip(total([b[k] * v for k, v in (weights or SURVIVAL_WEIGHTS).items()]), 0, 1)


def extinction_risk_index(df: DataFrame, name: str = "extinction_risk") -> DataFrame:
    """25 x (cash flow + debt + market + operational risk), each clipped to 0-1.

    Market inputs default to a share decline of 0 and a neutral position of .5;
    revenue variation is the entity's coefficient of variation.
    """
    cv = F.coalesce(sd(F.stddev_pop("revenue").over(whole()), F.avg("revenue").over(whole())), F.lit(0.0))
    d = df.withColumn("_cv", cv).withColumn("_dg", F.coalesce(growth("total_liabilities"), F.lit(0.0)))
    cash = clip(1.0 - F.tanh(c("operating_cash_flow") / 1e8 + _sd0("operating_cash_flow", "revenue") * 10.0), 0, 1)
    debt = clip(F.tanh(_sd0("interest_expenses", "operating_cash_flow") * 2.0 + c("_dg")), 0, 1)
    market = clip(F.lit(0.0) * 2.0 + (1.0 - F.lit(0.5)), 0, 1)
    fixed = _sd0(c("sg_a_expenses") + c("depreciation"), "revenue")
    oper = clip(c("_cv") * 3.0 + fixed * 0.5, 0, 1)
    return d.withColumn(name, clip((cash + debt + market + oper) * 25.0, 0, 100)).drop("_cv", "_dg")


def exit_probability(share: Column, rival_growth: Column, relative_profit: Column) -> Column:
    """Mean of market vulnerability, competitive decline and 1 - sustainability."""
    vul = clip((1.0 - share) * 0.7 + rival_growth * 0.3, 0, 1)
    decline = clip((1.0 - relative_profit) * 0.6 + (0.05 - _sd0("rd_expenses", "revenue")) * 10.0, 0, 1)
    sust = _tanh01(_sd0("cash_and_deposits", "revenue") * 5.0
                   + _sd0("operating_cash_flow", "total_liabilities") * 2.0)
    return clip((vul + decline + (1.0 - sust)) / 3.0, 0, 1)


def continuity_index() -> Column:
    """25 x (stability + growth + efficiency + adaptability)."""
    stab = clip(_sd0("shareholders_equity", "total_assets")
                + F.tanh((_sd0("current_assets", "current_liabilities") - 1.0) * 2.0) * 0.3, 0, 1)
    g = F.coalesce(growth("revenue"), F.lit(0.0)) + F.coalesce(growth("net_profit"), F.lit(0.0))
    grow = clip(F.tanh(g) * 0.4 + F.tanh(_sd0("capex", "revenue") * 10.0) * 0.6, 0, 1)
    eff = clip(F.tanh(_sd0("revenue", "total_assets")) * 0.5
               + F.tanh(_sd0("revenue", "employees") / 1e6) * 0.5, 0, 1)
    adapt = clip(F.tanh(_sd0("rd_expenses", "revenue") * 20.0) * 0.6 + c("overseas_revenue_ratio") * 0.4, 0, 1)
    return clip((stab + grow + eff + adapt) * 25.0, 0, 100)


def altman_bands(z: Column) -> Column:
    """Risk level by the 1.8 / 3.0 cut-offs: 2 distress, 1 grey, 0 safe."""
    return ladder([(z < 1.8, 2), (z < 3.0, 1)], 0)


def risk_flags(df: DataFrame) -> DataFrame:
    """Threshold flags (liquidity, leverage, margin, coverage) and their mean."""
    fs = {
        "low_liquidity": flag(sd("current_assets", "current_liabilities") < 1.0),
        "high_leverage": flag(sd("total_liabilities", "shareholders_equity") > 3.0),
        "negative_margin": flag(sd("operating_profit", "revenue") < -0.05),
        "low_coverage": flag(sd("operating_profit", "interest_expenses") < 1.5),
    }
    d = df.select("*", *[v.alias(k) for k, v in fs.items()])
    return d.withColumn("risk_flag_mean", total([c(k) for k in fs]) / len(fs))


def latest_row(df: DataFrame, cols: list[str], entity: str = "company_id", period: str = "year") -> DataFrame:
    """Columns of the newest row per entity by one max_by, no sort."""
    return df.groupBy(entity).agg(F.max_by(F.struct(period, *cols), period).alias("_r")).select(entity, "_r.*")


def distress_latest(df: DataFrame) -> DataFrame:
    """Latest-row score: .3 min(current ratio, 3) + .3 turnover + 4 x return on assets, floored at 0."""
    d = latest_row(df, ["net_profit", "revenue", "total_assets", "current_assets", "current_liabilities"])
    cur = sd("current_assets", "current_liabilities")
    score = (F.coalesce(F.when(cur > 3, 3.0).otherwise(cur) * 0.3, F.lit(0.0))
             + F.coalesce(sd("revenue", "total_assets") * 0.3, F.lit(0.0))
             + F.coalesce(sd("net_profit", "total_assets") * 4.0, F.lit(0.0)))
    return d.withColumn("distress", F.when(c("total_assets") > 0, F.greatest(score, F.lit(0.0))).otherwise(0.0))


def risk_outlook(risk: Column) -> dict[str, Column]:
    """1 - .3r compounded over 1, 3, 5 years; years until survival falls below one half; level band."""
    s1 = 1.0 - risk * 0.3
    s = {n: clip(F.pow(s1, F.lit(float(n))), 0, 1) for n in (1, 3, 5)}
    decay = -F.ln(s[5]) / 5.0
    when = F.when(risk < 0.3, F.lit(None).cast("double"))
    for n in (1, 3, 5):
        when = when.when(s[n] < 0.5, float(n))
    return {
        "survival_1y": s[1], "survival_3y": s[3], "survival_5y": s[5],
        "years_to_extinction": when.otherwise(F.when(decay > 0, F.lit(0.6931471805599453) / decay)),
        "risk_level": ladder([(risk < b, n) for b, n in RISK_BANDS], "critical"),
    }


# fixed upper bounds of the risk levels
RISK_BANDS = ((0.1, "very_low"), (0.25, "low"), (0.5, "medium"), (0.75, "high"), (0.9, "very_high"))


# ---- interaction and ensemble features ------------------------------------

EPS = 2.220446049250313e-16


def interactions(df: DataFrame, products: list[tuple[str, str]], ratios: list[tuple[str, str]],
                 squares: list[str], roots: list[str], triples: list[tuple[str, str, str]],
                 gates: dict[str, Column], gated: list[str]) -> DataFrame:
    """Generated features: products, ratios (zero denominator -> eps), powers, triples and 0/1 gates."""
    out = {f"{a}_x_{b}": c(a) * c(b) for a, b in products}
    out |= {f"{a}_per_{b}": c(a) / F.when(c(b) == 0, EPS).otherwise(c(b)) for a, b in ratios}
    out |= {f"{a}_sq": c(a) * c(a) for a in squares}
    out |= {f"{a}_sqrt": F.sqrt(F.abs(c(a))) for a in roots}
    out |= {"_x_".join(t): c(t[0]) * c(t[1]) * c(t[2]) for t in triples}
    out |= {f"{a}_{g}": c(a) * flag(cond) for g, cond in gates.items() for a in gated}
    return df.select("*", *[v.alias(k) for k, v in out.items()])


def age_gates(young: int = 10, mature: int = 20) -> dict[str, Column]:
    age, abroad = c("year") - c("start_year"), c("overseas_revenue_ratio")
    return {"young": age < young, "mature": age >= mature, "global": abroad > 0.5, "domestic": abroad <= 0.2}


def ensemble_features(df: DataFrame, weights: dict[str, float], mature: int = 20) -> DataFrame:
    """log1p age, age squared, mature flag, assets by market, R&D x margin, market weight (default 1)."""
    age = (c("year") - c("start_year")).cast("double")
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(c("market") == k, v).otherwise(w)
    return df.select(
        "*", F.log1p(age).alias("log_age"), (age * age).alias("age_sq"), flag(age > mature).alias("mature_flag"),
        w.alias("market_weight"),
        *[(flag(c("market") == k) * c("total_assets")).alias(f"assets_{k.lower()}") for k in weights],
        (sd("rd_expenses", "revenue") * sd("operating_profit", "revenue")).alias("rd_margin"),
    )


def stage_features(df: DataFrame) -> DataFrame:
    """Burn, runway, investment efficiency, traction, scaling, leverage, distress count, bankruptcy band."""
    cf, cash = c("operating_cash_flow"), c("cash_and_deposits")
    burn = F.coalesce(sd(-cf, cash) * 12.0, F.lit(0.0))
    ta = c("total_assets")
    z = (sd(c("current_assets") - c("current_liabilities"), ta) * 1.2 + sd("retained_earnings", ta) * 1.4
         + sd("operating_profit", ta) * 3.3 + sd("revenue", ta) * 1.0)
    distress = total([flag(sd("current_assets", "current_liabilities") < 1.0),
                      flag(sd("operating_profit", "revenue") < 0),
                      flag(sd("total_liabilities", "total_assets") * 100.0 > 70), flag(cf < 0)])
    g = growth("revenue")
    return df.select(
        "*", burn.alias("burn_rate"), F.when(burn > 0, cash / burn).alias("runway_months"),
        sd(g, sd("capex", "revenue") * 100.0).alias("investment_efficiency"), g.alias("traction"),
        sd(g, growth("cost_of_sales")).alias("scaling"), sd(growth("operating_profit"), g).alias("leverage"),
        distress.alias("distress_count"),
        ladder([(z > 2.99, 5.0), (z > 1.81, 20.0)], 50.0).alias("bankruptcy_pct"),
    )


def category_features(df: DataFrame) -> DataFrame:
    """R&D intensity, pricing power, leadership and scale; null where inputs are absent."""
    return df.select("*", sd("rd_expenses", "revenue").alias("f_rd_intensity"),
                     sd("gross_profit", "revenue").alias("f_pricing_power"),
                     sd("revenue", "employees").alias("f_leadership"),
                     F.when(c("total_assets") > 0, F.ln("total_assets")).alias("f_scale"))


# ---- filters --------------------------------------------------------------

def select_panel(df: DataFrame, markets: list[str] | None = None, stages: list[str] | None = None,
                 status: str | None = None, years: tuple[int, int] | None = None, ids: DataFrame | None = None,
                 recent: int | None = None, last_year: int | None = None) -> DataFrame:
    """Filters by category, stage, status, year range, id list and recent years (pushed to the scan)."""
    if markets:
        df = df.where(c("market").isin(markets))
    if stages:
        df = df.where(c("stage").isin(stages))
    if status:
        df = df.where(c("status") == status)
    if years:
        df = df.where(c("year").between(*years))
    if ids is not None:
        df = df.join(ids, "company_id", "left_semi")
    if recent and last_year:
        df = df.where(c("year") > last_year - recent)
    return df

