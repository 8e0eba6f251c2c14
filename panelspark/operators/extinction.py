"""Extinction features: nine families of row rules, composites, warnings and probability features.

Every feature is one of a few rules applied to one ratio; all of them share the
entity's windows, so the whole table is one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, flag, ladder, sd, total
from ..functions.windows import W, full_window, growth, rows, whole
from .metrics import altman_bands, altman_z
from .timeseries import change_eps, rolling_slope, with_row

c = F.col

RATIOS: dict[str, tuple[str, str]] = {
    "equity_ratio": ("shareholders_equity", "total_assets"), "debt_ratio": ("total_liabilities", "total_assets"), "current_ratio": ("current_assets", "current_liabilities"),
    "interest_burden": ("interest_expenses", "revenue"), "op_margin": ("operating_profit", "revenue"), "roe_r": ("net_profit", "shareholders_equity"), "roa": ("net_profit", "total_assets"),
    "gross_margin": ("gross_profit", "revenue"), "rd_r": ("rd_expenses", "revenue"), "asset_turn": ("revenue", "total_assets"), "recv_turn": ("revenue", "accounts_receivable"),
    "inv_turn": ("cost_of_sales", "inventories"), "fixed_turn": ("revenue", "tangible_fixed_assets"), "labor_prod": ("revenue", "employees"), "de_ratio": ("total_liabilities", "shareholders_equity"),
    "coverage": ("operating_profit", "interest_expenses"), "short_debt": ("current_liabilities", "total_liabilities"), "ad_r": ("advertising_expenses", "revenue"),
}

# feature -> (family, rule, column, argument)
FEATURES: dict[str, tuple[str, str, str, float]] = {
    "equity_ratio_decline": ("health", "change", "equity_ratio", 2), "equity_ratio_volatility": ("health", "volatility", "equity_ratio", 3), "debt_ratio_surge": ("health", "change", "debt_ratio", 2),
    "current_ratio_deterioration": ("health", "below", "current_ratio", 1.5), "insolvency": ("health", "negative", "shareholders_equity", 0), "net_assets_trend": ("health", "trend", "shareholders_equity", 3),
    "interest_burden_increase": ("health", "change", "interest_burden", 2),
    "margin_decline": ("deterioration", "consecutive", "op_margin", 3), "margin_volatility": ("deterioration", "volatility", "op_margin", 3), "revenue_decline_trend": ("deterioration", "lower", "revenue", 3),
    "revenue_deceleration": ("deterioration", "deceleration", "revenue", 1), "roe_deterioration": ("deterioration", "below", "roe_r", 0.08), "roa_negative": ("deterioration", "negative", "roa", 0),
    "roa_decline": ("deterioration", "change", "roa", 2), "gross_margin_compression": ("deterioration", "compression", "gross_margin", 3), "loss_periods": ("deterioration", "run_negative", "net_profit", 0),
    "current_crisis": ("liquidity", "under", "current_ratio", 0.8), "current_decline": ("liquidity", "change", "current_ratio", 2), "cash_flow_negative_periods": ("liquidity", "run_negative", "operating_cash_flow", 0),
    "cash_flow_volatility": ("liquidity", "volatility", "operating_cash_flow", 3), "cash_depletion": ("liquidity", "reduction", "cash_and_deposits", 2),
    "rd_decline": ("competitiveness", "change", "rd_r", 2), "rd_stagnation": ("competitiveness", "stagnation", "rd_expenses", 3), "capex_stagnation": ("competitiveness", "stagnation", "capex", 3),
    "capex_decline_trend": ("competitiveness", "lower", "capex", 3), "staff_reduction": ("competitiveness", "reduction", "employees", 1), "staff_reduction_consecutive": ("competitiveness", "consecutive", "employees", 2),
    "overseas_decline": ("competitiveness", "change", "overseas_revenue_ratio", 2),
    "leverage_crisis": ("leverage", "over", "de_ratio", 2.0), "leverage_increase": ("leverage", "change", "de_ratio", 2), "coverage_crisis": ("leverage", "under", "coverage", 1.5),
    "coverage_decline": ("leverage", "change", "coverage", 2), "short_debt_dependency": ("leverage", "square", "short_debt", 0),
    "asset_turn_decline": ("efficiency", "change", "asset_turn", 2), "receivables_deterioration": ("efficiency", "below", "recv_turn", 6), "inventory_decline": ("efficiency", "change", "inv_turn", 2),
    "fixed_asset_decline": ("efficiency", "change", "fixed_turn", 2), "labor_decline": ("efficiency", "change", "labor_prod", 2),
    "intangible_stagnation": ("innovation", "stagnation", "intangible_fixed_assets", 3), "rd_expense_decline": ("innovation", "change", "rd_expenses", 2), "salary_decline": ("innovation", "change", "average_salary", 2),
    "segments_stagnation": ("adaptation", "stagnation", "segments_count", 3), "advertising_decline": ("adaptation", "change", "ad_r", 2),
    "revenue_anomaly": ("anomaly", "anomaly", "revenue", 3), "profit_anomaly": ("anomaly", "anomaly", "operating_profit", 3),
}

# fixed members of the composites
COMPOSITES = {
    "composite_extinction_risk": ("insolvency", "roa_negative", "current_crisis", "leverage_crisis", "coverage_crisis"),
    "health_composite": ("insolvency", "leverage_crisis", "coverage_crisis"),
    "continuity_risk": ("roa_negative", "revenue_decline_trend", "current_crisis"),
}


def _rule(rule: str, x: str, a: float) -> Column:
    k, w = int(a), W()
    v = c(x)
    if rule == "change":
        return change_eps(x, k)
    if rule == "reduction":
        return -change_eps(x, k)
    if rule == "volatility":
        return full_window(F.stddev_samp(x), x, rows(k), k)
    if rule == "below":
        return (a - v) / a
    if rule == "negative":
        return flag(v < 0)
    if rule == "under":
        return flag(v < a)
    if rule == "over":
        return flag(v > a)
    if rule == "square":
        return v * v
    if rule == "trend":
        return rolling_slope(x, k)
    if rule == "lower":
        return flag(v < F.lag(x, k - 1).over(w))
    if rule == "deceleration":
        return growth(x) - F.coalesce(F.lag(x, 1).over(w) / F.nullif(F.lag(x, 2).over(w), F.lit(0.0)) - 1.0, F.lit(None).cast("double"))
    if rule == "compression":
        m = full_window(F.avg(x), x, rows(k), k)
        return (m - v) / (m + 1e-6)
    if rule == "stagnation":
        return flag(full_window(F.stddev_samp(x), x, rows(k), k) < F.stddev_samp(x).over(whole()) * 0.1)
    if rule == "consecutive":
        return flag(total([flag(F.lag(x, i).over(w) < F.lag(x, i + 1).over(w)) if i else flag(v < F.lag(x).over(w)) for i in range(k)]) == k)
    if rule == "run_negative":
        last_ok = F.last(F.when(v >= 0, c("_row")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return (c("_row") - F.coalesce(last_ok, F.lit(0))).cast("double")
    raise ValueError(rule)


def with_ratios(df: DataFrame) -> DataFrame:
    return df.select("*", *[sd(a, b).alias(k) for k, (a, b) in RATIOS.items()])


def extinction_features(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    """The feature table of the chosen families, with the composites when their members are present."""
    d = with_row(with_ratios(df))
    want = {k: v for k, v in FEATURES.items() if not families or v[0] in families}
    plain = {k: _rule(r, x, a) for k, (_, r, x, a) in want.items() if r != "anomaly"}
    d = d.select("*", *[v.alias(k) for k, v in plain.items()])
    for k, (_, r, x, a) in want.items():
        if r == "anomaly":
            n = int(a)
            d = d.withColumn("_v", full_window(F.stddev_samp(x), x, rows(n), n))
            d = d.withColumn(k, flag(c("_v") > F.percentile("_v", F.lit(0.9)).over(whole()))).drop("_v")
    for k, members in COMPOSITES.items():
        if all(m in want for m in members):
            d = d.withColumn(k, total([c(m) for m in members]) / len(members))
    return d.drop("_row")


def probability_features(df: DataFrame) -> DataFrame:
    """Z score and band, 3-year ratio trends with their worsening, cash exhaustion, decline persistence."""
    d = with_row(with_ratios(df))
    keys = ("equity_ratio", "current_ratio", "op_margin", "roe_r")
    d = d.select("*", altman_z().alias("z"), altman_bands(altman_z()).alias("z_band"), *[rolling_slope(k, 3).alias(f"{k}_trend") for k in keys],
                 (c("operating_cash_flow") - c("capex")).alias("_fcf"), flag(growth("revenue") < -0.05).alias("_dec"))
    w3 = rows(3)
    return d.select(*[x for x in d.columns if not x.startswith("_")], *[clip(c(f"{k}_trend") - F.lag(f"{k}_trend").over(W()), -1, 0).alias(f"{k}_worsening") for k in keys],
                    flag(full_window(F.sum("_fcf"), "_fcf", w3, 3) < 0).alias("cash_exhaustion"), full_window(F.sum("_dec"), "_dec", w3, 3).alias("decline_persistence"))


def early_warnings(df: DataFrame, lead: int = 3) -> DataFrame:
    """Profit quality gap, falling ROA and share, and shrinking return on investment growth."""
    d = with_row(with_ratios(df))
    return d.select("*", (c("operating_cash_flow") - c("net_profit")).alias("quality_gap"), flag(rolling_slope("roa", lead) < -0.01).alias("roa_declining"),
                    flag(rolling_slope("share", lead) < 0).alias("share_weakening"), flag(growth("revenue") / (growth("capex") + 1e-6) < 0).alias("investment_decline")).drop("_row")


def hazard_indicators(df: DataFrame, k: int = 3) -> DataFrame:
    """Deterioration, risk accumulation, competitiveness, resilience and warning count over k rows."""
    w = rows(k)
    d = with_ratios(df)
    d = d.withColumn("_d", flag(c("op_margin") < F.lag("op_margin").over(W()))).withColumn("_r", flag(c("debt_ratio") > 0.7) + flag(c("current_ratio") < 1.0) + flag(c("roa") < 0))
    return d.select("*", F.avg("_d").over(w).alias("deterioration"), F.sum("_r").over(w).alias("risk_accumulation"), F.avg("rd_r").over(w).alias("competitiveness"),
                    F.avg("equity_ratio").over(w).alias("resilience"), c("_r").alias("warnings")).drop("_d", "_r")


def time_varying(df: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """Change rates, rolling trend and rolling spread of each column."""
    d = with_row(df)
    return d.select("*", *[a for x in cols for a in (growth(x).alias(f"{x}_change"), rolling_slope(x, k).alias(f"{x}_trend"),
                                                     full_window(F.stddev_samp(x), x, rows(k), k).alias(f"{x}_risk"))]).drop("_row")


# ---- maturity in five dimensions -------------------------------------------------------

def maturity_dimensions(df: DataFrame, k: int = 3) -> DataFrame:
    """Financial, investment, organization, market and technology maturity (0-100), overall, balance, velocity.

    Each dimension is the sum of four 0-25 scores: rolling stability 1/(1+CV) of a ratio or a clipped level.
    """
    d = with_ratios(df)
    w = rows(k)

    def stable(x: str) -> Column:
        m = F.avg(x).over(w)
        return F.when(F.count(x).over(w) >= 2, 1.0 / (1.0 + F.coalesce(sd(F.stddev_samp(x).over(w), F.abs(m)), F.lit(1.0)))).otherwise(0.5)

    z = lambda x: clip(F.coalesce(x, F.lit(0.0)), 0, 1)
    dims = {
        "financial": (stable("roe_r"), stable("op_margin"), stable("operating_cash_flow"), z(1 - c("de_ratio") / 3) * 0.5 + z(c("coverage") / 10) * 0.5),
        "investment": (z(c("fixed_turn") / 5), stable("rd_r"), z(c("roa") * 10), stable("capex")),
        "organization": (z(c("labor_prod")), z(1 - sd(c("employees") * c("average_salary"), "revenue")), stable("employees"), z(c("dividend_payout_ratio"))),
        "market": (stable("revenue"), z(c("overseas_revenue_ratio")) * 0.5 + z(c("segments_count") / 5) * 0.5, z(c("gross_margin") * 2), z(c("ad_r") * 20)),
        "technology": (z(c("rd_r") * 10), z(sd("intangible_fixed_assets", "total_assets") * 5), stable("intangible_fixed_assets"), z(c("inv_turn") / 10)),
    }
    d = d.select("*", *[(total([s * 25.0 for s in v])).alias(f"mat_{n}") for n, v in dims.items()])
    names = [c(f"mat_{n}") for n in dims]
    m = total(names) / len(names)
    s = F.sqrt(total([F.pow(x - m, F.lit(2.0)) for x in names]) / len(names))
    d = d.withColumn("maturity", m).withColumn("balance", 1.0 / F.nullif(s, F.lit(0.0)))
    return d.withColumn("velocity", c("maturity") - F.lag("maturity").over(W())).withColumn(
        "phase", ladder([(c("maturity") >= 70, "mature"), (c("maturity") >= 40, "developing")], "emerging"))
