"""The factor pack: nine families of 23 explanatory factors per entity and year.

Three layers, each one projection: row measures, values of the year before
(all of them share one range window), and composites.  Formulas are plain SQL
expressions over named columns; families list the measure behind each id.
Windows over years stay inside one entity (at most eight rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip
from ..functions.windows import W, year_lag, years

c = F.col


def _r(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _or(x: str, default: str) -> str:
    """A missing or zero value is replaced by the default."""
    return f"coalesce(nullif({x}, 0), {default})"


# ---- layer 1: row measures ------------------------------------------------------

_SHARES = {"material": 0.6, "labor_cost": 0.25, "overhead": 0.15}
ROW: dict[str, str] = {
    **{k: f"case when revenue > 0 then cost_of_sales * {w} / revenue end" for k, w in _SHARES.items()},
    "recv_turn": _r("revenue", "accounts_receivable"), "inv_turn": _r("cost_of_sales", "inventories"), "asset_turn": _r("revenue", "total_assets"),
    "equity_ratio": _r("shareholders_equity", "total_assets"), "roe": _r("net_profit", "shareholders_equity"), "labor_prod": _r("revenue", "employees"),
    "asset_eff": _r("revenue", "tangible_fixed_assets"),
    "cur_ratio": _r("cash_and_deposits + accounts_receivable + inventories", "(total_assets - shareholders_equity) * 0.6"),
    "debt_equity": _r("case when interest_expenses > 0 then interest_expenses / 0.02 else 0.0 end", "shareholders_equity"),
    "debt_assets": _r("case when interest_expenses > 0 then interest_expenses / 0.02 else 0.0 end", "total_assets"),
    "retirement": "case when employees > 0 and average_salary > 0 then employees * average_salary * 0.05 end",
    "welfare": "case when employees > 0 and average_salary > 0 then employees * average_salary * 0.15 end",
    "personnel": "employees * average_salary",
    "outsourcing": "case when revenue > 0 then cost_of_sales * (0.1 + overseas_revenue_ratio * 0.2) / revenue end",
    "non_op": "interest_income + greatest(fx_gain_loss, 0.0)",
    "dependency": "case when overseas_revenue_ratio < 0.2 and segments_count <= 2 then 0.8 when overseas_revenue_ratio < 0.5 and segments_count <= 3 then 0.5 else 0.2 end",
    "value_added": _r("revenue - cost_of_sales * 0.6", "revenue"), "fixed_cost": _r("sg_a_expenses + depreciation", "revenue"),
    "concentration": "case when segments_count <= 1 then 1.0 else 1.0 / segments_count end",
    "op_ratio": _r("operating_profit", "revenue"), "net_ratio": _r("net_profit", "revenue"), "rd_ratio": _r("rd_expenses", "revenue"), "sga_ratio": _r("sg_a_expenses", "revenue"),
    "ad_ratio": _r("advertising_expenses", "revenue"), "cost_ratio": _r("cost_of_sales", "revenue"), "dep_revenue": _r("depreciation", "revenue"), "dep_cost": _r("depreciation", "cost_of_sales"),
    "int_income_ratio": _r("interest_income", "revenue"), "int_expense_ratio": _r("interest_expenses", "revenue"), "fx_ratio": _r("fx_gain_loss", "revenue"),
    "xprofit_ratio": _r("extraordinary_profit", "revenue"), "xloss_ratio": _r("extraordinary_loss", "revenue"),
    "sga_personnel": "case when sg_a_expenses > 0 then sg_a_expenses * 0.4 end", "sga_depreciation": "case when sg_a_expenses > 0 then sg_a_expenses * 0.1 end",
    "equity_income": _r("investment_securities * 0.03", "revenue"), "tax_adjust": "tax_rate - 0.3",
    "pretax": _r("case when tax_rate < 1 then net_profit / nullif(1 - tax_rate, 0) else net_profit end", "revenue"),
    "securities_gain": _r("greatest(fx_gain_loss, 0.0)", "revenue"), "disposal": _r("(extraordinary_profit - extraordinary_loss) * 0.5", "revenue"), "impairment": _r("extraordinary_loss * 0.3", "revenue"),
    "assets_equity": _r("total_assets", "shareholders_equity"), "fixed_equity": _r("tangible_fixed_assets + intangible_fixed_assets", "shareholders_equity"),
    "cash_assets": _r("cash_and_deposits", "total_assets"), "securities_assets": _r("investment_securities", "total_assets"), "retention": "1 - dividend_payout_ratio",
    "x_impact": _r("extraordinary_profit - extraordinary_loss", "net_profit"), "intangible_revenue": _r("intangible_fixed_assets", "revenue"), "patent": "case when rd_expenses > 0 then rd_expenses * 0.2 end",
    "software": _r("intangible_fixed_assets * 0.7", "total_assets"), "intangible": _r("intangible_fixed_assets", "total_assets"), "salary_ratio": "average_salary / 6000000",
    "staff_per_million": _r("employees", "revenue / 1000000"), "one_less_cost": "1 - cost_of_sales / nullif(revenue, 0)",
    "interest_cover": _r("operating_profit", "interest_expenses"), "debt_service": _r("net_profit + depreciation", "interest_expenses"), "capex_ratio": _r("capex", "revenue"),
    "diversification": "(least(overseas_revenue_ratio, 0.8) / 0.8 + least(segments_count / 5, 1.0)) / 2", "cf_ratio": "case when revenue > 0 then (net_profit + depreciation) / revenue end",
    "age": "cast(year - entry_year as double)",
}

# ---- layer 2: the year before ----------------------------------------------------

GROWN = """capex rd_expenses tangible_fixed_assets intangible_fixed_assets total_assets employees average_salary sg_a_expenses advertising_expenses
accounts_receivable inventories personnel retirement non_op recv_turn inv_turn asset_turn revenue operating_profit""".split()
PREVIOUS = [*GROWN, "overseas_revenue_ratio", "segments_count", "roe", "equity_ratio", "op_ratio", "rd_ratio", "sga_ratio", "cost_ratio", "dividend_payout_ratio"]
GROWTH = {f"g_{x}": _r(f"{x} - p_{x}", f"p_{x}") for x in GROWN}

# ---- layer 3: composites -----------------------------------------------------------

COMPOSITE: dict[str, str] = {
    "entry_timing": "least(age / 40, 1.0)",
    "overseas_change": "overseas_revenue_ratio - p_overseas_revenue_ratio",
    "segment_growth": "case when p_revenue is not null then coalesce(g_revenue, 0.0) + (segments_count - p_segments_count) * 0.1 end",
    "maturity_impact": "1 / (1 + exp(-0.1 * (20 - age)))",
    "variable_cost": "coalesce(material, 0.0) + coalesce(outsourcing, 0.0)",
    "position": "coalesce(op_ratio, 0.0) * 5 * 0.7 + least(revenue / 100000000000, 1.0) * 0.3",
    "op_leverage": "case when g_revenue <> 0 and g_operating_profit is not null then greatest(least(g_operating_profit / nullif(g_revenue, 0) / 5, 1.0), 0.0) end",
    "leverage_impact": "least(coalesce(debt_equity, 0.0), 2.0) / 2",
    "allocation": "least(coalesce(roe, 0.0) * 5, 1.0) * 0.6 + least(coalesce(asset_turn, 0.0), 1.0) * 0.4",
    "non_op_ratio": _r("non_op", "revenue"),
    "return_efficiency": "(case when dividend_payout_ratio between 0.3 and 0.6 then 1.0 else 0.5 end) * 0.4 + least(coalesce(roe, 0.0) * 5, 1.0) * 0.6",
    "sustainability": "least(coalesce(retention, 0.0) * coalesce(roe, 0.0) * 10, 1.0)",
    "personnel_ratio": _r("personnel", "revenue"), "retirement_ratio": _r("retirement", "revenue"), "welfare_ratio": _r("welfare", "revenue"),
    "one_less_material": "1 - material", "one_less_outsourcing": "1 - outsourcing",
    "high_value": "case when coalesce(op_ratio, 0.0) >= 0.15 then 0.8 when coalesce(op_ratio, 0.0) >= 0.1 then 0.5 else 0.2 end",
    "service": "least(coalesce(non_op, 0.0) / nullif(revenue, 0) * 5, 0.5)", "license": _r("non_op * 0.3", "revenue"),
    "innovation": "coalesce(rd_ratio, 0.0) * 10 * 0.6 + coalesce(intangible, 0.0) * 0.4", "differentiation": "coalesce(op_ratio, 0.0) * 5 * 0.7 + coalesce(rd_ratio, 0.0) * 10 * 0.3",
    "chain": f"greatest(1 - {_or('outsourcing', '0.2')}, 0.0)",
    "brand": "least(coalesce(intangible, 0.0) * 0.4 + coalesce(op_ratio, 0.0) * 5 * 0.4 + coalesce(ad_ratio, 0.0) * 10 * 0.2, 1.0)",
    "supply": f"(1 - {_or('outsourcing', '0.3')}) * 0.6 + least({_or('inv_turn', '5.0')} / 10, 1.0) * 0.4",
    "compliance": "(1 - least(coalesce(xloss_ratio, 0.0) * 10, 1.0)) * 0.7 + overseas_revenue_ratio * 0.3",
    "age_survival": "exp(-power((year - founding_year) / 50.0, 1.5))",
    "crisis": "least(coalesce(cash_assets, 0.0) * 0.4 + coalesce(op_ratio, 0.0) * 5 * 0.3 + coalesce(equity_ratio, 0.0) * 0.3, 1.0)",
    "capital_adequacy": "case when year - founding_year <= 5 then least(total_assets / nullif((year - founding_year) * 1000000.0, 0), 2.0) end",
    "timing": "case when year - founding_year <= 5 then coalesce(least(revenue / nullif((year - founding_year) * 500000000.0, 0), 2.0) / 2, 0.0) end",
    "novelty": "least(coalesce(rd_ratio, 0.0) * 5 * 0.7 + coalesce(patent / nullif(revenue, 0), 0.0) * 20 * 0.3, 1.0)",
    "size_potential": "overseas_revenue_ratio * 0.6 + least(segments_count / 3, 1.0) * 0.4",
    "acquisition": "case when advertising_expenses <> 0 and p_revenue > 0 and p_advertising_expenses > 0 then greatest(least((revenue / advertising_expenses) / (p_revenue / p_advertising_expenses) - 1 + 0.5, 1.0), 0.0) end",
    "unit_economics": "least(operating_profit / nullif(employees, 0) / 5000000, 2.0) / 2",
    "funding": "case when g_total_assets > 0 then greatest(least((coalesce(roe, 0.0) - coalesce(p_roe, 0.0)) / nullif(g_total_assets, 0) + 0.5, 1.0), 0.0) end",
    "talent": "greatest(least(coalesce(g_employees, 0.0), 1.0), 0.0)", "rd_intensity": "least(coalesce(rd_ratio, 0.0) / 0.15, 1.0)",
    "infrastructure": "least(coalesce(capex_ratio, 0.0) + coalesce(intangible, 0.0), 1.0)",
    "partnership": "greatest(case when coalesce(outsourcing, 0.0) between 0.2 and 0.4 then 1.0 else 1.0 - abs(coalesce(outsourcing, 0.0) - 0.3) / 0.3 end, 0.0)",
    "resilience": "case when p_revenue is null then coalesce(equity_ratio, 0.0) else greatest(least((coalesce(equity_ratio, 0.0) - coalesce(p_equity_ratio, 0.0)) * 10, 1.0), 0.0) end",
    "continuity": "(case when p_revenue is null or coalesce(g_employees, 0.0) between -0.05 and 0.15 then 1.0 else 0.7 end) * 0.6 + (case when p_revenue is null or coalesce(g_average_salary, 0.0) between -0.02 and 0.10 then 1.0 else 0.7 end) * 0.4",
    "planning": "case when year >= succession_year then least((year - succession_year) / 5.0, 1.0) end",
    "transfer": "coalesce(rd_ratio, 0.0) * 10 * (case when g_employees is null then 1.0 else 0.6 end) + (case when g_employees is null then 0.0 when g_employees between -0.1 and 0.2 then 1 - abs(g_employees) else 0.5 end) * 0.4",
    "integration": "case when p_sga_ratio > 0 then greatest((p_sga_ratio - sga_ratio) / nullif(p_sga_ratio, 0), 0.0) end",
    "customer_retention": "case when recv_turn is not null and p_recv_turn > 0 then greatest(1 - abs((recv_turn - p_recv_turn) / nullif(p_recv_turn, 0)), 0.0) else 0.8 end",
    "disruption": "case when asset_turn is not null and p_asset_turn > 0 then least(asset_turn / nullif(p_asset_turn, 0), 1.0) else 0.9 end",
    "duplicates": "case when p_sga_ratio > 0 then greatest(least((p_sga_ratio - coalesce(sga_ratio, 0.0)) / nullif(p_sga_ratio, 0), 1.0), 0.0) else 0.5 end",
    "scale_economy": "case when p_cost_ratio > 0 and revenue > p_revenue then greatest(least((p_cost_ratio - coalesce(cost_ratio, 0.0)) / nullif(p_cost_ratio, 0) / nullif((revenue - p_revenue) / p_revenue, 0) + 0.5, 1.0), 0.0) else 0.5 end",
    "scope_economy": "case when p_sga_ratio > 0 and p_segments_count > 0 and segments_count > p_segments_count then greatest(least((p_sga_ratio - coalesce(sga_ratio, 0.0)) / nullif(p_sga_ratio, 0) / nullif((segments_count - p_segments_count) / p_segments_count, 0) + 0.5, 1.0), 0.0) else 0.5 end",
    "capability": "case when p_rd_ratio > 0 then greatest(least((coalesce(rd_ratio, 0.0) - p_rd_ratio) / nullif(p_rd_ratio, 0) + 0.5, 1.0), 0.0) else coalesce(rd_ratio, 0.0) * 10 end",
    "strengthening": "least(coalesce(g_revenue, 0.0), 1.0) * 0.5 + greatest(least((case when p_op_ratio > 0 then (coalesce(op_ratio, 0.0) - p_op_ratio) / nullif(p_op_ratio, 0) else 0.0 end) + 0.5, 1.0), 0.0) * 0.5",
    "pricing": "least(coalesce(op_ratio, 0.0) * 5 * 0.5 + least(coalesce(g_revenue, 0.0), 1.0) * 0.5, 1.0)",
    "readiness": f"least(coalesce(software, 0.0) * 0.4 + least({_or('average_salary / 8000000', '0.5')}, 1.0) * 0.3 + coalesce(rd_ratio, 0.0) * 10 * 0.3, 1.0)",
}
# composites over composites or over the year windows of ``_windows``
FINAL: dict[str, str] = {
    "cost_flexibility": "case when variable_cost + coalesce(fixed_cost, 0.0) > 0 then variable_cost / nullif(variable_cost + coalesce(fixed_cost, 0.0), 0) else 0.5 end",
    "model_flexibility": "(variable_cost - coalesce(fixed_cost, 0.0) + 1) / 2",
    "risk_efficiency": f"{_or('cf_stability', '0.5')} * 0.6 + least({_or('interest_cover', '1.0')} / 10, 1.0) * 0.4",
    "moat": "least(coalesce(rd_ratio, 0.0) * 0.4 + coalesce(op_ratio, 0.0) * 0.4 + coalesce(revenue_stability, 0.0) * 0.2, 1.0)",
    "loyalty": f"{_or('revenue_stability', '0.5')} * 0.6 + least(coalesce(op_ratio, 0.0) * 5, 1.0) * 0.4",
    "market_fit": f"least(coalesce(g_revenue, 0.0) * 2, 1.0) * 0.6 + {_or('acquisition', '0.5')} * 0.4",
    "viral": f"{_or('acquisition', '0.5')} * (1 - least({_or('ad_ratio', '0.05')} * 20, 1.0))",
    "penetration": "least(coalesce(g_revenue, 0.0), 1.0) * 0.7 + least(abs(coalesce(overseas_change, 0.0)) * 5, 1.0) * 0.3",
    "channel": "least(greatest(coalesce(segments_count - p_segments_count, 0.0), 0.0) * 0.5 + least(abs(coalesce(overseas_change, 0.0)) * 5, 1.0) * 0.5, 1.0)",
    "recognition": f"{_or('acquisition', '0.5')} * 0.6 + least(coalesce(ad_ratio, 0.0) * 20, 1.0) * 0.4",
    "ecosystem": "partnership * 0.6 + coalesce(software, 0.0) * 0.4", "scalability": f"{_or('variable_cost', '0.5')} * 0.5 + coalesce(software, 0.0) * 0.5",
    "culture": f"{_or('innovation_frequency', '0.5')} * 0.5 + continuity * 0.5",
    "alignment": f"(case when p_revenue is null or abs(dividend_payout_ratio - p_dividend_payout_ratio) <= 0.1 then 1.0 else 0.7 end) * 0.3 + continuity * 0.4 + ({_or('revenue_stability', '0.5')} * 0.6 + least(coalesce(op_ratio, 0.0) * 5, 1.0) * 0.4) * 0.3",
    "retention_rate": _or("revenue_stability", "0.5"),
    "vision": f"{_or('innovation_frequency', '0.5')} * 0.6 + (case when p_revenue is null or abs(segments_count - p_segments_count) <= 1 then 1.0 else 0.7 end) * 0.4",
    "amplification": "case when past_differentiation > 0 then greatest(least((differentiation - past_differentiation) / nullif(past_differentiation, 0) + 0.5, 1.0), 0.0) else differentiation end",
    "opportunity": "coalesce(expansion_rate, 0.0) * 0.6 + greatest(least(coalesce(segments_count - p_segments_count, 0.0) / 2, 1.0), 0.0) * 0.4",
    "agility": "least(coalesce(rd_ratio, 0.0) * 10 * 0.4 + coalesce(diversification, 0.0) * 0.3 + (case when variable_cost + coalesce(fixed_cost, 0.0) > 0 then variable_cost / nullif(variable_cost + coalesce(fixed_cost, 0.0), 0) else 0.5 end) * 0.3, 1.0)",
    "legacy": "brand * 0.6 + coalesce(intangible, 0.0) * 0.4", "transformation": f"{_or('capability', '0.5')} * 0.6 + continuity * 0.4",
}

# fixed order of the measures behind the 23 ids of each family ("-" has no defined value)
FAMILIES: dict[str, list[str]] = {k: v.split() for k, v in {
    "rev": """tangible_fixed_assets capex rd_expenses intangible_fixed_assets investment_securities employees average_salary retirement welfare dividend_payout_ratio
      accounts_receivable inventories total_assets recv_turn inv_turn overseas_revenue_ratio segments_count sg_a_expenses advertising_expenses non_op age entry_timing dependency""",
    "growth": """g_capex g_rd_expenses g_tangible_fixed_assets g_intangible_fixed_assets g_total_assets g_intangible_fixed_assets g_employees g_average_salary g_personnel g_retirement
      overseas_change segment_growth g_sg_a_expenses g_advertising_expenses g_non_op g_accounts_receivable g_inventories g_recv_turn g_inv_turn g_asset_turn maturity_impact innovation_cycle expansion_rate""",
    "op_margin": """material labor_cost overhead outsourcing dep_cost sga_ratio sga_personnel ad_ratio rd_ratio sga_depreciation value_added labor_prod asset_eff asset_turn inv_turn revenue fixed_cost
      variable_cost overseas_revenue_ratio concentration position op_leverage cost_flexibility""",
    "net_margin": """op_ratio sga_ratio cost_ratio rd_ratio dep_revenue int_income_ratio int_expense_ratio fx_ratio equity_income non_op_ratio xprofit_ratio xloss_ratio tax_rate tax_adjust pretax
      debt_assets equity_ratio securities_gain disposal impairment leverage_impact risk_efficiency allocation""",
    "roe": """net_ratio asset_turn op_ratio cost_ratio sga_ratio equity_ratio assets_equity debt_equity cur_ratio fixed_equity recv_turn inv_turn asset_eff cash_assets securities_assets dividend_payout_ratio
      retention non_op_ratio x_impact tax_rate return_efficiency sustainability capital_trend""",
    "va": """rd_ratio intangible_revenue patent software license salary_ratio personnel_ratio staff_per_million retirement_ratio welfare_ratio one_less_cost one_less_material one_less_outsourcing labor_prod
      asset_eff overseas_revenue_ratio high_value service op_ratio intangible innovation differentiation chain""",
    "survival": """equity_ratio cur_ratio debt_service interest_cover cf_stability op_ratio roe revenue_stability profit_stability g_revenue rd_ratio model_flexibility adaptation diversification
      innovation_frequency moat brand loyalty supply compliance age_survival crisis agility""",
    "emergence": """capital_adequacy - timing novelty size_potential scaling acquisition market_fit unit_economics viral funding talent rd_intensity infrastructure partnership penetration differentiation
      pricing channel recognition ecosystem scalability resilience""",
    "succession": """planning transfer continuity culture alignment synergy integration retention_rate customer_retention disruption integration duplicates diffusion scale_economy scope_economy vision
      capability strengthening amplification opportunity readiness legacy transformation""",
}.items()}


# ---- year windows ------------------------------------------------------------------------

def _past(x: str, lo: int, hi: int = 0) -> Column:
    """Values of the calendar frame in year order (an array of at most hi - lo + 1 elements)."""
    return F.collect_list(F.struct(c("year").alias("y"), c(x).alias("v"))).over(years(lo, hi))


def _vals(a: str) -> Column:
    return F.transform(F.filter(c(a), lambda s: s["v"].isNotNull()), lambda s: s["v"])


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))


def _std(a: Column, m: Column) -> Column:
    """``m``: the mean, as a column of an earlier step; an expression would be worked out again for every element."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.nullif(F.size(a), F.lit(0)))


def _growths(a: str) -> Column:
    """Changes between neighbouring rows of the frame; both values non-zero and the earlier one positive."""
    idx = F.sequence(F.lit(1), F.size(a) - 1)
    pairs = F.when(F.size(a) > 1, F.transform(idx, lambda i: F.struct(F.get(c(a), i - 1)["v"].alias("p"), F.get(c(a), i)["v"].alias("v"))))
    ok = F.filter(F.coalesce(pairs, F.array().cast("array<struct<p:double,v:double>>")), lambda s: (s["p"] > 0) & (s["v"] != 0))
    return F.transform(ok, lambda s: (s["v"] - s["p"]) / F.nullif(s["p"], F.lit(0.0)))


def _slope(a: Column) -> Column:
    """OLS slope on the positions 0..n-1."""
    mid = (F.size(a) - 1) / 2.0
    num = F.aggregate(F.transform(a, lambda v, i: v * (i - mid)), F.lit(0.0), lambda s, v: s + v)
    n = F.size(a).cast("double")
    return num / F.nullif(n * (n * n - 1) / 12.0, F.lit(0.0))


def _power(a: Column, k: int) -> Column:
    ang = lambda i: 6.283185307179586 * k * i / F.size(a)
    re = F.aggregate(F.transform(a, lambda v, i: v * F.cos(ang(i))), F.lit(0.0), lambda s, v: s + v)
    im = F.aggregate(F.transform(a, lambda v, i: v * F.sin(ang(i))), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(re * re + im * im)


def _windows(d: DataFrame) -> DataFrame:
    d = d.select("*", _past("revenue", -5).alias("_rev5"), _past("operating_profit", -5).alias("_op5"), _past("cf_ratio", -5, -1).alias("_cf5"), _past("rd_ratio", -5).alias("_rd5"),
                 _past("rd_ratio", -7).alias("_rd7"), _past("rd_expenses", -3, -1).alias("_rde3"), _past("revenue", -3).alias("_rev3"), _past("roe", -3).alias("_roe3"),
                 _past("overseas_revenue_ratio", -3).alias("_ov3"), _past("op_ratio", -3).alias("_m3"), year_lag("op_ratio", 3).alias("_m_3"),
                 F.last("differentiation").over(years(-2, -1)).alias("past_differentiation"))
    d = d.select("*", _growths("_rev5").alias("_gr"), _growths("_op5").alias("_go"), _growths("_rde3").alias("_gd"), _growths("_rev3").alias("_g3"), _vals("_cf5").alias("_cf"), _vals("_rd5").alias("_rd"),
                 _vals("_rd7").alias("_r7"), _vals("_roe3").alias("_ro"), _vals("_ov3").alias("_ov"), _vals("_m3").alias("_mm"))
    d = d.select("*", *[_mean(c(x)).alias(f"_mean{x}") for x in ("_gr", "_go", "_cf", "_rd")])
    stable = lambda rows, g: F.when((F.size(rows) >= 4) & (F.size(g) >= 3), 1 / (1 + _std(c(g), c(f"_mean{g}"))))
    cf_m, cf_s = c("_mean_cf"), _std(c("_cf"), c("_mean_cf"))
    n7 = F.size("_r7")
    top = F.greatest(_power(c("_r7"), 1), F.when(n7 >= 6, _power(c("_r7"), 2)), F.when(n7 >= 8, _power(c("_r7"), 3)))
    d = d.select(
        *[x for x in d.columns if not x.startswith("_")],
        stable("_rev5", "_gr").alias("revenue_stability"), stable("_op5", "_go").alias("profit_stability"),
        F.when((F.size("_cf5") >= 3) & (F.size("_cf") >= 3) & (cf_m > 0) & (cf_s > 0), 1 / (1 + cf_s / F.nullif(cf_m, F.lit(0.0)))).alias("cf_stability"),
        F.when((F.size("_rd5") >= 4) & (F.size("_rd") >= 3), 0.5 / (1 + _std(c("_rd"), c("_mean_rd"))) + F.least(c("_mean_rd") * 10, F.lit(1.0)) * 0.5).alias("innovation_frequency"),
        F.when((F.size("_rde3") >= 2) & (F.size("_gd") > 0), clip(_mean(c("_gd")), 0, 1)).alias("adaptation"),
        F.when((F.size("_rev3") >= 3) & (F.size("_g3") >= 2), F.element_at("_g3", -1) - F.get("_g3", F.size("_g3") - 2)).alias("scaling"),
        F.when(F.size("_ro") >= 3, clip(_slope(c("_ro")) * 20 + 0.5, 0, 1)).alias("capital_trend"), F.when(F.size("_ov") >= 3, clip(_slope(c("_ov")) * 10, 0, 1)).alias("expansion_rate"),
        F.when(F.size("_mm") >= 3, clip(_slope(c("_mm")) * 20 + 0.5, 0, 1)).otherwise(0.5).alias("diffusion"),
        F.when(n7 >= 5, F.least(top / n7, F.lit(1.0))).alias("innovation_cycle"), F.when(c("_m_3") > 0, (c("op_ratio") - c("_m_3")) / F.nullif(c("_m_3"), F.lit(0.0))).alias("synergy"))
    return d


def measures(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """All named measures; ``rename`` maps another column vocabulary onto the canonical one."""
    d = df.withColumnsRenamed(rename) if rename else df
    for x, default in (("founding_year", None), ("succession_year", None)):
        d = d if x in d.columns else d.withColumn(x, F.lit(default).cast("int"))
    # in the order of the year windows, so that rows are sorted once
    d = d.withColumn("entry_year", F.min("year").over(W().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # before the windows only what they look back on: all row measures and the sort would be generated as one method, too
    # long for the JVM to compile
    formulas = lambda d, es: d.select("*", *[F.expr(e).cast("double").alias(k) for k, e in es.items()])
    d = formulas(d, {k: e for k, e in ROW.items() if k in PREVIOUS})
    d = d.select("*", *[year_lag(x).alias(f"p_{x}") for x in PREVIOUS])
    d = formulas(d, {k: e for k, e in ROW.items() if k not in PREVIOUS} | GROWTH)
    d = formulas(d, COMPOSITE)
    return formulas(_windows(d), FINAL)


def factors(df: DataFrame, families: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """Wide factor table.  A family is null where its denominator (revenue, or equity for roe) is zero;
    growth is null without a row for the year before."""
    m = measures(df, rename)
    out = []
    for fam in families or list(FAMILIES):
        ok = {"growth": c("p_revenue").isNotNull(), "roe": c("shareholders_equity") != 0, "survival": F.lit(True), "emergence": F.lit(True), "succession": F.lit(True)}.get(fam, c("revenue") != 0)
        out += [F.when(ok, F.lit(None).cast("double") if x == "-" else c(x)).alias(f"{fam}_{i:02d}") for i, x in enumerate(FAMILIES[fam], 1)]
    return m.select("company_id", "year", *out)


def factor_facts(wide: DataFrame) -> DataFrame:
    """Long (company_id, year, factor, value) facts."""
    cols = [x for x in wide.columns if x not in ("company_id", "year")]
    # unpivot would build a whole row per factor; here the wide row is read once and a factor is a place in its array
    at = wide.select("company_id", "year", F.posexplode(F.array(*cols)).alias("_at", "value"))
    return at.select("company_id", "year", F.element_at(F.array(*[F.lit(x) for x in cols]), c("_at") + 1).alias("factor"), "value")
