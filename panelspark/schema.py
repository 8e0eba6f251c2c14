"""Canonical schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _I, _L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()

AMOUNTS = """revenue cost_of_sales gross_profit sg_a_expenses operating_profit net_profit total_assets shareholders_equity
total_liabilities current_assets current_liabilities cash_and_deposits accounts_receivable inventories tangible_fixed_assets
intangible_fixed_assets rd_expenses advertising_expenses capex depreciation operating_cash_flow employees average_salary
overseas_revenue_ratio segments_count interest_income interest_expenses fx_gain_loss extraordinary_profit extraordinary_loss
tax_rate dividend_payout_ratio investment_securities retained_earnings""".split()

METRICS = """revenue revenue_growth operating_margin net_margin roe value_added_ratio survival_probability new_business_success
succession_score""".split()


def _table(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in spec])


_KEY = [("company_id", _L), ("year", _I)]

CATALOGUE: dict[str, T.StructType] = {
    "panel": _table(_KEY + [(x, _D) for x in AMOUNTS]),
    "entity": _table([("company_id", _L), ("company_name", _S), ("market", _S), ("industry_code", _S), ("status", _S), ("established", T.DateType()),
                      ("extinction", T.DateType()), ("parent_id", _L), ("start_year", _I), ("end_year", _I)]),
    "event": _table([("event_id", _L), ("company_id", _L), ("event_type", _S), ("event_date", T.DateType()), ("counterpart_id", _L), ("ownership_ratio", _D),
                     ("intensity", _D), ("attributes", T.MapType(_S, _S))]),
    "market_share": _table(_KEY + [("market", _S), ("share", _D), ("domestic_share", _D), ("rank", _I), ("market_size", _D)]),
    "survival": _table([("company_id", _L), ("market", _S), ("observation_start", T.DateType()), ("observation_end", T.DateType()), ("duration", _D), ("event", _I)]),
    "person_period": _table(_KEY + [("time_from_start", _I), ("event_occurred", _I), ("revenue", _D), ("margin", _D)]),
    "metrics": _table(_KEY + [(x, _D) for x in METRICS]),
    "metric_fact": _table(_KEY + [("metric", _S), ("value", _D)]),
    "factor_fact": _table(_KEY + [("factor", _S), ("value", _D)]),
    "finding": _table(_KEY + [("rule", _S), ("severity", _S), ("field", _S), ("value", _D)]),
    "outlier": _table(_KEY + [("metric", _S), ("value", _D), ("method", _S), ("severity", _D), ("confidence", _D), ("action", _S)]),
    "transition": _table([("company_id", _L), ("market", _S), ("year", _I), ("from_stage", _S), ("to_stage", _S), ("gap", _I)]),
    "forecast": _table([("company_id", _L), ("step", _I), ("year", _I), ("forecast", _D), ("lower", _D), ("upper", _D)]),
    "match": _table([("treated", _L), ("control", _L), ("distance", _D), ("rank", _I)]),
    "model_score": _table([("model", _S), ("run_id", _L), ("score", _D)]),
}
