"""Outcome metrics, ratios and scores (inventory M1-M32, IO1)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..operators import metrics as m
from ..sources import derive as d
from .registry import query

W = "WINDOW w AS (PARTITION BY company_id ORDER BY year)"
K = "company_id year"


def lagged(x, k=1):
    return f"lag({x},{k}) OVER (PARTITION BY company_id ORDER BY year)"


def gr(x, k=1):
    return f"({x}/nullif({lagged(x, k)},0)-1)"


def clipped(x, lo, hi):
    return f"least(greatest({x},{lo}),{hi})"


def nn(x, body):
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {body} END"


def nz(a, b):
    return f"coalesce(({a})/nullif({b},0),0)"


def th01(x):
    return f"(tanh({x})*0.5+0.5)"


@query("financial_panel", "IO1 J1", K, "revenue operating_profit total_assets average_salary tax_rate",
       "SELECT company_id, year, revenue, operating_profit, total_assets, average_salary, tax_rate FROM panel")
def _(spark, sf):
    return d.panel(spark, sf)


@query("outcome_metrics", "M1 M2 M3 M4 M5 M6 M10", K,
       "revenue_alive revenue_growth operating_margin net_margin roe value_added_ratio",
       f"""SELECT company_id, year,
  CASE WHEN extinction IS NULL OR year <= year(extinction) THEN revenue END AS revenue_alive,
  CASE WHEN NOT (year = start_year OR (parent_id IS NOT NULL AND year <= start_year)) THEN {gr('revenue')} END AS revenue_growth,
  {nn('revenue', clipped('operating_profit/revenue*100', -100, 100))} AS operating_margin,
  {nn('revenue', clipped('net_profit/revenue*100', -200, 200))} AS net_margin,
  CASE WHEN shareholders_equity <> 0 THEN {clipped('net_profit/shareholders_equity*100', -500, 500)} END AS roe,
  {nn('revenue', clipped('(revenue-cost_of_sales)/revenue*100', 0, 100))} AS value_added_ratio FROM mpanel""")
def _(spark, sf):
    return m.with_metrics(d.mpanel(spark, sf), "revenue_alive", "revenue_growth", "operating_margin", "net_margin",
                          "roe", "value_added_ratio")


Z = ("(1.2*(current_assets-current_liabilities)/total_assets+1.4*retained_earnings/total_assets"
     "+3.3*operating_profit/total_assets+0.6*shareholders_equity/nullif(total_assets-shareholders_equity,0)"
     "+revenue/total_assets)")


@query("survival_probability_by_z", "M7 M21", f"{K} band", "survival_probability altman_z",
       f"""SELECT company_id, year, {Z} AS altman_z, CASE WHEN {Z} < 1.8 THEN 2 WHEN {Z} < 3.0 THEN 1 ELSE 0 END AS band,
  CASE WHEN extinction IS NOT NULL AND year > year(extinction) THEN 0
       ELSE 100/(1+exp(-({Z}))) END AS survival_probability FROM mpanel""")
def _(spark, sf):
    p = m.with_metrics(d.mpanel(spark, sf), "survival_probability", "altman_z")
    return p.withColumn("band", m.altman_bands(F.col("altman_z")))


def step(x, hi, lo):
    return f"CASE WHEN {x} > {hi} THEN 1.0 WHEN {x} > {lo} THEN 0.5 ELSE 0.0 END"


@query("new_business_success", "M8", K, "new_business_success",
       f"""SELECT company_id, year, ({step(gr('revenue'), 0.1, 0)}*0.3 + {step('operating_profit/revenue', 0.05, 0)}*0.3
  + {step('rd_expenses/revenue', 0.03, 0.01)}*0.2 + CASE WHEN segments_count > 1 THEN 0.5 ELSE 0 END*0.2)
  * least((year-start_year)/5.0, 1.0) * 100 AS new_business_success FROM mpanel""")
def _(spark, sf):
    return m.with_metrics(d.mpanel(spark, sf), "new_business_success")


@query("succession_score", "M9", K, "succession_score",
       f"""SELECT company_id, year, CASE WHEN parent_id IS NULL THEN 50 ELSE least((year-start_year)/3.0,1.0)*100*(
   CASE WHEN m3-lag(m3) OVER w > 0 THEN 1.0 WHEN m3-lag(m3) OVER w >= -1 THEN 0.5 ELSE 0 END*0.3
  +CASE WHEN t3-lag(t3) OVER w > 0 THEN 1.0 WHEN t3-lag(t3) OVER w >= -0.05 THEN 0.5 ELSE 0 END*0.25
  +{step('g3', 0.05, 0)}*0.25 + CASE WHEN v5 < mp*0.2 THEN 1.0 ELSE 0.5 END*0.2) END AS succession_score
FROM (SELECT *, avg(g) OVER (PARTITION BY company_id ORDER BY year ROWS 2 PRECEDING) AS g3 FROM (
  SELECT *, {gr('revenue')} AS g,
  avg(operating_profit/revenue*100) OVER (PARTITION BY company_id ORDER BY year ROWS 2 PRECEDING) AS m3,
  avg(revenue/total_assets) OVER (PARTITION BY company_id ORDER BY year ROWS 2 PRECEDING) AS t3,
  stddev_samp(operating_profit) OVER (PARTITION BY company_id ORDER BY year ROWS 4 PRECEDING) AS v5,
  avg(operating_profit) OVER (PARTITION BY company_id) AS mp FROM mpanel)) {W}""")
def _(spark, sf):
    return m.with_succession_score(d.mpanel(spark, sf))


@query("growth_and_cagr", "M11 M12 M14", K, "log_revenue revenue_per_employee growth_2 cagr_3 operating_leverage",
       f"""SELECT company_id, year, ln(revenue) AS log_revenue, revenue/employees AS revenue_per_employee,
  {gr('revenue', 2)} AS growth_2, pow(revenue/{lagged('revenue', 3)}, 1.0/3)-1 AS cagr_3,
  {gr('operating_profit')}/nullif({gr('revenue')},0) AS operating_leverage FROM panel""")
def _(spark, sf):
    return m.with_metrics(d.panel(spark, sf), "log_revenue", "revenue_per_employee", "growth_2", "cagr_3",
                          "operating_leverage")


@query("rolling_volatility", "M13", K, "growth_volatility margin_stability margin_trend",
       f"""SELECT company_id, year, CASE WHEN count(g) OVER w >= 3 THEN stddev_samp(g) OVER w END AS growth_volatility,
  CASE WHEN count(mg) OVER w >= 3 THEN stddev_samp(mg) OVER w END AS margin_stability,
  CASE WHEN count(mg) OVER w >= 3 THEN avg(mg) OVER w END AS margin_trend
FROM (SELECT *, {gr('revenue')} AS g, operating_profit/revenue AS mg FROM panel)
WINDOW w AS (PARTITION BY company_id ORDER BY year ROWS 2 PRECEDING)""")
def _(spark, sf):
    return m.rolling_pack(d.panel(spark, sf))


PROD = ("value_added labor_productivity capital_productivity labor_share depreciation_share profit_share "
        "profit_quality net_profit_margin asset_turnover equity_multiplier roe_dupont sustainable_growth")


@query("dupont_and_productivity", "M15 M16", K, PROD,
       """SELECT *, va AS value_added, va/employees AS labor_productivity, va/tangible_fixed_assets AS capital_productivity,
  employees*average_salary/nullif(va,0) AS labor_share, depreciation/nullif(va,0) AS depreciation_share,
  operating_profit/nullif(va,0) AS profit_share, net_profit/nullif(operating_profit,0) AS profit_quality,
  net_profit/revenue AS net_profit_margin, revenue/total_assets AS asset_turnover,
  total_assets/nullif(shareholders_equity,0) AS equity_multiplier,
  net_profit/revenue*(revenue/total_assets)*(total_assets/nullif(shareholders_equity,0)) AS roe_dupont,
  net_profit/nullif(shareholders_equity,0)*(1-dividend_payout_ratio) AS sustainable_growth
FROM (SELECT *, revenue-cost_of_sales AS va FROM panel)""")
def _(spark, sf):
    return m.with_metrics(d.panel(spark, sf), *PROD.split())


RATIOS = ("gross_margin debt_ratio current_ratio interest_coverage inventory_turnover receivables_turnover "
          "rd_intensity capex_intensity")


@query("ratio_pack", "M18", K, RATIOS,
       """SELECT *, gross_profit/revenue AS gross_margin, total_liabilities/total_assets AS debt_ratio,
  current_assets/nullif(current_liabilities,0) AS current_ratio, operating_profit/nullif(interest_expenses,0) AS interest_coverage,
  cost_of_sales/nullif(inventories,0) AS inventory_turnover, revenue/nullif(accounts_receivable,0) AS receivables_turnover,
  rd_expenses/revenue AS rd_intensity, capex/revenue AS capex_intensity FROM panel""")
def _(spark, sf):
    return m.with_metrics(d.panel(spark, sf), *RATIOS.split())


DESC = ["revenue", "operating_profit", "net_profit"]


@query("metric_describe", "M17 G13", "metric n", "mean std lo hi", "\nUNION ALL ".join(
    f"SELECT '{x}' AS metric, count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS lo, max({x}) AS hi FROM panel"
    for x in DESC))
def _(spark, sf):
    from ..functions.ranks import long

    return long(d.panel(spark, sf), ["company_id"], DESC).groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))


QUICK = nz("current_assets-inventories", "current_liabilities")
LIQ = th01(f"({nz('current_assets','current_liabilities')}-1)*0.5+({QUICK}-0.8)*0.7+({nz('cash_and_deposits','current_liabilities')}-0.2)*1.0")
PROF = th01(f"{nz('net_profit','shareholders_equity')}*10+{nz('net_profit','total_assets')}*15+{nz('operating_profit','revenue')}*8")
LEV = th01(f"(1-{nz('total_liabilities','total_assets')})*2+ln(1+greatest({nz('operating_profit','interest_expenses')},-0.999))*0.3")
EFF = th01(f"{nz('revenue','total_assets')}+ln(1+{nz('cost_of_sales','inventories')})*0.2")


@query("survival_score_blocks", "M19", K, "liquidity profitability leverage efficiency survival_score",
       f"""SELECT *, (liquidity+profitability+leverage+efficiency)*0.25 AS survival_score FROM (
  SELECT company_id, year, {LIQ} AS liquidity, {PROF} AS profitability, {LEV} AS leverage, {EFF} AS efficiency FROM panel)""")
def _(spark, sf):
    p = d.panel(spark, sf)
    return p.select("*", *[v.alias(k) for k, v in m.survival_blocks().items()]).withColumn(
        "survival_score", m.survival_score())


@query("extinction_and_continuity", "M20", K, "extinction_risk exit_probability continuity_index",
       f"""SELECT company_id, year,
  25*({clipped(f"1-tanh(operating_cash_flow/1e8+{nz('operating_cash_flow','revenue')}*10)", 0, 1)}
   + {clipped(f"tanh({nz('interest_expenses','operating_cash_flow')}*2+coalesce({gr('total_liabilities')},0))", 0, 1)}
   + 0.5 + {clipped("coalesce(stddev_pop(revenue) OVER e/avg(revenue) OVER e,0)*3+(sg_a_expenses+depreciation)/revenue*0.5", 0, 1)}) AS extinction_risk,
  ({clipped(f"(1-0.1)*0.7+0.0*0.3", 0, 1)} + {clipped(f"(1-net_profit/revenue/0.2)*0.6+(0.05-rd_expenses/revenue)*10", 0, 1)}
   + 1 - {th01(f"cash_and_deposits/revenue*5+{nz('operating_cash_flow','total_liabilities')}*2")})/3 AS exit_probability,
  25*({clipped(f"shareholders_equity/total_assets+tanh(({nz('current_assets','current_liabilities')}-1)*2)*0.3", 0, 1)}
   + {clipped(f"tanh(coalesce({gr('revenue')},0)+coalesce({gr('net_profit')},0))*0.4+tanh(capex/revenue*10)*0.6", 0, 1)}
   + {clipped("tanh(revenue/total_assets)*0.5+tanh(revenue/employees/1e6)*0.5", 0, 1)}
   + {clipped("tanh(rd_expenses/revenue*20)*0.6+overseas_revenue_ratio*0.4", 0, 1)}) AS continuity_index
FROM panel WINDOW e AS (PARTITION BY company_id)""")
def _(spark, sf):
    p = m.extinction_risk_index(d.panel(spark, sf))
    return p.select("*", m.exit_probability(F.lit(0.1), F.lit(0.0), sd("net_profit", "revenue") / 0.2)
                    .alias("exit_probability"), m.continuity_index().alias("continuity_index"))


def fl(x):
    return f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"


FLAGS = [fl("current_assets/nullif(current_liabilities,0) < 1"), fl("total_liabilities/nullif(shareholders_equity,0) > 3"),
         fl("operating_profit/revenue < -0.05"), fl("operating_profit/nullif(interest_expenses,0) < 1.5")]


@query("risk_flags_and_outlook", "M22 M24", f"{K} risk_level",
       "risk_flag_mean survival_1y survival_3y survival_5y years_to_extinction",
       f"""SELECT *, CASE WHEN r < .1 THEN 'very_low' WHEN r < .25 THEN 'low' WHEN r < .5 THEN 'medium' WHEN r < .75 THEN 'high' WHEN r < .9 THEN 'very_high'
    ELSE 'critical' END AS risk_level, CASE WHEN r < .3 THEN NULL WHEN survival_1y < .5 THEN 1 WHEN survival_3y < .5 THEN 3
    WHEN survival_5y < .5 THEN 5 ELSE ln(2.0)/(-ln(survival_5y)/5) END AS years_to_extinction
FROM (SELECT *, r AS risk_flag_mean, 1-r*.3 AS survival_1y, pow(1-r*.3,3.0) AS survival_3y, pow(1-r*.3,5.0) AS survival_5y
  FROM (SELECT company_id, year, ({'+'.join(FLAGS)})/4 AS r FROM panel))""")
def _(spark, sf):
    p = m.risk_flags(d.panel(spark, sf))
    return p.select("*", *[v.alias(k) for k, v in m.risk_outlook(F.col("risk_flag_mean")).items()])


@query("latest_distress", "M23 G5", "company_id year", "distress",
       """SELECT company_id, year, greatest(0, least(current_assets/nullif(current_liabilities,0),3)*.3
   + revenue/total_assets*.3 + net_profit/total_assets*4) AS distress FROM panel
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC) = 1""")
def _(spark, sf):
    return m.distress_latest(d.panel(spark, sf))


STG = "burn_rate runway_months investment_efficiency traction scaling leverage distress_count bankruptcy_pct"
ZL = ("((current_assets-current_liabilities)/total_assets*1.2+retained_earnings/total_assets*1.4"
      "+operating_profit/total_assets*3.3+revenue/total_assets)")


@query("stage_specific_features", "M28", K, STG,
       f"""SELECT *, CASE WHEN burn_rate > 0 THEN cash_and_deposits/burn_rate END AS runway_months,
   g/nullif(capex/revenue*100,0) AS investment_efficiency, g AS traction, g/nullif(cg,0) AS scaling, og/nullif(g,0) AS leverage,
   CASE WHEN z > 2.99 THEN 5 WHEN z > 1.81 THEN 20 ELSE 50 END AS bankruptcy_pct
FROM (SELECT *, coalesce(-operating_cash_flow/nullif(cash_and_deposits,0)*12,0) AS burn_rate, {gr('revenue')} AS g,
   {gr('cost_of_sales')} AS cg, {gr('operating_profit')} AS og, {ZL} AS z,
   {fl('current_assets/nullif(current_liabilities,0)<1')}+{fl('operating_profit/revenue<0')}
   +{fl('total_liabilities/total_assets*100>70')}+{fl('operating_cash_flow<0')} AS distress_count FROM panel)""")
def _(spark, sf):
    return m.stage_features(d.panel(spark, sf))


@query("category_features", "M29", K, "f_rd_intensity f_pricing_power f_leadership f_scale",
       """SELECT company_id, year, rd_expenses/revenue AS f_rd_intensity, gross_profit/revenue AS f_pricing_power,
  revenue/employees AS f_leadership, ln(total_assets) AS f_scale FROM panel""")
def _(spark, sf):
    return m.category_features(d.panel(spark, sf))


@query("interaction_features", "M30", K,
       "rd_expenses_x_intangible_fixed_assets employees_x_average_salary rd_expenses_per_capex capex_per_inventories "
       "capex_sq employees_sqrt rd_expenses_x_capex_x_employees rd_expenses_young capex_mature rd_expenses_global capex_domestic",
       f"""SELECT company_id, year, rd_expenses*intangible_fixed_assets AS rd_expenses_x_intangible_fixed_assets,
  employees*average_salary AS employees_x_average_salary, rd_expenses/capex AS rd_expenses_per_capex,
  CASE WHEN inventories = 0 THEN NULL ELSE capex/inventories END AS capex_per_inventories, capex*capex AS capex_sq,
  sqrt(employees) AS employees_sqrt, rd_expenses*capex*employees AS rd_expenses_x_capex_x_employees,
  rd_expenses*{fl('year-start_year<3')} AS rd_expenses_young, capex*{fl('year-start_year>=5')} AS capex_mature,
  rd_expenses*{fl('overseas_revenue_ratio>.5')} AS rd_expenses_global, capex*{fl('overseas_revenue_ratio<=.2')} AS capex_domestic
FROM mpanel""")
def _(spark, sf):
    p = m.interactions(
        d.mpanel(spark, sf),
        products=[("rd_expenses", "intangible_fixed_assets"), ("employees", "average_salary")],
        ratios=[("rd_expenses", "capex"), ("capex", "inventories")], squares=["capex"], roots=["employees"],
        triples=[("rd_expenses", "capex", "employees")], gates=m.age_gates(3, 5), gated=["rd_expenses", "capex"])
    return p.withColumn("capex_per_inventories", F.when(F.col("inventories") != 0, F.col("capex_per_inventories")))


@query("ensemble_features", "M31", K, "log_age age_sq mature_flag market_weight assets_building rd_margin",
       f"""SELECT company_id, year, ln(1+year-start_year) AS log_age, (year-start_year)*(year-start_year) AS age_sq,
  {fl('year-start_year>4')} AS mature_flag, CASE market WHEN 'MACHINERY' THEN 1.2 WHEN 'BUILDING' THEN 1.5 ELSE 1 END AS market_weight,
  {fl("market='BUILDING'")}*total_assets AS assets_building, rd_expenses/revenue*(operating_profit/revenue) AS rd_margin FROM mpanel""")
def _(spark, sf):
    return m.ensemble_features(d.mpanel(spark, sf), {"MACHINERY": 1.2, "BUILDING": 1.5}, mature=4)


@query("filtered_panel", "M32 IO3 J11", f"{K} market", "revenue",
       """SELECT company_id, year, market, revenue FROM mpanel WHERE market IN ('BUILDING','MACHINERY')
  AND status='active' AND year BETWEEN 1997 AND 2000
  AND company_id IN (SELECT company_id FROM ledger WHERE event_type='spinoff') AND year > 1998""")
def _(spark, sf):
    ids = d.ledger(spark, sf).where("event_type = 'spinoff'").select("company_id")
    return m.select_panel(d.mpanel(spark, sf), markets=["BUILDING", "MACHINERY"], status="active", years=(1997, 2000),
                          ids=ids, recent=3, last_year=2001)


@query("market_share_panel", "IO1 J12", "company_id market year", "sales share", "SELECT * FROM market_share")
def _(spark, sf):
    return d.market_share(spark, sf)


@query("survival_table", "U1", "company_id market duration event", "balance", "SELECT * FROM surv")
def _(spark, sf):
    return d.survival(spark, sf)


@query("stage_panel", "L1 L3", "company_id year stage", "g", "SELECT * FROM stages")
def _(spark, sf):
    return d.stages(spark, sf)
