"""Extinction feature and maturity queries (inventory T14-T17, M25, U24, E12, E16)."""

from pyspark.sql import functions as F

from ..operators import emergence as e
from ..operators import extinction as x
from ..operators import survival as s
from ..session import reliable
from ..sources import derive as d
from .emergence import pre_post, spin
from .registry import query
from .survival import selected

c = F.col
PW = "PARTITION BY company_id ORDER BY year"
W3 = f"({PW} ROWS 2 PRECEDING)"
RT = "rt AS (SELECT *, row_number() OVER (" + PW + ") AS i, " + ", ".join(f"{a}/nullif({b},0) AS {k}" for k, (a, b) in x.RATIOS.items()) + " FROM comp)"


def ch(v, k):
    return f"({v}-lag({v},{k}) OVER ({PW}))/(lag({v},{k}) OVER ({PW})+1e-6)"


def full3(agg, v, k=3):
    return f"CASE WHEN count({v}) OVER {W3}>={k} THEN {agg}({v}) OVER {W3} END"


def fl(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


@query("extinction_health", "T14 T9", "company_id year", "equity_ratio_decline equity_ratio_volatility debt_ratio_surge current_ratio_deterioration insolvency net_assets_trend interest_burden_increase", f"""WITH {RT}
SELECT company_id, year, {ch('equity_ratio', 2)} AS equity_ratio_decline, {full3('stddev_samp', 'equity_ratio')} AS equity_ratio_volatility, {ch('debt_ratio', 2)} AS debt_ratio_surge, (1.5-current_ratio)/1.5 AS current_ratio_deterioration,
 {fl('shareholders_equity<0')} AS insolvency, CASE WHEN count(shareholders_equity) OVER {W3}>=3 THEN regr_slope(shareholders_equity,i) OVER {W3} END AS net_assets_trend, {ch('interest_burden', 2)} AS interest_burden_increase FROM rt""", digits=5)
def _(spark, sf):
    return x.extinction_features(d.competition(spark, sf), ["health"])


@query("extinction_deterioration", "T14 T10", "company_id year", "margin_decline revenue_decline_trend revenue_deceleration roe_deterioration roa_negative gross_margin_compression loss_periods", f"""WITH {RT},
 n AS (SELECT *, lag(op_margin,1) OVER w AS m1, lag(op_margin,2) OVER w AS m2, lag(op_margin,3) OVER w AS m3, lag(revenue,1) OVER w AS r1, lag(revenue,2) OVER w AS r2, last_value(CASE WHEN net_profit>=0 THEN i END IGNORE NULLS) OVER ({PW} ROWS UNBOUNDED PRECEDING) AS lo, {full3('avg', 'gross_margin')} AS gm FROM rt WINDOW w AS ({PW}))
SELECT company_id, year, {fl('op_margin<m1 AND m1<m2 AND m2<m3')} AS margin_decline, {fl('revenue<r2')} AS revenue_decline_trend, (revenue/r1-1)-(r1/r2-1) AS revenue_deceleration, (.08-roe_r)/.08 AS roe_deterioration, {fl('roa<0')} AS roa_negative,
 (gm-gross_margin)/(gm+1e-6) AS gross_margin_compression, i-coalesce(lo,0) AS loss_periods FROM n""", digits=5)
def _(spark, sf):
    return x.extinction_features(d.competition(spark, sf), ["deterioration"])


@query("extinction_composites", "T14", "company_id year", "composite_extinction_risk health_composite continuity_risk leverage_crisis coverage_crisis current_crisis", f"""WITH {RT}, f AS (SELECT company_id, year, {fl('shareholders_equity<0')} AS ins, {fl('roa<0')} AS neg, {fl('current_ratio<.8')} AS current_crisis, {fl('de_ratio>2')} AS leverage_crisis, {fl('coverage<1.5')} AS coverage_crisis,
 {fl(f'revenue<lag(revenue,2) OVER ({PW})')} AS dec FROM rt) SELECT *, (ins+neg+current_crisis+leverage_crisis+coverage_crisis)/5.0 AS composite_extinction_risk, (ins+leverage_crisis+coverage_crisis)/3.0 AS health_composite, (neg+dec+current_crisis)/3.0 AS continuity_risk FROM f""")
def _(spark, sf):
    return x.extinction_features(d.competition(spark, sf))


@query("extinction_families_profile", "T14", "feature n", "mean")
def _(spark, sf):
    """All nine families in long form, summarized."""
    t = x.extinction_features(d.competition(spark, sf)).select("company_id", *x.FEATURES)
    return t.unpivot(["company_id"], list(x.FEATURES), "feature", "v").groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


@query("extinction_probability_features", "T15 M21", "company_id year z_band", "equity_ratio_trend equity_ratio_worsening cash_exhaustion decline_persistence", f"""WITH {RT}, t AS (SELECT *, CASE WHEN count(equity_ratio) OVER {W3}>=3 THEN regr_slope(equity_ratio,i) OVER {W3} END AS tr, operating_cash_flow-capex AS fcf, {fl(f'revenue/lag(revenue) OVER ({PW})-1 < -.05')} AS dc,
 1.2*(current_assets-current_liabilities)/total_assets+1.4*retained_earnings/total_assets+3.3*operating_profit/total_assets+.6*shareholders_equity/nullif(total_assets-shareholders_equity,0)+revenue/total_assets AS z FROM rt)
SELECT company_id, year, CASE WHEN z<1.8 THEN 2 WHEN z<3 THEN 1 ELSE 0 END AS z_band, tr AS equity_ratio_trend, CASE WHEN tr-lag(tr) OVER ({PW}) IS NOT NULL THEN least(0,greatest(-1,tr-lag(tr) OVER ({PW}))) END AS equity_ratio_worsening,
 CASE WHEN count(fcf) OVER {W3}>=3 AND sum(fcf) OVER {W3}<0 THEN 1 ELSE 0 END AS cash_exhaustion, CASE WHEN count(dc) OVER {W3}>=3 THEN sum(dc) OVER {W3} END AS decline_persistence FROM t""", digits=5)
def _(spark, sf):
    return x.probability_features(d.competition(spark, sf))


@query("early_warnings", "T15", "company_id year", "quality_gap roa_declining share_weakening investment_decline", f"""WITH {RT} SELECT company_id, year, operating_cash_flow-net_profit AS quality_gap, CASE WHEN count(roa) OVER {W3}>=3 AND regr_slope(roa,i) OVER {W3}<-.01 THEN 1 ELSE 0 END AS roa_declining,
 CASE WHEN count(share) OVER {W3}>=3 AND regr_slope(share,i) OVER {W3}<0 THEN 1 ELSE 0 END AS share_weakening, {fl(f'(revenue/lag(revenue) OVER ({PW})-1)/(capex/lag(capex) OVER ({PW})-1+1e-6)<0')} AS investment_decline FROM rt""")
def _(spark, sf):
    return x.early_warnings(d.competition(spark, sf))


@query("hazard_indicators", "T16", "company_id year", "deterioration risk_accumulation competitiveness resilience warnings", f"""WITH {RT}, f AS (SELECT *, {fl(f'op_margin<lag(op_margin) OVER ({PW})')} AS dd, {fl('debt_ratio>.7')}+{fl('current_ratio<1')}+{fl('roa<0')} AS rr FROM rt)
SELECT company_id, year, avg(dd) OVER {W3} AS deterioration, sum(rr) OVER {W3} AS risk_accumulation, avg(rd_r) OVER {W3} AS competitiveness, avg(equity_ratio) OVER {W3} AS resilience, rr AS warnings FROM f""")
def _(spark, sf):
    return x.hazard_indicators(d.competition(spark, sf))


@query("time_varying_features", "T17", "company_id year", "revenue_change revenue_trend revenue_risk", f"""WITH r AS (SELECT *, row_number() OVER ({PW}) AS i FROM panel) SELECT company_id, year, revenue/lag(revenue) OVER ({PW})-1 AS revenue_change,
 CASE WHEN count(revenue) OVER {W3}>=3 THEN regr_slope(revenue,i) OVER {W3} END AS revenue_trend, {full3('stddev_samp', 'revenue')} AS revenue_risk FROM r""")
def _(spark, sf):
    return x.time_varying(d.panel(spark, sf), ["revenue"])


@query("maturity_dimensions", "M25", "company_id year phase", "mat_financial mat_investment mat_organization mat_market mat_technology maturity velocity")
def _(spark, sf):
    return x.maturity_dimensions(d.panel(spark, sf))


@query("succession_factors", "E16", "factor n", "r importance")
def _(spark, sf):
    sc = e.integration_score(pre_post(spark, sf), e.share_change(d.staged(spark, sf), spin(spark, sf)))
    return e.succession_factors(sc, d.staged(spark, sf), ["margin", "rd_ratio", "debt"])


@query("correction_effectiveness", "U24", "", "normality_p t_p corr levene_p score")
def _(spark, sf):
    # weighed, joined and read again by every statistic
    z = reliable(selected(spark, sf).select("company_id", "alive", "balance_k", "returns", "margin"))
    w = s.ipw(z, "alive", ["balance_k", "returns"], "logistic").select("company_id", "weight")
    z = z.join(w, "company_id", "left").withColumn("corrected", c("margin") * F.coalesce("weight", F.lit(1.0)))
    return s.correction_effectiveness(z, "margin", "corrected", "alive")
