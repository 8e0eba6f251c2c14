"""Market structure and competition queries (inventory K1-K33)."""

from pyspark.sql import functions as F

from ..functions.windows import latest_rows
from ..operators import market as k
from ..operators import responses
from ..sources import derive as d
from .registry import query

c = F.col
PW = "PARTITION BY company_id ORDER BY year"


@query("market_concentration", "K1 K2 K3", "market year participants level", "hhi cr", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY market, year ORDER BY sales DESC, company_id) AS rn FROM market_share),
 g AS (SELECT market, year, count(*) AS participants, sum(pow(share*100,2)) AS hhi, sum(CASE WHEN rn<=3 THEN share END) AS cr FROM r GROUP BY 1,2) SELECT *, CASE WHEN hhi>2500 THEN 'high' WHEN hhi>1500 THEN 'moderate' ELSE 'low' END AS level FROM g""", digits=5)
def _(spark, sf):
    g = k.concentration(d.market_share(spark, sf), ["market", "year"], "sales", 3, 100.0)
    return g.withColumn("level", k.concentration_class(c("hhi")))


ATTR = [("AUTOMOBILE", .9, .8, .6, .7, 4.0), ("BUILDING", .4, .5, .5, .8, 8.0), ("FURNITURE", .3, .6, .2, .6, 6.0), ("HOUSEHOLD", .5, .7, .3, .5, 3.0), ("MACHINERY", .8, .9, .7, .4, 5.0)]


def attributes(spark):
    return spark.createDataFrame(ATTR, "market string, tech_intensity double, competition_level double, entry_barriers double, maturity double, cycle_years double")


AT = "mkat(market, t, k, b, m, cy) AS (VALUES " + ", ".join(str(r) for r in ATTR) + ")"


@query("market_attributes", "K4 K3", "company_id year structure", "competition_intensity tech_competition price_pressure innovation_pressure rd_necessity obsolescence_risk innovation_defence adaptation_score", f"""
WITH {AT}, h AS (SELECT market, year, sum(pow(share/100,2)) AS hhi FROM comp GROUP BY 1,2) SELECT company_id, year, k*(1-b) AS competition_intensity, t/(k+.01) AS tech_competition, (1-b)*k AS price_pressure, t/(cy+1) AS innovation_pressure,
 t*(1-m)*k AS rd_necessity, (1-t)/(cy+1)*k AS obsolescence_risk, t*b*(1-k) AS innovation_defence, (t+t*(1-m)*k+t*b*(1-k))/3 AS adaptation_score,
 CASE WHEN hhi>.25 THEN 'x' WHEN hhi>.15 THEN 'y' WHEN k>.8 THEN 'perfect_competition' ELSE 'fragmented' END AS structure FROM comp JOIN mkat USING (market) JOIN h USING (market, year)""")
def _(spark, sf):
    p = d.competition(spark, sf)
    h = p.groupBy("market", "year").agg(F.sum(F.pow(c("share") / 100, F.lit(2.0))).alias("hhi"))
    x = k.market_attributes(p, attributes(spark)).join(h, ["market", "year"])
    return x.withColumn("structure", k.competition_structure(c("hhi"), c("entry_barriers"), c("competition_level")))


@query("market_position", "K5 R4", "company_id year sales_rank entry_order", "sales_percentile leader position_score timing_fit", f"""
WITH {AT}, e AS (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY start_year) AS entry_order, dense_rank() OVER (PARTITION BY market, year ORDER BY revenue DESC) AS sales_rank,
  (rank() OVER (PARTITION BY market, year ORDER BY revenue)+(count(*) OVER (PARTITION BY market, year, revenue)-1)/2.0)/count(*) OVER (PARTITION BY market, year) AS pct, count(*) OVER (PARTITION BY market, year) AS n FROM mpanel)
SELECT company_id, year, cast(sales_rank AS bigint) AS sales_rank, cast(entry_order AS bigint) AS entry_order, pct AS sales_percentile, CASE WHEN sales_rank<=3 THEN 1 ELSE 0 END AS leader,
 pct*.4+CASE WHEN entry_order<=3 THEN .3 ELSE 0 END+CASE WHEN sales_rank<=3 THEN .3 ELSE 0 END AS position_score,
 greatest(0, CASE WHEN m<.3 THEN 1-(entry_order-1)*1.0/n WHEN m<.7 THEN 1-abs(entry_order-n*.3)/n ELSE 1-(entry_order-1)/3.0 END) AS timing_fit FROM e JOIN mkat USING (market)""")
def _(spark, sf):
    p = d.mpanel(spark, sf)
    n = p.groupBy("market", "year").agg(F.count(F.lit(1)).alias("n"))
    x = k.market_position(p).join(attributes(spark), "market").join(n, ["market", "year"])
    return x.withColumn("timing_fit", k.timing_fit(c("maturity"), c("entry_order"), c("n")))


@query("market_dynamics", "K6 K29", "market year participants age concentration_trend growth_stage", "hhi entry_rate hhi_change mean_growth", """
WITH g AS (SELECT market, year, count(*) AS participants, sum(revenue*revenue)/pow(sum(revenue),2) AS hhi, avg(growth) AS mean_growth FROM comp GROUP BY 1,2),
 x AS (SELECT *, cast(year-min(year) OVER (PARTITION BY market) AS int) AS age, participants*1.0/lag(participants) OVER w-1 AS entry_rate, hhi/lag(hhi) OVER w-1 AS hhi_change FROM g WINDOW w AS (PARTITION BY market ORDER BY year))
SELECT *, CASE WHEN hhi_change>.05 THEN 'concentrating' WHEN hhi_change<-.05 THEN 'fragmenting' ELSE 'stable' END AS concentration_trend,
 CASE WHEN mean_growth>20 THEN 'introduction' WHEN mean_growth>10 THEN 'growth' WHEN mean_growth>2 THEN 'maturity' ELSE 'decline' END AS growth_stage FROM x""")
def _(spark, sf):
    return k.market_dynamics(d.competition(spark, sf))


@query("shift_periods", "K6", "company_id year in_shift", "", "SELECT company_id, year, CASE WHEN (market='AUTOMOBILE' AND year BETWEEN 1997 AND 1999) OR (market='MACHINERY' AND year BETWEEN 1996 AND 1997) THEN 1 ELSE 0 END AS in_shift FROM mpanel")
def _(spark, sf):
    p = spark.createDataFrame([("AUTOMOBILE", 1997, 1999), ("MACHINERY", 1996, 1997)], "market string, from_year int, to_year int")
    return k.in_period(d.mpanel(spark, sf), p)


POS = """(SELECT *, CASE WHEN share>.5 AND g AND p THEN 'x' WHEN g AND p THEN 'question_mark_premium' WHEN g THEN 'question_mark' WHEN p THEN 'niche_premium' ELSE 'dog' END AS position
 FROM (SELECT *, roe*.6+margin*.4 AS profitability, coalesce(growth>5,false) AS g, coalesce(roe*.6+margin*.4>10,false) AS p FROM comp))""".replace("WHEN share>.5 AND g AND p THEN 'x' ", "")


@query("positioning_matrix", "K8", "company_id year position", "profitability share", f"SELECT company_id, year, position, profitability, share FROM {POS}")
def _(spark, sf):
    return k.positioning(d.competition(spark, sf))


EVO = f"""(SELECT *, CASE WHEN l>pl THEN 'upward' WHEN l<pl THEN 'downward' ELSE 'stable' END AS movement, profit_change*.4+share_change*.6+CASE WHEN l>pl THEN 10 WHEN l<pl THEN -10 ELSE 0 END AS evolution_score FROM (
 SELECT company_id, market, year, lag(position) OVER w AS from_position, position, CASE position WHEN 'question_mark_premium' THEN 5 WHEN 'question_mark' THEN 3 WHEN 'niche_premium' THEN 2 ELSE 1 END AS l,
 CASE lag(position) OVER w WHEN 'question_mark_premium' THEN 5 WHEN 'question_mark' THEN 3 WHEN 'niche_premium' THEN 2 ELSE 1 END AS pl,
 (profitability-lag(profitability) OVER w)/greatest(abs(lag(profitability) OVER w),1)*100 AS profit_change, (share-lag(share) OVER w)/greatest(abs(lag(share) OVER w),1)*100 AS share_change FROM {POS} WINDOW w AS ({PW})) WHERE from_position IS NOT NULL)"""


def evolution(spark, sf):
    return k.position_evolution(k.positioning(d.competition(spark, sf)))


@query("position_evolution", "K9", "company_id year from_position position movement", "profit_change share_change evolution_score", f"SELECT * FROM {EVO}")
def _(spark, sf):
    return evolution(spark, sf)


@query("position_stability", "K9", "company_id market changes", "stability stability_rank", f"""WITH g AS (SELECT company_id, market, count(*) AS changes, greatest(0,100-(stddev_samp(share_change)+stddev_samp(profit_change))/2) AS stability, stddev_samp(share_change) AS a, stddev_samp(profit_change) AS b FROM {EVO} GROUP BY 1,2)
SELECT *, rank() OVER (PARTITION BY market ORDER BY stability DESC)+(count(*) OVER (PARTITION BY market, stability)-1)/2.0 AS stability_rank FROM g WHERE a IS NOT NULL AND b IS NOT NULL""", digits=5)
def _(spark, sf):
    return k.position_stability(evolution(spark, sf))


MY = """my AS (SELECT market, year, count(*) AS n, var_samp(margin) AS margin_var, var_samp(roe) AS roe_var, sum(share*share) AS hhi, avg(cost_ratio) AS cost, avg(rd_ratio) AS rd, var_samp(rd_ratio) AS rd_var, avg(ad_ratio) AS ad,
 avg(margin) AS margin, avg(revenue) AS revenue, avg(intangible_fixed_assets/total_assets*100) AS intangible FROM comp GROUP BY 1,2)"""
INT = "i AS (SELECT *, margin_var*.3+roe_var*.2+(100-hhi)*.2+cost*.1+rd*.1+ad*.1 AS intensity FROM my WHERE n>=2)"


@query("competition_intensity", "K10 K14", "market year level concentration", "intensity hhi margin_var", f"""WITH {MY}, {INT} SELECT *, CASE WHEN intensity>50 THEN 'very_high' WHEN intensity>30 THEN 'high' WHEN intensity>15 THEN 'moderate' ELSE 'low' END AS level,
 CASE WHEN hhi>2500 THEN 'high' WHEN hhi>1500 THEN 'moderate' ELSE 'low' END AS concentration FROM i""", digits=4)
def _(spark, sf):
    return k.intensity(k.market_years(d.competition(spark, sf)))


@query("price_and_innovation", "K11", "market year", "cost_increase margin_decline margin_convergence price_score rd_growth innovation_score", f"""WITH {MY}, p AS (SELECT a.*, b.cost AS pc, b.margin AS pm, b.margin_var AS pv, b.rd AS pr FROM my a LEFT JOIN my b ON a.market=b.market AND a.year=b.year+1)
SELECT market, year, cost-pc AS cost_increase, pm-margin AS margin_decline, pv-margin_var AS margin_convergence, (cost-pc)*.6+(pm-margin)*.4 AS price_score, coalesce((rd-pr)/greatest(pr,.1),0) AS rd_growth,
 rd*.4+rd_var*.2+abs(coalesce((rd-pr)/greatest(pr,.1),0))*.1+intangible*.2+ad*.1 AS innovation_score FROM p""")
def _(spark, sf):
    return k.price_innovation(k.market_years(d.competition(spark, sf)))


@query("entry_exit_by_year", "K12", "market year entrants exits net_change active turbulence barriers", "hhi barrier_score", f"""WITH {MY}, s AS (SELECT market, company_id, min(year) AS a, max(year) AS z FROM comp GROUP BY 1,2),
 g AS (SELECT my.*, (SELECT count(*) FROM s WHERE s.market=my.market AND a=my.year) AS entrants, (SELECT count(*) FROM s WHERE s.market=my.market AND z=my.year AND z<2001) AS exits FROM my),
 x AS (SELECT *, least(revenue/1e7,50)*.5+rd*.3+(5-entrants)*2*.2 AS barrier_score FROM g)
SELECT market, year, entrants, exits, entrants-exits AS net_change, cast(sum(entrants-exits) OVER (PARTITION BY market ORDER BY year) AS bigint) AS active, entrants+exits AS turbulence, hhi, barrier_score,
 CASE WHEN barrier_score>60 THEN 'very_high' WHEN barrier_score>40 THEN 'high' WHEN barrier_score>20 THEN 'moderate' ELSE 'low' END AS barriers FROM x""")
def _(spark, sf):
    p = d.competition(spark, sf)
    return k.entry_exit(p, k.market_years(p), 2001)


@query("competitive_cycles", "K13", "market peaks troughs", "amplitude mean_gap", f"""WITH {MY}, {INT}, s AS (SELECT market, year, intensity, avg(intensity) OVER (PARTITION BY market ORDER BY year ROWS 2 PRECEDING) AS m0, row_number() OVER (PARTITION BY market ORDER BY year) AS rn FROM i),
 t AS (SELECT *, coalesce(CASE WHEN rn>=3 THEN m0 END, first_value(CASE WHEN rn>=3 THEN m0 END IGNORE NULLS) OVER (PARTITION BY market ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s FROM s),
 u AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS n FROM t WINDOW w AS (PARTITION BY market ORDER BY year)), v AS (SELECT *, CASE WHEN s>p AND s>n THEN year END AS pk FROM u),
 z AS (SELECT *, pk-last_value(pk IGNORE NULLS) OVER (PARTITION BY market ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM v)
SELECT market, count(pk) AS peaks, count(CASE WHEN s<p AND s<n THEN 1 END) AS troughs, stddev_pop(intensity) AS amplitude, coalesce(avg(gap),0) AS mean_gap FROM z GROUP BY 1""", digits=4)
def _(spark, sf):
    return k.cycles(k.intensity(k.market_years(d.competition(spark, sf))), k=3)


@query("strategy_types", "K15", "company_id year strategy", "cost_score diff_score focus_score scale_score", """WITH x AS (SELECT company_id, year, (100-cost_ratio)*.7+least(revenue/1e6,100)*.3 AS cost_score, rd_ratio*.4+ad_ratio*.3+margin*.3 AS diff_score, 100/greatest(segments_count,1)*.6 AS focus_score, least(revenue/1e7,50)+share AS scale_score FROM comp)
SELECT *, CASE WHEN cost_score>60 AND scale_score>60 THEN 'cost_leadership_scale' WHEN diff_score>60 THEN 'differentiation' WHEN focus_score>60 THEN 'focus' WHEN cost_score>40 THEN 'cost_leadership' ELSE 'stuck_in_middle' END AS strategy FROM x""")
def _(spark, sf):
    return k.strategy_scores(d.competition(spark, sf))


ST = ["cost_score", "diff_score", "focus_score", "scale_score"]


@query("strategic_groups", "K16", "group n", "intra_competition inter_competition performance")
def _(spark, sf):
    x = latest_rows(k.strategy_scores(d.competition(spark, sf)).select("company_id", "year", *ST, "roe", "margin", "growth", "share"))
    return k.group_competition(k.strategic_groups(x, ST, 4), ST)


@query("strategic_mobility", "K16", "company_id steps", "mobility", """WITH x AS (SELECT company_id, year, CASE WHEN rd_ratio*.4+ad_ratio*.3+margin*.3>60 THEN 'd' WHEN 100/greatest(segments_count,1)*.6>60 THEN 'f' WHEN (100-cost_ratio)*.7+least(revenue/1e6,100)*.3>40 THEN 'c' ELSE 's' END AS s FROM comp),
 y AS (SELECT *, lag(s) OVER (PARTITION BY company_id ORDER BY year) AS p FROM x) SELECT company_id, count(p) AS steps, count(CASE WHEN p<>s THEN 1 END)*1.0/count(p) AS mobility FROM y GROUP BY 1 HAVING count(p)>0""")
def _(spark, sf):
    return k.mobility(k.strategy_scores(d.competition(spark, sf)))


LEAD = "ld AS (SELECT market, company_id FROM (SELECT market, company_id, sum(revenue) AS r FROM comp GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY market ORDER BY r DESC, company_id)<=3)"


@query("competitive_responses", "K17 J8", "market focal rival years", "rd_corr capex_corr margin_corr", f"""WITH {LEAD}, z AS (SELECT a.market, b.company_id AS focal, a.company_id AS rival, count(*) AS years, corr(a.rd_ratio,b.rd_ratio) AS x, corr(a.capex_ratio,b.capex_ratio) AS y, corr(a.margin,b.margin) AS w
 FROM comp a JOIN comp b ON a.market=b.market AND a.year=b.year AND a.company_id<>b.company_id JOIN ld ON ld.company_id=b.company_id GROUP BY 1,2,3 HAVING count(*)>=3)
SELECT market, focal, rival, years, CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END AS rd_corr, CASE WHEN y IS NULL OR isnan(y) THEN 0 ELSE y END AS capex_corr, CASE WHEN w IS NULL OR isnan(w) THEN 0 ELSE w END AS margin_corr FROM z""", digits=5)
def _(spark, sf):
    p = d.competition(spark, sf)
    tot = p.groupBy("market", "company_id").agg(F.sum("revenue").alias("r"))
    return k.responses(p, k.top_k(tot, ["market"], "r", 3))


# smoothed series of both sides of a pair, their moves, and all lags of 1 to 3 years
LAGS = f"""{LEAD}, pr AS (SELECT a.market, b.company_id AS focal, a.company_id AS rival, a.year, a.rd_ratio, a.capex_ratio, a.margin, b.rd_ratio AS f_rd, b.capex_ratio AS f_cx, b.margin AS f_mg
  FROM comp a JOIN comp b ON a.market=b.market AND a.year=b.year AND a.company_id<>b.company_id JOIN ld ON ld.company_id=b.company_id),
 sm AS (SELECT *, CASE WHEN count(*) OVER n=3 THEN avg(coalesce(f_rd,0)) OVER n END AS m0, CASE WHEN count(*) OVER n=3 THEN avg(coalesce(rd_ratio,0)) OVER n END AS t0 FROM pr WINDOW n AS (PARTITION BY market, focal, rival ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 sn AS (SELECT *, coalesce(m0, lead(m0) OVER w, lag(m0) OVER w) AS m1, coalesce(t0, lead(t0) OVER w, lag(t0) OVER w) AS t1 FROM sm WINDOW w AS (PARTITION BY market, focal, rival ORDER BY year)),
 mv AS (SELECT *, coalesce(abs((m1-lag(m1) OVER w)/greatest(abs(lag(m1) OVER w),.1))>.2,false) AS mine, coalesce(abs((t1-lag(t1) OVER w)/greatest(abs(lag(t1) OVER w),.1))>.2,false) AS theirs FROM sn WINDOW w AS (PARTITION BY market, focal, rival ORDER BY year)),
 pc AS (SELECT market, focal, rival, count(*) AS years, corr(rd_ratio,f_rd) AS x, corr(capex_ratio,f_cx) AS y, corr(margin,f_mg) AS w FROM mv GROUP BY 1,2,3 HAVING count(*)>=3),
 lg AS (SELECT a.market, a.focal, a.rival, avg(b.year-a.year) AS avg_lag, min(b.year-a.year) AS min_lag, max(b.year-a.year) AS max_lag, count(*) AS n_lags FROM mv a JOIN mv b ON a.market=b.market AND a.focal=b.focal AND a.rival=b.rival AND a.mine AND b.theirs AND b.year BETWEEN a.year+1 AND a.year+3 GROUP BY 1,2,3),
 rl AS (SELECT market, focal, rival, years, CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END AS rd_corr, CASE WHEN y IS NULL OR isnan(y) THEN 0 ELSE y END AS capex_corr, CASE WHEN w IS NULL OR isnan(w) THEN 0 ELSE w END AS margin_corr,
  coalesce(avg_lag,0) AS avg_lag, coalesce(min_lag,0) AS min_lag, coalesce(max_lag,0) AS max_lag, coalesce(n_lags,0) AS n_lags FROM pc LEFT JOIN lg USING (market, focal, rival)), rs AS (SELECT *, (rd_corr+capex_corr+abs(margin_corr))/3 AS strength FROM rl)"""


def lags(spark, sf):
    p = d.competition(spark, sf)
    return responses.response_lags(p, k.top_k(p.groupBy("market", "company_id").agg(F.sum("revenue").alias("r")), ["market"], "r", 3))


@query("response_lags", "K17", "market focal rival years n_lags relation", "avg_lag min_lag max_lag strength", f"""WITH {LAGS} SELECT market, focal, rival, years, n_lags, avg_lag, min_lag, max_lag, strength,
 CASE WHEN abs(strength)>.7 AND avg_lag<=1 THEN 'simultaneous' WHEN abs(strength)>.7 THEN 'follower_leader' WHEN abs(strength)>.4 THEN 'moderate' WHEN abs(strength)>.2 THEN 'weak' ELSE 'independent' END AS relation FROM rs""", digits=5)
def _(spark, sf):
    return lags(spark, sf)


@query("response_timing", "K18", "market focal rivals pattern", "avg_lag strength aggressiveness", f"""WITH {LAGS}, g AS (SELECT market, focal, count(*) AS rivals, avg(avg_lag) AS avg_lag, avg(strength) AS strength, 100*avg(CASE WHEN strength>.5 AND avg_lag<=1 THEN 1.0 ELSE 0 END) AS aggressiveness FROM rs GROUP BY 1,2)
SELECT *, CASE WHEN strength>.6 AND avg_lag<1 THEN 'fast_responder' WHEN strength>.6 THEN 'strong_follower' WHEN strength>.3 AND avg_lag<1 THEN 'quick_adapter' WHEN strength>.3 THEN 'moderate_follower' ELSE 'independent' END AS pattern FROM g""", digits=5)
def _(spark, sf):
    return responses.response_timing(lags(spark, sf))


@query("response_intensity", "K18", "market focal dominant", "rd investment pricing overall", f"""WITH {LAGS}, g AS (SELECT market, focal, avg(abs(rd_corr)) AS rd, avg(abs(capex_corr)) AS investment, avg(abs(margin_corr)) AS pricing FROM rs GROUP BY 1,2)
SELECT *, (rd+investment+pricing)/3 AS overall, CASE WHEN rd=greatest(rd,investment,pricing) THEN 'rd' WHEN investment=greatest(rd,investment,pricing) THEN 'investment' ELSE 'pricing' END AS dominant FROM g""", digits=5)
def _(spark, sf):
    return responses.response_intensity(lags(spark, sf))


@query("innovation_leaders", "K19", "market block company_id rank", "mean", """WITH g AS (SELECT market, cast(floor((year-1990)/5.0)*5+1990 AS int) AS block, company_id, avg(rd_ratio) AS mean FROM comp WHERE rd_ratio IS NOT NULL GROUP BY 1,2,3)
SELECT market, block, company_id, mean, cast(row_number() OVER (PARTITION BY market, block ORDER BY mean DESC, company_id) AS int) AS rank FROM g QUALIFY rank<=3""")
def _(spark, sf):
    return responses.innovation_leaders(d.competition(spark, sf))


@query("followership", "K19", "market company_id adoptions kind", "avg_lag", """WITH m AS (SELECT market, year, avg(rd_ratio) AS m FROM comp GROUP BY 1,2), u AS (SELECT a.market, a.year FROM m a JOIN m b ON a.market=b.market AND b.year=a.year+1 AND b.m>a.m*1.01),
 s AS (SELECT market, company_id, year, CASE WHEN count(*) OVER n=3 THEN avg(coalesce(rd_ratio,0)) OVER n END AS a FROM comp WINDOW n AS (PARTITION BY market, company_id ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 t AS (SELECT *, coalesce(a, lead(a) OVER w, lag(a) OVER w) AS b FROM s WINDOW w AS (PARTITION BY market, company_id ORDER BY year)), v AS (SELECT *, lag(b) OVER (PARTITION BY market, company_id ORDER BY year) AS p FROM t),
 l AS (SELECT v.market, v.company_id, v.year, v.year-min(u.year) AS lag FROM v JOIN u ON u.market=v.market AND u.year BETWEEN v.year-5 AND v.year-1 WHERE abs((b-p)/greatest(abs(p),.1))>.2 GROUP BY 1,2,3),
 g AS (SELECT market, company_id, count(*) AS adoptions, avg(lag) AS avg_lag FROM l GROUP BY 1,2) SELECT *, CASE WHEN avg_lag<=1 THEN 'fast' WHEN avg_lag<=3 THEN 'moderate' WHEN avg_lag<=5 THEN 'slow' ELSE 'late' END AS kind FROM g""")
def _(spark, sf):
    # markets of the given panel never rise by a tenth in a year, the usual threshold
    return responses.followership(d.competition(spark, sf), rise=1.01)


@query("imitation", "K19", "company_id n", "slope imitation", """WITH x AS (SELECT company_id, year, abs(rd_ratio-avg(rd_ratio) OVER (PARTITION BY market, year))/abs(avg(rd_ratio) OVER (PARTITION BY market, year)) AS d FROM comp)
SELECT company_id, count(d) AS n, regr_slope(d,year) AS slope, greatest(0,-10*regr_slope(d,year)) AS imitation FROM x GROUP BY 1 HAVING count(d)>=3""")
def _(spark, sf):
    return k.imitation(d.competition(spark, sf))


@query("diffusion_speed", "K20", "market", "speed peak", """WITH b AS (SELECT market, quantile_cont(rd_ratio,.5) AS m FROM comp WHERE year=1995 GROUP BY 1), g AS (SELECT market, year, avg(CASE WHEN rd_ratio>m THEN 1.0 ELSE 0 END) AS a FROM comp JOIN b USING (market) GROUP BY 1,2),
 z AS (SELECT *, a-lag(a) OVER (PARTITION BY market ORDER BY year) AS d FROM g) SELECT market, avg(d) AS speed, max(a) AS peak FROM z GROUP BY 1""")
def _(spark, sf):
    return k.diffusion(d.competition(spark, sf))


DIMS = """dm AS (SELECT company_id, year, market, .4*rd_ratio/100+.3*intangible_fixed_assets/revenue AS innovation,
 .3*revenue/total_assets+.3*revenue/employees+.2*revenue/tangible_fixed_assets+.2*(1-cost_ratio/100) AS efficiency,
 coalesce(.35*overseas_revenue_ratio+.25*segments_count/10+.25*growth/100+.15*(1-sg_a_expenses/revenue),0) AS expansion,
 coalesce(.35*roe/100+.25*shareholders_equity/total_assets+.25*current_assets/nullif(current_liabilities,0)+.15/(1+total_liabilities/nullif(shareholders_equity,0)),0) AS financial,
 .3*cash_and_deposits/total_assets+.3*capex/depreciation+.25*segments_count/5+.15*(1-(sg_a_expenses+depreciation)/revenue) AS flexibility FROM comp)"""
D5 = ["innovation", "efficiency", "expansion", "financial", "flexibility"]


@query("strategy_dimensions", "K21", "company_id year", " ".join(D5), f"WITH {DIMS} SELECT * FROM dm")
def _(spark, sf):
    return k.strategy_dimensions(d.competition(spark, sf))


@query("competitive_strength", "K21 R2 G9", "company_id year position", "strength", f"WITH {DIMS}, r AS (SELECT company_id, year, " + "+".join(
    f"(rank() OVER (PARTITION BY market ORDER BY {x})+(count(*) OVER (PARTITION BY market, {x})-1)/2.0)/count(*) OVER (PARTITION BY market)*.5" for x in ("innovation", "efficiency"))
    + " AS strength FROM dm) SELECT *, CASE WHEN strength>=.8 THEN 'leader' WHEN strength>=.6 THEN 'challenger' WHEN strength>=.4 THEN 'follower' ELSE 'niche' END AS position FROM r")
def _(spark, sf):
    return k.competitive_strength(k.strategy_dimensions(d.competition(spark, sf)), ["innovation", "efficiency"], {"innovation": 0.5, "efficiency": 0.5})


@query("strategy_transitions", "K22", "company_id year direction", "distance", f"WITH {DIMS}, l AS (SELECT company_id, year, " + ", ".join(f"{x}-lag({x}) OVER ({PW}) AS {x}" for x in D5) + " FROM dm), b AS (SELECT *, greatest("
       + ",".join(f"abs({x})" for x in D5) + ") AS b FROM l WHERE innovation IS NOT NULL) SELECT company_id, year, sqrt(" + "+".join(f"{x}*{x}" for x in D5) + ") AS distance, CASE "
       + " ".join(f"WHEN abs({x})=b THEN CASE WHEN {x}>0 THEN 'increase_' ELSE 'decrease_' END || '{x}'" for x in D5) + " END AS direction FROM b")
def _(spark, sf):
    return k.strategy_transitions(k.strategy_dimensions(d.competition(spark, sf)), D5)


@query("ecosystem_by_year", "K23 K24", "year n", "hhi innovation age_std margin_mean margin_std growth_mean", """WITH x AS (SELECT *, revenue/sum(revenue) OVER (PARTITION BY year) AS s FROM comp)
SELECT year, count(*) AS n, sum(s*s) AS hhi, avg(rd_ratio) AS innovation, stddev_pop(year-start_year) AS age_std, avg(margin) AS margin_mean, stddev_pop(margin) AS margin_std, avg(growth) AS growth_mean FROM x GROUP BY 1""")
def _(spark, sf):
    return k.ecosystem(d.competition(spark, sf))


@query("entry_profiles", "K26 K30", "company_id market n entry_year years_to_profit entry_type", "entry_revenue capex rd ad cagr", f"""WITH x AS (SELECT *, row_number() OVER ({PW}) AS i FROM comp),
 g AS (SELECT company_id, market, count(*) AS n, min(year) AS entry_year, arg_min(revenue,year) AS entry_revenue, avg(CASE WHEN i<=3 THEN capex_ratio END) AS capex, avg(CASE WHEN i<=3 THEN rd_ratio END) AS rd, avg(CASE WHEN i<=3 THEN ad_ratio END) AS ad,
  arg_max(revenue,year) AS lr, min(CASE WHEN margin>0 THEN year END) AS py FROM x GROUP BY 1,2)
SELECT *, pow(lr/entry_revenue,1.0/n)-1 AS cagr, cast(py-entry_year AS int) AS years_to_profit, CASE WHEN capex>15 AND rd>5 THEN 'aggressive_technology' WHEN ad>3 AND capex>10 THEN 'aggressive_market' WHEN rd>8 OR ad>5 THEN 'niche' ELSE 'conservative' END AS entry_type FROM g""")
def _(spark, sf):
    return k.entry_profile(d.competition(spark, sf))


SUC = f"""su AS (SELECT company_id, market, y0 AS entry_year, n, .3*least(1,greatest(0,pow(z/a,1.0/n)-1))+.3*CASE WHEN py IS NULL THEN 0 ELSE greatest(0,1-(py-y0)/10.0) END
  +.25*((SELECT count(*) FROM panel q WHERE q.year=g.y1 AND q.revenue<g.z)+(SELECT count(*) FROM panel q WHERE q.year=g.y1 AND q.revenue<=g.z)+1)/2.0/(SELECT count(*) FROM panel q WHERE q.year=g.y1)+.15*least(1,n/20.0) AS success
 FROM (SELECT company_id, market, count(*) AS n, min(year) AS y0, max(year) AS y1, arg_min(revenue,year) AS a, arg_max(revenue,year) AS z, min(CASE WHEN margin>0 THEN year END) AS py FROM comp GROUP BY 1,2 HAVING count(*)>=5) g)"""


@query("entry_success", "K27", "company_id market entry_year n", "success", f"WITH {SUC} SELECT * FROM su")
def _(spark, sf):
    return k.entry_success(d.competition(spark, sf))


@query("entry_timing_link", "K25", "market early mid late", "timing_corr", f"""WITH {SUC}, q AS (SELECT market, quantile_cont(entry_year,1/3.0) AS a, quantile_cont(entry_year,2/3.0) AS b FROM su GROUP BY 1)
SELECT market, count(CASE WHEN entry_year<=a THEN 1 END) AS early, count(CASE WHEN entry_year>a AND entry_year<=b THEN 1 END) AS mid, count(CASE WHEN entry_year>b THEN 1 END) AS late, corr(entry_year,success) AS timing_corr FROM su JOIN q USING (market) GROUP BY 1""")
def _(spark, sf):
    return k.entry_timing_link(k.entry_success(d.competition(spark, sf)))


@query("entry_patterns", "K31", "outcome entry_type n", "success cagr early_profit_share")
def _(spark, sf):
    p = d.competition(spark, sf, share=False)
    e = k.entrants(p)
    return k.entry_patterns(k.entry_profile(p, entities=e), k.entry_success(p, entities=e), 0.55, 0.45)


@query("market_growth_phases", "K29", "market year phase entrants", "market_growth volatility", """WITH g AS (SELECT market, year, sum(revenue) AS s, count(CASE WHEN year=start_year THEN 1 END) AS entrants, stddev_samp(margin) AS volatility FROM comp GROUP BY 1,2),
 x AS (SELECT *, s/lag(s) OVER (PARTITION BY market ORDER BY year)-1 AS market_growth FROM g) SELECT *, CASE WHEN market_growth>.15 THEN 'emergence' WHEN market_growth>.05 THEN 'growth' WHEN market_growth>-.02 THEN 'maturity' ELSE 'decline' END AS phase FROM x""")
def _(spark, sf):
    return k.growth_phases(d.competition(spark, sf))


# least squares on x and its square by their covariances
@query("market_saturation", "K28", "market", "b1 b2 optimal_competition", """WITH g AS (SELECT market, year, count(*)*1.0 AS x, avg(margin) AS y FROM comp GROUP BY 1,2), m AS (SELECT market, var_pop(x) AS a, var_pop(x*x) AS b, covar_pop(x,x*x) AS k, covar_pop(x,y) AS p, covar_pop(x*x,y) AS q FROM g GROUP BY 1),
 s AS (SELECT market, (p*b-q*k)/(a*b-k*k) AS b1, (q*a-p*k)/(a*b-k*k) AS b2 FROM m) SELECT *, CASE WHEN b2<0 THEN -b1/(2*b2) END AS optimal_competition FROM s""", digits=3)
def _(spark, sf):
    return k.saturation(d.competition(spark, sf))


@query("innovation_metrics", "K32", "company_id", "pipeline diversity short_impact efficiency risk_adjusted", """SELECT company_id, avg(rd_ratio) AS pipeline, avg(segments_count) AS diversity, avg(growth) AS short_impact, avg(margin)/nullif(avg(rd_ratio),0) AS efficiency, avg(margin)/nullif(stddev_samp(margin),0) AS risk_adjusted
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b FROM comp) WHERE b<=5 GROUP BY 1""", digits=4)
def _(spark, sf):
    return k.innovation_metrics(d.competition(spark, sf))


@query("entrant_impact", "K33", "market entry_year", "margin_before margin_after margin_impact", """WITH s AS (SELECT market, a, count(*) AS e FROM (SELECT market, company_id, min(year) AS a FROM comp GROUP BY 1,2) GROUP BY 1,2), p AS (SELECT market, arg_max(a,(e,-a)) AS ey FROM s GROUP BY 1),
 m AS (SELECT market, year, avg(margin) AS m FROM comp GROUP BY 1,2), z AS (SELECT market, ey AS entry_year, avg(CASE WHEN year BETWEEN ey-2 AND ey-1 THEN m END) AS margin_before, avg(CASE WHEN year BETWEEN ey+1 AND ey+2 THEN m END) AS margin_after FROM m JOIN p USING (market) GROUP BY 1,2)
SELECT *, margin_after-margin_before AS margin_impact FROM z""")
def _(spark, sf):
    p = d.competition(spark, sf)
    return k.entrant_impact(p, k.entry_exit(p, k.market_years(p), 2001))
