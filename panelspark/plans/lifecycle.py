"""Lifecycle queries (inventory L1-L26)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..functions.windows import latest_rows
from ..operators import clean
from ..operators import lifecycle as l
from ..operators import metrics as m
from ..session import reliable
from ..sources import derive as d
from .registry import query

c = F.col
PW = "PARTITION BY company_id ORDER BY year"


@query("company_age", "L1 C15 L5", "company_id year age stage", "", """SELECT company_id, year, cast(year-min(year) OVER (PARTITION BY company_id) AS int) AS age, CASE WHEN status='extinct' AND year>=end_year THEN 'extinct'
 WHEN year-min(year) OVER (PARTITION BY company_id)<=1 THEN 'startup' WHEN year-min(year) OVER (PARTITION BY company_id)<=3 THEN 'growth' ELSE 'mature' END AS stage FROM mpanel""")
def _(spark, sf):
    from ..functions.windows import whole

    p = d.mpanel(spark, sf).withColumn("age", c("year") - F.min("year").over(whole()))
    b = clean.age_bin(c("age"), (1, 3), True, ("startup", "growth", "mature"))
    return p.withColumn("stage", F.when((c("status") == "extinct") & (c("year") >= c("end_year")), "extinct").otherwise(b))


ADJ = {"startup": "CASE WHEN g>.15 THEN 1.5 WHEN g<-.05 THEN .3 ELSE 1 END*CASE WHEN a<.02 THEN 1.2 ELSE 1 END*CASE WHEN r>.08 THEN 1.3 ELSE 1 END", "growth": "CASE WHEN g>.15 THEN 1.3 WHEN g<-.05 THEN .5 ELSE 1 END",
       "maturity": "CASE WHEN a>.1 THEN 1.4 ELSE 1 END"}
AGES = {"startup": (0, 2), "growth": (1, 4), "maturity": (3, 7)}


@query("stage_probabilities", "L2", "company_id", "age p_startup p_growth p_maturity", "WITH x AS (SELECT company_id, max(year-start_year) AS age, avg(growth/100) AS g, avg(net_profit/total_assets) AS a, avg(rd_ratio/100) AS r FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b FROM lc) WHERE b<=3 GROUP BY 1), p AS (SELECT *, "
       + ", ".join(f"CASE WHEN age BETWEEN {a} AND {b} THEN exp(-pow((age-{(a + b) / 2})/{(b - a) / 4},2)/2)/({(b - a) / 4}*2.5066282746310002) ELSE 0 END*{ADJ[s]} AS {s}" for s, (a, b) in AGES.items())
       + " FROM x) SELECT company_id, age, CASE WHEN startup+growth+maturity>0 THEN startup/(startup+growth+maturity) ELSE 0 END AS p_startup, CASE WHEN startup+growth+maturity>0 THEN growth/(startup+growth+maturity) ELSE 0 END AS p_growth, CASE WHEN startup+growth+maturity>0 THEN maturity/(startup+growth+maturity) ELSE 0 END AS p_maturity FROM p")
def _(spark, sf):
    p = d.staged(spark, sf).select("company_id", "year", "start_year", (c("growth") / 100).alias("growth"), sd("net_profit", "total_assets").alias("roa"), (c("rd_ratio") / 100).alias("rd"))
    return l.stage_probabilities(p, AGES)


@query("rule_phases", "L3 L4", "company_id year phase smooth", "smoothed", f"""WITH x AS (SELECT *, growth/100 AS g, margin/100 AS m, 1-debt/100 AS st, avg(growth/100) OVER ({PW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM lc)
SELECT company_id, year, smoothed, CASE WHEN (g>.5 OR g<-.2) AND m<.05 AND st<.5 THEN 'startup' WHEN g<-.1 AND m<.02 THEN 'decline' WHEN abs(g)<.15 AND m>.08 AND st>.7 THEN 'maturity' ELSE 'growth' END AS phase,
 CASE WHEN smoothed IS NULL THEN 'introduction' WHEN smoothed>.15 THEN 'growth' WHEN smoothed>.05 THEN 'maturity' WHEN smoothed>-.05 THEN 'introduction' ELSE 'decline' END AS smooth FROM x""")
def _(spark, sf):
    p = d.staged(spark, sf).withColumn("g", c("growth") / 100)
    p = l.smoothed_phase(p, "g").withColumnRenamed("phase", "smooth")
    return p.withColumn("phase", l.phase_rules(c("g"), c("margin") / 100, 1 - c("debt") / 100))


RUNS = f"""rn AS (SELECT company_id, stage, min(year) AS first_year, max(year) AS last_year, count(*) AS length FROM (SELECT *, row_number() OVER ({PW})-row_number() OVER (PARTITION BY company_id, stage ORDER BY year) AS isle FROM lc) GROUP BY company_id, stage, isle)"""


@query("stage_runs", "L7", "company_id stage first_year last_year length", "", f"WITH {RUNS} SELECT * FROM rn")
def _(spark, sf):
    return l.stage_runs(d.staged(spark, sf))


TR = f"""tr AS (SELECT * FROM (SELECT company_id, market, year, lag(stage) OVER w AS from_stage, stage AS to_stage, year-lag(year) OVER w AS gap, margin-lag(margin) OVER w AS d_margin, debt-lag(debt) OVER w AS d_debt FROM lc WINDOW w AS ({PW})) WHERE from_stage<>to_stage)"""


@query("stage_transitions", "L8", "company_id year from_stage to_stage gap", "d_margin d_debt", f"WITH {TR} SELECT * FROM tr")
def _(spark, sf):
    return l.transitions(d.staged(spark, sf), context=["margin", "debt"])


MX = f"mx AS (SELECT *, n*1.0/sum(n) OVER (PARTITION BY from_stage) AS p FROM (SELECT from_stage, to_stage, count(*) AS n FROM (SELECT lag(stage) OVER ({PW}) AS from_stage, stage AS to_stage FROM lc) WHERE from_stage IS NOT NULL GROUP BY 1,2))"


@query("transition_matrix", "L9", "from_stage to_stage n", "p", f"WITH {MX} SELECT * FROM mx")
def _(spark, sf):
    return l.transition_matrix(d.staged(spark, sf))


@query("transition_matrix_by_market", "L9 A18", "market from_stage to_stage n", "p", f"""SELECT *, n*1.0/sum(n) OVER (PARTITION BY market, from_stage) AS p FROM (SELECT market, from_stage, to_stage, count(*) AS n FROM (SELECT market, lag(stage) OVER ({PW}) AS from_stage, stage AS to_stage FROM lc) WHERE from_stage<>to_stage GROUP BY 1,2,3)""")
def _(spark, sf):
    return l.transition_matrix(d.staged(spark, sf), by=["market"], changes_only=True)


@query("stage_durations", "L10", "stage n longest", "mean std", f"WITH {RUNS} SELECT stage, count(*) AS n, max(length) AS longest, avg(length) AS mean, stddev_samp(length) AS std FROM rn GROUP BY 1")
def _(spark, sf):
    return l.run_durations(l.stage_runs(d.staged(spark, sf)))


@query("common_paths", "L11", "path n", "", f"""WITH s AS (SELECT stage AS s0, lead(stage,1) OVER w AS s1, lead(stage,2) OVER w AS s2, lead(stage,3) OVER w AS s3, lead(stage,4) OVER w AS s4 FROM lc WINDOW w AS ({PW})),
 p AS (SELECT s0||'>'||s1||'>'||s2 AS path FROM s UNION ALL SELECT s0||'>'||s1||'>'||s2||'>'||s3 FROM s UNION ALL SELECT s0||'>'||s1||'>'||s2||'>'||s3||'>'||s4 FROM s)
SELECT path, count(*) AS n FROM p WHERE path IS NOT NULL GROUP BY 1 HAVING count(*)>=3 ORDER BY n DESC, path LIMIT 10""")
def _(spark, sf):
    return l.common_paths(d.staged(spark, sf))


@query("markov_forecast", "L12 L16", "step stage", "share", f"""WITH {MX}, lt AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC)=1), s0 AS (SELECT stage, count(*)*1.0/(SELECT count(*) FROM lt) AS p FROM lt GROUP BY 1), s1 AS (SELECT to_stage AS stage, sum(s0.p*mx.p) AS p FROM s0 JOIN mx ON stage=from_stage GROUP BY 1),
 s2 AS (SELECT to_stage AS stage, sum(s1.p*mx.p) AS p FROM s1 JOIN mx ON stage=from_stage GROUP BY 1) SELECT 0 AS step, stage, p AS share FROM s0 UNION ALL SELECT 1, stage, p FROM s1 UNION ALL SELECT 2, stage, p FROM s2""")
def _(spark, sf):
    p = d.staged(spark, sf)
    return l.markov_forecast(latest_rows(p), l.transition_matrix(p), 2)


@query("stage_survival", "L13", "stage n", "rate", "SELECT stage, count(*) AS n, avg(CASE WHEN s>=3 THEN 1.0 ELSE 0 END) AS rate FROM (SELECT company_id, stage, max(year)-min(year) AS s FROM lc GROUP BY 1,2) GROUP BY 1")
def _(spark, sf):
    return l.stage_survival(d.staged(spark, sf), 3)


@query("risky_transitions", "L14", "from_stage n", "risk", f"WITH {TR} SELECT from_stage, count(*) AS n, count(*)*(100-avg(margin+100-debt)) AS risk FROM tr JOIN lc USING (company_id, year) WHERE to_stage='decline' GROUP BY 1", digits=4)
def _(spark, sf):
    p = d.staged(spark, sf)
    return l.risky_transitions(l.transitions(p), p)


@query("recovery_factors", "L14", "recovered declined", "rate_pct margin_mean margin_std", f"WITH {TR} SELECT count(DISTINCT company_id) AS recovered, (SELECT count(DISTINCT company_id) FROM lc WHERE stage='decline') AS declined, count(DISTINCT company_id)*100.0/(SELECT count(DISTINCT company_id) FROM lc WHERE stage='decline') AS rate_pct, avg(margin) AS margin_mean, stddev_samp(margin) AS margin_std FROM tr JOIN lc USING (company_id, year) WHERE from_stage='decline'")
def _(spark, sf):
    p = d.staged(spark, sf)
    return l.recoveries(l.transitions(p), p, ["margin"])


@query("around_transitions", "L15", "from_stage to_stage n", "before after change", f"""WITH {TR}, j AS (SELECT t.company_id, t.year AS ty, from_stage, to_stage, avg(CASE WHEN l.year<t.year THEN margin END) AS b, avg(CASE WHEN l.year>t.year THEN margin END) AS a FROM tr t JOIN lc l ON l.company_id=t.company_id AND l.year BETWEEN t.year-2 AND t.year+2 GROUP BY 1,2,3,4)
SELECT from_stage, to_stage, count(*) AS n, avg(b) AS before, avg(a) AS after, avg(a-b) AS change FROM j GROUP BY 1,2""")
def _(spark, sf):
    p = d.staged(spark, sf)
    return l.around_transition(p, l.transitions(p), "margin")


@query("stage_history", "L18 L24", "company_id changes longest_run current_run current_stage", "mean_run share_growth share_decline", f"""WITH {RUNS} SELECT company_id, count(*)-1 AS changes, max(length) AS longest_run, arg_max(length, first_year) AS current_run, arg_max(stage, first_year) AS current_stage, avg(length) AS mean_run,
 sum(CASE WHEN stage='growth' THEN length ELSE 0 END)*1.0/sum(length) AS share_growth, sum(CASE WHEN stage='decline' THEN length ELSE 0 END)*1.0/sum(length) AS share_decline FROM rn GROUP BY 1""")
def _(spark, sf):
    return l.stage_history(d.staged(spark, sf))


MAT = """mt AS (SELECT company_id, CASE WHEN max(n)>=5 THEN greatest(0,1-stddev_samp(revenue)/avg(revenue)) END AS revenue_stability, least(1,avg(CASE WHEN b<=3 THEN dividend_payout_ratio END)) AS payout, avg(CASE WHEN b<=3 THEN share/100 END) AS share_strength,
 avg(CASE WHEN b<=3 THEN shareholders_equity/total_assets END) AS equity_stability, greatest(0,1-abs(avg(CASE WHEN b<=3 THEN segments_count END)-3)/3) AS diversification,
 CASE WHEN count(CASE WHEN b<=3 THEN growth END)>0 THEN least(10,avg(CASE WHEN b<=3 THEN growth/100 END)/greatest(.001,avg(CASE WHEN b<=3 THEN rd_ratio/100 END))) END AS rd_efficiency, CASE WHEN max(n)>=5 THEN greatest(0,regr_slope(margin/100,-b)+.5) END AS advantage
 FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b, count(*) OVER (PARTITION BY company_id) AS n FROM lc) WHERE b<=5 GROUP BY 1),
 mo AS (SELECT *, list_avg(list_filter([revenue_stability,payout,share_strength,equity_stability,diversification,rd_efficiency,advantage], lambda q: q IS NOT NULL)) AS overall_maturity FROM mt)"""


@query("maturity_indicators", "L19 M25", "company_id", "revenue_stability payout equity_stability diversification rd_efficiency advantage overall_maturity", f"WITH {MAT} SELECT * FROM mo")
def _(spark, sf):
    return l.maturity_indicators(d.staged(spark, sf))


@query("market_maturity", "L23", "market n", "mean high medium low", f"WITH {MAT} SELECT market, count(*) AS n, avg(overall_maturity) AS mean, avg(CASE WHEN overall_maturity>=.7 THEN 1.0 ELSE 0 END) AS high, avg(CASE WHEN overall_maturity>=.4 AND overall_maturity<.7 THEN 1.0 ELSE 0 END) AS medium, avg(CASE WHEN overall_maturity<.4 THEN 1.0 ELSE 0 END) AS low FROM mo JOIN entity USING (company_id) GROUP BY 1")
def _(spark, sf):
    x = l.maturity_indicators(d.staged(spark, sf)).join(d.entity(spark, sf).select("company_id", "market"), "company_id")
    return l.market_maturity(x)


@query("stage_anomalies", "L17", "company_id n excessive_changes volatile_growth dramatic_margin", "change_rate growth_volatility margin_jump", f"""WITH x AS (SELECT *, CASE WHEN stage=lag(stage) OVER w THEN 0 ELSE 1 END AS ch, abs(margin-lag(margin) OVER w) AS dm, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b FROM lc WINDOW w AS ({PW})),
 g AS (SELECT company_id, count(*) AS n, sum(ch) AS k, stddev_samp(CASE WHEN b<=3 THEN growth END) AS growth_volatility, max(CASE WHEN b=1 THEN dm END) AS margin_jump FROM x GROUP BY 1)
SELECT *, k*1.0/n AS change_rate, k>n*.3 AS excessive_changes, coalesce(growth_volatility>50,false) AS volatile_growth, coalesce(margin_jump>10,false) AS dramatic_margin FROM g""")
def _(spark, sf):
    return l.stage_anomalies(d.staged(spark, sf))


DEC = f"""sm AS (SELECT company_id, year, s, lag(s) OVER ({PW}) AS p, lead(s) OVER ({PW}) AS nx FROM (SELECT company_id, year, CASE WHEN count(revenue) OVER w=3 THEN avg(revenue) OVER w END AS s, count(*) OVER (PARTITION BY company_id) AS n FROM panel WINDOW w AS ({PW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE n>=5 AND s IS NOT NULL),
 pk AS (SELECT a.company_id, a.year AS peak_year, a.s AS peak, (SELECT min(b.s) FROM sm b WHERE b.company_id=a.company_id AND b.year>=a.year) AS trough FROM sm a WHERE s>p AND s>nx),
 dp AS (SELECT *, (trough-peak)/peak AS decline_rate, (SELECT min(b.year) FROM sm b WHERE b.company_id=pk.company_id AND b.year>=peak_year AND b.s=trough) AS trough_year FROM pk WHERE (trough-peak)/peak<=-.2),
 rc AS (SELECT *, CASE WHEN (SELECT count(*) FROM sm b WHERE b.company_id=dp.company_id AND b.year>=trough_year)>=3 THEN (SELECT min(b.year) FROM sm b WHERE b.company_id=dp.company_id AND b.year>=trough_year AND b.s>=trough*1.1) END AS ry FROM dp)"""


@query("decline_periods", "L20", "company_id peak_year trough_year duration recovered recovery_years", "peak trough decline_rate", f"WITH {DEC} SELECT *, trough_year-peak_year AS duration, ry IS NOT NULL AS recovered, ry-trough_year AS recovery_years FROM rc")
def _(spark, sf):
    return l.decline_periods(d.panel(spark, sf), "revenue")


@query("market_resilience", "L22", "market declines", "rate severity frequency", f"WITH {DEC} SELECT market, count(*) AS declines, avg(CASE WHEN ry IS NOT NULL THEN 1.0 ELSE 0 END) AS rate, avg(abs(decline_rate)) AS severity, count(*)*1.0/(SELECT count(*) FROM entity x WHERE x.market=e.market) AS frequency FROM rc JOIN entity e USING (company_id) GROUP BY 1")
def _(spark, sf):
    return l.resilience(l.decline_periods(d.panel(spark, sf), "revenue"), d.entity(spark, sf))


@query("rejuvenation_factors", "L21", "factor", "z cohen_d r successes failures")
def _(spark, sf):
    return l.rejuvenation_factors(d.staged(spark, sf, share=False).select("company_id", "year", "margin", "rd_ratio"), l.decline_periods(d.panel(spark, sf), "revenue"), ["margin", "rd_ratio"])


@query("current_phase", "L24", "company_id current_stage current_run", "success risk")
def _(spark, sf):
    return l.current_phase(d.staged(spark, sf))


@query("kmeans_stages", "L6 L25", "company_id run_id stage model_stage first_year last_year overlap", "")
def _(spark, sf):
    p = reliable(d.staged(spark, sf, share=False).select("company_id", "year", "stage", "growth", "margin").na.fill(0.0, ["growth"]))
    model = l.stage_runs(l.kmeans_stages(p, ["growth", "margin"], (3, 4, 5, 6, 7)), "model_stage")
    return l.merge_phases(l.stage_runs(p), model)


@query("integrated_dataset", "L26 J3 J13", "company_id year stage duration event new_entity", "revenue margin", """SELECT l.company_id, l.year, stage, duration, event, l.start_year>1995 AS new_entity, revenue, margin FROM lc l JOIN surv USING (company_id)""")
def _(spark, sf):
    sv = d.survival(spark, sf).select("company_id", "duration", "event")
    return d.staged(spark, sf).join(sv, "company_id").withColumn("new_entity", c("start_year") > 1995)
