"""Emergence, succession and spin-off queries (inventory E1-E21)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..operators import emergence as e
from ..session import reliable
from ..sources import derive as d
from .clean import SPIN
from .registry import query

c = F.col


@query("new_entities", "E1", "company_id market start_year", "", "SELECT company_id, market, start_year FROM entity WHERE start_year > 1996")
def _(spark, sf):
    return e.new_entities(d.entity(spark, sf), 1996)


@query("emergence_timing", "E2", "company_id entry_rank era_early era_late pioneer early_follower", "age", """SELECT company_id, rank() OVER w AS entry_rank, start_year BETWEEN 1995 AND 1996 AS era_early, start_year BETWEEN 1997 AND 2001 AS era_late, rank() OVER w=1 AS pioneer,
 rank() OVER w>1 AND rank() OVER w<=.2*count(*) OVER (PARTITION BY market) AS early_follower, date_diff('day', established, DATE '2001-08-01')/365.25 AS age FROM entity WINDOW w AS (PARTITION BY market ORDER BY established)""")
def _(spark, sf):
    return e.timing_features(d.entity(spark, sf), "2001-08-01", {"early": (1995, 1996), "late": (1997, 2001)})


@query("parent_dependency", "E3", "company_id parent_id", "revenue_ratio total_assets_ratio employees_ratio independence", f"""WITH l AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC)=1)
SELECT a.company_id, parent_id, a.revenue/b.revenue AS revenue_ratio, a.total_assets/b.total_assets AS total_assets_ratio, a.employees/b.employees AS employees_ratio,
 least(1,a.revenue/b.revenue)*.4+least(1,a.total_assets/b.total_assets)*.3+least(1,a.employees/b.employees)*.3 AS independence FROM {SPIN} s JOIN l a ON a.company_id=s.child_id JOIN l b ON b.company_id=s.parent_id""")
def _(spark, sf):
    return e.parent_dependency(d.panel(spark, sf), d.entity(spark, sf).where("parent_id is not null"))


@query("initial_resources", "E3", "company_id capital_band", "resource_score", """WITH f AS (SELECT company_id, arg_min(total_assets,year) AS k, arg_min(employees,year) AS s FROM panel GROUP BY 1)
SELECT company_id, CASE WHEN k>=200 THEN 'large' WHEN k>=100 THEN 'medium' ELSE 'small' END AS capital_band, (CASE WHEN k>=200 THEN 1.0 WHEN k>=100 THEN .6 ELSE .3 END+CASE WHEN s>=400 THEN 1.0 WHEN s>=200 THEN .8 WHEN s>=100 THEN .5 ELSE .2 END)/2 AS resource_score FROM f""")
def _(spark, sf):
    return e.initial_resources(d.panel(spark, sf), (100.0, 200.0), (100.0, 200.0, 400.0))


@query("innovation_potential", "E3", "company_id", "innovation_potential", """SELECT company_id, least(1,rd_ratio/10)*.3+least(1,greatest(0,intangible_fixed_assets/total_assets*5))*.2+least(1,greatest(0,coalesce(growth,0)/100))*.3+least(1,segments_count/5)*.2 AS innovation_potential FROM lc
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC)=1""")
def _(spark, sf):
    return e.innovation_potential(d.staged(spark, sf))


@query("early_growth", "E4", "company_id n speed", "revenue_cagr employee_cagr margin_change productivity composite", """WITH g AS (SELECT company_id, count(*) AS n, arg_min(revenue,year) AS ra, arg_max(revenue,year) AS rz, arg_min(employees,year) AS ea, arg_max(employees,year) AS ez, arg_min(operating_profit/revenue,year) AS ma, arg_max(operating_profit/revenue,year) AS mz, max(year)-min(year) AS y
  FROM mpanel WHERE year<=start_year+3 GROUP BY 1 HAVING count(*)>=2), x AS (SELECT company_id, n, pow(rz/ra,1.0/y)-1 AS revenue_cagr, pow(ez/ea,1.0/y)-1 AS employee_cagr, mz-ma AS margin_change, rz/ez AS productivity FROM g)
SELECT *, CASE WHEN revenue_cagr>.3 THEN 'high' WHEN revenue_cagr>.1 THEN 'medium' ELSE 'low' END AS speed, least(1,greatest(0,revenue_cagr))*.4+least(1,greatest(0,margin_change+.1))*.3+least(1,productivity/10)*.3 AS composite FROM x""")
def _(spark, sf):
    return e.early_growth(d.mpanel(spark, sf), 3, 10.0)


SS = """ss AS (SELECT company_id, market, start_year, least(1,arg_max(revenue,year)/300)*.4+least(1,arg_max(employees,year)/300)*.3+least(1,(max(year)-start_year)/5.0)*.3 AS score FROM mpanel GROUP BY 1,2,3)"""


@query("emergence_success_score", "E5", "company_id market success_class", "score probability", f"WITH {SS} SELECT *, 1/(1+exp(-5*(score-.5))) AS probability, CASE WHEN score>=.8 THEN 'high' WHEN score>=.5 THEN 'medium' ELSE 'low' END AS success_class FROM ss")
def _(spark, sf):
    return e.success_score(d.mpanel(spark, sf), (300.0, 300.0, 5.0))


@query("emergence_success_patterns", "E5 G7", "start_year market n", "mean std success_rate", f"WITH {SS} SELECT start_year, market, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, avg(CASE WHEN score>=.5 THEN 1.0 ELSE 0 END) AS success_rate FROM ss GROUP BY 1,2")
def _(spark, sf):
    return e.success_by(e.success_score(d.mpanel(spark, sf), (300.0, 300.0, 5.0)), ["start_year", "market"])


@query("emergence_importance", "E5 E9", "factor n", "r importance", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{x}' AS factor, {x} AS v, margin AS y FROM lc" for x in ("rd_ratio", "ad_ratio", "capex_ratio", "share"))
       + ") SELECT factor, corr(v,y) AS r, abs(corr(v,y)) AS importance, count(*) AS n FROM l GROUP BY 1 ORDER BY importance DESC, factor LIMIT 3")
def _(spark, sf):
    return e.importance_by_correlation(d.staged(spark, sf), "margin", ["rd_ratio", "ad_ratio", "capex_ratio", "share"], 3)


@query("success_labels", "E6", "company_id label", "cagr weighted", """WITH g AS (SELECT company_id, arg_min(revenue,year) AS a, arg_max(revenue,year) AS z, max(year)-min(year) AS y, max(share) AS sh, min(CASE WHEN margin>0 THEN year END)-min(year) AS py, max(year-start_year) AS age FROM lc GROUP BY 1),
 x AS (SELECT *, CASE WHEN y>0 THEN pow(z/a,1.0/y)-1 ELSE 0 END AS cagr FROM g), w AS (SELECT *, CASE WHEN cagr>=.1 THEN .3 ELSE 0 END+CASE WHEN sh>=.3 THEN .25 ELSE 0 END+CASE WHEN py<=1 THEN .25 ELSE 0 END+CASE WHEN age>=5 THEN .2 ELSE 0 END AS weighted FROM x)
SELECT company_id, cagr, weighted, CASE WHEN weighted>=.6 THEN 1 ELSE 0 END AS label FROM w""")
def _(spark, sf):
    return e.success_labels(d.staged(spark, sf), 5, 0.1, 0.3, 1)


@query("success_model", "E7", "company_id start_year label", "probability lr rf gbt")
def _(spark, sf):
    # read twice, and both times shuffled by company
    p = reliable(d.staged(spark, sf).select("company_id", "year", "start_year", "share", "revenue", "margin", "rd_ratio", "capex_ratio"))
    x = p.groupBy("company_id", "start_year").agg(*[F.min_by(v, "year").alias(v) for v in ("revenue", "margin", "rd_ratio", "capex_ratio")])
    y = e.success_labels(p, 3, 0.0, 0.2, 2).select("company_id", c("label").cast("double").alias("label"))
    return e.success_model(x.join(y, "company_id"), "label", ["revenue", "margin", "rd_ratio", "capex_ratio"], "start_year", 1996)[0].withColumn("label", c("label").cast("int"))


@query("entry_timing_scan", "E8", "market wait phase rank", "score", """WITH m AS (SELECT market, year, sum(revenue) AS s FROM lc GROUP BY 1,2), b AS (SELECT market, pow(max(CASE WHEN year=2000 THEN s END)/max(CASE WHEN year=1995 THEN s END),.2)-1 AS g, max(CASE WHEN year=2000 THEN s END) AS size FROM m GROUP BY 1),
 x AS (SELECT *, cast(unnest(range(0,11)) AS int) AS wait, .5 AS k, 5 AS age FROM b), y AS (SELECT *, g*exp(-.1*wait) AS gg, size*pow(1+g,wait*1.0) AS sz FROM x), z AS (SELECT *, sz/max(sz) OVER (PARTITION BY market) AS rs FROM y),
 q AS (SELECT market, wait, least(1,greatest(0,least(1,greatest(0,gg*5))*.4+(1-least(1,k+.05*wait))*.3+least(1,rs)*.3)) AS score, CASE WHEN age+wait<2 THEN 'pioneer' WHEN age+wait<7 THEN 'growth' WHEN age+wait<15 THEN 'mature' ELSE 'late' END AS phase FROM z)
SELECT *, cast(row_number() OVER (PARTITION BY market ORDER BY score DESC, wait) AS int) AS rank FROM q""")
def _(spark, sf):
    m = d.staged(spark, sf).groupBy("market").agg(F.sum(F.when(c("year") == 2000, c("revenue"))).alias("size"), F.sum(F.when(c("year") == 1995, c("revenue"))).alias("a"))
    b = m.select("market", (F.pow(c("size") / c("a"), F.lit(0.2)) - 1).alias("growth"), F.lit(0.5).alias("competition"), "size", F.lit(5).alias("age"))
    return e.entry_scan(b, 10)


@query("startup_scores", "E9", "company_id", "score success", """WITH g AS (SELECT company_id, avg(growth) AS growth, avg(margin) AS margin, avg(rd_ratio) AS rd FROM lc GROUP BY 1 HAVING avg(growth) IS NOT NULL), m AS (SELECT min(growth) AS a, max(growth) AS b, min(margin) AS c, max(margin) AS d, min(rd) AS e, max(rd) AS f FROM g),
 s AS (SELECT company_id, (growth-a)/(b-a)*.4+(margin-c)/(d-c)*.4+(rd-e)/(f-e)*.2 AS score FROM g, m) SELECT *, CASE WHEN score >= (SELECT quantile_cont(score,.7) FROM s) THEN 1 ELSE 0 END AS success FROM s""")
def _(spark, sf):
    g = d.staged(spark, sf).groupBy("company_id").agg(F.avg("growth").alias("growth"), F.avg("margin").alias("margin"), F.avg("rd_ratio").alias("rd")).where("growth is not null")
    return e.startup_score(g, {"growth": 0.4, "margin": 0.4, "rd": 0.2})


@query("entity_metrics", "E10", "company_id n years_to_profit level", "cagr margin_slope stability score", """WITH g AS (SELECT company_id, count(*) AS n, arg_min(revenue,year) AS a, arg_max(revenue,year) AS z, max(year)-min(year) AS y, cast(min(CASE WHEN margin>0 THEN year END)-min(year) AS int) AS years_to_profit, CASE WHEN count(*)>1 THEN regr_slope(margin,year) END AS margin_slope, avg(margin) AS m, stddev_samp(growth) AS gs FROM lc GROUP BY 1),
 x AS (SELECT *, CASE WHEN y>0 THEN pow(z/a,1.0/y)-1 ELSE 0 END AS cagr, 1/(1+coalesce(gs,0)/100) AS stability FROM g), s AS (SELECT *, least(1,greatest(0,cagr))*.3+least(1,greatest(0,m/20))*.25+stability*.25+least(1,y/10.0)*.2 AS score FROM x)
SELECT *, CASE WHEN score>=(SELECT quantile_cont(score,.8) FROM s) THEN 'excellent' WHEN score>=(SELECT quantile_cont(score,.6) FROM s) THEN 'good' WHEN score>=(SELECT quantile_cont(score,.4) FROM s) THEN 'average' ELSE 'low' END AS level FROM s""")
def _(spark, sf):
    return e.entity_metrics(d.staged(spark, sf))


@query("growth_curves", "E11", "company_id n curve", "r2")
def _(spark, sf):
    return e.growth_curves(d.panel(spark, sf), "revenue")


@query("trajectory_projection", "E13 F1", "company_id year", "predicted confidence", """WITH g AS (SELECT company_id, regr_slope(revenue,year) AS s, regr_intercept(revenue,year) AS i, regr_r2(revenue,year) AS confidence, max(year) AS y FROM panel GROUP BY 1 HAVING count(*)>=3)
SELECT company_id, cast(y+k AS int) AS year, i+s*(y+k) AS predicted, confidence FROM g, (SELECT unnest([1,2,3]) AS k)""")
def _(spark, sf):
    return e.linear_projection(d.panel(spark, sf), "revenue", 3)


def spin(spark, sf):
    return d.entity(spark, sf).where("parent_id is not null").select(c("parent_id").alias("company_id"), F.when(c("start_year") < 1996, "early_spinoff").otherwise("late_spinoff").alias("event_type"),
                                                                     c("start_year").alias("event_year"))


PPC = ["revenue", "operating_profit", "total_assets", "employees", "shareholders_equity", "roa"]
PP = f"""pp AS (SELECT p.company_id, CASE WHEN event_year<1996 THEN 'early_spinoff' ELSE 'late_spinoff' END AS event_type, event_year, {', '.join(f"avg(CASE WHEN year<event_year THEN {x} END) AS {x}_pre, avg(CASE WHEN year>event_year THEN {x} END) AS {x}_post" for x in PPC)}
 FROM (SELECT *, net_profit/total_assets AS roa FROM lc) p JOIN {SPIN} s ON s.parent_id=p.company_id WHERE year BETWEEN event_year-3 AND event_year+3 GROUP BY 1,2,3), pc AS (SELECT *, {', '.join(f"({x}_post-{x}_pre)/nullif(abs({x}_pre),0)*100 AS {x}_change" for x in PPC)} FROM pp WHERE revenue_pre IS NOT NULL AND revenue_post IS NOT NULL)"""


def pre_post(spark, sf):
    p = d.staged(spark, sf).withColumn("roa", sd("net_profit", "total_assets"))
    return e.pre_post(p, spin(spark, sf), PPC)


@query("succession_pre_post", "E14 J6", "company_id event_type event_year", "revenue_pre revenue_post revenue_change operating_profit_change", f"WITH {PP} SELECT * FROM pc", digits=4)
def _(spark, sf):
    return pre_post(spark, sf)


def n50(x):
    return f"(least(greatest({x},-50),50)*2)"


@query("integration_scores", "E15 J5", "company_id event_type event_year", "revenue_synergy cost_synergy scale_effect score", f"""WITH {PP}, sh AS (SELECT s.parent_id AS company_id, s.event_year, max(CASE WHEN year<event_year THEN share END) AS a, max(CASE WHEN year>event_year THEN share END) AS z FROM {SPIN} s JOIN lc ON lc.company_id=s.parent_id AND year IN (event_year-1, event_year+2) GROUP BY 1,2)
SELECT company_id, event_type, event_year, revenue_change-3 AS revenue_synergy, operating_profit_change-revenue_change AS cost_synergy, ((revenue_post/total_assets_post)-(revenue_pre/total_assets_pre))/(revenue_pre/total_assets_pre)*100 AS scale_effect,
 ({n50('revenue_change')}+{n50('operating_profit_change')}+{n50('roa_change')})/3*.4+({n50('(revenue_change-3)')}+{n50('(operating_profit_change-revenue_change)')}+{n50('roa_change')})/3*.3
 +coalesce(CASE WHEN (z-a)/a IS NULL THEN NULL ELSE least(greatest((z-a)/a*100*2,-100),100) END,0)*.2+(50+CASE WHEN shareholders_equity_change IS NULL THEN 0 ELSE least(greatest(shareholders_equity_change,-50),50) END)*.1 AS score FROM pc LEFT JOIN sh USING (company_id, event_year)""", digits=4)
def _(spark, sf):
    return e.integration_score(pre_post(spark, sf), e.share_change(d.staged(spark, sf), spin(spark, sf)))


@query("succession_effectiveness", "E16", "event_type n", "revenue_change", f"WITH {PP} SELECT event_type, count(*) AS n, avg(revenue_change) AS revenue_change FROM pc GROUP BY 1", digits=4)
def _(spark, sf):
    return e.effectiveness(e.integration_score(pre_post(spark, sf), e.share_change(d.staged(spark, sf), spin(spark, sf))))


def z1(x):
    return f"least(greatest({x}/100,-1),1)"


SPS = f"sps AS (SELECT company_id, event_type, event_year, {z1('revenue_change')}*.3+CASE WHEN operating_profit_change IS NULL THEN 0 ELSE {z1('operating_profit_change')} END*.25+{z1('total_assets_change')}*.25+{z1('employees_change')}*.2 AS score, abs(revenue_change-total_assets_change) AS r FROM pc)"


@query("spinoff_success", "E17", "company_id event_year", "score risk_adjusted", f"WITH {PP}, {SPS} SELECT *, score/(1+r/100) AS risk_adjusted FROM sps")
def _(spark, sf):
    return e.spinoff_success(pre_post(spark, sf))


@query("spinoff_patterns", "E18", "market timing n", "mean success_rate", f"WITH {PP}, {SPS} SELECT market, CASE WHEN event_year=1997 THEN 'crisis' WHEN event_year=1996 THEN 'growth' ELSE 'normal' END AS timing, count(*) AS n, avg(score) AS mean, avg(CASE WHEN score>0 THEN 1.0 ELSE 0 END) AS success_rate FROM sps JOIN entity USING (company_id) GROUP BY 1,2")
def _(spark, sf):
    return e.spinoff_patterns(e.spinoff_success(pre_post(spark, sf)), d.entity(spark, sf), (1997,), (1996,))


@query("event_registration", "E20 IO4", "user_id event_type event_id", "value", """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)=1""")
def _(spark, sf):
    ev = d.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("stamp"))
    return e.register(ev.where("value < 100"), ev.where("value >= 100"), ["user_id", "event_type"], "stamp")


@query("emergence_progress", "E19", "company_id market entry_year last_year", "mean_growth growth_spread margin_trend survival profitability innovation overall", """WITH g AS (SELECT company_id, market, min(year) AS entry_year, max(year) AS last_year,
  avg(CASE WHEN growth<>0 THEN growth END) AS mean_growth, stddev_pop(CASE WHEN growth<>0 THEN growth END) AS growth_spread, arg_max(margin, year) AS m, arg_max(rd_ratio, year) AS r, regr_slope(margin, year) AS margin_trend FROM comp GROUP BY 1,2),
 s AS (SELECT *, least(1,greatest(0,(2001-entry_year)/5.0)) AS survival, coalesce(least(1,greatest(0,m/20)),0) AS profitability, coalesce(least(1,greatest(0,r/10)),0) AS innovation FROM g)
SELECT *, (survival+profitability+innovation)/3 AS overall FROM s""", digits=4)
def _(spark, sf):
    return e.emergence_progress(d.competition(spark, sf), 2001)


@query("extinction_process", "E21", "company_id event_type cause", "debt_ratio value record_quality", """WITH ev AS (SELECT company_id, event_type, year(event_date) AS y FROM ledger WHERE event_type IN ('bankruptcy','dissolution')), l AS (SELECT e.company_id, event_type, y, count(*) AS n, max(year) AS ly, arg_max(total_liabilities/total_assets,year) AS debt_ratio, arg_max(net_profit,year) AS np, arg_max(total_assets,year) AS ta
  FROM panel p JOIN ev e ON p.company_id=e.company_id AND year<=y GROUP BY 1,2,3) SELECT company_id, event_type, debt_ratio, CASE WHEN debt_ratio>.7 THEN 'excess_debt' WHEN np<0 THEN 'losses' ELSE 'other' END AS cause, ta*.8 AS value, least(1,n/5.0)*.5+CASE WHEN y-ly<=1 THEN .5 ELSE 0 END AS record_quality FROM l""")
def _(spark, sf):
    return e.extinction_process(d.panel(spark, sf), d.ledger(spark, sf).where("event_type in ('bankruptcy','dissolution')"))
