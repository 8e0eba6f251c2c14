"""Time-series feature queries (inventory T1-T33)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..functions.windows import growth
from ..operators import timeseries as t
from ..sources import derive as d
from .registry import query

c = F.col
K = "company_id year"
TP = ("(SELECT *, operating_profit/revenue AS margin, net_profit/nullif(shareholders_equity,0) AS roe, "
      "(revenue-cost_of_sales)/revenue AS va FROM stages)")
PW = "PARTITION BY company_id ORDER BY year"
IX = f"""(SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year)-1 AS i, count(*) OVER (PARTITION BY company_id) AS n, revenue AS v,
  lag(revenue) OVER (PARTITION BY company_id ORDER BY year) AS p FROM panel)"""


def tp(spark, sf):
    return d.stages(spark, sf).select("*", sd("operating_profit", "revenue").alias("margin"), sd("net_profit", "shareholders_equity").alias("roe"),
                                      sd(c("revenue") - c("cost_of_sales"), "revenue").alias("va"))


def c0(x):
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 0 ELSE {x} END)"


def third(tno, f):
    return f"{f}(CASE WHEN th={tno} THEN v END, CASE WHEN th={tno} THEN i END) FILTER (WHERE th={tno})"


@query("trend_pack", "T1", "company_id n", "slope intercept r2 monotonic acceleration residual_std trend_early trend_mid trend_late", f"""
WITH x AS (SELECT *, v-p AS dv, CASE WHEN i < n//3 THEN 0 WHEN i < 2*n//3 THEN 1 ELSE 2 END AS th FROM {IX} WHERE n>=3),
 y AS (SELECT *, dv-lag(dv) OVER ({PW}) AS ddv, regr_slope(v,i) OVER (PARTITION BY company_id) AS s FROM x)
SELECT company_id, n, regr_slope(v,i) AS slope, regr_intercept(v,i) AS intercept, pow({c0('corr(v,i)')},2) AS r2,
 greatest(count(CASE WHEN dv>0 THEN 1 END), count(CASE WHEN dv<0 THEN 1 END))*1.0/(n-1) AS monotonic, avg(ddv) AS acceleration, stddev_pop(v-s*i) AS residual_std,
 {', '.join(f"CASE WHEN count(CASE WHEN th={k} THEN 1 END)>=2 THEN (arg_max(v,i) FILTER (WHERE th={k})-arg_min(v,i) FILTER (WHERE th={k}))/count(CASE WHEN th={k} THEN 1 END) ELSE 0 END AS trend_{nm}" for k, nm in enumerate(('early', 'mid', 'late')))}
FROM y GROUP BY company_id, n""")
def _(spark, sf):
    return t.trend_pack(d.panel(spark, sf), "revenue")


@query("volatility_pack", "T2", "company_id n", "std cv range iqr returns_std downside_std clustering persistence", f"""
WITH x AS (SELECT *, (v-p)/p AS r FROM {IX} WHERE n>=2), q AS (SELECT *, abs(r) AS a, lag(abs(r)) OVER ({PW}) AS pa, quantile_cont(abs(r),.75) OVER (PARTITION BY company_id) AS q FROM x),
 h AS (SELECT *, coalesce(a>q,false) AS hi FROM q), z AS (SELECT *, i-row_number() OVER (PARTITION BY company_id, hi ORDER BY year) AS isle FROM h),
 cl AS (SELECT company_id, sum(l*l) AS cl FROM (SELECT company_id, isle, count(*) AS l FROM z WHERE hi GROUP BY 1,2) GROUP BY 1),
 g AS (SELECT company_id, n, stddev_pop(v) AS std, stddev_pop(v)/abs(avg(v)) AS cv, max(v)-min(v) AS range, quantile_cont(v,.75)-quantile_cont(v,.25) AS iqr, coalesce(stddev_pop(r),0) AS returns_std,
   coalesce(stddev_pop(CASE WHEN r<0 THEN r END),0) AS downside_std, count(r) AS nr, {c0('corr(a,pa)')} AS persistence FROM z GROUP BY 1,2)
SELECT *, CASE WHEN nr>=3 THEN coalesce(cl,0)*1.0/nr ELSE 0 END AS clustering FROM g LEFT JOIN cl USING (company_id)""")
def _(spark, sf):
    return t.volatility_pack(d.panel(spark, sf), "revenue")


@query("growth_pack", "T3", "company_id n", "cagr mean_growth median_growth growth_std max_growth min_growth positive_share acceleration consistency", f"""
WITH x AS (SELECT *, (v-p)/abs(p) AS r FROM {IX} WHERE n>=2), y AS (SELECT *, r-lag(r) OVER ({PW}) AS dr FROM x)
SELECT company_id, n, pow(arg_max(v,i)/arg_min(v,i), 1.0/(n-1))-1 AS cagr, avg(r) AS mean_growth, quantile_cont(r,.5) AS median_growth, stddev_pop(r) AS growth_std, max(r) AS max_growth, min(r) AS min_growth,
 count(CASE WHEN r>0 THEN 1 END)*1.0/count(r) AS positive_share, coalesce(avg(dr),0) AS acceleration,
 CASE WHEN count(r)>=2 THEN greatest(count(CASE WHEN r>0 THEN 1 END),count(CASE WHEN r<0 THEN 1 END))*1.0/count(r) ELSE .5 END AS consistency FROM y GROUP BY 1,2""")
def _(spark, sf):
    return t.growth_pack(d.panel(spark, sf), "revenue")


@query("growth_link", "T3", "company_id n", "growth_corr mean_gap", f"""WITH x AS (SELECT company_id, (revenue-lag(revenue) OVER ({PW}))/lag(revenue) OVER ({PW}) AS a,
  (total_assets-lag(total_assets) OVER ({PW}))/lag(total_assets) OVER ({PW}) AS b FROM panel)
SELECT company_id, count(a) AS n, {c0('corr(a,b)')} AS growth_corr, avg(a)-avg(b) AS mean_gap FROM x GROUP BY 1""", digits=5)
def _(spark, sf):
    return t.growth_link(d.panel(spark, sf), "revenue", "total_assets")


@query("cycle_pack", "T4", "company_id n", "max_autocorr autocorr_decay peak_frequency trough_frequency regularity crossing_rate amplitude", f"""
WITH x AS (SELECT *, v-regr_slope(v,i) OVER e*i-regr_intercept(v,i) OVER e AS er, lead(v) OVER w AS nx, lag(v,2) OVER w AS p2, lag(v,3) OVER w AS p3 FROM {IX} WHERE n>=4 WINDOW e AS (PARTITION BY company_id), w AS ({PW})),
 y AS (SELECT *, lag(er) OVER ({PW}) AS per, CASE WHEN v>p AND v>nx THEN i END AS pk, CASE WHEN v<p AND v<nx THEN i END AS tr FROM x),
 z AS (SELECT *, pk-last_value(pk IGNORE NULLS) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pg, tr-last_value(tr IGNORE NULLS) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tg FROM y),
 g AS (SELECT company_id, n, {c0('corr(v,p)')} AS c1, {c0('corr(v,p2)')} AS c2, CASE WHEN n>=6 THEN {c0('corr(v,p3)')} END AS c3, count(pk) AS np, count(tr) AS nt, avg(pg) AS pm, stddev_pop(pg) AS ps, avg(tg) AS tm, stddev_pop(tg) AS ts,
   count(CASE WHEN er*per<0 THEN 1 END)*1.0/n AS crossing_rate, stddev_pop(er) AS amplitude FROM z GROUP BY 1,2),
 s AS (SELECT *, list_filter([c1,c2,c3], lambda q: q IS NOT NULL AND abs(q)>.1) AS sig FROM g)
SELECT company_id, n, greatest(c1,c2,c3) AS max_autocorr, CASE WHEN len(sig)<2 THEN 1.0 ELSE least(abs(sig[-1]/sig[1]),1) END AS autocorr_decay,
 CASE WHEN n>=5 THEN np*1.0/n ELSE 0 END AS peak_frequency, CASE WHEN n>=5 THEN nt*1.0/n ELSE 0 END AS trough_frequency,
 CASE WHEN n>=5 AND np>1 AND nt>1 THEN greatest(0,least(1,((1-ps/pm)+(1-ts/tm))/2)) ELSE 0 END AS regularity, crossing_rate, amplitude FROM s""")
def _(spark, sf):
    return t.cycle_pack(d.panel(spark, sf), "revenue", max_lag=3)


def stab(x, k):
    return f"(CASE WHEN count({x})>={k} AND avg({x})<>0 THEN 1/(1+stddev_samp({x})/abs(avg({x}))) ELSE 0 END)"


@query("lifecycle_pack", "T5", "company_id n stage_transitions age era", "startup_mean growth_growth maturity_std decline_mean decline_share maturity coverage", f"""
WITH x AS (SELECT *, row_number() OVER ({PW})-1 AS i, count(*) OVER (PARTITION BY company_id) AS n, CASE WHEN g>.15 THEN 'high' WHEN g>.05 THEN 'stable' WHEN g>0 THEN 'low' WHEN g IS NOT NULL THEN 'decline' END AS k FROM {TP}),
 y AS (SELECT *, least(i//greatest(n//4,1),3) AS b, last_value(k IGNORE NULLS) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM x)
SELECT company_id, n, cast(CASE WHEN count(g)>=5 THEN count(CASE WHEN k<>pk THEN 1 END) ELSE 0 END AS bigint) AS stage_transitions, avg(CASE WHEN b=0 THEN revenue END) AS startup_mean,
 CASE WHEN count(CASE WHEN b=1 THEN 1 END)>=2 THEN (arg_max(revenue,year) FILTER (WHERE b=1)-arg_min(revenue,year) FILTER (WHERE b=1))/arg_min(revenue,year) FILTER (WHERE b=1) ELSE 0 END AS growth_growth,
 stddev_samp(CASE WHEN b=2 THEN revenue END) AS maturity_std, avg(CASE WHEN b=3 THEN revenue END) AS decline_mean,
 CASE WHEN count(g)>=5 THEN count(CASE WHEN k='decline' THEN 1 END)*1.0/count(g) ELSE 0 END AS decline_share, ({stab('g', 3)}+{stab('margin', 3)}+{stab('roe', 3)})/3 AS maturity,
 cast(coalesce(year(any_value(extinction)),2001)-any_value(start_year) AS int) AS age, 'bubble_collapse' AS era0,
 CASE WHEN any_value(start_year)<2000 THEN 'bubble_collapse' ELSE 'digital_transformation' END AS era,
 CASE WHEN coalesce(year(any_value(extinction)),2001)-any_value(start_year)>0 THEN n*1.0/(coalesce(year(any_value(extinction)),2001)-any_value(start_year)) ELSE 0 END AS coverage FROM y GROUP BY company_id, n""")
def _(spark, sf):
    return t.lifecycle_pack(tp(spark, sf), "revenue", "g", "margin", "roe", 2001)


@query("survival_pack", "T6", "company_id", "margin_risk roe_risk growth_risk stability_risk recent_stability overall_risk margin_slope", f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS back FROM {TP}),
 gr AS (SELECT company_id, max(l) AS longest FROM (SELECT company_id, isle, count(*) AS l FROM (SELECT company_id, g, row_number() OVER ({PW})-row_number() OVER (PARTITION BY company_id, g<0 ORDER BY year) AS isle
   FROM x WHERE g IS NOT NULL) WHERE g<0 GROUP BY 1,2) GROUP BY 1),
 a AS (SELECT company_id, {', '.join(f"CASE WHEN count({m})>=2 THEN least(1, count(CASE WHEN {m}<0 THEN 1 END)*.7/count({m})+least(CASE WHEN avg({m})<>0 THEN stddev_samp({m})/abs(avg({m})) ELSE 1 END/2,.3)) ELSE .5 END AS {m}_risk" for m in ('margin', 'roe'))},
  count(g) AS ng, ({'+'.join(f"CASE WHEN count({m})>2 THEN {stab(m, 3)} ELSE 0 END" for m in ('revenue', 'margin', 'roe'))})/nullif({'+'.join(f"CASE WHEN count({m})>2 THEN 1 ELSE 0 END" for m in ('revenue', 'margin', 'roe'))},0) AS ms,
  ({stab('CASE WHEN back<=5 THEN margin END', 2)}+{stab('CASE WHEN back<=5 THEN roe END', 2)})/2 AS recent_stability, CASE WHEN count(*)>1 THEN regr_slope(CASE WHEN back<=5 THEN margin END,-back) ELSE 0 END AS margin_slope FROM x GROUP BY 1),
 b AS (SELECT *, CASE WHEN ng<3 THEN .5 ELSE coalesce(longest,0)*1.0/ng END AS growth_risk, coalesce(1-ms,.5) AS stability_risk FROM a LEFT JOIN gr USING (company_id))
SELECT *, (margin_risk+roe_risk+growth_risk+stability_risk)/4 AS overall_risk FROM b""")
def _(spark, sf):
    return t.survival_pack(tp(spark, sf), "g", "margin", "roe", "revenue")


@query("emergence_pack", "T7", "company_id n rapid_duration rapid_runs era", "initial_growth initial_margin initial_stability competitiveness growth_sustainability financial_sustainability", f"""
WITH x AS (SELECT *, row_number() OVER ({PW}) AS i, count(*) OVER (PARTITION BY company_id) AS n FROM {TP}), y AS (SELECT *, i <= CASE WHEN n>=2 THEN least(5,n//2) ELSE n END AS ini FROM x),
 rr AS (SELECT company_id, max(l) AS d, count(*) AS r FROM (SELECT company_id, isle, count(*) AS l FROM (SELECT company_id, g, row_number() OVER ({PW})-row_number() OVER (PARTITION BY company_id, g>.2 ORDER BY year) AS isle FROM x WHERE g IS NOT NULL) WHERE g>.2 GROUP BY 1,2) GROUP BY 1),
 a AS (SELECT company_id, n, CASE WHEN count(CASE WHEN ini THEN 1 END)>=2 THEN pow(arg_max(revenue,year) FILTER (WHERE ini)/arg_min(revenue,year) FILTER (WHERE ini), 1.0/(count(CASE WHEN ini THEN 1 END)-1))-1 ELSE 0 END AS initial_growth,
  avg(CASE WHEN ini THEN margin END) AS initial_margin, ({stab('CASE WHEN ini THEN margin END', 2)}+{stab('CASE WHEN ini THEN roe END', 2)})/2 AS initial_stability,
  [least(1,greatest(0,avg(margin))*5), least(1,greatest(0,coalesce(avg(g),0))*2), least(1,greatest(0,coalesce(avg(roe),0))*2), least(1,greatest(0,avg(va)))] AS cp,
  coalesce(avg(CASE WHEN g>0 THEN 1.0 WHEN g IS NOT NULL THEN 0 END),0) AS growth_sustainability, avg(CASE WHEN margin>0 THEN 1.0 ELSE 0 END) AS financial_sustainability, any_value(start_year) AS sy FROM y GROUP BY 1,2)
SELECT a.*, coalesce(d,0) AS rapid_duration, coalesce(r,0) AS rapid_runs, CASE WHEN sy<2000 THEN 'early_digital' ELSE 'digital_transformation' END AS era, list_sum(cp)/len(cp) AS competitiveness FROM a LEFT JOIN rr USING (company_id)""")
def _(spark, sf):
    return t.emergence_pack(tp(spark, sf), "revenue", "g", "margin", "roe", "va")


@query("rolling_slopes", "T8 T9", K, "slope decline_rate", f"""WITH x AS (SELECT *, row_number() OVER ({PW}) AS i FROM panel)
SELECT company_id, year, CASE WHEN count(revenue) OVER w >= 3 THEN regr_slope(revenue, i) OVER w END AS slope, (revenue-lag(revenue,2) OVER ({PW}))/(lag(revenue,2) OVER ({PW})+1e-6) AS decline_rate
FROM x WINDOW w AS ({PW} ROWS 2 PRECEDING)""")
def _(spark, sf):
    p = t.with_row(d.panel(spark, sf))
    return p.select("company_id", "year", t.rolling_slope("revenue", 3).alias("slope"), t.change_eps("revenue", 2).alias("decline_rate"))


@query("decline_counters", "T10", f"{K} decline_count longest_decline", "consecutive_decline", f"""
WITH x AS (SELECT *, coalesce(revenue<lag(revenue) OVER ({PW}),false) AS dn, row_number() OVER ({PW}) AS i FROM panel), y AS (SELECT *, i-row_number() OVER (PARTITION BY company_id, dn ORDER BY year) AS isle FROM x),
 z AS (SELECT *, cast(CASE WHEN dn THEN row_number() OVER (PARTITION BY company_id, dn, isle ORDER BY year) ELSE 0 END AS int) AS decline_count FROM y)
SELECT company_id, year, decline_count, max(decline_count) OVER (PARTITION BY company_id) AS longest_decline, CASE WHEN decline_count>=3 THEN 1 ELSE 0 END AS consecutive_decline FROM z""")
def _(spark, sf):
    return t.decline_counters(d.panel(spark, sf), "revenue")


@query("stress_scores", "T11 T16", K, "compression stagnation deceleration delay burden consistency", f"""
WITH x AS (SELECT *, revenue/lag(revenue) OVER ({PW})-1 AS gr FROM mpanel)
SELECT company_id, year, CASE WHEN count(revenue) OVER w>=3 THEN (avg(revenue) OVER w-revenue)/(avg(revenue) OVER w+1e-6) END AS compression,
 CASE WHEN count(revenue) OVER w>=3 AND stddev_samp(revenue) OVER w < stddev_samp(revenue) OVER (PARTITION BY company_id)*.1 THEN 1 ELSE 0 END AS stagnation, gr-lag(gr) OVER ({PW}) AS deceleration,
 (avg(revenue) OVER (PARTITION BY market,year)-revenue)/(avg(revenue) OVER (PARTITION BY market,year)+1e-6) AS delay, ln(1+revenue) AS burden,
 1/(1+stddev_samp(revenue) OVER (PARTITION BY company_id)/avg(revenue) OVER (PARTITION BY company_id)) AS consistency FROM x WINDOW w AS ({PW} ROWS 2 PRECEDING)""")
def _(spark, sf):
    return t.stress_scores(d.mpanel(spark, sf), "revenue", 3)


@query("volatility_anomaly", "T12 T13", K, "rolling_std volatility_anomaly sudden_changes", f"""
WITH x AS (SELECT *, CASE WHEN count(revenue) OVER w>=2 THEN stddev_samp(revenue) OVER w END AS v, {'+'.join(f"CASE WHEN abs({m}/nullif(lag({m}) OVER ({PW}),0)-1)>.3 THEN 1 ELSE 0 END" for m in ('revenue', 'operating_profit', 'net_profit'))} AS sudden_changes FROM panel WINDOW w AS ({PW} ROWS 1 PRECEDING))
SELECT *, v AS rolling_std, CASE WHEN v > quantile_cont(v,.9) OVER (PARTITION BY company_id) THEN 1 ELSE 0 END AS volatility_anomaly FROM x""")
def _(spark, sf):
    return t.sudden_changes(t.volatility_anomaly(d.panel(spark, sf), "revenue", 2), ["revenue", "operating_profit", "net_profit"])


@query("entity_trends", "T18", "company_id n", "slope deteriorating cv very_volatile volatile", """SELECT *, CASE WHEN slope<0 THEN 1 ELSE 0 END AS deteriorating, CASE WHEN cv>1 THEN 1 ELSE 0 END AS very_volatile, CASE WHEN cv>.3 THEN 1 ELSE 0 END AS volatile
FROM (SELECT company_id, count(*) AS n, regr_slope(revenue,year) AS slope, stddev_samp(revenue)/abs(avg(revenue)) AS cv FROM panel GROUP BY 1 HAVING count(*)>=3)""")
def _(spark, sf):
    return t.entity_trend(d.panel(spark, sf), "revenue")


@query("momentum", "T19", "company_id", "m_revenue m_net_profit momentum", """SELECT *, (m_revenue+m_net_profit)/2 AS momentum FROM (SELECT company_id, regr_slope(revenue,-b) AS m_revenue, regr_slope(net_profit,-b) AS m_net_profit
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b FROM panel) WHERE b<=3 GROUP BY 1)""")
def _(spark, sf):
    return t.momentum(d.panel(spark, sf), ["revenue", "net_profit"])


@query("growth_indicator_frame", "T20 T21", K, "growth growth_acc productivity expansion", f"""WITH x AS (SELECT company_id, year, revenue/lag(revenue) OVER w-1 AS g, revenue/employees AS p, total_assets/lag(total_assets) OVER w-1 AS e FROM panel WINDOW w AS ({PW})),
 y AS (SELECT *, g-lag(g) OVER ({PW}) AS a FROM x) SELECT company_id, year, avg(g) OVER w AS growth, avg(a) OVER w AS growth_acc, avg(p) OVER w AS productivity, avg(e) OVER w AS expansion FROM y WINDOW w AS ({PW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(spark, sf):
    return t.growth_frame(d.panel(spark, sf))


@query("resampled_trajectory", "T22", "company_id j", "value", """WITH a AS (SELECT company_id, list(revenue ORDER BY year) AS a, count(*) AS n FROM panel GROUP BY 1 HAVING count(*)>=2),
 x AS (SELECT *, cast(unnest(range(5)) AS int) AS j FROM a), y AS (SELECT *, j*(n-1)/4.0 AS pos FROM x)
SELECT company_id, j, a[cast(floor(pos) AS int)+1]+(a[cast(ceil(pos) AS int)+1]-a[cast(floor(pos) AS int)+1])*(pos-floor(pos)) AS value FROM y""")
def _(spark, sf):
    return t.resample(d.panel(spark, sf), "revenue", 5)


@query("turning_points", "T23", K, "value d2", f"""WITH x AS (SELECT company_id, year, revenue AS value, lead(revenue) OVER w-2*revenue+lag(revenue) OVER w AS d2 FROM panel WINDOW w AS ({PW}))
SELECT * FROM (SELECT *, stddev_pop(d2) OVER (PARTITION BY company_id) AS s FROM x) WHERE abs(d2)>1.2*s""")
def _(spark, sf):
    return t.turning_points(d.panel(spark, sf), "revenue", 1.2)


@query("series_peaks", "T24", K, "height", f"""WITH s AS (SELECT company_id, year, avg(revenue) OVER ({PW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, row_number() OVER ({PW}) AS i FROM panel),
 p AS (SELECT * FROM (SELECT *, lag(s) OVER ({PW}) AS a, lead(s) OVER ({PW}) AS b FROM s) WHERE s>a AND s>b), g AS (SELECT *, coalesce(i-lag(i) OVER ({PW}),3) AS gap FROM p),
 r AS (SELECT *, sum(CASE WHEN gap>=3 THEN 1 ELSE 0 END) OVER ({PW}) AS r FROM g) SELECT company_id, arg_max(year, (s,-year)) AS year, max(s) AS height FROM r GROUP BY company_id, r""")
def _(spark, sf):
    return t.peaks(d.panel(spark, sf), "revenue", 1, 3)


@query("trend_labels", "T25", "company_id n trend", "slope r2 strength", f"""WITH g AS (SELECT company_id, n, regr_slope(v,i) AS slope, pow({c0('corr(v,i)')},2) AS r2, {c0('corr(v,p)')} AS ac, stddev_pop(v)/abs(avg(v)) AS cv FROM {IX} WHERE n>=4 GROUP BY 1,2)
SELECT *, CASE WHEN r2<.3 THEN 'volatile' WHEN abs(slope)<.01 THEN 'stable' WHEN slope>0 THEN 'increasing' ELSE 'decreasing' END AS trend, greatest(0,least(1,ac+1-cv/2)) AS strength FROM g""")
def _(spark, sf):
    return t.trend_label(d.panel(spark, sf), "revenue", 4)


MONTHS = """(SELECT o_orderpriority AS market, cast((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS int) AS m, cast(cast(sum(cast(o_totalprice AS decimal(18,2))) AS decimal(24,0)) AS double)/1e6 AS v FROM orders GROUP BY 1,2)"""


def monthly(spark, sf):
    o = d.table(spark, sf, "orders")
    m = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return o.groupBy(c("o_orderpriority").alias("market"), m.alias("m")).agg(
        (F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("decimal(24,0)").cast("double") / 1e6).alias("v"))


@query("seasonal_decomposition", "T26", "market phase", "seasonal strength", f"""WITH x AS (SELECT *, CASE WHEN count(v) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)=13 THEN (sum(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)+(lag(v,6) OVER w+lead(v,6) OVER w)/2)/12 END AS t
   FROM {MONTHS} WINDOW w AS (PARTITION BY market ORDER BY m)), dd AS (SELECT *, v-t AS d, m%12 AS phase FROM x), s0 AS (SELECT market, phase, avg(d) AS s FROM dd GROUP BY 1,2), s AS (SELECT *, s-avg(s) OVER (PARTITION BY market) AS seasonal FROM s0),
 g AS (SELECT market, greatest(0,1-var_pop(d-seasonal)/var_pop(d)) AS strength FROM dd JOIN s USING (market, phase) GROUP BY 1) SELECT market, phase, seasonal, strength FROM s JOIN g USING (market)""")
def _(spark, sf):
    return t.seasonality(monthly(spark, sf), "market", "m", "v", 12)


@query("structural_breaks", "T27", "company_id year merged", "t")
def _(spark, sf):
    return t.breaks_t(d.panel(spark, sf), "revenue", 3)


@query("cusum_breaks", "T28", "company_id n year break_found", "cusum threshold", f"""WITH e AS (SELECT company_id, year, revenue-avg(revenue) OVER e AS x, stddev_pop(revenue) OVER e AS s FROM panel WINDOW e AS (PARTITION BY company_id)),
 k AS (SELECT *, abs(sum(x) OVER ({PW})) AS cu FROM e), g AS (SELECT company_id, count(*) AS n, round(max(cu),9) AS cusum, arg_max(year,(round(cu,9),-year)) AS year, .5*max(s)*sqrt(count(*)) AS threshold FROM k GROUP BY 1)
SELECT *, cusum>threshold AS break_found FROM g WHERE n>2""")
def _(spark, sf):
    return t.cusum(d.panel(spark, sf), "revenue", 0.5).where("n > 2")


@query("regimes", "T29", "company_id regime first_year last_year n", "mean std", f"""WITH b AS (SELECT *, coalesce(abs(revenue/lag(revenue) OVER ({PW})-1)>.5,false) AS b FROM panel), r AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER ({PW}) AS regime FROM b)
SELECT company_id, cast(regime AS bigint) AS regime, min(year) AS first_year, max(year) AS last_year, count(*) AS n, avg(revenue) AS mean, stddev_pop(revenue) AS std FROM r GROUP BY 1,2""")
def _(spark, sf):
    p = d.panel(spark, sf).withColumn("_b", F.abs(growth("revenue")) > 0.5)
    return t.regimes(p, "revenue", c("_b"))


@query("dominant_cycle", "T30", "company_id n", "power", f"""WITH x AS (SELECT *, v-avg(v) OVER (PARTITION BY company_id) AS x FROM {IX} WHERE n>=4), e AS (SELECT *, unnest(range(1, n//2+1)) AS k FROM x),
 p AS (SELECT company_id, n, k, pow(sum(x*cos(2*pi()*k*i/n)),2)+pow(sum(x*sin(2*pi()*k*i/n)),2) AS p FROM e GROUP BY 1,2,3) SELECT company_id, n, max(p) AS power FROM p GROUP BY 1,2""", digits=3)
def _(spark, sf):
    return t.dominant_cycle(d.panel(spark, sf), "revenue")


@query("decline_signals", "T32", "company_id level", "score", f"""WITH l AS (SELECT company_id, year, 'r' AS m, revenue AS v FROM panel WHERE year>1996 UNION ALL SELECT company_id, year, 'p', net_profit FROM panel WHERE year>1996),
 k AS (SELECT *, abs(v/nullif(lag(v) OVER (PARTITION BY company_id, m ORDER BY year),0)-1) AS g FROM l), a AS (SELECT company_id, m, count(v) AS n, regr_slope(v,year) AS s, regr_r2(v,year) AS r, max(g) AS g FROM k GROUP BY 1,2 HAVING count(v)>=3),
 z AS (SELECT company_id, sum(CASE WHEN s<0 AND r>.5 THEN 1 ELSE 0 END+CASE WHEN g>.3 THEN .5 ELSE 0 END) AS score FROM a GROUP BY 1)
SELECT *, CASE WHEN score>=2.5 THEN 'high' ELSE 'medium' END AS level FROM z WHERE score>=1.5 ORDER BY score DESC, company_id LIMIT 20""")
def _(spark, sf):
    return t.trend_signals(d.panel(spark, sf), ["revenue", "net_profit"], 2001)


@query("sequence_windows", "T33", f"{K} past_sum_len", "past_sum target", f"""SELECT company_id, year, 3 AS past_sum_len, lag(revenue,1) OVER w+lag(revenue,2) OVER w+lag(revenue,3) OVER w AS past_sum, revenue AS target FROM panel WINDOW w AS ({PW})
QUALIFY count(*) OVER ({PW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)=3""")
def _(spark, sf):
    s = t.sequence_windows(d.panel(spark, sf), "revenue", 3)
    return s.select("company_id", "year", F.size("past").alias("past_sum_len"), F.aggregate("past", F.lit(0.0), lambda a, x: a + x).alias("past_sum"), "target")
