"""Aggregations, ranking, correlation, regression and test queries (inventory G, R, S, A)."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.cols import ladder, safe_corr, sd
from ..functions.ranks import exact_quantiles, long, with_ranks
from ..operators import regression as rg
from ..operators import selection
from ..operators import stats as st
from ..sources import derive as d
from .registry import query

c = F.col
K = "company_id year"
CR = "SELECT '{a}' AS x, '{b}' AS y, corr({a},{b}) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n"


def one(spark, row: dict):
    return spark.createDataFrame([tuple(float(v) for v in row.values())], ", ".join(f"{k} double" for k in row))


# ---- aggregations ------------------------------------------------------------------

@query("market_describe", "G1 G8 K7", "market n", "mean median std lo hi", """SELECT market, count(*) AS n, avg(revenue) AS mean, quantile_cont(revenue,.5) AS median,
 stddev_samp(revenue) AS std, min(revenue) AS lo, max(revenue) AS hi FROM mpanel GROUP BY 1""")
def _(spark, sf):
    p = d.mpanel(spark, sf)
    q = exact_quantiles(p, ["market"], "revenue", {"median": 0.5}).drop("n")
    return p.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg("revenue").alias("mean"), F.stddev_samp("revenue").alias("std"),
                                   F.min("revenue").alias("lo"), F.max("revenue").alias("hi")).join(q, "market")


@query("status_shares", "G2 G10", "market status n", "share", """SELECT market, status, n, n*1.0/sum(n) OVER (PARTITION BY market) AS share
FROM (SELECT market, status, count(*) AS n FROM entity GROUP BY 1,2)""")
def _(spark, sf):
    g = d.entity(spark, sf).groupBy("market", "status").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("market")))  # rows: market x status


@query("status_crosstab", "G3", "market active extinct", "", """SELECT market, count(CASE WHEN status='active' THEN 1 END) AS active,
 count(CASE WHEN status='extinct' THEN 1 END) AS extinct FROM entity GROUP BY 1""")
def _(spark, sf):
    return st.crosstab(d.entity(spark, sf), "market", "status", ["active", "extinct"])


@query("distinct_entities", "G4", "market year entities", "", "SELECT market, year, count(DISTINCT company_id) AS entities FROM mpanel GROUP BY 1,2")
def _(spark, sf):
    return d.mpanel(spark, sf).groupBy("market", "year").agg(F.countDistinct("company_id").alias("entities"))


@query("weighted_mean", "G6", "market", "wmean wstd", """SELECT market, wm AS wmean, sqrt(sum(total_assets*(net_profit-wm)*(net_profit-wm))/sum(total_assets)) AS wstd
FROM mpanel JOIN (SELECT market, sum(total_assets*net_profit)/sum(total_assets) AS wm FROM mpanel GROUP BY 1) USING (market) GROUP BY 1,2""")
def _(spark, sf):
    w, x = c("total_assets"), c("net_profit")
    g = d.mpanel(spark, sf).groupBy("market").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    m = c("wx") / c("w")
    return g.select("market", m.alias("wmean"), F.sqrt(c("wxx") / c("w") - m * m).alias("wstd"))


@query("cube_report", "G8", "market stage n", "mean", "SELECT market, stage, count(*) AS n, avg(revenue) AS mean FROM stages GROUP BY CUBE (market, stage)")
def _(spark, sf):
    return d.stages(spark, sf).cube("market", "stage").agg(F.count(F.lit(1)).alias("n"), F.avg("revenue").alias("mean"))


@query("extinction_summary", "G10 G11", "market entities extinct", "rate mean_duration mean_active_age", """SELECT market, count(*) AS entities, cast(sum(event) AS bigint) AS extinct,
 avg(event) AS rate, avg(CASE WHEN event=1 THEN duration END)/365.25 AS mean_duration, avg(CASE WHEN event=0 THEN duration END)/365.25 AS mean_active_age FROM surv GROUP BY 1""")
def _(spark, sf):
    e = c("event") == 1
    return d.survival(spark, sf).groupBy("market").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("event").alias("extinct"), F.avg("event").alias("rate"),
        (F.avg(F.when(e, c("duration"))) / 365.25).alias("mean_duration"),
        (F.avg(F.when(~e, c("duration"))) / 365.25).alias("mean_active_age"))


@query("event_timeline", "G11 G12", "event_type year n", "", "SELECT event_type, cast(year(event_date) AS int) AS year, count(*) AS n FROM ledger GROUP BY 1,2")
def _(spark, sf):
    return d.ledger(spark, sf).groupBy("event_type", F.year("event_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("success_by_era", "G7", "era market n", "mean_margin", """SELECT CASE WHEN start_year < 1996 THEN 'early' WHEN start_year < 1998 THEN 'mid' ELSE 'late' END AS era, market,
 count(*) AS n, avg(operating_profit/revenue) AS mean_margin FROM mpanel GROUP BY 1,2""")
def _(spark, sf):
    era = ladder([(c("start_year") < 1996, "early"), (c("start_year") < 1998, "mid")], "late")
    return d.mpanel(spark, sf).groupBy(era.alias("era"), "market").agg(
        F.count(F.lit(1)).alias("n"), F.avg(sd("operating_profit", "revenue")).alias("mean_margin"))


@query("running_product", "G14", K, "wealth", f"""SELECT company_id, year, exp(sum(ln(1+.1*operating_profit/revenue)) OVER (PARTITION BY company_id ORDER BY year)) AS wealth FROM panel""")
def _(spark, sf):
    from ..functions.windows import W

    w = W().rowsBetween(Window.unboundedPreceding, 0)
    return d.panel(spark, sf).withColumn("wealth", F.exp(F.sum(F.log1p(0.1 * sd("operating_profit", "revenue"))).over(w)))


@query("composition_by_age", "G15", "stage young old", "active_share", """SELECT stage, count(CASE WHEN year-start_year<3 THEN 1 END) AS young, count(CASE WHEN year-start_year>=3 THEN 1 END) AS old,
 avg(CASE WHEN status='active' THEN 1.0 ELSE 0 END) AS active_share FROM stages GROUP BY 1""")
def _(spark, sf):
    young = (c("year") - c("start_year")) < 3
    return d.stages(spark, sf).groupBy("stage").agg(F.count(F.when(young, 1)).alias("young"), F.count(F.when(~young, 1)).alias("old"),
                                                    F.avg((c("status") == "active").cast("double")).alias("active_share"))


# ---- ranking -------------------------------------------------------------------------

@query("market_ranks", "R1 R2 R3", f"market {K} rank_desc", "pct score_pct", """SELECT market, company_id, year, cast(dense_rank() OVER (PARTITION BY market, year ORDER BY sales DESC) AS bigint) AS rank_desc,
 (rank() OVER w + (count(*) OVER (PARTITION BY market, year, sales)-1)/2.0)/count(*) OVER (PARTITION BY market, year) AS pct,
 (rank() OVER w - 1 + rank() OVER w - 1 + count(*) OVER (PARTITION BY market, year, sales) + 1)/2.0/count(*) OVER (PARTITION BY market, year) AS score_pct
FROM market_share WINDOW w AS (PARTITION BY market, year ORDER BY sales)""")
def _(spark, sf):
    r = with_ranks(d.market_share(spark, sf), ["market", "year"], "sales")
    return r.select("*", (c("n_distinct") - c("dense") + 1).alias("rank_desc"), (c("avg_rank") / c("n")).alias("pct"),
                    ((c("lt") + c("le") + (c("lt") < c("le")).cast("int")) / (2.0 * c("n"))).alias("score_pct"))


@query("entry_order", "R4", "company_id market entry_rank first_mover late_entrant", "", """SELECT company_id, market, cast(dense_rank() OVER (PARTITION BY market ORDER BY established) AS bigint) AS entry_rank,
 dense_rank() OVER (PARTITION BY market ORDER BY established) <= 3 AS first_mover,
 start_year > avg(start_year) OVER (PARTITION BY market) + stddev_samp(start_year) OVER (PARTITION BY market) AS late_entrant FROM entity""")
def _(spark, sf):
    from ..operators.market import entry_order

    return entry_order(d.entity(spark, sf))


@query("top_suppliers", "R5", "market year company_id", "sales", """SELECT market, year, company_id, sales FROM market_share
QUALIFY row_number() OVER (PARTITION BY market, year ORDER BY sales DESC, company_id) <= 2""")
def _(spark, sf):
    from ..operators.market import top_k

    return top_k(d.market_share(spark, sf), ["market", "year"], "sales", 2)


@query("largest_customers", "R6", "company_id", "revenue", "SELECT company_id, sum(revenue) AS revenue FROM panel GROUP BY 1 ORDER BY revenue DESC, company_id LIMIT 20")
def _(spark, sf):
    return d.panel(spark, sf).groupBy("company_id").agg(F.sum("revenue").alias("revenue")).orderBy(F.desc("revenue"), "company_id").limit(20)


@query("quantile_bins", "R7", f"{K} q_bin w_bin", "revenue", """SELECT company_id, year, revenue, 1+(CASE WHEN revenue>q1 THEN 1 ELSE 0 END)+(CASE WHEN revenue>q2 THEN 1 ELSE 0 END)+(CASE WHEN revenue>q3 THEN 1 ELSE 0 END) AS q_bin,
 CASE WHEN revenue<50 THEN 'small' WHEN revenue<200 THEN 'mid' ELSE 'large' END AS w_bin
FROM panel, (SELECT quantile_cont(revenue,.25) AS q1, quantile_cont(revenue,.5) AS q2, quantile_cont(revenue,.75) AS q3 FROM panel)""")
def _(spark, sf):
    from ..functions.cols import with_totals

    p = d.panel(spark, sf)
    q = exact_quantiles(p, [], "revenue", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n")
    b = F.lit(1)
    for x in ("q1", "q2", "q3"):
        b = b + (c("revenue") > c(x)).cast("int")
    return with_totals(p, q).withColumn("q_bin", b).withColumn("w_bin", ladder([(c("revenue") < 50, "small"), (c("revenue") < 200, "mid")], "large"))


@query("metric_facts_long", "IO9 S4", f"{K} metric", "value", """SELECT company_id, year, 'revenue' AS metric, revenue AS value FROM panel UNION ALL SELECT company_id, year, 'employees', employees FROM panel""")
def _(spark, sf):
    return long(d.panel(spark, sf), ["company_id", "year"], ["revenue", "employees"])


@query("metric_facts_wide", "IO9", K, "revenue employees", "SELECT company_id, year, revenue, employees FROM panel")
def _(spark, sf):
    v = long(d.panel(spark, sf), ["company_id", "year"], ["revenue", "employees"])
    return v.groupBy("company_id", "year").pivot("metric", ["revenue", "employees"]).agg(F.first("value"))


@query("sql_report", "IO2", "market year n", "revenue", "SELECT market, year, count(*) AS n, sum(revenue) AS revenue FROM mpanel WHERE year >= 1998 GROUP BY 1,2")
def _(spark, sf):
    return spark.sql("SELECT market, year, count(*) AS n, sum(revenue) AS revenue FROM {p} WHERE year >= 1998 GROUP BY market, year",
                     p=d.mpanel(spark, sf))


# ---- correlation -----------------------------------------------------------------------

XS = ["revenue", "net_profit", "employees"]
PAIRS = [("revenue", "net_profit"), ("revenue", "employees"), ("net_profit", "employees")]


@query("correlation_matrix", "A1 A5", "x y n", "r", " UNION ALL ".join(CR.format(a=a, b=b) + " FROM panel" for a, b in PAIRS))
def _(spark, sf):
    return st.correlation(d.panel(spark, sf), XS)


@query("correlation_by_market", "A2", "market x y n", "r", " UNION ALL ".join(CR.format(a=a, b=b).replace("SELECT", "SELECT market,") + " FROM mpanel GROUP BY 1" for a, b in PAIRS))
def _(spark, sf):
    return st.correlation(d.mpanel(spark, sf), XS, ["market"])


@query("spearman_matrix", "A1", "x y n", "r", "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {x})+(count(*) OVER (PARTITION BY {x})-1)/2.0 AS {x}" for x in XS) + " FROM panel) "
       + " UNION ALL ".join(CR.format(a=a, b=b) + " FROM r" for a, b in PAIRS))
def _(spark, sf):
    return st.spearman(d.panel(spark, sf), ["company_id", "year"], XS)


@query("kendall_tau", "A1", "n", "discordant concordant tau", """WITH t AS (SELECT company_id AS i, duration AS x, balance AS y FROM surv),
 p AS (SELECT sum(CASE WHEN (a.x-b.x)*(a.y-b.y)>0 THEN 1.0 ELSE 0 END) AS con, sum(CASE WHEN (a.x-b.x)*(a.y-b.y)<0 THEN 1.0 ELSE 0 END) AS dis,
  sum(CASE WHEN a.x<>b.x THEN 1.0 ELSE 0 END) AS nx, sum(CASE WHEN a.y<>b.y THEN 1.0 ELSE 0 END) AS ny FROM t a JOIN t b ON a.i<b.i)
SELECT (SELECT count(*) FROM t) AS n, dis AS discordant, con AS concordant, (con-dis)/sqrt(nx*ny) AS tau FROM p""")
def _(spark, sf):
    return st.kendall(d.survival(spark, sf), "duration", "balance")


@query("partial_correlation", "A3", "x y", "partial_r", """WITH k AS (SELECT corr(revenue,net_profit) AS ab, corr(revenue,employees) AS ac, corr(net_profit,employees) AS bc FROM panel)
SELECT 'revenue' AS x, 'net_profit' AS y, (ab-ac*bc)/sqrt((1-ac*ac)*(1-bc*bc)) AS partial_r FROM k UNION ALL
SELECT 'revenue', 'employees', (ac-ab*bc)/sqrt((1-ab*ab)*(1-bc*bc)) FROM k UNION ALL SELECT 'net_profit', 'employees', (bc-ab*ac)/sqrt((1-ab*ab)*(1-ac*ac)) FROM k""")
def _(spark, sf):
    return st.partial_correlation(d.panel(spark, sf), XS)


@query("conditional_correlation", "A4", "band n", "r", """SELECT 1+(CASE WHEN employees>q1 THEN 1 ELSE 0 END)+(CASE WHEN employees>q2 THEN 1 ELSE 0 END) AS band, count(*) AS n, corr(revenue, net_profit) AS r
FROM panel, (SELECT quantile_cont(employees,1/3.0) AS q1, quantile_cont(employees,2/3.0) AS q2 FROM panel) GROUP BY 1""")
def _(spark, sf):
    return st.conditional_correlation(d.panel(spark, sf), "revenue", "net_profit", "employees")


@query("mutual_information", "A6", "", "mi", """WITH b AS (SELECT least(floor((revenue-a)/(b-a)*10),9) AS x, least(floor((net_profit-e)/(f-e)*10),9) AS y FROM panel,
  (SELECT min(revenue) AS a, max(revenue) AS b, min(net_profit) AS e, max(net_profit) AS f FROM panel)),
 j AS (SELECT x, y, count(*)*1.0 AS n FROM b GROUP BY 1,2), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j)
SELECT sum(n/t*ln(n*t/(nx*ny))) AS mi FROM m""")
def _(spark, sf):
    return st.mutual_information(d.panel(spark, sf), "revenue", "net_profit")


@query("survivor_correlation", "A7 A21", "n_all n_survivors", "r_all r_survivors", """SELECT count(*) AS n_all, count(CASE WHEN status='active' THEN 1 END) AS n_survivors, corr(revenue,net_profit) AS r_all,
 corr(CASE WHEN status='active' THEN revenue END, CASE WHEN status='active' THEN net_profit END) AS r_survivors FROM mpanel""")
def _(spark, sf):
    return st.survivor_correlation(d.mpanel(spark, sf), "revenue", "net_profit", c("status") == "active")


@query("factor_impact", "A8 A14 R6", "metric n", "r slope intercept r2 f_stat", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS metric, {x} AS v, operating_profit/revenue AS y FROM panel" for x in ("capex", "rd_expenses", "employees", "inventories"))
    + ") SELECT metric, count(*) AS n, corr(v,y) AS r, regr_slope(y,v) AS slope, regr_intercept(y,v) AS intercept, regr_r2(y,v) AS r2, regr_r2(y,v)*(count(*)-2)/(1-regr_r2(y,v)) AS f_stat FROM l GROUP BY 1")
def _(spark, sf):
    p = d.panel(spark, sf).withColumn("y", sd("operating_profit", "revenue"))
    v = p.select("y", "capex", "rd_expenses", "employees", "inventories").unpivot(["y"], ["capex", "rd_expenses", "employees", "inventories"], "metric", "v")
    g = v.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), safe_corr("v", "y").alias("r"), F.regr_slope("y", "v").alias("slope"),
                                F.regr_intercept("y", "v").alias("intercept"), F.regr_r2("y", "v").alias("r2"))
    return g.withColumn("f_stat", c("r2") * (c("n") - 2) / (1 - c("r2")))


# ---- regression ---------------------------------------------------------------------------

OLS2 = """s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, sum(w) AS sw, {m}
  FROM t {g}), b AS (SELECT *, (s1y*s22-s2y*s12)/(s11*s22-s12*s12) AS b1, (s2y*s11-s1y*s12)/(s11*s22-s12*s12) AS b2 FROM s)"""


def wcov(a, b):
    return f"(sum(w*{a}*{b})/sum(w)-sum(w*{a})/sum(w)*sum(w*{b})/sum(w))"


WM = f"""sum(w*y)/sum(w) AS wy, sum(w*x1)/sum(w) AS w1, sum(w*x2)/sum(w) AS w2, {wcov('x1', 'x1')} AS s11, {wcov('x2', 'x2')} AS s22, {wcov('x1', 'x2')} AS s12, {wcov('x1', 'y')} AS s1y, {wcov('x2', 'y')} AS s2y, {wcov('y', 'y')} AS syy"""


def reg_panel(spark, sf):
    return d.mpanel(spark, sf).select("company_id", "year", "market", "status", "start_year", sd("operating_profit", "revenue").alias("y"),
                                      sd("returned", "gross").alias("x1"), sd("rd_expenses", "revenue").alias("x2"))


T0 = """t AS (SELECT company_id, year, market, status, start_year, operating_profit/revenue AS y, returned/gross AS x1, rd_expenses/revenue AS x2, {w} AS w FROM mpanel),"""
COEF = """SELECT 'intercept' AS term, wy-b1*w1-b2*w2 AS coef, n, (b1*s1y+b2*s2y)/syy AS r2 {x} FROM b UNION ALL SELECT 'x1', b1, n, (b1*s1y+b2*s2y)/syy {x} FROM b UNION ALL SELECT 'x2', b2, n, (b1*s1y+b2*s2y)/syy {x} FROM b"""


@query("ols", "A10", "term", "coef r2", f"WITH {T0.format(w='1.0')} {OLS2.format(m=WM, g='')} {COEF.format(x='')}", digits=5)
def _(spark, sf):
    return rg.ols(reg_panel(spark, sf), "y", ["x1", "x2"]).table(spark)


@query("ols_standard_errors", "A10", "term", "se t", f"""WITH {T0.format(w='1.0')} {OLS2.format(m=WM, g='')},
 v AS (SELECT *, (syy-b1*s1y-b2*s2y)/(n-3) AS s2, s11*s22-s12*s12 AS det FROM b)
SELECT 'x1' AS term, sqrt(s2*s22/det) AS se, b1/sqrt(s2*s22/det) AS t FROM v UNION ALL SELECT 'x2', sqrt(s2*s11/det), b2/sqrt(s2*s11/det) FROM v""", digits=4)
def _(spark, sf):
    return rg.ols(reg_panel(spark, sf), "y", ["x1", "x2"]).table(spark).where("term <> 'intercept'")


@query("ols_survival_weighted", "U25 A10", "term", "coef", f"""WITH {T0.format(w="greatest((year-start_year)*1.0/6, .1)")} {OLS2.format(m=WM, g='')} {COEF.format(x='')}""", digits=5)
def _(spark, sf):
    return rg.ols(rg.age_weight(reg_panel(spark, sf)), "y", ["x1", "x2"], weight="weight").table(spark)


@query("ols_status_weighted", "U25", "term", "coef", f"""WITH {T0.format(w="1/greatest(avg(CASE WHEN status='active' THEN 1.0 ELSE 0 END) OVER (PARTITION BY market, year-start_year), .1)")} {OLS2.format(m=WM, g='')} {COEF.format(x='')}""", digits=5)
def _(spark, sf):
    return rg.ols(rg.status_rate_weight(reg_panel(spark, sf)), "y", ["x1", "x2"], weight="weight").table(spark)


@query("ols_by_market", "A15", "market term", "coef n r2 adj_r2", f"""WITH {T0.format(w='1.0')} {OLS2.format(m='market, ' + WM, g='GROUP BY market')}, z AS ({COEF.format(x=', market')})
SELECT *, 1-(1-r2)*(n-1)/(n-3) AS adj_r2 FROM z""", digits=5)
def _(spark, sf):
    return rg.ols_by(reg_panel(spark, sf), ["market"], "y", ["x1", "x2"])


def candidates(spark, sf):
    return d.mpanel(spark, sf).select(sd("operating_profit", "revenue").alias("y"), sd("returned", "gross").alias("returns"), (c("balance") / 1000.0).alias("balance"),
                                      sd("sg_a_expenses", "revenue").alias("overhead"), sd("inventories", "revenue").alias("stock"), c("year").cast("double").alias("year"))


# every subset of two candidates from its sums; the path goes on while a better one is a step away
@query("stepwise_path", "A14", "step action term", "rss bic", """WITH x AS (SELECT operating_profit/revenue AS y, returned/gross AS a, balance/1000 AS b FROM mpanel), k AS (SELECT * FROM x WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
 v AS (SELECT count(*)*1.0 AS n, count(*)*var_pop(y) AS yy, count(*)*var_pop(a) AS aa, count(*)*var_pop(b) AS bb, count(*)*covar_pop(a,y) AS ay, count(*)*covar_pop(b,y) AS by_, count(*)*covar_pop(a,b) AS ab FROM k),
 r AS (SELECT *, yy-ay*ay/aa AS ra, yy-by_*by_/bb AS rb, yy-(ay*ay*bb-2*ay*by_*ab+by_*by_*aa)/(aa*bb-ab*ab) AS rab FROM v),
 s AS (SELECT *, n*ln(yy/n)+ln(n) AS k0, n*ln(ra/n)+2*ln(n) AS ka, n*ln(rb/n)+2*ln(n) AS kb, n*ln(rab/n)+3*ln(n) AS kab FROM r)
SELECT cast(0 AS int) AS step, 'start' AS action, NULL AS term, yy AS rss, k0 AS bic FROM s
UNION ALL SELECT 1, 'in', CASE WHEN ka<=kb THEN 'returns' ELSE 'balance' END, least(ra,rb), least(ka,kb) FROM s WHERE least(ka,kb)<k0
UNION ALL SELECT 2, 'in', CASE WHEN ka<=kb THEN 'balance' ELSE 'returns' END, rab, kab FROM s WHERE least(ka,kb)<k0 AND kab<least(ka,kb)""")
def _(spark, sf):
    return selection.path_table(spark, selection.stepwise(selection.gram(candidates(spark, sf), "y", ["returns", "balance"]))[0])


@query("stepwise_model", "A14 A8", "term", "coef se t p")
def _(spark, sf):
    return selection.selected_model(candidates(spark, sf), "y", ["returns", "balance", "overhead", "stock", "year"])


@query("interaction_ols", "A9", "term", "coef")
def _(spark, sf):
    p = reg_panel(spark, sf).withColumn("x1_x2", c("x1") * c("x2"))
    return rg.ols(p, "y", ["x1", "x2", "x1_x2"]).table(spark)


@query("sliding_window_impact", "A9 T31", "last_year n", "r slope", """SELECT cast(w.last_year AS int) AS last_year, count(*) AS n, corr(y,x) AS r, regr_slope(y,x) AS slope
FROM (SELECT year, operating_profit/revenue AS y, returned/gross AS x FROM panel), (SELECT unnest(range(1997,2002)) AS last_year) w WHERE year BETWEEN last_year-2 AND last_year GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, sf):
    from ..operators.timeseries import rolling_pooled

    return rolling_pooled(reg_panel(spark, sf), "y", "x1", 3, 1997, 2001)


@query("elastic_net", "A11", "term", "coef")
def _(spark, sf):
    return rg.elastic_net(reg_panel(spark, sf), "y", ["x1", "x2"], 0.01, 0.5)[0]


@query("huber_regression", "A11", "term", "coef")
def _(spark, sf):
    return rg.elastic_net(reg_panel(spark, sf), "y", ["x1", "x2"], 0.0, loss="huber")[0]


@query("ridge_alpha_cv", "A11 X6", "alpha", "rmse")
def _(spark, sf):
    return rg.choose_alpha(reg_panel(spark, sf), "y", ["x1", "x2"], [0.01, 1.0, 10.0])


@query("panel_fixed_effects", "A12", "term", "coef", """WITH t AS (SELECT company_id, operating_profit/revenue AS y, returned/gross AS x1 FROM panel),
 m AS (SELECT y-avg(y) OVER (PARTITION BY company_id) AS y, x1-avg(x1) OVER (PARTITION BY company_id) AS x1 FROM t)
SELECT 'x1' AS term, sum(y*x1)/sum(x1*x1) AS coef FROM m""")
def _(spark, sf):
    return rg.fixed_effects(reg_panel(spark, sf), "y", ["x1"], period=None).table(spark)


@query("clustered_standard_error", "A12", "term", "se", """WITH t AS (SELECT company_id, operating_profit/revenue AS y, returned/gross AS x1 FROM panel),
 m AS (SELECT company_id, y-avg(y) OVER e AS y, x1-avg(x1) OVER e AS x1 FROM t WINDOW e AS (PARTITION BY company_id)), b AS (SELECT sum(y*x1)/sum(x1*x1) AS b, sum(x1*x1) AS a, count(*) AS n FROM m),
 s AS (SELECT company_id, sum(x1*(y-b*x1)) AS s FROM m, b GROUP BY 1), g AS (SELECT sum(s*s) AS meat, count(*) AS g FROM s)
SELECT 'x1' AS term, sqrt(meat/(a*a)*g/(g-1.0)*(n-1)/(n-1)) AS se FROM g, b""")
def _(spark, sf):
    return rg.fixed_effects(reg_panel(spark, sf), "y", ["x1"], period=None).table(spark)


@query("regression_diagnostics", "A13", "", "durbin_watson jarque_bera", f"""WITH {T0.format(w='1.0')} {OLS2.format(m=WM, g='')},
 e AS (SELECT t.*, y-(wy-b1*w1-b2*w2)-b1*x1-b2*x2 AS e FROM t, b), l AS (SELECT *, lag(e) OVER (PARTITION BY company_id ORDER BY year) AS p FROM e),
 k AS (SELECT count(*) AS n, avg(e) AS m FROM e), mm AS (SELECT n, avg(pow(e-m,2)) AS m2, avg(pow(e-m,3)) AS m3, avg(pow(e-m,4)) AS m4 FROM e, k GROUP BY n)
SELECT (SELECT sum((e-p)*(e-p))/(SELECT sum(e*e) FROM e) FROM l) AS durbin_watson, n/6.0*(pow(m3/pow(m2,1.5),2)+pow(m4/(m2*m2)-3,2)/4) AS jarque_bera FROM mm""", digits=3)
def _(spark, sf):
    p = reg_panel(spark, sf)
    r = rg.residuals(p, "y", rg.ols(p, "y", ["x1", "x2"]))
    from ..functions.cols import with_totals

    return with_totals(rg.durbin_watson(r), st.normality(r, "residual").select(c("jb").alias("jarque_bera")))


@query("variance_inflation", "A13", "term", "vif", "SELECT unnest(['x1','x2']) AS term, 1/(1-pow(corr(returned/gross, rd_expenses/revenue),2)) AS vif FROM panel")
def _(spark, sf):
    return rg.vif(reg_panel(spark, sf), ["x1", "x2"])


@query("white_and_serial_tests", "A13", "test", "statistic df p")
def _(spark, sf):
    p = reg_panel(spark, sf)
    fit = rg.ols(p, "y", ["x1", "x2"])
    a, b = rg.white_test(p, "y", ["x1", "x2"], fit), rg.breusch_godfrey(p, "y", ["x1", "x2"], fit)
    return spark.createDataFrame([("white", *a.values()), ("breusch_godfrey", *b.values())], "test string, statistic double, df double, p double")


# ---- tests ------------------------------------------------------------------------------------

MOM = "g AS (SELECT market, count(*)*1.0 AS n, avg(y) AS m, var_samp(y) AS v FROM t GROUP BY 1), a AS (SELECT sum(n) AS n, count(*) AS k, sum(n*m)/sum(n) AS gm FROM g)"
TY = "t AS (SELECT market, operating_profit/revenue AS y, CASE WHEN status='active' THEN 1 ELSE 0 END AS alive FROM mpanel)"


@query("anova_by_market", "A16 A24", "", "f eta2 welch_f", f"""WITH {TY}, {MOM},
 s AS (SELECT sum(g.n*pow(m-gm,2)) AS ssb, sum((g.n-1)*v) AS ssw, any_value(a.n) AS n, any_value(k) AS k FROM g, a),
 w AS (SELECT sum(n/v) AS sw, sum(n/v*m)/sum(n/v) AS wm, count(*) AS k FROM g), l AS (SELECT sum(pow(1-n/v/sw,2)/(n-1)) AS lam, sum(n/v*pow(m-wm,2)) AS num, any_value(w.k) AS k FROM g, w)
SELECT ssb/(s.k-1)/(ssw/(n-s.k)) AS f, ssb/(ssb+ssw) AS eta2, num/(l.k-1)/(1+2*(l.k-2)/(l.k*l.k-1.0)*lam) AS welch_f FROM s, l""")
def _(spark, sf):
    return one(spark, st.anova(reg_panel(spark, sf), "market", "y"))


@query("kruskal_by_market", "A16", "", "h epsilon2", f"""WITH {TY}, r AS (SELECT market, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 AS r, count(*) OVER (PARTITION BY y) AS c FROM t),
 n AS (SELECT count(*)*1.0 AS n, sum(c*c-1.0) AS ties FROM r), s AS (SELECT sum(sr*sr/k) AS q FROM (SELECT sum(r) AS sr, count(*) AS k FROM r GROUP BY market)),
 h AS (SELECT (12/(n*(n+1))*q-3*(n+1))/(1-ties/(n*n*n-n)) AS h, n FROM s, n) SELECT h, h*(n+1)/(n*n-1) AS epsilon2 FROM h""", digits=4)
def _(spark, sf):
    return one(spark, st.kruskal(reg_panel(spark, sf), "market", "y"))


@query("t_tests", "A17", "", "t df welch_t welch_df cohen_d", f"""WITH {TY}, g AS (SELECT count(CASE WHEN alive=0 THEN 1 END)*1.0 AS n0, count(CASE WHEN alive=1 THEN 1 END)*1.0 AS n1,
 avg(CASE WHEN alive=0 THEN y END) AS m0, avg(CASE WHEN alive=1 THEN y END) AS m1, var_samp(CASE WHEN alive=0 THEN y END) AS v0, var_samp(CASE WHEN alive=1 THEN y END) AS v1 FROM t),
 p AS (SELECT *, ((n0-1)*v0+(n1-1)*v1)/(n0+n1-2) AS sp, v0/n0 AS a, v1/n1 AS b FROM g)
SELECT (m1-m0)/sqrt(sp*(1/n0+1/n1)) AS t, n0+n1-2 AS df, (m1-m0)/sqrt(a+b) AS welch_t, (a+b)*(a+b)/(a*a/(n0-1)+b*b/(n1-1)) AS welch_df, (m1-m0)/sqrt(sp) AS cohen_d FROM p""", digits=4)
def _(spark, sf):
    return st.t_test(reg_panel(spark, sf).withColumn("alive", (c("status") == "active").cast("int")), "alive", "y")


@query("mann_whitney", "A17 L21", "", "u z", f"""WITH {TY}, r AS (SELECT alive, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 AS r, count(*) OVER (PARTITION BY y) AS c FROM t),
 s AS (SELECT sum(CASE WHEN alive=1 THEN r END) AS s1, count(CASE WHEN alive=1 THEN 1 END)*1.0 AS n1, count(CASE WHEN alive=0 THEN 1 END)*1.0 AS n0, sum(c*c-1.0) AS ties FROM r),
 u AS (SELECT *, s1-n1*(n1+1)/2 AS u, n0+n1 AS n FROM s) SELECT u, (u-n0*n1/2)/sqrt(n0*n1/12*((n+1)-ties/(n*(n-1)))) AS z FROM u""", digits=4)
def _(spark, sf):
    return st.mann_whitney(reg_panel(spark, sf).withColumn("alive", (c("status") == "active").cast("int")), "alive", "y")


@query("levene_by_market", "A17", "", "f", f"""WITH {TY.replace("operating_profit/revenue AS y", "abs(operating_profit/revenue-quantile_cont(operating_profit/revenue,.5) OVER (PARTITION BY market)) AS y")}, {MOM}
SELECT sum(g.n*pow(m-gm,2))/(any_value(k)-1)/(sum((g.n-1)*v)/(any_value(a.n)-any_value(k))) AS f FROM g, a""")
def _(spark, sf):
    return one(spark, st.levene(reg_panel(spark, sf), "market", "y"))


@query("ks_two_sample", "A17", "n_a n_b", "ks", f"""WITH {TY}, k AS (SELECT y, sum(CASE WHEN alive=0 THEN 1 ELSE 0 END) AS a, sum(alive) AS b FROM t GROUP BY 1),
 q AS (SELECT sum(a) OVER (ORDER BY y) AS ca, sum(b) OVER (ORDER BY y) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM k)
SELECT max(abs(ca*1.0/na-cb*1.0/nb)) AS ks, cast(max(na) AS bigint) AS n_a, cast(max(nb) AS bigint) AS n_b FROM q""")
def _(spark, sf):
    return st.ks_test(reg_panel(spark, sf).withColumn("alive", (c("status") == "active").cast("int")), "alive", "y")


@query("chi_square_status", "A18 U19", "", "chi2 df n cramers_v", """WITH o AS (SELECT market, status, count(*)*1.0 AS o FROM entity GROUP BY 1,2),
 e AS (SELECT *, sum(o) OVER (PARTITION BY market)*sum(o) OVER (PARTITION BY status)/sum(o) OVER () AS e, sum(o) OVER () AS n FROM o)
SELECT sum(pow(o-e,2)/e) AS chi2, (count(DISTINCT market)-1)*(count(DISTINCT status)-1) AS df, max(n) AS n, sqrt(sum(pow(o-e,2)/e)/max(n)/(least(count(DISTINCT market),count(DISTINCT status))-1)) AS cramers_v FROM e""")
def _(spark, sf):
    return st.chi_square(d.entity(spark, sf), "market", "status")


@query("normality_by_market", "A19", "market", "n skew kurt jb", f"""WITH {TY}, c AS (SELECT market, y-avg(y) OVER (PARTITION BY market) AS e FROM t), m AS (SELECT market, count(*) AS n, avg(e*e) AS m2, avg(pow(e,3)) AS m3, avg(pow(e,4)) AS m4 FROM c GROUP BY 1)
SELECT market, n, m3/pow(m2,1.5) AS skew, m4/(m2*m2)-3 AS kurt, n/6.0*(pow(m3/pow(m2,1.5),2)+pow(m4/(m2*m2)-3,2)/4) AS jb FROM m""", digits=4)
def _(spark, sf):
    return st.normality(reg_panel(spark, sf), "y", ["market"])


@query("anderson_darling", "A19", "", "a2")
def _(spark, sf):
    return one(spark, {"a2": st.anderson(reg_panel(spark, sf), "y")})


@query("dickey_fuller", "A20", "company_id stationary", "n b adf", """WITH l AS (SELECT company_id, revenue, lag(revenue) OVER (PARTITION BY company_id ORDER BY year) AS x FROM panel),
 g AS (SELECT company_id, count(x) AS n, regr_slope(revenue-x, x) AS b, regr_sxx(revenue-x,x) AS sxx, regr_syy(revenue-x,x) AS syy, regr_sxy(revenue-x,x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY 1 HAVING count(x) > 3)
SELECT *, adf < -2.86 AS stationary FROM (SELECT *, b/sqrt(greatest(syy-b*sxy,0)/(n-2)/sxx) AS adf FROM g)""", digits=3)
def _(spark, sf):
    return st.dickey_fuller(d.panel(spark, sf), "revenue").where("n > 3")


@query("kpss_level", "A20", "company_id stationary", "n kpss", """WITH e AS (SELECT company_id, year, revenue-avg(revenue) OVER (PARTITION BY company_id) AS e FROM panel),
 s AS (SELECT *, sum(e) OVER (PARTITION BY company_id ORDER BY year) AS s FROM e), g AS (SELECT company_id, count(*) AS n, sum(s*s) AS ss, sum(e*e) AS ee FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT *, kpss < .463 AS stationary FROM (SELECT *, ss/(n*n)/nullif(ee/n,0) AS kpss FROM g)""", digits=4)
def _(spark, sf):
    return st.kpss(d.panel(spark, sf), "revenue").where("n > 1")


@query("adjusted_p_values", "A22", "company_id", "p bh bonferroni", """WITH l AS (SELECT company_id, count(*) AS n, exp(-abs(avg(net_profit))/10) AS p FROM panel GROUP BY 1), r AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p)+count(*) OVER (PARTITION BY p)-1 AS k FROM l)
SELECT company_id, p, least(1, min(p*m/k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS bh, least(1,p*m) AS bonferroni FROM r""")
def _(spark, sf):
    p = d.panel(spark, sf).groupBy("company_id").agg(F.exp(-F.abs(F.avg("net_profit")) / 10).alias("p"))
    return st.adjust_p(p)
