"""Alignment, imputation, scaling, spin-off and outlier queries (inventory C5-C32, O1-O11, IO10-IO11)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..functions.ranks import long
from ..operators import clean as k
from ..operators import outliers as o
from ..sources import derive as d
from .registry import query

c = F.col
K = "company_id year"
PW = "(PARTITION BY company_id ORDER BY year"
UPTO = f"{PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FROM = f"{PW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def lin(x, t="holed"):
    return f"""(SELECT *, coalesce({x}, v0+(v1-v0)*(year-p0)/nullif(p1-p0,0)) AS lin FROM (SELECT *,
   last_value({x} IGNORE NULLS) OVER {UPTO} AS v0, first_value({x} IGNORE NULLS) OVER {FROM} AS v1,
   last_value(CASE WHEN {x} IS NOT NULL THEN year END IGNORE NULLS) OVER {UPTO} AS p0,
   first_value(CASE WHEN {x} IS NOT NULL THEN year END IGNORE NULLS) OVER {FROM} AS p1 FROM {t}))"""


@query("linear_fill", "C6", K, "revenue", f"""
SELECT company_id, year, coalesce(l1, last_value(l1 IGNORE NULLS) OVER {PW} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS revenue
FROM (SELECT *, coalesce(revenue, CASE WHEN year-p0 <= 2 THEN lin END) AS l1 FROM {lin('revenue')})""")
def _(spark, sf):
    return k.fill_time(d.holed(spark, sf), ["revenue"], limit=2, ffill=1)


STRUCT = """(SELECT company_id, year, market, CASE WHEN ey IS NOT NULL AND year > ey THEN 0 WHEN year < start_year THEN 0
   WHEN revenue IS NOT NULL THEN revenue WHEN year = ey THEN .5*max(revenue) OVER (PARTITION BY company_id ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)
   WHEN year = start_year THEN .5*avg(revenue) OVER (PARTITION BY market, year) END AS revenue
  FROM (SELECT *, CASE WHEN status='extinct' THEN end_year END AS ey,
     CASE WHEN year = end_year OR year = start_year THEN CASE WHEN revenue < 100 THEN NULL ELSE revenue END ELSE revenue END AS r0 FROM holed))"""


def _extinct(h):
    return h.withColumn("extinct_year", F.when(c("status") == "extinct", c("end_year")))


@query("structural_fill", "C7", K, "revenue", f"SELECT company_id, year, revenue FROM {STRUCT}")
def _(spark, sf):
    return k.fill_structural(_extinct(d.holed(spark, sf)), ["revenue"])


@query("restructure_fill", "C8", K, "revenue", f"""SELECT company_id, year, CASE WHEN year=1998 THEN coalesce(lin, orig) ELSE orig END AS revenue
 FROM {lin('side', "(SELECT *, revenue AS orig, CASE WHEN year <> 1998 THEN revenue END AS side FROM holed)")}""")
def _(spark, sf):
    return k.fill_restructure(d.holed(spark, sf), ["revenue"], F.lit(1998))


@query("peer_fill", "C9 J12", K, "revenue", "SELECT company_id, year, coalesce(revenue, avg(revenue) OVER (PARTITION BY market, year)) AS revenue FROM holed")
def _(spark, sf):
    return k.fill_peers(d.holed(spark, sf), ["revenue"])


@query("statistic_fill", "C10", K, "revenue employees", """SELECT company_id, year,
  coalesce(revenue, (SELECT (avg(revenue)+quantile_cont(revenue,.5))/2 FROM holed)) AS revenue,
  coalesce(employees, (SELECT (avg(employees)+quantile_cont(employees,.5))/2 FROM holed)) AS employees FROM holed""")
def _(spark, sf):
    return k.fill_statistic(d.holed(spark, sf), ["revenue", "employees"], "mean_median")


@query("mode_fill", "C10", K, "employees", """SELECT company_id, year, coalesce(employees,
  (SELECT employees FROM holed WHERE employees IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, employees LIMIT 1)) AS employees FROM holed""")
def _(spark, sf):
    return k.fill_statistic(d.holed(spark, sf), ["employees"], "mode")


@query("model_fill", "C11", K, "revenue employees total_assets")
def _(spark, sf):
    h = d.holed(spark, sf).where("exists_flag")
    h = h.select("company_id", "year", "revenue", "employees", "total_assets", (c("year") - c("start_year")).cast("double").alias("age"))
    return k.fill_model(h, ["revenue", "employees", "total_assets"], ["age"], trees=50, depth=5)


@query("chained_fill", "C11", K, "revenue employees total_assets")
def _(spark, sf):
    h = d.holed(spark, sf).where("exists_flag").select("company_id", "year", "revenue", "employees", "total_assets", (c("year") - c("start_year")).cast("double").alias("age"))
    return k.fill_chained(h, ["revenue", "employees", "total_assets"], ["age"])[0]


@query("regression_fill", "C12", K, "ratio", """
WITH t AS (SELECT company_id, year, ln(total_assets) AS size, year-start_year AS age,
    CASE WHEN returned > 0 THEN operating_profit/revenue END AS ratio FROM mpanel),
 s AS (SELECT avg(size) AS ms, avg(age) AS ma, avg(ratio) AS mr, covar_pop(size,size) AS ss, covar_pop(age,age) AS aa, covar_pop(size,age) AS sa,
   covar_pop(size,ratio) AS sr, covar_pop(age,ratio) AS ar FROM t WHERE ratio IS NOT NULL),
 b AS (SELECT *, (sr*aa-ar*sa)/(ss*aa-sa*sa) AS b1, (ar*ss-sr*sa)/(ss*aa-sa*sa) AS b2 FROM s)
SELECT company_id, year, coalesce(ratio, mr+b1*(size-ms)+b2*(age-ma)) AS ratio FROM t, b""")
def _(spark, sf):
    p = d.mpanel(spark, sf).select(
        "company_id", "year", F.ln("total_assets").alias("size"), (c("year") - c("start_year")).cast("double").alias("age"),
        F.when(c("returned") > 0, sd("operating_profit", "revenue")).alias("ratio"))
    return k.fill_regression(p, "ratio", ["size", "age"])


@query("impute_comprehensive", "C13", K, "revenue", f"""
WITH s AS {STRUCT}, f AS (SELECT company_id, year, market, coalesce(l1, last_value(l1 IGNORE NULLS) OVER {PW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS r
  FROM (SELECT *, coalesce(revenue, CASE WHEN year-p0 <= 5 THEN lin END) AS l1 FROM {lin('revenue', 's')}))
SELECT company_id, year, coalesce(r, avg(r) OVER (PARTITION BY market, year)) AS revenue FROM f""")
def _(spark, sf):
    return k.impute(_extinct(d.holed(spark, sf)), ["revenue"], "comprehensive")


@query("drop_sparse_columns", "C14", "company_id year", "revenue",
       "SELECT company_id, year, revenue FROM holed")
def _(spark, sf):
    return k.drop_sparse(d.holed(spark, sf), ["revenue", "employees"], 0.99)


@query("labels_and_weights", "C15 C16 C17 C19", f"{K} age_class standard exit_phase", "status_weight", """
SELECT company_id, year, CASE WHEN year-start_year<2 THEN 'startup' WHEN year-start_year<4 THEN 'growth' WHEN year-start_year<6 THEN 'mature' ELSE 'established' END AS age_class,
  CASE WHEN year >= 1998 THEN 'IFRS' ELSE 'JGAAP' END AS standard,
  count(*) OVER ()*1.0/count(*) OVER (PARTITION BY status) AS status_weight,
  market IN ('BUILDING') AND year > max(year) OVER (PARTITION BY company_id)-3 AS exit_phase FROM mpanel""")
def _(spark, sf):
    p = k.exit_phase(k.accounting_tag(k.status_weight(d.mpanel(spark, sf)), 1998), ["BUILDING"])
    return p.withColumn("age_class", k.age_bin(c("year") - c("start_year"), (2, 4, 6))).withColumnRenamed(
        "accounting_standard", "standard")


@query("fix_jumps", "C18", K, "revenue", """SELECT company_id, year, CASE WHEN (g > 2 OR g < -.6) AND n IS NOT NULL THEN (p+n)/2 ELSE revenue END AS revenue
FROM (SELECT *, revenue/p-1 AS g FROM (SELECT *, lag(revenue) OVER w AS p, lead(revenue) OVER w AS n FROM panel WINDOW w AS (PARTITION BY company_id ORDER BY year)))""")
def _(spark, sf):
    return k.fix_jumps(d.panel(spark, sf), ["revenue"], 2.0, -0.6)


@query("clip_iqr", "C20", K, "revenue net_profit", """SELECT company_id, year, least(greatest(revenue, r1-1.5*(r3-r1)), r3+1.5*(r3-r1)) AS revenue,
  least(greatest(net_profit, n1-1.5*(n3-n1)), n3+1.5*(n3-n1)) AS net_profit FROM panel, (SELECT quantile_cont(revenue,.25) AS r1, quantile_cont(revenue,.75) AS r3,
  quantile_cont(net_profit,.25) AS n1, quantile_cont(net_profit,.75) AS n3 FROM panel)""")
def _(spark, sf):
    return k.clip_iqr(d.panel(spark, sf), ["revenue", "net_profit"])


@query("clip_z", "C20", K, "revenue", """SELECT company_id, year, least(greatest(revenue, m-2*s), m+2*s) AS revenue
FROM panel, (SELECT avg(revenue) AS m, stddev_samp(revenue) AS s FROM panel)""")
def _(spark, sf):
    return k.clip_z(d.panel(spark, sf), ["revenue"], 2.0)


@query("winsorize", "C21", K, "revenue net_profit", """SELECT company_id, year, least(greatest(revenue, r1), r3) AS revenue, least(greatest(net_profit, n1), n3) AS net_profit
FROM panel, (SELECT quantile_cont(revenue,.01) AS r1, quantile_cont(revenue,.99) AS r3, quantile_cont(net_profit,.01) AS n1, quantile_cont(net_profit,.99) AS n3 FROM panel)""")
def _(spark, sf):
    return k.winsorize(d.panel(spark, sf), ["revenue", "net_profit"])


@query("peer_zscore", "C22", K, "revenue_zscore", """SELECT company_id, year, (revenue-avg(revenue) OVER m)/stddev_samp(revenue) OVER m AS revenue_zscore
FROM mpanel WINDOW m AS (PARTITION BY market)""")
def _(spark, sf):
    return k.peer_zscore(d.mpanel(spark, sf), ["revenue"])


@query("robust_scale", "C23", K, "revenue_scaled net_profit_scaled", """SELECT company_id, year, (revenue-r2)/(r3-r1) AS revenue_scaled, (net_profit-n2)/(n3-n1) AS net_profit_scaled
FROM mpanel JOIN (SELECT market, quantile_cont(revenue,.25) AS r1, quantile_cont(revenue,.5) AS r2, quantile_cont(revenue,.75) AS r3,
  quantile_cont(net_profit,.25) AS n1, quantile_cont(net_profit,.5) AS n2, quantile_cont(net_profit,.75) AS n3 FROM mpanel GROUP BY 1) USING (market)""")
def _(spark, sf):
    return k.robust_scale(d.mpanel(spark, sf), ["revenue", "net_profit"])


NORM = """SELECT *, 'x' AS dummy FROM (SELECT *, CASE WHEN status='extinct' THEN 'extinction' WHEN parent_id IS NOT NULL AND 2001-start_year<=5 THEN 'revival'
   WHEN 2001-start_year<=5 THEN 'startup' ELSE 'growth' END AS life_stage,
   CASE WHEN start_year-1995<=10 THEN 'pioneer' ELSE 'early_adopter' END AS timing FROM mpanel)"""


@query("lifecycle_normalize", "C24 C25 C26", f"{K} life_stage timing", "revenue_norm", f"""
SELECT company_id, year, life_stage, timing, CASE WHEN life_stage='extinction' THEN revenue*(1-.9*pos) WHEN life_stage='revival' THEN revenue*(.3+.9*pos)
  WHEN n > 1 AND s > 0 THEN (revenue-m)/s/(CASE life_stage WHEN 'startup' THEN 2.0 ELSE 1.5 END*.8*1.5) ELSE revenue END AS revenue_norm
FROM (SELECT *, CASE WHEN n > 1 THEN (i-1)*1.0/(n-1) ELSE 0 END AS pos FROM (SELECT *, count(*) OVER e AS n, row_number() OVER {PW}) AS i,
  stddev_pop(revenue) OVER e AS s, avg(revenue) OVER e AS m FROM ({NORM}) WINDOW e AS (PARTITION BY company_id)))""")
def _(spark, sf):
    p = d.mpanel(spark, sf)
    spin_age = F.when(c("parent_id").isNotNull(), F.lit(2001) - c("start_year"))
    p = p.withColumn("life_stage", k.year_stage(F.lit(2001) - c("start_year"), c("status") == "extinct", spin_age))
    return k.lifecycle_normalize(p.withColumn("timing", k.entry_timing(c("start_year"), F.lit(1995))), ["revenue"])


@query("stage_benchmarks", "C27 G1", "stage metric n", "mean std lo hi q25 median q75", "\nUNION ALL ".join(
    f"""SELECT stage, '{x}' AS metric, count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS lo, max({x}) AS hi,
 quantile_cont({x},.25) AS q25, quantile_cont({x},.5) AS median, quantile_cont({x},.75) AS q75 FROM stages GROUP BY 1""" for x in ("revenue", "net_profit")))
def _(spark, sf):
    return k.stage_benchmarks(d.stages(spark, sf), ["revenue", "net_profit"])


def spin_events(spark, sf):
    e = d.entity(spark, sf).where("parent_id is not null")
    return e.select("parent_id", c("company_id").alias("child_id"), c("start_year").alias("event_year"),
                    F.lit(d.OWNERSHIP).alias("ownership"))


SPIN = "(SELECT parent_id, company_id AS child_id, start_year AS event_year, 0.4 AS ownership FROM entity WHERE parent_id IS NOT NULL)"


@query("spinoff_adjust", "C28", K, "revenue", f"""SELECT p.company_id, year, CASE WHEN year < event_year THEN revenue*.6 ELSE revenue END AS revenue
FROM panel p JOIN {SPIN} s ON p.company_id = s.parent_id""")
def _(spark, sf):
    return k.spinoff_adjust(d.panel(spark, sf), spin_events(spark, sf), ["revenue"])


CONS = f"""SELECT parent_id, child_id, p.year, p.revenue, p.total_assets, event_year, 'pre' AS part FROM panel p JOIN {SPIN} s ON p.company_id=s.parent_id WHERE p.year < event_year
UNION ALL SELECT parent_id, child_id, p.year, p.revenue+q.revenue*.4, p.total_assets+q.total_assets*.4, event_year, 'post' FROM panel p JOIN {SPIN} s ON p.company_id=s.parent_id
JOIN panel q ON q.company_id=s.child_id AND q.year=p.year WHERE p.year >= event_year"""


@query("spinoff_consolidate", "C29 J10 S1 S3", "parent_id child_id year part", "revenue", CONS)
def _(spark, sf):
    return k.spinoff_consolidate(d.panel(spark, sf), spin_events(spark, sf), ["revenue"])


@query("spinoff_continuity", "C30", "parent_id child_id continuous", "change_revenue change_total_assets", f"""
WITH t AS ({CONS}), r AS (SELECT *, year >= event_year AS a, row_number() OVER (PARTITION BY parent_id, child_id, year >= event_year
   ORDER BY CASE WHEN year >= event_year THEN year ELSE -year END) AS n FROM t),
 g AS (SELECT parent_id, child_id, avg(CASE WHEN NOT a THEN revenue END) AS r0, avg(CASE WHEN a THEN revenue END) AS r1,
   avg(CASE WHEN NOT a THEN total_assets END) AS t0, avg(CASE WHEN a THEN total_assets END) AS t1 FROM r WHERE n <= 4 GROUP BY 1,2)
SELECT *, r0 IS NOT NULL AND r1 IS NOT NULL AND coalesce(change_revenue,0)<=.5 AND coalesce(change_total_assets,0)<=.5 AS continuous
FROM (SELECT *, abs(r1-r0)/r0 AS change_revenue, abs(t1-t0)/t0 AS change_total_assets FROM g)""")
def _(spark, sf):
    ev = spin_events(spark, sf)
    j = k.spinoff_consolidate(d.panel(spark, sf), ev, ["revenue", "total_assets"])
    j = j.join(ev.select("parent_id", "child_id", "event_year"), ["parent_id", "child_id"])
    return k.continuity_across(j, ["revenue", "total_assets"], ["parent_id", "child_id"])


@query("subsidiary_estimate", "C31", "subsidiary_id year", "revenue", f"""SELECT child_id AS subsidiary_id, year, revenue*coalesce(CASE WHEN event_year < 1996 THEN .25 END,.1) AS revenue
FROM panel p JOIN {SPIN} s ON p.company_id=s.parent_id""")
def _(spark, sf):
    r = spin_events(spark, sf).select(c("parent_id").alias("company_id"), c("child_id").alias("subsidiary_id"),
                                      F.when(c("event_year") < 1996, 0.25).alias("ratio"))
    return k.subsidiary_estimate(d.panel(spark, sf), r, ["revenue"])


@query("sector_benchmark", "C32", f"{K} survives", "revenue_to_sector revenue_ma3", f"""SELECT company_id, year, status='active' AS survives,
 revenue/avg(revenue) OVER (PARTITION BY market, year) AS revenue_to_sector, avg(revenue) OVER {PW} ROWS 2 PRECEDING) AS revenue_ma3 FROM mpanel""")
def _(spark, sf):
    return k.sector_benchmark(d.mpanel(spark, sf), ["revenue"])


@query("first_available_source", "IO10", "market year source", "size", """WITH s AS (SELECT market, year, sum(sales) AS size FROM market_share GROUP BY 1,2)
SELECT market, year, CASE WHEN size > 1500 THEN 'industry' WHEN year > 1998 THEN 'ministry' ELSE 'estimate' END AS source,
  CASE WHEN size > 1500 THEN size WHEN year > 1998 THEN size*1.1 ELSE size*.9 END AS size FROM s""")
def _(spark, sf):
    s = d.market_share(spark, sf).groupBy("market", "year").agg(F.sum("sales").alias("size"))
    parts = [s.where("size > 1500").withColumn("source", F.lit("industry")),
             s.where("year > 1998").select("market", "year", (c("size") * 1.1).alias("size"), F.lit("ministry").alias("source")),
             s.select("market", "year", (c("size") * 0.9).alias("size"), F.lit("estimate").alias("source"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return k.first_available(u, ["market", "year"], "source", "size", ["industry", "ministry", "estimate"])


@query("best_reliability", "IO11", K, "revenue inventories", """SELECT company_id, year, CASE WHEN returned > 0 THEN revenue*1.01 ELSE revenue END AS revenue,
  CASE WHEN inventories > 0 THEN inventories END AS inventories FROM panel""")
def _(spark, sf):
    p = d.panel(spark, sf).select("company_id", "year", "revenue", "inventories", "returned")
    a = p.select("company_id", "year", "revenue", F.when(c("inventories") > 0, c("inventories")).alias("inventories"),
                 F.lit(0.5).alias("reliability"))
    b = p.where("returned > 0").select("company_id", "year", (c("revenue") * 1.01).alias("revenue"),
                                       F.lit(None).cast("double").alias("inventories"), F.lit(0.9).alias("reliability"))
    return k.best_reliability(a.unionByName(b), ["company_id", "year"], ["revenue", "inventories"])


# ---- outliers -----------------------------------------------------------------------

OC = "company_id year metric method action"
OV = "value severity confidence"
LONG = "(SELECT company_id, year, market, stage, 'revenue' AS metric, revenue AS value FROM stages UNION ALL SELECT company_id, year, market, stage, 'net_profit', net_profit FROM stages)"


def values(spark, sf):
    return long(d.stages(spark, sf), ["company_id", "year", "market", "stage"], ["revenue", "net_profit"])


IQR = f"""SELECT company_id, year, metric, value, 'iqr' AS method, 'investigate' AS action, least(1, greatest(q1-1.5*(q3-q1)-value, value-q3-1.5*(q3-q1))/nullif(q3-q1,0)/1.5) AS severity,
  0.8 AS confidence FROM (SELECT *, quantile_cont(value,.25) OVER m AS q1, quantile_cont(value,.75) OVER m AS q3 FROM {LONG} WINDOW m AS (PARTITION BY metric, market))
  WHERE value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1)"""
ZS = f"""SELECT company_id, year, metric, value, 'zscore' AS method, CASE WHEN z < 4.5 THEN 'flag' ELSE 'investigate' END AS action, least(1, z/3/2) AS severity, 0.85 AS confidence
  FROM (SELECT *, abs(value-avg(value) OVER m)/stddev_pop(value) OVER m AS z FROM {LONG} WINDOW m AS (PARTITION BY metric, market)) WHERE z > 3"""
MZ = f"""SELECT company_id, year, metric, value, 'modified_z' AS method, CASE WHEN z > 4.2 THEN 'investigate' ELSE 'flag' END AS action, least(1, z/3.5/2) AS severity, 0.9 AS confidence
  FROM (SELECT *, .6745*dv/quantile_cont(dv,.5) OVER (PARTITION BY metric, market) AS z FROM (SELECT *, abs(value-quantile_cont(value,.5) OVER (PARTITION BY metric, market)) AS dv FROM {LONG})) WHERE z > 3.5"""


@query("outliers_iqr", "O1 O11", OC, OV, IQR)
def _(spark, sf):
    return o.iqr(values(spark, sf), ["metric", "market"])


@query("outliers_zscore", "O2 O11", OC, OV, ZS)
def _(spark, sf):
    return o.zscore(values(spark, sf), ["metric", "market"])


@query("outliers_modified_z", "O3", OC, OV, MZ)
def _(spark, sf):
    return o.modified_zscore(values(spark, sf), ["metric", "market"])


@query("outliers_rolling", "O4", OC, OV, f"""SELECT company_id, year, metric, value, 'rolling' AS method, 'investigate' AS action, least(1, z/1.1/2) AS severity, 0.8 AS confidence
FROM (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN abs(value-avg(value) OVER w)/nullif(stddev_samp(value) OVER w,0) END AS z FROM {LONG}
 WINDOW w AS (PARTITION BY company_id, metric ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE z > 1.1""")
def _(spark, sf):
    return o.rolling(values(spark, sf), 3, 1.1)


@query("outliers_change_rate", "O5", OC, OV, f"""WITH r AS (SELECT *, (value-p)/(abs(p)+1e-6) AS r FROM (SELECT *, lag(value) OVER (PARTITION BY company_id, metric ORDER BY year) AS p FROM {LONG})),
 s AS (SELECT *, stddev_pop(r) OVER (PARTITION BY company_id, metric) AS s, count(value) OVER (PARTITION BY company_id, metric) AS n FROM r),
 v AS (SELECT *, least(1, abs(r)/(1.7*s)/(CASE stage WHEN 'startup' THEN 3.0 WHEN 'decline' THEN 2.0 ELSE 1.0 END)) AS severity FROM s WHERE n >= 5 AND s > 0 AND abs(r) > 1.7*s)
SELECT *, 'change_rate' AS method, 0.7 AS confidence, CASE WHEN severity > .8 THEN 'remove' WHEN severity > .5 THEN 'investigate' ELSE 'flag' END AS action FROM v""")
def _(spark, sf):
    return o.change_rate(values(spark, sf), 1.7)


def _exit_events(spark, sf):
    return d.entity(spark, sf).where("status = 'extinct'").select("company_id", F.lit("divestiture").alias("event_type"), c("end_year").alias("year"))


@query("outliers_event_context", "O6 J6", OC, OV, """WITH l AS (SELECT company_id, year, metric, value FROM (SELECT company_id, year, 'revenue' AS metric, revenue AS value FROM stages
   UNION ALL SELECT company_id, year, 'net_profit', net_profit FROM stages)),
 g AS (SELECT l.company_id, metric, end_year AS year, count(*) AS n, count(CASE WHEN year<end_year THEN 1 END) AS np, avg(CASE WHEN year<end_year THEN value END) AS b,
   stddev_samp(CASE WHEN year<end_year THEN value END) AS s, max(CASE WHEN year=end_year THEN value END) AS value FROM l JOIN entity e USING (company_id)
   WHERE e.status='extinct' AND year BETWEEN end_year-3 AND end_year+3 GROUP BY 1,2,3),
 x AS (SELECT *, abs(value-b*(1+CASE metric WHEN 'revenue' THEN -.3 ELSE 0 END))/(s+1e-6) AS dev FROM g WHERE n>=3 AND np>=2 AND s<>0)
SELECT company_id, year, metric, value, 'event_context' AS method, least(1,dev/5) AS severity, .85 AS confidence, CASE WHEN least(1,dev/5)>.6 THEN 'investigate' ELSE 'flag' END AS action FROM x WHERE dev > 2""")
def _(spark, sf):
    return o.event_context(values(spark, sf), _exit_events(spark, sf))


ACC = f"""SELECT company_id, year, metric, value, 'accounting_change' AS method, least(1, r) AS severity, .9 AS confidence, 'transform' AS action FROM (
 SELECT *, abs((value-b)/nullif(b,0)) AS r FROM (SELECT *, max(value) OVER (PARTITION BY company_id, metric ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b FROM {LONG})
 WHERE year IN (1998) AND abs(b) > 1e-6) WHERE r > .5"""


@query("outliers_accounting_change", "O7", OC, OV, ACC)
def _(spark, sf):
    return o.accounting_change(values(spark, sf), [1998])


@query("outliers_mahalanobis", "O8", f"{K} outlier", "distance2", """WITH s AS (SELECT avg(revenue) AS mr, avg(net_profit) AS mn, covar_samp(revenue,revenue) AS rr, covar_samp(net_profit,net_profit) AS nn, covar_samp(revenue,net_profit) AS rn FROM panel)
SELECT *, distance2 > 9.21 AS outlier FROM (SELECT company_id, year, ((revenue-mr)*(revenue-mr)*nn-2*(revenue-mr)*(net_profit-mn)*rn+(net_profit-mn)*(net_profit-mn)*rr)/(rr*nn-rn*rn) AS distance2 FROM panel, s)""")
def _(spark, sf):
    return o.mahalanobis(d.panel(spark, sf), ["revenue", "net_profit"], 9.21)


ALL = f"SELECT company_id, year, metric, value, method, action, severity, confidence FROM ({IQR} UNION ALL BY NAME {ZS} UNION ALL BY NAME {ACC})"


def findings(spark, sf):
    v = values(spark, sf)
    return o.iqr(v, ["metric", "market"]).unionByName(o.zscore(v, ["metric", "market"])).unionByName(o.accounting_change(v, [1998]))


CONSOL = f"""SELECT company_id, year, metric, max(severity) AS severity, max(confidence) AS confidence, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
  arg_max(action, (severity, confidence, method)) AS action, max(value) AS value FROM ({ALL}) GROUP BY 1,2,3"""


@query("outliers_consolidated", "O9", "company_id year metric methods action", "value severity confidence", CONSOL)
def _(spark, sf):
    return o.consolidate(findings(spark, sf))


@query("outliers_treated", "O10", "company_id year metric treatment", "value", f"""WITH f AS ({CONSOL}),
 v AS (SELECT *, lag(value) OVER (PARTITION BY company_id, metric ORDER BY year) AS p FROM {LONG})
SELECT v.company_id, v.year, v.metric, coalesce(f.action,'keep') AS treatment, CASE WHEN f.action='transform' THEN (p+v.value)/2 ELSE v.value END AS value
FROM v LEFT JOIN f ON f.company_id=v.company_id AND f.year=v.year AND f.metric=v.metric AND f.severity > .5 WHERE coalesce(f.action,'') <> 'remove'""")
def _(spark, sf):
    return o.treat(values(spark, sf), o.consolidate(findings(spark, sf)), "aggressive")
