"""Clustering, forecasts, evaluation, graph and event queries (inventory P1-P11, F1-F6, X1-X8, N1-N3, ST)."""

from pyspark.sql import functions as F

from ..functions.windows import W, latest_rows
from ..operators import cluster as k
from ..operators import evaluation as x
from ..operators import graph as g
from ..sources import derive as d
from ..streaming import ledger as s
from .registry import query

c = F.col
PW = "PARTITION BY company_id ORDER BY year"
CF = ["margin", "rd_ratio", "capex_ratio"]


LT = "lt AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC)=1)"


def latest(spark, sf):
    """Each company's last year, with the columns that clusters are made of (others would be shuffled along)."""
    return latest_rows(d.staged(spark, sf, share=False).select("company_id", "year", "market", *CF))


@query("scaled_features", "P1", "company_id year", "m0 m1 m2", f"WITH {LT}, s AS (SELECT avg(margin) AS a, stddev_samp(margin) AS b, avg(rd_ratio) AS e, stddev_samp(rd_ratio) AS f, avg(capex_ratio) AS h, stddev_samp(capex_ratio) AS i FROM lt) SELECT company_id, year, (margin-a)/b AS m0, 2*(rd_ratio-e)/f AS m1, (capex_ratio-h)/i AS m2 FROM lt, s")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    p = k.features(latest(spark, sf), CF, emphasis={"rd_ratio": 2.0}).withColumn("a", vector_to_array("features"))
    return p.select("company_id", "year", *[c("a")[i].alias(f"m{i}") for i in range(3)])


@query("kmeans_silhouette", "P2 L23", "k", "silhouette")
def _(spark, sf):
    return k.choose_k(latest(spark, sf), CF)[1]


@query("mixture_clusters", "P2", "company_id cluster", "")
def _(spark, sf):
    return k.fit_clusters(k.features(latest(spark, sf), CF, "robust"), "mixture", 3)


@query("cluster_hierarchy", "P3 P5 G15", "cluster n dominant", "margin rd_ratio capex_ratio")
def _(spark, sf):
    return k.cluster_stats(k.fit_clusters(k.features(latest(spark, sf), CF), "hierarchy", 4), CF)


@query("lifecycle_row_features", "P4", "company_id year", "growth_mean growth_std growth_slope growth_stability", "WITH x AS (SELECT company_id, year, (margin+roe+rd_ratio)/3 AS m, margin, roe, rd_ratio FROM lc WHERE roe IS NOT NULL) SELECT company_id, year, m AS growth_mean, sqrt((pow(margin-m,2)+pow(roe-m,2)+pow(rd_ratio-m,2))/3) AS growth_std, (rd_ratio-margin)/2 AS growth_slope, 1/(1+sqrt((pow(margin-m,2)+pow(roe-m,2)+pow(rd_ratio-m,2))/3)) AS growth_stability FROM x")
def _(spark, sf):
    return k.lifecycle_features(d.staged(spark, sf).where("roe is not null"), ["margin", "roe", "rd_ratio"])


@query("survival_row_features", "P4", "company_id trailing_losses", "health risk decline", f"""WITH x AS (SELECT *, row_number() OVER ({PW}) AS i, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b FROM panel),
 g AS (SELECT company_id, avg(least(1,greatest(0,shareholders_equity/total_assets)))*.3+avg(least(1,greatest(0,operating_profit/revenue*5)))*.3+avg(least(1,greatest(0,current_assets/nullif(current_liabilities,0)/2)))*.2+avg(least(1,greatest(0,operating_cash_flow/revenue*5)))*.2 AS health,
  cast(coalesce(min(CASE WHEN net_profit>=0 THEN b END)-1,count(*)) AS bigint) AS trailing_losses, avg(CASE WHEN i<=3 THEN revenue END) AS a, avg(CASE WHEN b<=3 THEN revenue END) AS z FROM x GROUP BY 1) SELECT *, 1-health AS risk, (a-z)/a AS decline FROM g""")
def _(spark, sf):
    return k.survival_features(d.panel(spark, sf))


@query("cluster_quality", "P6", "k", "calinski_harabasz davies_bouldin", f"""WITH {LT}, x AS (SELECT market, margin AS x, rd_ratio AS y FROM lt), m AS (SELECT market, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x)+var_pop(y) AS v FROM x GROUP BY 1),
 s AS (SELECT market, avg(sqrt(pow(x-mx,2)+pow(y-my,2))) AS s FROM x JOIN m USING (market) GROUP BY 1), t AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS tn FROM x),
 b AS (SELECT sum(n*(pow(mx-gx,2)+pow(my-gy,2))) AS b, sum(n*v) AS w, count(*) AS k, max(tn) AS tn FROM m, t), db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT a.market, max((p.s+q.s)/sqrt(pow(a.mx-z.mx,2)+pow(a.my-z.my,2))) AS r FROM m a JOIN m z ON a.market<>z.market JOIN s p ON p.market=a.market JOIN s q ON q.market=z.market GROUP BY 1))
SELECT k, b/(k-1)/(w/(tn-k)) AS calinski_harabasz, davies_bouldin FROM b, db""", digits=4)
def _(spark, sf):
    return k.quality(latest(spark, sf), ["margin", "rd_ratio"], "market")


@query("principal_components", "P7", "company_id", "pc1 pc2")
def _(spark, sf):
    return k.pca(latest(spark, sf).select("company_id", *CF), CF, 2)[0]


@query("embedding_clusters", "P2 P7", "vec_id cluster", "")
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = d.table(spark, sf, "embeddings").select("vec_id", array_to_vector(c("embedding").cast("array<double>")).alias("features"))
    return k.fit_clusters(e, "kmeans", 4)


@query("trajectory_clusters", "P8 E12", "company_id cluster", "")
def _(spark, sf):
    from ..operators.timeseries import resample

    r = resample(d.panel(spark, sf), "revenue", 4, least=1)
    w = r.groupBy("company_id").agg(*[F.max(F.when(c("j") == j, c("value"))).alias(f"v{j}") for j in range(4)])
    return k.fit_clusters(k.features(w, [f"v{j}" for j in range(4)]), "kmeans", 4)


@query("ensemble_regression", "P9 P11", "company_id year", "lin rf gbt voting adaptive stacked")
def _(spark, sf):
    p = d.staged(spark, sf, share=False).select("company_id", "year", *CF).withColumn("prev", F.lag("margin").over(W()))
    return k.ensemble(p, "margin", ["prev", "rd_ratio", "capex_ratio"], "year", 1999)


@query("survival_classifier", "P10 U26", "company_id", "score")
def _(spark, sf):
    from ..operators.survival import propensity
    from .survival import selected

    return propensity(selected(spark, sf).withColumn("y", c("event").cast("double")), "y", ["balance_k", "margin", "returns"], "boosting")


@query("linear_forecast", "F1", "company_id step year", "forecast lower upper", f"""WITH x AS (SELECT company_id, year, revenue AS v, row_number() OVER ({PW})-1 AS i FROM panel), g AS (SELECT company_id, count(*) AS n, regr_slope(v,i) AS s, regr_intercept(v,i) AS c0, sqrt(greatest(regr_syy(v,i)-regr_slope(v,i)*regr_sxy(v,i),0)/greatest(count(*)-2,1)) AS se, max(year) AS last FROM x GROUP BY 1 HAVING count(*)>=3)
SELECT company_id, cast(step AS int) AS step, cast(last+step AS int) AS year, c0+s*(n-1+step) AS forecast, c0+s*(n-1+step)-1.959963984540054*se*sqrt(step) AS lower, c0+s*(n-1+step)+1.959963984540054*se*sqrt(step) AS upper FROM g, (SELECT unnest([1,2,3]) AS step)""", digits=5)
def _(spark, sf):
    return k.linear_forecast(d.panel(spark, sf), "revenue", 3)


@query("autoregressive_forecast", "F2", "company_id order step year", "forecast")
def _(spark, sf):
    return k.ar_forecast(d.panel(spark, sf), "revenue", 3)


@query("levinson_forecast", "F2", "company_id ar_order step year", "forecast", """WITH z AS (SELECT company_id, year, revenue AS v, revenue-lag(revenue) OVER (PARTITION BY company_id ORDER BY year) AS x FROM panel),
 e AS (SELECT *, x-avg(x) OVER (PARTITION BY company_id) AS e FROM z WHERE x IS NOT NULL), l AS (SELECT *, lag(e,1) OVER (PARTITION BY company_id ORDER BY year) AS e1, lag(e,2) OVER (PARTITION BY company_id ORDER BY year) AS e2 FROM e),
 r AS (SELECT company_id, count(*)*1.0 AS n, avg(x) AS mu, arg_max(v,year) AS last, max(year) AS y, arg_max(e,year) AS h1, arg_max(e1,year) AS h2, sum(e*e)/count(*) AS r0, coalesce(sum(e*e1),0)/count(*) AS r1, coalesce(sum(e*e2),0)/count(*) AS r2 FROM l GROUP BY 1 HAVING count(*)>=2),
 a AS (SELECT *, coalesce(r1/nullif(r0,0),0) AS k1 FROM r), b AS (SELECT *, r0*(1-k1*k1) AS s1 FROM a), k AS (SELECT *, coalesce((r2-k1*r1)/nullif(s1,0),0) AS k2 FROM b), s AS (SELECT *, s1*(1-k2*k2) AS s2 FROM k),
 i AS (SELECT *, CASE WHEN n>2 THEN n*ln(greatest(r0,1e-12))+2*n/(n-2) END AS c0, CASE WHEN n>3 THEN n*ln(greatest(s1,1e-12))+4*n/(n-3) END AS c1, CASE WHEN n>4 THEN n*ln(greatest(s2,1e-12))+6*n/(n-4) END AS c2 FROM s),
 o AS (SELECT *, CASE WHEN c2<c0 AND c2<c1 THEN 2 WHEN c1<c0 THEN 1 ELSE 0 END AS o FROM i), f AS (SELECT *, CASE o WHEN 2 THEN (k1-k2*k1)*h1+k2*h2 WHEN 1 THEN k1*h1 ELSE 0 END AS g1 FROM o),
 h AS (SELECT *, CASE o WHEN 2 THEN (k1-k2*k1)*g1+k2*h1 WHEN 1 THEN k1*g1 ELSE 0 END AS g2 FROM f)
SELECT company_id, cast(o AS int) AS ar_order, cast(1 AS int) AS step, y+1 AS year, last+mu+g1 AS forecast FROM h UNION ALL SELECT company_id, cast(o AS int), 2, y+2, last+2*mu+g1+g2 FROM h""", digits=4)
def _(spark, sf):
    return k.autoregression(d.panel(spark, sf), "revenue", 2, most=2).withColumnRenamed("order", "ar_order")


@query("forest_forecast", "F3", "company_id step year", "forecast lower upper")
def _(spark, sf):
    return k.forest_forecast(d.panel(spark, sf), "revenue", 2)


@query("market_outlook", "F4", "market", "slope risk", f"""WITH x AS (SELECT company_id, year, revenue AS v, row_number() OVER ({PW})-1 AS i FROM panel), g AS (SELECT company_id, count(*) AS n, regr_slope(v,i) AS s, regr_intercept(v,i) AS c0, arg_max(v,year) AS lv FROM x GROUP BY 1 HAVING count(*)>=3),
 f AS (SELECT market, step, avg(c0+s*(n-1+step)) AS f, avg(lv) AS b FROM g JOIN entity USING (company_id), (SELECT unnest([1,2,3]) AS step) GROUP BY 1,2)
SELECT market, regr_slope(f,step) AS slope, .7*greatest((max(b)-arg_max(f,step))/max(b),0)+.3*stddev_pop(f)/abs(avg(f)) AS risk FROM f GROUP BY 1""", digits=5)
def _(spark, sf):
    p = d.mpanel(spark, sf)
    base = p.groupBy("company_id", "market").agg(F.max_by("revenue", "year").alias("last_value"))
    return k.market_outlook(k.linear_forecast(p, "revenue", 3), base)


@query("combined_forecast", "F5", "company_id step models", "forecast")
def _(spark, sf):
    p = d.panel(spark, sf)
    return k.average_forecasts([k.linear_forecast(p, "revenue", 2), k.ar_forecast(p, "revenue", 2)])


@query("scenario_simulation", "F6", "market scenario", "mean p05 p50 p95 value_at_risk shortfall extinction")
def _(spark, sf):
    m = d.mpanel(spark, sf).groupBy("market", "year").agg(F.sum("revenue").alias("r"))
    last = d.table(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0]
    if last is not None and last.month < 12:  # a year cut off by the data's end has no yearly growth
        m = m.where(c("year") < last.year)
    from pyspark.sql import Window

    gr = m.withColumn("g", c("r") / F.lag("r").over(Window.partitionBy("market").orderBy("year")) - 1)  # market-years
    u = gr.groupBy("market").agg(F.avg("g").alias("mu"), F.stddev_samp("g").alias("sigma"))
    return k.scenario_summary(k.simulate(u, "market", 500, 5), "market", 5)


# ---- evaluation ------------------------------------------------------------------------

NAIVE = f"(SELECT company_id, year, market, margin AS y, lag(margin) OVER ({PW}) AS p, avg(margin) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM lc)"


def naive(spark, sf):
    from pyspark.sql import Window

    w = W()
    return d.staged(spark, sf).select("company_id", "year", "market", c("margin").alias("y"), F.lag("margin").over(w).alias("p"), F.avg("margin").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("q"))


RM = "avg(pow(y-{p},2)) AS mse, sqrt(avg(pow(y-{p},2))) AS rmse, avg(abs(y-{p})) AS mae, 1-avg(pow(y-{p},2))/var_pop(y) AS r2, avg(abs((y-{p})/nullif(y,0))) AS mape, corr(y,{p}) AS pearson"


@query("regression_metrics", "X1", "n", "mse rmse mae r2 mape pearson residual_mean residual_std", f"SELECT count(*) AS n, {RM.format(p='p')}, avg(y-p) AS residual_mean, stddev_samp(y-p) AS residual_std FROM {NAIVE} WHERE p IS NOT NULL", digits=4)
def _(spark, sf):
    return x.regression_metrics(naive(spark, sf), "y", "p")


@query("direction_accuracy", "X2", "n", "direction within_tol extreme", f"""WITH z AS (SELECT *, y-lag(y) OVER ({PW}) AS a, q-lag(y) OVER ({PW}) AS b, abs((y-q)/nullif(y,0)) AS r FROM {NAIVE})
SELECT count(a) AS n, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN sign(a)=sign(b) THEN 1.0 ELSE 0 END END) AS direction, avg(CASE WHEN r<=.1 THEN 1.0 ELSE 0 END) AS within_tol, avg(CASE WHEN r>.5 THEN 1.0 ELSE 0 END) AS extreme FROM z""")
def _(spark, sf):
    return x.direction_accuracy(naive(spark, sf), "y", "q")


PR = "(SELECT company_id, event AS y, 1/(1+exp(balance/4000)) AS p FROM surv)"


def probs(spark, sf):
    return d.survival(spark, sf).select("company_id", c("event").alias("y"), (1 / (1 + F.exp(c("balance") / 4000))).alias("p"))


@query("classification_metrics", "X3", "", "precision recall f1 brier auc", f"""WITH r AS (SELECT *, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0 AS rk FROM {PR}), g AS (SELECT sum(CASE WHEN y=1 AND p>=.5 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN y=0 AND p>=.5 THEN 1.0 ELSE 0 END) AS fp, sum(y)*1.0 AS m, count(*)-sum(y) AS n, avg(pow(p-y,2)) AS brier, sum(CASE WHEN y=1 THEN rk END) AS rs FROM r)
SELECT tp/(tp+fp) AS precision, tp/m AS recall, 2*(tp/(tp+fp))*(tp/m)/(tp/(tp+fp)+tp/m) AS f1, brier, (rs-m*(m+1)/2)/(m*n) AS auc FROM g""")
def _(spark, sf):
    return x.classification_metrics(probs(spark, sf), "y", "p")


@query("calibration_error", "X3", "bins", "ece", f"WITH b AS (SELECT least(floor(p*10),9) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM {PR} GROUP BY 1) SELECT count(*) AS bins, sum(n*abs(p-y))/sum(n) AS ece FROM b")
def _(spark, sf):
    return x.calibration_error(probs(spark, sf), "y", "p")


@query("precision_at_k", "X3", "k", "precision_at_k", f"SELECT count(*) AS k, avg(y) AS precision_at_k FROM (SELECT * FROM {PR} ORDER BY p DESC, company_id LIMIT 50)")
def _(spark, sf):
    return x.top_precision(probs(spark, sf), "y", "p", 50)


@query("interval_coverage", "X4", "n", "coverage bias width", f"SELECT count(*) AS n, avg(CASE WHEN y BETWEEN q-10 AND q+10 THEN 1.0 ELSE 0 END) AS coverage, avg(q-y) AS bias, 20.0 AS width FROM {NAIVE} WHERE q IS NOT NULL")
def _(spark, sf):
    n = naive(spark, sf).where("q is not null").select("y", "q", (c("q") - 10).alias("lo"), (c("q") + 10).alias("hi"))
    return x.coverage(n, "y", "q", "lo", "hi")


@query("model_comparison", "X5", "market model n", "rmse r2 pearson", " UNION ALL ".join(f"SELECT market, '{m}' AS model, count(*) AS n, {RM.format(p=m)} FROM {NAIVE} WHERE {m} IS NOT NULL GROUP BY 1" for m in ("p", "q")), digits=5)
def _(spark, sf):
    return x.compare_models(naive(spark, sf), "y", ["p", "q"], ["market"])


@query("model_stability", "X5 X8", "model groups", "stability")
def _(spark, sf):
    return x.stability(x.compare_models(naive(spark, sf), "y", ["p", "q"], ["market"]))


@query("time_series_folds", "X6", "fold part n", "", "SELECT cast(f AS int) AS fold, CASE WHEN year<f THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM panel, (SELECT unnest(range(1997,2002)) AS f) WHERE year<=f GROUP BY 1,2")
def _(spark, sf):
    return x.time_folds(d.panel(spark, sf).select("company_id", "year"), "year", 1997, 2001).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_fold_sizes", "X6", "market folds spread_ok", "", "SELECT market, least(count(*),5) AS folds, true AS spread_ok FROM entity GROUP BY 1")
def _(spark, sf):
    f = x.stratified_fold(d.entity(spark, sf), "company_id", "market", 5).groupBy("market", "fold").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy("market").agg(F.count(F.lit(1)).alias("folds"), (F.max("n") - F.min("n") <= 1).alias("spread_ok"))


@query("bias_checks", "X7", "rule biased", "value", """WITH r AS (SELECT 'group_concentration' AS rule, max(n)*1.0/sum(n) AS value FROM (SELECT nation, count(*) AS n FROM entity GROUP BY 1) UNION ALL SELECT 'recency', avg(CASE WHEN year>=2000 THEN 1.0 ELSE 0 END) FROM panel
 UNION ALL SELECT 'survivorship', avg(CASE WHEN status='active' THEN 1.0 ELSE 0 END) FROM entity UNION ALL SELECT 'market_concentration', sum(n*n)*1.0/pow(sum(n),2) FROM (SELECT market, count(*) AS n FROM entity GROUP BY 1)
 UNION ALL SELECT 'size_dispersion', stddev_samp(r)/avg(r) FROM (SELECT company_id, avg(revenue) AS r FROM panel GROUP BY 1)) SELECT rule, value, value>.5 AS biased FROM r""")
def _(spark, sf):
    return x.bias_checks(d.panel(spark, sf), d.entity(spark, sf), 2000)


# ---- graph -------------------------------------------------------------------------------

ED = "ed AS (SELECT least(s_nationkey, c_nationkey) AS src, greatest(s_nationkey, c_nationkey) AS dst, count(*)*1.0 AS weight FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE s_nationkey<>c_nationkey GROUP BY 1,2)"


def trade(spark, sf):
    """Trade between two nations, whichever of them supplies; home trade is no link."""
    li = d.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = d.table(spark, sf, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    su = d.table(spark, sf, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("_s"))
    cu = d.table(spark, sf, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("_c"))
    e = li.join(su, "l_suppkey").join(o, "l_orderkey").join(cu, "o_custkey").where("_s <> _c")
    return e.groupBy(F.least("_s", "_c").alias("src"), F.greatest("_s", "_c").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("trade_degree", "N2", "node degree", "strength centrality", f"WITH {ED}, b AS (SELECT src AS node, weight FROM ed UNION ALL SELECT dst, weight FROM ed) SELECT node, count(*) AS degree, sum(weight) AS strength, count(*)*1.0/((SELECT count(DISTINCT node) FROM b)-1) AS centrality FROM b GROUP BY 1")
def _(spark, sf):
    return g.degree(trade(spark, sf))


LINK = "lk AS (SELECT company_id AS src, parent_id AS dst FROM entity WHERE parent_id IS NOT NULL)"


def links(spark, sf):
    return d.entity(spark, sf).where("parent_id is not null").select(c("company_id").alias("src"), c("parent_id").alias("dst"), F.lit(1.0).alias("weight"))


@query("parent_components", "N2", "node label", "", f"WITH RECURSIVE {LINK}, nd AS (SELECT src AS node FROM lk UNION SELECT dst FROM lk), r(node, top) AS (SELECT node, node FROM nd UNION SELECT r.node, lk.dst FROM r JOIN lk ON lk.src=r.top) SELECT node, min(top) AS label FROM r GROUP BY 1")
def _(spark, sf):
    return g.components(links(spark, sf))


@query("trade_triangles", "N2", "node degree triangles", "clustering", f"""WITH {ED}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM ed a JOIN ed b ON a.dst=b.src JOIN ed c ON c.src=a.src AND c.dst=b.dst), n AS (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t),
 dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1), tc AS (SELECT node, count(*) AS triangles FROM n GROUP BY 1)
SELECT node, degree, coalesce(triangles,0) AS triangles, CASE WHEN degree>1 THEN 2.0*coalesce(triangles,0)/(degree*(degree-1)) ELSE 0 END AS clustering FROM dg LEFT JOIN tc USING (node)""")
def _(spark, sf):
    return g.triangles(trade(spark, sf))


@query("trade_modularity", "N2", "groups", "modularity", f"""WITH {ED}, mm AS (SELECT n_nationkey AS node, n_regionkey AS label FROM nation), m AS (SELECT sum(weight) AS m FROM ed), i AS (SELECT a.label, sum(weight) AS w FROM ed JOIN mm a ON a.node=src JOIN mm b ON b.node=dst WHERE a.label=b.label GROUP BY 1),
 q AS (SELECT label, sum(weight) AS d FROM (SELECT src AS node, weight FROM ed UNION ALL SELECT dst, weight FROM ed) JOIN mm USING (node) GROUP BY 1) SELECT count(*) AS groups, sum(coalesce(w,0)/m-pow(d/(2*m),2)) AS modularity FROM q LEFT JOIN i USING (label), m""")
def _(spark, sf):
    mm = d.table(spark, sf, "nation").select(c("n_nationkey").alias("node"), c("n_regionkey").alias("label"))
    return g.modularity(trade(spark, sf), mm)


@query("trade_eigenvector", "N3", "node", "eigenvector")
def _(spark, sf):
    return g.eigenvector(trade(spark, sf))


@query("nation_similarity", "N1", "src dst", "weight", """WITH n AS (SELECT c_nationkey AS node, n_regionkey AS seg, avg(margin) AS a, avg(rd_ratio) AS b, avg(capex_ratio) AS e, avg(ad_ratio) AS f FROM lc JOIN customer ON c_custkey=company_id JOIN nation ON n_nationkey=c_nationkey GROUP BY 1,2), z AS (SELECT node, seg, a-(a+b+e+f)/4 AS a, b-(a+b+e+f)/4 AS b, e-(a+b+e+f)/4 AS e, f-(a+b+e+f)/4 AS f FROM n)
SELECT x.node AS src, y.node AS dst, CASE WHEN x.seg=y.seg THEN .5 ELSE 0 END+.3*greatest(0,(x.a*y.a+x.b*y.b+x.e*y.e+x.f*y.f)/sqrt((x.a*x.a+x.b*x.b+x.e*x.e+x.f*x.f)*(y.a*y.a+y.b*y.b+y.e*y.e+y.f*y.f)))+.1 AS weight FROM z x JOIN z y ON x.node<y.node
WHERE CASE WHEN x.seg=y.seg THEN .5 ELSE 0 END+.3*greatest(0,(x.a*y.a+x.b*y.b+x.e*y.e+x.f*y.f)/sqrt((x.a*x.a+x.b*x.b+x.e*x.e+x.f*x.f)*(y.a*y.a+y.b*y.b+y.e*y.e+y.f*y.f)))+.1>.5""")
def _(spark, sf):
    m = d.table(spark, sf, "nation").select(c("n_nationkey").alias("nation"), c("n_regionkey").alias("seg"))
    n = d.staged(spark, sf).join(m, "nation").groupBy(c("nation").alias("node"), "seg").agg(*[F.avg(v).alias(v) for v in ("margin", "rd_ratio", "capex_ratio", "ad_ratio")])
    return g.similarity_edges(n, ["margin", "rd_ratio", "capex_ratio", "ad_ratio"], "seg", 0.5)


# ---- events (the batch form of the stream operators) ------------------------------------------

@query("event_counts", "ST2", "day event_type n", "total", "SELECT cast(ts AS date) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1,2", digits=4)
def _(spark, sf):
    return s.counts(d.table(spark, sf, "events"), ["event_type"]).withColumn("day", F.to_date("start"))


@query("event_sessions", "ST4", "user_id n", "minutes", """WITH a AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, count(*) AS n, epoch(max(ts)-min(ts))/60.0 AS minutes FROM b GROUP BY user_id, k""", digits=4)
def _(spark, sf):
    e = s.sessions(d.table(spark, sf, "events"), "user_id")
    return e.select("user_id", "n", (F.timestamp_diff("MICROSECOND", c("start"), c("end")) / 6e7 - 30).alias("minutes"))


@query("current_status", "ST3", "user_id status n", "", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return s.current_status(d.table(spark, sf, "events"), "user_id")


@query("event_properties", "IO6", "event_type n", "mean_k", "SELECT event_type, count(*) AS n, avg(cast(json_extract_string(props,'$.k') AS int)) AS mean_k FROM events GROUP BY 1")
def _(spark, sf):
    e = d.table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean_k"))
