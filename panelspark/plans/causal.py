"""Causal queries (inventory H1-H21, U22, U24, J9)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..operators import causal as h
from ..operators import survival as s
from ..operators import synthetic_did as sdid
from ..sources import derive as d
from .registry import query
from .survival import subjects

c = F.col
START = 1998
TRT = ("(SELECT *, operating_profit/revenue AS y, CASE WHEN market='BUILDING' THEN 1 ELSE 0 END AS treated, CASE WHEN market='BUILDING' AND year>=1998 THEN 1 ELSE 0 END AS post, "
       "CASE WHEN year>=1998 THEN 1 ELSE 0 END AS after FROM mpanel)")


def treated(spark, sf):
    e = d.entity(spark, sf).where("market = 'BUILDING'").select("company_id", F.lit(START).alias("treat_year"), (c("balance") / 1000).alias("intensity"))
    p = d.mpanel(spark, sf).select("company_id", "year", "market", "balance", "revenue", sd("operating_profit", "revenue").alias("y"), sd("returned", "gross").alias("x1"),
                                   sd("rd_expenses", "revenue").alias("x2"), "net_profit")
    return h.did_prepare(p, e).withColumn("after", (c("year") >= START).cast("int"))


@query("did_panel", "H1", "company_id year", "treated post dose did", f"""SELECT company_id, year, treated, post, CASE WHEN treated=1 THEN balance/1000 ELSE 0 END AS dose, treated*post AS did FROM {TRT}""")
def _(spark, sf):
    return treated(spark, sf)


C4 = "avg(CASE WHEN treated=1 AND after=1 THEN y END)-avg(CASE WHEN treated=1 AND after=0 THEN y END)-avg(CASE WHEN treated=0 AND after=1 THEN y END)+avg(CASE WHEN treated=0 AND after=0 THEN y END)"


@query("did_two_by_two", "H2", "n", "effect", f"SELECT count(y) AS n, {C4} AS effect FROM {TRT}")
def _(spark, sf):
    return h.did_2x2(treated(spark, sf), "y")


@query("did_two_way_effects", "H2", "term", "coef se")
def _(spark, sf):
    return h.did_twfe(treated(spark, sf), "y", periods=list(range(1995, 2002))).table(spark).where("term = 'did'")


@query("did_time_varying", "H3", "period n", "effect", f"""WITH p AS (SELECT unnest(range(1998,2002)) AS period) SELECT cast(period AS int) AS period, count(y) AS n, {C4} AS effect
FROM (SELECT period, y, treated, CASE WHEN year=period THEN 1 ELSE 0 END AS after FROM {TRT}, p WHERE year<1998 OR year=period) GROUP BY 1""")
def _(spark, sf):
    return h.did_time_varying(treated(spark, sf), "y", START)


@query("did_staggered", "H3", "cohort n", "effect", f"""WITH b AS (SELECT company_id, year, operating_profit/revenue AS y, CASE market WHEN 'BUILDING' THEN 1998 WHEN 'MACHINERY' THEN 1999 END AS ty FROM mpanel),
 k AS (SELECT ty AS cohort, 1 AS treated, year, y FROM b WHERE ty IS NOT NULL UNION ALL SELECT unnest([1998,1999]), 0, year, y FROM b WHERE ty IS NULL)
SELECT cohort, count(y) AS n, {C4} AS effect FROM (SELECT *, CASE WHEN year>=cohort THEN 1 ELSE 0 END AS after FROM k) GROUP BY 1""")
def _(spark, sf):
    e = d.entity(spark, sf)
    e = e.where("market in ('BUILDING','MACHINERY')").select("company_id", F.when(c("market") == "BUILDING", 1998).otherwise(1999).alias("treat_year"), F.lit(1.0).alias("intensity"))
    p = d.mpanel(spark, sf).select("company_id", "year", sd("operating_profit", "revenue").alias("y"))
    return h.did_staggered(h.did_prepare(p, e), "y")


@query("event_study", "H4", "term", "coef se")
def _(spark, sf):
    return h.event_study(treated(spark, sf), "y", -3, 3, list(range(1995, 2002)))


@query("parallel_trends", "H5 A23", "", "slope0 slope1 gap t", f"""WITH p AS (SELECT * FROM {TRT} WHERE post=0), g AS (SELECT treated, regr_slope(y,year) AS b, regr_sxx(y,year) AS sxx, regr_syy(y,year) AS syy, regr_sxy(y,year) AS sxy, count(*) AS n FROM p GROUP BY 1)
SELECT a.b AS slope0, z.b AS slope1, z.b-a.b AS gap, (z.b-a.b)/sqrt((a.syy-a.b*a.sxy)/(a.n-2)/a.sxx+(z.syy-z.b*z.sxy)/(z.n-2)/z.sxx) AS t FROM g a, g z WHERE a.treated=0 AND z.treated=1""")
def _(spark, sf):
    return h.parallel_trends(treated(spark, sf), "y")


@query("placebo_effect", "H5", "n", "effect", f"SELECT count(y) AS n, {C4} AS effect FROM (SELECT treated, y, CASE WHEN year>=1997 THEN 1 ELSE 0 END AS after FROM {TRT} WHERE post=0)")
def _(spark, sf):
    return h.placebo(treated(spark, sf), "y", 1)


@query("detected_treatments", "H6", "company_id year kind", "change", """WITH c AS (SELECT company_id, year, revenue/lag(revenue) OVER (PARTITION BY company_id ORDER BY year)-1 AS change FROM panel),
 s AS (SELECT *, avg(change) OVER e AS m, stddev_samp(change) OVER e AS s FROM c WINDOW e AS (PARTITION BY company_id)) SELECT *, CASE WHEN change>m THEN 'increase' ELSE 'decrease' END AS kind FROM s WHERE abs(change-m)>1.5*s""")
def _(spark, sf):
    return h.detect_treatments(d.panel(spark, sf), "revenue", 1.5)


@query("synthetic_control", "H7", "year", "actual synthetic gap")
def _(spark, sf):
    g = d.mpanel(spark, sf).groupBy("market", "year").agg(F.avg("revenue").alias("revenue"))
    years = {r[0]: set(r[1]) for r in g.where("market is not null").groupBy("market").agg(F.collect_set("year")).collect()}
    # weights need donors with a value in each year of the treated market
    donors = sorted(m for m, ys in years.items() if m != "BUILDING" and ys >= years.get("BUILDING", set()))
    return h.synthetic_control(g, "revenue", "BUILDING", "market", START, donors)[1]


def nation_panel(spark, sf):
    """Margins of every company and year with its nation; the first five nations by name are taken for treated."""
    e = d.entity(spark, sf).select("company_id", "nation")
    return d.panel(spark, sf).select("company_id", "year", sd("operating_profit", "revenue").alias("y")).join(e, "company_id")


def nation_effect(spark, sf):
    x = nation_panel(spark, sf)
    return sdid.synthetic_did(x, "y", "nation", "year", [r[0] for r in x.select("nation").distinct().orderBy("nation").limit(5).collect()], START)


@query("synthetic_did", "H7", "n_placebo", "effect se p")
def _(spark, sf):
    r = nation_effect(spark, sf)
    return spark.createDataFrame([(len(r["placebo"]), r["effect"], r["se"], r["p"])], "n_placebo int, effect double, se double, p double")


@query("synthetic_did_weights", "H7", "kind name", "weight")
def _(spark, sf):
    r = nation_effect(spark, sf)
    return spark.createDataFrame([("unit", str(k), v) for k, v in r["unit_weights"].items()] + [("period", str(k), v) for k, v in r["period_weights"].items()], "kind string, name string, weight double")


CGT = """x AS (SELECT year AS t, operating_profit/revenue AS y, CASE market WHEN 'BUILDING' THEN 1998 WHEN 'MACHINERY' THEN 1999 WHEN 'HOUSEHOLD' THEN 2000 END AS g FROM mpanel WHERE revenue<>0),
 k AS (SELECT DISTINCT g, t FROM x WHERE g IS NOT NULL), f AS (SELECT k.g, k.t,
  avg(CASE WHEN x.g=k.g AND x.t=k.t THEN y END)-avg(CASE WHEN x.g=k.g AND x.t=k.g-1 THEN y END)
  -avg(CASE WHEN x.t=k.t AND (x.g IS NULL OR x.g>greatest(k.t,k.g-1) AND x.g<>k.g) THEN y END)+avg(CASE WHEN x.t=k.g-1 AND (x.g IS NULL OR x.g>greatest(k.t,k.g-1) AND x.g<>k.g) THEN y END) AS effect,
  count(CASE WHEN x.g=k.g AND x.t=k.t THEN y END) AS n_treated, count(CASE WHEN x.t=k.t AND (x.g IS NULL OR x.g>greatest(k.t,k.g-1) AND x.g<>k.g) THEN y END) AS n_control FROM k, x GROUP BY k.g, k.t)"""


def cohorts(spark, sf):
    at = F.when(c("market") == "BUILDING", 1998).when(c("market") == "MACHINERY", 1999).when(c("market") == "HOUSEHOLD", 2000)
    return sdid.group_time_effects(d.mpanel(spark, sf).select("year", at.alias("treat_year"), sd("operating_profit", "revenue").alias("y")), "y")


@query("group_time_effects", "H3", "cohort year since n_treated n_control", "effect", f"WITH {CGT} SELECT g AS cohort, t AS year, t-g AS since, n_treated, n_control, effect FROM f")
def _(spark, sf):
    return cohorts(spark, sf)


@query("exposure_effects", "H3", "since n", "effect", f"WITH {CGT} SELECT t-g AS since, sum(effect*n_treated)/sum(n_treated) AS effect, cast(sum(n_treated) AS bigint) AS n FROM f GROUP BY 1")
def _(spark, sf):
    return sdid.by_exposure(cohorts(spark, sf))


@query("cohort_effects", "H3", "cohort n", "effect overall", f"""WITH {CGT}, a AS (SELECT g AS cohort, avg(effect) AS effect, cast(sum(n_treated) AS bigint) AS n FROM f WHERE t>=g GROUP BY 1)
SELECT *, sum(effect*n) OVER ()/sum(n) OVER () AS overall FROM a""")
def _(spark, sf):
    return sdid.by_cohort(cohorts(spark, sf))


IVT = "(SELECT company_id, year, operating_profit/revenue AS y, returned/gross AS x, lag(returned/gross) OVER (PARTITION BY company_id ORDER BY year) AS z FROM mpanel)"


def iv_data(spark, sf):
    return h.lag_instruments(treated(spark, sf).withColumn("x", c("x1")), "x")


@query("two_stage_least_squares", "H8 H12", "term", "coef first_stage_f", f"""WITH t AS (SELECT * FROM {IVT} WHERE z IS NOT NULL), m AS (SELECT covar_pop(z,y)/covar_pop(z,x) AS b, avg(y) AS my, avg(x) AS mx, regr_r2(x,z) AS r2, count(*) AS n FROM t)
SELECT 'endogenous' AS term, b AS coef, r2*(n-2)/(1-r2) AS first_stage_f FROM m UNION ALL SELECT 'intercept', my-b*mx, r2*(n-2)/(1-r2) FROM m""", digits=4)
def _(spark, sf):
    return h.two_stage(iv_data(spark, sf), "y", "x", [], ["x_lag1"]).table(spark)


@query("gmm_two_step", "H9", "term", "coef se")
def _(spark, sf):
    return h.two_stage(iv_data(spark, sf), "y", "x", [], ["x_lag1", "x_peers"], gmm=True)[0].table(spark)


@query("panel_instruments", "H10", "term", "coef se")
def _(spark, sf):
    return h.panel_iv(iv_data(spark, sf), "y", "x", [], ["x_lag1", "x_peers"]).table(spark)


@query("endogeneity_test", "H11", "", "t p first_stage_r2")
def _(spark, sf):
    r = h.endogeneity_test(iv_data(spark, sf), "y", "x", [], ["x_lag1", "x_peers"])
    return spark.createDataFrame([tuple(r.values())], "t double, p double, first_stage_r2 double")


@query("lag_instruments", "H12", "company_id year", "x_lag1 x_lag2 x_peers", """WITH t AS (SELECT company_id, year, market, returned/gross AS x FROM mpanel)
SELECT company_id, year, lag(x,1) OVER w AS x_lag1, lag(x,2) OVER w AS x_lag2, (sum(x) OVER g-x)/nullif(count(x) OVER g-1,0) AS x_peers FROM t WINDOW w AS (PARTITION BY company_id ORDER BY year), g AS (PARTITION BY market, year)""")
def _(spark, sf):
    return iv_data(spark, sf)


# the score of the matching queries is a plain function of the balance, so that SQL can follow it
def scored(spark, sf):
    return subjects(spark, sf).select("company_id", "market", "balance", "margin", "duration", (c("market") == "BUILDING").cast("int").alias("treat"),
                                      (1 / (1 + F.exp(-c("balance") / 4000))).alias("score"))


SC = "sc AS (SELECT company_id, market, balance, duration, CASE WHEN market='BUILDING' THEN 1 ELSE 0 END AS treat, 1/(1+exp(-balance/4000)) AS score FROM entity JOIN surv USING (company_id, market, balance) WHERE company_id IN (SELECT company_id FROM panel))"


@query("propensity_scores", "H13", "company_id treat", "score")
def _(spark, sf):
    return s.propensity(scored(spark, sf).drop("score"), "treat", ["balance", "margin"])


@query("common_support", "H13", "company_id treat", "score", f"""WITH {SC}, m AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(score) AS lo, max(score) AS hi FROM sc GROUP BY treat)) SELECT company_id, treat, score FROM sc, m WHERE score BETWEEN lo AND hi""")
def _(spark, sf):
    return h.common_support(scored(spark, sf), "treat", "score")


@query("nearest_match", "H14 J9 R8 U22", "treated rank", "distance", f"""WITH {SC}, p AS (SELECT a.company_id AS treated, b.company_id AS control, abs(a.score-b.score) AS distance FROM sc a, sc b WHERE a.treat=1 AND b.treat=0),
 r AS (SELECT *, row_number() OVER (PARTITION BY treated ORDER BY distance, control) AS rank FROM p WHERE distance<=.05) SELECT treated, cast(rank AS int) AS rank, distance FROM r WHERE rank<=2""")
def _(spark, sf):
    return h.match_nearest(scored(spark, sf), "treat", "score", "company_id", 0.05, 2)


@query("match_without_replacement", "J9", "treated control", "distance")
def _(spark, sf):
    return h.match_without_replacement(scored(spark, sf), "treat", "score", "company_id", 0.05)


@query("kernel_match", "H15", "treated", "counterfactual weight", f"""WITH {SC}, k AS (SELECT a.company_id AS treated, exp(-pow((a.score-b.score)/.06,2)/2) AS w, b.duration AS y FROM sc a, sc b WHERE a.treat=1 AND b.treat=0 AND abs(a.score-b.score)<.06*11)
SELECT treated, sum(w*y)/sum(w) AS counterfactual, sum(w) AS weight FROM k GROUP BY 1""", digits=4)
def _(spark, sf):
    return h.kernel_match(scored(spark, sf), "treat", "score", "duration", "company_id", 0.06)


@query("score_strata", "H16", "stratum n n_treated", "effect", f"""WITH {SC}, q AS (SELECT quantile_cont(score,.25) AS a, quantile_cont(score,.5) AS b, quantile_cont(score,.75) AS c FROM sc)
SELECT 1+(CASE WHEN score>a THEN 1 ELSE 0 END)+(CASE WHEN score>b THEN 1 ELSE 0 END)+(CASE WHEN score>c THEN 1 ELSE 0 END) AS stratum, count(*) AS n, cast(sum(treat) AS bigint) AS n_treated,
 avg(CASE WHEN treat=1 THEN duration END)-avg(CASE WHEN treat=0 THEN duration END) AS effect FROM sc, q GROUP BY 1""")
def _(spark, sf):
    return h.stratify(scored(spark, sf), "treat", "score", "duration", 4)


@query("covariate_balance", "H17", "metric", "mean_treated mean_control smd", f"WITH {SC} " + " UNION ALL ".join(
    f"SELECT '{x}' AS metric, avg(CASE WHEN treat=1 THEN {x} END) AS mean_treated, avg(CASE WHEN treat=0 THEN {x} END) AS mean_control, (avg(CASE WHEN treat=1 THEN {x} END)-avg(CASE WHEN treat=0 THEN {x} END))/sqrt((var_samp(CASE WHEN treat=1 THEN {x} END)+var_samp(CASE WHEN treat=0 THEN {x} END))/2) AS smd FROM sc"
    for x in ("balance", "duration")))
def _(spark, sf):
    return h.balance(scored(spark, sf), "treat", ["balance", "duration"])


def pairs(spark, sf):
    x = scored(spark, sf)
    return h.match_nearest(x, "treat", "score", "company_id", 0.05, 3), x


NM = f"""{SC}, nm AS (SELECT t.company_id AS treated, k.company_id AS control, row_number() OVER (PARTITION BY t.company_id ORDER BY abs(t.score-k.score), k.company_id) AS r FROM sc t JOIN sc k ON t.treat=1 AND k.treat=0 AND abs(t.score-k.score)<=.05),
 df AS (SELECT n.treated, any_value(a.duration)-avg(b.duration) AS diff FROM nm n JOIN sc a ON a.company_id=n.treated JOIN sc b ON b.company_id=n.control WHERE r<=3 GROUP BY 1)"""


@query("matched_effect", "H18", "n", "att t", f"WITH {NM} SELECT count(diff) AS n, avg(diff) AS att, avg(diff)/(stddev_samp(diff)/sqrt(count(diff))) AS t FROM df")
def _(spark, sf):
    x = scored(spark, sf)
    return h.matched_effect(h.match_nearest(x, "treat", "score", "company_id", 0.05, 3), x, "company_id", "duration")


@query("matched_differences", "H18", "treated", "diff", f"WITH {NM} SELECT * FROM df")
def _(spark, sf):
    return h.matched_differences(*pairs(spark, sf), "company_id", "duration")


@query("matched_effect_interval", "H18", "n", "mean se lower upper")
def _(spark, sf):
    return h.matched_interval(*pairs(spark, sf), "company_id", "duration")


@query("matched_effect_by_margin", "H21", "high_margin n", "mean se lower upper")
def _(spark, sf):
    """Treated companies above and below a margin of 20%."""
    m, x = pairs(spark, sf)
    return h.matched_interval(m, x.withColumn("high_margin", F.coalesce(c("margin") > 0.2, F.lit(False))), "company_id", "duration", ["high_margin"])


@query("balance_after_matching", "H17", "metric", "smd_before smd_after", f"WITH {NM}, n AS (SELECT treated, control, 1.0/count(*) OVER (PARTITION BY treated) AS v FROM nm WHERE r<=3),\n"
       " w AS (SELECT control AS company_id, sum(v) AS w FROM n GROUP BY 1 UNION ALL SELECT DISTINCT treated, 1.0 FROM n), x AS (SELECT sc.*, coalesce(w,0) AS w FROM sc LEFT JOIN w USING (company_id)) " + " UNION ALL ".join(
    f"SELECT '{v}' AS metric, (avg({v}) FILTER (treat=1)-avg({v}) FILTER (treat=0))/sqrt((var_samp({v}) FILTER (treat=1)+var_samp({v}) FILTER (treat=0))/2) AS smd_before, "
    f"(sum(w*{v}) FILTER (treat=1)/sum(w) FILTER (treat=1)-sum(w*{v}) FILTER (treat=0)/sum(w) FILTER (treat=0))/sqrt((var_samp({v}) FILTER (treat=1)+var_samp({v}) FILTER (treat=0))/2) AS smd_after FROM x" for v in ("balance", "duration")))
def _(spark, sf):
    m, x = pairs(spark, sf)
    return h.balance_after(m, x, "treat", "company_id", ["balance", "duration"])


@query("hidden_bias_bounds", "H19", "robust", "gamma base effect", f"""WITH {SC}, g AS (SELECT avg(CASE WHEN treat=1 THEN duration END)-avg(CASE WHEN treat=0 THEN duration END) AS base, stddev_pop(duration) AS s FROM sc)
SELECT gamma, base, base-(gamma-1)/gamma*s AS effect, abs(base-(gamma-1)/gamma*s)>=.1*s AS robust FROM g, (SELECT unnest([1.0,1.5,2.0]) AS gamma)""", digits=4)
def _(spark, sf):
    return h.sensitivity(scored(spark, sf), "treat", "duration", [1.0, 1.5, 2.0])


@query("interference_check", "H19", "", "share_std lo hi", f"WITH {SC.replace('company_id, market, balance, duration', 'company_id, market, nation, balance, duration').replace('USING (company_id, market, balance)', 'USING (company_id, market, nation, balance)')}, g AS (SELECT nation, avg(treat) AS s FROM sc GROUP BY 1) SELECT stddev_samp(s) AS share_std, min(s) AS lo, max(s) AS hi FROM g")
def _(spark, sf):
    x = scored(spark, sf).join(d.entity(spark, sf).select("company_id", "nation"), "company_id")
    return h.interference(x, "treat", "nation")


@query("heterogeneous_effects", "H20", "company_id", "mu1 mu0 effect")
def _(spark, sf):
    return h.t_learner(scored(spark, sf).withColumn("y", c("duration").cast("double")), "treat", "y", ["balance", "margin"], 10, 4)
