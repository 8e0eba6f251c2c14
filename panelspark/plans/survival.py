"""Survival queries (inventory U1-U29)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..operators import metrics as m
from ..operators import parametric, resampling, robust, stacking
from ..operators import survival as s
from ..session import reliable
from ..sources import derive as d
from .registry import query

c = F.col
EX = """x AS (SELECT {g} duration, sum(event) AS d, count(*) AS e FROM surv GROUP BY ALL), n AS (SELECT *, sum(e) OVER ({p} ORDER BY duration DESC) AS n FROM x)"""
EXM = EX.format(g="market,", p="PARTITION BY market")


@query("kaplan_meier_by_market", "U4 U7 J7", "market duration d n", "s variance lower upper", f"""
WITH {EXM}, s AS (SELECT market, duration, cast(d AS bigint) AS d, cast(n AS bigint) AS n, CASE WHEN min(1-d*1.0/n) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN d<n THEN 1-d*1.0/n END)) OVER w) END AS s,
  sum(CASE WHEN n>d THEN d*1.0/(n*(n-d)) END) OVER w AS gw FROM n WINDOW w AS (PARTITION BY market ORDER BY duration)), v AS (SELECT *, s*s*gw AS variance, s>0 AND s<1 AS ok FROM s)
SELECT market, duration, d, n, s, variance, CASE WHEN ok THEN 1/(1+exp(-(ln(s/(1-s))-1.959963984540054*sqrt(variance)/(s*(1-s))))) ELSE s END AS lower,
 CASE WHEN ok THEN 1/(1+exp(-(ln(s/(1-s))+1.959963984540054*sqrt(variance)/(s*(1-s))))) ELSE s END AS upper FROM v""")
def _(spark, sf):
    return s.kaplan_meier(d.survival(spark, sf), ["market"])


KMS = f"""{EXM}, km AS (SELECT market, duration, CASE WHEN min(1-d*1.0/n) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN d<n THEN 1-d*1.0/n END)) OVER w) END AS s FROM n WINDOW w AS (PARTITION BY market ORDER BY duration))"""


@query("kaplan_meier_overall", "U4", "duration d n", "s", f"""WITH {EX.format(g='', p='')} SELECT duration, cast(d AS bigint) AS d, cast(n AS bigint) AS n,
 CASE WHEN min(1-d*1.0/n) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN d<n THEN 1-d*1.0/n END)) OVER w) END AS s FROM n WINDOW w AS (ORDER BY duration)""")
def _(spark, sf):
    return s.kaplan_meier(d.survival(spark, sf))


@query("median_survival", "U5", "market median", "final_s", f"WITH {KMS} SELECT market, min(CASE WHEN s < .5 THEN duration END) AS median, min(s) AS final_s FROM km GROUP BY 1")
def _(spark, sf):
    return s.median_survival(s.kaplan_meier(d.survival(spark, sf), ["market"]), ["market"])


@query("survival_lookup", "U5 J5", "market t", "s", f"""WITH {KMS}, q AS (SELECT DISTINCT market, unnest([365,1000,2000]) AS t FROM km)
SELECT q.market, q.t, coalesce(arg_max(s, duration) FILTER (WHERE duration <= t), 1) AS s FROM q JOIN km USING (market) GROUP BY 1,2""")
def _(spark, sf):
    return s.survival_at(s.kaplan_meier(d.survival(spark, sf), ["market"]), ["market"], [365, 1000, 2000])


@query("nelson_aalen", "U6 U7", "market duration d n", "hazard", f"WITH {EXM} SELECT market, duration, cast(d AS bigint) AS d, cast(n AS bigint) AS n, sum(d*1.0/n) OVER (PARTITION BY market ORDER BY duration) AS hazard FROM n")
def _(spark, sf):
    return s.nelson_aalen(d.survival(spark, sf), ["market"])


TWO = """g AS (SELECT duration, sum(CASE WHEN {a} THEN event ELSE 0 END) AS d1, sum(event) AS d, sum(CASE WHEN {a} THEN 1 ELSE 0 END) AS e1, count(*) AS e FROM surv WHERE {f} GROUP BY 1),
 r AS (SELECT *, sum(e1) OVER (ORDER BY duration DESC) AS n1, sum(e) OVER (ORDER BY duration DESC) AS n FROM g),
 z AS (SELECT sum(d1-d*n1*1.0/n) AS u, sum(CASE WHEN n>1 THEN d*(n1*1.0/n)*(1-n1*1.0/n)*(n-d)*1.0/(n-1) ELSE 0 END) AS v FROM r WHERE d>0)"""


@query("logrank_two_sample", "U8", "", "chi2 df", f"WITH {TWO.format(a='balance < 0', f='true')} SELECT u*u/v AS chi2, 1 AS df FROM z")
def _(spark, sf):
    r = s.logrank(d.survival(spark, sf).withColumn("g", (c("balance") < 0).cast("int")), "g", [0, 1])
    return spark.createDataFrame([(r["chi2"], r["df"])], "chi2 double, df double")


def markets(df):
    """All markets of a table, in order."""
    return [r[0] for r in df.where("market is not null").select("market").distinct().orderBy("market").collect()]


# the markets of the checking SQL
MK = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("logrank_pairs", "U9", "a b", "chi2 o_minus_e", "\nUNION ALL ".join(
    f"SELECT * FROM (WITH {TWO.format(a=f'''market='{a}' ''', f=f'''market IN ('{a}','{b}')''')} SELECT '{a}' AS a, '{b}' AS b, u*u/v AS chi2, u AS o_minus_e FROM z)"
    for i, a in enumerate(MK) for b in MK[i + 1:]))
def _(spark, sf):
    x = d.survival(spark, sf)
    return s.logrank_pairs(x, "market", markets(x))


@query("logrank_k_sample", "U9", "", "chi2 df p")
def _(spark, sf):
    x = d.survival(spark, sf)
    r = s.logrank(x, "market", markets(x))
    return spark.createDataFrame([tuple(r.values())], "chi2 double, df double, p double")


LAST = "cast(coalesce(year(any_value(extinction)), max(year)) AS int)"


@query("survival_years_table", "U1", "company_id start end_year duration event", "", f"""SELECT company_id, min(year) AS start, {LAST} AS end_year,
 cast({LAST}-min(year) AS int) AS duration, CASE WHEN any_value(extinction) IS NULL THEN 0 ELSE 1 END AS event FROM mpanel GROUP BY 1""")
def _(spark, sf):
    ev = d.ledger(spark, sf).where("event_type in ('bankruptcy','dissolution')")
    return s.survival_table(d.panel(spark, sf), ev, 2001).withColumnRenamed("end", "end_year")


def pp(spark, sf):
    ev = d.ledger(spark, sf).where("event_type in ('bankruptcy','dissolution')")
    p = d.panel(spark, sf).withColumn("margin", sd("operating_profit", "revenue"))
    return s.person_period(s.survival_table(p, ev, 2001), p, ["revenue", "margin"])


@query("person_period", "U2", "company_id year time_from_start event_occurred", "revenue margin", """
WITH t AS (SELECT company_id, min(year) AS s, cast(coalesce(year(any_value(extinction)), max(year)) AS int) AS e, CASE WHEN any_value(extinction) IS NULL THEN 0 ELSE 1 END AS ev FROM mpanel GROUP BY 1),
 x AS (SELECT *, cast(unnest(range(s,e+1)) AS int) AS year FROM t) SELECT x.company_id, x.year, x.year-s AS time_from_start, CASE WHEN x.year=e THEN ev ELSE 0 END AS event_occurred, revenue, operating_profit/revenue AS margin
FROM x LEFT JOIN panel p ON p.company_id=x.company_id AND p.year=x.year""")
def _(spark, sf):
    return pp(spark, sf)


@query("recent_means", "U3", "company_id", "revenue net_profit", """SELECT company_id, avg(revenue) AS revenue, avg(net_profit) AS net_profit FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS b FROM panel) WHERE b<=3 GROUP BY 1""")
def _(spark, sf):
    return s.recent_means(d.panel(spark, sf), ["revenue", "net_profit"], 3)


def subjects(spark, sf):
    p = d.panel(spark, sf).select("company_id", "year", "revenue", sd("operating_profit", "revenue").alias("margin"), sd("returned", "gross").alias("returns"))
    x = s.recent_means(p, ["margin", "returns"], 3)
    return d.survival(spark, sf).join(x, "company_id").withColumn("balance_k", c("balance") / 1000.0)


@query("cox_regression", "U10", "term", "coef hr se z p")
def _(spark, sf):
    return s.cox(subjects(spark, sf), ["margin", "balance_k"]).table(spark)


@query("cox_score_equation", "U10 U12", "at_optimum", "")
def _(spark, sf):
    f = s.cox(subjects(spark, sf), ["margin", "balance_k"])
    return spark.createDataFrame([(bool(abs(f.gradient).max() < 1e-4),)], "at_optimum boolean")


@query("cox_market_hazards", "U11", "term market differs", "coef hr hr_ratio")
def _(spark, sf):
    x = subjects(spark, sf)
    return s.market_hazards(x, ["balance_k"], "market", markets(x))


@query("cox_baseline_survival", "U10", "duration", "hazard")
def _(spark, sf):
    x = subjects(spark, sf)
    return s.cox_baseline(x, s.cox(x, ["margin", "balance_k"]))


@query("concordance_index", "U12 U17", "", "comparable concordant discordant c_index", """WITH p AS (SELECT sum(CASE WHEN a.balance>b.balance THEN 1.0 ELSE 0 END) AS con, sum(CASE WHEN a.balance<b.balance THEN 1.0 ELSE 0 END) AS dis, count(*)*1.0 AS n
 FROM surv a JOIN surv b ON a.event=1 AND a.duration<b.duration) SELECT n AS comparable, con AS concordant, dis AS discordant, (con+.5*(n-con-dis))/n AS c_index FROM p""")
def _(spark, sf):
    return s.concordance(d.survival(spark, sf), "balance")


@query("concordance_by_market", "U17", "market", "c_index", """SELECT a.market, (sum(CASE WHEN a.balance>b.balance THEN 1.0 ELSE 0 END)+.5*sum(CASE WHEN a.balance=b.balance THEN 1 ELSE 0 END))/count(*) AS c_index
FROM surv a JOIN surv b ON a.market=b.market AND a.event=1 AND a.duration<b.duration GROUP BY 1""")
def _(spark, sf):
    return s.concordance(d.survival(spark, sf), "balance", ["market"])


def multiples(keys):
    """Weights of four fixed replicates: the remainders of the key by 2, 3, 4 and 5."""
    import numpy as np

    return np.stack([keys % k for k in (2, 3, 4, 5)], axis=1).astype(float)


@query("concordance_weighted", "U17", "b", "concordant discordant comparable c_index", """WITH q AS (SELECT unnest([2,3,4,5]) AS k), x AS (SELECT k, balance AS s, duration, event, cast(company_id AS bigint) % k AS w FROM surv, q),
 p AS (SELECT a.k, sum(CASE WHEN a.s>b.s THEN a.w*b.w ELSE 0 END)*1.0 AS concordant, sum(CASE WHEN a.s<b.s THEN a.w*b.w ELSE 0 END)*1.0 AS discordant, sum(a.w*b.w)*1.0 AS comparable
 FROM x a JOIN x b ON a.k=b.k AND a.event=1 AND a.duration<b.duration GROUP BY 1) SELECT cast(k-2 AS bigint) AS b, *, (concordant+.5*(comparable-concordant-discordant))/comparable AS c_index FROM p""")
def _(spark, sf):
    return resampling.weighted_concordance(d.survival(spark, sf), "balance", c("company_id").cast("long"), multiples)


@query("concordance_interval", "U17", "draws", "c_index mean se lower upper")
def _(spark, sf):
    return resampling.interval_of_fit(subjects(spark, sf), ["margin", "balance_k"], "company_id", 1000)


@query("concordance_folds", "U17", "fold", "comparable c_index mean_c")
def _(spark, sf):
    return resampling.cross_validated_concordance(subjects(spark, sf), ["margin", "balance_k"], "company_id", 5)


@query("time_dependent_auc", "U17", "t cases controls", "auc", """WITH q AS (SELECT unnest([365,1000,2000]) AS t), y AS (SELECT t, balance AS s, CASE WHEN duration<=t AND event=1 THEN 1 WHEN duration>t THEN 0 END AS y FROM surv, q)
SELECT a.t, count(DISTINCT a.s) AS x, (SELECT count(*) FROM y k WHERE k.t=a.t AND y=1) AS cases, (SELECT count(*) FROM y k WHERE k.t=a.t AND y=0) AS controls, sum(CASE WHEN a.s>b.s THEN 1.0 WHEN a.s=b.s THEN .5 ELSE 0 END)/count(*) AS auc
FROM y a JOIN y b ON a.t=b.t AND a.y=1 AND b.y=0 GROUP BY a.t""")
def _(spark, sf):
    return s.auc_at(d.survival(spark, sf), "balance", [365, 1000, 2000])


@query("brier_scores", "U17", "t n", "brier", """WITH q AS (SELECT unnest([365,1000,2000]) AS t) SELECT t, count(*) AS n, avg(pow(1/(1+exp(-balance/5000))-CASE WHEN duration<=t AND event=1 THEN 0 ELSE 1 END,2)) AS brier FROM surv, q GROUP BY 1""")
def _(spark, sf):
    return s.brier_at(d.survival(spark, sf).withColumn("p", 1 / (1 + F.exp(-c("balance") / 5000))), "p", [365, 1000, 2000])


@query("risk_calibration", "U17", "bin n", "predicted observed", """WITH x AS (SELECT *, 1/(1+exp(-balance/5000)) AS p FROM surv), q AS (SELECT quantile_cont(p,.25) AS a, quantile_cont(p,.5) AS b, quantile_cont(p,.75) AS e FROM x)
SELECT 1+(CASE WHEN p>a THEN 1 ELSE 0 END)+(CASE WHEN p>b THEN 1 ELSE 0 END)+(CASE WHEN p>e THEN 1 ELSE 0 END) AS bin, count(*) AS n, avg(p) AS predicted, avg(event) AS observed FROM x, q GROUP BY 1""")
def _(spark, sf):
    return s.calibration(d.survival(spark, sf).withColumn("p", 1 / (1 + F.exp(-c("balance") / 5000))), "p", "event", 4)


@query("exponential_fit", "U13", "dist", "intercept loglik", """SELECT 'exponential' AS dist, ln(sum(duration)*1.0/sum(event)) AS intercept, sum(event)*ln(sum(event)*1.0/sum(duration))-sum(event) AS loglik FROM surv WHERE duration>0""", digits=3)
def _(spark, sf):
    return parametric.comparison(spark, parametric.fit_all(d.survival(spark, sf), ["exponential"]))


# bisection on the shape: the likelihood equation of a Weibull sample has one root
@query("weibull_fit", "U13", "dist", "intercept scale loglik aic bic", """WITH RECURSIVE y AS (SELECT duration/1000.0 AS t, event FROM surv WHERE duration>0), z AS (SELECT sum(event) AS d, sum(event*ln(t)) AS el, count(*) AS n FROM y),
 b AS (SELECT 0 AS i, cast(.01 AS double) AS lo, cast(50 AS double) AS hi UNION ALL SELECT any_value(i)+1, CASE WHEN sum(pow(t,(lo+hi)/2)*ln(t))/sum(pow(t,(lo+hi)/2))-2/(lo+hi)-any_value(el/d) < 0 THEN (lo+hi)/2 ELSE lo END,
  CASE WHEN sum(pow(t,(lo+hi)/2)*ln(t))/sum(pow(t,(lo+hi)/2))-2/(lo+hi)-any_value(el/d) < 0 THEN hi ELSE (lo+hi)/2 END FROM b, y, z WHERE i<60 GROUP BY lo, hi),
 k AS (SELECT lo AS k FROM b WHERE i=60), f AS (SELECT any_value(k) AS k, any_value(d) AS d, any_value(n) AS n, any_value(el) AS el, ln(sum(pow(t,k))/any_value(d))/any_value(k) AS m FROM y, z, k),
 l AS (SELECT *, d*ln(k)-d*k*m+(k-1)*el-d-d*ln(1000.0) AS loglik FROM f)
SELECT 'weibull' AS dist, m+ln(1000.0) AS intercept, 1/k AS scale, loglik, 4-2*loglik AS aic, 2*ln(n)-2*loglik AS bic FROM l""", digits=4)
def _(spark, sf):
    return parametric.comparison(spark, parametric.fit_all(d.survival(spark, sf), ["weibull"]))


ALL_FAMILIES = list(parametric.FAMILIES)


@query("parametric_comparison", "U13 U14", "dist aic_rank bic_rank converged", "intercept scale loglik aic bic")
def _(spark, sf):
    return parametric.comparison(spark, parametric.fit_all(subjects(spark, sf), ALL_FAMILIES, ["balance_k"]))


@query("parametric_coefficients", "U13", "dist term", "coef se p")
def _(spark, sf):
    return parametric.coefficients(spark, parametric.fit_all(subjects(spark, sf), ALL_FAMILIES, ["balance_k", "returns"]))


@query("exponential_curves", "U14", "market t", "survival hazard median", """WITH z AS (SELECT sum(event)*1.0/sum(duration) AS r FROM surv WHERE duration>0), q AS (SELECT DISTINCT market FROM surv), u AS (SELECT cast(unnest([365,1000,2000]) AS double) AS t)
SELECT market, t, exp(-r*t) AS survival, r AS hazard, ln(2)/r AS median FROM q, u, z""")
def _(spark, sf):
    x = d.survival(spark, sf)
    fit = parametric.fit_all(x, ["exponential"])[0]
    rows = parametric.with_median(x.select("market").distinct(), fit)
    return parametric.curves(rows, fit, [365, 1000, 2000], ["market", "median"])


@query("parametric_curves", "U14", "company_id t", "survival hazard median")
def _(spark, sf):
    """Of the family with the least AIC."""
    x = subjects(spark, sf)
    fit = parametric.best(parametric.fit_all(x, ALL_FAMILIES, ["balance_k"]))
    return parametric.curves(parametric.with_median(x, fit), fit, [365.25 * y for y in (1, 3, 5, 10)], ["company_id", "median"])


RES = """g AS (SELECT duration, sum(event) AS d, count(*) AS e, sum(balance/1000) AS sx FROM surv GROUP BY 1),
 r AS (SELECT *, sum(e) OVER w AS n, sum(sx) OVER w AS s1 FROM g WINDOW w AS (ORDER BY duration DESC)),
 a AS (SELECT *, sum(d*1.0/n) OVER u AS ca, sum(d*s1/(n*1.0*n)) OVER u AS cb FROM r WINDOW u AS (ORDER BY duration)),
 z AS (SELECT company_id, market, event*(balance/1000-s1/n)-(balance/1000*ca-cb) AS r_balance_k FROM surv JOIN a USING (duration))"""


def scored(spark, sf):
    return d.survival(spark, sf).withColumn("balance_k", c("balance") / 1000.0)


@query("cox_score_residuals", "U10", "company_id", "r_balance_k", f"WITH {RES} SELECT company_id, r_balance_k FROM z")
def _(spark, sf):
    return robust.score_residuals(scored(spark, sf), ["balance_k"], [0.0], ["company_id"])


@query("cox_robust_score_test", "U10", "clusters", "chi2", f"""WITH {RES}, m AS (SELECT market, sum(r_balance_k) AS r FROM z GROUP BY 1)
SELECT 'subject' AS clusters, pow(sum(r_balance_k),2)/sum(r_balance_k*r_balance_k) AS chi2 FROM z UNION ALL SELECT 'market', pow(sum(r),2)/sum(r*r) FROM m""")
def _(spark, sf):
    x = scored(spark, sf)
    return spark.createDataFrame([(n, robust.robust_score_test(x, ["balance_k"], k)["chi2"]) for n, k in (("subject", None), ("market", "market"))], "clusters string, chi2 double")


@query("cox_robust_errors", "U10", "clusters term", "coef se robust_se z p")
def _(spark, sf):
    names = ["margin", "balance_k"]
    x = reliable(subjects(spark, sf).select("market", "duration", "event", *names))
    fit = s.cox(x.dropna(subset=["duration", "event"]), names, ties="breslow")
    parts = [robust.robust_cox(x, names, k, fit).withColumn("clusters", F.lit(n)) for n, k in (("subject", None), ("market", "market"))]
    return parts[0].unionByName(parts[1])


@query("hazard_forest", "U15", "company_id year", "hazard survival")
def _(spark, sf):
    return s.hazard_model(pp(spark, sf), ["revenue", "margin"], "forest", 100, 3)[0]


@query("feature_screening", "U16", "term", "coef p")
def _(spark, sf):
    return s.screening(subjects(spark, sf), ["margin", "returns", "balance_k"])


@query("screening_spearman", "U16", "term n", "rho", """WITH x AS (SELECT balance/1000 AS v, duration*1.0 AS t FROM surv WHERE company_id IN (SELECT company_id FROM panel)), r AS (SELECT rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0 AS a, rank() OVER (ORDER BY t)+(count(*) OVER (PARTITION BY t)-1)/2.0 AS b FROM x)
SELECT 'balance_k' AS term, count(*) AS n, corr(a,b) AS rho FROM r""")
def _(spark, sf):
    from ..operators import stats as st

    x = subjects(spark, sf).withColumn("t", c("duration").cast("double"))
    return st.spearman(x, ["company_id"], ["balance_k", "t"]).select(c("x").alias("term"), "n", c("r").alias("rho"))


@query("screening_lasso", "U16", "term kept", "coef")
def _(spark, sf):
    """Features that an l1 penalty keeps for the log of the duration, all on one scale."""
    from ..operators import regression as rg

    names = ["margin", "returns", "balance_k"]
    x = subjects(spark, sf).where("duration > 0").withColumn("log_t", F.ln(c("duration").cast("double")))
    return rg.elastic_net(x, "log_t", names, 0.01, 1.0)[0].withColumn("kept", c("coef") != 0)


@query("market_survival_stats", "U18", "market n events", "rate mean_duration duration_pct_mean", """SELECT market, count(*) AS n, cast(sum(event) AS bigint) AS events, avg(event) AS rate, avg(duration) AS mean_duration, avg(pr) AS duration_pct_mean
FROM (SELECT *, (rank() OVER (PARTITION BY market ORDER BY duration)+(count(*) OVER (PARTITION BY market, duration)-1)/2.0)/count(*) OVER (PARTITION BY market) AS pr FROM surv) GROUP BY 1""")
def _(spark, sf):
    from ..functions.ranks import with_ranks

    x = with_ranks(d.survival(spark, sf), ["market"], "duration")
    return x.groupBy("market").agg(F.count(F.lit(1)).alias("n_"), F.sum("event").alias("events"), F.avg("event").alias("rate"), F.avg("duration").alias("mean_duration"),
                                   F.avg(c("avg_rank") / c("n")).alias("duration_pct_mean")).withColumnRenamed("n_", "n")


@query("survival_bias_ratios", "U19", "market n extinct", "extinct_share", "SELECT market, count(*) AS n, cast(sum(event) AS bigint) AS extinct, avg(event) AS extinct_share FROM surv GROUP BY 1")
def _(spark, sf):
    return d.survival(spark, sf).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("extinct"), F.avg("event").alias("extinct_share"))


def selected(spark, sf):
    return subjects(spark, sf).withColumn("alive", (1 - c("event")).cast("double")).withColumn("age", c("duration") / 365.25)


@query("heckman_correction", "U20", "term", "coef se p")
def _(spark, sf):
    return s.heckman(selected(spark, sf), "alive", ["balance_k", "returns"], "margin", ["balance_k"])


@query("inverse_probability_weights", "U21", "company_id", "weight")
def _(spark, sf):
    return s.ipw(selected(spark, sf), "alive", ["balance_k", "returns"], "logistic")


@query("stratified_bootstrap", "U23 H18", "market", "mean se lower upper")
def _(spark, sf):
    return s.bootstrap_mean(subjects(spark, sf), "company_id", "margin", ["market"], 1000)


def percentiles(spark, sf):
    return stacking.percentile_features(subjects(spark, sf), "company_id", "market", ["margin", "returns", "balance_k"])


MPC = "SELECT company_id, market, balance/1000 AS v FROM surv JOIN (SELECT DISTINCT company_id FROM panel) USING (company_id)"


@query("risk_percentiles", "U26", "company_id", "pct low", f"""WITH x AS ({MPC}), n AS (SELECT *, count(*) OVER (PARTITION BY market) AS n, rank() OVER (PARTITION BY market ORDER BY v)-1 AS lt, count(*) OVER (PARTITION BY market, v) AS e FROM x)
SELECT company_id, (2*lt+e+1)/(2.0*n) AS pct, CASE WHEN (2*lt+e+1)/(2.0*n) < .25 THEN 1 ELSE 0 END AS low FROM n""")
def _(spark, sf):
    return percentiles(spark, sf)[0].select("company_id", c("balance_k_pct").alias("pct"), c("balance_k_low").alias("low"))


def combined(spark, sf):
    x, names = percentiles(spark, sf)
    return stacking.stacked_risk(x, "event", ["margin", "returns", "balance_k", *names], "company_id", folds=3, trees=100, rounds=50)


@query("stacked_risk_quality", "U26", "member n", "auc c_index brier")
def _(spark, sf):
    return stacking.member_quality(combined(spark, sf), "event")


@query("stacked_risk_summary", "U26 U27", "market n n_high", "mean_risk median_risk high_share least_survival observed")
def _(spark, sf):
    return stacking.risk_by_group(combined(spark, sf), "market")


@query("extinction_risk_summary", "U27", "market n", "mean_risk median_risk high_share", """WITH r AS (SELECT company_id, CASE WHEN max(year) < 2000 THEN 0.9 ELSE 0.2 END AS r FROM panel GROUP BY 1)
SELECT market, count(*) AS n, avg(r) AS mean_risk, quantile_cont(r,.5) AS median_risk, avg(CASE WHEN r>.5 THEN 1.0 ELSE 0 END) AS high_share FROM r JOIN entity USING (company_id) GROUP BY 1""")
def _(spark, sf):
    r = d.panel(spark, sf).groupBy("company_id").agg(F.when(F.max("year") < 2000, 0.9).otherwise(0.2).alias("r"))
    return s.risk_summary(r.join(d.entity(spark, sf).select("company_id", "market"), "company_id"), "market", "r")


@query("future_extinctions", "U27", "company_id ahead", "probability", """WITH r AS (SELECT company_id, avg(CASE WHEN operating_profit<0 THEN 1.0 ELSE 0 END) AS r FROM panel GROUP BY 1), x AS (SELECT *, 1-.3*r AS s1, cast(unnest(range(1,9)) AS int) AS ahead FROM r),
 p AS (SELECT *, CASE ahead WHEN 1 THEN 1-s1 WHEN 3 THEN 1-pow(s1,3.0) WHEN 5 THEN 1-pow(s1,5.0) ELSE 1-exp(ln(s1)*ahead) END AS probability FROM x) SELECT * FROM p WHERE probability > .5""")
def _(spark, sf):
    r = d.panel(spark, sf).groupBy("company_id").agg(F.avg((c("operating_profit") < 0).cast("double")).alias("r"))
    return s.future_extinctions(r.select("*", *[v.alias(k) for k, v in m.risk_outlook(c("r")).items()]), 8)


@query("survival_curve_patterns", "U28", "market pattern", "s_early s_late", f"""WITH {KMS}, z AS (SELECT market, coalesce(arg_max(s,duration) FILTER (WHERE duration<=730),1) AS s_early, coalesce(arg_max(s,duration) FILTER (WHERE duration<=2000),1) AS s_late FROM km GROUP BY 1)
SELECT *, CASE WHEN s_late>.8 THEN 'stable' WHEN s_early<.7 THEN 'early_decline' WHEN s_early-s_late>.3 THEN 'late_decline' ELSE 'gradual' END AS pattern FROM z""")
def _(spark, sf):
    return s.curve_class(s.kaplan_meier(d.survival(spark, sf), ["market"]), ["market"], 730, 2000)


@query("survival_factor_importance", "U29", "term", "coef p importance score")
def _(spark, sf):
    names = ["margin", "returns", "balance_k"]
    x = reliable(subjects(spark, sf).select("company_id", "duration", "event", *names))
    _, model = s.hazard_model(x.withColumn("event_occurred", c("event")).withColumn("time_from_start", F.lit(0)).withColumn("year", F.lit(0)), names, "forest", 100, 4)
    return s.factor_importance(s.cox(x, names).table(spark), dict(zip(names, [float(v) for v in model.featureImportances.toArray()])))
