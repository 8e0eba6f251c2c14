"""Validation queries (inventory V1-V20)."""

from pyspark.sql import functions as F

from ..functions.cols import sd
from ..operators import align as al
from ..operators import quality as q
from ..sources import derive as d
from .registry import query

FK = "company_id year rule severity field"
c = F.col


def f(check, sev, field, value, frm, year="year"):
    return (f"SELECT company_id, cast({year} AS int) AS year, '{check}' AS rule, '{sev}' AS severity, "
            f"{field} AS field, cast({value} AS double) AS value FROM {frm}")


@query("type_check", "V2", "field n_bad", "", """
SELECT 'o_orderpriority' AS field, cast(sum(CASE WHEN try_cast(o_orderpriority AS double) IS NULL THEN 1 ELSE 0 END) AS bigint) AS n_bad FROM orders
UNION ALL SELECT 'o_totalprice', cast(sum(CASE WHEN try_cast(o_totalprice AS double) IS NULL THEN 1 ELSE 0 END) AS bigint) FROM orders""")
def _(spark, sf):
    return q.type_check(d.table(spark, sf, "orders"), ["o_orderpriority", "o_totalprice"])


@query("range_check", "V3 V1", "company_id metric n_bad", "lo hi", """
SELECT company_id, metric, count(*) AS n_bad, min(v) AS lo, max(v) AS hi FROM (
  SELECT company_id, 'equity_ratio' AS metric, shareholders_equity/total_assets AS v FROM panel
  UNION ALL SELECT company_id, 'roe', net_profit/nullif(shareholders_equity,0) FROM panel
  UNION ALL SELECT company_id, 'revenue', revenue FROM panel UNION ALL SELECT company_id, 'total_assets', total_assets FROM panel)
WHERE (metric='equity_ratio' AND (v<0.25 OR v>0.6)) OR (metric='roe' AND (v<-0.1 OR v>0.3)) OR (metric='revenue' AND v<30)
  OR (metric='total_assets' AND v<0) GROUP BY 1, 2""")
def _(spark, sf):
    p = d.panel(spark, sf).select("company_id", "total_assets", "revenue",
                                  sd("shareholders_equity", "total_assets").alias("equity_ratio"),
                                  sd("net_profit", "shareholders_equity").alias("roe"))
    return q.range_check(p, {"total_assets": (0.0, None), "revenue": (30.0, None), "equity_ratio": (0.25, 0.6),
                             "roe": (-0.1, 0.3)})


CONT = """SELECT e.company_id, coalesce(missing,0) AS missing, coalesce(longest,0) AS longest, coalesce(points,0) AS points,
  CASE WHEN longest > 3 OR coalesce(points,0) < 3 THEN 'critical' WHEN missing > 0 THEN 'warning' ELSE 'ok' END AS severity
FROM entity e LEFT JOIN (SELECT company_id, cast(sum(run) AS bigint) AS missing, max(run) AS longest FROM (
    SELECT company_id, isle, count(*) AS run FROM (
      SELECT g.company_id, g.year - row_number() OVER (PARTITION BY g.company_id ORDER BY g.year) AS isle
      FROM (SELECT company_id, unnest(range(greatest(1995,start_year), least(2001, coalesce(year(extinction),2001))+1)) AS year FROM entity) g
      LEFT JOIN panel p ON p.company_id=g.company_id AND p.year=g.year WHERE p.year IS NULL) GROUP BY 1,2) GROUP BY 1) m USING (company_id)
LEFT JOIN (SELECT company_id, count(*) AS points FROM panel GROUP BY 1) n USING (company_id)"""


@query("period_continuity", "V4 S2", "company_id missing longest points severity", "", CONT)
def _(spark, sf):
    return q.continuity(d.panel(spark, sf), d.entity(spark, sf), 1995, 2001, 3, 3)


@query("accounting_identities", "V5", FK, "value", " UNION ALL ".join([
    f("balance_sheet", "warning", "'total_assets'", "x", "(SELECT *, abs(ta-(total_liabilities+shareholders_equity))/ta AS x FROM (SELECT *, total_assets+0.04*returned AS ta FROM panel)) WHERE x > 0.0123"),
    f("gross_profit", "warning", "'gross_profit'", "x", "(SELECT *, abs(gross_profit-(revenue-cost_of_sales-0.2*extraordinary_loss))/nullif(abs(gross_profit),0) AS x FROM panel) WHERE x > 0.0123")]))
def _(spark, sf):
    p = d.panel(spark, sf)
    return q.identities(p.withColumn("total_assets", c("total_assets") + 0.04 * c("returned"))
                        .withColumn("cost_of_sales", c("cost_of_sales") + 0.2 * c("extraordinary_loss")), tol=0.0123)


@query("lifecycle_rows", "V6", FK, "value", " UNION ALL ".join([
    f("before_establishment", "warning", "'year'", "b-year", "(SELECT *, year(established + INTERVAL 400 DAY) AS b FROM mpanel) WHERE year < b"),
    f("after_extinction", "critical", "'year'", "year-x", "(SELECT *, year(established + INTERVAL 800 DAY) AS x FROM mpanel WHERE balance < 0) WHERE year > x+2")]))
def _(spark, sf):
    p = d.mpanel(spark, sf).withColumn("extinction", F.when(c("balance") < 0, F.date_add("established", 800)))
    return q.lifecycle_rows(p.withColumn("established", F.date_add("established", 400)))


@query("metadata_rules", "V7", FK, "value", " UNION ALL ".join([
    f("future_establishment", "critical", "'established'", "start_year", "entity WHERE established > DATE '2000-01-01'", "start_year"),
    f("future_extinction", "critical", "'extinction'", "year(extinction)", "entity WHERE extinction > DATE '2000-01-01'", "start_year"),
    f("start_after_end", "critical", "'established'", "start_year", "entity WHERE established >= extinction", "start_year"),
    f("implausible_year", "warning", "'established'", "start_year", "entity WHERE start_year < 1996", "start_year")]))
def _(spark, sf):
    return q.metadata_rules(d.entity(spark, sf), "2000-01-01", 1996)


EXT = """SELECT company_id, year, 'extreme_value' AS "rule", 'info' AS severity, metric AS field, value FROM (
  SELECT *, quantile_cont(value,.25) OVER w AS q1, quantile_cont(value,.75) OVER w AS q3, count(value) OVER w AS n
  FROM (SELECT company_id, year, 'revenue' AS metric, revenue AS value FROM panel UNION ALL SELECT company_id, year, 'net_profit', net_profit FROM panel)
  WINDOW w AS (PARTITION BY company_id, metric)) WHERE n >= 4 AND (value < q1-{k}*(q3-q1) OR value > q3+{k}*(q3-q1))"""


@query("extreme_values", "V8", FK, "value", EXT.format(k=1.5))
def _(spark, sf):
    return q.extreme_values(d.panel(spark, sf), ["revenue", "net_profit"], k=1.5)


SH = "(SELECT *, share*100 AS s, sales/sum(sales) OVER (PARTITION BY year)*100 AS g FROM market_share)"


@query("market_share_rules", "V9", FK, "value", " UNION ALL ".join([
    f("share_range", "critical", "cast(market AS varchar)", "s", f"{SH} WHERE s < 0 OR s > 60"),
    f("global_over_domestic", "warning", "cast(market AS varchar)", "g", f"{SH} WHERE g > s*0.08"),
    f("share_jump", "warning", "cast(market AS varchar)", "j", f"(SELECT *, abs(s-max(s) OVER (PARTITION BY company_id, market ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS j FROM {SH}) WHERE j > 5"),
    "SELECT NULL, year, 'share_total', 'warning', cast(market AS varchar), t FROM (SELECT market, year, sum(share*100) AS t FROM market_share GROUP BY 1,2) WHERE t > 99"]))
def _(spark, sf):
    ms = d.market_share(spark, sf)
    world = ms.groupBy("year").agg(F.sum("sales").alias("w"))
    p = ms.join(F.broadcast(world), "year").select(  # one row per year
        "company_id", "year", "market", (c("share") * 100).alias("share_pct"), (c("sales") / c("w") * 100).alias("global_pct"))
    return q.market_share_rules(p, max_share=60, max_total=99, ratio=0.08, jump=5)


SURVC = " UNION ALL ".join([
    f("stale_active", "warning", "'year'", "last", "pe WHERE status='active' AND last < 2001-0", "last"),
    f("rows_after_extinction", "critical", "'year'", "last", "pe WHERE status='extinct' AND last > gone-1", "last"),
    f("extinct_without_loss", "info", "'net_profit'", "n_end", "pe WHERE status='extinct' AND n_end >= 2 AND n_loss = 0", "last")])
PE = """WITH pe AS (SELECT company_id, status, max(year) AS last, year(extinction) AS gone,
  count(CASE WHEN year >= year(extinction)-3 THEN 1 END) AS n_end, count(CASE WHEN year >= year(extinction)-3 AND net_profit<0 THEN 1 END) AS n_loss
  FROM mpanel GROUP BY company_id, status, extinction) """


def _surv_findings(spark, sf):
    return q.survival_consistency(d.panel(spark, sf), d.entity(spark, sf), 2001, lag=0, grace=-1)


@query("survival_consistency", "V10", FK, "value", PE + SURVC)
def _(spark, sf):
    return _surv_findings(spark, sf)


@query("entrant_patterns", "V11", FK, "value", f"""WITH g AS (SELECT company_id, min(year) AS year, arg_min(revenue, year) AS first,
    count(*) AS n, max((revenue-p)/p) AS g FROM (SELECT *, lag(revenue) OVER (PARTITION BY company_id ORDER BY year) AS p FROM mpanel
    WHERE parent_id IS NOT NULL AND year <= start_year+3) GROUP BY 1) {f("large_first_revenue", "info", "'revenue'", "first", "g WHERE n>=2 AND first>100")}
 UNION ALL {f("extreme_growth", "warning", "'revenue'", "g", "g WHERE n>=3 AND g>1.0")}
 UNION ALL {f("large_first_assets", "warning", "'total_assets'", "total_assets", "mpanel WHERE year=start_year AND total_assets>200")}""")
def _(spark, sf):
    return q.entrant_patterns(d.mpanel(spark, sf), 100.0, 1.0, 200.0)


@query("quality_score", "V12 V13", "company_id ready", "score", PE + f""", fs AS ({SURVC}), g AS (
  SELECT company_id, count(CASE WHEN severity='critical' THEN 1 END) AS cr, count(CASE WHEN severity='warning' THEN 1 END) AS wa FROM fs GROUP BY 1)
SELECT *, coalesce(cr,0)=0 AND score >= 70 AS ready FROM (SELECT e.company_id, cr,
  greatest(0, 100-20*coalesce(cr,0)-5*coalesce(wa,0)) AS score FROM entity e LEFT JOIN g USING (company_id))""")
def _(spark, sf):
    return q.quality_score(_surv_findings(spark, sf), d.entity(spark, sf))


@query("collector_quality", "V12", "company_id", "score", """SELECT company_id,
  least(1, count(*)/7.0*.3 + CASE WHEN count(*) > 1 THEN coalesce(sum(st),0)/(count(*)-1) ELSE 1 END*.25
   + (max(CASE WHEN accounts_receivable>0 THEN 1 ELSE 0 END)+max(CASE WHEN inventories>0 THEN 1 ELSE 0 END)+1)/3.0*.25
   + .2) AS score
FROM (SELECT *, CASE WHEN year = lag(year) OVER (PARTITION BY company_id ORDER BY year)+1 THEN 1 ELSE 0 END AS st FROM panel) GROUP BY 1""")
def _(spark, sf):
    p = d.panel(spark, sf).withColumn("accounts_receivable", F.when(c("accounts_receivable") > 0, c("accounts_receivable")))
    p = p.withColumn("inventories", F.when(c("inventories") > 0, c("inventories")))
    return q.collector_score(p, ["accounts_receivable", "inventories", "capex"], ["revenue", "total_assets"], 1995, 2001)


@query("findings_summary", "V14", "rule critical warning info", "", PE + f""", fs AS ({SURVC})
SELECT "rule", count(CASE WHEN severity='critical' THEN 1 END) AS critical, count(CASE WHEN severity='warning' THEN 1 END) AS warning,
  count(CASE WHEN severity='info' THEN 1 END) AS info FROM fs GROUP BY 1""")
def _(spark, sf):
    return q.summary(_surv_findings(spark, sf))


@query("completeness", "V15", "min_years max_years full_coverage", "completeness consistency avg_years", """
SELECT min(n) AS min_years, max(n) AS max_years, count(CASE WHEN n>=5 THEN 1 END) AS full_coverage, avg(n) AS avg_years,
  sum(f)/(sum(n)*2.0) AS completeness, sum(ok)*1.0/sum(n) AS consistency FROM (SELECT company_id, count(*) AS n,
  count(nullif(inventories,0))+count(nullif(accounts_receivable,0)) AS f, count(CASE WHEN revenue>=operating_profit THEN 1 END) AS ok FROM panel GROUP BY 1)""")
def _(spark, sf):
    p = d.panel(spark, sf)
    for x in ("inventories", "accounts_receivable"):
        p = p.withColumn(x, F.when(c(x) != 0, c(x)))
    return q.completeness(p, ["inventories", "accounts_receivable"], 5)


@query("dedup_first", "V16 ST1", "user_id event_type event_id", "value", """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def _(spark, sf):
    e = d.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return q.dedup(e, ["user_id", "event_type"], [c("ts"), c("event_id")])


@query("missing_pattern", "V17", "metric pattern n", "null_share near_share far_share", """
SELECT metric, count(*) AS n, avg(m) AS null_share, avg(CASE WHEN near THEN m END) AS near_share,
  avg(CASE WHEN coalesce(near,false) THEN NULL ELSE m END) AS far_share,
  CASE WHEN avg(CASE WHEN near THEN m END) > 0.4 THEN 'structural' ELSE 'random' END AS pattern
FROM (SELECT 'revenue' AS metric, CASE WHEN revenue IS NULL THEN 1 ELSE 0 END AS m, abs(year-CASE WHEN status='extinct' THEN end_year END)<=1 AS near FROM holed
 UNION ALL SELECT 'employees', CASE WHEN employees IS NULL THEN 1 ELSE 0 END, abs(year-CASE WHEN status='extinct' THEN end_year END)<=1 FROM holed) GROUP BY 1""")
def _(spark, sf):
    ev = F.when(c("status") == "extinct", c("end_year"))
    return q.missing_profile(d.holed(spark, sf), ["revenue", "employees"], ev, limit=0.4)


@query("missing_by_year", "V17", "year", "null_share", "SELECT year, 1-count(revenue)*1.0/count(*) AS null_share FROM holed GROUP BY 1")
def _(spark, sf):
    return q.missing_by(d.holed(spark, sf), "year", ["revenue", "employees"])


@query("imputation_quality", "V18", "metric filled outliers_added negatives jumps", "completeness mean_shift std_shift similarity", """
WITH b AS (SELECT company_id, year, revenue AS old, coalesce(revenue, last_value(revenue IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY year
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS new FROM holed),
 qq AS (SELECT quantile_cont(old,.25) AS q1, quantile_cont(old,.75) AS q3, count(old) AS no, count(new) AS nn FROM b),
 j AS (SELECT *, abs(new/nullif(last_value(new IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)-1)>2 AS jump FROM b, qq),
 ks AS (SELECT max(abs(ca*1.0/no-cb*1.0/nn)) AS ks FROM (SELECT no, nn, v, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM (
   SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT old AS v, 1 AS a, 0 AS b FROM b WHERE old IS NOT NULL UNION ALL SELECT new, 0, 1 FROM b WHERE new IS NOT NULL) GROUP BY 1), qq))
SELECT 'revenue' AS metric, count(new)-count(old) AS filled, count(CASE WHEN old IS NULL AND (new<q1-1.5*(q3-q1) OR new>q3+1.5*(q3-q1)) THEN 1 END) AS outliers_added,
  count(CASE WHEN new<0 THEN 1 END) AS negatives, count(CASE WHEN jump THEN 1 END) AS jumps, count(new)*1.0/count(*) AS completeness,
  abs(avg(old)-avg(new))/avg(old) AS mean_shift, abs(stddev_samp(old)-stddev_samp(new))/stddev_samp(old) AS std_shift, 1-(SELECT ks FROM ks) AS similarity FROM j""")
def _(spark, sf):
    from ..functions.windows import last_known

    h = d.holed(spark, sf)
    return q.imputation_quality(h, h.withColumn("revenue", last_known("revenue")), ["revenue"])


def iqr_sql(metric, col, tab):
    return (f"SELECT '{metric}' AS metric, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS null_share, "
            f"avg(CASE WHEN v<q1-1.5*(q3-q1) OR v>q3+1.5*(q3-q1) THEN 1.0 ELSE 0 END) AS outlier_share, max(abs(v)) AS mx, var_samp(v) AS vr "
            f"FROM (SELECT {col} AS v FROM {tab}), (SELECT quantile_cont({col},.25) AS q1, quantile_cont({col},.75) AS q3 FROM {tab})")


@query("survival_feature_checks", "V19", "metric warning negative_durations bad_flags", "null_share outlier_share event_rate",
       f"""SELECT t.*, null_share > .5 OR outlier_share > .1 AS warning, negative_durations, bad_flags, event_rate FROM (
  {iqr_sql('duration', 'duration', 'surv')} UNION ALL {iqr_sql('balance', 'balance', 'surv')}) t,
  (SELECT count(CASE WHEN duration<0 THEN 1 END) AS negative_durations, count(CASE WHEN event NOT IN (0,1) THEN 1 END) AS bad_flags, avg(event) AS event_rate FROM surv)""")
def _(spark, sf):
    return q.survival_feature_checks(d.survival(spark, sf), ["duration", "balance"])


@query("factor_checks", "V20", "metric all_zero constant", "missing_rate outlier_rate data_quality_score", f"""
SELECT metric, null_share AS missing_rate, outlier_share AS outlier_rate, coalesce(mx,0)=0 AS all_zero, coalesce(vr,0)<1e-6 AS constant,
 greatest(0, 1-(avg(null_share) OVER ()*.6+avg(outlier_share) OVER ()*.4)) AS data_quality_score FROM (
 {iqr_sql('revenue', 'revenue', 'holed')} UNION ALL {iqr_sql('net_profit', 'net_profit', 'holed')})""")
def _(spark, sf):
    return q.factor_checks(d.holed(spark, sf), ["revenue", "net_profit"])


@query("aligned_panel", "C1 J4", "company_id year market exists_flag", "revenue", "SELECT * FROM holed")
def _(spark, sf):
    return d.holed(spark, sf)


@query("lifetime_stages", "C2 C3 C4", "company_id year life_stage", "lifetime data_availability survival_weight", """
SELECT company_id, year, lifetime, CASE WHEN lifetime IS NULL THEN 'non_existent' WHEN lifetime<=.2 THEN 'startup' WHEN lifetime<=.6 THEN 'growth'
  WHEN lifetime<=.9 THEN 'mature' ELSE 'decline_or_stable' END AS life_stage,
  CASE WHEN exists_flag THEN (CASE WHEN revenue IS NULL THEN 0 ELSE 1 END) ELSE 0 END AS data_availability,
  CASE WHEN exists_flag THEN 1/greatest(ex*1.0/(SELECT count(*) FROM entity), .1) ELSE 0 END AS survival_weight
FROM (SELECT *, CASE WHEN exists_flag THEN (year-start_year)*1.0/greatest(end_year-start_year,1) END AS lifetime,
  count(CASE WHEN exists_flag THEN 1 END) OVER (PARTITION BY year) AS ex FROM holed)""")
def _(spark, sf):
    h = al.lifetime_stage(d.holed(spark, sf))
    return al.yearly_survival_weight(al.availability(h, ["revenue", "employees", "total_assets", "net_profit"]))


@query("panel_ids", "C5", "company_id year entity_id period_id", "", """SELECT company_id, year, cast(dense_rank() OVER (ORDER BY company_id) AS bigint) AS entity_id,
  cast(dense_rank() OVER (ORDER BY year) AS int) AS period_id FROM panel""")
def _(spark, sf):
    return al.panel_ids(d.panel(spark, sf).select("company_id", "year"))


@query("duplicate_keys", "IO8", "user_id event_type n", "", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1,2 HAVING count(*) > 1")
def _(spark, sf):
    from ..sources.io import unique_violations

    return unique_violations(d.table(spark, sf, "events"), ["user_id", "event_type"])


@query("category_export_rows", "IO7 J11", "company_id year", "revenue", "SELECT company_id, year, revenue FROM panel WHERE company_id IN (SELECT company_id FROM entity WHERE market='BUILDING')")
def _(spark, sf):
    keep = d.entity(spark, sf).where("market = 'BUILDING'").select("company_id")
    return d.panel(spark, sf).join(keep, "company_id", "left_semi")
