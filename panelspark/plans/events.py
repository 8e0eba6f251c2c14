"""Event joins and sessions (inventory J2, J5, J6, ST4)."""

from pyspark.sql import functions as F

from ..operators import events as v
from ..sources import derive as d
from .registry import query

c = F.col


def stamped(spark, sf):
    return d.table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))


@query("last_click_before_purchase", "J5", "user_id event_id click_id", "value", """SELECT p.user_id, p.event_id, k.event_id AS click_id, p.value FROM (SELECT * FROM events WHERE event_type='purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type='click') k ON p.user_id=k.user_id AND p.ts>=k.ts""")
def _(spark, sf):
    e = stamped(spark, sf)
    k = e.where("event_type = 'click'").select("user_id", "ts", c("event_id").alias("click_id"))
    return v.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value"), k, ["user_id"], "ts", ["click_id"])


@query("sessionized_events", "ST4", "user_id session n", "total", """WITH a AS (SELECT *, CASE WHEN ts-lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, cast(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS session FROM a) SELECT user_id, session, count(*) AS n, sum(value) AS total FROM b GROUP BY 1,2""", digits=4)
def _(spark, sf):
    s = v.sessionize(stamped(spark, sf), "user_id", "ts", "event_id", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("rows_around_exit", "J6 J2", "company_id event_period side n", "revenue", """SELECT p.company_id, end_year AS event_period, CASE WHEN year<end_year THEN 'pre' WHEN year>end_year THEN 'post' ELSE 'at' END AS side, count(*) AS n, avg(revenue) AS revenue
FROM panel p JOIN entity e ON e.company_id=p.company_id AND e.status='extinct' AND year BETWEEN end_year-2 AND end_year+1 GROUP BY 1,2,3""")
def _(spark, sf):
    ev = d.entity(spark, sf).where("status = 'extinct'").select("company_id", c("end_year").alias("year"))
    j = v.interval_rows(d.panel(spark, sf).select("company_id", "year", "revenue"), ev, "company_id", "year", 2, 1)
    return j.groupBy("company_id", "event_period", "side").agg(F.count(F.lit(1)).alias("n"), F.avg("revenue").alias("revenue"))
