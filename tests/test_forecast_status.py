"""Autoregression against direct solves, means by bootstrap, and stateful status with restarts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cluster, resampling
from panelspark.streaming import ledger


def direct(v, horizon, most, diff):
    x = np.diff(v) if diff else np.asarray(v, float)
    n, mu = len(x), x.mean()
    e = x - mu
    r = [e[k:] @ e[:n - k] / n for k in range(most + 1)]
    best = None
    for p in range(most + 1):
        a = np.linalg.solve([[r[abs(i - j)] for j in range(p)] for i in range(p)], r[1:p + 1]) if p else np.zeros(0)
        if n > p + 2:
            score = n * math.log(max(r[0] - a @ np.array(r[1:p + 1]), 1e-12)) + 2 * (p + 1) * n / (n - p - 2)
            best = min(best, (score, p, a), key=lambda t: t[:2]) if best else (score, p, a)
    a = best[2] if best else np.zeros(0)
    h, out = list(e[::-1]), []
    for _ in range(horizon):
        h.insert(0, float(a @ np.array(h[:len(a)])) if len(a) else 0.0)
        out.append(h[0] + mu)
    return len(a), (v[-1] + np.cumsum(out)) if diff else np.array(out)


@pytest.mark.parametrize("diff", [0, 1])
def test_levinson_equals_direct_solves(spark, diff):
    rng = np.random.default_rng(3)
    series = {}
    for i in range(40):
        n = int(rng.integers(3, 40))
        v = list(rng.normal(size=2))
        for _ in range(n):
            v.append(1.2 * v[-1] - 0.6 * v[-2] + rng.normal() + 0.2)
        series[i] = [float(q) for q in (np.cumsum(v) if diff else v)]
    df = spark.createDataFrame([(i, 2000 + t, q) for i, v in series.items() for t, q in enumerate(v)] + [(99, 2000, 1.0), (98, 2000, None)], "company_id int, year int, v double").repartition(3)
    got = {}
    for r in cluster.autoregression(df, "v", 3, 3, diff).collect():
        got.setdefault(r.company_id, {})[r.step] = (r.order, r.forecast, r.year)
    assert set(got) == set(series) and {o[1][0] for o in got.values()} >= {0, 2}
    for i, v in series.items():
        p, f = direct(v, 3, 3, diff)
        assert [got[i][s][0] for s in (1, 2, 3)] == [p] * 3 and np.allclose([got[i][s][1] for s in (1, 2, 3)], f, atol=1e-6) and got[i][2][2] == 2000 + len(v) + 1


def test_bootstrap_means(spark):
    rng = np.random.default_rng(1)
    rows = [(i // 3, "ab"[i % 2] if i % 7 else None, float(rng.normal(5, 2))) for i in range(900)] + [(1, "a", None)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(4)
    got = {r.g: r for r in resampling.bootstrap_means(df, "id", "v", ["g"], 400).collect()}
    for g in ("a", "b", None):
        own = [v for _, h, v in rows if h == g and v is not None]
        assert got[g].n == len(own) and abs(got[g].mean - np.mean(own)) < 1e-9
        assert abs(got[g].se - np.std(own) / math.sqrt(len(own))) < 0.25 * got[g].se and got[g].lower < got[g].mean < got[g].upper
    # rows of one key move together
    twice = df.unionByName(df)
    a, b = (resampling.bootstrap_means(x, "id", "v", draws=300).first().se for x in (df, twice))
    assert abs(a - b) < 1e-9


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_stateful_status_survives_restarts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    days = [r[0] for r in e.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()]
    src, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.RocksDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(checkpoint):
        d = ledger.stateful_status(ledger.read_events(spark, src, SCHEMA, files_per_trigger=1), "user_id", delay="0 seconds", idle_hours=24)
        q = d.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(ledger.upsert_sink(sink, ["user_id"], "ts")).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None

    try:
        half = len(days) // 2
        e.where(F.to_date("ts") <= F.lit(days[half])).coalesce(1).write.mode("append").parquet(src)
        run(ckpt)
        e.where(F.to_date("ts") > F.lit(days[half])).coalesce(1).write.mode("append").parquet(src)
        run(ckpt)  # goes on from the state of the first run
        got = {r.user_id: r for r in ledger.read_sink(spark, sink, f"user_id long, {ledger.STATUS}").collect()}
        want = {r.user_id: r for r in ledger.current_status(e, "user_id").collect()}
        assert set(got) == set(want) and all((got[u].ts, got[u].status) == (want[u].ts, want[u].status) for u in want)
        # those without an idle spell before their last event keep one count throughout
        assert sum(got[u].n == want[u].n for u in want) > 0 and {r.change for r in got.values()} <= {"updated", "idle"}
        # another checkpoint reads everything again and changes nothing
        run(str(tmp_path / "ckpt2"))
        again = {r.user_id: (r.ts, r.status) for r in ledger.read_sink(spark, sink, f"user_id long, {ledger.STATUS}").collect()}
        assert again == {u: (r.ts, r.status) for u, r in got.items()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ledger.read_sink(spark, str(tmp_path / "none"), "user_id long").count() == 0
