"""Sources, sinks and event streams."""

import pytest
from pyspark.sql import functions as F

from panelspark.schema import CATALOGUE
from panelspark.sources import io
from panelspark.streaming import ledger


def test_csv_and_export(spark, frame, tmp_path):
    f = frame("company_id long, year int, metric string, value double", [(1, 2000, "m", 1.5), (2, 2001, "m", 2.5)])
    io.write(f, str(tmp_path / "c"), "csv")
    back = io.read_csv(spark, str(tmp_path / "c"), "metric_fact")
    assert sorted(back.collect()) == sorted(f.collect())
    e = frame("company_id long, market string", [(1, "a"), (2, "b")])
    io.export({"facts": f}, str(tmp_path / "x"), e, "a")
    assert [r["company_id"] for r in spark.read.parquet(str(tmp_path / "x" / "facts")).collect()] == [1]


def test_rename_map_and_append(spark, frame, tmp_path):
    frame("code string, fiscal_year string, metric string, value string", [("1", "2000", "m", "x"), ("2", "2001", "m", "3")]).write.option("header", True).csv(str(tmp_path / "r"))
    d = io.read_csv(spark, str(tmp_path / "r"), "metric_fact", {"code": "company_id", "fiscal_year": "year"})
    assert sorted((r["company_id"], r["value"]) for r in d.collect()) == [(1, None), (2, 3.0)]
    io.append(d, str(tmp_path / "p"))
    io.append(d, str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    assert p.count() == 4 and io.history(p, 1, 1999, 2000).count() == 2
    assert io.unique_violations(p, ["company_id", "year"]).count() == 2


def test_schema_check(frame):
    assert {r["field"] for r in io.check_tables(frame("company_id long, year int, metric string", [(1, 1, "a")]), "metric_fact").collect()} == {"value"}
    assert len(CATALOGUE) == 15


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _rows(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_match_batch(spark, tmp_path):
    e = _rows(spark)
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    src = ledger.read_events(spark, str(tmp_path / "in"), SCHEMA)
    got = _run(ledger.counts(src, ["event_type"], delay="60 days"), "update", "counts_out")
    want = ledger.counts(e, ["event_type"])
    cols = ["start", "event_type", "n"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    st = _run(ledger.current_status(src, "user_id"), "complete", "status_out")
    assert sorted(st.select("user_id", "status", "n").collect()) == sorted(ledger.current_status(e, "user_id").select("user_id", "status", "n").collect())


def test_dedup_and_sessions_stream(spark, tmp_path):
    e = _rows(spark)
    e.unionByName(e).repartition(3).write.parquet(str(tmp_path / "in"))
    src = ledger.read_events(spark, str(tmp_path / "in"), SCHEMA)
    assert _run(ledger.dedup(src, ["event_id"], delay="60 days"), "append", "dedup_out").count() == e.count()
    s = ledger.sessions(ledger.read_events(spark, str(tmp_path / "in"), SCHEMA), "user_id", delay="1 minute")
    out = _run(s, "append", "sessions_out")
    assert 0 < out.count() <= ledger.sessions(e, "user_id").count()


def test_upsert_sink(spark, frame, tmp_path):
    w = ledger.upsert_sink(str(tmp_path / "t"), ["k"], "v")
    a = frame("k long, v double", [(1, 1.0), (2, 5.0)])
    b = frame("k long, v double", [(1, 3.0), (2, 4.0), (3, 1.0)])
    w(a, 0)
    w(b, 1)
    w(b, 1)  # a replayed batch changes nothing
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v=1")).select("k", "v").collect()) == [(1, 3.0), (2, 5.0), (3, 1.0)]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.sparkContext.getCheckpointDir() is not None or pytest.skip("nothing checkpointed yet")
