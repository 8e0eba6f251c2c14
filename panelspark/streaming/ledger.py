"""Event-ledger streams: deduplication, windowed counts, current status and sessions.

Late rows beyond the watermark are dropped.  State is keyed by entity or by
(entity, type); the counts aggregate partially before their shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def dedup(events: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First event per key inside the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def counts(events: DataFrame, by: list[str], ts: str = "ts", window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts and sums by type."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = events.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(c("w.start").alias("start"), c("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, entity: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Session windows per entity."""
    g = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(entity, c("w.start").alias("start"), c("w.end").alias("end"), "n", "total")


def current_status(events: DataFrame, entity: str, ts: str = "ts") -> DataFrame:
    """Latest event per entity by event time (update or complete mode); older arrivals never replace newer state."""
    g = events.groupBy(entity).agg(F.max(F.struct(ts, "event_id", "event_type")).alias("_r"), F.count(F.lit(1)).alias("n"))
    return g.select(entity, c(f"_r.{ts}").alias(ts), c("_r.event_type").alias("status"), "n")


RocksDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "ts timestamp, status string, n long, change string"


def stateful_status(events: DataFrame, entity: str, ts: str = "ts", delay: str = "1 day", idle_hours: float = 24 * 30) -> DataFrame:
    """Status of each entity as state: its newest event by (time, id), the number of its events, and when it falls idle.

    A batch gives one row (``change`` = updated) for each entity that it touches.  An event older than the state counts
    but does not replace the status.  An entity without an event for ``idle_hours`` of event time is dropped by a timer,
    with a last row (``change`` = idle), so state does not grow with entities that are gone.  Events older than the
    watermark are dropped by Spark.  Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    from pyspark.sql.streaming import StatefulProcessor

    kind = events.schema[entity].dataType.simpleString()
    idle_ms = int(idle_hours * 3_600_000)

    class Status(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("status", "at long, id long, status string, n long")

        def handleInputRows(self, key, rows, timerValues):
            old = self.state.get()
            best, n = ((old[0], old[1], old[2]), old[3]) if old is not None else (None, 0)
            before = best
            for b in rows:
                n += len(b)
                b = b.dropna(subset=[ts])
                if len(b):
                    top = b.sort_values([ts, "event_id"]).iloc[-1]
                    new = (int(top[ts].value // 1000), int(top["event_id"]), top["event_type"])
                    best = new if best is None or new[:2] > best[:2] else best
            if best is None:  # no event with a time: nothing to order by
                return
            if before is not None and best[0] != before[0]:
                self.handle.deleteTimer(before[0] // 1000 + idle_ms)
            if before is None or best[0] != before[0]:
                self.handle.registerTimer(best[0] // 1000 + idle_ms)
            self.state.update((best[0], best[1], best[2], n))
            yield pd.DataFrame({entity: [key[0]], "ts": pd.to_datetime([best[0]], unit="us"), "status": [best[2]], "n": [n], "change": ["updated"]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            old = self.state.get()
            if old is not None:
                self.state.clear()
                yield pd.DataFrame({entity: [key[0]], "ts": pd.to_datetime([old[0]], unit="us"), "status": [old[2]], "n": [old[3]], "change": ["idle"]})

        def close(self) -> None:
            pass

    d = events.withWatermark(ts, delay).select(entity, ts, "event_id", "event_type")
    return d.groupBy(entity).transformWithStateInPandas(Status(), f"`{entity}` {kind}, {STATUS}", "Update", "EventTime")


def _versions(spark: SparkSession, path: str) -> tuple[list[int], object]:
    """Numbers of the complete versions in a folder, and its file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return [], fs
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))), fs


def upsert_sink(path: str, key: list[str], stamp: str, keep: int = 3):
    """foreachBatch writer: newest record per key, each version written beside the last complete one.

    Batch numbers play no part: a replayed batch changes nothing, as it is not newer than what it left, and a query that
    starts anew with another checkpoint goes on from the last version.  The latest ``keep`` versions stay, so readers
    of the one before are not disturbed.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        from ..operators.emergence import register

        spark = batch.sparkSession
        done, fs = _versions(spark, path)
        old = spark.read.schema(batch.schema).parquet(f"{path}/v={done[-1]}") if done else batch.limit(0)
        now = done[-1] + 1 if done else 0
        register(old, batch, key, stamp).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={now}")
        for v in done[:max(0, len(done) + 1 - keep)]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)

    return write


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete version of what ``upsert_sink`` wrote; no rows where there is none."""
    done, _ = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={done[-1]}") if done else spark.createDataFrame([], schema)
