"""Structured Streaming variants (K1, K2; extensions, the reference has no streams).

K1  incremental feature ETL: new incident files landing in a folder are
    picked up with ``Trigger.AvailableNow``; each micro-batch is featurised
    and upserted (latest row per incident id) into the feature table.
K2  severe-weather alert counts: observations stream in with an event-time
    watermark, duplicates are dropped within the watermark, and severe
    observations are counted per airport in tumbling one-hour windows.
    Every micro-batch upserts the windows it changed (update mode), so the
    table is complete after a drain; the last windows do not wait for the
    watermark to pass them.

E28 alert episodes: per airport, an alert is raised when the weather risk reaches the upper threshold
    and cleared when it falls below the lower one (arbitrary keyed state); an airport that falls silent
    for ``EXPIRY_HOURS`` of event time loses its state by a timer.

All keep their state and progress in checkpoint folders under the shared
``spark.checkpoint.dir`` so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wingwatch.functions import weather as W
from wingwatch.functions.incident import incident_features
from wingwatch.sources import sinks as S


def incremental_features(spark: SparkSession, landing: str, schema: StructType, table: str,
                         state_root: str, rollups: tuple[S.Rollup, ...] = ()) -> None:
    """K1: drain everything that has landed, upserting features per batch; ``rollups`` follow every batch."""
    stream = spark.readStream.schema(schema).parquet(landing)

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        feats = incident_features(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        # a repeated id is reduced to one row there; only the year partitions this batch touches are rewritten
        S.upsert_table(spark, table, feats, ["id"], ["batch_id"], "year",
                       os.path.join(state_root, f"staging-{batch_id}"), rollups)

    q = (stream.writeStream.foreachBatch(upsert_batch)
         .option("checkpointLocation", os.path.join(state_root, "k1-checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def severe_alert_stream(observations: DataFrame, watermark: str = "1 day",
                        window: str = "1 hour") -> DataFrame:
    """K2: severe-weather counts per airport and window.

    On a stream, duplicates are dropped within the watermark (bounded state);
    on a batch frame (replay, backfill) the same key is deduplicated with
    ``dropDuplicates``.
    """
    # event-time watermarks need a zoned timestamp; the session zone is UTC
    obs = observations.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    obs = obs.dropDuplicatesWithinWatermark(["id"]) if obs.isStreaming else obs.dropDuplicates(["id"])
    kt = W.mps_to_knots(F.col("wind_speed_ms"))
    severe = obs.filter(W.severe_weather_kt(F.col("weather_condition"), kt))
    return (severe.groupBy(F.window("ts", window).alias("w"), "airport_code")
            .agg(F.count(F.lit(1)).alias("severe_observations"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "airport_code", "severe_observations"))


RAISE_AT, CLEAR_BELOW, EXPIRY_HOURS = 60.0, 30.0, 48
EPISODE_SCHEMA = "airport_code string, ts timestamp, event string, risk double"


def _expiry(last) -> pd.Timestamp:
    """Event time at which an airport last seen at ``last`` loses its state (timers count in milliseconds)."""
    return pd.Timestamp(last).floor("ms") + pd.Timedelta(hours=EXPIRY_HOURS)


class AlertEpisodes(StatefulProcessor):
    """State of an airport: whether its alert stands, and the last time seen.  Rows are taken in order of (ts, id);
    rows at or before the last time seen come too late and change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "active boolean, ts timestamp")

    def handleInputRows(self, key, rows, timerValues):
        active, last = self.state.get() if self.state.exists() else (False, None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        frame = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        out = []
        for ts, risk in zip(frame["ts"], frame["risk"]):
            if last is not None and ts < pd.Timestamp(last):
                continue
            if last is not None and ts >= _expiry(last):  # silent for too long, whether a timer has told so or not
                out += [(key[0], _expiry(last), "expired", None)] * bool(active)
                active = False
            if risk >= RAISE_AT and not active:
                active = True
                out.append((key[0], ts, "raised", risk))
            elif risk < CLEAR_BELOW and active:
                active = False
                out.append((key[0], ts, "cleared", risk))
            last = ts
        self.state.update((active, pd.Timestamp(last).to_pydatetime()))
        self.handle.registerTimer(int(_expiry(last).value // 1_000_000))
        yield pd.DataFrame(out, columns=["airport_code", "ts", "event", "risk"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        active, _ = self.state.get() if self.state.exists() else (False, None)
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        self.state.clear()
        rows = [(key[0], at, "expired", None)] if active else []
        yield pd.DataFrame(rows, columns=["airport_code", "ts", "event", "risk"])

    def close(self) -> None:
        pass


def alert_episodes(observations: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """(airport_code, ts, event, risk) of raised, cleared and expired alerts from a stream of weather observations."""
    obs = observations.select("airport_code", F.col("ts").cast("timestamp").alias("ts"), "id", _risk().alias("risk"))
    return (obs.filter("risk IS NOT NULL AND ts IS NOT NULL AND airport_code IS NOT NULL").withWatermark("ts", watermark).groupBy("airport_code")
            .transformWithStateInPandas(AlertEpisodes(), EPISODE_SCHEMA, "Append", "EventTime"))


def _risk():
    return W.weather_risk_kt(F.col("visibility_m"), W.mps_to_knots(F.col("wind_speed_ms")), F.col("weather_condition"), F.col("temperature_c"))


def run_alert_episodes(spark: SparkSession, landing: str, schema: StructType, table: str, state_root: str) -> None:
    """Drains what has landed; events are appended to ``table``.  State is kept in RocksDB, as timers ask for."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = spark.readStream.schema(schema).parquet(landing)
        q = (alert_episodes(src).writeStream.format("parquet").option("path", table).outputMode("append")
             .option("checkpointLocation", os.path.join(state_root, "e28-checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_alert_stream(spark: SparkSession, landing: str, schema: StructType, table: str,
                     state_root: str) -> None:
    """K2 end to end: file source -> watermark/dedup/window -> upsert of changed windows into a
    table partitioned by window date."""
    src = spark.readStream.schema(schema).parquet(landing)

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumns({"batch_id": F.lit(batch_id).cast("bigint"),
                                     "window_date": F.to_date("window_start")})
        S.upsert_table(spark, table, changed, ["window_start", "airport_code"], ["batch_id"], "window_date",
                       os.path.join(state_root, f"k2-staging-{batch_id}"))

    q = (severe_alert_stream(src).writeStream.foreachBatch(upsert_batch).outputMode("update")
         .option("checkpointLocation", os.path.join(state_root, "k2-checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
