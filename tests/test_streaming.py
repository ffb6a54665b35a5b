"""Structured Streaming extensions (K1, K2) on the smallest tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables


def test_incremental_features_upsert(spark, catalog):
    """Two drains; the values are checked against the oracle in test_oracle."""
    queries, _ = catalog
    out = queries["stream_incremental_etl"](spark, SF_SMALL)
    inc = A.incidents(Tables(spark, SF_SMALL))
    assert out.count() == inc.count() == out.select("id").distinct().count()
    assert {r["batch_id"] for r in out.select("batch_id").distinct().collect()} == {0, 1}


def test_all_alert_windows(spark, catalog):
    """The drained table equals a batch recount, the last windows included."""
    from wingwatch.streaming.incremental import severe_alert_stream

    queries, _ = catalog
    out = queries["stream_alert_counts"](spark, SF_SMALL).collect()
    t = Tables(spark, SF_SMALL)
    obs = A.weather_conditions(t).join(t.read("events", ["event_id", "ts"]), F.col("id") == F.col("event_id"))
    batch = {(r["window_start"], r["airport_code"]): r["severe_observations"] for r in severe_alert_stream(obs).collect()}
    assert {(r["window_start"], r["airport_code"]): r["severe_observations"] for r in out} == batch
