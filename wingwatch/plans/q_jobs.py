"""Job, sink and streaming queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wingwatch.functions.incident import incident_features
from wingwatch.functions.ops import ops_features
from wingwatch.operators import quality as Q
from wingwatch.operators import rollups as RO
from wingwatch.plans import jobs as J
from wingwatch.plans import q_enrich
from wingwatch.plans.catalog import query
from wingwatch.session import checkpoint_dir
from wingwatch.sources import adapters as A
from wingwatch.sources import sinks as S
from wingwatch.sources.tables import Tables
from wingwatch.plans.oracle_views import pct6
from wingwatch.plans.q_ingest import _KT, _KT_RISK
from wingwatch.streaming import incremental as K

INC_AS_OF = "2001-07-01"
OPS_AS_OF = "2001-11-04"
INCIDENT_FEATURE_COLUMNS = 36
OPS_FEATURE_COLUMNS = 18


def _run_root(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


_ETL_SQL = f"""
src AS (SELECT string_agg(source || ':' || CAST(n AS VARCHAR), ',' ORDER BY source || ':' || CAST(n AS VARCHAR)) AS by_source
             FROM (SELECT source, count(*) AS n FROM incident_features WHERE source IS NOT NULL GROUP BY source) g),
sev AS (SELECT string_agg(severity || ':' || CAST(n AS VARCHAR), ',' ORDER BY severity || ':' || CAST(n AS VARCHAR)) AS by_severity
        FROM (SELECT severity, count(*) AS n FROM incident_features WHERE severity IS NOT NULL GROUP BY severity) g)
SELECT (SELECT count(*) FROM incident_features) AS incident_records, {INCIDENT_FEATURE_COLUMNS} AS incident_features_created,
  (SELECT round(overall_score, 6) FROM dq) AS quality_score, src.by_source, sev.by_severity,
  (SELECT count(*) FROM operational_data) AS operational_records, {OPS_FEATURE_COLUMNS} AS operational_features_created,
  'SUCCESS' AS status
FROM src, sev"""


@query("etl_summary")
def etl_summary(spark, sf_dir):
    """E14 over the full tables (the J2 script run)."""
    t = Tables(spark, sf_dir)
    inc = A.incidents(t, geo=True)
    return J.etl_summary(incident_features(inc), ops_features(A.operational_data(t)),
                         Q.validate_incidents(inc, INC_AS_OF))


@query("daily_etl_job")
def daily_etl_job(spark, sf_dir):
    """Trailing windows (365 / 90 days) -> DQ -> features -> store -> summary."""
    return J.daily_etl(spark, Tables(spark, sf_dir), _run_root(spark, "daily-etl"), INC_AS_OF, OPS_AS_OF)


@query("full_etl_job")
def full_etl_job(spark, sf_dir):
    """The same job over the full tables."""
    return J.daily_etl(spark, Tables(spark, sf_dir), _run_root(spark, "full-etl"), INC_AS_OF, OPS_AS_OF,
                       incident_days_back=None, operational_days_back=None)


@query("recommendation_run_job")
def recommendation_run_job(spark, sf_dir):
    """Top-10 -> rules -> JSON/CSV exports -> priority summary."""
    return J.recommendation_run(spark, Tables(spark, sf_dir), _run_root(spark, "recs"))


@query("weather_enrichment_job")
def weather_enrichment_job(spark, sf_dir):
    """Payloads -> incident update -> rewritten incident table."""
    return J.weather_enrichment(spark, Tables(spark, sf_dir), _run_root(spark, "weather"))


@query("training_frames_job")
def training_frames_job(spark, sf_dir):
    """The three training frames; returns the monthly aggregate."""
    t = Tables(spark, sf_dir)
    _, _, monthly = J.training_frames(A.incidents(t, geo=True), A.operational_data(t))
    return monthly


@query("sink_roundtrip", ("incidents",), "SELECT source, count(*) AS count FROM incidents GROUP BY source")
def sink_roundtrip(spark, sf_dir):
    """Replace-mode write of the incident table, read back, counted."""
    path = _run_root(spark, "sink")
    S.write_table(A.incidents(Tables(spark, sf_dir), geo=True), path, "replace")
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("count"))


@query("feature_store_roundtrip", ("incidents",), """
SELECT id, severity, 'incident_features' AS feature_set_name, DATE '2001-07-01' AS run_date
FROM incidents WHERE severity = 'FATAL'""")
def feature_store_roundtrip(spark, sf_dir):
    """A15 + A16: two runs of a feature set; loading returns the latest run."""
    root = _run_root(spark, "store")
    feats = incident_features(A.incidents(Tables(spark, sf_dir), geo=True))
    S.save_features(feats, root, "incident_features", "2001-06-30", "2001-06-30 00:00:00")
    S.save_features(feats.filter(F.col("severity") == "FATAL"), root, "incident_features", "2001-07-01",
                    "2001-07-01 00:00:00")
    return S.load_features(spark, root, "incident_features").select("id", "severity", "feature_set_name", "run_date")


@query("feature_store_list", ("incidents", "operational_data"), """
SELECT 'incident_features' AS feature_set_name, DATE '2001-07-01' AS run_date, count(*) AS records FROM incidents
UNION ALL SELECT 'operational_features', DATE '2001-07-01', count(*) FROM operational_data""")
def feature_store_list(spark, sf_dir):
    """Feature sets and runs present in the store."""
    root = _run_root(spark, "store")
    t = Tables(spark, sf_dir)
    S.save_features(incident_features(A.incidents(t, geo=True)), root, "incident_features", "2001-07-01",
                    "2001-07-01 00:00:00")
    S.save_features(ops_features(A.operational_data(t)), root, "operational_features", "2001-07-01",
                    "2001-07-01 00:00:00")
    return S.list_feature_sets(spark, root)


@query("stream_incremental_etl", ("incidents",), """
SELECT id, CASE WHEN id % 50 = 0 THEN 'MINOR' ELSE severity END AS severity,
  CASE WHEN id % 100 = 0 THEN NULL ELSE CAST(year(incident_date) AS INTEGER) END AS year,
  CAST(CASE WHEN id % 10 = 7 OR id % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch_id
FROM incidents""")
def stream_incremental_etl(spark, sf_dir):
    """K1: incidents land and are drained; then new ones land with corrections of old ones (another
    severity; some lose their date and so move to the NULL partition) and are drained again."""
    root = _run_root(spark, "k1")
    inc = A.incidents(Tables(spark, sf_dir))
    landing, table = os.path.join(root, "landing"), os.path.join(root, "features")
    late = F.col("id") % 10 == 7
    inc.filter(~late).write.mode("append").parquet(landing)
    K.incremental_features(spark, landing, inc.schema, table, root)
    corrected = inc.filter(F.col("id") % 50 == 0).withColumns({
        "severity": F.lit("MINOR"), "incident_date": F.when(F.col("id") % 100 != 0, F.col("incident_date"))})
    inc.filter(late).unionByName(corrected).write.mode("append").parquet(landing)
    K.incremental_features(spark, landing, inc.schema, table, root)
    return spark.read.parquet(table).select("id", "severity", "year", "batch_id")


# ---- served aggregates: the rollup that K1 keeps, after two drains with corrections -------------

_CORRECTED_SQL = """c AS (SELECT source, CASE WHEN id % 50 = 0 THEN 'MINOR' ELSE severity END AS severity,
  CASE WHEN id % 100 = 0 THEN NULL ELSE incident_date END AS incident_date, injury_score,
  CASE WHEN id % 50 = 0 THEN 0 ELSE is_serious END AS is_serious, weather_risk FROM incident_features)"""


def _drained_rollup(spark, sf_dir):
    """Incidents land and are drained, then new ones and corrections of old ones; returns the rollup."""
    root = _run_root(spark, "k1-rollup")
    inc = A.incidents(Tables(spark, sf_dir))
    landing, table = os.path.join(root, "landing"), os.path.join(root, "features")
    rollup = RO.incident_rollup(os.path.join(root, "rollup"))
    late = F.col("id") % 10 == 7
    corrected = inc.filter(F.col("id") % 50 == 0).withColumns({
        "severity": F.lit("MINOR"), "incident_date": F.when(F.col("id") % 100 != 0, F.col("incident_date"))})
    for rows in (inc.filter(~late), inc.filter(late).unionByName(corrected)):
        rows.write.mode("append").parquet(landing)
        K.incremental_features(spark, landing, inc.schema, table, root, (rollup,))
    return spark.read.parquet(rollup.path)


@query("rollup_dashboard", ("incident_features",), f"""WITH {_CORRECTED_SQL}
SELECT count(*) AS total, count_if(severity = 'FATAL') AS fatal, count_if(severity = 'SERIOUS') AS serious,
  count_if(severity = 'MINOR') AS minor, count_if(severity = 'NONE') AS none_count, count_if(source = 'NTSB') AS ntsb,
  count_if(source = 'ASRS') AS asrs, round({pct6("count_if(severity = 'FATAL')", "count(*)")}, 6) AS fatal_rate,
  round(avg(injury_score), 6) AS avg_injury_score FROM c""")
def rollup_dashboard(spark, sf_dir):
    """E2 from the maintained rollup."""
    return RO.dashboard_summary(_drained_rollup(spark, sf_dir))


@query("rollup_monthly_trend", ("incident_features",), f"""WITH {_CORRECTED_SQL}
SELECT strftime(incident_date, '%Y-%m') AS period, count(*) AS count, count_if(severity = 'FATAL') AS fatal_count
FROM c WHERE incident_date >= CAST(DATE '{INC_AS_OF}' - INTERVAL 24 MONTH AS TIMESTAMP) GROUP BY 1 ORDER BY period DESC LIMIT 24""")
def rollup_monthly_trend(spark, sf_dir):
    """E4 from the maintained rollup."""
    return RO.monthly_trend(_drained_rollup(spark, sf_dir), INC_AS_OF)


@query("rollup_kpis", ("incident_features",), f"""WITH {_CORRECTED_SQL}
SELECT count(*) AS total_incidents, count_if(severity = 'FATAL') AS fatal_incidents,
  round({pct6("count_if(severity = 'FATAL')", "count(*)")}, 6) AS fatal_rate_percent,
  round({pct6("count_if(severity = 'NONE')", "count(*)")}, 6) AS no_injury_rate_percent,
  CAST(sum(is_serious) AS BIGINT) AS serious_incidents, round(avg(weather_risk), 6) AS avg_weather_risk FROM c""")
def rollup_kpis(spark, sf_dir):
    """E7 (incidents) from the maintained rollup."""
    return RO.incident_kpis(_drained_rollup(spark, sf_dir))


@query("rollup_counts", ("incident_features",), f"""WITH {_CORRECTED_SQL}
SELECT 'source' AS dimension, source AS value, count(*) AS count FROM c GROUP BY source
UNION ALL SELECT 'severity', severity, count(*) FROM c GROUP BY severity""")
def rollup_counts(spark, sf_dir):
    """E9 from the maintained rollup."""
    r = _drained_rollup(spark, sf_dir)
    parts = [RO.value_counts(r, k).select(F.lit(k).alias("dimension"), F.col(k).alias("value"), "count") for k in ("source", "severity")]
    return parts[0].unionByName(parts[1])


_EPISODE_SQL = f"""
WITH w AS (SELECT w.airport_code, CAST(e.ts AS TIMESTAMP) AS ts, w.id, CAST({_KT_RISK} AS DOUBLE) AS risk
  FROM weather_conditions w JOIN events e ON w.id = e.event_id),
x AS (SELECT *, lag(ts) OVER (PARTITION BY airport_code ORDER BY ts, id) AS prev FROM w WHERE risk IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= date_trunc('millisecond', prev) + INTERVAL {K.EXPIRY_HOURS} HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY airport_code ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS episode FROM x),
a AS (SELECT *, COALESCE(last_value(CASE WHEN risk >= {K.RAISE_AT} THEN 1 WHEN risk < {K.CLEAR_BELOW} THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY airport_code, episode ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 0) AS act FROM s),
b AS (SELECT *, lag(act, 1, 0) OVER (PARTITION BY airport_code, episode ORDER BY ts, id) AS before,
  row_number() OVER (PARTITION BY airport_code, episode ORDER BY ts DESC, id DESC) AS back FROM a)
SELECT airport_code, ts, CASE WHEN act = 1 THEN 'raised' ELSE 'cleared' END AS event, risk FROM b WHERE act <> before
UNION ALL
SELECT airport_code, date_trunc('millisecond', ts) + INTERVAL {K.EXPIRY_HOURS} HOUR, 'expired', NULL FROM b
WHERE back = 1 AND act = 1 AND date_trunc('millisecond', ts) + INTERVAL {K.EXPIRY_HOURS} HOUR <= (SELECT max(ts) FROM w)"""


@query("stream_alert_episodes", ("weather_conditions",), _EPISODE_SQL)
def stream_alert_episodes(spark, sf_dir):
    """E28 as a stream: two drains, the later half of the observations in the second; equals a batch replay."""
    root = _run_root(spark, "e28")
    t = Tables(spark, sf_dir)
    obs = A.weather_conditions(t).join(
        t.read("events", ["event_id", "ts"]), F.col("id") == F.col("event_id")).drop("event_id")
    landing, table = os.path.join(root, "landing"), os.path.join(root, "episodes")
    ends = obs.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle = F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2)
    for rows in (obs.filter(F.col("ts") < middle), obs.filter(F.col("ts") >= middle)):
        rows.write.mode("append").parquet(landing)
        K.run_alert_episodes(spark, landing, obs.schema, table, root)
    return spark.read.schema(K.EPISODE_SCHEMA).parquet(table).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_ALERT_SQL = f"""
SELECT date_trunc('hour', CAST(e.ts AS TIMESTAMP)) AS window_start,
  date_trunc('hour', CAST(e.ts AS TIMESTAMP)) + INTERVAL 1 HOUR AS window_end, w.airport_code, count(*) AS severe_observations
FROM weather_conditions w JOIN events e ON w.id = e.event_id
WHERE COALESCE(w.weather_condition IN ('Thunderstorm', 'Tornado'), FALSE) OR COALESCE({_KT} > 25, FALSE)
GROUP BY 1, 2, 3"""


@query("stream_alert_counts", ("weather_conditions",), _ALERT_SQL)
def stream_alert_counts(spark, sf_dir):
    """K2: watermarked, deduplicated hourly severe-weather counts, all windows."""
    root = _run_root(spark, "k2")
    t = Tables(spark, sf_dir)
    obs = A.weather_conditions(t).join(
        t.read("events", ["event_id", "ts"]), F.col("id") == F.col("event_id")).drop("event_id")
    landing = os.path.join(root, "landing")
    obs.write.mode("append").parquet(landing)
    table = os.path.join(root, "alerts")
    K.run_alert_stream(spark, landing, obs.schema, table, root)
    return spark.read.parquet(table).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "airport_code", "severe_observations")


# oracle: the DQ score CTEs of q_quality, then the summary
from wingwatch.plans.catalog import ORACLE  # noqa: E402
from wingwatch.plans.oracle_views import with_views  # noqa: E402
from wingwatch.plans.q_quality import _INC_SCORES, _INC_SQL  # noqa: E402

ORACLE["etl_summary"] = (
    with_views("incidents", "incident_features", "operational_data").rstrip() + "\n" + _INC_SQL + _INC_SCORES
    + """, dq AS (SELECT completeness_score * 0.3 + consistency_score * 0.4 + accuracy_score * 0.3 AS overall_score
    FROM s),""" + _ETL_SQL)
# the full-table run returns the same summary row
ORACLE["full_etl_job"] = ORACLE["etl_summary"]
# the daily run sees a trailing window of both tables
ORACLE["daily_etl_job"] = (
    with_views("incidents", "incident_features", "operational_data", only={
        "incidents": f"incident_date >= CAST(DATE '{INC_AS_OF}' - INTERVAL 365 DAY AS TIMESTAMP)",
        "operational_data": f"date >= DATE '{OPS_AS_OF}' - INTERVAL 90 DAY"}).rstrip() + "\n" + _INC_SQL + _INC_SCORES
    + """, dq AS (SELECT completeness_score * 0.3 + consistency_score * 0.4 + accuracy_score * 0.3 AS overall_score
    FROM s),""" + _ETL_SQL)
# the jobs return what these queries state
from wingwatch.plans import q_enrich, q_features, q_rules  # noqa: E402, F401

ORACLE["training_frames_job"] = ORACLE["monthly_incident_profile"]
ORACLE["recommendation_run_job"] = ORACLE["recommendation_summary"]
ORACLE["weather_enrichment_job"] = f"SELECT updated, count(*) AS incidents FROM ({ORACLE['apply_weather_update']}) u GROUP BY updated"


@query("aircraft_types_use", ("incidents",), f"""WITH {q_enrich._MATCH_SQL}
SELECT d.make, d.model, d.category, d.risk_factor * 100.0 AS base_risk_score, count(m.id) AS incidents
FROM dim d LEFT JOIN m ON m.matched AND m.first_category = d.category AND m.first_risk_factor = d.risk_factor
GROUP BY d.ord, d.make, d.model, d.category, d.risk_factor""")
def aircraft_types_use(spark, sf_dir):
    """A19 + A10: the aircraft types are written as CSV and scanned back; each with the incidents whose first match has
    its category and risk factor."""
    from wingwatch.operators import dims
    from wingwatch.operators import enrich as EN

    path = _run_root(spark, "aircraft-csv")
    S.export_records(dims.aircraft_types(spark).drop("base_risk_score"), path, "csv")
    types = dims.read_dimension_csv(spark, path, dims.AIRCRAFT_SCHEMA)
    used = (EN.aircraft_matches(A.incidents(Tables(spark, sf_dir))).filter("matched")
            .groupBy(F.col("first_category").alias("category"), F.col("first_risk_factor").alias("risk_factor")).agg(F.count(F.lit(1)).alias("n")))
    return types.join(used, ["category", "risk_factor"], "left").select(
        "make", "model", "category", (F.col("risk_factor") * 100.0).alias("base_risk_score"), F.coalesce("n", F.lit(0)).alias("incidents"))


@query("scan_airport_csv", ("airports",), "SELECT * FROM airports")
def scan_airport_csv(spark, sf_dir):
    """A19 + A10: the airport list is written as CSV, scanned back with an
    explicit schema (no inference pass) and projected (B1, B2, C29)."""
    from wingwatch.operators import dims

    path = _run_root(spark, "airports-csv")
    A.airports(Tables(spark, sf_dir)).write.option("header", True).csv(path)
    raw = dims.read_dimension_csv(spark, path, dims.AIRPORT_CSV_SCHEMA)
    return dims.airport_projection(raw)
