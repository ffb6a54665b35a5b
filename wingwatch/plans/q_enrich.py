"""Enrichment, lineage and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.functions import weather as W
from wingwatch.functions.incident import incident_features
from wingwatch.operators import analytics as AN
from wingwatch.operators import dims
from wingwatch.operators import enrich as EN
from wingwatch.operators import rules as RU
from wingwatch.operators import setops as SO
from wingwatch.plans.catalog import query
from wingwatch.plans.q_ingest import _PAYLOAD_SQL
from wingwatch.plans.q_rules import _cond_sql
from wingwatch.functions.rule_table import RULES
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@query("enrich_airport_coords", ("incidents", "airports"), """
WITH ap AS (SELECT icao_code, min(latitude) AS ap_lat, min(longitude) AS ap_lon FROM airports GROUP BY icao_code),
b AS (SELECT id, airport_code, latitude, longitude FROM incidents
      WHERE airport_code IS NOT NULL AND (latitude IS NULL OR longitude IS NULL))
SELECT b.id, b.airport_code, COALESCE(a0.icao_code, a1.icao_code, a2.icao_code) AS matched_code,
  CASE WHEN a0.icao_code IS NOT NULL THEN a0.ap_lat WHEN a1.icao_code IS NOT NULL THEN a1.ap_lat
       WHEN a2.icao_code IS NOT NULL THEN a2.ap_lat ELSE b.latitude END AS latitude,
  CASE WHEN a0.icao_code IS NOT NULL THEN a0.ap_lon WHEN a1.icao_code IS NOT NULL THEN a1.ap_lon
       WHEN a2.icao_code IS NOT NULL THEN a2.ap_lon ELSE b.longitude END AS longitude
FROM b LEFT JOIN ap a0 ON a0.icao_code = b.airport_code
  LEFT JOIN ap a1 ON a1.icao_code = 'K' || b.airport_code
  LEFT JOIN ap a2 ON a2.icao_code = upper(b.airport_code)""")
def enrich_airport_coords(spark, sf_dir):
    t = _t(spark, sf_dir)
    return EN.airport_coords(A.incidents(t), dims.airport_projection(A.airports(t)))


_DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', CAST({r[7]} AS DOUBLE))" for i, r in enumerate(K.AIRCRAFT_TYPES)
) + ") t(ord, make, model, category, risk_factor))"

_MATCH_SQL = f"""{_DIM_SQL},
inc AS (SELECT id, upper(aircraft_make) AS mk, upper(COALESCE(aircraft_model, '')) AS md
        FROM incidents WHERE aircraft_make IS NOT NULL),
pp AS (SELECT p.mk, p.md, count(d.ord) AS match_count, max(d.risk_factor * 100.0) AS max_base_risk,
         arg_min(d.category, d.ord) AS first_category, arg_min(d.risk_factor, d.ord) AS first_risk_factor
       FROM (SELECT DISTINCT mk, md FROM inc) p LEFT JOIN dim d
         ON (substring(p.mk, 1, 4) <> '' AND contains(upper(d.make), substring(p.mk, 1, 4)))
         OR (substring(p.md, 1, 3) <> '' AND contains(upper(d.model), substring(p.md, 1, 3)))
       GROUP BY p.mk, p.md),
m AS (SELECT inc.id, pp.match_count > 0 AS matched, pp.match_count, pp.max_base_risk, pp.first_category,
        pp.first_risk_factor FROM inc JOIN pp ON inc.mk = pp.mk AND inc.md = pp.md)"""


def _matches(spark, sf_dir):
    return EN.aircraft_matches(A.incidents(_t(spark, sf_dir)))


@query("match_aircraft_fuzzy", ("incidents",), f"WITH {_MATCH_SQL}\nSELECT * FROM m")
def match_aircraft_fuzzy(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("aircraft_category", ("incidents",), f"""WITH {_MATCH_SQL}
SELECT first_category AS category, count(*) AS incidents, round(avg(first_risk_factor), 6) AS mean_risk_factor
FROM m WHERE matched GROUP BY first_category""")
def aircraft_category(spark, sf_dir):
    return EN.aircraft_category(_matches(spark, sf_dir))


@query("apply_weather_update", ("incidents", "weather_payloads"), f"""
WITH pf AS (SELECT * FROM ({_PAYLOAD_SQL}) x)
SELECT i.id,
  CASE WHEN pf.id IS NOT NULL THEN (CASE WHEN COALESCE(pf.visibility_m, 10000.0) < 5000 THEN 'IMC' ELSE 'VMC' END)
       ELSE i.weather_conditions END AS weather_conditions,
  CASE WHEN pf.id IS NOT NULL THEN pf.weather_risk_score
       ELSE TRY_CAST(json_extract_string(i.weather_data, '$.weather_risk_score') AS DOUBLE) END AS weather_risk_score,
  pf.id IS NOT NULL AS updated
FROM incidents i LEFT JOIN pf ON i.id = pf.id AND pf.parsed AND i.latitude IS NOT NULL
  AND i.longitude IS NOT NULL AND i.weather_data IS NULL""")
def apply_weather_update(spark, sf_dir):
    t = _t(spark, sf_dir)
    parsed = W.flatten_weather_payload(A.weather_payloads(t))
    upd = EN.apply_weather_update(A.incidents(t), parsed)
    return AN.with_weather_payload(upd).select("id", "weather_conditions",
                                               F.col("wx_risk").alias("weather_risk_score"), "updated")


def _incident_rule_records(spark, sf_dir):
    inc = AN.with_weather_payload(incident_features(A.incidents(_t(spark, sf_dir))))
    return inc.select(F.col("id").cast("string").alias("record_id"),
                      F.col("wx_risk").alias("weather_risk_score"), F.col("wx_visibility").alias("visibility_m"),
                      F.col("wx_wind").alias("wind_speed_kt"), "injury_score", "severity_code")


def _inc_recs_sql() -> str:
    feats = {"weather_risk_score": "wx_risk", "visibility_m": "wx_visibility", "wind_speed_kt": "wx_wind",
             "injury_score": "injury_score", "severity_code": "severity_code"}
    parts = []
    for r in RULES:
        if r["feature"] in feats:
            v = f"CAST({feats[r['feature']]} AS DOUBLE)"
            parts.append(f"SELECT 'P' || CAST(id AS VARCHAR) AS prediction_id FROM incident_wx WHERE {_cond_sql(v, r)}")
    return "\nUNION ALL ".join(parts)


@query("prediction_lineage", ("incident_wx", "scored"), f"""
WITH p AS (SELECT 'P' || CAST(id AS VARCHAR) AS prediction_id, id AS incident_id, y_hat AS risk_score FROM scored),
r AS (SELECT prediction_id, count(*) AS n_recs FROM ({_inc_recs_sql()}) x GROUP BY prediction_id)
SELECT i.severity, count(DISTINCT i.id) AS incidents, count(p.prediction_id) AS predictions,
  CAST(COALESCE(sum(r.n_recs), 0) AS BIGINT) AS recommendations, round(avg(p.risk_score), 6) AS avg_risk_score
FROM incident_wx i JOIN p ON i.id = p.incident_id LEFT JOIN r ON p.prediction_id = r.prediction_id
GROUP BY i.severity""")
def prediction_lineage(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = A.scored(t)
    preds = s.select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("prediction_id"),
                     F.col("id").alias("incident_id"), F.col("y_hat").alias("risk_score"))
    recs = RU.recommendations(_incident_rule_records(spark, sf_dir), key="record_id").select(
        F.concat(F.lit("P"), F.col("record_id")).alias("prediction_id"))
    return EN.prediction_lineage(A.incidents(t), preds, recs)


_WX_KEYS = ["date", "hour", "airport_code"]


@query("dedup_weather", ("weather_conditions",), """
SELECT date, hour, airport_code, id, visibility_m FROM (
  SELECT *, row_number() OVER (PARTITION BY date, hour, airport_code ORDER BY id) AS rn FROM weather_conditions) x
WHERE rn = 1""")
def dedup_weather(spark, sf_dir):
    w = A.weather_conditions(_t(spark, sf_dir)).select(*_WX_KEYS, "id", "visibility_m")
    return SO.dedup_by_key(w, _WX_KEYS, ["id"])


@query("key_violations", ("weather_conditions",), """
SELECT date, hour, airport_code, count(*) AS dup_count, min(id) AS first_id
FROM weather_conditions GROUP BY date, hour, airport_code HAVING count(*) > 1""")
def key_violations(spark, sf_dir):
    return SO.key_violations(A.weather_conditions(_t(spark, sf_dir)), _WX_KEYS, "id")


def prediction_batches(spark, sf_dir):
    """Two prediction batches laid out from ``scored``: every entity on
    2024-01-01, re-scored entities (class disagreement) on 2024-02-01."""
    s = A.scored(_t(spark, sf_dir))
    old = s.select(F.col("id").alias("entity_id"), F.lit("FLIGHT").alias("entity_type"),
                   F.col("y").alias("risk_score"), F.lit("2024-01-01").cast("date").alias("prediction_date"),
                   F.lit(1).alias("batch"))
    new = s.filter(F.col("class_pred") != F.col("class_actual")).select(
        F.col("id").alias("entity_id"), F.lit("FLIGHT").alias("entity_type"), F.col("y_hat").alias("risk_score"),
        F.lit("2024-02-01").cast("date").alias("prediction_date"), F.lit(2).alias("batch"))
    return old, new


@query("upsert_predictions", ("scored",), """
SELECT entity_type, entity_id, risk_score, prediction_date, batch FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY prediction_date DESC, batch DESC) AS rn
  FROM (SELECT id AS entity_id, 'FLIGHT' AS entity_type, y AS risk_score, DATE '2024-01-01' AS prediction_date, 1 AS batch FROM scored
        UNION ALL SELECT id, 'FLIGHT', y_hat, DATE '2024-02-01', 2 FROM scored WHERE class_pred <> class_actual) u) x
WHERE rn = 1""")
def upsert_predictions(spark, sf_dir):
    old, new = prediction_batches(spark, sf_dir)
    return SO.upsert(old, new, ["entity_type", "entity_id"], ["prediction_date", "batch"])
