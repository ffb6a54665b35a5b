"""Weather, ingest and risk-label queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wingwatch.functions import ops as OPS
from wingwatch.functions import risk as R
from wingwatch.functions import text as T
from wingwatch.functions import weather as W
from wingwatch.functions.ops import ops_features
from wingwatch.operators import analytics as AN
from wingwatch.operators import ingest as IN
from wingwatch.plans.catalog import query
from wingwatch.session import checkpoint_dir
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _wx(spark, sf_dir):
    return A.weather_conditions(_t(spark, sf_dir))


def _ladder_sql(expr: str, steps, below: bool) -> str:
    op = "<" if below else ">"
    parts = " ".join(f"WHEN {expr} {op} {b} THEN {float(p)}" for b, p in steps)
    return f"COALESCE(CASE {parts} ELSE 0.0 END, 0.0)"


def _map_sql(expr: str, mapping: dict, default) -> str:
    parts = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in mapping.items())
    return f"CASE {expr} {parts} ELSE {float(default)} END"


from wingwatch.functions import constants as K  # noqa: E402

_SI_RISK = f"""least(
  CASE WHEN COALESCE(visibility_m <> 0, FALSE) THEN {_ladder_sql('visibility_m', K.SI_VISIBILITY_STEPS, True)} ELSE 0.0 END
  + {_ladder_sql('greatest(COALESCE(wind_speed_ms, 0.0), COALESCE(wind_gust_ms, 0.0))', K.SI_WIND_STEPS, False)}
  + {_map_sql("COALESCE(weather_condition, 'Clear')", K.SI_CONDITION_RISK, K.SI_CONDITION_DEFAULT)}
  + CASE WHEN COALESCE(temperature_c, 20.0) = 0 THEN 0.0
         WHEN COALESCE(temperature_c, 20.0) < -10 OR COALESCE(temperature_c, 20.0) > 40 THEN 15.0
         WHEN COALESCE(temperature_c, 20.0) < 0 OR COALESCE(temperature_c, 20.0) > 35 THEN 10.0
         WHEN COALESCE(temperature_c, 20.0) < 5 OR COALESCE(temperature_c, 20.0) > 30 THEN 5.0 ELSE 0.0 END,
  100.0)"""

_KT = "(CASE WHEN COALESCE(wind_speed_ms <> 0, FALSE) THEN wind_speed_ms * 1.94384 ELSE 0.0 END)"
_KT_RISK = f"""least(
  {_ladder_sql('visibility_m', K.KT_VISIBILITY_STEPS, True)}
  + {_ladder_sql(_KT, K.KT_WIND_STEPS, False)}
  + {_map_sql('weather_condition', K.KT_CONDITION_RISK, K.KT_CONDITION_DEFAULT)}
  + COALESCE(CASE WHEN temperature_c < -10 OR temperature_c > 40 THEN 15.0
         WHEN temperature_c < 0 OR temperature_c > 35 THEN 10.0 WHEN temperature_c < 5 THEN 5.0 END, 0.0),
  100.0)"""


# ---- C20-C25 weather ----------------------------------------------------------

@query("weather_risk_si", ("weather_conditions",),
       f"SELECT id, CAST({_SI_RISK} AS DOUBLE) AS weather_risk_score FROM weather_conditions")
def weather_risk_si(spark, sf_dir):
    w = _wx(spark, sf_dir)
    return w.select("id", W.weather_risk_si(F.col("visibility_m"), F.col("wind_speed_ms"),
                                            F.col("wind_gust_ms"), F.col("weather_condition"),
                                            F.col("temperature_c")).alias("weather_risk_score"))


@query("latitude_temperature", ("incidents",), """
SELECT id, round(CASE WHEN COALESCE(latitude <> 0, FALSE) THEN t - (abs(latitude) - 40) / 50.0 * 5.0 ELSE t END, 6) AS temperature_c
FROM (SELECT id, latitude, CAST(20 - 2 * abs(COALESCE(month(incident_date), 6) - 7) AS DOUBLE) AS t FROM incidents) x""")
def latitude_temperature(spark, sf_dir):
    """A seasonal temperature (warmest in July; June where the date is unknown) corrected for latitude, per incident."""
    season = (20 - 2 * F.abs(F.coalesce(F.month("incident_date"), F.lit(6)) - 7)).cast("double")
    inc = A.incidents(_t(spark, sf_dir))
    return inc.select("id", F.round(W.latitude_temperature(season, F.col("latitude")), 6).alias("temperature_c"))


@query("weather_risk_kt", ("weather_conditions",),
       f"SELECT id, round({_KT}, 6) AS wind_speed_kt, CAST({_KT_RISK} AS DOUBLE) AS weather_risk_score "
       "FROM weather_conditions")
def weather_risk_kt(spark, sf_dir):
    w = _wx(spark, sf_dir).withColumn("wind_speed_kt", W.mps_to_knots(F.col("wind_speed_ms")))
    return w.select("id", F.round("wind_speed_kt", 6).alias("wind_speed_kt"),
                    W.weather_risk_kt(F.col("visibility_m"), F.col("wind_speed_kt"),
                                      F.col("weather_condition"), F.col("temperature_c"))
                    .alias("weather_risk_score"))


@query("severe_weather", ("weather_conditions",), f"""
SELECT id,
  COALESCE(weather_condition IN ('Thunderstorm', 'Tornado', 'Squall', 'Hurricane'), FALSE)
    OR COALESCE(wind_speed_ms, 0.0) > 12.9
    OR (COALESCE(visibility_m <> 0, FALSE) AND COALESCE(visibility_m < 1000, FALSE)) AS severe_si,
  COALESCE(weather_condition IN ('Thunderstorm', 'Tornado'), FALSE) OR COALESCE({_KT} > 25, FALSE) AS severe_kt
FROM weather_conditions""")
def severe_weather(spark, sf_dir):
    w = _wx(spark, sf_dir)
    return w.select("id",
                    W.severe_weather_si(F.col("weather_condition"), F.col("wind_speed_ms"),
                                        F.col("visibility_m")).alias("severe_si"),
                    W.severe_weather_kt(F.col("weather_condition"),
                                        W.mps_to_knots(F.col("wind_speed_ms"))).alias("severe_kt"))


@query("flight_category", ("weather_conditions",), """
SELECT id, CASE WHEN COALESCE(visibility_m, 10000.0) < 5000 THEN 'IMC' ELSE 'VMC' END AS category_si,
  CASE WHEN COALESCE(visibility_m < 5000, FALSE) OR COALESCE(cloud_cover_percent > 80, FALSE)
       THEN 'IMC' ELSE 'VMC' END AS category_kt
FROM weather_conditions""")
def flight_category(spark, sf_dir):
    w = _wx(spark, sf_dir)
    return w.select("id", W.flight_category_si(F.col("visibility_m")).alias("category_si"),
                    W.flight_category_kt(F.col("visibility_m"), F.col("cloud_cover_percent"))
                    .alias("category_kt"))


@query("weather_units", ("weather_conditions",), f"""
SELECT id, round({_KT}, 6) AS wind_speed_kt,
  CASE WHEN COALESCE(wind_gust_ms <> 0, FALSE) THEN round(wind_gust_ms * 1.94384, 6) END AS wind_gust_kt,
  CAST(round(CAST(format('{{}}', temperature_c - {_KT} * 0.3) AS DECIMAL(38, 20)), 1) AS DOUBLE) AS feels_like_c
FROM weather_conditions""")
def weather_units(spark, sf_dir):
    w = _wx(spark, sf_dir)
    kt = W.mps_to_knots(F.col("wind_speed_ms"))
    gust = F.when(F.coalesce(F.col("wind_gust_ms") != 0, F.lit(False)),
                  F.round(F.col("wind_gust_ms") * K.MPS_TO_KNOTS, 6))
    return w.select("id", F.round(kt, 6).alias("wind_speed_kt"), gust.alias("wind_gust_kt"),
                    W.feels_like(F.col("temperature_c"), kt).alias("feels_like_c"))


@query("hour_profile", ("weather_conditions",), f"""
SELECT hour, count(*) AS observations, round(avg({_KT_RISK}), 6) AS avg_risk
FROM weather_conditions GROUP BY hour""")
def hour_profile(spark, sf_dir):
    w = _wx(spark, sf_dir)
    w = w.withColumn("ts", F.make_timestamp_ntz(F.year("date"), F.month("date"), F.dayofmonth("date"),
                                                F.col("hour"), F.lit(0), F.lit(0)))
    w = w.withColumn("risk", W.weather_risk_kt(F.col("visibility_m"), W.mps_to_knots(F.col("wind_speed_ms")),
                                               F.col("weather_condition"), F.col("temperature_c")))
    return AN.hour_profile(w, "ts", "risk")


# ---- A11 payload flattening ---------------------------------------------------

def _js(path: str) -> str:
    return f"TRY_CAST(json_extract_string(payload, '{path}') AS DOUBLE)"


_PAYLOAD_SQL = f"""
WITH p AS (
  SELECT id, payload,
    json_extract(payload, '$.data') IS NOT NULL AS hist,
    (json_extract(payload, '$.main') IS NULL AND json_extract(payload, '$.current') IS NULL
     AND json_extract(payload, '$.wind') IS NULL AND json_extract(payload, '$.clouds') IS NULL
     AND json_extract(payload, '$.weather') IS NULL AND json_extract(payload, '$.visibility') IS NULL
     AND json_extract(payload, '$.data') IS NULL) AS empty
  FROM weather_payloads),
f AS (
  SELECT id, empty, payload,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].feels_like')} ELSE COALESCE({_js('$.main.feels_like')}, {_js('$.current.feels_like')}) END AS feels,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].pressure')} ELSE COALESCE({_js('$.main.pressure')}, {_js('$.current.pressure')}) END AS pressure,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].deg')} ELSE {_js('$.wind.deg')} END AS deg,
    CASE WHEN empty THEN NULL WHEN hist THEN COALESCE(json_extract_string(payload, '$.data[0].weather[0].description'), '')
         ELSE COALESCE(json_extract_string(payload, '$.weather[0].description'), '') END AS descr,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].temp')} ELSE COALESCE({_js('$.main.temp')}, {_js('$.current.temp')}) END AS temp,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].humidity')} ELSE COALESCE({_js('$.main.humidity')}, {_js('$.current.humidity')}) END AS humidity,
    CASE WHEN empty THEN NULL WHEN hist THEN COALESCE({_js('$.visibility')}, {_js('$.data[0].visibility')}, 10000.0)
         ELSE COALESCE({_js('$.visibility')}, {_js('$.main.visibility')}, {_js('$.current.visibility')}, 10000.0) END AS vis,
    CASE WHEN empty THEN NULL WHEN hist THEN COALESCE({_js('$.data[0].all')}, {_js('$.data[0].clouds')})
         ELSE COALESCE({_js('$.clouds.all')}, {_js('$.main.clouds')}, {_js('$.current.clouds')}) END AS clouds,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].speed')} ELSE {_js('$.wind.speed')} END AS speed,
    CASE WHEN empty THEN NULL WHEN hist THEN {_js('$.data[0].gust')} ELSE {_js('$.wind.gust')} END AS gust,
    CASE WHEN empty THEN NULL WHEN hist THEN json_extract_string(payload, '$.data[0].weather[0].main')
         ELSE json_extract_string(payload, '$.weather[0].main') END AS cond
  FROM p)
SELECT id, NOT empty AS parsed, feels AS feels_like_c, pressure AS pressure_hpa, deg AS wind_direction_deg,
  descr AS weather_description, CASE WHEN NOT empty THEN payload END AS raw_data, temp AS temperature_c, humidity AS humidity_percent, vis AS visibility_m,
  clouds AS cloud_cover_percent,
  CASE WHEN empty THEN NULL WHEN COALESCE(speed <> 0, FALSE) THEN round(speed * 1.94384, 6) ELSE 0.0 END AS wind_speed_kt,
  CASE WHEN COALESCE(gust <> 0, FALSE) THEN round(gust * 1.94384, 6) END AS wind_gust_kt,
  CASE WHEN empty THEN NULL ELSE COALESCE(cond, 'Unknown') END AS weather_condition,
  CASE WHEN empty THEN NULL ELSE COALESCE(cond IN ('Thunderstorm', 'Tornado', 'Squall', 'Hurricane'), FALSE)
    OR COALESCE(speed, 0.0) > 12.9 OR (COALESCE(vis <> 0, FALSE) AND COALESCE(vis < 1000, FALSE)) END AS severe_weather_flag,
  CASE WHEN empty THEN NULL ELSE CAST(least(
    CASE WHEN COALESCE(vis <> 0, FALSE) THEN {_ladder_sql('vis', K.SI_VISIBILITY_STEPS, True)} ELSE 0.0 END
    + {_ladder_sql('greatest(COALESCE(speed, 0.0), COALESCE(gust, 0.0))', K.SI_WIND_STEPS, False)}
    + {_map_sql("COALESCE(cond, 'Clear')", K.SI_CONDITION_RISK, K.SI_CONDITION_DEFAULT)}
    + CASE WHEN COALESCE(temp, 20.0) = 0 THEN 0.0
           WHEN COALESCE(temp, 20.0) < -10 OR COALESCE(temp, 20.0) > 40 THEN 15.0
           WHEN COALESCE(temp, 20.0) < 0 OR COALESCE(temp, 20.0) > 35 THEN 10.0
           WHEN COALESCE(temp, 20.0) < 5 OR COALESCE(temp, 20.0) > 30 THEN 5.0 ELSE 0.0 END, 100.0) AS DOUBLE) END
    AS weather_risk_score,
  CASE WHEN empty THEN NULL WHEN vis < 5000 THEN 'IMC' ELSE 'VMC' END AS flight_conditions
FROM f"""


def _payload_frame(spark, sf_dir):
    out = W.flatten_weather_payload(A.weather_payloads(_t(spark, sf_dir)))
    return out.withColumns({"wind_speed_kt": F.round("wind_speed_kt", 6),
                            "wind_gust_kt": F.round("wind_gust_kt", 6)})


@query("weather_json_flatten", ("weather_payloads",), _PAYLOAD_SQL)
def weather_json_flatten(spark, sf_dir):
    return _payload_frame(spark, sf_dir)


# ---- C11-C14 accident events ------------------------------------------------------

def _int_sql(c: str) -> str:
    return (f"CAST(COALESCE(CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN TRY_CAST(trim({c}) AS BIGINT) END, 0) AS INTEGER)")


def _json_field(name: str, value: str, text: bool) -> str:
    told = f"to_json({value})::VARCHAR" if text else f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NOT NULL THEN '\"{name}\":' || {told} END"


_TEXT_WEATHER = {"sky_cond_ceil", "light_cond"}
_WEATHER_JSON_SQL = ("CASE WHEN COALESCE(" + ", ".join(f"CAST({src} AS VARCHAR)" for src, _ in IN.ACCIDENT_WEATHER_FIELDS) + ") IS NOT NULL "
                     "THEN '{' || concat_ws(',', " + ", ".join(_json_field(dst, src, src in _TEXT_WEATHER) for src, dst in IN.ACCIDENT_WEATHER_FIELDS)
                     + ") || '}' END")
_RAW_JSON_SQL = "CAST(json_object(" + ", ".join(f"'{c}', {c}" for c in IN.RAW_DATA_FIELDS) + ") AS VARCHAR)"

_NTSB_SQL = f"""
SELECT 'NTSB' AS source, ev_id AS external_id, TRY_CAST(ev_date AS TIMESTAMP) AS incident_date,
  NULLIF(concat_ws(', ', ev_city, ev_state), '') AS location, ev_nr_apt_id AS airport_code,
  COALESCE(ev_country, 'USA') AS country,
  TRY_CAST(trim(dec_latitude) AS DOUBLE) AS latitude, TRY_CAST(trim(dec_longitude) AS DOUBLE) AS longitude,
  CASE phase_flt_spec WHEN 'TAXI' THEN 'TAXI' WHEN 'TKOF' THEN 'TAKEOFF' WHEN 'CLIMB' THEN 'CLIMB'
    WHEN 'CRUISE' THEN 'CRUISE' WHEN 'DESCEND' THEN 'DESCENT' WHEN 'DESCENT' THEN 'DESCENT'
    WHEN 'APPR' THEN 'APPROACH' WHEN 'APPROACH' THEN 'APPROACH' WHEN 'LDG' THEN 'LANDING'
    WHEN 'LANDING' THEN 'LANDING' WHEN 'MANEUVERING' THEN 'CRUISE' WHEN 'STANDING' THEN 'PREFLIGHT'
    WHEN 'OTHER' THEN 'UNKNOWN' ELSE 'UNKNOWN' END AS phase_of_flight,
  CASE ev_highest_injury WHEN 'FATL' THEN 'FATAL' WHEN 'SERS' THEN 'SERIOUS' WHEN 'MINR' THEN 'MINOR'
    WHEN 'NONE' THEN 'NONE' ELSE 'NONE' END AS severity,
  {_int_sql('inj_tot_f')} AS injuries_fatal, {_int_sql('inj_tot_s')} AS injuries_serious,
  {_int_sql('inj_tot_m')} AS injuries_minor, {_int_sql('inj_tot_n')} AS injuries_uninjured,
  wx_cond_basic AS weather_conditions, {_WEATHER_JSON_SQL} AS weather_data, ev_type AS event_type, {_RAW_JSON_SQL} AS raw_data
FROM raw_events"""


@query("ntsb_normalize", ("raw_events",), _NTSB_SQL)
def ntsb_normalize(spark, sf_dir):
    """C11-C14: whole incident rows, weather and raw payloads included."""
    return IN.normalize_accidents(A.raw_events(_t(spark, sf_dir)))


@query("ntsb_weather_json", ("raw_events",), f"SELECT external_id, weather_data, raw_data FROM ({_NTSB_SQL}) x")
def ntsb_weather_json(spark, sf_dir):
    return IN.normalize_accidents(A.raw_events(_t(spark, sf_dir))).select("external_id", "weather_data", "raw_data")


@query("scan_aircraft", ("raw_aircraft",), "SELECT * FROM raw_aircraft")
def scan_aircraft(spark, sf_dir):
    """The whole raw aircraft table."""
    return IN.scan_aircraft(A.raw_aircraft(_t(spark, sf_dir)))


@query("scan_aircraft_top", ("raw_aircraft",), "SELECT * FROM raw_aircraft ORDER BY ev_id, line_no, part_no, supp_no LIMIT 100")
def scan_aircraft_top(spark, sf_dir):
    """A6 with TOP n: the first 100 rows in file order."""
    return IN.scan_aircraft(A.raw_aircraft(_t(spark, sf_dir)), 100)


@query("enrich_first_aircraft", ("raw_events", "raw_aircraft"), """
SELECT e.ev_id AS external_id, f.acft_make AS aircraft_make, f.acft_model AS aircraft_model,
  f.regis_no AS aircraft_registration, f.acft_category AS aircraft_type, f.oper_name AS operator
FROM raw_events e LEFT JOIN (
  SELECT ev_id, acft_make, acft_model, regis_no, acft_category, oper_name FROM (
    SELECT *, row_number() OVER (PARTITION BY ev_id ORDER BY line_no, part_no, supp_no) AS rn FROM raw_aircraft) x
  WHERE rn = 1) f ON e.ev_id = f.ev_id""")
def enrich_first_aircraft(spark, sf_dir):
    t = _t(spark, sf_dir)
    inc = IN.normalize_accidents(A.raw_events(t))
    return IN.enrich_first_aircraft(inc, A.raw_aircraft(t)).select(
        "external_id", "aircraft_make", "aircraft_model", "aircraft_registration", "aircraft_type", "operator")


@query("ingest_reject_split", ("raw_events",), """
SELECT status, reject_reason, count(*) AS records FROM (
  SELECT CASE WHEN TRY_CAST(ev_date AS TIMESTAMP) IS NULL THEN 'missing_incident_date' END AS reject_reason,
    CASE WHEN TRY_CAST(ev_date AS TIMESTAMP) IS NULL THEN 'rejected' ELSE 'accepted' END AS status
  FROM raw_events) GROUP BY 1, 2""")
def ingest_reject_split(spark, sf_dir):
    n = IN.reject_split(IN.normalize_accidents(A.raw_events(_t(spark, sf_dir))))
    return n.groupBy("status", "reject_reason").agg(F.count(F.lit(1)).alias("records"))


# ---- C15-C19 voluntary reports --------------------------------------------------

_PHASE_SQL = ("CASE " + " ".join(f"WHEN contains(lower(flight_phase), '{k}') THEN '{v}'"
                                 for k, v in K.REPORT_PHASE_KEYWORDS) + " ELSE 'UNKNOWN' END")
_SEV_SQL = """CASE WHEN contains(lower(COALESCE(result, '')), 'collision') OR contains(lower(COALESCE(anomaly, '')), 'collision') THEN 'SERIOUS'
  WHEN contains(lower(COALESCE(result, '')), 'deviation') OR contains(lower(COALESCE(result, '')), 'excursion') THEN 'MINOR'
  ELSE 'NONE' END"""
_DATE_SQL = ("CAST(try_strptime(trim(date_raw), ['%Y%m', '%Y-%m', '%m/%Y', '%Y', '%Y%m%d', '%m/%d/%Y']) "
             "AS TIMESTAMP)")


@query("keyword_severity", ("raw_reports",),
       f"SELECT acn, {_SEV_SQL} AS severity FROM raw_reports")
def keyword_severity(spark, sf_dir):
    r = A.raw_reports(_t(spark, sf_dir))
    return r.select("acn", T.keyword_severity(F.col("result"), F.col("anomaly")).alias("severity"))


@query("keyword_phase", ("raw_reports",), f"SELECT acn, {_PHASE_SQL} AS phase_of_flight FROM raw_reports")
def keyword_phase(spark, sf_dir):
    r = A.raw_reports(_t(spark, sf_dir))
    return r.select("acn", T.keyword_phase(F.col("flight_phase")).alias("phase_of_flight"))


@query("parse_dates", ("raw_reports",), f"SELECT acn, date_raw, {_DATE_SQL} AS parsed_date FROM raw_reports")
def parse_dates(spark, sf_dir):
    r = A.raw_reports(_t(spark, sf_dir))
    return r.select("acn", "date_raw", T.parse_multi_date(F.col("date_raw")).alias("parsed_date"))


def _report_sql(make: str = "NULL", operator: str = "NULL") -> str:
    null = lambda name, kind="VARCHAR": f"CAST(NULL AS {kind}) AS {name}"
    return f"""
SELECT md5('ASRS|' || CAST(acn AS VARCHAR)) AS id, 'ASRS' AS source, CAST(acn AS VARCHAR) AS external_id,
  COALESCE({_DATE_SQL}, TIMESTAMP '2020-01-01 00:00:00') AS incident_date, {null('report_date', 'TIMESTAMP')},
  COALESCE(NULLIF(substring(state_reference, 1, 255), ''), 'USA') AS location, {null('airport_code')}, 'USA' AS country,
  {null('latitude', 'DOUBLE')}, {null('longitude', 'DOUBLE')}, {null('aircraft_type')}, CAST({make} AS VARCHAR) AS aircraft_make,
  {null('aircraft_model')}, {null('aircraft_registration')}, CAST({operator} AS VARCHAR) AS operator,
  {_PHASE_SQL} AS phase_of_flight, {null('flight_type')}, {_SEV_SQL} AS severity,
  0 AS injuries_fatal, 0 AS injuries_serious, 0 AS injuries_minor, 0 AS injuries_uninjured, 'None' AS aircraft_damage,
  COALESCE(NULLIF(substring(synopsis, 1, 2000), ''), NULLIF(substring(narrative, 1, 5000), '')) AS probable_cause,
  {null('contributing_factors')},
  COALESCE(substring(NULLIF(substring(anomaly, 1, 255), ''), 1, 100), 'Near Miss') AS event_type,
  NULLIF(substring(flight_conditions, 1, 255), '') AS weather_conditions, {null('weather_data')}, {null('raw_data')},
  TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
FROM raw_reports"""


_REPORT_SQL = _report_sql("make_model", "operator")


@query("asrs_normalize", ("raw_reports",), _REPORT_SQL)
def asrs_normalize(spark, sf_dir):
    """Whole incident rows of the reports."""
    return IN.normalize_reports(A.raw_reports(_t(spark, sf_dir)))


_UNION_COLUMNS = ["source", "external_id", "incident_date", "location", "airport_code", "country", "latitude", "longitude",
                  "phase_of_flight", "severity", "injuries_fatal", "injuries_serious", "injuries_minor", "injuries_uninjured",
                  "weather_conditions", "weather_data", "event_type", "raw_data"]


@query("union_sources", ("raw_events", "raw_reports"), f"""
SELECT {', '.join(_UNION_COLUMNS)}, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS probable_cause FROM ({_NTSB_SQL}) a
UNION ALL SELECT {', '.join(_UNION_COLUMNS)}, id, probable_cause FROM ({_REPORT_SQL}) b""")
def union_sources(spark, sf_dir):
    """H1: all columns that either source fills."""
    t = _t(spark, sf_dir)
    u = IN.union_sources(IN.normalize_accidents(A.raw_events(t)), IN.normalize_reports(A.raw_reports(t)))
    return u.select(*_UNION_COLUMNS, "id", "probable_cause")


REPORTS_A_FILE = 50_000


@query("scan_tsv_reports", ("raw_reports",), _REPORT_SQL)
def scan_tsv_reports(spark, sf_dir):
    """A9 + B8: land the reports as TSV files with vendor headers in the shared folder, scan them
    back with header resolution and normalise.  The files are compressed, and of a bounded number of
    reports each, as a compressed file is read by one task."""
    path = os.path.join(checkpoint_dir(spark), f"reports-{uuid.uuid4().hex}.tsv")
    vendor = {"acn": "ACN", "date_raw": "Time / Date", "result": "Events / Result",
              "anomaly": "Events / Anomaly", "flight_phase": "Aircraft 1 / Flight Phase",
              "synopsis": "Report 1 / Synopsis", "narrative": "Report 1 / Narrative",
              "state_reference": "Place / State Reference", "make_model": "Aircraft 1 / Make Model Name",
              "operator": "Aircraft 1 / Aircraft Operator",
              "flight_conditions": "Environment / Flight Conditions"}
    r = A.raw_reports(_t(spark, sf_dir))
    r.select(*[F.col(k).alias(v) for k, v in vendor.items()]).write.mode("overwrite").option(
        "sep", "\t").option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).option(
        "compression", "gzip").option("maxRecordsPerFile", REPORTS_A_FILE).csv(path)
    raw, _ = IN.read_delimited(spark, path)
    return IN.normalize_reports(IN.resolve_report_columns(raw))


@query("scan_narratives", ("raw_reports",),
       "SELECT 'E' || CAST(acn AS VARCHAR) AS ev_id, narrative AS narr_text FROM raw_reports")
def scan_narratives(spark, sf_dir):
    """Discover the narrative table case-insensitively in the catalog."""
    r = A.raw_reports(_t(spark, sf_dir))
    r.select(F.concat(F.lit("E"), F.col("acn").cast("string")).alias("ev_id"),
             F.col("narrative").alias("narr_text")).createOrReplaceTempView("Report_Narratives")
    return IN.scan_narratives(spark, "NARR")


# ---- C26-C35, B10 risk labels -------------------------------------------------------

def _ops(spark, sf_dir):
    return ops_features(A.operational_data(_t(spark, sf_dir)))


@query("fatigue_index", ("operational_data",), """
SELECT id, round(greatest(least(20.0 + crew_duty_hours / 14.0 * 30.0 + greatest(0.0, 10.0 - crew_rest_hours) * 5.0,
  100.0), 0.0), 9) AS crew_fatigue_index FROM operational_data""")
def fatigue_index(spark, sf_dir):
    o = A.operational_data(_t(spark, sf_dir))
    return o.select("id", F.round(OPS.crew_fatigue_index(F.col("crew_duty_hours"), F.col("crew_rest_hours")), 9)
                    .alias("crew_fatigue_index"))


@query("source_risk", ("operational_data",), """
SELECT id, CAST(round(CAST(format('{}', r) AS DECIMAL(38, 20)), 1) AS DOUBLE) AS source_risk FROM (
SELECT id, greatest(least(crew_fatigue_index * 0.3
  + CASE WHEN maintenance_overdue_flag THEN 20.0 ELSE 0.0 END + open_maintenance_items / 10.0 * 10.0
  + least(aircraft_age_years / 30.0 * 10.0, 10.0) + least(abs(schedule_deviation_minutes) / 60.0 * 15.0, 15.0)
  + CASE WHEN turnaround_time_minutes < 45 THEN 10.0 ELSE 0.0 END, 100.0), 0.0) AS r
FROM operational_data) x""")
def source_risk(spark, sf_dir):
    o = A.operational_data(_t(spark, sf_dir))
    return o.select("id", OPS.source_composite_risk(
        F.col("crew_fatigue_index"), F.col("maintenance_overdue_flag"), F.col("open_maintenance_items"),
        F.col("aircraft_age_years"), F.col("schedule_deviation_minutes"),
        F.col("turnaround_time_minutes")).alias("source_risk"))


@query("actual_departure", ("operational_data",), """
SELECT id, scheduled_departure + to_minutes(CAST(schedule_deviation_minutes AS BIGINT)) AS actual_departure
FROM operational_data""")
def actual_departure(spark, sf_dir):
    o = A.operational_data(_t(spark, sf_dir))
    return o.select("id", OPS.actual_departure(F.col("scheduled_departure"),
                                               F.col("schedule_deviation_minutes")).alias("actual_departure"))


@query("risk_level", ("ops_features",), """
SELECT id, round(greatest(least(operational_risk_score, 100.0), 0.0), 9) AS risk_score,
  CASE WHEN operational_risk_score >= 75 THEN 'CRITICAL' WHEN operational_risk_score >= 50 THEN 'HIGH'
       WHEN operational_risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM ops_features""")
def risk_level(spark, sf_dir):
    o = _ops(spark, sf_dir)
    s = R.clamp_score(F.col("operational_risk_score"))
    return o.select("id", F.round(s, 9).alias("risk_score"), R.risk_level(s).alias("risk_level"))


@query("contributing_factors", ("ops_features",), """
SELECT id, CASE WHEN f = '' THEN 'No significant factors' ELSE f END AS factors FROM (
  SELECT id, concat_ws('|',
    CASE WHEN operational_risk_score > 70 THEN 'High operational risk score' END,
    CASE WHEN fatigue_risk > 60 THEN 'Elevated crew fatigue' END,
    CASE WHEN maintenance_risk > 50 THEN 'Maintenance concerns' END,
    CASE WHEN crew_duty_hours > 12 THEN 'Extended duty hours' END) AS f FROM ops_features) x""")
def contributing_factors(spark, sf_dir):
    o = _ops(spark, sf_dir)
    return o.select("id", F.array_join(R.contributing_factors(o), "|").alias("factors"))


@query("anomaly_percentile", ("scored",),
       "SELECT id, round(50 + anomaly_score * 50, 9) AS percentile FROM scored")
def anomaly_percentile(spark, sf_dir):
    s = A.scored(_t(spark, sf_dir))
    return s.select("id", F.round(R.approx_percentile(F.col("anomaly_score")), 9).alias("percentile"))


@query("heuristic_risk", ("ops_features",), """
SELECT id, round(r, 9) AS heuristic_risk,
  COALESCE(r > 70 OR crew_fatigue_index > 80 OR maintenance_risk > 60, FALSE) AS heuristic_anomaly
FROM (SELECT *, greatest(least(50.0 * 0.35 + crew_fatigue_index * 0.25 + maintenance_risk * 0.2
        + CASE WHEN hour(scheduled_departure) < 6 OR hour(scheduled_departure) >= 21 THEN 10.0 ELSE 0.0 END
        + COALESCE(aircraft_age_years, 0.0) / 2.0, 100.0), 0.0) AS r FROM ops_features) x""")
def heuristic_risk(spark, sf_dir):
    o = _ops(spark, sf_dir)
    h = F.hour("scheduled_departure")
    r = R.heuristic_risk(F.lit(50.0), F.col("crew_fatigue_index"), F.col("maintenance_risk"),
                         (h < 6) | (h >= 21), F.coalesce(F.col("aircraft_age_years"), F.lit(0.0)))
    return o.select("id", F.round(r, 9).alias("heuristic_risk"),
                    R.heuristic_anomaly(r, F.col("crew_fatigue_index"), F.col("maintenance_risk"))
                    .alias("heuristic_anomaly"))


@query("scoring_batch_constraints", ("ops_features",), """
SELECT status, violation, count(*) AS records FROM (
  SELECT id, v AS violation, 'rejected' AS status FROM (
    SELECT id, unnest(list_filter([
      CASE WHEN operational_risk_score IS NULL THEN 'missing:operational_risk_score' END,
      CASE WHEN operational_risk_score < 0.0 THEN 'below_min:operational_risk_score' END,
      CASE WHEN operational_risk_score > 100.0 THEN 'above_max:operational_risk_score' END,
      CASE WHEN fatigue_risk IS NULL THEN 'missing:fatigue_risk' END,
      CASE WHEN fatigue_risk < 0.0 THEN 'below_min:fatigue_risk' END,
      CASE WHEN fatigue_risk > 100.0 THEN 'above_max:fatigue_risk' END,
      CASE WHEN maintenance_risk IS NULL THEN 'missing:maintenance_risk' END,
      CASE WHEN maintenance_risk < 0.0 THEN 'below_min:maintenance_risk' END,
      CASE WHEN maintenance_risk > 100.0 THEN 'above_max:maintenance_risk' END,
      CASE WHEN schedule_risk < 0.0 THEN 'below_min:schedule_risk' END,
      CASE WHEN schedule_risk > 100.0 THEN 'above_max:schedule_risk' END,
      CASE WHEN crew_duty_hours < 0.0 THEN 'below_min:crew_duty_hours' END,
      CASE WHEN crew_duty_hours > 20.0 THEN 'above_max:crew_duty_hours' END,
      CASE WHEN crew_rest_hours < 0.0 THEN 'below_min:crew_rest_hours' END,
      CASE WHEN crew_rest_hours > 48.0 THEN 'above_max:crew_rest_hours' END,
      CASE WHEN turnaround_time_minutes < 0.0 THEN 'below_min:turnaround_time_mins' END], lambda x: x IS NOT NULL)) AS v
    FROM ops_features) e
  UNION ALL
  SELECT id, NULL, 'accepted' FROM ops_features
  WHERE NOT (COALESCE(operational_risk_score IS NULL OR operational_risk_score < 0 OR operational_risk_score > 100, FALSE)
    OR COALESCE(fatigue_risk IS NULL OR fatigue_risk < 0 OR fatigue_risk > 100, FALSE)
    OR COALESCE(maintenance_risk IS NULL OR maintenance_risk < 0 OR maintenance_risk > 100, FALSE)
    OR COALESCE(schedule_risk < 0 OR schedule_risk > 100, FALSE)
    OR COALESCE(crew_duty_hours < 0 OR crew_duty_hours > 20, FALSE)
    OR COALESCE(crew_rest_hours < 0 OR crew_rest_hours > 48, FALSE)
    OR COALESCE(turnaround_time_minutes < 0, FALSE))) GROUP BY 1, 2""")
def scoring_batch_constraints(spark, sf_dir):
    o = _ops(spark, sf_dir).withColumnRenamed("turnaround_time_minutes", "turnaround_time_mins")
    v = o.select("id", R.constraint_violations(o, R.ANOMALY_REQUEST_RULES).alias("violations"))
    rejected = v.filter(F.size("violations") > 0).select(
        F.lit("rejected").alias("status"), F.explode("violations").alias("violation"))
    accepted = v.filter(F.size("violations") == 0).select(
        F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("violation"))
    return rejected.unionByName(accepted).groupBy("status", "violation").agg(
        F.count(F.lit(1)).alias("records"))


@query("request_constraints", ("ops_features",), """
WITH v AS (
  SELECT 'severity' AS request, unnest(list_filter([
    CASE WHEN crew_fatigue_index < 0 THEN 'below_min:crew_fatigue_index' END,
    CASE WHEN crew_fatigue_index > 100 THEN 'above_max:crew_fatigue_index' END,
    CASE WHEN maintenance_risk < 0 THEN 'below_min:maintenance_risk' END,
    CASE WHEN maintenance_risk > 100 THEN 'above_max:maintenance_risk' END,
    CASE WHEN aircraft_age_years < 0 THEN 'below_min:aircraft_age_years' END,
    CASE WHEN aircraft_age_years > 60 THEN 'above_max:aircraft_age_years' END], lambda x: x IS NOT NULL)) AS violation
  FROM ops_features
  UNION ALL
  SELECT 'recommendation', unnest(list_filter([
    CASE WHEN crew_fatigue_index < 0 THEN 'below_min:crew_fatigue_index' END,
    CASE WHEN crew_fatigue_index > 100 THEN 'above_max:crew_fatigue_index' END,
    CASE WHEN crew_duty_hours < 0 THEN 'below_min:crew_duty_hours' END,
    CASE WHEN crew_duty_hours > 20 THEN 'above_max:crew_duty_hours' END,
    CASE WHEN maintenance_risk < 0 THEN 'below_min:maintenance_risk' END,
    CASE WHEN maintenance_risk > 100 THEN 'above_max:maintenance_risk' END,
    CASE WHEN turnaround_time_minutes < 0 THEN 'below_min:turnaround_time_mins' END], lambda x: x IS NOT NULL))
  FROM ops_features
  UNION ALL
  SELECT 'risk', unnest(['missing:incident_year', 'missing:incident_month', 'missing:incident_day_of_week'])
  FROM ops_features)
SELECT request, violation, count(*) AS records FROM v GROUP BY 1, 2""")
def request_constraints(spark, sf_dir):
    """The severity, recommendation and risk request checks over a batch of operations (which
    lack the risk request's required dates)."""
    o = _ops(spark, sf_dir).withColumnRenamed("turnaround_time_minutes", "turnaround_time_mins")
    rules = {"severity": R.SEVERITY_REQUEST_RULES, "recommendation": R.RECOMMENDATION_REQUEST_RULES,
             "risk": R.RISK_REQUEST_RULES}
    o = o.drop("weather_risk_score", "maintenance_overdue_flag")

    def named(kind):
        return F.transform(R.constraint_violations(o, rules[kind]),
                           lambda v: F.struct(F.lit(kind).alias("request"), v.alias("violation")))

    rows = F.explode(F.concat(*[named(kind) for kind in rules]))
    return o.select(rows.alias("v")).groupBy("v.request", "v.violation").agg(F.count(F.lit(1)).alias("records"))
