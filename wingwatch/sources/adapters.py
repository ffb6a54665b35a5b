"""Adapter views: give the driver's Parquet tables the shapes the jobs read.

These only *lay out* input rows (see FIXTURES.md section 3); NULLs and bad
values are injected on purpose because the driver tables have none.  No job
result is computed here, and no job relies on how these rows were made.
Each view is one ``selectExpr`` (SQL expression text: one parse instead of
hundreds of Column calls).  Joins use Spark's planner: nation (25 rows) and
region (5 rows) are fixed-size by the TPC-H definition and are broadcast;
customer/orders grow with scale and are left to AQE (broadcast below the
threshold, sort-merge above it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingwatch.sources.tables import Tables

INCIDENT_PHASES = [
    "TAKEOFF", "LANDING", "APPROACH", "CLIMB", "DESCENT", "CRUISE", "TAXI",
    "PREFLIGHT", "POST_FLIGHT", "UNKNOWN", "GO_AROUND", None,
]
INCIDENT_MAKES = [
    "CESSNA", "Piper", "BOEING", "Airbus Industrie", "ROBINSON", "GRUMMAN",
    "Mooney", None,
]
INCIDENT_MODELS = ["172", "PA-28-140", "737-800", "XX9", None]
RAW_PHASE_CODES = ["TKOF", "LDG", "APPR", "MANEUVERING", "STANDING", "ZZZ", None]
REPORT_DATES = ["202301", "2023-01", "01/2023", "2023", "20230115", "1/5/2023", "junk", None]
REPORT_RESULTS = ["Ground Collision", "Runway excursion", "altitude DEVIATION",
                  "None Reported", None]
REPORT_ANOMALIES = ["Airborne collision threat", "deviation", None, None]
REPORT_PHASES = ["Initial Climb", "Final Approach", "Taxi", "Parked", "Takeoff; Landing",
                 "Cruise", "Hover", "", None]
WEATHER_BY_EVENT = [("error", "Thunderstorm"), ("click", "Fog"), ("signup", "Rain"),
                    ("purchase", "Clouds")]


def _lit(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + str(v).replace("'", "\\'") + "'"


def pick(values: list, index_sql: str) -> str:
    """``values[index]`` as a SQL CASE (index is a 0-based integer expression)."""
    return "CASE " + " ".join(f"WHEN {index_sql} = {i} THEN {_lit(v)}" for i, v in enumerate(values)) + " END"


def _event_condition() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in WEATHER_BY_EVENT) + " ELSE 'Clear' END"


def _geo(t: Tables) -> DataFrame:
    n = t.read("nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = t.read("region", ["r_regionkey", "r_name"])
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).drop("r_regionkey")


#: incident columns that come from the customer and nation side
GEO_COLUMNS = ("country", "location", "probable_cause")


def incidents(t: Tables, geo: bool = False) -> DataFrame:
    """Incident records.  ``geo`` adds ``GEO_COLUMNS``; without it the view is one scan of the order
    table, so queries that need none of them pay for no join."""
    o = t.read("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    if geo:
        c = t.read("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
        o = (o.join(c, o.o_custkey == c.c_custkey)
             .join(F.broadcast(_geo(t)), F.col("c_nationkey") == F.col("n_nationkey")))
    k, cu, prio = "o_orderkey", "o_custkey", "o_orderpriority"
    view = [
        f"CAST({k} AS BIGINT) AS id",
        f"CASE WHEN {k} % 97 = 0 THEN 'BOGUS' WHEN {k} % 103 = 0 THEN CAST(NULL AS STRING) "
        f"WHEN {k} % 10 < 6 THEN 'NTSB' WHEN {k} % 10 < 9 THEN 'ASRS' ELSE 'FAA' END AS source",
        f"CASE WHEN {k} % 101 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) "
        f"WHEN {k} % 499 = 0 THEN TIMESTAMP_NTZ '1949-06-01 00:00:00' "
        f"ELSE CAST(o_orderdate AS TIMESTAMP_NTZ) END AS incident_date",
        f"CASE {prio} WHEN '1-URGENT' THEN 'FATAL' WHEN '2-HIGH' THEN 'SERIOUS' "
        f"WHEN '3-MEDIUM' THEN 'MINOR' ELSE 'NONE' END AS severity",
        f"CAST(CASE WHEN {prio} = '1-URGENT' THEN {cu} % 4 WHEN {k} % 997 = 0 THEN -1 ELSE 0 END AS INT) "
        f"AS injuries_fatal",
        f"CAST(CASE WHEN {prio} IN ('1-URGENT', '2-HIGH') THEN {k} % 3 WHEN {k} % 13 = 0 THEN NULL ELSE 0 END "
        f"AS INT) AS injuries_serious",
        f"CAST(CASE WHEN {prio} = '3-MEDIUM' THEN 1 + {k} % 5 ELSE 0 END AS INT) AS injuries_minor",
        f"CAST({cu} % 6 AS INT) AS injuries_uninjured",
        f"CAST(CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 211 = 0 THEN 95 ELSE {k} % 181 - 90 END AS DOUBLE) "
        f"AS latitude",
        f"CAST(CASE WHEN {k} % 11 = 0 THEN NULL ELSE {cu} % 361 - 180 END AS DOUBLE) AS longitude",
        f"{pick(INCIDENT_PHASES, f'{k} % 12')} AS phase_of_flight",
        "CASE o_orderstatus WHEN 'F' THEN 'IMC' WHEN 'O' THEN 'VMC' ELSE CAST(NULL AS STRING) END "
        "AS weather_conditions",
        f"CASE WHEN {k} % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('{{\"weather_risk_score\": ', "
        f"CAST({cu} % 101 AS STRING), ', \"visibility_m\": ', CAST(100 * ({k} % 120) AS STRING), "
        f"', \"wind_speed_kt\": ', CAST({k} % 41 AS STRING), '}}') END AS weather_data",
        f"CASE WHEN {k} % 9 = 0 THEN CAST(NULL AS STRING) WHEN {k} % 4 = 0 THEN concat('a', CAST({cu} % 60 AS STRING)) "
        f"ELSE concat('A', CAST({cu} % 60 AS STRING)) END AS airport_code",
        f"{pick(INCIDENT_MAKES, f'{k} % 8')} AS aircraft_make",
        f"{pick(INCIDENT_MODELS, f'{cu} % 5')} AS aircraft_model",
    ]
    if geo:
        view += [
            "CASE WHEN n_regionkey = 1 THEN 'USA' ELSE n_name END AS country",
            f"CASE WHEN {k} % 5 = 0 THEN CAST(NULL AS STRING) "
            f"ELSE concat('CITY_', CAST({cu} % 50 AS STRING), ', ', r_name) END AS location",
            f"CASE WHEN {k} % 3 = 0 THEN CAST(NULL AS STRING) "
            f"ELSE repeat(concat(c_mktsegment, ' cause '), CAST(1 + {k} % 40 AS INT)) END AS probable_cause",
        ]
    return o.selectExpr(*view)


def operational_data(t: Tables) -> DataFrame:
    li = t.read("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                             "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    return li.selectExpr(
        "concat_ws('-', 'F', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
        "CAST(l_suppkey AS STRING), date_format(l_shipdate, 'yyyyMMdd')) AS id",
        "CAST(l_shipdate AS DATE) AS date",
        "concat('N', CAST(l_suppkey AS STRING)) AS aircraft_id",
        "concat('FL', CAST(l_orderkey AS STRING)) AS flight_id",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) AS scheduled_departure",
        "CAST(CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_quantity * CAST(0.25 AS DOUBLE) END AS DOUBLE) "
        "AS crew_duty_hours",
        "CAST(CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_discount * CAST(150 AS DOUBLE) END AS DOUBLE) "
        "AS crew_rest_hours",
        "CAST(l_orderkey % 105 AS DOUBLE) AS crew_fatigue_index",
        "CAST(CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_partkey % 41 END AS DOUBLE) AS aircraft_age_years",
        "l_returnflag = 'R' AS maintenance_overdue_flag",
        "CAST(l_linenumber AS INT) AS open_maintenance_items",
        "CAST(l_orderkey % 211 - 30 AS INT) AS schedule_deviation_minutes",
        "CAST(20 + l_partkey % 160 AS INT) AS turnaround_time_minutes",
        "CAST(l_tax * CAST(1250 AS DOUBLE) AS DOUBLE) AS operational_risk_score",
    )


def weather_conditions(t: Tables) -> DataFrame:
    ev = t.read("events", ["event_id", "ts", "user_id", "event_type"])
    return ev.selectExpr(
        "CAST(event_id AS BIGINT) AS id", "CAST(ts AS DATE) AS date", "CAST(hour(ts) AS INT) AS hour",
        "concat('AP', CAST(user_id % 50 AS STRING)) AS airport_code",
        "CAST(event_id * 37 % 15000 AS DOUBLE) AS visibility_m",
        "CAST(event_id * 13 % 36 AS DOUBLE) AS wind_speed_ms",
        "CAST(event_id * 5 % 50 AS DOUBLE) AS wind_gust_ms",
        "CAST(event_id * 7 % 60 - 15 AS DOUBLE) AS temperature_c",
        "CAST(event_id * 11 % 101 AS DOUBLE) AS cloud_cover_percent",
        f"{_event_condition()} AS weather_condition",
    )


def airports(t: Tables) -> DataFrame:
    """Raw airport list (before the B2 type filter)."""
    sup = t.read("supplier", ["s_suppkey", "s_nationkey"])
    s = "s_suppkey"
    return sup.selectExpr(
        f"CASE WHEN {s} % 3 = 0 THEN concat('A', CAST({s} AS STRING)) ELSE concat('KA', CAST({s} AS STRING)) END "
        f"AS ident",
        f"{pick(['large_airport', 'medium_airport', 'small_airport', 'heliport'], f'{s} % 4')} AS type",
        f"concat('Airport ', CAST({s} AS STRING)) AS name",
        f"CAST({s} - 50 AS DOUBLE) AS latitude_deg", f"CAST(2 * {s} - 100 AS DOUBLE) AS longitude_deg",
        f"CAST({s} * 10 AS INT) AS elevation_ft",
        "CASE WHEN s_nationkey = 1 THEN 'US' ELSE 'XX' END AS iso_country",
        f"concat('R-', CAST({s} % 5 AS STRING)) AS iso_region",
        f"concat('CITY_', CAST({s} % 50 AS STRING)) AS municipality",
    )


def raw_events(t: Tables) -> DataFrame:
    o = t.read("orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    k, cu = "o_orderkey", "o_custkey"
    return o.selectExpr(
        f"concat('E', CAST({k} AS STRING)) AS ev_id",
        f"CASE WHEN {k} % 101 = 0 THEN CAST(NULL AS STRING) ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS ev_date",
        "CAST(year(o_orderdate) AS INT) AS ev_year",
        f"CASE WHEN {k} % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('CITY_', CAST({cu} % 50 AS STRING)) END AS ev_city",
        f"CASE WHEN {k} % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('S', CAST({cu} % 7 AS STRING)) END AS ev_state",
        f"CASE WHEN {k} % 17 = 0 THEN 'n/a' WHEN {k} % 7 = 0 THEN CAST(NULL AS STRING) "
        f"ELSE CAST({k} % 181 - 90 AS STRING) END AS dec_latitude",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'FATL' WHEN '2-HIGH' THEN 'SERS' WHEN '3-MEDIUM' THEN 'MINR' "
        "WHEN '5-LOW' THEN 'NONE' ELSE CAST(NULL AS STRING) END AS ev_highest_injury",
        f"{pick(RAW_PHASE_CODES, f'{k} % 7')} AS phase_flt_spec",
        f"CASE WHEN {k} % 19 = 0 THEN 'x' WHEN {k} % 6 = 0 THEN CAST(NULL AS STRING) "
        f"ELSE CAST({cu} % 4 AS STRING) END AS inj_tot_f",
        f"CAST(CASE WHEN {k} % 4 = 0 THEN NULL ELSE {cu} % 41 END AS DOUBLE) AS wind_vel_kts",
        f"CAST(CASE WHEN {k} % 8 = 0 THEN NULL ELSE {cu} % 11 END AS DOUBLE) AS vis_sm",
        f"CASE WHEN {k} % 9 = 0 THEN CAST(NULL AS STRING) ELSE CAST({cu} % 9 AS STRING) END AS inj_tot_s",
        f"CASE WHEN {k} % 23 = 0 THEN '2.5' ELSE CAST({cu} % 3 AS STRING) END AS inj_tot_m",
        f"CAST({cu} % 180 AS STRING) AS inj_tot_n",
        f"CASE WHEN {k} % 16 = 0 THEN '' ELSE CAST({cu} % 361 - 180 AS STRING) END AS dec_longitude",
        f"CASE WHEN {k} % 12 = 0 THEN CAST(NULL AS STRING) ELSE concat('AP', CAST({cu} % 50 AS STRING)) END AS ev_nr_apt_id",
        f"CASE WHEN {k} % 10 = 0 THEN CAST(NULL AS STRING) ELSE concat('C', CAST({cu} % 5 AS STRING)) END AS ev_country",
        f"CASE WHEN {k} % 14 = 0 THEN CAST(NULL AS STRING) WHEN {k} % 2 = 0 THEN 'VMC' ELSE 'IMC' END AS wx_cond_basic",
        f"CASE WHEN {k} % 13 = 0 THEN CAST(NULL AS STRING) ELSE 'ACC' END AS ev_type",
        f"CAST(CASE WHEN {k} % 4 = 1 THEN NULL ELSE {cu} % 100 END AS INT) AS wx_temp",
        f"CAST(CASE WHEN {k} % 8 = 1 THEN NULL ELSE {cu} % 70 END AS INT) AS wx_dew_pt",
        f"CAST(CASE WHEN {k} % 8 = 2 THEN NULL ELSE {cu} % 360 END AS INT) AS wind_dir_deg",
        f"CAST(CASE WHEN {k} % 4 < 3 THEN NULL ELSE {cu} % 60 END AS INT) AS gust_kts",
        f"CAST(CASE WHEN {k} % 8 = 3 THEN NULL ELSE {cu} % 40 END AS DOUBLE) AS altimeter",
        f"CASE WHEN {k} % 3 = 1 THEN CAST(NULL AS STRING) ELSE 'BKN \"low\"' END AS sky_cond_ceil",
        f"CAST(CASE WHEN {k} % 3 = 1 THEN NULL ELSE {cu} % 30 * 100 END AS INT) AS sky_ceil_ht",
        f"CASE WHEN {k} % 6 < 3 THEN CAST(NULL AS STRING) ELSE 'DAYL' END AS light_cond",
        f"concat('NTSB', CAST({k} AS STRING)) AS ntsb_no",
        "CAST(month(o_orderdate) AS INT) AS ev_month",
        f"CASE WHEN {k} % 7 = 3 THEN CAST(NULL AS INT) ELSE CAST({cu} % 2400 AS INT) END AS ev_time",
        f"CASE WHEN {k} % 2 = 0 THEN 'Mo' ELSE 'Su' END AS ev_dow",
        f"CASE WHEN {k} % 5 = 1 THEN CAST(NULL AS STRING) ELSE concat('Field ', CAST({cu} % 20 AS STRING)) END AS apt_name",
    )


def raw_aircraft(t: Tables) -> DataFrame:
    li = t.read("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    p = t.read("part", ["p_partkey", "p_brand", "p_type", "p_size"])
    return li.join(p, li.l_partkey == p.p_partkey).selectExpr(
        "concat('E', CAST(l_orderkey AS STRING)) AS ev_id", "CAST(l_linenumber AS INT) AS line_no",
        "CAST(l_partkey AS BIGINT) AS part_no", "CAST(l_suppkey AS BIGINT) AS supp_no",
        "p_brand AS acft_make", "p_type AS acft_model", "concat('N', CAST(l_suppkey AS STRING)) AS regis_no",
        "CASE WHEN p_size % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('CAT', CAST(p_size % 4 AS STRING)) END AS acft_category",
        "concat('OPER', CAST(l_suppkey % 11 AS STRING)) AS oper_name",
    )


def raw_reports(t: Tables) -> DataFrame:
    o = t.read("orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"])
    k, cu = "o_orderkey", "o_custkey"
    return o.selectExpr(
        f"CAST({k} AS BIGINT) AS acn",
        f"{pick(REPORT_DATES, f'{k} % 8')} AS date_raw",
        f"{pick(REPORT_RESULTS, f'{cu} % 5')} AS result",
        f"{pick(REPORT_ANOMALIES, f'{cu} % 4')} AS anomaly",
        f"{pick(REPORT_PHASES, f'{k} % 9')} AS flight_phase",
        f"CASE WHEN {k} % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('Synopsis of report ', CAST({k} AS STRING)) END "
        f"AS synopsis",
        f"CASE WHEN {k} % 5 = 0 THEN CAST(NULL AS STRING) "
        f"ELSE repeat(concat('Narrative ', o_orderpriority, ' '), CAST(1 + {k} % 400 AS INT)) END AS narrative",
        f"concat('S', CAST({cu} % 7 AS STRING)) AS state_reference",
        "o_orderstatus AS flight_conditions",
        f"CASE WHEN {k} % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('MAKE', CAST({cu} % 12 AS STRING)) END AS make_model",
        f"CASE WHEN {k} % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('Operator ', CAST({cu} % 8 AS STRING)) END AS operator",
    )


def weather_payloads(t: Tables) -> DataFrame:
    """Landed weather API payloads, three shapes by event id."""
    ev = t.read("events", ["event_id", "event_type"])
    temp = "CAST(event_id * 7 % 60 - 15 AS STRING)"
    vis = "CAST(event_id * 37 % 15000 AS STRING)"
    speed = "CAST(event_id * 13 % 36 AS STRING)"
    gust = "CAST(event_id * 5 % 50 AS STRING)"
    hum = "CAST(event_id * 3 % 100 AS STRING)"
    cond = _event_condition()
    history = (f"concat('{{\"data\": [{{\"temp\": ', {temp}, ', \"visibility\": ', {vis}, ', \"speed\": ', {speed}, "
               f"', \"weather\": [{{\"main\": \"', {cond}, '\"}}]}}]}}')")
    current = (f"concat('{{\"main\": {{\"temp\": ', {temp}, ', \"humidity\": ', {hum}, "
               f"'}}, \"wind\": {{\"speed\": ', {speed}, ', \"gust\": ', {gust}, '}}, \"visibility\": ', {vis}, "
               f"', \"weather\": [{{\"main\": \"', {cond}, '\"}}]}}')")
    return ev.selectExpr(
        "CAST(event_id AS BIGINT) AS id",
        f"CASE WHEN event_id % 3 = 0 THEN {history} WHEN event_id % 3 = 1 THEN {current} ELSE '{{}}' END AS payload",
    )


def scored(t: Tables) -> DataFrame:
    """Deterministic pseudo-predictions for the metric operators."""
    o = t.read("orders", ["o_orderkey", "o_custkey"])
    return o.selectExpr(
        "CAST(o_orderkey AS BIGINT) AS id", "CAST(o_custkey % 21 AS DOUBLE) AS y",
        "CAST(o_custkey % 21 AS DOUBLE) + CAST(o_orderkey % 9 - 4 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS y_hat",
        "CAST(o_custkey % 4 AS INT) AS class_actual",
        "CAST(CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % 4 ELSE o_custkey % 4 END AS INT) AS class_pred",
        "CAST(o_orderkey * 31 % 1000 AS DOUBLE) * CAST(0.001 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS anomaly_score",
        "o_orderkey * 31 % 1000 < 50 AS is_anomaly",
    )
