"""DuckDB SQL for the adapter views and the shared feature views.

The oracle is an independent SQL statement of every query.  Views are emitted
as CTEs in front of each oracle statement; the driver tables (orders, ...)
are pre-registered views in DuckDB.
"""

from __future__ import annotations

from wingwatch.sources import adapters as A


def _q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _pick(values, index_sql: str) -> str:
    parts = " ".join(f"WHEN {index_sql} = {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {parts} END"


def avg6(expr: str) -> str:
    """Exact mean HALF_UP to 6 places (the library's ``mean6``): values enter
    as their shortest decimal text at scale 12, the sum is exact, and the
    division is rounded with integer arithmetic."""
    d = (f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE "
         f"CAST(format('{{}}', CAST(({expr}) AS DOUBLE)) AS DECIMAL(38, 12)) END")
    u = f"CAST(replace(CAST(sum({d}) AS VARCHAR), '.', '') AS HUGEINT)"
    n = f"CAST(count({expr}) AS HUGEINT)"
    return (f"(CASE WHEN count({expr}) = 0 THEN NULL ELSE CAST(sign({u}) * ((2 * abs({u}) + {n} * 1000000) "
            f"// (2 * {n} * 1000000)) AS DOUBLE) / 1000000 END)")


def pct6(part: str, whole: str) -> str:
    """Exact ``part / whole * 100`` HALF_UP to 6 places (the library's ``pct``)."""
    p = f"CAST({part} AS HUGEINT)"
    w = f"CAST({whole} AS HUGEINT)"
    return (f"(CASE WHEN {w} > 0 THEN CAST(sign({p}) * ((2 * abs({p}) * 100000000 + {w}) // (2 * {w})) AS DOUBLE) "
            f"/ 1000000 ELSE CAST(0 AS DOUBLE) END)")


def wrap_counts(sql: str) -> str:
    """``count_if`` is HUGEINT in DuckDB; Spark's is BIGINT: cast each call."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(tok), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = wrap_counts(sql[j + len(tok):k - 1])
        out.append(sql[i:j] + "CAST(" + tok + inner + ") AS BIGINT)")
        i = k


def rewrite_means(sql: str) -> str:
    """Replace every ``round(avg(<expr>), 6)`` with the exact ``avg6``."""
    out, i, tok = [], 0, "round(avg("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(tok), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        expr = sql[j + len(tok):k - 1]
        tail = sql[k:k + 4]
        if tail != ", 6)":
            out.append(sql[i:k])
            i = k
            continue
        out.append(sql[i:j] + avg6(expr))
        i = k + 4


VIEWS: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}


def view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = sql
    DEPS[name] = deps


view("incidents", f"""
SELECT CAST(o_orderkey AS BIGINT) AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'BOGUS' WHEN o_orderkey % 103 = 0 THEN NULL
       WHEN o_orderkey % 10 < 6 THEN 'NTSB' WHEN o_orderkey % 10 < 9 THEN 'ASRS' ELSE 'FAA' END AS source,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 499 = 0 THEN TIMESTAMP '1949-06-01 00:00:00'
       ELSE CAST(o_orderdate AS TIMESTAMP) END AS incident_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'FATAL' WHEN '2-HIGH' THEN 'SERIOUS'
       WHEN '3-MEDIUM' THEN 'MINOR' ELSE 'NONE' END AS severity,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey % 4 WHEN o_orderkey % 997 = 0 THEN -1 ELSE 0 END AS INTEGER) AS injuries_fatal,
  CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey % 3 WHEN o_orderkey % 13 = 0 THEN NULL ELSE 0 END AS INTEGER) AS injuries_serious,
  CAST(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 + o_orderkey % 5 ELSE 0 END AS INTEGER) AS injuries_minor,
  CAST(o_custkey % 6 AS INTEGER) AS injuries_uninjured,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN 95 ELSE o_orderkey % 181 - 90 END AS DOUBLE) AS latitude,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 361 - 180 END AS DOUBLE) AS longitude,
  CASE WHEN n_regionkey = 1 THEN 'USA' ELSE n_name END AS country,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'CITY_' || CAST(o_custkey % 50 AS VARCHAR) || ', ' || r_name END AS location,
  {_pick(A.INCIDENT_PHASES, 'o_orderkey % 12')} AS phase_of_flight,
  CASE o_orderstatus WHEN 'F' THEN 'IMC' WHEN 'O' THEN 'VMC' ELSE NULL END AS weather_conditions,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE
    '{{"weather_risk_score": ' || CAST(o_custkey % 101 AS VARCHAR) || ', "visibility_m": ' ||
    CAST(100 * (o_orderkey % 120) AS VARCHAR) || ', "wind_speed_kt": ' || CAST(o_orderkey % 41 AS VARCHAR) || '}}' END AS weather_data,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'a' || CAST(o_custkey % 60 AS VARCHAR)
       ELSE 'A' || CAST(o_custkey % 60 AS VARCHAR) END AS airport_code,
  {_pick(A.INCIDENT_MAKES, 'o_orderkey % 8')} AS aircraft_make,
  {_pick(A.INCIDENT_MODELS, 'o_custkey % 5')} AS aircraft_model,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE repeat(c_mktsegment || ' cause ', CAST(1 + o_orderkey % 40 AS INTEGER)) END AS probable_cause
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

view("operational_data", """
SELECT 'F-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
       CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d') AS id,
  CAST(l_shipdate AS DATE) AS date,
  'N' || CAST(l_suppkey AS VARCHAR) AS aircraft_id,
  'FL' || CAST(l_orderkey AS VARCHAR) AS flight_id,
  CAST(l_shipdate AS TIMESTAMP) AS scheduled_departure,
  CAST(CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_quantity * CAST(0.25 AS DOUBLE) END AS DOUBLE) AS crew_duty_hours,
  CAST(CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_discount * CAST(150 AS DOUBLE) END AS DOUBLE) AS crew_rest_hours,
  CAST(l_orderkey % 105 AS DOUBLE) AS crew_fatigue_index,
  CAST(CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_partkey % 41 END AS DOUBLE) AS aircraft_age_years,
  l_returnflag = 'R' AS maintenance_overdue_flag,
  CAST(l_linenumber AS INTEGER) AS open_maintenance_items,
  CAST(l_orderkey % 211 - 30 AS INTEGER) AS schedule_deviation_minutes,
  CAST(20 + l_partkey % 160 AS INTEGER) AS turnaround_time_minutes,
  CAST(l_tax * CAST(1250 AS DOUBLE) AS DOUBLE) AS operational_risk_score
FROM lineitem
""")

_COND = ("CASE event_type WHEN 'error' THEN 'Thunderstorm' WHEN 'click' THEN 'Fog' "
         "WHEN 'signup' THEN 'Rain' WHEN 'purchase' THEN 'Clouds' ELSE 'Clear' END")

view("weather_conditions", f"""
SELECT CAST(event_id AS BIGINT) AS id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
  'AP' || CAST(user_id % 50 AS VARCHAR) AS airport_code,
  CAST(event_id * 37 % 15000 AS DOUBLE) AS visibility_m,
  CAST(event_id * 13 % 36 AS DOUBLE) AS wind_speed_ms,
  CAST(event_id * 5 % 50 AS DOUBLE) AS wind_gust_ms,
  CAST(event_id * 7 % 60 - 15 AS DOUBLE) AS temperature_c,
  CAST(event_id * 11 % 101 AS DOUBLE) AS cloud_cover_percent,
  {_COND} AS weather_condition
FROM events
""")

view("airports_raw", f"""
SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'A' || CAST(s_suppkey AS VARCHAR) ELSE 'KA' || CAST(s_suppkey AS VARCHAR) END AS ident,
  {_pick(['large_airport', 'medium_airport', 'small_airport', 'heliport'], 's_suppkey % 4')} AS type,
  'Airport ' || CAST(s_suppkey AS VARCHAR) AS name,
  CAST(s_suppkey - 50 AS DOUBLE) AS latitude_deg,
  CAST(2 * s_suppkey - 100 AS DOUBLE) AS longitude_deg,
  CAST(s_suppkey * 10 AS INTEGER) AS elevation_ft,
  CASE WHEN s_nationkey = 1 THEN 'US' ELSE 'XX' END AS iso_country,
  'R-' || CAST(s_suppkey % 5 AS VARCHAR) AS iso_region,
  'CITY_' || CAST(s_suppkey % 50 AS VARCHAR) AS municipality
FROM supplier
""")

view("raw_events", f"""
SELECT 'E' || CAST(o_orderkey AS VARCHAR) AS ev_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ev_date,
  CAST(year(o_orderdate) AS INTEGER) AS ev_year,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'CITY_' || CAST(o_custkey % 50 AS VARCHAR) END AS ev_city,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'S' || CAST(o_custkey % 7 AS VARCHAR) END AS ev_state,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE CAST(o_orderkey % 181 - 90 AS VARCHAR) END AS dec_latitude,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'FATL' WHEN '2-HIGH' THEN 'SERS' WHEN '3-MEDIUM' THEN 'MINR'
       WHEN '5-LOW' THEN 'NONE' ELSE NULL END AS ev_highest_injury,
  {_pick(A.RAW_PHASE_CODES, 'o_orderkey % 7')} AS phase_flt_spec,
  CASE WHEN o_orderkey % 19 = 0 THEN 'x' WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS VARCHAR) END AS inj_tot_f,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 41 END AS DOUBLE) AS wind_vel_kts,
  CAST(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey % 11 END AS DOUBLE) AS vis_sm,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS VARCHAR) END AS inj_tot_s,
  CASE WHEN o_orderkey % 23 = 0 THEN '2.5' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS inj_tot_m,
  CAST(o_custkey % 180 AS VARCHAR) AS inj_tot_n,
  CASE WHEN o_orderkey % 16 = 0 THEN '' ELSE CAST(o_custkey % 361 - 180 AS VARCHAR) END AS dec_longitude,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'AP' || CAST(o_custkey % 50 AS VARCHAR) END AS ev_nr_apt_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'C' || CAST(o_custkey % 5 AS VARCHAR) END AS ev_country,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'VMC' ELSE 'IMC' END AS wx_cond_basic,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'ACC' END AS ev_type,
  CAST(CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_custkey % 100 END AS INTEGER) AS wx_temp,
  CAST(CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE o_custkey % 70 END AS INTEGER) AS wx_dew_pt,
  CAST(CASE WHEN o_orderkey % 8 = 2 THEN NULL ELSE o_custkey % 360 END AS INTEGER) AS wind_dir_deg,
  CAST(CASE WHEN o_orderkey % 4 < 3 THEN NULL ELSE o_custkey % 60 END AS INTEGER) AS gust_kts,
  CAST(CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE o_custkey % 40 END AS DOUBLE) AS altimeter,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'BKN "low"' END AS sky_cond_ceil,
  CAST(CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey % 30 * 100 END AS INTEGER) AS sky_ceil_ht,
  CASE WHEN o_orderkey % 6 < 3 THEN NULL ELSE 'DAYL' END AS light_cond,
  'NTSB' || CAST(o_orderkey AS VARCHAR) AS ntsb_no,
  CAST(month(o_orderdate) AS INTEGER) AS ev_month,
  CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_custkey % 2400 AS INTEGER) END AS ev_time,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Mo' ELSE 'Su' END AS ev_dow,
  CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'Field ' || CAST(o_custkey % 20 AS VARCHAR) END AS apt_name
FROM orders
""")

view("raw_aircraft", """
SELECT 'E' || CAST(l_orderkey AS VARCHAR) AS ev_id, CAST(l_linenumber AS INTEGER) AS line_no,
  CAST(l_partkey AS BIGINT) AS part_no, CAST(l_suppkey AS BIGINT) AS supp_no,
  p_brand AS acft_make, p_type AS acft_model, 'N' || CAST(l_suppkey AS VARCHAR) AS regis_no,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'CAT' || CAST(p_size % 4 AS VARCHAR) END AS acft_category,
  'OPER' || CAST(l_suppkey % 11 AS VARCHAR) AS oper_name
FROM lineitem JOIN part ON l_partkey = p_partkey
""")

view("raw_reports", f"""
SELECT CAST(o_orderkey AS BIGINT) AS acn,
  {_pick(A.REPORT_DATES, 'o_orderkey % 8')} AS date_raw,
  {_pick(A.REPORT_RESULTS, 'o_custkey % 5')} AS result,
  {_pick(A.REPORT_ANOMALIES, 'o_custkey % 4')} AS anomaly,
  {_pick(A.REPORT_PHASES, 'o_orderkey % 9')} AS flight_phase,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Synopsis of report ' || CAST(o_orderkey AS VARCHAR) END AS synopsis,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE repeat('Narrative ' || o_orderpriority || ' ', CAST(1 + o_orderkey % 400 AS INTEGER)) END AS narrative,
  'S' || CAST(o_custkey % 7 AS VARCHAR) AS state_reference,
  o_orderstatus AS flight_conditions,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'MAKE' || CAST(o_custkey % 12 AS VARCHAR) END AS make_model,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Operator ' || CAST(o_custkey % 8 AS VARCHAR) END AS operator
FROM orders
""")

_T = "CAST(event_id * 7 % 60 - 15 AS VARCHAR)"
_V = "CAST(event_id * 37 % 15000 AS VARCHAR)"
_S = "CAST(event_id * 13 % 36 AS VARCHAR)"
_G = "CAST(event_id * 5 % 50 AS VARCHAR)"
_H = "CAST(event_id * 3 % 100 AS VARCHAR)"
view("weather_payloads", f"""
SELECT CAST(event_id AS BIGINT) AS id,
  CASE WHEN event_id % 3 = 0 THEN
    '{{"data": [{{"temp": ' || {_T} || ', "visibility": ' || {_V} || ', "speed": ' || {_S} ||
    ', "weather": [{{"main": "' || {_COND} || '"}}]}}]}}'
  WHEN event_id % 3 = 1 THEN
    '{{"main": {{"temp": ' || {_T} || ', "humidity": ' || {_H} || '}}, "wind": {{"speed": ' || {_S} ||
    ', "gust": ' || {_G} || '}}, "visibility": ' || {_V} || ', "weather": [{{"main": "' || {_COND} || '"}}]}}'
  ELSE '{{}}' END AS payload
FROM events
""")

view("scored", """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 21 AS DOUBLE) AS y,
  CAST(o_custkey % 21 AS DOUBLE) + CAST(o_orderkey % 9 - 4 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS y_hat,
  CAST(o_custkey % 4 AS INTEGER) AS class_actual,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % 4 ELSE o_custkey % 4 END AS INTEGER) AS class_pred,
  CAST(o_orderkey * 31 % 1000 AS DOUBLE) * CAST(0.001 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS anomaly_score,
  o_orderkey * 31 % 1000 < 50 AS is_anomaly
FROM orders
""")

# --- shared feature views (SQL statement of C1-C10) -------------------------

view("incident_features", """
SELECT i.*,
  CAST(year(incident_date) AS INTEGER) AS year,
  CAST(month(incident_date) AS INTEGER) AS month,
  CAST(isodow(incident_date) - 1 AS INTEGER) AS day_of_week,
  CAST(dayofyear(incident_date) AS INTEGER) AS day_of_year,
  CAST(quarter(incident_date) AS INTEGER) AS quarter,
  CAST(COALESCE(isodow(incident_date) - 1 >= 5, FALSE) AS INTEGER) AS is_weekend,
  CAST(COALESCE(month(incident_date) IN (11, 12, 7), FALSE) AS INTEGER) AS is_holiday_season,
  CAST(CASE severity WHEN 'NONE' THEN 0 WHEN 'MINOR' THEN 1 WHEN 'SERIOUS' THEN 3 WHEN 'FATAL' THEN 5 ELSE 0 END AS INTEGER) AS severity_code,
  CAST(COALESCE(severity IN ('SERIOUS', 'FATAL'), FALSE) AS INTEGER) AS is_serious,
  CAST(CASE phase_of_flight WHEN 'TAKEOFF' THEN 1.5 WHEN 'LANDING' THEN 1.4 WHEN 'APPROACH' THEN 1.3
       WHEN 'CLIMB' THEN 1.1 WHEN 'DESCENT' THEN 1.1 WHEN 'CRUISE' THEN 0.8 WHEN 'TAXI' THEN 0.7
       WHEN 'PREFLIGHT' THEN 0.5 WHEN 'POST_FLIGHT' THEN 0.5 WHEN 'UNKNOWN' THEN 1.0 ELSE 1.0 END AS DOUBLE) AS phase_risk,
  CAST(COALESCE(injuries_fatal, 0) + COALESCE(injuries_serious, 0) + COALESCE(injuries_minor, 0) AS INTEGER) AS total_injuries,
  CAST(COALESCE(injuries_fatal, 0) + COALESCE(injuries_serious, 0) + COALESCE(injuries_minor, 0)
       + COALESCE(injuries_uninjured, 0) AS INTEGER) AS total_people,
  CASE WHEN COALESCE(injuries_fatal, 0) + COALESCE(injuries_serious, 0) + COALESCE(injuries_minor, 0)
       + COALESCE(injuries_uninjured, 0) > 0
       THEN CAST(COALESCE(injuries_fatal, 0) + COALESCE(injuries_serious, 0) + COALESCE(injuries_minor, 0) AS DOUBLE)
          / CAST(COALESCE(injuries_fatal, 0) + COALESCE(injuries_serious, 0) + COALESCE(injuries_minor, 0)
       + COALESCE(injuries_uninjured, 0) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS injury_rate,
  CAST(COALESCE(injuries_fatal, 0) * 5 + COALESCE(injuries_serious, 0) * 3 + COALESCE(injuries_minor, 0) AS INTEGER) AS injury_score,
  CAST(latitude IS NOT NULL AND longitude IS NOT NULL AS INTEGER) AS has_coordinates,
  CAST(COALESCE(country = 'USA', FALSE) AS INTEGER) AS is_us,
  CAST(CASE weather_conditions WHEN 'VMC' THEN 0.3 WHEN 'IMC' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS weather_risk
FROM incidents i
""", ("incidents",))

view("ops_features", """
SELECT f.*, f.fatigue_risk * CAST(0.4 AS DOUBLE) + f.maintenance_risk * CAST(0.4 AS DOUBLE)
            + f.schedule_risk * CAST(0.2 AS DOUBLE) AS operational_risk_score
FROM (
  SELECT o.* EXCLUDE (operational_risk_score), o.operational_risk_score AS source_risk_score,
    greatest(least((COALESCE(crew_duty_hours, 8) / CAST(16 AS DOUBLE))
                   * (1 - COALESCE(crew_rest_hours, 8) / CAST(12 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE))
      * CAST(100 AS DOUBLE) AS fatigue_risk,
    CAST(CAST(COALESCE(maintenance_overdue_flag, FALSE) AS INTEGER) * 30 AS DOUBLE)
      + CAST(greatest(least(COALESCE(open_maintenance_items, 0) * 5, 40), 0) AS DOUBLE)
      + greatest(least(COALESCE(aircraft_age_years, CAST(10 AS DOUBLE)), CAST(30 AS DOUBLE)), CAST(0 AS DOUBLE)) AS maintenance_risk,
    greatest(least(CAST(abs(COALESCE(schedule_deviation_minutes, 0)) AS DOUBLE) / CAST(60 AS DOUBLE) * CAST(10 AS DOUBLE),
                   CAST(30 AS DOUBLE)), CAST(0 AS DOUBLE))
      + CASE WHEN COALESCE(turnaround_time_minutes, 60) < 30 THEN CAST(20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS schedule_risk
  FROM operational_data o
) f
""", ("operational_data",))


def with_views(*names: str, only: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named views and their dependencies, in order; ``only`` restricts views
    to the rows that a condition names."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPS[n]:
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    held = lambda n: f"SELECT * FROM ({VIEWS[n]}) v WHERE {only[n]}" if only and n in only else VIEWS[n]
    return "WITH " + ",\n".join(f"{n} AS ({held(n)})" for n in ordered) + "\n"

view("incident_wx", """
SELECT f.*,
  TRY_CAST(json_extract_string(weather_data, '$.weather_risk_score') AS DOUBLE) AS wx_risk,
  TRY_CAST(json_extract_string(weather_data, '$.visibility_m') AS DOUBLE) AS wx_visibility,
  TRY_CAST(json_extract_string(weather_data, '$.wind_speed_kt') AS DOUBLE) AS wx_wind,
  json_extract_string(weather_data, '$.weather_condition') AS wx_type
FROM incident_features f
""", ("incident_features",))

view("airports", """
SELECT ident AS icao_code, type, name, latitude_deg AS latitude, longitude_deg AS longitude,
  elevation_ft, iso_country AS country, iso_region AS region, municipality AS city,
  CAST(CASE type WHEN 'large_airport' THEN 80 WHEN 'medium_airport' THEN 50
       WHEN 'small_airport' THEN 30 END AS INTEGER) AS complexity_score
FROM airports_raw WHERE type IN ('large_airport', 'medium_airport', 'small_airport')
""", ("airports_raw",))
