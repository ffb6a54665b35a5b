"""Analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions.incident import incident_features
from wingwatch.functions.ops import ops_features
from wingwatch.operators import analytics as AN
from wingwatch.operators import dims
from wingwatch.plans.catalog import query
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables
from wingwatch.plans.oracle_views import pct6

INC_AS_OF = "2001-07-01"
OPS_AS_OF = "2001-11-04"


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _feat(spark, sf_dir):
    return incident_features(A.incidents(_t(spark, sf_dir)))


def _pct_sql(part: str, whole: str) -> str:
    return pct6(part, whole)


# ---- A1 / A8 scans and counts ----------------------------------------------

@query("scan_incidents", ("incidents",), "SELECT * FROM incidents")
def scan_incidents(spark, sf_dir):
    return A.incidents(_t(spark, sf_dir), geo=True)


@query("scan_ops", ("operational_data",), "SELECT * FROM operational_data")
def scan_ops(spark, sf_dir):
    return A.operational_data(_t(spark, sf_dir))


@query("table_counts", ("incidents", "operational_data", "weather_conditions", "raw_events",
                        "raw_aircraft", "raw_reports", "airports"), """
SELECT 'incidents' AS table_name, count(*) AS row_count FROM incidents
UNION ALL SELECT 'operational_data', count(*) FROM operational_data
UNION ALL SELECT 'weather_conditions', count(*) FROM weather_conditions
UNION ALL SELECT 'raw_events', count(*) FROM raw_events
UNION ALL SELECT 'raw_aircraft', count(*) FROM raw_aircraft
UNION ALL SELECT 'raw_reports', count(*) FROM raw_reports
UNION ALL SELECT 'airports', count(*) FROM airports
""")
def table_counts(spark, sf_dir):
    t = _t(spark, sf_dir)
    frames = {
        "incidents": A.incidents(t), "operational_data": A.operational_data(t),
        "weather_conditions": A.weather_conditions(t), "raw_events": A.raw_events(t),
        "raw_aircraft": A.raw_aircraft(t), "raw_reports": A.raw_reports(t),
        "airports": dims.airport_projection(A.airports(t)),
    }
    out = None
    for name, df in frames.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


# ---- A2-A5 extracts ---------------------------------------------------------

@query("extract_incidents_window", ("incidents",), f"""
SELECT id, source, incident_date, severity FROM incidents
WHERE incident_date >= CAST(DATE '{INC_AS_OF}' - INTERVAL 365 DAY AS TIMESTAMP)
ORDER BY incident_date DESC, id
""")
def extract_incidents_window(spark, sf_dir):
    inc = A.incidents(_t(spark, sf_dir))
    return (AN.trailing_window(inc, "incident_date", INC_AS_OF, 365)
            .orderBy(F.desc("incident_date"), "id")
            .select("id", "source", "incident_date", "severity"))


@query("extract_ops_window", ("operational_data",), f"""
SELECT id, date, aircraft_id, operational_risk_score FROM operational_data
WHERE date >= DATE '{OPS_AS_OF}' - INTERVAL 90 DAY
""")
def extract_ops_window(spark, sf_dir):
    ops = A.operational_data(_t(spark, sf_dir))
    return (AN.trailing_window(ops, "date", OPS_AS_OF, 90)
            .orderBy(F.desc("date"), "id")
            .select("id", "date", "aircraft_id", "operational_risk_score"))


@query("full_refresh_counts", ("incidents", "operational_data"), f"""
SELECT 'incidents' AS table_name, count(*) AS row_count FROM incidents
  WHERE incident_date >= CAST(DATE '{INC_AS_OF}' - INTERVAL 36500 DAY AS TIMESTAMP)
UNION ALL SELECT 'operational_data', count(*) FROM operational_data
  WHERE date >= DATE '{OPS_AS_OF}' - INTERVAL 365 DAY
""")
def full_refresh_counts(spark, sf_dir):
    t = _t(spark, sf_dir)
    inc = AN.trailing_window(A.incidents(t), "incident_date", INC_AS_OF, 36500)
    ops = AN.trailing_window(A.operational_data(t), "date", OPS_AS_OF, 365)
    return (inc.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("incidents").alias("table_name"), "row_count")
            .unionByName(ops.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit("operational_data").alias("table_name"), "row_count")))


@query("events_year_range", ("raw_events",), """
SELECT ev_id, ev_date, ev_year, ev_highest_injury FROM raw_events
WHERE ev_year BETWEEN 1996 AND 1998 ORDER BY ev_id LIMIT 100
""")
def events_year_range(spark, sf_dir):
    """A5: optional year range + TOP n, made deterministic by ordering on the key."""
    ev = A.raw_events(_t(spark, sf_dir))
    return (ev.filter(F.col("ev_year").between(1996, 1998)).orderBy("ev_id").limit(100)
            .select("ev_id", "ev_date", "ev_year", "ev_highest_injury"))


# ---- B1/B2 airports ---------------------------------------------------------

@query("airport_projection", ("airports",), "SELECT * FROM airports")
def airport_projection(spark, sf_dir):
    return dims.airport_projection(A.airports(_t(spark, sf_dir)))


# ---- dashboard / API --------------------------------------------------------

@query("dashboard_summary", ("incident_features",), f"""
SELECT count(*) AS total, count_if(severity = 'FATAL') AS fatal, count_if(severity = 'SERIOUS') AS serious,
  count_if(severity = 'MINOR') AS minor, count_if(severity = 'NONE') AS none_count,
  count_if(source = 'NTSB') AS ntsb, count_if(source = 'ASRS') AS asrs,
  round({_pct_sql("count_if(severity = 'FATAL')", "count(*)")}, 6) AS fatal_rate,
  round(avg(injury_score), 6) AS avg_injury_score
FROM incident_features
""")
def dashboard_summary(spark, sf_dir):
    return AN.dashboard_summary(_feat(spark, sf_dir))


@query("yearly_counts", ("incident_features",), """
SELECT year, count(*) AS count FROM incident_features WHERE incident_date IS NOT NULL
GROUP BY year ORDER BY year DESC LIMIT 10
""")
def yearly_counts(spark, sf_dir):
    return AN.yearly_counts(_feat(spark, sf_dir))


_MONTHLY_SQL = f"""SELECT strftime(incident_date, '%Y-%m') AS period, count(*) AS count,
  count_if(severity = 'FATAL') AS fatal_count
FROM incidents WHERE incident_date >= CAST(DATE '{INC_AS_OF}' - INTERVAL 24 MONTH AS TIMESTAMP)
GROUP BY 1 ORDER BY period DESC LIMIT 24"""
_YEARLY_SQL = """SELECT CAST(year(incident_date) AS VARCHAR) AS period, count(*) AS count,
  count_if(severity = 'FATAL') AS fatal_count
FROM incidents WHERE incident_date IS NOT NULL GROUP BY 1 ORDER BY period DESC LIMIT 10"""


@query("monthly_trend", ("incidents",), _MONTHLY_SQL)
def monthly_trend(spark, sf_dir):
    return AN.period_series(A.incidents(_t(spark, sf_dir)), "monthly", INC_AS_OF)


def _trend_sql(series: str, label: str) -> str:
    return f"""SELECT '{label}' AS period_type, periods, recent, older,
  CASE WHEN periods < 2 THEN 'insufficient_data' WHEN recent > older * 1.1 THEN 'increasing'
       WHEN recent < older * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  round(CASE WHEN periods < 2 THEN 0 WHEN recent > older * 1.1 THEN (recent - older) / older * 100
       WHEN recent < older * 0.9 THEN (older - recent) / older * -100 ELSE 0 END, 6) AS change_percent
FROM (SELECT count(*) AS periods,
        CAST(COALESCE(sum(CASE WHEN rn_new <= 3 THEN count END), 0) AS BIGINT) AS recent_i,
        CAST(COALESCE(sum(CASE WHEN rn_old <= 3 THEN count END), 0) AS BIGINT) AS older_i,
        CAST(recent_i AS DOUBLE) AS recent_d, CAST(older_i AS DOUBLE) AS older_d
      FROM (SELECT period, count, row_number() OVER (ORDER BY period DESC) AS rn_new,
                   row_number() OVER (ORDER BY period ASC) AS rn_old FROM ({series}) s) r) a,
     LATERAL (SELECT recent_i AS recent, older_i AS older) x"""


@query("fine_trends", ("incidents",), f"""
SELECT 'weekly' AS period_type, strftime(date_trunc('week', incident_date), '%Y-%m-%d') AS period, count(*) AS count,
  count_if(severity = 'FATAL') AS fatal_count
FROM incidents WHERE incident_date >= CAST('{INC_AS_OF}' AS TIMESTAMP) - INTERVAL 24 MONTH GROUP BY 1, 2
UNION ALL
SELECT 'daily', strftime(incident_date, '%Y-%m-%d'), count(*), count_if(severity = 'FATAL')
FROM incidents WHERE incident_date >= CAST('{INC_AS_OF}' AS TIMESTAMP) - INTERVAL 24 MONTH GROUP BY 1, 2""")
def fine_trends(spark, sf_dir):
    """E5: weekly and daily series of the last 24 months."""
    inc = A.incidents(_t(spark, sf_dir))
    parts = [AN.period_series(inc, p, INC_AS_OF).withColumn("period_type", F.lit(p)) for p in ("weekly", "daily")]
    return parts[0].unionByName(parts[1])


@query("trend_direction", ("incidents",),
       f"""SELECT period_type, periods, recent, older, trend_direction, change_percent FROM (
SELECT 'yearly' AS period_type, * FROM (
  SELECT periods, recent, older,
    CASE WHEN periods < 2 THEN 'insufficient_data' WHEN rd > od * 1.1 THEN 'increasing'
         WHEN rd < od * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
    round(CASE WHEN periods < 2 THEN 0 WHEN rd > od * 1.1 THEN (rd - od) / od * 100
         WHEN rd < od * 0.9 THEN (od - rd) / od * -100 ELSE 0 END, 6) AS change_percent
  FROM (SELECT count(*) AS periods,
          CAST(COALESCE(sum(CASE WHEN rn_new <= 3 THEN count END), 0) AS BIGINT) AS recent,
          CAST(COALESCE(sum(CASE WHEN rn_old <= 3 THEN count END), 0) AS BIGINT) AS older,
          CAST(COALESCE(sum(CASE WHEN rn_new <= 3 THEN count END), 0) AS DOUBLE) AS rd,
          CAST(COALESCE(sum(CASE WHEN rn_old <= 3 THEN count END), 0) AS DOUBLE) AS od
        FROM (SELECT period, count, row_number() OVER (ORDER BY period DESC) AS rn_new,
                     row_number() OVER (ORDER BY period ASC) AS rn_old FROM ({_YEARLY_SQL}) s) r) a) y
UNION ALL
SELECT 'monthly' AS period_type, * FROM (
  SELECT periods, recent, older,
    CASE WHEN periods < 2 THEN 'insufficient_data' WHEN rd > od * 1.1 THEN 'increasing'
         WHEN rd < od * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
    round(CASE WHEN periods < 2 THEN 0 WHEN rd > od * 1.1 THEN (rd - od) / od * 100
         WHEN rd < od * 0.9 THEN (od - rd) / od * -100 ELSE 0 END, 6) AS change_percent
  FROM (SELECT count(*) AS periods,
          CAST(COALESCE(sum(CASE WHEN rn_new <= 3 THEN count END), 0) AS BIGINT) AS recent,
          CAST(COALESCE(sum(CASE WHEN rn_old <= 3 THEN count END), 0) AS BIGINT) AS older,
          CAST(COALESCE(sum(CASE WHEN rn_new <= 3 THEN count END), 0) AS DOUBLE) AS rd,
          CAST(COALESCE(sum(CASE WHEN rn_old <= 3 THEN count END), 0) AS DOUBLE) AS od
        FROM (SELECT period, count, row_number() OVER (ORDER BY period DESC) AS rn_new,
                     row_number() OVER (ORDER BY period ASC) AS rn_old FROM ({_MONTHLY_SQL}) s) r) a) m
) t""")
def trend_direction(spark, sf_dir):
    inc = A.incidents(_t(spark, sf_dir))
    return (AN.trend_direction(AN.period_series(inc, "yearly", INC_AS_OF), "yearly")
            .unionByName(AN.trend_direction(AN.period_series(inc, "monthly", INC_AS_OF), "monthly")))


@query("severity_by_weather", ("incident_wx",), """
SELECT severity, round(avg(wx_risk), 6) AS avg_weather_risk, round(avg(wx_visibility), 6) AS avg_visibility,
  round(avg(wx_wind), 6) AS avg_wind, count(*) AS count
FROM incident_wx WHERE weather_data IS NOT NULL GROUP BY severity
""")
def severity_by_weather(spark, sf_dir):
    return AN.severity_by_weather(_feat(spark, sf_dir))


@query("safety_kpis", ("incident_wx", "operational_data"), f"""
SELECT * FROM (
  SELECT count(*) AS total_incidents, count_if(severity = 'FATAL') AS fatal_incidents,
    round({_pct_sql("count_if(severity = 'FATAL')", "count(*)")}, 6) AS fatal_rate_percent,
    round({_pct_sql("count_if(severity = 'NONE')", "count(*)")}, 6) AS no_injury_rate_percent,
    round(avg(wx_risk), 6) AS avg_weather_risk FROM incident_wx) i,
  (SELECT count(*) AS total_operations, round(avg(operational_risk_score), 6) AS avg_operational_risk
   FROM operational_data) o,
  (SELECT CAST(15.0 AS DOUBLE) AS fatal_rate_target, CAST(30.0 AS DOUBLE) AS weather_risk_target,
          CAST(25.0 AS DOUBLE) AS operational_risk_target) k
""")
def safety_kpis(spark, sf_dir):
    t = _t(spark, sf_dir)
    return AN.safety_kpis(A.incidents(t), A.operational_data(t))


@query("coverage_counts", ("incidents",), """
SELECT count(*) AS total_incidents, count(weather_data) AS with_weather, count(latitude) AS with_coords,
  count(DISTINCT source) AS sources FROM incidents
""")
def coverage_counts(spark, sf_dir):
    return AN.coverage_counts(A.incidents(_t(spark, sf_dir)))


@query("counts_by_source", ("incidents",),
       "SELECT source, count(*) AS count FROM incidents GROUP BY source")
def counts_by_source(spark, sf_dir):
    return AN.counts_by(A.incidents(_t(spark, sf_dir)), "source")


@query("counts_by_severity", ("incidents",),
       "SELECT severity, count(*) AS count FROM incidents GROUP BY severity")
def counts_by_severity(spark, sf_dir):
    return AN.counts_by(A.incidents(_t(spark, sf_dir)), "severity")


@query("weather_distribution", ("incident_wx",), """
SELECT weather_conditions, wx_type, count(*) AS count, round(avg(wx_risk), 6) AS avg_risk
FROM incident_wx WHERE weather_data IS NOT NULL GROUP BY weather_conditions, wx_type
""")
def weather_distribution(spark, sf_dir):
    return AN.weather_distribution(A.incidents(_t(spark, sf_dir)))


@query("ops_summary", ("operational_data",), """
SELECT count(*) AS records, round(avg(operational_risk_score), 6) AS avg_risk FROM operational_data
""")
def ops_summary(spark, sf_dir):
    return AN.ops_summary(A.operational_data(_t(spark, sf_dir)))


@query("value_distribution", ("incident_features", "airports"), f"""
WITH g AS (
  SELECT 'severity' AS dimension, severity AS value, count(*) AS count FROM incident_features GROUP BY 2
  UNION ALL SELECT 'severity_class', CAST(CASE severity WHEN 'NONE' THEN 0 WHEN 'MINOR' THEN 1
      WHEN 'SERIOUS' THEN 2 WHEN 'FATAL' THEN 3 ELSE 0 END AS VARCHAR), count(*) FROM incident_features GROUP BY 2
  UNION ALL SELECT 'type', type, count(*) FROM airports GROUP BY 2),
c AS (SELECT 'country' AS dimension, country AS value, count(*) AS count FROM incident_features GROUP BY 2),
s AS (SELECT dimension, value, count, {pct6("count", "sum(count) OVER (PARTITION BY dimension)")} AS share_pct
      FROM (SELECT * FROM g UNION ALL SELECT * FROM c) u)
SELECT * FROM s WHERE dimension <> 'country'
UNION ALL
SELECT * FROM (SELECT * FROM s WHERE dimension = 'country' ORDER BY count DESC, value ASC NULLS LAST LIMIT 10)
""")
def value_distribution(spark, sf_dir):
    from wingwatch.functions.incident import severity_class
    t = _t(spark, sf_dir)
    feat = incident_features(A.incidents(t, geo=True)).withColumn("severity_class", severity_class(F.col("severity")))
    ap = dims.airport_projection(A.airports(t))
    return (AN.value_distribution(feat, "severity")
            .unionByName(AN.value_distribution(feat, "severity_class"))
            .unionByName(AN.value_distribution(ap, "type"))
            .unionByName(AN.value_distribution(feat, "country", top_n=10)))


@query("ops_profile", ("operational_data",), """
SELECT round(min(operational_risk_score), 6) AS min_risk, round(max(operational_risk_score), 6) AS max_risk,
  round(avg(operational_risk_score), 6) AS mean_risk, count(DISTINCT aircraft_id) AS unique_aircraft,
  count(DISTINCT flight_id) AS unique_flights, min(date) AS first_date, max(date) AS last_date,
  count_if(operational_risk_score > 70) AS high_risk_count
FROM operational_data
""")
def ops_profile(spark, sf_dir):
    return AN.ops_profile(A.operational_data(_t(spark, sf_dir)))


_NULL_COLS = ["source", "incident_date", "severity", "injuries_serious", "latitude", "longitude",
              "country", "location", "phase_of_flight", "weather_conditions", "weather_data",
              "airport_code", "aircraft_make", "aircraft_model", "probable_cause"]


@query("null_profile", ("incidents",), "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count, "
    f"round({_pct_sql(f'count_if({c} IS NULL)', 'count(*)')}, 6) AS null_pct FROM incidents"
    for c in _NULL_COLS))
def null_profile(spark, sf_dir):
    return AN.null_profile(A.incidents(_t(spark, sf_dir), geo=True), _NULL_COLS)


_MEAN_COLS = ["severity_code", "phase_risk", "total_injuries", "injury_rate", "injury_score",
              "weather_risk", "is_weekend", "has_coordinates"]


@query("feature_means", ("incident_features",), "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean FROM incident_features" for c in _MEAN_COLS))
def feature_means(spark, sf_dir):
    return AN.feature_means(_feat(spark, sf_dir), _MEAN_COLS)


@query("severity_distribution", ("incident_wx",), f"""
SELECT severity, count, avg_risk_score, {pct6("count", "sum(count) OVER ()")} AS percentage
FROM (SELECT severity, count(*) AS count, round(avg(wx_risk), 6) AS avg_risk_score FROM incident_wx GROUP BY severity) g
""")
def severity_distribution(spark, sf_dir):
    return AN.severity_distribution(_feat(spark, sf_dir))


@query("seasonality", ("incident_features",), """
SELECT month, count(*) AS incidents, count_if(severity = 'FATAL') AS fatal
FROM incident_features WHERE month IS NOT NULL GROUP BY month
""")
def seasonality(spark, sf_dir):
    return AN.seasonality(_feat(spark, sf_dir))


@query("weekly_series", ("incident_wx",), f"""
SELECT CAST(date_trunc('week', incident_date) AS DATE) AS week_start, count(*) AS incidents,
  round({_pct_sql("count_if(severity = 'FATAL')", "count(*)")}, 6) AS fatal_rate,
  round(avg(wx_risk), 6) AS avg_risk
FROM incident_wx WHERE incident_date IS NOT NULL GROUP BY 1
""")
def weekly_series(spark, sf_dir):
    return AN.weekly_series(_feat(spark, sf_dir))


@query("region_distribution", ("incidents",), f"""
SELECT region, incidents, {pct6("incidents", "sum(incidents) OVER ()")} AS share_pct
FROM (SELECT COALESCE(regexp_extract(location, ', (.*)$', 1), 'Unknown') AS region, count(*) AS incidents
      FROM incidents GROUP BY 1) g
""")
def region_distribution(spark, sf_dir):
    return AN.region_distribution(A.incidents(_t(spark, sf_dir), geo=True))


_CORR_FACTORS = ["crew_fatigue_index", "fatigue_risk", "maintenance_risk", "schedule_deviation_minutes",
                 "aircraft_age_years", "schedule_risk"]


@query("factor_correlation", ("ops_features",), "\nUNION ALL ".join(
    f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, round(corr({a}, {b}), 6) AS correlation FROM ops_features"
    for i, a in enumerate(_CORR_FACTORS) for b in _CORR_FACTORS[i + 1:]))
def factor_correlation(spark, sf_dir):
    ops = ops_features(A.operational_data(_t(spark, sf_dir)))
    return AN.factor_correlation(ops, _CORR_FACTORS)


@query("kpi_status", ("incident_wx",), f"""
WITH yearly AS (
  SELECT year, {_pct_sql("count_if(severity = 'FATAL')", "count(*)")} AS fatal_rate, round(avg(wx_risk), 6) AS avg_weather_risk
  FROM incident_wx WHERE year IS NOT NULL GROUP BY year),
lng AS (
  SELECT 'SPI-001' AS code, 'fatal_rate' AS name, year, fatal_rate AS value, CAST(15.0 AS DOUBLE) AS target_value FROM yearly
  UNION ALL SELECT 'SPI-002', 'avg_weather_risk', year, avg_weather_risk, CAST(30.0 AS DOUBLE) FROM yearly),
w AS (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY year) AS prev FROM lng)
SELECT code, name, year, round(value, 6) AS value, target_value,
  target_value * CAST(1.2 AS DOUBLE) AS threshold_warning, target_value * CAST(1.5 AS DOUBLE) AS threshold_critical,
  value <= target_value AS target_met,
  CASE WHEN value IS NULL THEN 'NO_DATA' WHEN value <= target_value THEN 'ON_TARGET'
       WHEN value <= target_value * CAST(1.2 AS DOUBLE) THEN 'WARNING' ELSE 'CRITICAL' END AS status,
  CASE WHEN prev IS NULL OR value IS NULL THEN 'stable' WHEN value < prev THEN 'improving'
       WHEN value > prev THEN 'declining' ELSE 'stable' END AS trend_direction
FROM w
""")
def kpi_status(spark, sf_dir):
    return AN.kpi_status(_feat(spark, sf_dir))


@query("period_delta", ("incident_features",), f"""
WITH y AS (SELECT year, count(*) AS incidents,
             {_pct_sql("count_if(severity = 'FATAL')", "count(*)")} AS fatal_rate
           FROM incident_features WHERE year IS NOT NULL GROUP BY year)
SELECT year, incidents, round(fatal_rate, 6) AS fatal_rate,
  round(CAST(incidents - lag(incidents) OVER (ORDER BY year) AS DOUBLE)
        / CAST(lag(incidents) OVER (ORDER BY year) AS DOUBLE) * 100, 6) AS incidents_change_pct,
  round(fatal_rate - lag(fatal_rate) OVER (ORDER BY year), 6) AS fatal_rate_change
FROM y
""")
def period_delta(spark, sf_dir):
    return AN.period_delta(_feat(spark, sf_dir))


@query("incident_page", ("incidents",), """
SELECT p.*, t.total FROM (
  SELECT id, source, CAST(incident_date AS DATE) AS date, severity, location,
    CASE WHEN aircraft_make IS NOT NULL THEN aircraft_make || ' ' || COALESCE(aircraft_model, 'None')
         ELSE 'Unknown' END AS aircraft,
    substring(probable_cause, 1, 200) AS cause
  FROM incidents WHERE severity = 'FATAL' AND source = 'NTSB'
  ORDER BY incident_date DESC NULLS FIRST, id LIMIT 50 OFFSET 10) p,
  (SELECT count(*) AS total FROM incidents WHERE severity = 'FATAL' AND source = 'NTSB') t
""")
def incident_page(spark, sf_dir):
    return AN.incident_page(A.incidents(_t(spark, sf_dir), geo=True), severity="FATAL", source="NTSB",
                            limit=50, offset=10)


@query("incident_page_after", ("incidents",), """
SELECT p.*, t.total FROM (
  SELECT id, source, CAST(incident_date AS DATE) AS date, severity, location,
    CASE WHEN aircraft_make IS NOT NULL THEN aircraft_make || ' ' || COALESCE(aircraft_model, 'None')
         ELSE 'Unknown' END AS aircraft,
    substring(probable_cause, 1, 200) AS cause
  FROM incidents WHERE severity = 'MINOR' AND (incident_date < TIMESTAMP '1997-03-01 00:00:00'
    OR (incident_date = TIMESTAMP '1997-03-01 00:00:00' AND id > 100))
  ORDER BY incident_date DESC, id LIMIT 50) p,
  (SELECT count(*) AS total FROM incidents WHERE severity = 'MINOR') t
""")
def incident_page_after(spark, sf_dir):
    """B3/G2 by key: the page behind the last row seen."""
    return AN.incident_page(A.incidents(_t(spark, sf_dir), geo=True), severity="MINOR", limit=50, after=("1997-03-01 00:00:00", 100))


@query("enrichment_backlog", ("incidents",), """
SELECT count_if(latitude IS NOT NULL AND longitude IS NOT NULL AND weather_data IS NULL) AS weather_fetch_backlog,
  count_if(weather_data IS NULL) AS weather_generate_backlog,
  count_if(airport_code IS NOT NULL AND (latitude IS NULL OR longitude IS NULL)) AS airport_coord_backlog,
  count_if(aircraft_make IS NOT NULL) AS aircraft_match_candidates
FROM incidents
""")
def enrichment_backlog(spark, sf_dir):
    return AN.enrichment_backlog(A.incidents(_t(spark, sf_dir)))


@query("analytics_query", ("incident_features",), f"""
SELECT 'fatal_rate' AS metric, strftime(incident_date, '%Y-%m') AS period,
  round({_pct_sql("count_if(severity = 'FATAL')", "count(*)")}, 6) AS value
FROM incident_features
WHERE incident_date >= TIMESTAMP '2000-01-01' AND incident_date < TIMESTAMP '2001-01-01'
GROUP BY 2
""")
def analytics_query(spark, sf_dir):
    return AN.analytics_query(_feat(spark, sf_dir), "2000-01-01", "2000-12-31", "fatal_rate")


@query("top_risk", ("ops_features",), """
SELECT id, aircraft_id, date, round(operational_risk_score, 9) AS operational_risk_score,
  round(fatigue_risk, 9) AS fatigue_risk, round(maintenance_risk, 9) AS maintenance_risk,
  round(schedule_risk, 9) AS schedule_risk
FROM ops_features ORDER BY operational_risk_score DESC, id LIMIT 10
""")
def top_risk(spark, sf_dir):
    ops = ops_features(A.operational_data(_t(spark, sf_dir)))
    top = AN.top_k(ops, "operational_risk_score", 10)
    return top.select("id", "aircraft_id", "date",
                      *[F.round(c, 9).alias(c) for c in
                        ("operational_risk_score", "fatigue_risk", "maintenance_risk", "schedule_risk")])


@query("top_injury", ("incident_features",), """
SELECT id, severity, injury_score FROM incident_features WHERE injury_score IS NOT NULL ORDER BY injury_score DESC, id LIMIT 10""")
def top_injury(spark, sf_dir):
    """Incidents have no operational score, so the injury score ranks them."""
    return AN.riskiest(_feat(spark, sf_dir), 10).select("id", "severity", "injury_score")


@query("alert_feed", ("ops_features",), """
SELECT id, date, aircraft_id,
  CASE WHEN COALESCE(crew_fatigue_index > 80, FALSE) THEN 'Fatigue Warning'
       WHEN COALESCE(maintenance_risk > 60, FALSE) THEN 'Maintenance Due'
       WHEN COALESCE(operational_risk_score > 70, FALSE) THEN 'High Operational Risk' END AS alert_type,
  CASE WHEN operational_risk_score >= 75 THEN 'CRITICAL' WHEN operational_risk_score >= 50 THEN 'HIGH'
       WHEN operational_risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  round(operational_risk_score, 6) AS operational_risk_score
FROM ops_features
WHERE COALESCE(crew_fatigue_index > 80, FALSE) OR COALESCE(maintenance_risk > 60, FALSE)
   OR COALESCE(operational_risk_score > 70, FALSE)
""")
def alert_feed(spark, sf_dir):
    return AN.alert_feed(ops_features(A.operational_data(_t(spark, sf_dir))))
