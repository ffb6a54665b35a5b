"""Feature queries (C1-C10) and the minimum slice E1."""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions.incident import incident_features
from wingwatch.functions.ops import ops_features
from wingwatch.operators import analytics as AN
from wingwatch.plans.catalog import query
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables


def incident_feature_frame(spark, sf_dir):
    return incident_features(A.incidents(Tables(spark, sf_dir), geo=True))


def ops_feature_frame(spark, sf_dir):
    return ops_features(A.operational_data(Tables(spark, sf_dir)))


@query("monthly_incident_profile", ("incident_features",), """
SELECT year, month,
  round(avg(severity_code), 6) AS avg_severity,
  CAST(max(severity_code) AS BIGINT) AS max_severity,
  CAST(count(severity_code) AS BIGINT) AS incident_count,
  CAST(sum(is_serious) AS BIGINT) AS serious_count,
  CAST(sum(injury_score) AS BIGINT) AS total_injury_score,
  round(avg(phase_risk), 6) AS avg_phase_risk,
  round(avg(weather_risk), 6) AS avg_weather_risk
FROM incident_features WHERE year IS NOT NULL AND month IS NOT NULL
GROUP BY year, month
""")
def monthly_incident_profile(spark, sf_dir):
    return AN.monthly_incident_profile(incident_feature_frame(spark, sf_dir))


@query("incident_date_features", ("incident_features",), """
SELECT id, year, month, day_of_week, day_of_year, quarter, is_weekend, is_holiday_season
FROM incident_features
""")
def incident_date_features(spark, sf_dir):
    return incident_feature_frame(spark, sf_dir).select(
        "id", "year", "month", "day_of_week", "day_of_year", "quarter", "is_weekend",
        "is_holiday_season")


@query("incident_features", ("incident_features",), """
SELECT id, severity_code, is_serious, phase_risk, total_injuries, total_people,
  round(injury_rate, 9) AS injury_rate, injury_score, has_coordinates, is_us, weather_risk
FROM incident_features
""")
def incident_features_q(spark, sf_dir):
    return incident_feature_frame(spark, sf_dir).select(
        "id", "severity_code", "is_serious", "phase_risk", "total_injuries", "total_people",
        F.round("injury_rate", 9).alias("injury_rate"), "injury_score", "has_coordinates",
        "is_us", "weather_risk")


@query("ops_features", ("ops_features",), """
SELECT id, round(fatigue_risk, 9) AS fatigue_risk, round(maintenance_risk, 9) AS maintenance_risk,
  round(schedule_risk, 9) AS schedule_risk, round(operational_risk_score, 9) AS operational_risk_score,
  source_risk_score
FROM ops_features
""")
def ops_features_q(spark, sf_dir):
    return ops_feature_frame(spark, sf_dir).select(
        "id", *[F.round(c, 9).alias(c) for c in
                ("fatigue_risk", "maintenance_risk", "schedule_risk", "operational_risk_score")],
        "source_risk_score")
