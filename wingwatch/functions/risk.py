"""Risk labels, factor arrays and request constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.functions.ops import clip

# ---- FIXED VALUES: request field constraints (field, lo, hi, required) ------
ANOMALY_REQUEST_RULES = [
    ("operational_risk_score", 0.0, 100.0, True),
    ("fatigue_risk", 0.0, 100.0, True),
    ("maintenance_risk", 0.0, 100.0, True),
    ("schedule_risk", 0.0, 100.0, False),
    ("crew_duty_hours", 0.0, 20.0, False),
    ("crew_rest_hours", 0.0, 48.0, False),
    ("turnaround_time_mins", 0.0, None, False),
]
RISK_REQUEST_RULES = [
    ("incident_year", 1980, 2030, True),
    ("incident_month", 1, 12, True),
    ("incident_day_of_week", 0, 6, True),
    ("is_weekend", 0, 1, False),
    ("severity_code", 0, 3, False),
    ("phase_risk_factor", 0.5, 2.0, False),
    ("total_injuries", 0, None, False),
    ("injury_rate", 0.0, None, False),
    ("has_coordinates", 0, 1, False),
    ("is_us", 0, 1, False),
    ("weather_risk_score", 0.0, 100.0, False),
]

SEVERITY_REQUEST_RULES = [
    ("weather_risk_score", 0.0, 100.0, False),
    ("crew_fatigue_index", 0.0, 100.0, False),
    ("maintenance_risk", 0.0, 100.0, False),
    ("aircraft_age_years", 0, 60, False),
    ("visibility_m", 0.0, None, False),
    ("wind_speed_kt", 0.0, None, False),
    ("crew_experience_hours", 0, None, False),
]
RECOMMENDATION_REQUEST_RULES = [
    ("weather_risk_score", 0.0, 100.0, False),
    ("visibility_m", 0.0, None, False),
    ("wind_speed_kt", 0.0, None, False),
    ("crew_fatigue_index", 0.0, 100.0, False),
    ("crew_duty_hours", 0.0, 20.0, False),
    ("maintenance_risk", 0.0, 100.0, False),
    ("maintenance_overdue_flag", 0, 1, False),
    ("turnaround_time_mins", 0.0, None, False),
    ("injury_score", 0.0, None, False),
    ("severity_code", 0, 3, False),
]


def risk_level(score: Column) -> Column:
    """>=75 CRITICAL, >=50 HIGH, >=25 MEDIUM, else LOW."""
    expr = None
    for bound, label in K.RISK_LEVELS:
        expr = F.when(score >= bound, label) if expr is None else expr.when(score >= bound, label)
    return expr.otherwise(K.RISK_LEVEL_DEFAULT)


def clamp_score(score: Column) -> Column:
    """Clamp a model score to 0..100."""
    return clip(score, 0.0, 100.0)


def contributing_factors(df: DataFrame) -> Column:
    """Ordered factor labels over their thresholds, or the no-factor label."""
    items = [F.when(F.col(c) > t, F.lit(label)) for c, t, label in K.ANOMALY_FACTORS if c in df.columns]
    arr = F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    return F.when(F.size(arr) == 0, F.array(F.lit(K.NO_FACTORS))).otherwise(arr)


def approx_percentile(score: Column) -> Column:
    """The API's approximate percentile 50 + 50 * score."""
    return 50.0 + score * 50.0


def heuristic_risk(weather: Column, fatigue: Column, maintenance: Column, is_night: Column,
                   aircraft_age: Column) -> Column:
    """.35 weather + .25 fatigue + .2 maintenance + 10 night + age/2, clip 0-100."""
    r = (weather * 0.35 + fatigue * 0.25 + maintenance * 0.2
         + F.when(is_night, F.lit(10.0)).otherwise(F.lit(0.0)) + aircraft_age / 2.0)
    return clip(r, 0.0, 100.0)


def heuristic_anomaly(risk: Column, fatigue: Column, maintenance: Column) -> Column:
    """Anomaly when risk > 70 or fatigue > 80 or maintenance > 60."""
    return F.coalesce((risk > 70) | (fatigue > 80) | (maintenance > 60), F.lit(False))


def direction(contribution: Column) -> Column:
    """A positive contribution raises risk."""
    return F.when(contribution > 0, "increases risk").otherwise("decreases risk")


def constraint_violations(df: DataFrame, rules) -> Column:
    """Names of violated range rules (missing required field, below lo,
    above hi).  Absent optional columns take their defaults and pass."""
    checks = []
    for field, lo, hi, required in rules:
        if field not in df.columns:
            if required:
                checks.append(F.lit(f"missing:{field}"))
            continue
        v = F.col(field)
        if required:
            checks.append(F.when(v.isNull(), F.lit(f"missing:{field}")))
        if lo is not None:
            checks.append(F.when(v < lo, F.lit(f"below_min:{field}")))
        if hi is not None:
            checks.append(F.when(v > hi, F.lit(f"above_max:{field}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
