"""Incident feature expressions.

Every function is ``Column -> Column`` or a ``DataFrame -> DataFrame`` made of
one projection, so the whole feature set compiles into a single whole-stage
codegen span after the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.functions import constants as K


def _sql_lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(col: Column | str, mapping: dict, default=None) -> Column:
    """Small constant map lookup as a CASE (stays inside codegen).

    Given a column *name* the CASE is built as SQL text: one parse instead of
    one JVM call per branch when the plan is constructed.
    """
    if isinstance(col, str):
        parts = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(v)}" for k, v in mapping.items())
        tail = f" ELSE {_sql_lit(default)}" if default is not None else ""
        return F.expr(f"CASE `{col}` {parts}{tail} END")
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(col == key, F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 int; NULL counts as 0 (pandas ``astype(int)``)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def date_features(date: Column) -> dict[str, Column]:
    """Year, month, Monday=0 day_of_week, day_of_year, quarter, flags."""
    dow = F.weekday(date)
    return {
        "year": F.year(date).cast("int"),
        "month": F.month(date).cast("int"),
        "day_of_week": dow.cast("int"),
        "day_of_year": F.dayofyear(date).cast("int"),
        "quarter": F.quarter(date).cast("int"),
        "is_weekend": flag(dow >= 5),
        "is_holiday_season": flag(F.month(date).isin(*K.HOLIDAY_MONTHS)),
    }


def severity_code(severity: Column | str) -> Column:
    """NONE 0 / MINOR 1 / SERIOUS 3 / FATAL 5, unmapped 0."""
    return lookup(severity, K.SEVERITY_WEIGHTS, 0).cast("int")


def severity_class(severity: Column | str) -> Column:
    """Classifier encoding NONE 0 / MINOR 1 / SERIOUS 2 / FATAL 3, unmapped 0."""
    return lookup(severity, K.SEVERITY_CLASSES, 0).cast("int")


def phase_risk(phase: Column | str) -> Column:
    """Phase risk weight, unknown/NULL -> 1.0."""
    return lookup(phase, K.PHASE_RISK, K.PHASE_RISK_DEFAULT).cast("double")


def injury_columns(fatal: Column, serious: Column, minor: Column,
                   uninjured: Column) -> dict[str, Column]:
    """C4: totals, rate and weighted score; NULL counts as 0."""
    f, s, m, u = (F.coalesce(c, F.lit(0)) for c in (fatal, serious, minor, uninjured))
    total = f + s + m
    people = total + u
    return {
        "total_injuries": total.cast("int"),
        "total_people": people.cast("int"),
        "injury_rate": F.when(people > 0, total.cast("double") / people.cast("double"))
                        .otherwise(F.lit(0.0)),
        "injury_score": (f * 5 + s * 3 + m).cast("int"),
    }


def weather_risk(conditions: Column | str) -> Column:
    """VMC 0.3 / IMC 0.8 / else 0.5."""
    return lookup(conditions, K.WEATHER_CONDITION_RISK,
                  K.WEATHER_CONDITION_RISK_DEFAULT).cast("double")


def incident_features(df: DataFrame) -> DataFrame:
    """C1-C6 in one projection (``IncidentTransformer.transform``)."""
    cols = dict(date_features(F.col("incident_date")))
    cols["severity_code"] = severity_code("severity")
    cols["is_serious"] = flag(F.col("severity").isin("SERIOUS", "FATAL"))
    cols["phase_risk"] = phase_risk("phase_of_flight")
    cols.update(injury_columns(F.col("injuries_fatal"), F.col("injuries_serious"),
                               F.col("injuries_minor"), F.col("injuries_uninjured")))
    cols["has_coordinates"] = (F.col("latitude").isNotNull()
                               & F.col("longitude").isNotNull()).cast("int")
    if "country" in df.columns:
        cols["is_us"] = flag(F.col("country") == "USA")
    cols["weather_risk"] = weather_risk("weather_conditions")
    return df.withColumns(cols)
