"""Operational risk expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col, F.lit(hi)), F.lit(lo))


def fatigue_risk(duty: Column, rest: Column) -> Column:
    """clip(duty/16 * (1 - rest/12), 0, 1) * 100, NULL hours -> 8."""
    d = F.coalesce(duty.cast("double"), F.lit(8.0))
    r = F.coalesce(rest.cast("double"), F.lit(8.0))
    return clip((d / 16.0) * (1 - r / 12.0), 0.0, 1.0) * 100.0


def maintenance_risk(overdue: Column, items: Column, age: Column) -> Column:
    """overdue*30 + clip(items*5, 0, 40) + clip(age (NULL->10), 0, 30)."""
    od = F.coalesce(overdue.cast("int"), F.lit(0)) * 30
    it = clip(F.coalesce(items, F.lit(0)) * 5, 0, 40)
    ag = clip(F.coalesce(age.cast("double"), F.lit(10.0)), 0.0, 30.0)
    return od.cast("double") + it.cast("double") + ag


def schedule_risk(deviation: Column, turnaround: Column) -> Column:
    """clip(|dev|/60*10, 0, 30) + 20 when turnaround (NULL->60) < 30."""
    dev = clip(F.abs(F.coalesce(deviation, F.lit(0))).cast("double") / 60.0 * 10.0, 0.0, 30.0)
    rushed = F.when(F.coalesce(turnaround, F.lit(60)) < 30, F.lit(20.0)).otherwise(F.lit(0.0))
    return dev + rushed


def combined_risk(fatigue: Column, maintenance: Column, schedule: Column) -> Column:
    """0.4 fatigue + 0.4 maintenance + 0.2 schedule."""
    return fatigue * 0.4 + maintenance * 0.4 + schedule * 0.2


def ops_features(df: DataFrame) -> DataFrame:
    """C7-C10 (``OperationalTransformer.transform``).

    The blend overwrites ``operational_risk_score`` like the reference does;
    the incoming value is kept as ``source_risk_score``.
    """
    if "operational_risk_score" in df.columns:
        df = df.withColumnRenamed("operational_risk_score", "source_risk_score")
    fat = fatigue_risk(F.col("crew_duty_hours"), F.col("crew_rest_hours"))
    mnt = maintenance_risk(F.col("maintenance_overdue_flag"), F.col("open_maintenance_items"),
                           F.col("aircraft_age_years"))
    sch = schedule_risk(F.col("schedule_deviation_minutes"), F.col("turnaround_time_minutes"))
    df = df.withColumns({"fatigue_risk": fat, "maintenance_risk": mnt, "schedule_risk": sch})
    return df.withColumn("operational_risk_score",
                         combined_risk(F.col("fatigue_risk"), F.col("maintenance_risk"),
                                       F.col("schedule_risk")))


def crew_fatigue_index(duty: Column, rest: Column) -> Column:
    """clip(20 + duty/14*30 + max(0, 10-rest)*5, 0, 100) (noise term dropped)."""
    base = 20.0 + duty / 14.0 * 30.0 + F.greatest(F.lit(0.0), 10.0 - rest) * 5.0
    return clip(base, 0.0, 100.0)


def source_composite_risk(fatigue_index: Column, overdue: Column, items: Column, age: Column,
                          deviation: Column, turnaround: Column) -> Column:
    """generator's composite risk, clip 0-100 (noise term dropped)."""
    r = (fatigue_index * 0.3
         + F.when(overdue, F.lit(20.0)).otherwise(F.lit(0.0))
         + items / 10.0 * 10.0
         + F.least(age / 30.0 * 10.0, F.lit(10.0))
         + F.least(F.abs(deviation) / 60.0 * 15.0, F.lit(15.0))
         + F.when(turnaround < 45, F.lit(10.0)).otherwise(F.lit(0.0)))
    return F.round(clip(r, 0.0, 100.0), 1)


def actual_departure(scheduled: Column, deviation_minutes: Column) -> Column:
    """Scheduled + deviation minutes."""
    return F.timestamp_add("MINUTE", deviation_minutes, scheduled)
