"""Served aggregates from a rollup by day, source and severity.

The rollup is kept current by the incremental job (K1): each batch takes the old rows of corrected
incidents out and adds their new ones, in whole numbers and decimals, so a correction leaves no trace.
The dashboard reads the rollup, a few rows a day, instead of the incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.operators.analytics import pct
from wingwatch.sources.sinks import Rollup


def incident_rollup(path: str) -> Rollup:
    """Rows, injury score, serious injuries and weather risk by (day, source, severity), in a folder a year."""
    return Rollup(path, {"day": F.col("incident_date").cast("date"), "source": F.col("source"), "severity": F.col("severity"), "year": F.col("year")},
                  {"injury_score": F.coalesce(F.col("injury_score"), F.lit(0)).cast("decimal(20,0)"),
                   "serious": F.coalesce(F.col("is_serious"), F.lit(0)).cast("long"),
                   "weather_risk": F.coalesce(F.col("weather_risk"), F.lit(0.0)).cast("decimal(28,6)")}, "year")


def _rows(cond: Column | None = None) -> Column:
    n = F.col("rows") if cond is None else F.when(cond, F.col("rows"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def _mean(total: str) -> Column:
    """Sum over rows, rounded half up to six places."""
    return F.round(F.sum(total).cast("decimal(38,12)") / F.nullif(F.sum("rows"), F.lit(0)).cast("decimal(18,0)"), 6).cast("double")


def dashboard_summary(rollup: DataFrame) -> DataFrame:
    """E2 from the rollup."""
    sev, src = F.col("severity"), F.col("source")
    return rollup.agg(
        _rows().alias("total"), *[_rows(sev == s).alias(n) for s, n in (("FATAL", "fatal"), ("SERIOUS", "serious"), ("MINOR", "minor"), ("NONE", "none_count"))],
        _rows(src == "NTSB").alias("ntsb"), _rows(src == "ASRS").alias("asrs"), pct(_rows(sev == "FATAL"), _rows()).alias("fatal_rate"),
        _mean("injury_score").alias("avg_injury_score"))


def monthly_trend(rollup: DataFrame, as_of: str, months_back: int = 24) -> DataFrame:
    """E4 from the rollup: incidents and fatal ones a month, newest first."""
    since = F.add_months(F.lit(as_of).cast("date"), -months_back)
    return (rollup.filter(F.col("day") >= since).groupBy(F.date_format("day", "yyyy-MM").alias("period"))
            .agg(_rows().alias("count"), _rows(F.col("severity") == "FATAL").alias("fatal_count")).orderBy(F.desc("period")).limit(months_back))


def incident_kpis(rollup: DataFrame) -> DataFrame:
    """E7, incident half, from the rollup."""
    sev = F.col("severity")
    return rollup.agg(_rows().alias("total_incidents"), _rows(sev == "FATAL").alias("fatal_incidents"),
                      pct(_rows(sev == "FATAL"), _rows()).alias("fatal_rate_percent"), pct(_rows(sev == "NONE"), _rows()).alias("no_injury_rate_percent"),
                      F.coalesce(F.sum("serious"), F.lit(0)).cast("long").alias("serious_incidents"), _mean("weather_risk").alias("avg_weather_risk"))


def value_counts(rollup: DataFrame, key: str) -> DataFrame:
    """E9 from the rollup: rows by source or severity."""
    return rollup.groupBy(key).agg(_rows().alias("count")).orderBy(F.desc("count"), key)

