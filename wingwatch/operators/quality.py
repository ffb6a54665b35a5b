"""Data-quality validation.

Design: every check is a pair of aggregate expressions ``(checked, failed)``.
Which checks exist is decided at plan time from ``df.columns`` (a missing
column skips the check, except required fields, which then fail fully).  All
pairs plus the completeness counts are computed in ONE ``agg`` over the data
(partial + final hash aggregate, one shuffle of one row per task).  The long
report and the scores are then derived from that single row, so the table is
scanned once no matter how many checks there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wingwatch.functions import constants as K


@dataclass
class Check:
    name: str
    checked: Column          # aggregate expression
    failed: Column           # aggregate expression
    drop_if_unchecked: bool = False


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _not_in(col: Column, values: list) -> Column:
    """pandas ``~isin``: NULL is *not* in the list (trap T1)."""
    return ~F.coalesce(col.isin(*values), F.lit(False))


def _as_timestamp(df: DataFrame, name: str) -> Column:
    """``pd.to_datetime(errors='coerce')``: unparseable text becomes NULL."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp_ntz")


def incident_checks(df: DataFrame, as_of: str) -> list[Check]:
    cols = set(df.columns)
    n = F.count(F.lit(1))
    checks: list[Check] = []
    for field in K.INCIDENT_REQUIRED:                                   # V1
        if field in cols:
            checks.append(Check(f"required_field_{field}", n, _count_if(F.col(field).isNull())))
        else:
            checks.append(Check(f"required_field_{field}", n, n))
    if "source" in cols:                                                # V2
        checks.append(Check("valid_source", n, _count_if(_not_in(F.col("source"), K.VALID_SOURCES))))
    if "severity" in cols:                                              # V3
        checks.append(Check("valid_severity", n,
                            _count_if(_not_in(F.col("severity"), K.VALID_SEVERITIES))))
    if "incident_date" in cols:                                         # V4
        d = _as_timestamp(df, "incident_date")
        as_of_ts = F.lit(as_of).cast("timestamp_ntz")
        failed = (_count_if(d.isNull()) + _count_if(d > as_of_ts)
                  + _count_if(d < F.lit(K.EARLIEST_VALID_DATE).cast("timestamp_ntz")))
        checks.append(Check("valid_dates", n, failed))
    injury = ["injuries_fatal", "injuries_serious", "injuries_minor"]
    if all(c in cols for c in injury):
        if "severity" in cols:                                          # V5
            fatal = F.col("severity") == "FATAL"
            checks.append(Check(
                "injury_severity_consistency", _count_if(fatal),
                _count_if(fatal & (F.coalesce(F.col("injuries_fatal"), F.lit(0)) == 0))))
        for c in injury:                                                # V6
            checks.append(Check(f"non_negative_{c}", n,
                                _count_if(F.coalesce(F.col(c), F.lit(0)) < 0)))
    if "latitude" in cols and "longitude" in cols:                      # V7 (trap T3)
        lat, lon = F.col("latitude"), F.col("longitude")
        bad_lat = lat.isNotNull() & ((lat < -90) | (lat > 90))
        bad_lon = lon.isNotNull() & ((lon < -180) | (lon > 180))
        checks.append(Check("valid_coordinates", _count_if(lat.isNotNull() & lon.isNotNull()),
                            _count_if(bad_lat | bad_lon), drop_if_unchecked=True))
    if "phase_of_flight" in cols:                                       # V8
        ph = F.col("phase_of_flight")
        checks.append(Check("valid_flight_phase", F.count(ph),
                            _count_if(ph.isNotNull() & _not_in(ph, K.VALID_PHASES))))
    return checks


def ops_checks(df: DataFrame) -> list[Check]:
    cols = set(df.columns)
    n = F.count(F.lit(1))
    checks: list[Check] = []
    for field in K.OPS_REQUIRED:                                        # V11
        if field in cols:
            checks.append(Check(f"required_{field}", n, _count_if(F.col(field).isNull())))
        else:
            checks.append(Check(f"required_{field}", n, n))
    for field, lo, hi in K.OPS_RANGES:                                  # V12
        if field in cols:
            v = F.col(field)
            checks.append(Check(f"range_{field}", n,
                                _count_if(v.isNotNull() & ~((v >= lo) & (v <= hi)))))
    if "date" in cols:                                                  # V13
        checks.append(Check("valid_date", n, _count_if(_as_timestamp(df, "date").isNull())))
    return checks


def measure(df: DataFrame, checks: list[Check], important: list[str]) -> DataFrame:
    """The single aggregation pass: one row with every count the report needs."""
    present = [f for f in important if f in df.columns]
    aggs = [F.count(F.lit(1)).alias("total_records")]
    for i, c in enumerate(checks):
        aggs += [c.checked.cast("bigint").alias(f"c{i}"), c.failed.cast("bigint").alias(f"f{i}")]
    aggs += [F.count(F.col(f)).alias(f"nn{j}") for j, f in enumerate(present)]
    row = df.agg(*aggs)
    entries = []
    for i, c in enumerate(checks):
        checked, failed = F.col(f"c{i}"), F.col(f"f{i}")
        keep = F.lit(True) if not c.drop_if_unchecked else checked > 0
        entries.append(F.struct(
            F.lit(i).alias("check_order"), F.lit(c.name).alias("check_name"),
            (failed == 0).alias("is_valid"), checked.alias("records_checked"),
            (checked - failed).alias("records_passed"), failed.alias("records_failed"),
            F.when(checked == 0, F.lit(0.0))
             .otherwise((checked - failed).cast("double") / checked.cast("double") * 100.0)
             .alias("pass_rate"),
            keep.alias("keep")))
    total = F.col("total_records")
    completeness = [F.when(total > 0, F.col(f"nn{j}").cast("double") / total.cast("double") * 100.0)
                    .otherwise(F.lit(None).cast("double")) for j in range(len(present))]
    return row.select(
        "total_records",
        F.filter(F.array(*entries), lambda e: e["keep"]).alias("checks"),
        (F.array(*completeness) if completeness else F.array().cast("array<double>"))
        .alias("completeness_parts"))


def _mean(arr: Column, default: float) -> Column:
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, s / F.size(arr)).otherwise(F.lit(default))


def report_long(measured: DataFrame) -> DataFrame:
    """V1-V8 / V11-V13 long report, one row per check."""
    return (measured.select(F.inline("checks"))
            .drop("keep"))


def scores(measured: DataFrame, source: str, kind: str) -> DataFrame:
    """V9/V10 (incidents) or V14 (operational) scores, one row."""
    rates = F.transform("checks", lambda e: e["pass_rate"])
    valid_rates = F.transform(F.filter("checks", lambda e: e["check_name"].startswith("valid_")),
                              lambda e: e["pass_rate"])
    parts = F.filter("completeness_parts", lambda x: x.isNotNull())
    completeness = _mean(parts, 0.0)
    consistency = _mean(rates, 0.0)
    if kind == "incidents":
        accuracy = _mean(valid_rates, 100.0)
        overall = completeness * 0.3 + consistency * 0.4 + accuracy * 0.3
    else:
        accuracy = consistency
        overall = (completeness + consistency * 2) / 3
    return measured.select(
        F.lit(source).alias("source"), F.col("total_records"),
        completeness.alias("completeness_score"), consistency.alias("consistency_score"),
        accuracy.alias("accuracy_score"), overall.alias("overall_score"), F.col("checks"))


def validate_incidents(df: DataFrame, as_of: str) -> DataFrame:
    return scores(measure(df, incident_checks(df, as_of), K.INCIDENT_IMPORTANT),
                  "incidents", "incidents")


def validate_ops(df: DataFrame) -> DataFrame:
    return scores(measure(df, ops_checks(df), K.OPS_IMPORTANT), "operational_data", "ops")


def nested_report(scored: DataFrame) -> DataFrame:
    """Checks as a nested array plus the first five failed check names."""
    failed = F.filter("checks", lambda e: ~e["is_valid"])
    return scored.select(
        "source", "total_records", "completeness_score", "consistency_score", "accuracy_score",
        "overall_score",
        F.transform("checks", lambda e: F.struct(
            e["check_name"].alias("check_name"), e["is_valid"].alias("is_valid"),
            e["pass_rate"].alias("pass_rate"), e["records_failed"].alias("records_failed")))
        .alias("validations"),
        F.slice(F.transform(failed, lambda e: e["check_name"]), 1, 5).alias("failed_checks"),
        F.size(failed).alias("failed_check_count"))


def dq_log_row(scored: DataFrame, run_date: str) -> DataFrame:
    """The appended log row; record counts truncate like ``int()``."""
    total = F.col("total_records").cast("double")
    ov = F.col("overall_score")
    return scored.select(
        F.lit(run_date).cast("date").alias("run_date"), "source",
        F.col("total_records").cast("bigint").alias("total_records"),
        (total * ov / 100.0).cast("bigint").alias("valid_records"),
        (total * (1 - ov / 100.0)).cast("bigint").alias("invalid_records"),
        "completeness_score", "consistency_score", "accuracy_score", "overall_score",
        F.lit(None).cast("string").alias("validation_errors"))
