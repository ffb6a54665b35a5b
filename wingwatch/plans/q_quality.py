"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.operators import quality as Q
from wingwatch.plans.catalog import query
from wingwatch.sources import adapters as A
from wingwatch.sources.tables import Tables

INCIDENTS_AS_OF = "2001-07-01"
OPS_AS_OF = "2001-11-04"


def _lst(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _checks_sql(table: str, checks: list[tuple[str, str, str]], drop_unchecked: str = "") -> str:
    """Oracle: one aggregate row, then one UNION ALL branch per check."""
    aggs = ",\n    ".join(f"CAST({c} AS BIGINT) AS c{i}, CAST({f} AS BIGINT) AS f{i}"
                          for i, (_, c, f) in enumerate(checks))
    branches = "\n  UNION ALL ".join(
        f"SELECT {i} AS check_order, '{name}' AS check_name, c{i} AS records_checked, "
        f"f{i} AS records_failed FROM m" for i, (name, _, _) in enumerate(checks))
    where = f"WHERE NOT (check_name = '{drop_unchecked}' AND records_checked = 0)" if drop_unchecked else ""
    return f""", m AS (SELECT count(*) AS n,
    {aggs}
  FROM {table}),
checks AS (SELECT * FROM ({branches}) x {where}),
report AS (
  SELECT check_order, check_name, records_failed = 0 AS is_valid, records_checked,
    records_checked - records_failed AS records_passed, records_failed,
    CASE WHEN records_checked = 0 THEN CAST(0 AS DOUBLE)
         ELSE CAST(records_checked - records_failed AS DOUBLE) / CAST(records_checked AS DOUBLE) * 100 END AS pass_rate
  FROM checks)
"""


_INC_CHECKS = [
    ("required_field_source", "count(*)", "count_if(source IS NULL)"),
    ("required_field_incident_date", "count(*)", "count_if(incident_date IS NULL)"),
    ("required_field_severity", "count(*)", "count_if(severity IS NULL)"),
    ("valid_source", "count(*)", f"count_if(source IS NULL OR source NOT IN ({_lst(K.VALID_SOURCES)}))"),
    ("valid_severity", "count(*)",
     f"count_if(severity IS NULL OR severity NOT IN ({_lst(K.VALID_SEVERITIES)}))"),
    ("valid_dates", "count(*)",
     f"count_if(incident_date IS NULL) + count_if(incident_date > TIMESTAMP '{INCIDENTS_AS_OF}') "
     f"+ count_if(incident_date < TIMESTAMP '1950-01-01')"),
    ("injury_severity_consistency", "count_if(severity = 'FATAL')",
     "count_if(severity = 'FATAL' AND COALESCE(injuries_fatal, 0) = 0)"),
    ("non_negative_injuries_fatal", "count(*)", "count_if(COALESCE(injuries_fatal, 0) < 0)"),
    ("non_negative_injuries_serious", "count(*)", "count_if(COALESCE(injuries_serious, 0) < 0)"),
    ("non_negative_injuries_minor", "count(*)", "count_if(COALESCE(injuries_minor, 0) < 0)"),
    ("valid_coordinates", "count_if(latitude IS NOT NULL AND longitude IS NOT NULL)",
     "count_if((latitude IS NOT NULL AND (latitude < -90 OR latitude > 90)) OR "
     "(longitude IS NOT NULL AND (longitude < -180 OR longitude > 180)))"),
    ("valid_flight_phase", "count(phase_of_flight)",
     f"count_if(phase_of_flight IS NOT NULL AND phase_of_flight NOT IN ({_lst(K.VALID_PHASES)}))"),
]
_INC_SQL = _checks_sql("incidents", _INC_CHECKS, "valid_coordinates")
_INC_COMPLETE = " + ".join(f"count({f})" for f in K.INCIDENT_IMPORTANT)
_INC_SCORES = f""", s AS (
  SELECT (SELECT n FROM m) AS total_records,
    (SELECT CAST({_INC_COMPLETE} AS DOUBLE) / {len(K.INCIDENT_IMPORTANT)} / count(*) * 100 FROM incidents) AS completeness_score,
    (SELECT avg(pass_rate) FROM report) AS consistency_score,
    (SELECT COALESCE(avg(pass_rate), 100) FROM report WHERE check_name LIKE 'valid\\_%' ESCAPE '\\') AS accuracy_score)
"""

_OPS_CHECKS = [
    ("required_date", "count(*)", "count_if(date IS NULL)"),
    ("required_aircraft_id", "count(*)", "count_if(aircraft_id IS NULL)"),
] + [
    (f"range_{f}", "count(*)", f"count_if({f} IS NOT NULL AND NOT ({f} >= {lo} AND {f} <= {hi}))")
    for f, lo, hi in K.OPS_RANGES
] + [("valid_date", "count(*)", "count_if(date IS NULL)")]
_OPS_SQL = _checks_sql("operational_data", _OPS_CHECKS)
_OPS_COMPLETE = " + ".join(f"count({f})" for f in K.OPS_IMPORTANT)
_OPS_SCORES = f""", s AS (
  SELECT (SELECT n FROM m) AS total_records,
    (SELECT CAST({_OPS_COMPLETE} AS DOUBLE) / {len(K.OPS_IMPORTANT)} / count(*) * 100 FROM operational_data) AS completeness_score,
    (SELECT avg(pass_rate) FROM report) AS consistency_score)
"""

_REPORT_COLS = """SELECT check_order, check_name, is_valid, records_checked, records_passed,
  records_failed, round(pass_rate, 6) AS pass_rate FROM report"""


def _inc_scored(spark, sf_dir):
    return Q.validate_incidents(A.incidents(Tables(spark, sf_dir), geo=True), INCIDENTS_AS_OF)


def _ops_scored(spark, sf_dir):
    return Q.validate_ops(A.operational_data(Tables(spark, sf_dir)))


def _long(scored):
    return (scored.select(F.inline("checks")).drop("keep")
            .withColumn("pass_rate", F.round("pass_rate", 6)))


def _round_scores(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c.endswith("_score") else c for c in cols])


_SCORE_COLS = ["source", "total_records", "completeness_score", "consistency_score",
               "accuracy_score", "overall_score"]


@query("dq_incidents")
def dq_incidents(spark, sf_dir):
    return _long(_inc_scored(spark, sf_dir))


@query("dq_incident_scores")
def dq_incident_scores(spark, sf_dir):
    return _round_scores(_inc_scored(spark, sf_dir), _SCORE_COLS)


@query("dq_ops")
def dq_ops(spark, sf_dir):
    return _long(_ops_scored(spark, sf_dir))


@query("dq_ops_scores")
def dq_ops_scores(spark, sf_dir):
    return _round_scores(_ops_scored(spark, sf_dir), _SCORE_COLS)


@query("dq_report_nested")
def dq_report_nested(spark, sf_dir):
    rep = Q.nested_report(_inc_scored(spark, sf_dir))
    return rep.select(
        "source", "total_records",
        F.round("overall_score", 6).alias("overall_score"),
        F.size("validations").alias("validation_count"),
        F.concat_ws(",", "failed_checks").alias("failed_checks"),
        F.col("failed_check_count").cast("int").alias("failed_check_count"))


@query("dq_log_row")
def dq_log_row(spark, sf_dir):
    rows = Q.dq_log_row(_inc_scored(spark, sf_dir), INCIDENTS_AS_OF).unionByName(
        Q.dq_log_row(_ops_scored(spark, sf_dir), OPS_AS_OF))
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_score") else c
                         for c in rows.columns])


# ---- oracle SQL (registered after the functions to keep the SQL together) --
from wingwatch.plans.catalog import ORACLE  # noqa: E402
from wingwatch.plans.oracle_views import with_views  # noqa: E402

_INC_HEAD = with_views("incidents")[:-1] + _INC_SQL
_OPS_HEAD = with_views("operational_data")[:-1] + _OPS_SQL
ORACLE["dq_incidents"] = _INC_HEAD + _REPORT_COLS
ORACLE["dq_ops"] = _OPS_HEAD + _REPORT_COLS
ORACLE["dq_incident_scores"] = _INC_HEAD + _INC_SCORES + """
SELECT 'incidents' AS source, total_records, round(completeness_score, 6) AS completeness_score,
  round(consistency_score, 6) AS consistency_score, round(accuracy_score, 6) AS accuracy_score,
  round(completeness_score * 0.3 + consistency_score * 0.4 + accuracy_score * 0.3, 6) AS overall_score
FROM s"""
ORACLE["dq_ops_scores"] = _OPS_HEAD + _OPS_SCORES + """
SELECT 'operational_data' AS source, total_records, round(completeness_score, 6) AS completeness_score,
  round(consistency_score, 6) AS consistency_score, round(consistency_score, 6) AS accuracy_score,
  round((completeness_score + consistency_score * 2) / 3, 6) AS overall_score
FROM s"""
ORACLE["dq_report_nested"] = _INC_HEAD + _INC_SCORES + """
SELECT 'incidents' AS source, total_records,
  round(completeness_score * 0.3 + consistency_score * 0.4 + accuracy_score * 0.3, 6) AS overall_score,
  CAST((SELECT count(*) FROM report) AS INTEGER) AS validation_count,
  COALESCE((SELECT string_agg(check_name, ',' ORDER BY check_order) FROM
     (SELECT check_name, check_order FROM report WHERE NOT is_valid ORDER BY check_order LIMIT 5) t), '') AS failed_checks,
  CAST((SELECT count(*) FROM report WHERE NOT is_valid) AS INTEGER) AS failed_check_count
FROM s"""
ORACLE["dq_log_row"] = (
    with_views("incidents", "operational_data")[:-1] + _INC_SQL
    + _INC_SCORES.replace(" s AS", " si AS")
    + _OPS_SQL.replace("m AS", "mo AS").replace("FROM m", "FROM mo").replace(
        "checks AS", "checks_o AS").replace("report AS", "report_o AS").replace(
        "FROM checks)", "FROM checks_o)")
    + _OPS_SCORES.replace(" s AS", " so AS").replace("FROM m)", "FROM mo)").replace(
        "FROM report)", "FROM report_o)")
    + f"""
SELECT DATE '{INCIDENTS_AS_OF}' AS run_date, 'incidents' AS source, CAST(total_records AS BIGINT) AS total_records,
  CAST(trunc(total_records * ov / 100) AS BIGINT) AS valid_records,
  CAST(trunc(total_records * (1 - ov / 100)) AS BIGINT) AS invalid_records,
  round(completeness_score, 6) AS completeness_score, round(consistency_score, 6) AS consistency_score,
  round(accuracy_score, 6) AS accuracy_score, round(ov, 6) AS overall_score,
  CAST(NULL AS VARCHAR) AS validation_errors
FROM (SELECT *, completeness_score * 0.3 + consistency_score * 0.4 + accuracy_score * 0.3 AS ov FROM si)
UNION ALL
SELECT DATE '{OPS_AS_OF}', 'operational_data', CAST(total_records AS BIGINT),
  CAST(trunc(total_records * ov / 100) AS BIGINT), CAST(trunc(total_records * (1 - ov / 100)) AS BIGINT),
  round(completeness_score, 6), round(consistency_score, 6), round(consistency_score, 6), round(ov, 6),
  CAST(NULL AS VARCHAR)
FROM (SELECT *, (completeness_score + consistency_score * 2) / 3 AS ov FROM so)""")
