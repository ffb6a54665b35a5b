"""Composite jobs (J1-J5) and the pipeline summary.

Each job is a short driver function that declares DataFrames and triggers a
few actions; the heavy work stays in Spark.  Inputs reused by several
actions are read once and materialised to the shared checkpoint folder
(``checkpoint()``), never to executor-local storage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingwatch.functions.incident import incident_features
from wingwatch.functions.ops import ops_features
from wingwatch.functions import weather as W
from wingwatch.operators import analytics as AN
from wingwatch.operators import enrich as EN
from wingwatch.operators import quality as Q
from wingwatch.operators import rules as RU
from wingwatch.operators import setops as SO
from wingwatch.session import checkpoint_dir, materialize
from wingwatch.sources import adapters as A
from wingwatch.sources import sinks as S
from wingwatch.sources.tables import Tables


def etl_summary(inc_feat: DataFrame, ops_feat: DataFrame, inc_scores: DataFrame) -> DataFrame:
    """Records, feature counts, quality score, by-source and by-severity counts in one row.

    The incidents are read by one grouped aggregate (grouping sets source and severity); the by_*
    lists, value:count with NULL left out, have one entry per distinct value."""
    groups = inc_feat.groupingSets([["source"], ["severity"]], "source", "severity").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))

    def listed(name: str, g: int):
        entry = F.concat(F.col(name), F.lit(":"), F.col("n").cast("string"))
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("g") == g, entry)))).alias(f"by_{name}")

    inc = groups.agg(F.coalesce(F.sum(F.when(F.col("g") == 1, F.col("n"))), F.lit(0)).alias("incident_records"),
                     listed("source", 1), listed("severity", 2))
    ops = ops_feat.agg(F.count(F.lit(1)).alias("operational_records"))
    q = inc_scores.select(F.round("overall_score", 6).alias("quality_score"))
    return (inc.crossJoin(ops).crossJoin(q)
            .select("incident_records", F.lit(len(inc_feat.columns)).alias("incident_features_created"),
                    "quality_score", "by_source", "by_severity", "operational_records",
                    F.lit(len(ops_feat.columns)).alias("operational_features_created"),
                    F.lit("SUCCESS").alias("status")))


def training_frames(incidents: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incident features, operational features, monthly incident profile."""
    inc = incident_features(incidents)
    opf = ops_features(ops)
    return inc, opf, AN.monthly_incident_profile(inc)


def daily_etl(spark: SparkSession, tables: Tables, out_root: str, incidents_as_of: str, ops_as_of: str,
              incident_days_back: int | None = 365, operational_days_back: int | None = 90,
              run_date: str | None = None) -> DataFrame:
    """J1 (and J2 with ``*_days_back=None``): extract -> validate -> features
    -> feature store -> DQ log -> summary row."""
    run_date = run_date or incidents_as_of
    inc = A.incidents(tables, geo=True)
    ops = A.operational_data(tables)
    if incident_days_back is not None:
        inc = AN.trailing_window(inc, "incident_date", incidents_as_of, incident_days_back)
    if operational_days_back is not None:
        ops = AN.trailing_window(ops, "date", ops_as_of, operational_days_back)
    # read once: validation, features, store and summary all reuse these rows
    inc = materialize(inc)
    ops = materialize(ops)
    inc_scores = Q.validate_incidents(inc, incidents_as_of)
    ops_scores = Q.validate_ops(ops)
    inc_feat, ops_feat, monthly = training_frames(inc, ops)
    created = f"{run_date} 00:00:00"
    S.save_features(inc_feat, out_root, "incident_features", run_date, created)
    S.save_features(ops_feat, out_root, "operational_features", run_date, created)
    S.save_features(monthly, out_root, "incident_monthly_profile", run_date, created)
    dq = Q.dq_log_row(inc_scores, run_date).unionByName(Q.dq_log_row(ops_scores, run_date))
    S.write_table(dq, os.path.join(out_root, "data_quality_logs"), "append")
    return etl_summary(inc_feat, ops_feat, inc_scores)


def recommendation_run(spark: SparkSession, tables: Tables, out_root: str, top_n: int = 10) -> DataFrame:
    """The top-n riskiest operations -> rules -> JSON + CSV exports -> summary."""
    ops = ops_features(A.operational_data(tables))
    top = AN.riskiest(ops, top_n)
    recs = materialize(RU.recommendations(top, key="id"))
    ordered = RU.sorted_recommendations(recs)  # part files are in this order
    S.export_records(ordered, os.path.join(out_root, "recommendations_json"), "json")
    S.export_records(RU.to_export(ordered).drop("json"), os.path.join(out_root, "recommendations_csv"), "csv")
    return RU.recommendation_summary(recs)


def weather_enrichment(spark: SparkSession, tables: Tables, out_root: str) -> DataFrame:
    """Backlog incidents take their landed payloads; incidents are
    rewritten and the parsed observations deduplicated on their natural key."""
    parsed = materialize(W.flatten_weather_payload(A.weather_payloads(tables)))
    updated = EN.apply_weather_update(A.incidents(tables, geo=True), parsed)
    S.write_table(updated.drop("updated").withColumn("incident_year", F.year("incident_date")),
                  os.path.join(out_root, "incidents_enriched"), "replace", partition_by=["incident_year"])
    keys = A.weather_conditions(tables).select("id", "date", "hour", "airport_code")
    observations = SO.dedup_by_key(keys.join(parsed.filter("parsed"), "id"),
                                   ["date", "hour", "airport_code"], ["id"])
    S.write_table(observations, os.path.join(out_root, "weather_observations"), "replace")
    return updated.groupBy("updated").agg(F.count(F.lit(1)).alias("incidents"))


def default_out_root(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), name)
