"""Model queries (I2, I4, I5, I9-I14, I16): rows-only checks plus property tests.

Fitted models are memoised per (application, input files with their sizes and times, parameters), so the
queries of one run share one fit per model and a rewritten table gets a new one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wingwatch.functions.incident import incident_features, severity_class
from wingwatch.functions.ops import ops_features
from wingwatch.operators import models as M
from wingwatch.operators import stats as ST
from wingwatch.operators import trees as TR
from wingwatch.plans.catalog import query
from wingwatch.sources import adapters as A
from wingwatch.session import file_versions, materialize
from wingwatch.sources.tables import Tables

# model parameters (the reference's, see SURVEY I2/I5/I9)
RISK_PARAMS = dict(max_iter=100, max_depth=6, step=0.1, subsample=0.8, col_sample="0.8", seed=42)
SEVERITY_PARAMS = dict(max_iter=100, max_depth=8, seed=42)
ANOMALY_PARAMS = dict(n_trees=100, max_samples=256, seed=42)
WHAT_IF_SCENARIOS = [{"severity_code": 0}, {"total_injuries": 0, "injury_rate": 0.0},
                     {"is_weekend": 0, "has_coordinates": 1}]

_CACHE: dict = {}


def _version(spark, sf_dir):
    """Identity of the data a model was fitted on."""
    t = Tables(spark, sf_dir)
    return (spark.sparkContext.applicationId,
            tuple(file_versions(spark, t.path(n)) for n in ("orders", "customer", "nation", "region", "lineitem")))


def _frames(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inc = incident_features(A.incidents(t, geo=True)).withColumn("severity_class", severity_class(F.col("severity")))
    ops = ops_features(A.operational_data(t))
    return inc, ops


def risk_bundle(spark, sf_dir, **params):
    p = {**RISK_PARAMS, **params}
    key = ("risk", _version(spark, sf_dir), tuple(sorted(p.items())))
    if key not in _CACHE:
        inc, ops = _frames(spark, sf_dir)
        feats = M.model_feature_sets(inc, ops)["risk"]
        data, med = M.prepare(inc, "id", feats, "injury_score")
        data = ST.hash_split(data, "id")
        model = M.fit_risk_model(M.training_rows(data.filter("split = 'train'"), "id"), feats, "injury_score", **p)
        ens = TR.ensemble_arrays(spark, model.stages[-1], len(feats), M.risk_cuts(model, feats))
        _CACHE[key] = dict(model=model, features=feats, data=data, medians=med, ens=ens)
    return _CACHE[key]


def severity_bundle(spark, sf_dir, **params):
    p = {**SEVERITY_PARAMS, **params}
    key = ("severity", _version(spark, sf_dir), tuple(sorted(p.items())))
    if key not in _CACHE:
        inc, ops = _frames(spark, sf_dir)
        feats = M.model_feature_sets(inc, ops)["severity"]
        data, med = M.prepare(inc, "id", feats, "severity_class")
        data = materialize(ST.with_class_weight(ST.stratified_split(data, "id", "severity_class"), "severity_class"))
        model = M.fit_severity_model(M.training_rows(data.filter("split = 'train'"), "id"), feats,
                                     "severity_class", **p)
        _CACHE[key] = dict(model=model, features=feats, data=data, medians=med)
    return _CACHE[key]


def anomaly_bundle(spark, sf_dir, **params):
    p = {**ANOMALY_PARAMS, **params}
    key = ("anomaly", _version(spark, sf_dir), tuple(sorted(p.items())))
    if key not in _CACHE:
        inc, ops = _frames(spark, sf_dir)
        feats = M.model_feature_sets(inc, ops)["anomaly"]
        data, med = M.prepare(ops, "id", feats)
        model = M.fit_anomaly_model(data, feats, "id", **p)
        _CACHE[key] = dict(model=model, features=feats, data=data, medians=med, ops=ops)
    return _CACHE[key]


@query("risk_model_scores")
def risk_model_scores(spark, sf_dir):
    """I2 + I10 on the held-out 20%: actual vs predicted, clamped score, level."""
    b = risk_bundle(spark, sf_dir)
    test = b["data"].filter("split = 'test'")
    p = b["model"].transform(test)
    return p.select("id", F.col("injury_score").alias("actual"), F.col("prediction"),
                    M.R.clamp_score(F.col("prediction")).alias("risk_score"),
                    M.R.risk_level(M.R.clamp_score(F.col("prediction"))).alias("risk_level"))


@query("risk_model_metrics")
def risk_model_metrics(spark, sf_dir):
    """I3 on the real model's held-out predictions."""
    return ST.regression_metrics(risk_model_scores(spark, sf_dir), "actual", "prediction")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """I4: ranked importances of the risk model."""
    b = risk_bundle(spark, sf_dir)
    return spark.createDataFrame(M.feature_importance(b["model"], b["features"]),
                                 "feature string, importance double, rank int")


@query("severity_model_scores")
def severity_model_scores(spark, sf_dir):
    """I5 + I11 on the held-out 20%."""
    b = severity_bundle(spark, sf_dir)
    test = b["data"].filter("split = 'test'")
    s = M.score_severity(b["model"], test, "id")
    return s.join(test.select("id", F.col("severity_class").alias("actual")), "id")


@query("severity_model_report")
def severity_model_report(spark, sf_dir):
    """I7 on the real classifier: per-class precision/recall/F1 and averages."""
    return ST.class_report(severity_model_scores(spark, sf_dir), "actual", "severity_code")


@query("anomaly_scores")
def anomaly_scores(spark, sf_dir):
    """Every operation scored, 5% contamination offset."""
    b = anomaly_bundle(spark, sf_dir)
    return M.IF.detect(M.apply_scaler(b["data"], b["model"]["scaler"], "id"), b["model"]["forest"], "id")


@query("score_risk")
def score_risk(spark, sf_dir):
    """Batch risk scoring of every incident (imputed with training medians)."""
    b = risk_bundle(spark, sf_dir)
    inc, _ = _frames(spark, sf_dir)
    rows = inc.select("id", *[F.col(c).cast("double") for c in b["features"]]).na.fill(
        {k: v for k, v in b["medians"].items() if v is not None})
    return M.score_risk(b["model"], rows, "id")


@query("score_severity")
def score_severity(spark, sf_dir):
    """Batch severity scoring of every incident (NULLs imputed with training medians); rows that the
    model cannot take are rejected."""
    b = severity_bundle(spark, sf_dir)
    inc, _ = _frames(spark, sf_dir)
    return M.score_severity_batch(b["model"], inc, "id", b["features"], b["medians"])


#: the features that the severity model resolves on the incident table, in its order
SEVERITY_BATCH = ["injuries_fatal", "injuries_serious", "injuries_minor", "injuries_uninjured", "latitude", "longitude", "year",
                  "month", "day_of_week", "day_of_year", "quarter", "is_weekend", "is_holiday_season", "is_serious", "phase_risk",
                  "total_injuries", "total_people", "injury_rate", "has_coordinates", "is_us", "weather_risk"]


@query("severity_batch_rejects", ("incident_features",), """
SELECT id, status, unfit FROM (
  SELECT id, unfit, CASE WHEN unfit = '' THEN 'accepted' ELSE 'rejected' END AS status FROM (
    SELECT id, concat_ws(',', """ + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in SEVERITY_BATCH) + """) AS unfit
    FROM incident_features) x) y""")
def severity_batch_rejects(spark, sf_dir):
    """Which incidents the severity model takes as they come, without imputing, and what the others lack."""
    inc, ops = _frames(spark, sf_dir)
    batch = M.batch_features(inc, "id", M.model_feature_sets(inc, ops)["severity"])
    return batch.select("id", F.when(F.size("unfit") == 0, "accepted").otherwise("rejected").alias("status"),
                        F.array_join("unfit", ",").alias("unfit"))


@query("score_anomaly")
def score_anomaly(spark, sf_dir):
    """Anomaly flag, score, contributing factors and percentile per operation."""
    b = anomaly_bundle(spark, sf_dir)
    return M.score_anomaly(b["model"], b["data"], "id")


@query("shap_values")
def shap_values(spark, sf_dir):
    """Exact tree Shapley values of the risk model for every incident."""
    b = risk_bundle(spark, sf_dir)
    return TR.shap_frame(b["data"], b["ens"], b["features"], "id")


@query("shap_global")
def shap_global(spark, sf_dir):
    """I14 on the real Shapley table: mean |value| per feature, ranked."""
    b = risk_bundle(spark, sf_dir)
    cols = [f"shap_{c}" for c in b["features"]]
    r = ST.mean_abs_importance(shap_values(spark, sf_dir), cols)
    return r.withColumn("feature", F.regexp_replace("feature", "^shap_", ""))


@query("what_if_model")
def what_if_model(spark, sf_dir):
    """I16: base vs scenario risk per incident with the fitted model."""
    b = risk_bundle(spark, sf_dir)
    return TR.what_if_frame(b["data"], b["ens"], b["features"], "id", WHAT_IF_SCENARIOS)


@query("feature_select")
def feature_select(spark, sf_dir):
    """The feature lists each model resolves from the available columns."""
    inc, ops = _frames(spark, sf_dir)
    sets = M.model_feature_sets(inc, ops)
    frames = {"risk": inc, "severity": inc, "anomaly": ops}
    out = None
    for m, fs in sets.items():
        # coverage of each selected feature over the whole table (one aggregate)
        counts = frames[m].agg(*[F.count(f).alias(f"n{i}") for i, f in enumerate(fs)])
        rows = counts.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.lit(i).alias("position"), F.lit(f).alias("feature"),
                     F.col(f"n{i}").alias("non_null")) for i, f in enumerate(fs)])))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("train_frame", ("incident_features",), """
SELECT id, CAST(injuries_serious AS DOUBLE) AS target, CAST(total_injuries AS DOUBLE) AS total_injuries, CAST(injury_rate AS DOUBLE) AS injury_rate,
  CAST(severity_code AS DOUBLE) AS severity_code, CAST(has_coordinates AS DOUBLE) AS has_coordinates
FROM incident_features WHERE injuries_serious IS NOT NULL""")
def train_frame(spark, sf_dir):
    """Rows with a target (serious injuries, NULL where unknown), features as doubles."""
    inc, _ = _frames(spark, sf_dir)
    return M.labelled(inc, "id", ["total_injuries", "injury_rate", "severity_code", "has_coordinates"], "injuries_serious")


@query("example_predictions")
def example_predictions(spark, sf_dir):
    """A seeded sample of held-out rows, actual vs predicted."""
    return ST.seeded_sample(risk_model_scores(spark, sf_dir), "id", 10, seed=42)


@query("model_results_sink")
def model_results_sink(spark, sf_dir):
    """Anomaly scores and Shapley values written with their row key, read back."""
    import os
    import uuid

    from wingwatch.session import checkpoint_dir
    from wingwatch.sources import sinks as S

    root = os.path.join(checkpoint_dir(spark), f"results-{uuid.uuid4().hex}")
    S.write_table(anomaly_scores(spark, sf_dir), os.path.join(root, "anomaly_scores"), "replace")
    S.write_table(shap_values(spark, sf_dir), os.path.join(root, "shap_values"), "replace")
    a = spark.read.parquet(os.path.join(root, "anomaly_scores"))
    s = spark.read.parquet(os.path.join(root, "shap_values"))
    return (a.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anomaly").alias("flagged"))
            .select(F.lit("anomaly_scores").alias("table_name"), "rows", "flagged")
            .unionByName(s.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit("shap_values").alias("table_name"), "rows", F.lit(None).cast("bigint").alias("flagged"))))
