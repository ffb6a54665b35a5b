"""Model training and batch scoring with ``pyspark.ml``.

Training data is median-imputed (exact distributed medians), split by a
hash of the record key, and fitted with distributed tree learners.  Scoring
is ``PipelineModel.transform`` (risk, severity) or a broadcast-tree map
(isolation forest), so batch scoring is a narrow stage over any number of
rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wingwatch.functions import constants as K
from wingwatch.functions import risk as R
from wingwatch.operators import iforest as IF
from wingwatch.operators import onevsrest as OVR
from wingwatch.operators import stats as ST
from wingwatch.session import keep

SEVERITY_LABELS = ["NONE", "MINOR", "SERIOUS", "FATAL"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def select_features(df: DataFrame, declared: list[str], min_count: int,
                    exclude: list[str] = (), exclude_substrings: list[str] = (),
                    aliases: dict[str, str] | None = None) -> list[str]:
    """Declared features present in ``df`` (declared order); fewer than
    ``min_count`` -> all numeric columns minus exclusions.  ``aliases`` maps a
    declared name to the column that carries it (e.g. ``_mins`` -> ``_minutes``)."""
    aliases = aliases or {}
    cols = set(df.columns)
    picked = []
    for d in declared:
        if d in cols:
            picked.append(d)
        elif aliases.get(d) in cols:
            picked.append(aliases[d])
    if len(picked) >= min_count:
        return picked
    return [c for c in numeric_columns(df) if c not in exclude
            and not any(s in c.lower() for s in exclude_substrings)]


def prepare(df: DataFrame, key: str, features: list[str], target: str | None = None) -> tuple[DataFrame, dict]:
    """B6 + E20: drop rows with a NULL target, cast features to double and
    fill NULLs with exact medians.

    The rows are written once, before the passes for the medians: these and the fit would otherwise read the sources,
    and join them, again and again.  Small row groups let them be read in as many tasks as there are cores, so they
    are not shuffled for it."""
    if target is not None:
        df = df.filter(F.col(target).isNotNull())
    cols = [key] + ([target] if target else [])
    df = df.select(*cols, *[F.col(c).cast("double").alias(c) for c in features])
    return ST.median_impute(keep(df, group_mb=4), features)


def labelled(df: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """(key, target, features) of the rows whose target is known, as doubles."""
    return df.filter(F.col(target).isNotNull()).select(
        key, F.col(target).cast("double").alias("target"), *[F.col(c).cast("double").alias(c) for c in features])


def training_rows(df: DataFrame, key: str) -> DataFrame:
    """The labelled rows that the boosted trees learn from: all of them, spread over the tasks of the fit."""
    n = df.count()
    return spread(df, key, n, task_rows(n))


#: the name from when a fit learned from 2,000,000 rows at most
training_sample = training_rows

#: rows of a fit that one task holds: few rows make about ``FIT_TASKS`` tasks, many rows full ones
ROWS_A_TASK, MAX_ROWS_A_TASK, FIT_TASKS = 25_000, 250_000, 24


def task_rows(n: int) -> int:
    """Rows of a task of a fit over ``n`` rows.  Each task sends sums for all open nodes, so tasks grow before they become more."""
    return min(MAX_ROWS_A_TASK, max(ROWS_A_TASK, math.ceil(n / FIT_TASKS)))


def spread(df: DataFrame, key: str, n: int, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` of about ``n`` rows over as many tasks as they ask for, in an order that reruns keep.

    A fit goes over its rows hundreds of times, so it must not inherit the few partitions of a small file.
    Their number follows from the rows alone, not from the cluster; a frame that is spread enough stays as it is.
    """
    parts = math.ceil(n / rows_a_task)
    return df.repartition(parts, key).sortWithinPartitions(key) if parts > df.rdd.getNumPartitions() else df


def fit_risk_model(train: DataFrame, features: list[str], target: str, max_iter: int = 100,
                   max_depth: int = 6, step: float = 0.1, subsample: float = 0.8,
                   col_sample: str = "0.8", seed: int = 42):
    """Boosted regression trees (100 x depth 6, lr 0.1, 0.8 row/col sampling).

    The learner would take its cuts from about 10,000 rows.  It is given places among cuts of all rows instead (at most
    ``OVR.BINS`` a feature), and enough ``maxBins`` to look at every row for them, which leaves exactly these cuts."""
    cuts = OVR.cut_points(train, features, None)
    cut = [i for i, c in enumerate(cuts) if len(c)]
    inputs = [f"_place{i}" if i in cut else c for i, c in enumerate(features)]
    # a bucket holds its lower bound, a node sends its cut left; the sum makes a number of a category
    places = [Bucketizer(inputCols=[features[i] for i in cut], outputCols=[f"_bucket{i}" for i in cut], handleInvalid="keep",
                         splitsArray=[[-math.inf, *np.nextafter(cuts[i], math.inf).tolist(), math.inf] for i in cut]),
              SQLTransformer(statement="SELECT *, " + ", ".join(f"_bucket{i} + 0D AS _place{i}" for i in cut) + " FROM __THIS__")] if cut else []
    gbt = GBTRegressor(featuresCol="features", labelCol=target, maxIter=max_iter, maxDepth=max_depth,
                       stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=col_sample,
                       seed=seed, maxBins=min(MAX_BINS, max(OVR.BINS, math.ceil(math.sqrt(train.count())))))
    pipe = Pipeline(stages=[*places, VectorAssembler(inputCols=inputs, outputCol="features",
                                                     handleInvalid="keep"), gbt])
    return pipe.fit(train)


#: bins whose square, the rows that the learner looks at, is still a 32-bit number
MAX_BINS = 46_340


def risk_cuts(model, features: list[str]) -> list[np.ndarray]:
    """The cuts of each feature among which a risk model's trees have their places."""
    cuts = {c: np.nextafter(s[1:-1], -math.inf) for b in model.stages[:1] if isinstance(b, Bucketizer)
            for c, s in zip(b.getInputCols(), b.getSplitsArray())}
    return [cuts.get(c, np.zeros(0)) for c in features]


def feature_importance(model, features: list[str]) -> list[tuple[str, float, int]]:
    """I4: importances of the last pipeline stage, ranked."""
    imp = model.stages[-1].featureImportances.toArray()
    order = np.argsort(-imp, kind="stable")
    return [(features[i], float(imp[i]), r + 1) for r, i in enumerate(order)]


def score_risk(model, df: DataFrame, key: str) -> DataFrame:
    """Predict, clamp 0-100, level (C30); constant confidence as served."""
    p = model.transform(df)
    s = R.clamp_score(F.col("prediction"))
    return p.select(key, F.round(s, 2).alias("risk_score"), R.risk_level(s).alias("risk_level"),
                    F.lit(0.85).alias("confidence"), F.lit("v1.0").alias("model_version"))


def fit_severity_model(train: DataFrame, features: list[str], label: str, max_iter: int = 100,
                       max_depth: int = 8, weight_col: str | None = "weight", seed: int = 42):
    """I5 + I6: 4-class boosted trees as one-vs-rest GBT with balanced weights.

    Nothing is drawn at random (all rows and columns make every tree), so nothing depends on ``seed``."""
    return OVR.fit(train, features, label, weight_col, rounds=max_iter, depth=max_depth)


def score_severity(model, df: DataFrame, key: str, n_classes: int = 4) -> DataFrame:
    """Class, probability map (per-class margins -> logistic -> normalised)
    and confidence = max probability."""
    p = OVR.transform(model, df, key)
    probs = F.transform("rawPrediction", lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    norm = F.transform(probs, lambda x: x / total)
    labels = F.array(*[F.lit(s) for s in SEVERITY_LABELS[:n_classes]])
    return p.select(key, F.col("prediction").cast("int").alias("severity_code"), norm.alias("_p")).select(
        key, "severity_code", F.element_at(labels, F.col("severity_code") + 1).alias("predicted_severity"),
        F.map_from_arrays(labels, F.transform("_p", lambda x: F.round(x, 4))).alias("probabilities"),
        F.round(F.array_max("_p"), 4).alias("confidence"))


def unfit_features(df: DataFrame, features: list[str]) -> Column:
    """Names of the features a model cannot take from a row: absent column, NULL, text that is no
    number, NaN or infinite.  In the order of ``features``; empty where the row is fit."""
    bad = []
    for c in features:
        if c not in df.columns:
            bad.append(F.lit(c))
            continue
        v = F.col(f"`{c}`").try_cast("double")
        bad.append(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(c)))
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def batch_features(df: DataFrame, key: str, features: list[str], fills: dict | None = None) -> DataFrame:
    """key, the features as doubles and ``unfit``.  ``fills`` stands in for NULLs (not for NaN, infinities or
    absent columns); without it a NULL makes the row unfit."""
    fills = fills or {}
    filled = df.select(F.col(f"`{key}`"), *[
        F.col(f"`{c}`") if fills.get(c) is None else F.when(F.col(f"`{c}`").isNull(), F.lit(float(fills[c]))).otherwise(
            F.col(f"`{c}`").try_cast("double")).alias(c) for c in features if c in df.columns])
    doubles = [(F.col(f"`{c}`").try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in features]
    return filled.select(F.col(f"`{key}`"), *doubles, unfit_features(filled, features).alias("unfit"))


def score_severity_batch(model, df: DataFrame, key: str, features: list[str], fills: dict | None = None,
                         n_classes: int = 4) -> DataFrame:
    """I11 over a whole batch: every row once, the fit ones as in ``score_severity`` and the others rejected.

    ``status`` is accepted or rejected; a rejected row has no class, no probabilities and no confidence,
    and ``unfit`` names its features.  Repeated keys are scored row by row; other columns of the batch
    play no part.  Each half is a narrow stage, so nothing is shuffled.  The columns of the batch are written once
    before they are checked: checks that repeat what the columns are made of give code too long to be compiled.
    """
    batch = batch_features(keep(df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in features if c in df.columns]), group_mb=4),
                           key, features, fills)
    scored = score_severity(model, batch.filter(F.size("unfit") == 0).drop("unfit"), key, n_classes)
    accepted = scored.withColumn("status", F.lit("accepted")).withColumn("unfit", F.array().cast("array<string>"))
    kinds = {f.name: f.dataType for f in scored.schema.fields}
    rejected = batch.filter(F.size("unfit") > 0).select(
        F.col(f"`{key}`"), *[F.lit(None).cast(kinds[c]).alias(c) for c in scored.columns if c != key],
        F.lit("rejected").alias("status"), "unfit")
    return accepted.unionByName(rejected)


def fit_anomaly_model(train: DataFrame, features: list[str], key: str, n_trees: int = 100,
                      max_samples: int = 256, seed: int = 42):
    """I8 + I9: population-std standardisation, then the isolation forest."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scaler = {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0) for c in features}
    scaled = apply_scaler(train, scaler, key)
    forest = IF.fit(scaled, features, key, n_trees=n_trees, max_samples=max_samples, seed=seed)
    return dict(scaler=scaler, forest=forest, features=list(features))


def apply_scaler(df: DataFrame, scaler: dict, key: str) -> DataFrame:
    return df.select(key, *[((F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)).alias(c)
                            for c, (m, s) in scaler.items()])


def score_anomaly(model: dict, df: DataFrame, key: str, contamination: float = 0.05) -> DataFrame:
    """I9 + I12: decision score, anomaly flag, contributing factors (C32) and
    the API's approximate percentile (C33)."""
    det = IF.detect(apply_scaler(df, model["scaler"], key), model["forest"], key, contamination)
    j = det.join(df, key)
    return j.select(key, "anomaly_score", "is_anomaly",
                    R.contributing_factors(df).alias("contributing_factors"),
                    F.round(R.approx_percentile(F.col("anomaly_score")), 1).alias("percentile"))


def model_feature_sets(inc_features: DataFrame, ops_features: DataFrame) -> dict[str, list[str]]:
    """Feature lists resolved the way the reference resolves them (trap T7/T8)."""
    risk = select_features(inc_features, K.RISK_FEATURES, K.RISK_MIN_FEATURES,
                           exclude=[K.RISK_TARGET, "id"])
    sev = select_features(inc_features, [], 1 << 30,
                          exclude=["id", "severity_class"] + K.SEVERITY_NUMERIC_EXCLUDE)
    anom = select_features(ops_features, K.ANOMALY_FEATURES, K.ANOMALY_MIN_FEATURES,
                           exclude_substrings=K.ANOMALY_NUMERIC_EXCLUDE,
                           aliases={"turnaround_time_mins": "turnaround_time_minutes",
                                    "schedule_deviation_mins": "schedule_deviation_minutes"})
    return {"risk": risk, "severity": sev, "anomaly": anom}
