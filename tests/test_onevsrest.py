"""The severity model's one-vs-rest trees: those of the library, from all rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wingwatch.operators import models as M
from wingwatch.operators import onevsrest as O

FEATURES = ["a", "b", "c"]


def _rows(spark, n=4000, parts=3):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 60, n), rng.normal(size=n).round(3), rng.integers(0, 3, n)
    y = np.clip(a // 20 + (b > 0.7) - (c == 2) * (b < 0), 0, 3)
    w = np.array([0.5, 1.0, 2.0, 1.25])[y]
    rows = [(i, *map(float, r[:3]), int(r[3]), float(r[4])) for i, r in enumerate(zip(a, b, c, y, w))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double").repartition(parts, "id").sortWithinPartitions("id")


def test_trees_are_those_of_the_library(spark):
    """the fit was rewritten; below the library's sample of 10,000 rows both have the same cuts."""
    df = _rows(spark).persist()
    model = O.fit(df, FEATURES, "y", "w", rounds=4, depth=5)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    got = {r["id"]: list(r["rawPrediction"]) for r in O.transform(model, df, "id").collect()}
    for k in range(4):
        gbt = GBTClassifier(labelCol="t", maxIter=4, maxDepth=5, weightCol="w").fit(vectors.withColumn("t", (F.col("y") == k).cast("double")))
        for r in gbt.transform(vectors).select("id", "rawPrediction").collect():
            assert got[r["id"]][k] == pytest.approx(r["rawPrediction"][1], abs=1e-9)


def test_same_model_from_few_and_many_sums(spark, monkeypatch):
    """Sums that the driver adds up and those that tasks add up give the same trees."""
    df = _rows(spark, 1500).persist()
    one = O.fit(df, FEATURES, "y", "w", rounds=12, depth=4)
    monkeypatch.setattr(O, "DRIVER_MB", 0)
    monkeypatch.setattr(O, "TASK_MB", 0.001)
    two = O.fit(df, FEATURES, "y", "w", rounds=12, depth=4)
    assert len(one["rounds"]) == 12
    for x, y in zip(one["rounds"], two["rounds"]):
        for s, t in zip(x, y):
            assert all(np.array_equal(s[c], t[c]) for c in ("feature", "cut", "left", "value"))


def test_cuts_come_from_all_rows(spark):
    """the cuts came from about 10,000 rows, so that a rare value had none."""
    df = spark.range(0, 60_000, 1, 2).select(F.when(F.col("id") == 31_111, 9.0).otherwise(F.col("id") % 3).alias("x"),
                                             F.when(F.col("id") % 5 == 0, 2.5).otherwise(0.0).alias("z"))
    assert [c.tolist() for c in O.cut_points(df, ["x", "z"], None)] == [[0.5, 1.5, 5.5], [1.25]]
    many = O.cut_points(spark.range(0, 64_000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w")), ["x"], "w")[0]
    assert many.tolist() == [2000 * i - 0.5 for i in range(1, 32)]


def test_one_rare_row_is_learned(spark):
    """the whole way from the rows to the scores."""
    df = spark.range(0, 30_000, 1, 2).select("id", F.when(F.col("id") == 12_345, 50.0).otherwise(F.col("id") % 2).alias("x"),
                                             F.when(F.col("id") == 12_345, 3).otherwise((F.col("id") % 2).cast("int")).alias("y"), F.lit(1.0).alias("weight"))
    model = M.fit_severity_model(M.training_rows(df, "id"), ["x"], "y", max_iter=2, max_depth=3)
    assert M.score_severity(model, df.filter("id = 12345"), "id").first()["severity_code"] == 3


def test_features_without_a_cut_and_missing_features(spark):
    df = spark.createDataFrame([(1, 1.0, 0, 1.0), (2, 1.0, 1, 1.0)], "id long, x double, y int, weight double")
    model = M.fit_severity_model(df, ["x"], "y", max_iter=3, max_depth=3)
    assert [len(t["feature"]) for t in model["rounds"][0]] == [1, 1]
    with pytest.raises(Exception, match="missing, NaN"):
        O.fit(df.withColumn("x", F.lit(None).cast("double")), ["x"], "y", "weight", rounds=1)


def test_risk_trees_have_cuts_from_all_rows(spark):
    """the cuts came from about 10,000 rows, so that a rare value had none; below that they stay as they were."""
    from wingwatch.operators import trees as TR

    df = spark.range(0, 30_000, 1, 2).select("id", F.when(F.col("id") == 12_345, 50.0).otherwise(F.col("id") % 2).alias("x"), F.lit(1.0).alias("z"),
                                             F.when(F.col("id") == 12_345, 9e5).otherwise(F.col("id") % 2).alias("t"))
    model = M.fit_risk_model(M.training_rows(df, "id"), ["z", "x"], "t", max_iter=2, max_depth=3, subsample=1.0, col_sample="all")
    assert model.transform(df.filter("id = 12345")).first()["prediction"] > 8e5
    ens = TR.ensemble_arrays(spark, model.stages[-1], 2, M.risk_cuts(model, ["z", "x"]))
    X = np.array([[1.0, v] for v in (0.0, 0.5, 1.0, 25.5, 26.0, 50.0, np.nan)])
    got = model.transform(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, z double, x double")).orderBy("id")
    assert [r["prediction"] for r in got.collect()] == pytest.approx(TR.predict_arrays(ens, X).tolist())

    small = _rows(spark).withColumn("t", F.col("a") + 3 * F.col("b")).persist()
    model = M.fit_risk_model(small, FEATURES, "t", max_iter=4, max_depth=4)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(small)
    plain = GBTRegressor(labelCol="t", maxIter=4, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42).fit(vectors)
    assert [r["prediction"] for r in model.transform(small).orderBy("id").collect()] == pytest.approx(
        [r["prediction"] for r in plain.transform(vectors).orderBy("id").collect()])
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray())
