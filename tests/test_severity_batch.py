"""Batch severity scoring, fit and unfit rows."""

import math

import pytest

from wingwatch.operators import models as M

FEATURES = ["speed", "depth"]
SCHEMA = "id long, speed string, depth double, unfit string, `a.b` long"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, float(i % 4), float(i % 7), i % 4, 1.0) for i in range(80)]
    train = spark.createDataFrame(rows, "id long, speed double, depth double, severity_class int, weight double")
    return M.fit_severity_model(train, FEATURES, "severity_class", max_iter=2, max_depth=3)


def batch(spark):
    rows = [(1, "0", 1.0), (2, "3", 2.0), (3, None, 1.0), (4, "fast", 1.0), (5, "1", math.nan), (6, "1", math.inf),
            (7, "NaN", None), (8, "2", 1.0), (8, "2", 1.0), (None, "1", 1.0), (9, "1", None)]
    return spark.createDataFrame([(*r, "mine", 0) for r in rows], SCHEMA)


def test_unfit_rows_are_rejected(spark, model):
    out = M.score_severity_batch(model, batch(spark), "id", FEATURES)
    assert out.columns == ["id", "severity_code", "predicted_severity", "probabilities", "confidence", "status", "unfit"]
    rows = out.collect()
    assert len(rows) == 11
    rejected = {r.id: r.unfit for r in rows if r.status == "rejected"}
    assert rejected == {3: ["speed"], 4: ["speed"], 5: ["depth"], 6: ["depth"], 7: ["speed", "depth"], 9: ["depth"]}
    for r in rows:
        scored = (r.severity_code, r.predicted_severity, r.probabilities, r.confidence)
        if r.status == "rejected":
            assert scored == (None,) * 4
        else:
            assert r.unfit == [] and sorted(r.probabilities) == sorted(M.SEVERITY_LABELS)
            assert r.confidence == max(r.probabilities.values()) and abs(sum(r.probabilities.values()) - 1) < 1e-3
    codes = {r.id: r.severity_code for r in rows if r.status == "accepted"}
    assert codes == {1: 0, 2: 3, 8: 2, None: 1} and sum(r.id == 8 for r in rows) == 2


def test_fills_stand_in_for_nulls_only(spark, model):
    rows = M.score_severity_batch(model, batch(spark), "id", FEATURES, {"speed": 2.0, "depth": 1.0}).collect()
    assert {r.id for r in rows if r.status == "rejected"} == {4, 5, 6, 7}
    assert {r.id: r.severity_code for r in rows if r.id in (3, 9)} == {3: 2, 9: 1}


def test_absent_column_and_empty_batch(spark, model):
    rows = M.score_severity_batch(model, batch(spark).drop("depth"), "id", FEATURES, {"depth": 1.0}).collect()
    assert len(rows) == 11 and all(r.status == "rejected" and "depth" in r.unfit for r in rows)
    assert M.score_severity_batch(model, batch(spark).limit(0), "id", FEATURES).collect() == []


def test_same_scores_as_without_checks(spark, model):
    fit = batch(spark).filter("id IN (1, 2, 8)").select("id", "depth", "speed")
    plain = fit.selectExpr("id", "CAST(speed AS double) AS speed", "depth")
    key = lambda r: (r.id, r.severity_code, r.confidence)
    assert sorted(map(key, M.score_severity(model, plain, "id").collect())) == sorted(
        map(key, M.score_severity_batch(model, fit, "id", FEATURES).collect()))
