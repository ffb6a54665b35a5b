"""Histogram boosting against a plain numpy statement, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingwatch.operators import boosting as B


def plain_fit(x, y, w, cuts, n_classes, rounds, depth, rate, ridge):
    """The same trees, one node at a time over all rows."""
    bins = B.binned(x, cuts)
    outputs = max(n_classes, 1)
    margin = np.zeros((len(y), outputs))
    if n_classes == 0:
        margin += (y * w).sum() / w.sum()
    for _ in range(rounds):
        g, h = (v / 2.0 ** B.SCALE for v in B.gradients(margin, y, w, n_classes))
        step = np.zeros_like(margin)
        for k in range(outputs):
            def grow(rows, level):
                G, H = g[rows, k].sum(), h[rows, k].sum()
                best = (B.MIN_GAIN, None)
                if level < depth:
                    for j in range(x.shape[1]):
                        for c in np.unique(bins[rows, j])[:-1]:
                            left = rows[bins[rows, j] <= c]
                            GL, HL = g[left, k].sum(), h[left, k].sum()
                            if HL < B.MIN_HESSIAN or H - HL < B.MIN_HESSIAN:
                                continue
                            gain = GL * GL / (HL + ridge) + (G - GL) ** 2 / (H - HL + ridge) - G * G / (H + ridge)
                            if gain > best[0] + 1e-12:
                                best = (gain, (j, c))
                if best[1] is None:
                    step[rows, k] = -rate * G / (H + ridge)
                    return
                j, c = best[1]
                grow(rows[bins[rows, j] <= c], level + 1)
                grow(rows[bins[rows, j] > c], level + 1)

            grow(np.arange(len(y)), 0)
        margin += step
    return margin


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=400), rng.integers(0, 5, 400), rng.exponential(size=400)], axis=1)
    y = ((x[:, 0] > 0.3).astype(int) + 2 * (x[:, 1] > 2) * (x[:, 2] > 0.5)).clip(0, 3)
    return x, y, np.where(y == 3, 2.0, 1.0)


def frame(spark, x, y, w):
    return spark.createDataFrame([(i, *map(float, r), float(t), float(v)) for i, (r, t, v) in enumerate(zip(x, y, w))],
                                 "id long, a double, b double, c double, y double, w double").repartition(5)


@pytest.mark.parametrize("n_classes", [4, 0])
def test_equals_plain_statement(spark, data, n_classes):
    x, y, w = data
    df = frame(spark, x, y, w)
    model = B.fit(df, ["a", "b", "c"], "y", n_classes, "w", rounds=3, depth=3)
    want = plain_fit(x, y.astype(float), w, model["cuts"], n_classes, 3, 3, 0.3, 1.0)
    assert np.allclose(B.margins(model, x), want, atol=1e-6)
    out = B.predict(df, model, "id", ("y",)).toPandas().sort_values("id")
    if n_classes:
        p = np.stack(out["probabilities"])
        assert np.allclose(p, B.softmax(want), atol=1e-6) and np.allclose(p.sum(axis=1), 1)
        assert (out["class"].to_numpy() == p.argmax(axis=1)).all() and (out["class"].to_numpy() == y).mean() > 0.9
    else:
        assert np.allclose(out["prediction"], want[:, 0], atol=1e-6)


def test_same_model_whatever_the_partitions(spark, data):
    x, y, w = data
    df = frame(spark, x, y, w)
    one, five = (B.fit(d, ["a", "b", "c"], "y", 4, "w", rounds=2, depth=3) for d in (df.coalesce(1), df))
    assert np.array_equal(B.margins(one, x), B.margins(five, x))


def test_columns_are_drawn_once_a_tree(spark, data):
    x, y, w = data
    model = B.fit(frame(spark, x, y, w), ["a", "b", "c"], "y", 4, rounds=4, depth=4, column_share=0.34, row_share=0.8)
    used = [set(t["feature"][t["feature"] >= 0].tolist()) for trees in model["rounds"] for t in trees]
    assert all(len(u) <= 1 for u in used) and len(set().union(*used)) > 1
    shares = [s for _, s, _ in B.importance(model)]
    assert shares == sorted(shares, reverse=True) and abs(sum(shares) - 1) < 1e-9


def test_no_rows_missing_values_and_one_class(spark):
    kind = "id long, a double, y int"
    empty = spark.createDataFrame([], kind)
    model = B.fit(empty, ["a"], "y", 3, rounds=2)
    assert model["rounds"] == [] and B.predict(empty, model, "id").collect() == []
    rows = spark.createDataFrame([(i, float("nan") if i % 2 else None if i % 3 else float(i), 1 if i != 7 else None) for i in range(20)], kind)
    model = B.fit(rows, ["a"], "y", 3, rounds=2)
    out = B.predict(rows, model, "id").select(F.col("class")).collect()
    assert len(out) == 20 and {r[0] for r in out} == {1}
