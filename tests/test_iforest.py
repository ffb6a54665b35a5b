"""Isolation forest: the draw is uniform and bounded, whatever the number of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingwatch.operators import iforest as IF


@pytest.mark.parametrize("n, psi, trees", [(40_000, 50, 100), (3_000, 50, 100), (120, 50, 20), (40, 40, 10)])
def test_every_row_is_drawn_equally_often(spark, n, psi, trees):
    df = spark.range(n).withColumnRenamed("id", "k")
    drawn = IF.draws(df, "k", n, psi, trees).select("k", "tree").toPandas()
    sizes = drawn.groupby("tree").size()
    assert not drawn.duplicated().any()  # without replacement
    assert len(sizes) == trees and (sizes <= psi).all() and (sizes >= min(psi, n) * 0.6).all()
    # inclusion is uniform: counts over 20 slices of the keys (the hash knows no order) pass a chi-squared test
    counts = np.bincount((drawn["k"].to_numpy() * 20) // n, minlength=20)
    expected = len(drawn) / 20
    assert ((counts - expected) ** 2 / expected).sum() < 50  # 19 degrees of freedom, p < 1e-4
    # and independent of the key's value, tree by tree
    means = drawn.groupby("tree")["k"].mean() / n
    assert abs(means.mean() - 0.5) < 4 * 0.29 / np.sqrt(len(drawn))


def test_one_hash_and_no_list_of_trees(spark):
    df = spark.range(200_000).withColumnRenamed("id", "k")
    plan = IF.draws(df, "k", 200_000, 256, 100)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert "Generate" not in physical and physical.count("xxhash64") <= 3 and "WindowGroupLimit" in physical


def test_repeated_keys_do_not_flood_a_tree(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    sizes = IF.draws(df, "k", 9_000, 40, 30).groupBy("tree").count().collect()
    assert max(r["count"] for r in sizes) <= 40


def test_scores_single_out_the_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))] + [(9999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    model = IF.fit(df, ["a", "b"], "k", n_trees=40, max_samples=128)
    scores = IF.score_samples(df, model, "k").toPandas().set_index("k")["score"]
    assert scores.idxmin() == 9999 and len(model["trees"]) == 40
