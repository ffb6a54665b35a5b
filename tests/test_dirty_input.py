"""Input that used to abort, hang or lose rows."""

import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingwatch.functions import text as T
from wingwatch.functions import weather as W
from wingwatch.operators import enrich as EN
from wingwatch.operators import ingest as IN
from wingwatch.operators import quantiles as Q
from wingwatch.operators import trees as TR
from wingwatch.session import checkpoint_dir
from wingwatch.sources import sinks as S

UPSERT = "k int, v string, d int, y int"


def _root(spark):
    return os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")


def _upsert(spark, path, rows, n):
    S.upsert_table(spark, path, spark.createDataFrame(rows, UPSERT), ["k"], ["d"], "y", f"{path}-staging-{n}")
    return sorted((r["k"], r["v"], r["y"]) for r in spark.read.schema(UPSERT).parquet(path).collect())


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_upsert_keeps_null_partitions_and_moves_keys(spark, scheme):
    path = scheme + os.path.join(_root(spark), "t")
    _upsert(spark, path, [(1, "a", 0, None), (2, "b", 0, 2000), (3, "c", 0, 2000), (5, "e", 0, 2002)], 0)
    second = [(4, "d", 1, None), (3, "C", 1, 2001), (5, "E", 1, None)]
    want = [(1, "a", None), (2, "b", 2000), (3, "C", 2001), (4, "d", None), (5, "E", None)]
    assert _upsert(spark, path, second, 1) == want
    assert _upsert(spark, path, second, 2) == want  # a replayed batch


def test_empty_arrays_in_payloads(spark):
    rows = [(1, '{"data": []}'), (2, '{"weather": []}'), (3, '{"data": [{"temp": 1, "weather": []}]}'), (4, "{}"), (5, "no json"), (6, None)]
    got = W.flatten_weather_payload(spark.createDataFrame(rows, "id int, payload string")).collect()
    assert len(got) == 6


def test_numbers_that_do_not_fit(spark):
    df = spark.createDataFrame([("3000000000",), ("-12",), ("2.5",), (None,), ("99999999999999999999999",)], "v string")
    assert [r[0] for r in df.select(T.safe_int(F.col("v"))).collect()] == [0, -12, 0, 0, 0]


def test_quantiles_with_nan_and_infinities(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=1000).tolist(), 1e-320, 2e-320, 1e308, -1e308, 5.0, 5.0, 5.0]
    rows = [(v,) for v in values] + [(float("nan"),), (None,), (float("inf"),), (float("-inf"),)]
    got = Q.exact_quantiles(spark.createDataFrame(rows, "x double"), "x", [0.0, 0.01, 0.25, 0.5, 0.99, 1.0], accuracy=50, buckets=16)
    known = sorted([*values, math.inf, -math.inf])
    assert got[0.0] == -math.inf and got[1.0] == math.inf
    for p in (0.01, 0.25, 0.5, 0.99):
        at = p * (len(known) - 1)
        lo, hi = known[math.floor(at)], known[math.ceil(at)]
        assert got[p] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12, abs=1e-300)
    assert Q.exact_quantiles(spark.createDataFrame([(float("nan"),)], "x double"), "x", [0.5]) == {0.5: None}


def test_reports_with_line_breaks_and_rejects(spark):
    path = os.path.join(_root(spark), "r.tsv")
    text = 'ACN\tReport 1 / Narrative\n1\t"line one\nline ""two"""\n2\tplain\n3\tx\ttoo\tmany'
    spark.createDataFrame([(text,)], "t string").coalesce(1).write.text(path)
    rows, rejects = IN.read_delimited(spark, path)
    assert [(r[0], r[1]) for r in rows.collect()] == [("1", 'line one\nline "two"'), ("2", "plain")]
    assert rejects.count() == 1


def test_two_payloads_for_one_incident(spark):
    inc = spark.createDataFrame([(1, 1.0, 2.0, None, None), (2, None, 2.0, None, None)],
                                "id long, latitude double, longitude double, weather_data string, weather_conditions string")
    parsed = W.flatten_weather_payload(spark.createDataFrame(
        [(1, "{}"), (1, '{"visibility": 100}'), (1, '{"visibility": 9000}')], "id long, payload string"))
    got = EN.apply_weather_update(inc, parsed).collect()
    assert len(got) == 2 and {r["id"]: r["updated"] for r in got} == {1: True, 2: False}


def test_shapley_with_many_features():
    """Additivity on a tree that uses 14 features, and the definition on a small one."""
    rng = np.random.default_rng(5)

    def grow(depth, n_features, feats, thr, left, right, value, cover):
        i = len(feats)
        feats.append(-1), thr.append(0.0), left.append(-1), right.append(-1), value.append(rng.normal()), cover.append(0.0)
        if depth:
            feats[i], thr[i] = int(rng.integers(n_features)), float(rng.normal())
            left[i] = grow(depth - 1, n_features, feats, thr, left, right, value, cover)
            right[i] = grow(depth - 1, n_features, feats, thr, left, right, value, cover)
            cover[i] = cover[left[i]] + cover[right[i]]
        else:
            cover[i] = float(rng.integers(1, 20))
        return i

    for depth, n_features in ((6, 14), (3, 3)):
        arrays = [[] for _ in range(6)]
        grow(depth, n_features, *arrays)
        tree = dict(zip(("feat", "thr", "left", "right", "value", "cover"), map(np.array, arrays)))
        ens = dict(trees=[tree], weights=[1.0], n_features=n_features)
        x = rng.normal(size=(50, n_features))
        phi, base = TR.shap_arrays(ens, x)
        assert np.allclose(phi.sum(axis=1) + base, TR.predict_arrays(ens, x))

    def value(row, known, node=0):
        f = tree["feat"][node]
        if f < 0:
            return tree["value"][node]
        l, r = tree["left"][node], tree["right"][node]
        if f in known:
            return value(row, known, l if row[f] <= tree["thr"][node] else r)
        share = tree["cover"][l] / (tree["cover"][l] + tree["cover"][r])
        return share * value(row, known, l) + (1 - share) * value(row, known, r)

    weight = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
    for row, got in zip(x[:10], phi[:10]):
        for f in range(3):
            others = [o for o in range(3) if o != f]
            want = sum(weight[len(s)] * (value(row, {*s, f}) - value(row, set(s)))
                       for s in ((), (others[0],), (others[1],), tuple(others)))
            assert got[f] == pytest.approx(want)


def test_stratified_split_keeps_null_keys(spark):
    from wingwatch.operators import stats

    rows = [(i if i % 10 else None, f"c{i % 3}") for i in range(300)] + [(None, "only"), (None, None)]
    got = stats.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label").collect()
    assert sorted(map(str, ((r.id, r.label) for r in got))) == sorted(map(str, rows))
    for label in ("c0", "c1", "c2"):
        assert [r.split for r in got if r.label == label].count("train") == 80
