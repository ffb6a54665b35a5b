"""Steps that must grow no faster than their input: what is kept on disk, tasks of a fit, look-ups, merges."""

import os
import random
import uuid

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wingwatch.operators import enrich as EN
from wingwatch.operators import iforest as IF
from wingwatch.operators import models as M
from wingwatch.operators import quantiles as Q
from wingwatch.operators import trees as TR
from wingwatch.session import checkpoint_dir
from wingwatch.sources import delimited as D
from wingwatch.sources import sinks as S


def _size(folder):
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(folder) for f in fs)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_delimited_reader_keeps_its_rows_once(spark):
    """two uncompressed copies of the files lay beside them before."""
    root = checkpoint_dir(spark)
    folder = os.path.join(root, f"tsv-{uuid.uuid4().hex}")
    os.makedirs(folder)
    rng = random.Random(1)
    rows = [(str(i), " ".join(rng.choice(["wind", "gust", "runway", "left", "engine"]) for _ in range(300))) for i in range(1500)]
    with open(os.path.join(folder, "a.tsv"), "w") as f:
        f.write("\n\nACN\tText\n" + "".join(f"{a}\t{b}\n" for a, b in rows))
    before = _size(root)
    found, rejects = D.read_delimited(spark, folder)
    assert found.columns == ["ACN", "Text"] and rejects.isEmpty()
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    assert _size(root) - before < 0.6 * _size(folder)


def test_fit_rows_are_spread(spark):
    """A fit ran on as many tasks as its source file had splits."""
    df = spark.range(0, 60_000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"))
    got = M.training_sample(df, "id")
    assert got.rdd.getNumPartitions() == 3
    assert got.count() == 60_000 and got.agg(F.sum("id")).first()[0] == sum(range(60_000))
    assert M.spread(df.limit(100), "id", 100).rdd.getNumPartitions() == 1


def test_prepared_rows_are_read_from_one_copy(spark):
    """Every pass for the medians read and joined the sources again."""
    df = spark.range(0, 60_000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"))
    got, medians = M.prepare(df, "id", ["x"])
    assert "Range" not in _plan(got) and medians == {"x": 30_000.0}
    assert got.count() == 60_000 and got.filter("x IS NULL").isEmpty()


def test_aircraft_types_are_looked_up_by_hash(spark):
    """each row went through the whole index of substrings, twice and again for a filter."""
    inc = spark.createDataFrame([(1, "cessna", "172"), (2, None, "172"), (3, "zzz", None), (4, "zzz", ""), (5, "ZZZ", "737-800"), (1, "BOEING", None)],
                                "id long, aircraft_make string, aircraft_model string")
    got = EN.aircraft_matches(inc)
    assert "element_at" not in _plan(got) and _plan(got.filter("matched")).count("BroadcastHashJoin") == 2
    matched = {(r["id"], r["matched"]) for r in got.collect()}
    assert got.count() == 5 and {(1, True), (3, False), (4, False), (5, True)} == matched
    assert {r["id"] for r in EN.aircraft_matches(inc, legacy_empty_match=True).filter("matched").collect()} == {1, 3, 4, 5}


def test_path_lengths_are_those_of_a_plain_walk():
    """Rows in pieces, leaves as their own children."""
    rng = np.random.default_rng(3)
    X = rng.normal(size=(IF.PATH_ROWS + 77, 4))
    X[5, 2] = np.nan
    trees = []
    for t in range(5):
        rows = IF._grow(rng.normal(size=(64, 4)), np.random.default_rng(t), 6)
        trees.append(dict(zip(("feat", "thr", "left", "right", "size"), (np.array([r[i] for r in rows]) for i in range(1, 6)))))
    trees.append(dict(feat=np.array([-1]), thr=np.zeros(1), left=np.array([-1]), right=np.array([-1]), size=np.array([7.0])))

    def plain(x):
        total = 0.0
        for t in trees:
            node, depth = 0, 0
            while t["feat"][node] >= 0:
                node, depth = t["left" if x[t["feat"][node]] < t["thr"][node] else "right"][node], depth + 1
            total += depth + float(IF.c_factor(np.array([t["size"][node]]))[0])
        return total / len(trees)

    got = IF.path_lengths(dict(trees=trees), X)
    assert np.allclose(got[::97], [plain(x) for x in X[::97]], rtol=0, atol=1e-12) and got[5] == plain(X[5])


def test_merge_neither_packs_nor_aggregates_rows(spark):
    """all rows of touched partitions were sorted and aggregated as structs; a null is a key."""
    old = spark.createDataFrame([(1, 0, "a"), (2, 5, "b"), (3, 1, "c"), (None, 0, "n")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 1, "A"), (2, 4, "late"), (3, 1, "C"), (None, None, "N"), (9, 0, "new")], "id int, at int, v string")
    got = S._latest(old, new, ["id"], ["at"])
    assert "Aggregate" not in _plan(got)
    assert sorted((r["id"] or 0, r["v"]) for r in got.collect()) == [(0, "n"), (1, "A"), (2, "b"), (3, "C"), (9, "new")]


def test_key_table_is_built_once(spark, monkeypatch):
    """every batch built the key table again from the whole table, and merged as into a table without one."""
    root = os.path.join(checkpoint_dir(spark), f"keyed-{uuid.uuid4().hex}")
    rows = lambda at, v: spark.createDataFrame([(i, at, v, i % 2) for i in range(6)], "id int, at int, v string, part int")
    upsert = lambda df: S.upsert_table(spark, os.path.join(root, "t"), df, ["id"], ["at"], "part", os.path.join(root, "s"))
    upsert(rows(0, "a"))
    called = []
    monkeypatch.setattr(S.SO, "upsert", lambda *a: called.append(a))
    upsert(rows(1, "b").filter("id < 3"))
    got = {(r["id"], r["v"]) for r in spark.read.parquet(os.path.join(root, "t")).collect()}
    assert not called and got == {(i, "b" if i < 3 else "a") for i in range(6)}


def test_large_trees_are_looked_up_in_groups(monkeypatch):
    """a tree of many leaf words, trees in several groups, rows on a threshold."""
    rng = np.random.default_rng(4)
    trees = []
    for t in range(6):
        rows = IF._grow(rng.normal(size=(2000, 3)), np.random.default_rng(t), 11)
        trees.append(dict(zip(("feat", "thr", "left", "right", "size"), (np.array([r[i] for r in rows]) for i in range(1, 6)))))
    assert max((t["feat"] < 0).sum() for t in trees) > 256
    X = rng.normal(size=(200, 3))
    X[:50, 1] = rng.choice(trees[0]["thr"][trees[0]["feat"] == 1], 50)
    X[50:60, 0], X[60:70, 2] = np.nan, np.inf

    def plain(x, t):
        node, depth = 0, 0
        while t["feat"][node] >= 0:
            node, depth = t["left" if x[t["feat"][node]] < t["thr"][node] else "right"][node], depth + 1
        return depth + float(IF.c_factor(np.array([t["size"][node]]))[0])

    whole = IF.path_tables(dict(trees=trees), 3)
    monkeypatch.setattr(IF, "GROUP_NODES", 700)
    groups = IF.path_tables(dict(trees=trees), 3)
    assert len(whole) == 1 and len(groups) > 2
    want = [sum(plain(x, t) for t in trees) / len(trees) for x in X]
    for tables in (whole, groups):
        assert np.allclose(IF.path_lengths(dict(trees=trees), X, tables), want, rtol=0, atol=1e-12)


def _ensemble(rng, n_features, n_trees, depth):
    trees = []
    for _ in range(n_trees):
        n = 2 ** (depth + 1) - 1
        at, inner = np.arange(n), 2 ** depth - 1
        split = at < inner
        cover = np.where(split, 0.0, rng.integers(1, 20, n))
        for i in range(inner - 1, -1, -1):
            cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
        trees.append(dict(feat=np.where(split, rng.integers(0, n_features, n), -1), thr=np.where(split, np.round(rng.normal(size=n), 1), 0.0),
                          left=np.where(split, 2 * at + 1, -1), right=np.where(split, 2 * at + 2, -1), value=rng.normal(size=n), cover=cover))
    return dict(trees=trees, weights=[1.0] * n_trees, n_features=n_features)


def test_shapley_cells_are_solved_once(spark, monkeypatch):
    """every batch of rows was solved again, though its rows take the ways of known ones."""
    rng = np.random.default_rng(6)
    for n_features, n_trees in ((3, 4), (40, 30)):  # cells as numbers and as bytes
        ens = _ensemble(rng, n_features, n_trees, 4)
        X = np.round(rng.normal(size=(300, n_features)), 1)
        X[0, 0], X[1, 2], X[2, 1] = np.nan, np.inf, -np.inf
        assert TR.cell_ids(ens, X).dtype.kind == ("i" if n_features == 3 else "V")
        want = np.column_stack([TR.shap_arrays(ens, X)[0], TR.predict_arrays(ens, X)])
        with monkeypatch.context() as m:
            assert np.array_equal(TR.solved(ens, X), want)
            m.setattr(TR, "shap_arrays", None)
            assert np.array_equal(TR.solved(ens, X[::-1]), want[::-1])
        monkeypatch.setattr(TR, "KNOWN_CELLS", 10)  # forgets, and starts with the new ones
        assert np.array_equal(TR.solved(ens, X[:200]), want[:200]) and np.array_equal(TR.solved(ens, X), want)
        monkeypatch.undo()
    ens = _ensemble(rng, 2, 3, 3)
    rows = [(i % 3 if i % 7 else None, float(i % 5) - 2 if i % 11 else None, float(i % 4)) for i in range(100)]
    got = TR.shap_frame(spark.createDataFrame(rows, "id long, a double, b double").repartition(3), ens, ["a", "b"], "id")
    assert got.columns == ["id", "shap_a", "shap_b", "base_value", "prediction"] and got.count() == 100
    X = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    phi, base = TR.shap_arrays(ens, X)
    want = sorted((-1 if r[0] is None else r[0], *p, base, y) for r, p, y in zip(rows, phi, TR.predict_arrays(ens, X)))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want


def test_prepared_rows_are_not_shuffled(spark):
    """all rows were shuffled and sorted by key before the passes for the medians."""
    df = spark.range(0, 300_000, 1, 1).select("id", *[F.rand(i).alias(f"x{i}") for i in range(4)])
    got, _ = M.prepare(df, "id", [f"x{i}" for i in range(4)])
    files = got.inputFiles()
    assert len(files) == 1 and pq.ParquetFile(files[0].removeprefix("file://")).num_row_groups > 1
    assert got.count() == 300_000 and got.agg(F.sum("id")).first()[0] == sum(range(300_000))


def test_quantiles_count_in_arrays(spark):
    """every row below a bracket went through a row generator in each pass; a range wider than a double was not divided."""
    rng = random.Random(7)
    big = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(3000)]
    few = [float(rng.randrange(5)) for _ in range(3000)]
    rows = [(a if i % 9 else None, b if i % 5 else float("nan")) for i, (a, b) in enumerate(zip(big, few))]
    rows += [(float("inf"), -0.0), (float("-inf"), 0.0), (5e-324, None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = Q.multi_quantiles(df, {"a": probs, "b": probs})
    for k, c in enumerate("ab"):
        known = sorted(r[k] for r in rows if r[k] is not None and r[k] == r[k])
        for p in probs:
            at = p * (len(known) - 1)
            lo, hi = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
            assert got[c][p] == (lo if lo == hi or at == int(at) else lo + (hi - lo) * (at - int(at)))
    passes = "mapinarrow" in _plan(df.select("a", "b").mapInArrow(Q._counter([(0, -1.0, 1.0)], 16), Q.COUNTS)).lower()
    under, bins = Q._pass(df, [(0, -1.0, 1.0)], 16)[0]
    assert passes and under == sum(a is not None and a < -1 for a, _ in rows) and len(bins) <= 16
    assert sum(c for _, _, c in bins) == sum(a is not None and -1 <= a <= 1 for a, _ in rows)


def test_fits_learn_from_all_rows(spark):
    """A fit learned from 2,000,000 rows at most; the share was taken with a hash of the key, so that rows without key went together."""
    df = spark.range(0, 2_100_000, 1, 4).select("id")
    got = M.training_rows(df, "id")
    assert got.count() == 2_100_000 and got.agg(F.sum("id")).first()[0] == 2_100_000 * 2_099_999 // 2
    assert got.rdd.getNumPartitions() == 24 and M.task_rows(60_000) == 25_000 and M.task_rows(10 ** 9) == 250_000
