"""Sinks, feature store, partition-scoped upsert and the delimited reader."""

import os
import uuid

from pyspark.sql import functions as F

from wingwatch.operators import ingest as IN
from wingwatch.session import checkpoint_dir
from wingwatch.sources import sinks as S


def _root(spark):
    return os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")


def test_write_modes(spark):
    path = _root(spark)
    df = spark.range(5)
    S.write_table(df, path, "append")
    S.write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 10
    S.write_table(df, path, "replace")
    assert spark.read.parquet(path).count() == 5


def test_feature_store_latest_and_list(spark):
    root = _root(spark)
    df = spark.range(4).withColumn("arr", F.array(F.col("id")))
    S.save_features(df, root, "fs", "2024-01-01", "2024-01-01 00:00:00")
    S.save_features(df.limit(2), root, "fs", "2024-01-02", "2024-01-02 00:00:00")
    S.save_features(df.limit(1), root, "fs", "2024-01-02", "2024-01-02 00:00:00")   # re-run replaces the day
    assert S.load_features(spark, root, "fs").count() == 1
    assert S.load_features(spark, root, "fs", "2024-01-01").count() == 4
    listed = {(r["feature_set_name"], str(r["run_date"])): r["records"]
              for r in S.list_feature_sets(spark, root).collect()}
    assert listed == {("fs", "2024-01-01"): 4, ("fs", "2024-01-02"): 1}


def test_upsert_table_touches_only_updated_partitions(spark):
    root = _root(spark)
    path = os.path.join(root, "t")
    cur = spark.createDataFrame([(1, "a", 1, 2023), (2, "b", 1, 2024)], "k int, v string, d int, y int")
    S.upsert_table(spark, path, cur, ["k"], ["d"], "y", os.path.join(root, "s0"))
    upd = spark.createDataFrame([(2, "B", 2, 2024), (3, "c", 2, 2024)], "k int, v string, d int, y int")
    S.upsert_table(spark, path, upd, ["k"], ["d"], "y", os.path.join(root, "s1"))
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {1: "a", 2: "B", 3: "c"}


def test_tsv_header_resolution(spark):
    path = os.path.join(_root(spark), "r.tsv")
    spark.createDataFrame([("1", "202301", "Ground collision")], "`ACN` string, `Time / Date` string, "
                          "`Events / Result` string").write.option("sep", "\t").option("header", True).csv(path)
    raw, rejects = IN.read_delimited(spark, path)
    assert rejects.isEmpty()
    res = IN.resolve_report_columns(raw)
    assert set(res.columns) == {"acn", "date_raw", "result"}
    row = IN.normalize_reports(res).first()
    assert row["severity"] == "SERIOUS" and row["external_id"] == "1"


# ---- H3: key table, redo log, rollups --------------------------------------------------------------

KIND = "k int, v string, n int, d int, p string"
ODD = ["a:b", "c/d", "e%f", "g h", "", None, "2020"]


def _drain(spark, path, rows, n, **kw):
    S.upsert_table(spark, path, spark.createDataFrame(rows, KIND), ["k"], ["d"], "p", f"{path}-stage-{n}", **kw)


def _state(spark, path):
    return sorted(((r["k"] is None, r["k"], r["v"], r["p"]) for r in spark.read.schema(KIND).parquet(path).collect()), key=repr)


def _expected(*batches):
    latest = {}
    for rows in batches:
        for k, v, n, d, p in rows:
            if k not in latest or latest[k][3] <= d:
                latest[k] = (k, v, n, d, p or None)
    return sorted(((k is None, k, v, p) for k, v, n, d, p in latest.values()), key=repr)


def _two_batches():
    first = [(i, f"v{i}", i, 0, ODD[i % len(ODD)]) for i in range(40)] + [(None, "none", 1, 0, "a:b"), (99, "alone", 1, 0, "only/one")]
    # keys move between odd partitions, one partition is emptied, a NULL key is corrected, an old version comes late
    second = [(1, "x", 5, 1, "a:b"), (0, "y", 5, 1, "c/d"), (2, "z", 5, 1, None), (99, "gone", 5, 1, "e%f"), (None, "some", 5, 1, "g h"),
              (3, "late", 5, -1, "2020"), (500, "new", 5, 1, "i=j")]
    return first, second


def test_upsert_with_values_that_need_escaping(spark):
    path = os.path.join(_root(spark), "t")
    first, second = _two_batches()
    _drain(spark, path, first, 0)
    _drain(spark, path, second, 1)
    assert _state(spark, path) == _expected(first, second)
    _drain(spark, path, second, 2)  # replayed
    assert _state(spark, path) == _expected(first, second)


def test_second_drain_reads_only_partitions_that_hold_updated_keys(spark):
    path = os.path.join(_root(spark), "t")
    rows = [(i, "v", i, 0, f"p{i % 20}") for i in range(200)]
    _drain(spark, path, rows, 0)
    df = spark.createDataFrame([(3, "w", 1, 1, "p3"), (23, "w", 1, 1, "p5")], KIND)
    n_files = S.upsert_table(spark, path, df, ["k"], ["d"], "p", f"{path}-stage-1")
    held = spark.read.parquet(path)
    in_two = len({f for f in held.inputFiles() if "/p=p3/" in f or "/p=p5/" in f})
    assert n_files == in_two < len(held.inputFiles()) / 5
    assert {r["p"] for r in held.filter("k IN (3, 23)").collect()} == {"p3", "p5"} and held.count() == 200


def test_table_from_before_the_key_table(spark):
    path = os.path.join(_root(spark), "t")
    first, second = _two_batches()
    _drain(spark, path, first, 0)
    from wingwatch.session import delete_path

    delete_path(spark, S.key_path(path))
    _drain(spark, path, second, 1)
    assert _state(spark, path) == _expected(first, second)


class _Crash(Exception):
    pass


def _crash_after(monkeypatch, calls):
    """The given number of steps that change files run, the next one fails half-way (before it does anything)."""
    left = [calls]

    def wrap(name):
        inner = getattr(S, name)

        def step(*a, **kw):
            if left[0] == 0:
                raise _Crash
            left[0] -= 1
            return inner(*a, **kw)

        monkeypatch.setattr(S, name, step)

    for name in ("write_table", "delete_path"):
        wrap(name)
    return left


def test_a_crash_at_any_step_is_repaired_by_the_next_run(spark, monkeypatch):
    monkeypatch.setattr(S, "KEY_BUCKETS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    first, second = _two_batches()
    rollups = lambda path: (S.Rollup(f"{path}-sums", {"p": F.col("p"), "odd": F.col("k") % 2}, {"n": F.col("n").cast("long")}, "p"),)
    want = _expected(first, second)
    sums = None
    for calls in range(40):
        path = os.path.join(_root(spark), "t")
        _drain(spark, path, first, 0, rollups=rollups(path))
        with monkeypatch.context() as m:
            left = _crash_after(m, calls)
            try:
                _drain(spark, path, second, 1, rollups=rollups(path))
            except _Crash:
                pass
        _drain(spark, path, second, 1, rollups=rollups(path))
        assert _state(spark, path) == want, calls
        got = sorted(map(str, spark.read.parquet(f"{path}-sums").select("odd", "rows", "n", "p").collect()))
        full = (spark.read.schema(KIND).parquet(path).groupBy("p", (F.col("k") % 2).alias("odd"))
                .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).select("odd", "rows", "n", "p"))
        assert got == sorted(map(str, full.collect())), calls
        if left[0]:  # the run went through without a crash: every step has been tried
            sums = got
            break
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sums and calls >= 8


def test_partitioned_writes_have_few_files_and_split_hot_partitions(spark):
    path = os.path.join(_root(spark), "t")
    df = spark.range(0, 400_000, 1, 16).select("id", F.md5(F.col("id").cast("string")).alias("x"),
                                               F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(7).alias("y"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "2m")
    try:
        S.write_table(df, path, "replace", ["y"])
    finally:
        spark.conf.unset(key)
    files = spark.read.parquet(path).inputFiles()
    per = {}
    for f in files:
        per[f.split("/y=")[1].split("/")[0]] = per.get(f.split("/y=")[1].split("/")[0], 0) + 1
    assert per["7"] > 1  # the hot partition is written by several tasks
    assert max(n for y, n in per.items() if y != "7") <= 2  # the others are not scattered over all 16 tasks
    assert spark.read.parquet(path).count() == 400_000
