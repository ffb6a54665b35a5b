"""Sinks (A12, A14-A19, H3 table upsert).

All writes go to folders under a caller-supplied root (on a cluster: a
shared file system; in tests: the session's checkpoint folder).  Partitioned
tables are rewritten with dynamic partition overwrite, so a run only
replaces the partitions it produced.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from wingwatch.operators import setops as SO
from wingwatch.session import delete_path, list_names, materialize, path_exists, touch

MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def write_table(df: DataFrame, path: str, if_exists: str = "append",
                partition_by: list[str] | None = None, rebalance: bool = True) -> None:
    """Append / replace / fail, as a Parquet table at ``path``.

    Rows of a partitioned table are first brought together by partition (REBALANCE), so that a task
    writes few partitions and a partition has as many files as its size asks for: adaptive execution
    merges small ones and splits large ones, as a hot year, over several tasks.  Without ``rebalance`` they are
    written as they come, for rows that already lie by partition.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(MODES[if_exists])
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def stringify_complex(df: DataFrame) -> DataFrame:
    """Nested columns (struct/array/map) become JSON text for the store."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (StructType, ArrayType, MapType)) else F.col(f.name)
                       for f in df.schema.fields])


def save_features(df: DataFrame, root: str, name: str, run_date: str, created_at: str) -> str:
    """Feature set with name + creation time, partitioned by
    (feature_set_name, run_date); re-running a day replaces only that day."""
    out = stringify_complex(df).withColumns({
        "feature_set_name": F.lit(name), "run_date": F.lit(run_date).cast("date"),
        "created_at": F.lit(created_at).cast("timestamp_ntz")})
    path = os.path.join(root, "feature_store")
    write_table(out, path, "replace", partition_by=["feature_set_name", "run_date"])
    return path


def load_features(spark: SparkSession, root: str, name: str, run_date: str | None = None) -> DataFrame:
    """A feature set, latest run unless ``run_date`` (partition pruning)."""
    df = spark.read.parquet(os.path.join(root, "feature_store")).filter(F.col("feature_set_name") == name)
    if run_date is None:
        latest = df.agg(F.max("run_date")).first()[0]
        return df.filter(F.col("run_date") == F.lit(latest))
    return df.filter(F.col("run_date") == F.lit(run_date).cast("date"))


def list_feature_sets(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (name, run_date) partitions with row counts."""
    df = spark.read.parquet(os.path.join(root, "feature_store"))
    return df.groupBy("feature_set_name", "run_date").agg(F.count(F.lit(1)).alias("records"))


# ---- H3: keyed upsert with a key table and a redo log -------------------------

#: folders of the key table; a batch reads those that its keys hash to
KEY_BUCKETS = 32
#: file that says that the key table is whole (a write of some partitions leaves no _SUCCESS)
KEYED = "_KEYED"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Rollup:
    """An aggregate that an upsert keeps current: old rows of updated keys are taken out, new ones added.

    ``group`` and ``sums`` map names to columns of the table; sums are whole numbers or decimals, so that
    taking out is exact.  ``rows`` counts the rows of a group; a group without rows goes.
    """

    path: str
    group: dict[str, Column]
    sums: dict[str, Column]
    partition_col: str


def key_path(path: str) -> str:
    return f"{path}.keys"


def redo_path(path: str) -> str:
    return f"{path}.redo"


def _folders(spark: SparkSession, path: str) -> dict[str | None, str]:
    """Partition value as text -> name of its folder, by listing (names are escaped on disk)."""
    found: dict[str | None, str] = {}
    for name in list_names(spark, path) if path_exists(spark, path) else ():
        if "=" in name:
            value = name.split("=", 1)[1]
            found[None if value == NULL_FOLDER else unquote(value)] = name
    return found


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _key_rows(rows: DataFrame, keys: list[str], partition_col: str) -> DataFrame:
    """Rows of the key table: the keys, the text of the partition value (empty and NULL share a folder), the bucket."""
    text = F.col(partition_col).cast("string")
    return rows.select(*[F.col(k).alias(k) for k in keys], F.when(text != "", text).alias("_part"),
                       F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket"))


def _read_folders(spark: SparkSession, path: str, schema: StructType, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[os.path.join(path, n) for n in sorted(names)])


def _stage(df: DataFrame, folder: str, partition_by: list[str]) -> None:
    write_table(df, folder, "replace", partition_by)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str],
                 partition_col: str, staging_dir: str, rollups: tuple[Rollup, ...] = ()) -> int:
    """H3: latest row per key; returns the number of data files that it read.

    A side table beside ``path`` says which partition holds each key.  The batch is joined with the
    side table's buckets that its keys hash to, so only partitions that hold an updated key, or take
    one, are read and rewritten; a key may move, and partitions that this empties are removed.  NULL is
    a key and a partition value like any other.

    All results are staged first, then a redo log is written, then they are put in place.  A run that
    stops before the log changed nothing; one that stops after it is finished by the next call.  So
    repeating a call, or going on after a crash at any step, gives the same tables.
    """
    finish_upsert(spark, path)
    stage = lambda name: os.path.join(staging_dir, name)
    SO.dedup_by_key(updates, keys, order, latest=True).write.mode("overwrite").parquet(stage("batch"))
    batch = spark.read.schema(updates.schema).parquet(stage("batch"))
    batch_keys = _key_rows(batch, keys, partition_col)
    folders = _folders(spark, path)
    names: set[str] = set()
    key_schema = batch_keys.schema
    keyed = path_exists(spark, os.path.join(key_path(path), KEYED))
    if folders:
        if not keyed:  # a table from before the key table
            _stage(_key_rows(spark.read.schema(updates.schema).parquet(path), keys, partition_col), key_path(path), ["_bucket"])
        buckets = {str(r[0]) for r in batch_keys.select("_bucket").distinct().collect()}  # at most KEY_BUCKETS
        known = _folders(spark, key_path(path))
        held = _read_folders(spark, key_path(path), key_schema, [known[b] for b in buckets if b in known])
        old = held.join(batch_keys, _same_key(held, batch_keys, keys), "left_semi").select("_part")
        touched = old.union(batch_keys.select("_part")).distinct().collect()  # one row a partition
        names = {folders[r[0]] for r in touched if r[0] in folders}
    current = _read_folders(spark, path, updates.schema, list(names))
    if not names:
        merged = batch
    elif keyed:
        merged = _latest(current, batch, keys, order)
    else:  # its keys may repeat
        merged = SO.upsert(current, batch, keys, order)
    _stage(merged, stage("rows"), [partition_col])
    staged = spark.read.schema(merged.schema).parquet(stage("rows"))
    if names:
        placed = _key_rows(staged.join(batch_keys, _same_key(staged, batch_keys, keys), "left_semi"), keys, partition_col)
    else:
        placed = batch_keys
    if folders:
        placed = held.join(batch_keys, _same_key(held, batch_keys, keys), "left_anti").unionByName(placed)
    _stage(placed, stage("keys"), ["_bucket"])
    steps = [[stage("rows"), path, partition_col], [stage("keys"), key_path(path), "_bucket"]]
    dropped = [os.path.join(path, n) for n in sorted(names - set(_folders(spark, stage("rows")).values()))]
    for i, rollup in enumerate(rollups):
        target, gone = _stage_rollup(spark, rollup, current if names else None, staged, batch_keys, keys, stage(f"rollup-{i}"))
        steps.append([stage(f"rollup-{i}"), target, rollup.partition_col])
        dropped += gone
    log = json.dumps({"steps": steps, "drop": dropped, "staging": staging_dir})
    spark.createDataFrame([(log,)], "value string").coalesce(1).write.mode("overwrite").text(redo_path(path))
    n_files = len(current.inputFiles()) if names else 0
    finish_upsert(spark, path)
    return n_files


def _latest(current: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key of two frames that each hold a key once; the batch wins a tie.  Each side is joined with the
    keys and the order of the other, so its rows are neither packed nor aggregated."""
    def newer(rows: DataFrame, other: DataFrame, wins_tie: bool) -> DataFrame:
        names = [f"_k{i}" for i in range(len(keys))]
        o = other.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.struct(*order).alias("_other"))
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(o[n]) for k, n in zip(keys, names)])
        own, theirs = F.struct(*order), F.col("_other")
        return (rows.join(o, same, "left").filter(theirs.isNull() | (own >= theirs if wins_tie else own > theirs))
                .drop(*names, "_other"))

    return newer(current, batch, False).unionByName(newer(batch, current, True))


def _stage_rollup(spark: SparkSession, rollup: Rollup, current: DataFrame | None, staged: DataFrame, batch_keys: DataFrame,
                  keys: list[str], folder: str) -> tuple[str, list[str]]:
    """Stages the new state of the rollup's partitions that the batch changes; (path, folders that go).  ``current``
    is None where all staged rows are new."""
    def signed(rows: DataFrame, sign: int) -> DataFrame:
        hit = rows if current is None else rows.join(batch_keys, _same_key(rows, batch_keys, keys), "left_semi")
        return hit.select(*[c.alias(k) for k, c in rollup.group.items()], F.lit(sign).cast("long").alias("rows"),
                          *[(c * sign).alias(k) for k, c in rollup.sums.items()])

    measures = ["rows", *rollup.sums]

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*rollup.group).agg(*[F.sum(m).cast(kinds[m].dataType).alias(m) for m in measures])

    change = signed(staged, 1)
    kinds = change.schema
    if current is not None:
        change = signed(current, -1).unionByName(change)
    change = materialize(summed(change))  # a few rows a day
    text = F.col(rollup.partition_col).cast("string")
    parts = [r[0] for r in change.select(F.when(text != "", text)).distinct().collect()]  # one row a partition
    known = _folders(spark, rollup.path)
    names = [known[p] for p in parts if p in known]
    state = summed(_read_folders(spark, rollup.path, change.schema, names).unionByName(change)).filter("rows <> 0")
    _stage(state, folder, [rollup.partition_col])
    return rollup.path, [os.path.join(rollup.path, n) for n in sorted(set(names) - set(_folders(spark, folder).values()))]


def finish_upsert(spark: SparkSession, path: str) -> None:
    """Puts what the redo log names in place; does nothing without a whole log.  Every step overwrites
    whole partitions or removes folders, so it can be repeated."""
    if not path_exists(spark, os.path.join(redo_path(path), "_SUCCESS")):
        return
    log = json.loads(spark.read.text(redo_path(path)).first()[0])
    for staged, target, column in log["steps"]:
        if _folders(spark, staged):  # something to put in place
            write_table(spark.read.option("basePath", staged).schema(_stored_schema(spark, staged, column)).parquet(staged), target, "replace", [column], rebalance=False)
    for folder in log["drop"]:
        delete_path(spark, folder)
    touch(spark, os.path.join(key_path(path), KEYED))
    delete_path(spark, redo_path(path))
    delete_path(spark, log["staging"])


def _stored_schema(spark: SparkSession, folder: str, column: str) -> StructType:
    """Schema of a staged table with its partition column as text, as the folders spell it."""
    inferred = spark.read.option("basePath", folder).parquet(folder).schema
    return StructType([StructField(f.name, StringType()) if f.name == column else f for f in inferred])


def export_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines or CSV (nested fields as JSON text) export."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        stringify_complex(df).write.mode("overwrite").option("header", True).csv(path)
