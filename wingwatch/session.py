"""Session helpers.

Every job runs on a caller-supplied ``SparkSession``.  ``configure`` only
sets runtime SQL options that change plans, never results: adaptive query
execution (partition coalescing, skew-join splitting, runtime broadcast
choice), UTC session time zone and Arrow transfer for the few Pandas stages.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_package() -> None:
    """Make functions of this package usable in the Python workers: they are
    pickled by value, so nothing has to be installed on, or copied to, the
    executors (the Arrow stages otherwise pickle them by reference)."""
    import wingwatch

    cloudpickle.register_pickle_by_value(wingwatch)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package()
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster it must come from ``spark.checkpoint.dir`` (a shared file
    system every executor sees).  Only a local-mode session without that
    setting (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder"
            )
        path = tempfile.mkdtemp(prefix="wingwatch-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(path, "rdd"))
    return path


def materialize(df):
    """Cut lineage reliably: write ``df`` once to the shared checkpoint folder
    (``Dataset.checkpoint``) so later actions read it instead of recomputing,
    and a lost executor does not force a recompute from the sources."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df, group_mb: int | None = None):
    """``df`` written once to the shared checkpoint folder as a compressed table, and read from there: for wide or
    long frames, which ``materialize`` would hold in full size.  A file is read in tasks of whole row groups, of
    ``group_mb`` each."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"kept-{uuid.uuid4().hex}")
    w = df.write.option("compression", "zstd")
    if group_mb:
        w = w.option("parquet.block.size", group_mb << 20)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, asked of the file system it names (local, HDFS, object store)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def file_versions(spark: SparkSession, path: str) -> tuple:
    """(name, size, time) of the files at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target)))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders at ``path``, in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(target))


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "wingwatch") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # skip per-call Python stack capture while building plans (it only
        # enriches error messages and dominated plan-construction time)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
