"""Raw table access.

Tables are read lazily; callers select only the columns they use so the
Parquet scan's ``ReadSchema`` stays narrow and filters reach ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from wingwatch.session import configure, path_exists

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """Lazy handle on a directory of ``<name>.parquet`` tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = root

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """Pruned scan of one table; its file splits are left as they are."""
        df = self.spark.read.parquet(self.path(name))
        return df.select(*columns) if columns else df

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, self.path(name))
