"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixing.

``STAGES`` are (name, function) pairs.  A function takes (spark, docs, sf_dir) and returns the rows
the next stage works on; all but the last return the columns of ``documents``.  ``run`` applies them
to ``documents`` with each result written as Parquet and read again.

Null or empty texts are scored like any text (and then usually go), rows without doc_id pass the
near-duplicate stage, repeated rows leave it once, and an empty table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wingwatch.llm import decontam, minhash, mixing, quality, secrets
from wingwatch.llm.common import prepare, saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned on the labelled ones, scores 0.7 or more."""
    prepare(spark)
    return quality.keep_good(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group that five-word shingles link at a
    similarity of 0.8 or more."""
    prepare(spark)
    return minhash.first_of_groups(docs, shingle=5, similarity=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of ``benchmark``."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date."""
    prepare(spark)
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes of a document, numbered in ``copy``."""
    prepare(spark)
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing to target weights", mixing_stage),
]

#: trees, lasso and MinHash have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
