"""Query catalogue: name -> (Spark builder, optional DuckDB oracle SQL).

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Registering a SQL
string gives it the value-hash check; queries without one (models, sinks)
get a rows-only check plus their own property tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wingwatch.plans.oracle_views import rewrite_means, with_views, wrap_counts

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` runs after the ``views`` CTEs."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            body = wrap_counts(rewrite_means(sql)).lstrip()
            if views and body[:5].upper() == "WITH ":
                ORACLE[name] = with_views(*views).rstrip() + ",\n" + body[5:]
            else:
                ORACLE[name] = (with_views(*views) if views else "") + body
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import wingwatch.plans as plans

    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("q_"):
            importlib.import_module(f"wingwatch.plans.{mod}")
