"""wingwatch: safety-risk analytics as Spark batch jobs.

Sub-packages
------------
sources    readers for the raw tables, adapter views, sinks
functions  pure ``Column -> Column`` feature expressions
operators  DataFrame -> DataFrame operators (quality, enrichment, rules,
           analytics, ranking, set ops, models)
plans      composite jobs and the query catalogue
streaming  incremental (Structured Streaming) variants of the batch jobs
"""

from wingwatch.session import configure, get_session, checkpoint_dir

__all__ = ["configure", "get_session", "checkpoint_dir"]
