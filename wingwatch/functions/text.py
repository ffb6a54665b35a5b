"""Ingest normalisation expressions.

Per-row Python in the reference (``iterrows`` loops, ``safe_*`` helpers)
becomes column expressions; bad values turn into NULL/defaults through
``try_*`` functions instead of exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wingwatch.functions import constants as K
from wingwatch.functions.incident import lookup


def safe_int(v: Column) -> Column:
    """C11 ``safe_int``: int(text) or 0.  Text must be an integer literal
    (Python ``int('2.5')`` fails); one that does not fit an integer column is 0."""
    s = F.trim(v.cast("string"))
    if_text = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))
    return F.coalesce(if_text, F.lit(0))


def safe_float(v: Column) -> Column:
    """C11 ``safe_float``: float(text) or NULL."""
    return F.trim(v.cast("string")).try_cast("double")


def safe_str(v: Column, max_len: int = 255) -> Column:
    """NULL/empty -> NULL, else truncated to ``max_len`` characters."""
    return F.nullif(F.substring(v.cast("string"), 1, max_len), F.lit(""))


def join_location(*parts: Column) -> Column:
    """Non-NULL parts joined by ', '; NULL when none."""
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def injury_code_severity(code: Column) -> Column:
    """FATL/SERS/MINR/NONE -> severity; NULL/unknown -> NONE."""
    return lookup(code, K.INJURY_CODE_SEVERITY, "NONE")


def phase_code(code: Column) -> Column:
    """Accident phase code -> flight phase; NULL/unknown -> UNKNOWN."""
    return lookup(code, K.PHASE_CODE_MAP, "UNKNOWN")


def keyword_severity(result: Column, anomaly: Column) -> Column:
    """C16: 'collision' in result/anomaly -> SERIOUS; 'deviation'/'excursion'
    in result -> MINOR; else NONE (case-insensitive, NULL is empty text)."""
    r = F.lower(F.coalesce(result, F.lit("")))
    a = F.lower(F.coalesce(anomaly, F.lit("")))
    return (F.when(r.contains("collision") | a.contains("collision"), "SERIOUS")
            .when(r.contains("deviation") | r.contains("excursion"), "MINOR")
            .otherwise("NONE"))


def keyword_phase(text: Column) -> Column:
    """C17: first of the ordered keywords contained in the text; else UNKNOWN."""
    t = F.lower(text)
    expr = None
    for key, phase in K.REPORT_PHASE_KEYWORDS:
        expr = F.when(t.contains(key), phase) if expr is None else expr.when(t.contains(key), phase)
    return F.coalesce(expr, F.lit("UNKNOWN"))


def parse_multi_date(text: Column) -> Column:
    """First format that parses, in the reference's order; NULL if none."""
    s = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in K.REPORT_DATE_FORMATS]
                      ).cast("timestamp_ntz")
