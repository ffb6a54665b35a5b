"""Exact quantiles without funnelling a column through one task.

``percentile()`` keeps every distinct value of a group in one aggregation buffer; for a global
percentile that is the whole column in one task.  Here each needed order statistic is found by
range narrowing, for any number of columns at once and in the same way for any number of rows:

1. doubles are read as integers of the same order, and one pass counts every column's values in
   ``buckets`` ranges of these integers, with the lowest and highest value of each range;
2. the range that holds a needed rank becomes its bracket, from the lowest to the highest value in
   it, and is counted in ``buckets`` ranges in turn, until a range holds a single value.

A task counts its rows in arrays (``mapInArrow``), so a pass shuffles at most tasks x brackets x
``buckets`` rows.  Every pass divides a bracket by ``buckets``: six passes settle any doubles, and
small integers or measurements with few digits need two or three.  NULL and NaN are left out;
infinities rank below and above all finite values.  Quantiles interpolate linearly between the
neighbouring order statistics (numpy and pandas defaults).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "j int, bin long, c long, mn double, mx double"


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles (no NaN, no negative zero) as unsigned integers of the same order."""
    bits = np.ascontiguousarray(x, dtype=np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _numbers(column: pa.Array) -> np.ndarray:
    x = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return x[~np.isnan(x)] + 0.0  # makes a negative zero a zero


def _counter(brackets: list[tuple], buckets: int):
    """The map stage of a pass: per bracket (column, low, high) the rows below it (bin -1) and in each of its bins."""
    def run(batches):
        ranges = []
        for i, low, high in brackets:
            a, b = (int(_ordered(np.array([v + 0.0]))[0]) for v in (low, high))
            shift = 0
            while (b - a) >> shift >= buckets:
                shift += 1
            bins = ((b - a) >> shift) + 1
            ranges.append((i, np.uint64(a), np.uint64(b), np.uint64(shift), np.zeros(bins, np.int64),
                           np.full(bins, np.inf), np.full(bins, -np.inf)))
        under = np.zeros(len(ranges), np.int64)
        for batch in batches:
            columns = {}
            for j, (i, a, b, shift, c, mn, mx) in enumerate(ranges):
                if i not in columns:
                    x = _numbers(batch.column(i))
                    columns[i] = x, _ordered(x)
                x, k = columns[i]
                under[j] += np.count_nonzero(k < a)
                inside = np.flatnonzero((k >= a) & (k <= b))
                if len(inside):
                    at, x = ((k[inside] - a) >> shift).astype(np.intp), x[inside]
                    c += np.bincount(at, minlength=len(c))
                    np.minimum.at(mn, at, x)
                    np.maximum.at(mx, at, x)
        for j, (_, _, _, _, c, mn, mx) in enumerate(ranges):
            full = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full) + 1, j, np.int32)), pa.array(np.append(full, -1)), pa.array(np.append(c[full], under[j])),
                 pa.array(np.append(mn[full], 0.0)), pa.array(np.append(mx[full], 0.0))], names=["j", "bin", "c", "mn", "mx"])
    return run


def _pass(values: DataFrame, brackets: list[tuple], buckets: int) -> list[tuple[int, list]]:
    """(rows below, [(lowest, highest, rows) of each bin that has rows, ascending]) per bracket."""
    rows = (values.mapInArrow(_counter(brackets, buckets), COUNTS).groupBy("j", "bin")
            .agg(F.sum("c").alias("c"), F.min("mn").alias("mn"), F.max("mx").alias("mx")).collect())
    under = [0] * len(brackets)
    bins: list[list] = [[] for _ in brackets]
    for r in rows:
        if r["bin"] < 0:
            under[r["j"]] = r["c"]
        else:
            bins[r["j"]].append((r["mn"], r["mx"], r["c"]))
    return [(u, sorted(b)) for u, b in zip(under, bins)]


def order_statistics(values: DataFrame, open_: dict[tuple, set[int]], passed: list[tuple[int, list]], n_cols: int,
                     buckets: int) -> list[dict[int, float]]:
    """Exact k-th smallest values (0-based ranks) per column of ``values``.

    ``open_``: (column number, low, high) -> ranks whose values lie in [low, high]; ``passed``: the pass over these brackets.
    """
    result: list[dict[int, float]] = [{} for _ in range(n_cols)]
    while open_:
        left: dict[tuple, set[int]] = {}
        for ((i, _, _), ranks), (under, bins) in zip(open_.items(), passed):
            for rank in ranks:
                at = under
                for mn, mx, c in bins:
                    if rank < at + c:
                        if mn == mx:
                            result[i][rank] = mn
                        else:
                            left.setdefault((i, mn, mx), set()).add(rank)
                        break
                    at += c
        open_ = left
        passed = _pass(values, list(open_), buckets) if open_ else []
    return result


def multi_quantiles(df: DataFrame, probs_by_col: dict[str, list[float]], accuracy: int | None = None,
                    buckets: int = 4096) -> dict[str, dict]:
    """Linear-interpolated quantiles of several columns (NULL and NaN left out).

    ``accuracy`` was that of a sketch that came before the counts; nothing depends on it.
    """
    cols = list(probs_by_col)
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    whole = [(i, -math.inf, math.inf) for i in range(len(cols))]
    passed = _pass(values, whole, buckets) if cols else []
    total = [sum(c for _, _, c in bins) for _, bins in passed]
    at = [{p: p * (n - 1) for p in probs_by_col[c]} if n else {} for c, n in zip(cols, total)]
    exact = order_statistics(values, {key: {r for h in at[key[0]].values() for r in (math.floor(h), math.ceil(h))} for key in whole},
                             passed, len(cols), buckets)
    out: dict[str, dict] = {}
    for i, c in enumerate(cols):
        out[c] = {p: None for p in probs_by_col[c]}
        for p, h in at[i].items():
            lo, hi = exact[i][math.floor(h)], exact[i][math.ceil(h)]
            out[c][p] = lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float], **kw) -> dict[float, float | None]:
    """Linear-interpolated quantiles of the non-NULL values of ``col``."""
    return multi_quantiles(df, {col: list(probs)}, **kw)[col]


def quantile_frame(df: DataFrame, col: str, probs: list[float], label: str = "percentile",
                   **kw) -> DataFrame:
    """Quantiles as a small DataFrame ``(label, value)``; label = p * 100."""
    q = exact_quantiles(df, col, probs, **kw)
    spark = df.sparkSession
    return spark.createDataFrame([(float(p * 100), None if v is None else float(v)) for p, v in q.items()],
                                 f"{label} double, value double")


def medians(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    """Exact medians per column (pandas ``median``: mean of the middle pair),
    all columns refined together."""
    q = multi_quantiles(df, {c: [0.5] for c in cols}, **kw)
    return {c: q[c][0.5] for c in cols}
