"""Shared helpers of the training-data operators.

Words are runs of characters other than ``\\x20`` and ``\\x09``-``\\x0D``.  All separators are
single ASCII bytes, so the byte-level helpers (numpy over the Arrow text buffer) and the SQL
expressions (regular expressions over code points) cut the same words.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wingwatch.session import checkpoint_dir, configure

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"

#: Arrow batches are kept small, so a Python worker holds a few MB of text at a time.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one of the given tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back: cuts the
    lineage, and later passes read the table instead of recomputing it."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "wingwatch-llm", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once.  Higher-order functions evaluate a captured
    expression for every element; binding it to a lambda variable avoids that."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of ``text``."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model may learn from: crc32(doc_id as text) mod 4 is 2.
    A null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Text key of a document: its doc_id, or a digest of its text where doc_id is null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.md5(text_of(text))))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- byte-level helpers for Arrow stages -------------------------------------------------

def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array, and the n + 1 offsets of its rows
    (a null row is empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, width)[array.offset:array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, size: int = 1 << 20):
    """(first row, last row + 1) of runs of rows with about ``size`` bytes; a longer row is
    a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of uint64 values."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x = x ^ (x >> _S33)
    x = x * _MIX2
    return x ^ (x >> _S33)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base & (2**64 - 1)
    while filled < n:
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step & (2**64 - 1)
    return out


class WordHasher:
    """64-bit hashes of the words in a byte array, without a loop over words."""

    def __init__(self, lower: bool = True, segment: int = 1 << 20):
        self.segment = segment
        codes = _BYTES[_LOWER] if lower else _BYTES.copy()
        self.codes = np.where(_SPACE, np.uint64(0), codes)
        self._grow(segment + 4096)

    def _grow(self, n: int) -> None:
        self.up = _powers(_BASE, n)
        self.down = _powers(pow(_BASE, -1, 2**64), n)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each word of ``data``; worked off in segments cut at spaces."""
        starts, ends, hashes, at, n = [], [], [], 0, len(data)
        while at < n:
            to = min(n, at + self.segment)
            while to < n and not _SPACE[data[to]]:  # never cut a word
                rest = np.flatnonzero(_SPACE[data[to:to + self.segment]])
                to = to + int(rest[0]) if len(rest) else min(n, to + self.segment)
            s, e, h = self._segment(data[at:to])
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = to
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)

    def _segment(self, data: np.ndarray):
        if len(data) > len(self.up):
            self._grow(len(data))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[data]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            return s, e, np.zeros(0, np.uint64)
        sums = np.add.reduceat(self.codes[data] * self.up[:len(data)], s)
        return s, e, mix64(sums * self.down[s] + (e - s).astype(np.uint64))
