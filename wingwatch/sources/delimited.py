"""Delimited files with quoted line breaks, read by many tasks.

A line break inside a quoted field does not end a record, so a byte range of a file cannot know by itself
whether it begins inside a quoted field.  The file is read as lines by splits:

1. each split is run through the quoting rule twice, from outside and from inside a quoted field, and
   reports where it ends in both cases (one row a split);
2. chaining these rows along the file gives the true state at the start of each split, and which split
   opened the record that is still open there;
3. each split joins its lines into whole records.  The parts of a record that crosses a border are
   brought together by the split that opened it, one group a record; they alone are kept between the
   steps, and only looked for where step 2 found such records;
4. records are parsed by Spark's CSV expression.  One that does not fit the header is a reject.  The parsed
   rows are written once, as a compressed table.

The encoding is decided by the first pass as well: the first one in which no line is broken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wingwatch.session import keep, materialize

QUOTE = b'"'
CORRUPT = "_corrupt_record"


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether the end of ``line`` lies inside a quoted field.  A quote opens a field only at its start; "" inside
    is a quote; what follows a closing quote belongs to the field up to the separator."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside:
            q = line.find(QUOTE, at)
            if q < 0:
                return True
            if line[q + 1:q + 2] == QUOTE:
                at = q + 2
                continue
            inside, at = False, q + 1
        elif line[at:at + 1] == QUOTE:
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("start"), F.is_valid_utf8("value").alias("utf8"))


def _splits(batches, read):
    """(file, start, lines) of the splits of a partition, in pieces; a split's pieces follow each other."""
    for b in batches:
        files, starts, lines = (b.column(c).to_pylist() for c in ("file", "start", "line"))
        a = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or files[i] != files[a] or starts[i] != starts[a]:
                yield from read(files[a], starts[a], lines[a:i], b.column("utf8").slice(a, i - a) if "utf8" in b.schema.names else None)
                a = i


def _scan(sep: bytes):
    """Step 1: a row for each piece of a split: ends from outside and inside, whether a record that is open
    at its start ends in it, broken lines."""
    def piece(file, start, lines, utf8):
        out, inn, closed = False, True, False
        for line in lines:
            out = ends_inside(line, out, sep)
            was = inn
            inn = ends_inside(line, inn, sep)
            closed |= was and not inn
        yield (file, start, out, inn, closed, len(lines) - (utf8.to_numpy(zero_copy_only=False).sum() if len(lines) else 0))

    def run(batches):
        order, rows = 0, []
        for r in _splits(batches, piece):
            rows.append((*r[:2], order, *r[2:]))
            order += 1
            if len(rows) == 1000:
                yield _table(rows)
                rows = []
        if rows:
            yield _table(rows)

    def _table(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64())
        names = ("file", "start", "piece", "from_out", "from_in", "closes", "broken")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    return run


def _chain(rows: list) -> tuple[dict[tuple[str, int], tuple[bool, int]], bool]:
    """Step 2: (file, split) -> (starts inside a quoted field, split that opened the record); whether any split
    ends inside a quoted field."""
    known: dict[tuple[str, int], tuple[bool, int]] = {}
    ordered = sorted(rows, key=lambda r: (r["file"], r["start"], r["piece"]))
    file, inside, opener, crossing = None, False, 0, False
    for r, after in zip(ordered, [*ordered[1:], None]):
        if r["file"] != file:
            file, inside, opener = r["file"], False, 0
        if (r["file"], r["start"]) not in known:
            known[r["file"], r["start"]] = (inside, opener)
        ends = r["from_in"] if inside else r["from_out"]
        if ends and (not inside or r["closes"]):
            opener = r["start"]
        inside = ends
        crossing |= inside and (after is None or (after["file"], after["start"]) != (r["file"], r["start"]))
    return known, crossing


def _records(known: dict, sep: bytes):
    """Step 3: (file, opener, start, seq, part, first, record): whole records, and the parts of records that
    cross a border of splits (``part``)."""
    def run(batches):
        state: dict = {}

        def piece(file, start, lines, _):
            s = state
            if s.get("at") != (file, start):
                yield from flush()
                inside, opener = known[file, start]
                s.update(at=(file, start), inside=inside, opener=opener, held=[], seq=0, carried=inside)
            for line in lines:
                s["held"].append(line)
                s["inside"] = ends_inside(line, s["inside"], sep)
                if not s["inside"]:
                    record = b"\n".join(s["held"])
                    if record or s["carried"]:  # empty lines are no records
                        yield (file, s["opener"] if s["carried"] else start, start, s["seq"], s["carried"], start == 0 and s["seq"] == 0, record)
                        s["seq"] += 1
                    s["held"], s["carried"] = [], False

        def flush():
            s = state
            if s.get("held"):
                file, start = s["at"]
                yield (file, s["opener"] if s["carried"] else start, start, s["seq"], s["inside"] or s["carried"], start == 0 and s["seq"] == 0,
                       b"\n".join(s["held"]))
                s["held"] = []

        def table(rows):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              ["file", "opener", "start", "seq", "part", "first", "record"])

        rows = []
        for r in _splits(batches, piece):
            rows.append(r)
            if len(rows) == 2000:
                yield table(rows)
                rows = []
        rows += list(flush())
        if rows:
            yield table(rows)

    return run


_CUT = "file string, opener long, start long, seq long, part boolean, first boolean, record binary"


def _cut(spark: SparkSession, path: str, sep: str, encodings: tuple[str, ...]) -> tuple[DataFrame, str, bytes]:
    """(whole records as text without the header of each file, encoding, header record of the first file)."""
    s = sep.encode()
    lines = _lines(spark, path)
    scanned = lines.mapInArrow(_scan(s), "file string, start long, piece long, from_out boolean, from_in boolean, closes boolean, broken long").collect()
    broken = sum(r["broken"] for r in scanned)
    encoding = next((e for e in encodings if e.upper().replace("-", "") != "UTF8" or not broken), encodings[-1])
    known, crossing = _chain(scanned)
    cut = lines.drop("utf8").mapInArrow(_records(known, s), _CUT)
    found = cut.filter("NOT part AND NOT first").select(F.decode("record", encoding).alias("record"))
    if crossing:
        # the records that cross a border: at most one a split
        parts = materialize(cut.filter("part"))
        joined = (parts.groupBy("file", "opener").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "record", "first"))).alias("p"))
                  .select(F.get("p", F.lit(0))["first"].alias("first"),
                          F.decode(F.aggregate("p", F.lit(None).cast("binary"), lambda a, x: F.coalesce(F.concat(a, F.lit(bytearray(b"\n")), x["record"]), x["record"])),
                                   encoding).alias("record")))
        found = found.unionByName(joined.filter("NOT first").select("record"))
    files = sorted({r["file"] for r in scanned})
    return found, encoding, next((h for h in (_header(lines, s, f) for f in files) if h), b"")


def _header(lines: DataFrame, sep: bytes, file: str) -> bytes:
    """First record of a file, from as many of its lines as that takes; empty if it has none."""
    of_file, n = lines.filter(F.col("file") == file).select("line"), 16
    while True:
        head = [bytes(r[0]) for r in of_file.head(n)]
        held, inside = [], False
        for line in head:
            if not held and not line:  # empty lines are no records
                continue
            held.append(line)
            inside = ends_inside(line, inside, sep)
            if not inside:
                return b"\n".join(held)
        if len(head) < n:
            return b"\n".join(held)
        n *= 8


def records(spark: SparkSession, path: str, sep: str = "\t", encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> tuple[DataFrame, str]:
    """(whole records as text without the header of each file, encoding)."""
    return _cut(spark, path, sep, encodings)[:2]


def read_delimited(spark: SparkSession, path: str, sep: str = "\t",
                   encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delimited files with a header row each, all columns as text.

    Quoted fields may hold separators, quotes ("" inside) and line breaks, which come out as one line feed.  A record
    that does not fit the header goes to ``rejects`` (its text in ``_corrupt_record``), it does not vanish.  The first
    encoding that leaves no broken line is used, else the last one.  A file is read by as many tasks as it has splits.
    Between the files and the result only the parsed rows are kept, once and compressed.
    """
    found, encoding, first = _cut(spark, path, sep, encodings)
    header = (spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
              .csv(spark.sparkContext.parallelize([first.decode(encoding, "replace")], 1)).columns)
    schema = StructType([StructField(c, StringType()) for c in header] + [StructField(CORRUPT, StringType())])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_csv(F.col("record"), F.lit(_ddl(schema)), options)
    every = keep(found.select(parsed.alias("r")).select("r.*"))
    bad = F.col(CORRUPT).isNotNull()
    return every.filter(~bad).drop(CORRUPT), every.filter(bad).select(CORRUPT)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
