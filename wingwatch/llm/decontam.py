"""Benchmark decontamination by template windows (native).

Texts become tokens in which numbers, their units and names are typed slots that remember their
value.  Windows of ``WINDOW`` tokens are hashed with the slots' types in place of their values and
hash-joined with the windows of the benchmark items, so a question that was re-parameterised
(other numbers, names or units) still meets its item.  Windows with names are hashed once more with
the names as plain words, so a copy meets its item whatever its case.  Within one alignment of an item in a
document each benchmark value must always stand for the same document value; where one does not,
its windows count only if all their values are the item's own.  A document leaks an item when at least ``COVERAGE`` of the
item's windows are found, or ``RUN`` of them in one alignment (13 tokens of a longer item).

Most documents hold no window of the benchmark.  A window of ``WINDOW`` tokens covers a piece of ``PIECE``
tokens that begins at a multiple of ``STRIDE`` in the document, so a document's windows are only built
if one of these pieces, slots as their types, is among the pieces of the benchmark.  The test is a
Bloom filter inside the row: it lets some documents through in vain and none is missed.

Only benchmark windows are broadcast, after their count was checked; beyond ``BROADCAST_ROWS``
the join is left to the planner (a shuffle on the window hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.llm.common import doc_key, fresh, let, saved, text_of

WINDOW = 8
PIECE, STRIDE = 4, 5  # PIECE + STRIDE - 1 <= WINDOW
FILTER_BITS = (12, 20)  # least and most bits, as powers of two
#: fewer plain words than this in a window: its values must match too
MIN_LITERALS = 4
COVERAGE, RUN = 0.5, 6
BROADCAST_ROWS = 1_000_000
MAX_CHARS = 2**31 - 1

UNITS = ("km", "m", "cm", "mm", "miles", "mile", "feet", "ft", "inches", "kg", "g", "mg", "lb", "lbs", "pounds",
         "tons", "l", "ml", "liters", "litres", "gallons", "hours", "hour", "minutes", "seconds", "days", "weeks",
         "months", "years", "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh", "watts", "volts")
MARK, POINT = "\u0001", "\u0002"
SPACE = "[\\s\\p{Z}]"
_NUMBER = (f"(?<![\\p{{L}}\\p{{N}}{POINT}])(\\p{{Nd}}+(?:{POINT}\\p{{Nd}}+)*)"
           f"(?:(?:{SPACE}*((?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}))(?![\\p{{L}}\\p{{N}}]))|(?![\\p{{L}}\\p{{N}}]))")
_NAME = f"{SPACE}(?<=[\\p{{L}}\\p{{N}},;:]{SPACE}){SPACE}*(\\p{{Lu}}\\p{{Ll}}+)(?![\\p{{L}}\\p{{N}}])"
_ANY_NAME = f"(?<![\\p{{L}}\\p{{N}}{MARK}])(\\p{{Lu}}\\p{{Ll}}+)(?![\\p{{L}}\\p{{N}}])"


def _is_slot(t: Column) -> Column:
    return F.startswith(t, F.lit(MARK))


def tokens(text: Column, name: str = _NAME) -> Column:
    """Lower-cased tokens; a slot is ``MARK``, its type (n number, u unit, p name) and its value.
    A number is always followed by a unit slot, empty where no unit stands there.  A name is a
    capitalised word inside a sentence, with ``_ANY_NAME`` any capitalised word."""
    plain = F.when(text.rlike(f"[{MARK}{POINT}]"), F.regexp_replace(text, f"[{MARK}{POINT}]", " ")).otherwise(text)
    points = F.regexp_replace(plain, "[.,](?<=\\p{Nd}[.,])(?=\\p{Nd})", POINT)
    numbers = F.when(plain.rlike("\\p{Nd}"), F.regexp_replace(points, _NUMBER, f" {MARK}n$1 {MARK}u$2 ")).otherwise(plain)
    named = F.regexp_replace(numbers, name, f" {MARK}p$1")
    return F.filter(F.split(F.lower(named), f"[^\\p{{L}}\\p{{M}}\\p{{N}}{MARK}{POINT}]+"), lambda t: t != "")


def _is_name(t: Column) -> Column:
    return F.startswith(t, F.lit(f"{MARK}p"))


def _windows(toks: Column, size: int | Column) -> Column:
    """array<struct<pos, h, vals>> of every window of ``size`` tokens.  A window that holds names is
    there twice, the second time with its names as plain words."""
    places = F.sequence(F.lit(1), F.size(toks) - (size - 1))

    def plain(t: Column) -> Column:
        return let(F.transform(t, lambda x: F.xxhash64(x)), lambda hs: F.transform(places, lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.slice(hs, i, size)).alias("h"), F.lit("").alias("vals"))))

    def slotted(t: Column, at: Column) -> Column:
        template = F.transform(t, lambda x: F.xxhash64(F.when(_is_slot(x), F.substring(x, 1, 2)).otherwise(x)))
        values = F.transform(t, lambda x: F.xxhash64(x))

        def one(i, th, vh):
            return let(F.filter(F.slice(t, i, size), _is_slot), lambda slots: F.struct(
                i.alias("pos"),
                F.when((F.size(slots) == 0) | (size - F.size(slots) >= MIN_LITERALS), F.xxhash64(F.slice(th, i, size)))
                .otherwise(F.xxhash64(F.slice(vh, i, size), F.lit("values"))).alias("h"),
                F.array_join(slots, " ").alias("vals")))

        return let(template, lambda th: let(values, lambda vh: F.transform(at, lambda i: one(i, th, vh))))

    def spelled(t: Column) -> Column:
        words = F.transform(t, lambda x: F.when(_is_name(x), F.substring(x, 3, MAX_CHARS)).otherwise(x))
        named = F.filter(places, lambda i: F.exists(F.slice(t, i, size), _is_name))
        return let(words, lambda w: let(named, lambda at: slotted(w, at)))

    return F.when(F.size(toks) < size, F.array().cast("array<struct<pos:int,h:bigint,vals:string>>")).when(
        F.exists(toks, _is_name), F.concat(slotted(toks, places), spelled(toks))).when(
        F.exists(toks, _is_slot), slotted(toks, places)).otherwise(plain(toks))


def _template(toks: Column, spelled: bool) -> Column:
    """Tokens with slots as their types; ``spelled`` takes names as plain words."""
    typed = lambda x: F.when(_is_slot(x), F.substring(x, 1, 2)).otherwise(x)
    if not spelled:
        return F.transform(toks, typed)
    return F.transform(toks, lambda x: F.when(_is_name(x), F.substring(x, 3, MAX_CHARS)).otherwise(typed(x)))


def _pieces(template: Column, stride: int) -> Column:
    """Hashes of the pieces of ``PIECE`` tokens at every ``stride``-th place."""
    def hashed(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(t) - (PIECE - 1), F.lit(stride))
        return F.when(F.size(t) < PIECE, F.array().cast("array<bigint>")).otherwise(
            F.transform(places, lambda i: F.xxhash64(F.slice(t, i, PIECE))))

    return let(template, hashed)


def piece_filter(benchmark: DataFrame):
    """Test whether a document's tokens may hold a window of the benchmark.

    The filter is a literal array of 64-bit words with two bits a piece; about 32 bits a piece, within
    ``FILTER_BITS``.  Beyond the largest size more documents pass; the result is the same.
    """
    toks = benchmark.select(F.explode(F.array(tokens(text_of()), tokens(text_of(), _ANY_NAME))).alias("t"))
    every = toks.select(F.explode(F.concat(_pieces(_template(F.col("t"), False), 1), _pieces(_template(F.col("t"), True), 1))).alias("h")).distinct()
    low, high = FILTER_BITS
    size = 1 << min(max((32 * max(every.count(), 1) - 1).bit_length(), low), high)

    def bits(h: Column) -> list[Column]:
        return [h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1))]

    marked = every.select(F.explode(F.array(*bits(F.col("h")))).alias("b"))
    words = (marked.groupBy(F.shiftright("b", 6).cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("m")).collect())  # at most size / 64 rows
    filled = [0] * (size // 64)
    for r in words:
        filled[r["w"]] = r["m"]
    literal = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")  # folded once, when the query is planned

    def held(h: Column, filter_: Column) -> Column:
        tests = [F.getbit(F.get(filter_, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in bits(h)]
        return tests[0] & tests[1]

    def suspicious(t: Column) -> Column:
        def tested(filter_: Column) -> Column:
            any_of = lambda template: F.exists(_pieces(template, STRIDE), lambda h: held(h, filter_))
            return F.when(F.exists(t, _is_slot), any_of(_template(t, False)) | any_of(_template(t, True))).otherwise(any_of(t))

        return let(literal, tested)  # the words stand in the plan once

    return suspicious


_NO_WINDOWS = "array<struct<pos:int,h:bigint,vals:string>>"


def _windows_of(column: str, size: int | Column) -> Column:
    return let(F.col(column), lambda t: _windows(t, size))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, ipos, h, bvals, n_windows, size.  Items of up to ``WINDOW`` tokens are one window, and it
    is there once more with every capitalised word as a name, as the word before a passage would
    else decide on the type of its first word.  Items without tokens have no windows."""
    toks = benchmark.select("item_id", tokens(text_of()).alias("t"), tokens(text_of(), _ANY_NAME).alias("any"))
    size = F.least(F.size("t"), F.lit(WINDOW))
    sized = toks.withColumn("size", size).withColumn("n_windows", F.size("t") - size + 1).filter("size > 0")
    picked = F.when(F.col("n_windows") == 1, F.concat(*[_windows_of(c, F.col("size")) for c in ("t", "any")])).otherwise(
        _windows_of("t", F.col("size")))
    return (sized.select("item_id", "size", "n_windows", F.explode(picked).alias("w"))
            .select("item_id", "size", "n_windows", F.col("w.pos").alias("ipos"), "w.h", F.col("w.vals").alias("bvals"))
            .dropDuplicates(["item_id", "ipos", "h"]))


def _mapped(windows: Column) -> Column:
    """The distinct (benchmark value, document value) pairs of the slots of an alignment."""
    slotted = F.filter(windows, lambda w: w["bvals"] != "")
    return F.array_distinct(F.flatten(F.transform(slotted, lambda w: F.arrays_zip(
        F.split(w["bvals"], " ").alias("b"), F.split(w["dvals"], " ").alias("d")))))


def _torn(mapped: Column) -> Column:
    """Benchmark values that stand for several document values.  The empty unit is no value: a number
    may gain a unit in one place and not in another."""
    values = F.filter(F.array_distinct(F.transform(mapped, lambda s: s["b"])), lambda v: v != f"{MARK}u")
    return F.filter(values, lambda v: F.size(F.filter(mapped, lambda s: s["b"] == v)) > 1)


def _counted(windows: Column, torn: Column) -> Column:
    """Places of the windows that count: those with the item's own values (or no slots), and those
    with changed values of which none is torn."""
    held = F.filter(windows, lambda w: (w["bvals"] == w["dvals"]) | ~F.arrays_overlap(F.split(w["bvals"], " "), torn))
    return F.array_distinct(F.transform(held, lambda w: w["ipos"]))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """key, doc_id, item_id, n_windows, n_matched, n_changed per leaked (document, item).

    ``n_changed`` counts the item's slot values that the document replaces.  A null or empty text
    leaks nothing; a document without doc_id is reported under the key of its text.  Repeated
    rows of a document are one document here.  An empty benchmark gives no rows.
    """
    bench = saved(benchmark_windows(benchmark))
    sizes = bench.groupBy("size").agg(F.min("n_windows").alias("least")).collect()  # at most 8 rows
    small = bench.count() <= BROADCAST_ROWS
    bench = bench.drop("size")
    whole = sorted(r["size"] for r in sizes if r["least"] == 1)
    suspicious = piece_filter(benchmark)
    long = let(F.col("toks"), lambda t: F.when(suspicious(t), _windows(t, WINDOW)).otherwise(F.array().cast(_NO_WINDOWS)))
    short = sorted(r["size"] for r in sizes if r["size"] < WINDOW)
    windows = F.concat(long, *[_windows_of("toks", s) for s in short], *[_windows_of("any", s) for s in whole])
    placed = (docs.select(doc_key().alias("key"), "doc_id", tokens(text_of()).alias("toks"),
                          *[tokens(text_of(), _ANY_NAME).alias("any")] * bool(whole))
              .select("key", "doc_id", F.explode(windows).alias("w"))
              .select("key", "doc_id", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"), F.col("w.vals").alias("dvals")))
    met = placed.join(F.broadcast(bench) if small else bench, "h")
    aligned = met.groupBy("key", "doc_id", "item_id", "n_windows", (F.col("pos") - F.col("ipos")).alias("off")).agg(
        F.collect_set(F.struct("ipos", "bvals", "dvals")).alias("ws"))  # at most n_windows
    found = (aligned.withColumn("mapped", _mapped(F.col("ws"))).withColumn("torn", _torn(F.col("mapped")))
             .select("key", "doc_id", "item_id", "n_windows", _counted(F.col("ws"), F.col("torn")).alias("ipos"),
                     F.size(F.array_distinct(F.transform(F.filter("mapped", lambda s: s["b"] != s["d"]), lambda s: s["b"]))).alias("changed"))
             .filter(F.size("ipos") > 0))
    per = found.groupBy("key", "doc_id", "item_id", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ipos")))).cast("long").alias("n_matched"),
        F.max("changed").cast("long").alias("n_changed"), F.max(F.size("ipos")).alias("aligned"))
    return (per.withColumn("n_windows", F.col("n_windows").cast("long"))
            .filter((F.col("n_matched") >= coverage * F.col("n_windows")) | (F.col("aligned") >= run)).drop("aligned"))


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, benchmark item it leaks); documents without a row are clean.  A very long text
    is tested piece by piece; its windows, where it has any, are one array in its row's task."""
    return leaks(docs, benchmark).select("doc_id", "item_id", "n_windows", "n_matched", "n_changed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    mine, leak = fresh(docs, "doc_key"), fresh(docs, "leak_key")
    bad = saved(leaks(docs, benchmark).select(F.col("key").alias(leak)).distinct())  # its size is known before the join
    return docs.withColumn(mine, doc_key()).join(bad, F.col(mine) == F.col(leak), "left_anti").select(*docs.columns)
