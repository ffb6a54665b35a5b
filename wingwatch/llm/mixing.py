"""Mixing sources to target weights by systematic sampling (native).

Each source gets a target of words; every document of a source expects ``target / source size``
copies.  Documents are put in a fixed order within their source, the expected copies are
prefix-summed, one random offset per source is added, and a document is emitted once for every
integer that its stretch of the running sum crosses.

The prefix sum never gathers a source in one task: it is the rank of the document times the rate,
and the rank is the sum of the counts of the earlier cells of the source plus the rank inside the
document's own cell.  A cell is (source, size class, one of ``BINS`` digest bins); the number of
cells a source has is bounded by the size classes (90 a decade) times the bins, so a source that
holds a third of all rows is spread over thousands of cells.  Ordering by size class also keeps
the words taken within a few documents of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wingwatch.llm.common import fresh, saved, text_of, words

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BINS = 64


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of ``text`` (portable to other SQL engines)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(mix_key, source_size, target) per source from (mix_key, size) rows.

    Targets share ``share`` times all words by weight, none above ``cap`` times its source's
    words.  The level at which the excess has been reshared until none is above is the largest of
    ``(total - caps before) / (weights from here on)`` over the sources in order of cap / weight.
    The windows here run over one row per source, after aggregation.
    """
    per = sizes.groupBy("mix_key").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy("mix_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "mix_key")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share)
                                   - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
                         / F.sum("weight").over(after))
    level = F.max("level").over(everything)
    return per.select("mix_key", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, carry: list[str], **how) -> DataFrame:
    """Copies per document: ``carry`` columns plus size, source_size, target and copies.

    ``docs`` has doc_id, text and source.  A null text has size 0, a null source is a source of
    its own (ordered last).  Rows that are equal in doc_id, text and source are interchangeable:
    the multiset of results is the same in every run.  Empty tables give an empty result; a
    source without words takes none.
    """
    return _placed(docs, carry, **how).select(
        *[F.col(f"`c_{c}`").alias(c) for c in carry], "size", "source_size", "target", "copies")


def _placed(docs: DataFrame, carry: list[str], weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
            seed: int = 11) -> DataFrame:
    """Columns ``c_<name>`` for ``carry``, and those that ``mix`` adds."""
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry],
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("mix_key"),
        F.size(words(text_of())).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), text_of())).alias("digest"))
    narrow = "text" not in carry
    sized = saved(keyed) if narrow else keyed
    digits = F.col("size").cast("string")
    sized = (sized.withColumn("stratum", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"))
             .withColumn("bin", F.pmod(F.conv(F.substring("digest", 9, 2), 16, 10).cast("int"), F.lit(BINS))))
    cells = sized.groupBy("mix_key", "stratum", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    cells = saved(cells)
    before = (Window.partitionBy("mix_key").orderBy("stratum", "bin")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .select("mix_key", "stratum", "bin", "first")
               .join(source_targets(cells, weights, share, cap), "mix_key"))
    inside = Window.partitionBy("mix_key", "stratum", "bin").orderBy("size", "digest")
    ranked = (sized.withColumn("place", F.row_number().over(inside))
              .join(offsets, ["mix_key", "stratum", "bin"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _unit(F.concat_ws("|", F.lit(str(seed)), F.col("mix_key")))
    rank = F.col("first") + F.col("place")
    copies = F.least(F.floor(rank * rate + start) - F.floor((rank - 1) * rate + start), F.ceil(rate))
    return ranked.select(*[f"`c_{c}`" for c in carry], "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """Every row of ``docs`` once per copy that the mix takes of it, with the copy's number from 1
    in a new last column (``copy``, lengthened where the name is taken)."""
    taken = _placed(docs, docs.columns, **how).filter(F.col("copies") > 0)
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.withColumn("number", number).select(
        *[F.col(f"`c_{c}`").alias(c) for c in docs.columns], F.col("number").alias(fresh(docs, "copy")))


def op8_mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies) for every row of ``docs``.  A very long text is
    only counted."""
    out = mix(docs, ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS mix_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', '11', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS digest
  FROM documents),
s AS (
  SELECT *, length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER) AS stratum,
         CAST('0x' || substr(digest, 9, 2) AS BIGINT) % {BINS} AS bin
  FROM d),
per AS (
  SELECT mix_key, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY mix_key) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM s GROUP BY mix_key),
lv AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, mix_key
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, mix_key
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
tg AS (SELECT mix_key, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM lv),
r AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.mix_key ORDER BY stratum, bin, size, digest) AS rank,
         source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('11|' || s.mix_key), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM s JOIN tg USING (mix_key))
SELECT doc_id, size, source_size, target,
       least(CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT), CAST(ceil(rate) AS BIGINT)) * size AS taken,
       least(CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT), CAST(ceil(rate) AS BIGINT)) AS copies
FROM r
"""
