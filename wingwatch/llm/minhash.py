"""Near-duplicate groups: banded MinHash with odd sketches.

A document's set is its distinct shingles.  Documents with equal sets form a class, represented by
its smallest doc_id.  Representatives get MinHash values, cut into bands whose hashes are the
buckets, and an odd sketch: every (function, value) sample flips one bit of a bitmap, so equal
samples cancel in the XOR of two sketches and its population count estimates how many samples
differ.  A second odd sketch folds the shingles themselves: the population count of its XOR never
exceeds the number of shingles in which two sets differ, so it rules out pairs for certain.  The
sketches pass on candidates that are similar enough, and the full sets then decide.

No bucket is expanded into all its pairs.  Every member meets the smallest and the largest member of its
bucket; confirmed links give components.  Only where a bucket then still holds members of several
components do members of different components meet, and of these only the pairs that pass the
sketch leave the join.  A pair that shares a bucket and is not tested lies in one component already,
so no link can be lost but for MinHash itself: with 24 bands of 4 values a pair at similarity 0.8
shares no bucket with probability 3e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wingwatch.llm.common import WordHasher, fresh, mix64, row_chunks, saved, text_buffer, text_of

BANDS, ROWS = 24, 4
SKETCH_WORDS = 8  # 512 bits of MinHash samples
SET_WORDS = 32  # 2,048 bits of shingles
#: the sketch lets candidates pass down to this estimate, nearly five standard errors below 0.8
SKETCH_SLACK = 0.21
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_SALT = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; with fewer words, the whole
    sequence is one shingle."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    acc = np.full(n, np.uint64(min(len(words), size)), np.uint64)
    for k in range(min(size, len(words))):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values; the shingles are worked off in blocks."""
    low = np.full(len(_A), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        block = shingles[at:at + 4096, None] * _A[None, :]
        block += _B[None, :]
        np.minimum(low, block.min(axis=0), out=low)
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    grid = low.reshape(BANDS, ROWS)
    acc = _SALT[:BANDS].copy()
    for k in range(ROWS):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return acc.view(np.int64)


def _parity(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bitmap in which each hash flips one bit."""
    bits = 64 * words
    place = (hashes >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Odd sketch of the MinHash samples."""
    return _parity(mix64(low ^ _SALT), SKETCH_WORDS)


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Odd sketch of the set itself."""
    return _parity(shingles, SET_WORDS)


def sketch_limit(similarity: float) -> int:
    """Population count of the XOR that is expected at the lowest similarity let through."""
    flips = 2 * BANDS * ROWS * (1 - (similarity - SKETCH_SLACK))
    return math.ceil(32 * SKETCH_WORDS * (1 - math.exp(-2 * flips / (64 * SKETCH_WORDS))))


def _rows_of_words(array: pa.Array, hasher: WordHasher):
    """(row, hashes of its words) of a text column."""
    data, offsets = text_buffer(array)
    for a, b in row_chunks(offsets):
        offs = offsets[a:b + 1] - offsets[a]
        part = data[offsets[a]:offsets[b]]
        spaced = np.insert(part, offs[1:-1], 32) if b - a > 1 else part
        s, _, h = hasher.words(spaced)
        cut = np.searchsorted(s, offs + np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, h[cut[i]:cut[i + 1]]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, fp1, fp2 (digest of the set), bands and sketch (both kinds in one); the last two are null where n is 0."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            rows = b.num_rows
            n, fp = np.zeros(rows, np.int64), np.zeros((2, rows), np.int64)
            bands, sketches = [None] * rows, [None] * rows
            for i, h in _rows_of_words(b.column("text"), hasher):
                s = shingle_hashes(h, shingle)
                n[i] = len(s)
                if len(s):
                    low = signature(s)
                    bands[i], sketches[i] = band_hashes(low), np.concatenate([odd_sketch(low), set_sketch(s)])
                    fp[0, i] = mix64(s).sum(dtype=np.uint64).astype(np.int64)
                    fp[1, i] = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(fp[0]), pa.array(fp[1]), pa.array(bands, longs), pa.array(sketches, longs)],
                ["doc_id", "n", "fp1", "fp2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, fp1 long, fp2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, shingle: int, key: str = "doc_id") -> DataFrame:
    """key, fp1, fp2 and the whole set of every document."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            fp, sets = np.zeros((2, b.num_rows), np.int64), [None] * b.num_rows
            for i, h in _rows_of_words(b.column("text"), hasher):
                s = shingle_hashes(h, shingle)
                fp[0, i] = mix64(s).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0
                fp[1, i] = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0
                sets[i] = s.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fp[0]), pa.array(fp[1]), pa.array(sets, pa.list_(pa.int64()))],
                                             [key, "fp1", "fp2", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, fp1 long, fp2 long, shingles array<long>")


def _alike(a: str, b: str, similarity: int) -> Column:
    """Pairs of representatives worth an exact comparison: sizes and sketches allow ``similarity`` %.
    Sets of n and m shingles that differ in d of them have similarity (n + m - d) / (n + m + d)."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")

    def flips(first: int, last: int) -> Column:
        return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(first, last)), F.lit(0))

    samples, shingles = flips(0, SKETCH_WORDS), flips(SKETCH_WORDS, SKETCH_WORDS + SET_WORDS)
    return ((100 * small >= similarity * large) & (samples <= sketch_limit(similarity / 100))
            & (shingles * (100 + similarity) <= (small + large) * (100 - similarity)))


def _doc_id(df: DataFrame, node: str) -> Column:
    """The doc_id of a representative, which is that doc_id itself where it names one class only."""
    return F.col(f"{node}.doc_id") if isinstance(df.schema[node].dataType, StructType) else F.col(node)


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    # written, so that the planner knows the size of the list when it plans the join with the texts
    asked = saved(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct())
    wanted = reps.select("rep", _doc_id(reps, "rep").alias("doc_id"), "fp1", "fp2").join(asked, "rep")
    # only texts that some pair asks for are read into sets
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(asked.select(_doc_id(asked, "rep").alias("doc_id")), "doc_id", "left_semi"))
    sets = saved(full_sets(texts, shingle).join(wanted, ["doc_id", "fp1", "fp2"]).dropDuplicates(["rep"])
                 .select("rep", "shingles"))
    one, two = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    every = F.size("set_a") + F.size("set_b") - shared
    return both.filter(100 * shared >= similarity * every).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): the smallest node reachable.  Each round takes
    the least label of the neighbours, then follows it one step; labels only fall, and the rounds end
    when none does."""
    both = saved(edges.union(edges.select("b", "a")).distinct().toDF("node", "other"))
    labels = saved(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        nearer = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        new = saved(nearer.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("beyond", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("comp < was").isEmpty():
            return labels


def _verdicts(docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """``near_duplicates`` with fp1 and fp2."""
    sigs = saved(signatures(docs, shingle))
    filled = sigs.filter("n > 0")
    classes = saved(filled.groupBy("n", "fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    if not classes.filter("rep IS NOT NULL").groupBy("rep").count().filter("count > 1").isEmpty():
        # a doc_id with several texts represents several classes: the digest tells them apart
        classes = classes.withColumn("rep", F.when(F.col("rep").isNotNull(), F.struct(F.col("rep").alias("doc_id"), "fp1", "fp2")))
    reps = classes.filter("rep IS NOT NULL").select(
        "rep", "n", "fp1", "fp2", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS + SET_WORDS)])
    light = reps.drop("bands", "fp1", "fp2")

    member = reps.select("rep", F.explode("bands").alias("bucket"))
    ends = member.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    shared = saved(member.join(ends, "bucket"))
    meets = shared.select(F.col("rep").alias("b"), F.explode(F.array("low", "high")).alias("a")).filter("a <> b")
    stars = meets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = saved(stars.join(light.select(F.col("rep").alias("a"), F.struct(*light.columns[1:]).alias("x")), "a")
             .join(light.select(F.col("rep").alias("b"), F.struct(*light.columns[1:]).alias("y")), "b")
             .filter(_alike("x", "y", similarity)).select("a", "b"))
    links = saved(_confirmed(first, reps, docs, shingle, similarity))
    comps = components(links)

    placed = (shared.select("bucket", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
              .withColumn("comp", F.coalesce("comp", "rep")))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    rest = saved(placed.join(mixed, "bucket", "left_semi").join(light, "rep"))
    x, y = rest.alias("x"), rest.alias("y")
    across = (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") < F.col("y.comp")) & _alike("x", "y", similarity))
              .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    more = saved(_confirmed(saved(across.join(first, ["a", "b"], "left_anti")), reps, docs, shingle, similarity))
    # links between components join them; only these few are worked off again
    of = comps.select(F.col("node").alias("rep"), "comp")
    ends = [F.coalesce(F.col(f"{x}_.comp"), F.col(x)).alias(x) for x in "ab"]
    between = (more.join(of.alias("a_"), F.col("a") == F.col("a_.rep"), "left")
               .join(of.alias("b_"), F.col("b") == F.col("b_.rep"), "left").select(*ends).filter("a <> b"))
    merged = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    alone = merged.join(of, merged.comp == of.rep, "left_anti").select(F.col("comp").alias("rep"), "comp")
    comps = (of.union(alone).join(merged, "comp", "left")
             .select(F.col("rep").alias("node"), F.coalesce("root", "comp").alias("comp")))

    grouped = (classes.select("n", "fp1", "fp2", "rep", "class_size").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
               .select("n", "fp1", "fp2", F.coalesce("comp", "rep").alias("comp"), "class_size"))
    out = sigs.select("doc_id", "n", "fp1", "fp2").join(grouped, ["n", "fp1", "fp2"], "left")
    comp = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(_doc_id(out, "comp"))
    own = F.col("doc_id") == F.col("component_id")
    if isinstance(out.schema["comp"].dataType, StructType):
        own &= (F.col("n") == 0) | ((F.col("fp1") == F.col("comp.fp1")) & (F.col("fp2") == F.col("comp.fp2")))
    return (out.withColumn("component_id", comp).withColumn("kept", F.coalesce(own, F.col("component_id").isNull()))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept",
                    F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "fp1", "fp2"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_size for every row of ``docs``.

    A text without words has an empty set and is linked with nothing.  Equal sets share a class
    whatever the texts.  A row without doc_id belongs to the class of its set but links no others;
    it is kept where its class has no doc_id at all.  Rows that repeat a doc_id with another text
    are grouped by their texts.
    """
    return _verdicts(docs, shingle, similarity).drop("fp1", "fp2")


def op2_near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups by distinct 2-word shingles at a similarity of 0.8 or more.  A very long text is hashed in
    segments; its full set is one row where it has a candidate."""
    return near_duplicates(docs, shingle=2, similarity=80)


def first_of_groups(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates.  A doc_id that is repeated stays
    once for each of its kept sets, with the row that is least by digest of its text and then by its
    values; rows without doc_id stay."""
    verdict = _verdicts(docs, shingle, similarity).filter("doc_id IS NOT NULL")
    sets = saved(verdict.groupBy("doc_id", "fp1", "fp2").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")))
    ids = saved(sets.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.sum("rows").alias("rows")).filter("NOT kept OR rows > 1"))
    gone = ids.filter("NOT kept").select("doc_id")
    repeated = ids.filter("kept").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return left
    text_key, fp1, fp2 = (fresh(docs, n) for n in ("text_key", "fp1", "fp2"))
    rows = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).withColumn(text_key, F.md5(text_of()))
    prints = (full_sets(rows.select(text_key, text_of().alias("text")).dropDuplicates([text_key]), shingle, text_key)
              .select(text_key, F.col("fp1").alias(fp1), F.col("fp2").alias(fp2)))
    stay = sets.filter("kept").select("doc_id", F.col("fp1").alias(fp1), F.col("fp2").alias(fp2))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = (rows.join(prints, text_key).join(stay, ["doc_id", fp1, fp2], "left_semi")
            .groupBy("doc_id", fp1, fp2).agg(F.min_by(row, F.struct(text_key, F.to_json(row))).alias(text_key)).select(f"{text_key}.*"))
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
