"""Quality classifier: a sparse rule ensemble.

Statistics of each text are measured over its bytes.  Shallow trees are grown on a bounded sample
of labelled documents, every path from a root to an inner node or leaf becomes a conjunctive rule,
a lasso-penalised logistic regression keeps few of the rules, and these are compiled into one Spark
column expression over the statistics.  Scoring is a single narrow pass over all documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.llm.common import WordHasher, held_out, row_chunks, saved, text_buffer

MAX_TRAIN_ROWS = 8000
TREES, DEPTH, LASSO = 24, 3, 0.0015
THRESHOLD = 0.7

#: share of the text's bytes in each class
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "symbol": b"#*$%&@^~+=<>\\{}[]_`", "pipe": b"|", "shout": b"!", "stop": b".?", "comma": b",;:",
    "quote": b"\"'()-/", "line": b"\n", "wide": bytes(range(128, 256)),
}
STATS = [*CLASSES, "n_words", "word_length", "short_words", "distinct_words", "repeated_pairs",
         "words_per_line", "repeated_lines", "marked_words"]
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _chars in enumerate(CLASSES.values(), 1):
    _CLASS_OF[list(_chars)] = _i
_MARKS = np.isin(np.arange(256), list(b"#*$%&@^~+=<>\\{}[]_`|!"))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per row number."""
    if not len(row):
        return np.zeros(n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def statistics(array: pa.Array, hasher: WordHasher) -> np.ndarray:
    """rows x STATS.  All are shares or means and 0 for an empty text, but for n_words."""
    data, offsets = text_buffer(array)
    out = np.zeros((len(offsets) - 1, len(STATS)))
    at = {s: i for i, s in enumerate(STATS)}
    for a, b in row_chunks(offsets):
        part, offs = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        n, size = b - a, np.maximum(np.diff(offs), 1)
        for i, (x, y) in enumerate(zip(offs[:-1], offs[1:])):
            counts = np.bincount(_CLASS_OF[part[x:y]], minlength=len(CLASSES) + 1)
            out[a + i, :len(CLASSES)] = counts[1:] / size[i]
        # a row ends its last word: words are cut at the rows' starts too
        starts, ends, hashes, rows = [], [], [], []
        if n == 1:
            s, e, h = hasher.words(part)
            r = np.zeros(len(s), np.int64)
        else:
            spaced = np.insert(part, offs[1:-1], 32)
            s, e, h = hasher.words(spaced)
            shifted = offs + np.arange(n + 1)
            r = np.searchsorted(shifted, s, side="right") - 1
            s, e = s - r, e - r
        words = np.bincount(r, minlength=n).astype(float)
        per = np.maximum(words, 1)
        length = e - s
        marked = np.zeros(len(part) + 1, np.int64)
        np.cumsum(_MARKS[part], out=marked[1:])
        out[a:b, at["n_words"]] = words
        out[a:b, at["word_length"]] = np.bincount(r, length, n) / per
        out[a:b, at["short_words"]] = np.bincount(r, length <= 2, n) / per
        out[a:b, at["marked_words"]] = np.bincount(r, marked[e] > marked[s], n) / per
        out[a:b, at["distinct_words"]] = _distinct(r, h, n) / per
        if len(h) > 1:
            same = r[1:] == r[:-1]
            pair, pr = (h[:-1] * np.uint64(3) + h[1:])[same], r[1:][same]
            pairs = np.bincount(pr, minlength=n)
            out[a:b, at["repeated_pairs"]] = np.where(pairs, 1 - _distinct(pr, pair, n) / np.maximum(pairs, 1), 0)
        # lines: the hash of a line is the sum of its words' hashes at their places in it
        if len(h):
            breaks = np.zeros(len(part) + 1, np.int64)
            np.cumsum(part == 10, out=breaks[1:])
            line = breaks[s] + r * 1  # a new row is a new line
            first = np.ones(len(line), bool)
            first[1:] = (line[1:] != line[:-1]) | (r[1:] != r[:-1])
            begin = np.flatnonzero(first)
            place = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))
            lines_hash = np.add.reduceat(h * (2 * place + 1).astype(np.uint64), begin)
            lr = r[begin]
            lines = np.bincount(lr, minlength=n).astype(float)
            out[a:b, at["words_per_line"]] = np.where(lines > 0, words / np.maximum(lines, 1), 0)
            out[a:b, at["repeated_lines"]] = np.where(lines > 0, 1 - _distinct(lr, lines_hash, n) / np.maximum(lines, 1), 0)
    return out


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns c0, c1, ... (those of ``carry``) plus one double column ``q_<statistic>`` each."""
    own = carry.index("text") if "text" in carry else None
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(*columns) if own is not None else docs.select(*columns, F.col("text").alias("q_text"))
    names = [f"c{i}" for i in range(len(carry))] + [f"q_{s}" for s in STATS]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:len(carry)]]
                       + [f"q_{s} double" for s in STATS])
    text = "q_text" if own is None else f"c{own}"

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            stats = statistics(b.column(text), hasher)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(carry)], *[pa.array(np.ascontiguousarray(stats[:, i])) for i in range(len(STATS))]], names)

    return rows.mapInArrow(run, schema)


def tree_rules(debug: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Distinct paths of a printed forest as conjunctions of (feature, <= or >, threshold)."""
    rules, path = {}, {}
    for line in debug.split("\n"):
        depth = len(line) - len(line.lstrip())
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)", line):
            path = {d: c for d, c in path.items() if d < depth} | {depth: (int(m[1]), m[2], float(m[3]))}
            bounds: dict = {}
            for f, op, t in (path[d] for d in sorted(path)):
                tighter = min if op == "<=" else max
                bounds[f, op] = tighter(bounds.get((f, op), t), t)
            rules[tuple(sorted((f, op, t) for (f, op), t in bounds.items()))] = None
        elif "Tree" in line:
            path = {}
    return list(rules)


def _rule(rule) -> Column:
    expr = None
    for f, op, t in rule:
        c = F.col(f"q_{STATS[f]}")
        one = c <= t if op == "<=" else c > t
        expr = one if expr is None else expr & one
    return expr.cast("double")


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, seed: int = 9):
    """(intercept, [(weight, rule)]) learned from a bounded hash sample of labelled documents that
    are not held out.  Documents whose labels contradict each other are not learned from."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
             .filter("label = other").select("doc_id", F.col("label").cast("double").alias("label")))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.filter(draw < min(1.0, max_train_rows / max(n, 1)))
    # the drawn labels are at most about max_train_rows rows, whatever the size of the tables
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    table = saved(with_statistics(sample, ["doc_id", "label"]).withColumnsRenamed({"c0": "doc_id", "c1": "label"})
                  .repartition(2, "doc_id").sortWithinPartitions("doc_id"))
    seen = table.groupBy("label").count().collect()
    if len(seen) < 2:
        share = seen[0]["label"] if seen else 0.5
        return (np.log((share + 0.01) / (1.01 - share)), [])
    stats = VectorAssembler(inputCols=[f"q_{s}" for s in STATS], outputCol="x").transform(table)
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
                                    featureSubsetStrategy="onethird", seed=seed).fit(stats)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        share = sum(r["label"] * r["count"] for r in seen) / sum(r["count"] for r in seen)
        return (np.log(share / (1 - share)), [])
    marked = table.select("label", *[_rule(r).alias(f"r{i}") for i, r in enumerate(rules)])
    rule_x = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marked)
    lasso = LogisticRegression(labelCol="label", featuresCol="x", regParam=LASSO, elasticNetParam=1.0,
                               maxIter=60).fit(rule_x.select("label", "x"))
    return float(lasso.intercept), [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules) if w]


def score(model) -> Column:
    """The compiled rules: logistic of the intercept plus the weights of the rules that hold."""
    z = F.lit(float(model[0]))
    for w, rule in model[1]:
        z = z + F.lit(w) * _rule(rule)
    return 1.0 / (1.0 + F.exp(-z))


def scored(docs: DataFrame, model, carry: list[str]) -> DataFrame:
    """``carry`` columns plus score (0 to 1); a null or empty text gets the score of its
    statistics, all of them 0."""
    return with_statistics(docs, carry).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], score(model).alias("score"))


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.  Without labelled rows every
    score is 0.5; with one label value only, all scores stand near it.  Repeated rows get equal
    scores; a score of exactly ``THRESHOLD`` is a 1.  A very long text is read once by its row's task."""
    out = scored(docs.withColumn("held_out", held_out()), fit(docs, labels), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score ``THRESHOLD`` or more, learned on ``train_docs``."""
    good = with_statistics(docs, docs.columns).filter(score(fit(train_docs, labels)) >= THRESHOLD)
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
