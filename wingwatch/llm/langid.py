"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits.  For each bit a logistic classifier over hashed byte
n-grams learns to tell the languages with +1 from those with -1.  A text's language is the
codeword with the least total logistic loss against the classifiers' margins (loss-weighted
decoding); the text is flagged ambiguous where the runner-up is nearly as good.

Learning takes a bounded sample: ``max_train_rows`` documents in expectation, spread evenly over
the languages by a hash of doc_id.  The sample's feature vectors (never its texts) meet in one
task; the model is ``DIM`` weights a bit.  Prediction is one narrow pass over all documents.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingwatch.llm.common import held_out, text_buffer

DIM = 4096
MAX_TRAIN_ROWS = 2400
STEPS, PENALTY = 150, 1e-5
#: ambiguous where the best language has less than this share of the decoded weight
AMBIGUOUS_BELOW = 0.6
SEGMENT = 1 << 20

#: byte classes for n-grams: ASCII letters in lower case, bytes of multi-byte characters as they
#: are, everything else a space
_GRAM = np.full(256, 32, np.uint8)
_GRAM[97:123] = np.arange(97, 123)
_GRAM[65:91] = np.arange(97, 123)
_GRAM[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k x bits matrix of +1/-1.  Up to five languages: every split of them, once (exhaustive
    code).  More: the best separated of 64 random codes of 8 * log2(k) balanced bits."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=k - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], np.int8).T
    bits, rng, best = int(8 * np.ceil(np.log2(k))), np.random.default_rng(seed), None
    for _ in range(64):
        code = np.stack([rng.permutation(np.where(np.arange(k) % 2, 1, -1)) for _ in range(bits)], axis=1)
        apart = (code @ code.T - 2 * bits * np.eye(k)).max()
        if best is None or apart < best[0]:
            best = (apart, code.astype(np.int8))
    return best[1]


def gram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of hashed 2-, 3- and 4-grams of one text's bytes, worked off in segments."""
    total = np.zeros(DIM, np.int64)
    for at in range(0, len(data), SEGMENT):
        c = _GRAM[data[max(at - 3, 0):at + SEGMENT]]
        space = c == 32
        c = c[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
        code = c
        for n in (2, 3, 4):
            if len(c) < n:
                break
            code = (code[:-1] << np.uint32(8)) | c[n - 1:]
            hashed = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            total += np.bincount(hashed, minlength=DIM)
    return total


def features(array: pa.Array) -> np.ndarray:
    """Rows of square-rooted n-gram shares, so of length 1 (0 for a text without bytes)."""
    data, offsets = text_buffer(array)
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    for i in range(len(out)):
        counts = gram_counts(data[offsets[i]:offsets[i + 1]])
        n = counts.sum()
        if n:
            out[i] = np.sqrt(counts / n)
    return out


def train_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(DIM + 1) x bits weights of the regularised logistic classifiers, by accelerated gradient
    descent; languages weigh the same whatever their number of rows."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    target = code[y].astype(np.float32)
    share = (1.0 / np.bincount(y, minlength=len(code)).clip(1))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        grad = x.T @ (-target * share / (1 + np.exp(np.clip(target * (x @ ahead), -30, 30)))) + PENALTY * ahead
        new = ahead - 2.0 * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """rows x languages: weight of each codeword, from the mean logistic loss over its bits."""
    loss = np.stack([np.logaddexp(0, -margins * row).sum(axis=1) for row in code.astype(np.float32)], axis=1)
    best = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return best / best.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights) learned from the rows of ``docs`` that are not held out."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(counts)
    code = codewords(len(langs))
    if len(langs) < 2:
        return langs, code, np.zeros((DIM + 1, 0), np.float32)
    keep = F.create_map(*[v for name in langs for v in (
        F.lit(name), F.lit(min(1.0, max_train_rows / len(langs) / counts[name])))])
    place = F.create_map(*[v for i, name in enumerate(langs) for v in (F.lit(name), F.lit(i))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(draw < keep[F.col("lang")]).select(place[F.col("lang")].alias("y"), "text")

    def vectors(batches):
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["y", "x"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
        return pd.DataFrame({"w": [train_bits(x, rows["y"].to_numpy(), code).tobytes()]})

    found = (sample.mapInArrow(vectors, "y int, x binary").withColumn("all_", F.lit(0)).groupBy("all_")
             .applyInPandas(learn, "w binary").collect())
    return langs, code, np.frombuffer(found[0]["w"], np.float32).reshape(DIM + 1, -1)


def identify(docs: DataFrame, model, carry: list[str]) -> DataFrame:
    """``carry`` columns plus lang_pred, score, runner_up and ambiguous for every row."""
    langs, code, weights = model
    names = np.array(langs + ["und"], dtype=object)
    rows = docs.select(*carry, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters_"), F.col("text").alias("text_"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(carry)]]
                       + ["lang_pred string", "score double", "runner_up string", "ambiguous boolean"])

    def run(batches):
        for b in batches:
            n = b.num_rows
            letters = b.column("letters_").to_numpy(zero_copy_only=False).astype(bool)
            best, second = np.full(n, len(langs)), np.full(n, len(langs))
            score, unsure = np.zeros(n), np.zeros(n, bool)
            if len(langs) == 1:
                best[letters], score[letters] = 0, 1.0
            elif langs:
                share = decode(features(b.column("text_")) @ weights[:-1] + weights[-1], code)
                order = np.argsort(-share, axis=1, kind="stable")
                top = share[np.arange(n), order[:, 0]]
                best, second = np.where(letters, order[:, 0], best), np.where(letters, order[:, 1], second)
                score, unsure = np.where(letters, top, 0.0), letters & (top < AMBIGUOUS_BELOW)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(names[best], pa.string()), pa.array(score, pa.float64()),
                 pa.array(names[second], pa.string()), pa.array(unsure, pa.bool_())],
                [*carry, "lang_pred", "score", "runner_up", "ambiguous"])

    return rows.mapInArrow(run, schema)


def op1_identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runner_up, ambiguous for every row of ``docs``.

    A null text, an empty one or one without a letter is ``und`` with score 0.  Without any
    training rows every text is ``und``; with one language every text with a letter is that one.
    Of languages with equal losses the first in order of name wins.  Repeated rows get equal results.
    A very long text is one row of one Arrow batch; its features take memory in proportion to it.
    """
    return identify(docs.withColumn("held_out", held_out()), fit(docs), ["doc_id", "held_out"])
