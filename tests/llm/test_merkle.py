"""op11: the midstate tree against whole re-hashing, block borders, edges, SQL."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from wingwatch.llm import merkle, sha  # noqa: E402
from wingwatch.llm.common import table  # noqa: E402

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def got(docs):
    return sorted([tuple(r) for r in merkle.audit(docs).collect()], key=repr)


def random_rows(n, langs, seed):
    rng = random.Random(seed)
    return [(i if rng.random() > 0.02 else None, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, i]),
             rng.choice([None, "", f"Text {i} É", "Same Text", "x" * rng.randrange(300)])) for i in range(n)]


def test_states_equal_hashlib():
    raw = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    words = sha.from_bytes(b"".join(raw))
    assert sha.to_bytes(words) == b"".join(raw)
    state = sha.begin(5)
    for _ in range(3):
        state = sha.feed(state, sha.hex_block(words))
    done = sha.feed(state, sha.closing(np.full(5, 3)))
    assert sha.to_bytes(done) == b"".join(hashlib.sha256(r.hex().encode() * 3).digest() for r in raw)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (7, ["en"]), (8, ["en", None]), (9, ["en"]), (300, ["en", "de", None, "é", "fr"]),
                                      (130, [f"l{i}" for i in range(70)] + ["en"] * 70)])
def test_equals_brute_force(spark, n, langs):
    rows = random_rows(n, langs, n)
    assert got(spark.createDataFrame(rows, KIND)) == brute.merkle(rows)


@pytest.mark.parametrize("depth", [1, 2])
def test_many_rounds(spark, monkeypatch, depth):
    """Blocks of 8 and 64 leaves, so that languages and the tree over them take several rounds."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** depth)
    monkeypatch.setattr(merkle, "LANES", 50)
    rows = random_rows(700, ["en"] * 30 + [f"l{i}" for i in range(20)], depth)
    assert got(spark.createDataFrame(rows, KIND)) == brute.merkle(rows)


def test_a_row_that_fills_a_third(spark):
    rows = random_rows(200, ["en", "de"], 3) + [(7, "a", "en", 1, "Copy")] * 100
    assert got(spark.createDataFrame(rows, KIND)) == brute.merkle(rows)


def test_only_tampered_rows_fail(spark):
    docs = table(spark, SF_SMALL, "documents")
    bad = docs.filter(merkle.tampered() & docs.text.rlike("[A-Z]")).count()
    out = merkle.op11_merkle_manifest(docs)
    assert 0 < bad == out.filter("NOT verified").count() and out.select("root").distinct().count() == 1


def test_empty_and_clashing_columns(spark):
    assert got(spark.createDataFrame([], KIND)) == []
    rows = random_rows(30, ["en", None], 5)
    wide = spark.createDataFrame([(*r, *"zzzzzz") for r in rows], KIND + ", idx string, tree string, n string, digest string, part string, block string")
    assert got(wide) == brute.merkle(rows)
