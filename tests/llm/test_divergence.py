"""op13: the joint traversal against plain sums, whole results against brute force, edges."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from wingwatch.llm import divergence  # noqa: E402

KIND = "doc_id long, lang string, source string, text string"


def got(docs):
    return sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(n, seed, sources):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "Éa", "x-y", "a1b", "日本", "naïve"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    pick = lambda: words[min(int(rng.expovariate(0.03)), len(words) - 1)]
    return [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(sources),
             rng.choice([None, "", " ".join(pick() for _ in range(rng.randrange(1, 60)))])) for _ in range(n)]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_pair_sums_equal_plain_sums(seed, same, monkeypatch):
    monkeypatch.setattr(divergence, "FRONTIER", 50)
    rng = np.random.default_rng(seed)
    ra, cols = int(rng.integers(1, 12)), int(rng.integers(1, 90))
    rb = ra if same else int(rng.integers(1, 12))

    def matrix(r):
        m = np.where(rng.random((r, cols)) < 0.15 * seed, rng.integers(2, 10**9, (r, cols)), 0)
        zero = rng.integers(1, 50, r)
        row, col = np.nonzero(m)
        return np.where(m > 0, m, zero[:, None]), (row, col, m[row, col], zero)

    full_a, a = matrix(ra)
    full_b, b = (full_a, a) if same else matrix(rb)
    there, back = divergence.pair_sums(*a, *b, cols, same)
    for i in range(ra):
        for j in range(rb):
            if not same or i < j:
                assert there[i, j] == divergence.cost(full_a[i], full_b[j]).sum()
                assert back[i, j] == divergence.cost(full_b[j], full_a[i]).sum()


def test_share_is_exact():
    rng = random.Random(1)
    pairs = [(rng.randrange(10**rng.randrange(1, 15)), rng.randrange(1, 10**rng.randrange(1, 15))) for _ in range(2000)]
    pairs = [(n, max(n + 1, t)) for n, t in pairs]
    out = divergence.share(np.array([n for n, _ in pairs]), np.array([t for _, t in pairs]))
    assert out.tolist() == [1 + 10**9 * (n + 1) // t for n, t in pairs]


@pytest.mark.parametrize("rows, strip, chunk", [(64, 100_000, 12 << 20), (2, 30, 400)])
def test_equals_brute_force(spark, monkeypatch, rows, strip, chunk):
    """Also with row blocks, strips and chunks so small that every language has many."""
    monkeypatch.setattr(divergence, "ROWS", rows)
    monkeypatch.setattr(divergence, "STRIP_CELLS", strip)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "TOP", 20)
    data = some_rows(300, rows, ["a", "b", "é", "c", None, "d"]) + [("fr", "only", "one"), ("it", "x", ""), ("it", "y", None)]
    data += [("en", "hot", "the common passage of words the")] * 150 + [("en", "long", "waa wba the " * 400)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], KIND)
    assert got(docs) == brute.divergence(data, top=20)


def test_edges(spark):
    assert got(spark.createDataFrame([], KIND)) == []
    data = [("en", s, "Aa bb" if s else None) for s in ("a", "a", "a", "b", None)]
    wide = spark.createDataFrame([(i, *r, *"zzzzzzz") for i, r in enumerate(data)], KIND + ", term string, n string, gid string, value string, rank string, x string, v string")
    assert got(wide) == brute.divergence(data)
