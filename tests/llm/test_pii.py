"""op12: base spans against plain patterns, Viterbi and likelihood against all labellings, held-out rows, edges."""

import hashlib
import itertools
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest import SF_CHECK  # noqa: E402
from wingwatch.llm import crf, pii  # noqa: E402
from wingwatch.llm.common import table  # noqa: E402


def plain_base(text):
    """The base kinds, word for word."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "@", ".", ".com", "1", "25", "256", "300", ".", "-", " ", "+", "+1", "(555)", "4111 1111 1111 1111", "10.0.0.1", "é", "\n",
             "5500-0000-0000-0004", "%", "x@y.z", "0", "00", "1.2.3.4.5.6.7.8.9", "+49 30 1234567", "  "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " @ x", "1" * 300_000 + " 1.1", "1." * 150_000, "+1" * 100_000, "@" * 300_000, "a." * 100_000 + "@"):
        pii.base_spans(text)


def random_field(rng, kinds, n_features):
    move, begin = crf.allowed(kinds)
    labels = 2 * kinds + 1
    known = np.sort(rng.choice(10**6, n_features, replace=False).astype(np.uint64))
    return crf.Model(known, np.vstack([rng.normal(size=(n_features, labels)), np.zeros(labels)]), move + rng.normal(size=(labels, labels)),
                     begin + rng.normal(size=labels))


def value_of(field, emit, labels):
    total = field.begin[labels[0]] + emit[0, labels[0]]
    return total + sum(field.move[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(labels, labels[1:])))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_and_likelihood_equal_all_labellings(seed):
    rng = np.random.default_rng(seed)
    field = random_field(rng, 1 + seed % 2, 12)
    lengths = rng.integers(1, 6, 9)
    features = rng.choice(np.append(field.known, 7), (lengths.sum(), 3))
    emit = crf.scores(field, features)
    got, at = crf.decode(field, features, lengths, cells=8), 0
    grid, mask = crf.padded(lengths)
    whole, share, _, _ = crf.expected(emit[grid], mask, field.move, field.begin)
    for k, n in enumerate(lengths):
        every = list(itertools.product(range(emit.shape[1]), repeat=int(n)))
        values = np.array([value_of(field, emit[at:at + n], x) for x in every])
        assert tuple(got[at:at + n]) == every[values.argmax()]
        assert np.isclose(whole[k], np.log(np.exp(values - values.max()).sum()) + values.max())
        p = np.exp(values - whole[k])
        for t in range(n):
            assert np.allclose(share[k, t], [p[[x[t] == y for x in every]].sum() for y in range(emit.shape[1])])
        at += n


def valid(text, span):
    found = pii.checked(span[1], text[span[0]:span[2]])
    return found is not None


def test_held_out_rows():
    """Rows drawn from another seed: almost all spans that pass their check are found, and hardly anything else."""
    field, right, wrong, all_spans = pii.model(), 0, 0, 0
    for text, spans in pii.labelled(800, seed=5):
        data = np.frombuffer(text.encode(), np.uint8)
        got = {(a, pii.KINDS[k], b) for a, k, b in pii.field_spans(field, data, np.array([0, len(data)])).get(0, [])}
        want = {s for s in spans if valid(text, s)}
        right, wrong, all_spans = right + len(got & want), wrong + len(got - want), all_spans + len(want)
    assert right >= 0.95 * all_spans and wrong <= 0.02 * all_spans, (right, wrong, all_spans)


def test_whole_table(spark):
    docs = table(spark, SF_CHECK, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = pii.op12_find_pii(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        base = plain_base(texts[r.doc_id])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))
        assert len([s for s in r.spans.split(",") if s]) == len(base) + r.n_added


def test_added_kinds_and_redaction(spark):
    rows = [(1, "call (487) 555-7209 now", 23), (2, "mail jane [at] example [dot] org today", 0), (3, "iban DE89 3704 0044 0532 0130 00.", 0), (4, None, None),
            (5, "", 0), (6, "é SSN: 123-45-6789, and a@b.co +1 (487) 555-7209", 0), (7, "nothing in 2023 costs $12.50 here", 33), (8, "x " * 50_000 + "tel: 030 1234567", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.op12_find_pii(docs).collect()}
    assert spans == {1: "phone:5:19", 2: "email:5:32", 3: "iban:5:32", 4: "", 5: "", 6: "ssn:7:18,email:24:30,phone:31:48", 7: "", 8: "phone:100005:100016"}
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert clean[6] == ("é SSN: [PII], and [PII] [PII]", 29) and clean[4] == (None, None) and clean[7] == (rows[6][1], 33)


def test_edges(spark):
    kind = "doc_id long, text string, spans string, base string, pii_text string, n_email string"
    assert pii.op12_find_pii(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, "a@b.co", *"zzzz")] * 2 + [(None, "a@b.co", *"zzzz"), (2, "1" * 50_000, *"zzzz"), (3, "1 2 " * 20_000, *"zzzz")]
    out = pii.op12_find_pii(spark.createDataFrame(rows, kind)).collect()
    assert len(out) == 5 and [r.spans for r in out if r.doc_id in (1, None)] == ["email:0:6"] * 3
    assert pii.redact(spark.createDataFrame(rows, kind)).filter("text = '[PII]'").count() == 3
