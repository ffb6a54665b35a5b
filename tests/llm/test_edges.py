"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from conftest import SF_CHECK, SF_SMALL  # noqa: E402

import brute  # noqa: E402
from wingwatch.llm import chat, decontam, hostrules, langid, merkle, minhash, mixing, pii, quality, secrets, suffix, tokens  # noqa: E402

CLASH = ["size", "copies", "copy", "c0", "q_text", "score", "key", "n", "bucket", "target", "leak_key", "scan_key", "cuts", "host", "w_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LONG = "the quick brown fox jumps over the lazy dog and runs far away from here " * 4000


def frame(spark, empty=False):
    rows = [(1, "Hello there, this is a text of some words.", "en", "a", 10), (1, "Hello there, this is a text of some words.", "en", "a", 10),
            (2, None, None, None, None), (3, "", "en", "b", 0), (None, "Nobody knows my number but I am here.", "en", None, 5),
            (None, None, None, None, None), (4, LONG, "en", "a", len(LONG)), (5, "123 456 !!! ###", "fr", "b", 15),
            (6, "Bonjour le monde, voici un texte.", "fr", "c", 3), (7, "x", None, "c", 1)]
    return spark.createDataFrame([] if empty else [(*r, *["z"] * len(CLASH)) for r in rows], SCHEMA)


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (3, 0, 0), (4, 1, 1), (5, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 0), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def bench(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, None), (2, ""), (3, "this is a text of some words."), (None, "x y z u v w x y z")], "item_id long, text string")


OPS = {
    "op1": lambda s, d, e: langid.op1_identify_language(d),
    "op2": lambda s, d, e: minhash.op2_near_duplicates(d),
    "op3": lambda s, d, e: quality.op3_quality(d, labels(s, e)),
    "op4": lambda s, d, e: tokens.op4_count_tokens(d),
    "op6": lambda s, d, e: hostrules.op6_host_rules(d),
    "op8": lambda s, d, e: mixing.op8_mix_sources(d),
    "op9": lambda s, d, e: secrets.op9_find_secrets(d),
    "op10": lambda s, d, e: suffix.op10_remove_repeats(d),
    "op11": lambda s, d, e: merkle.op11_merkle_manifest(d),
    "op12": lambda s, d, e: pii.op12_find_pii(d),
}


@pytest.mark.parametrize("op", sorted(OPS))
def test_one_row_per_row(spark, op):
    got = OPS[op](spark, frame(spark), False).collect()
    assert len(got) == 10
    twice = [r for r in got if r.doc_id == 1]
    assert len(twice) == 2 and (op == "op8" or twice[0] == twice[1])


@pytest.mark.parametrize("op", sorted(OPS))
def test_empty_table(spark, op):
    assert OPS[op](spark, frame(spark, True), True).collect() == []


def test_defined_results(spark):
    d = frame(spark)
    lang = {r.doc_id: r for r in OPS["op1"](spark, d, False).collect()}
    assert [lang[i].lang_pred for i in (2, 3, 5)] == ["und"] * 3 and lang[2].score == 0
    assert lang[4].lang_pred == "en" and lang[6].lang_pred in ("en", "fr")
    near = [r for r in OPS["op2"](spark, d, False).collect()]
    assert all(r.kept for r in near) and {r.n_shingles for r in near if r.doc_id in (2, 3)} == {0}
    assert {r.n_tokens for r in OPS["op4"](spark, d, False).collect() if r.doc_id in (2, 3)} == {0}
    assert all(r.base_failed for r in OPS["op6"](spark, d, False).collect() if r.doc_id in (2, 3))
    assert all(r.n_removed == 0 for r in OPS["op10"](spark, d, False).collect())
    assert decontam.leaks(d, bench(spark)).select("doc_id", "item_id").collect() == [(1, 3)]
    assert decontam.leaks(d, bench(spark, True)).count() == 0


def test_no_training_rows(spark):
    d = frame(spark)
    none = d.withColumn("lang", d["lang"].substr(100, 1)).replace("", None, ["lang"])
    assert {r.lang_pred for r in langid.op1_identify_language(none).collect()} == {"und"}
    assert {r.score for r in quality.op3_quality(d, labels(spark, True)).collect()} == {0.5}


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, place long, segments string")
    assert [r.conv_id for r in chat.op5_format_chat(none).collect()] == [-1]


def test_conversations_with_repeated_rows_long_texts_and_clashing_names(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", LONG), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", None)]
    more = "place long, segments string, in_order string, loss string, n_turns string, valid string"
    wide = spark.createDataFrame([(*r, 7, *"zzzzz") for r in rows], "conv_id long, turn long, role string, text string, " + more)
    got = {r.conv_id: r for r in chat.op5_format_chat(wide).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len(LONG) and got[2].n_turns == 3 and got[2].loss_chars == 0
    assert got[-1].n_turns == 2 and len(got) == 3


def test_near_duplicates_of_a_whole_table(spark):
    """All links of the table, two-word shingles, against comparing every pair."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    truth = brute.near_groups([(r.doc_id, r.text) for r in docs.collect()], 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op2_near_duplicates(docs).collect()}
    assert got == truth


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows(spark, stage, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    d = frame(spark)
    out = run(spark, d, str(tmp_path))
    last = stage == corpus_pipeline.STAGES[-1][0]
    assert out.columns[:len(d.columns)] == d.columns and len(out.columns) == len(d.columns) + last
    assert out.count() <= 2 * d.count()
    assert run(spark, frame(spark, True), str(tmp_path)).count() == 0


def test_pipeline_stages_decide(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    near = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF_SMALL)
    truth = brute.near_groups([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in truth.items() if i == c)
    clean = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, SF_SMALL)
    leaked = {r.doc_id for r in decontam.op7_decontaminate(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaked
    safe = dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, SF_SMALL)
    assert safe.count() == docs.count()
    assert secrets.op9_find_secrets(safe).filter("n_assign + n_access + n_hex > 0").count() == 0


def test_doc_ids_with_several_texts(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(100)) for c in "abcdef"}
    near = {c: t + f" {c}more" for c, t in text.items()}
    rows = [(1, text["a"]), (1, text["b"]), (0, near["b"]), (5, text["c"]), (5, text["d"]), (6, near["d"]), (7, near["c"]),
            (8, text["e"]), (8, near["e"]), (8, near["e"]), (9, text["f"]), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp1 string").repartition(4)
    got = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs).collect()}
    assert {(i, n): r.component_id for (i, n), r in got.items()} == {
        (1, 96): 1, (0, 97): 0, (5, 96): 5, (6, 97): 5, (7, 97): 5, (8, 96): 8, (8, 97): 8, (9, 96): 9, (9, 0): 9} | {(1, 96): got[1, 96].component_id}
    kept = minhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id, r.text or "") for r in kept.collect())
    eight = [t for i, t in left if i == 8]
    assert len(eight) == 1 and eight[0] in (text["e"], near["e"])
    assert [x for x in left if x[0] != 8] == sorted([(0, near["b"]), (1, text["a"]), (5, text["c"]), (5, text["d"]), (9, ""), (9, text["f"])])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF_CHECK)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    assert out.columns[:5] == docs.columns
    got = out.groupBy("doc_id").count().collect()
    assert 0 < len(got) < docs.count() and max(r["count"] for r in got) <= 2
