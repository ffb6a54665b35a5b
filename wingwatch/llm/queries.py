"""Registered queries of the subpackage and their DuckDB oracle SQL."""

from __future__ import annotations

from wingwatch.llm import (
    chat, decontam, divergence, hostrules, langid, merkle, minhash, mixing, pii, quality, secrets, suffix, tokens)
from wingwatch.llm.common import table

QUERIES = {
    "op1_identify_language": lambda spark, d: langid.op1_identify_language(table(spark, d, "documents")),
    "op2_near_duplicates": lambda spark, d: minhash.op2_near_duplicates(table(spark, d, "documents")),
    "op3_quality": lambda spark, d: quality.op3_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_count_tokens": lambda spark, d: tokens.op4_count_tokens(table(spark, d, "documents")),
    "op5_format_chat": lambda spark, d: chat.op5_format_chat(table(spark, d, "conversations")),
    "op6_host_rules": lambda spark, d: hostrules.op6_host_rules(table(spark, d, "documents")),
    "op7_decontaminate": lambda spark, d: decontam.op7_decontaminate(
        table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_find_secrets": lambda spark, d: secrets.op9_find_secrets(table(spark, d, "documents")),
    "op8_mix_sources": lambda spark, d: mixing.op8_mix_sources(table(spark, d, "documents")),
    "op10_remove_repeats": lambda spark, d: suffix.op10_remove_repeats(table(spark, d, "documents")),
    "op12_find_pii": lambda spark, d: pii.op12_find_pii(table(spark, d, "documents")),
    "op13_source_divergence": lambda spark, d: divergence.op13_source_divergence(table(spark, d, "documents")),
    "op11_merkle_manifest": lambda spark, d: merkle.op11_merkle_manifest(table(spark, d, "documents")),
}

ORACLE = {
    "op6_host_rules": hostrules.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
