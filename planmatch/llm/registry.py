"""Queries of this package, by name, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planmatch.llm import conversation_trie, html_extract, jaccard_join, language_model, mixing, nearest, packing, personal_data, quality_model, quality_rules, substring_dedup, token_files, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_personal_data": personal_data.op6_personal_data,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_language_model": language_model.op9_language_model,
    "op10_nearest": nearest.op10_nearest,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_whitening": whitening.op12_whitening,
    "op13_token_files": token_files.op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op10_nearest": nearest.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
}
