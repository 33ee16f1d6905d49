"""Queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, linededup, maxent, packing, prefixtrie, sharding, simhash, spelling, syncmers, tokencounts, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_lm_scoring": maxent.op2_lm_scoring,
    "op3_sharding": sharding.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_url_filters": urlfilter.op7_url_filters,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_document_fingerprints": syncmers.op9_document_fingerprints,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_token_counts": tokencounts.op11_token_counts,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_conversation_prefix_trie": prefixtrie.op13_conversation_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": chat.OP6_SQL,
    "op7_url_filters": urlfilter.OP7_SQL,
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_conversation_prefix_trie": prefixtrie.OP13_SQL,
}
