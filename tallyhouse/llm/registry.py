"""The registered training-data queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import (
    automata,
    conversations,
    html,
    language,
    merkle,
    mixing,
    neighbours,
    periodic,
    pieces,
    quality,
    simhash,
    suffixes,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_html_extraction": html.op3_html_extraction,
        "op4_suffix_array_dedup": suffixes.op4_suffix_array_dedup,
        "op5_document_fingerprints": merkle.op5_document_fingerprints,
        "op6_simhash_components": simhash.op6_simhash_components,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
        "op9_substring_dedup": automata.op9_substring_dedup,
        "op10_language_id": language.op10_language_id,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE}
