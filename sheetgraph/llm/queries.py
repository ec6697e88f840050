"""Queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetgraph.llm import align, caps, chat, decontam, langid, lm_mixing, mixing, quality, simhash, topk, toxicity, trie, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_url_filters": url_filter.query,
        "op3_decontamination": decontam.query,
        "op4_language_id": langid.query,
        "op5_quality": quality.query,
        "op6_simhash_golay": simhash.query,
        "op7_chat_formatting": chat.query,
        "op8_topk_search": topk.query,
        "op9_lm_scoring": lm_mixing.query,
        "op10_source_mixing": mixing.query,
        "op11_prefix_trie": trie.query,
        "op12_tokenizer_alignment": align.query,
        "op13_spherical_caps": caps.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": url_filter.ORACLE,
        "op7_chat_formatting": chat.ORACLE,
        "op8_topk_search": topk.ORACLE,
        "op10_source_mixing": mixing.ORACLE.format(docs="documents"),
        "op11_prefix_trie": trie.ORACLE,
        "op13_spherical_caps": caps.ORACLE,
    }
