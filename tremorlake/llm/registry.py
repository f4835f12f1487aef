"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremorlake.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, packing, phrases, pii, quality, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_url_filter": url_filter.query,
        "op4_packing": packing.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_decontaminate": decontaminate.query,
        "op7_pii": pii.query,
        "op8_toxicity": toxicity.query,
        "op9_suffix_dedup": suffix_dedup.query,
        "op10_line_dedup": line_dedup.query,
        "op11_phrases": phrases.query,
        "op12_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_url_filter": url_filter.ORACLE,
        "op5_jaccard_join": jaccard_join.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op9_suffix_dedup": suffix_dedup.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_phrases": phrases.ORACLE,
        "op12_mixing": mixing.ORACLE,
    }
