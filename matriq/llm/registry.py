"""The queries opN_<name> and their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matriq.llm import alignment, decontaminate, exact_dedup, language, license_scan, mixing, ngram_join, pieces, search, secret_scan, suffix_dedup, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language_id": language.op4_language_id,
        "op5_pieces": pieces.op5_pieces,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_url_filters": url_filters.op9_url_filters,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_search": search.op11_search,
        "op12_alignment": alignment.op12_alignment,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op7_license_scan": license_scan.SQL,
        "op8_secret_scan": secret_scan.SQL,
        "op9_url_filters": url_filters.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_search": search.SQL,
        "op13_mixing": mixing.SQL,
    }
