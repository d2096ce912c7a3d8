"""Queries of the corpus operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, fill_in_middle, html_extract, minhash, oracle, piece_bpe, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_count, url_filter, whitening
from tessera.llm.common import ship, table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, folder, "documents"), texts=False).drop("kept")


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(table(spark, folder, "pages"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(table(spark, folder, "documents"), texts=False).drop("kept")


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, folder, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_url_filters": op3_url_filters,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_html_extraction": op5_html_extraction,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_minhash_near_dedup": op11_minhash_near_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_fill_in_middle": op13_fill_in_middle,
    }
    return {name: _with_package(f) for name, f in found.items()}


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def oracle_sql() -> dict[str, str]:
    """SQL where there is any; the other queries are tested against brute force."""
    return {
        "op1_quality_rules": oracle.quality_sql(),
        "op2_suffix_dedup": oracle.suffix_sql(),
        "op6_substring_dedup": oracle.substring_sql(),
        "op10_benchmark_decontamination": oracle.decontamination_sql(),
        "op11_minhash_near_dedup": oracle.minhash_sql(),
        "op13_fill_in_middle": oracle.fill_in_middle_sql(),
    }
