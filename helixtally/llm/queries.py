"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.llm import blocks, bpe, decontaminate, embeddings, lm, pages, phrases, quality, search, secret_scan, simhash, suffixes, toxicity
from helixtally.llm.common import table
from helixtally.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_bits(F.col("bits")).alias("fingerprint"), "component_id")


def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.removed_bytes(table(spark, folder, "documents"), keep_text=False)


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(table(spark, folder, "pages"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.removed_words(table(spark, folder, "documents"), keep_text=False).drop("spans")


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_percent")
    return quality.measure(docs).select(*names)


def op8_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_copies(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scans": op8_secret_scans,
    "op9_byte_level_bpe": op9_byte_level_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
