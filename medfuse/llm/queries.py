"""Registered queries of the corpus operators and their DuckDB SQL: ``QUERIES`` and ``ORACLES`` by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medfuse.llm import (chat_format, crf_langid, fm_decontam, lexical, licenses, line_dedup, mixing, quality, simhash, spelling,
                         surrogates, url_filter, vamana)
from medfuse.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_conflict(table(spark, sf_dir, "conversations")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_mentions(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_mentions")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.identify(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), slim_rows=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_chat_formatting, op3_quality_classifier, op4_simhash_near_dedup, op5_embedding_near_dedup,
    op6_pii_surrogates, op7_url_filter, op8_language_id, op9_benchmark_decontamination, op10_mix_sources, op11_spelling_variants, op12_lexical_search, op13_license_scan,
)}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat_format.oracle_sql(),
    "op5_embedding_near_dedup": vamana.oracle_sql(),
    "op9_benchmark_decontamination": fm_decontam.oracle_sql(),
    "op10_mix_sources": mixing.oracle_sql(),
    "op11_spelling_variants": spelling.oracle_sql(),
    "op12_lexical_search": lexical.oracle_sql(),
    "op13_license_scan": licenses.oracle_sql(),
}
