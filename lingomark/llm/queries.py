"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lingomark.llm import (
    decontaminate, exact, html, interactions, language, mixing, quality, repeats, sharding, simhash, tokens, urls, variants,
)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    labelled = mixing.domain_labels(table(spark, folder, "labels"))
    return mixing.mix(table(spark, folder, "documents"), labelled, keep=["doc_id", "source"])


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeat_report(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.document_shards(table(spark, folder, "documents"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.filter_urls(pages, urls.labelled_pages(pages, table(spark, folder, "labels")))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_html_text": op10_html_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality": op13_quality,
}

ORACLES = {
    "op4_exact_dedup": exact.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op7_sharding": sharding.SQL,
    "op11_filter_audit": interactions.SQL,
}
