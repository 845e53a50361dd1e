"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonora.llm import chat, language_id, line_dedup, media, mixing, near_duplicates, packing, quality, sql, substring_dedup, url_filter
from sonora.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.report(table(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(chat.probe(turns))))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_chat_windows": op6_chat_windows,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_media_columns": op10_media_columns,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": sql.OP1,
    "op2_source_mixing": sql.OP2,
    "op4_line_dedup": sql.OP4,
    "op5_near_duplicates": sql.OP5,
    "op6_chat_windows": sql.OP6,
    "op7_url_filter": sql.OP7,
}
