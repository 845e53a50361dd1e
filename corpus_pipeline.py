"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

All but the last stage keep the columns of documents, whatever else these are named. Null and empty texts have no
letter, so the first stage rejects them. Of repeated rows and equal texts line deduplication and near duplicates leave
one, ties going to the smaller id, null ids last. Texts may be of any length. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonora.llm import language_id, line_dedup, mixing, near_duplicates, packing
from sonora.llm.common import table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted on a bounded sample of docs, does not reject."""
    return language_id.accepted(docs, language_id.fit(docs))


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier ones have; those that lose all their lines go."""
    return line_dedup.cleaned(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return near_duplicates.deduplicated(docs, near_duplicates.DEFAULT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_deduplicated),
    ("near_duplicates", near_deduplicated),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: SQL cannot express the stages; tests/llm holds their result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
