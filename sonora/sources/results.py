"""Sinks of results and of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(results: DataFrame, path: str) -> None:
    """The transcripts alone, a line each."""
    results.select(F.col("transcript.text").alias("value")).write.mode("overwrite").text(path)


def write_pairs(scored: DataFrame, path: str) -> None:
    """Scored pairs as a table, partitioned by condition and estimator."""
    scored.write.mode("overwrite").partitionBy("condition", "estimator").parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq long, score double, correct boolean, condition string, estimator string").parquet(path)


def stamped(table: DataFrame, **facts: str) -> DataFrame:
    """A table with provenance columns: what made it, as given, and Spark's version."""
    return table.withColumns({f"run_{k}": F.lit(v) for k, v in {"spark": table.sparkSession.version, **facts}.items()})


def write_study(summary: DataFrame, path: str) -> None:
    """A study's metrics as JSON, a document for each condition: estimator to metrics.

    summary: a row for each condition and estimator, as metrics.summary() gives it. The pairs themselves go
    to write_pairs().
    """
    metrics = F.struct(*[c for c in summary.columns if c not in ("condition", "estimator")])
    entries = F.sort_array(F.collect_list(F.struct("estimator", metrics.alias("metrics"))))
    summary.groupBy("condition").agg(F.map_from_entries(entries).alias("estimators")).write.mode("overwrite").json(path)
