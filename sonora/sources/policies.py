"""Policies as JSON documents, one a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOCUMENT = """calibrator struct<knots_x:array<double>,knots_y:array<double>,n_fit:long,condition:string>, threshold double, target_risk double,
coverage double, realized_risk double, notes string"""


def save(policies: DataFrame, path: str) -> None:
    """Writes each policy as a JSON document, in a folder of its condition; minus signs are `neg` in names."""
    pick = lambda field: F.transform("knots", lambda k: k[field])
    calibrator = F.struct(pick("x").alias("knots_x"), pick("y").alias("knots_y"), "n_fit", "condition")
    out = policies.select(F.replace("condition", F.lit("-"), F.lit("neg")).alias("name"), calibrator.alias("calibrator"), "threshold", "target_risk", "coverage", "realized_risk", "notes")
    out.write.mode("overwrite").partitionBy("name").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Policies of JSON documents, on one line or several, in files or folders under a path."""
    read = spark.read.schema(_DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    knots = F.transform(F.arrays_zip(F.col("calibrator.knots_x").alias("x"), F.col("calibrator.knots_y").alias("y")), lambda k: F.struct(k.x.alias("x"), k.y.alias("y")))
    return read.select(
        F.coalesce("calibrator.condition", F.lit("")).alias("condition"), F.coalesce("calibrator.n_fit", F.lit(0)).alias("n_fit"), knots.alias("knots"),
        "threshold", "target_risk", "coverage", "realized_risk", F.coalesce("notes", F.lit("")).alias("notes"),
    )


def available(policies: DataFrame) -> DataFrame:
    """Conditions with a policy, in order of their names."""
    return policies.select("condition").distinct().orderBy("condition")


def of_condition(policies: DataFrame, condition: str) -> DataFrame:
    """The policy of a condition. There is no default: the right one depends on the noise."""
    found = policies.filter(F.col("condition") == condition)
    if found.isEmpty():
        names = [r.condition for r in available(policies).limit(50).collect()]
        raise LookupError(f"no policy for condition {condition!r}; there are {names}")
    return found
