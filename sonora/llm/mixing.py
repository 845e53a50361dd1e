r"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words, runs of anything but space and \t to \r (null text: 0). Sources
in code-point order, null last, share all sizes by weight; a target stops at MOST times its source's
size, and the excess is shared again by weight until none is above.

Within a source every document expects target / source_size copies. Expected copies are summed up in
order of size, one random offset is added, and a copy is emitted for each integer boundary that a
document's own span crosses. In that order the words taken miss the target by less than about the
source's longest document, and a document gets the floor or the ceiling of its expected copies.

No prefix sum runs over a source's documents. Counts by (source, size, bucket of a hash) are summed up
over distinct sizes within a source and over buckets within a size; only ranks within a bucket look at
documents, which spreads a hot source, and a hot size, over the cluster.

Repeated rows are sampled one by one; rows that agree on source, size, id and text are interchangeable. Texts may be of
any length. Empty tables give no rows. mixed() carries all columns in a struct, so that they may have any names.
Null ids come first among equal sizes. Sources without words have target 0 and give no copies. The
per-source table (one row a source) is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sonora.llm.common import written

WEIGHTS = (1, 2, 3)
MOST = 3
#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets of a size of a source.
BUCKET_DIGITS = 3
#: Hexadecimal digits of the random offsets: few enough that offset plus copies is exact.
OFFSET_DIGITS = 5


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source, source_size) to the same with weight and target, by filling to a level.

    In order of cap / weight, sources are capped while the level that shares the rest reaches their
    cap; the first that is not gives the level of all that follow.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = (F.col("source_size") * MOST).cast("double")
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap)
    ranked = ranked.withColumn("level", rest / rest_weight).withColumn("at", F.row_number().over(by_ratio))
    free = F.col("cap") > F.col("level") * F.col("weight")
    ranked = ranked.withColumn("first", F.min(F.when(free, F.struct("at", "level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("cap")).otherwise(F.col("first.level") * F.col("weight"))
    return ranked.select("source_key", "source", "source_size", "weight", target.alias("target"))


def _offset(seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "source_key")), 1, OFFSET_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**OFFSET_DIGITS))


def with_copies(docs: DataFrame, carried: list[str], seed: int = 11) -> DataFrame:
    """Every row's carried columns in a struct `row`, with size, source_size, target and copies.

    The carried columns are shuffled once. docs is read twice.
    """
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    rows = docs.select(
        key.alias("source_key"),
        F.col("source"),
        words().alias("size"),
        F.col("doc_id"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
    ).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    counts = written(rows.groupBy("source_key", "size", "bucket").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    of_size = counts.groupBy("source_key", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    targets = source_targets(of_size.groupBy("source_key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size")))
    in_source = W.partitionBy("source_key").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    base = of_size.select("source_key", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("base"))
    base = base.join(targets.select("source_key", "source_size", "target"), "source_key")
    in_size = W.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("source_key", "size", "bucket", F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("within"))
    starts = starts.join(base, ["source_key", "size"]).withColumn("start", F.col("base") + F.col("within"))
    placed = rows.drop("source").join(starts.drop("base", "within"), ["source_key", "size", "bucket"])
    rank = F.col("start") + F.row_number().over(W.partitionBy("source_key", "size", "bucket").orderBy("doc_id", "hash"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = placed.withColumn("rank", rank).withColumn("rate", rate).withColumn("u", _offset(seed))
    copies = F.floor(F.col("u") + F.col("rate") * F.col("rank")) - F.floor(F.col("u") + F.col("rate") * (F.col("rank") - 1))
    return ranked.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    found = with_copies(docs, docs.columns).filter("copies > 0")
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of every row."""
    found = with_copies(docs, ["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
