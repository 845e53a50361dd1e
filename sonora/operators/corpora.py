"""Selecting and joining the utterances of a corpus, and error rates over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sonora.functions import text as X

#: A fixed value: marks stretches that a corpus leaves out of its scoring.
SKIP = "IGNORE_TIME_SEGMENT_IN_SCORING"
SCAN, MIN_WORDS, MIN_DURATION_S = 4000, 3, 2.0


def usable(arrived: DataFrame, order: str, speaker: str, scan: int = SCAN) -> DataFrame:
    """Of the first `scan` rows, those with a scorable reference of some length. Unknown speakers are `?`."""
    first = arrived.orderBy(order).limit(scan)
    text = F.trim("text")
    kept = first.filter((text != "") & ~F.contains(text, F.lit(SKIP)) & (F.regexp_count(text, F.lit(r"\S+")) >= MIN_WORDS) & (F.col("duration_s") >= MIN_DURATION_S))
    return kept.withColumn("text", text).withColumn(speaker, F.coalesce(F.when(F.col(speaker) != "", F.col(speaker)), F.lit("?")))


def round_robin(utterances: DataFrame, order: str, limit: int, speaker: str = "speaker") -> DataFrame:
    """The first `limit` utterances when speakers take turns, in the order of their first one, with their `place`."""
    own = W.partitionBy(speaker)
    ranked = utterances.withColumn("turn", F.row_number().over(own.orderBy(order))).withColumn("arrived", F.min(order).over(own))
    chosen = ranked.orderBy("turn", "arrived").limit(limit)
    return chosen.withColumn("place", F.row_number().over(W.orderBy("turn", "arrived")).cast("long")).drop("turn", "arrived")


def joined_clip(utterances: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first n utterances as one: samples in a row, references joined by spaces."""
    first = utterances.orderBy(order).limit(n)
    parts = first.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "samples", "reference"))).alias("parts"))
    return parts.select(
        F.flatten(F.transform("parts", lambda p: p.samples)).alias("samples"), F.array_join(F.transform("parts", lambda p: F.trim(p.reference)), " ").alias("reference")
    )


def joined_wer(utterances: DataFrame, by: list[str], order: str) -> DataFrame:
    """Word error rate of the references of a group joined in order against its hypotheses joined.

    An alignment may cross utterances, so a group's texts meet in one row, and the time grows with the
    square of its length: for test sets. pooled_wer() is for corpora of any size.
    """
    parts = utterances.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "ref", "hyp"))).alias("parts"))
    whole = {c: X.normalized(F.array_join(F.col("parts").getField(c), " ")) for c in ("ref", "hyp")}
    return parts.withColumns(whole).select(*by, X.wer(F.col("ref"), F.col("hyp")).alias("wer"))


def pooled_wer(utterances: DataFrame, by: list[str]) -> DataFrame:
    """Errors of the utterances of a group, each aligned by itself, over its reference words."""
    normal = utterances.withColumns({c: X.normalized(F.col(c)) for c in ("ref", "hyp")})
    a, b = X.tokens(F.col("ref")), X.tokens(F.col("hyp"))
    counted = normal.select(*by, X.token_distance(a, b).cast("long").alias("errors"), F.size(a).cast("long").alias("words"))
    sums = counted.groupBy(*by).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    return sums.withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")))


def smoke_set(spark) -> DataFrame:
    """(voice, expected, text): one short sentence in each of five languages, to try a provider on."""
    rows = [
        ("en", "en", "The train to the coast leaves at half past seven."),
        ("de", "de", "Der Zug an die Küste fährt um halb acht ab."),
        ("fr", "fr", "Le train pour la côte part à sept heures et demie."),
        ("es", "es", "El tren a la costa sale a las siete y media."),
        ("it", "it", "Il treno per la costa parte alle sette e mezza."),
    ]
    return spark.createDataFrame(rows, "voice string, expected string, text string")
