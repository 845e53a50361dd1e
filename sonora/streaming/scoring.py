"""Word reliability over a stream of segments: an extension, as the same transforms hold for streams.

The annotation has no state. Coverage by time window has, with a watermark that bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.operators import transcripts as R


def annotated(segments: DataFrame, policies: DataFrame) -> DataFrame:
    """Streamed segments (with condition and ts) to words with reliability and accept."""
    gate = segments.withColumn("confidence", F.least(F.lit(1.0), F.exp("avg_logprob")))
    words = gate.select("utt_id", "condition", "ts", "seg_id", F.posexplode("words").alias("pos", "w")).select("utt_id", "condition", "ts", "seg_id", "pos", "w.word", "w.prob")
    return R.word_reliability(words, policies)


def coverage(words: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Words and accepted words of each condition and time window; rows later than `late` are left out."""
    timed = words.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window).alias("window"), "condition")
    return grouped.agg(F.count("*").alias("words"), F.count_if("accept").alias("accepted")).select("window.start", "window.end", "condition", "words", "accepted")
