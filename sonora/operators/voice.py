"""Voice activity from frame energies, merged spans, speech ratio, and signal-to-noise estimates.

Samples are long-form rows (utterance keys, i from 0, y) or arrays, a clip a row. Arrays stay arrays (clip_segments,
clip_snr): their frames are made by numpy, their sums in place, and a row is a frame of 30 ms. Long-form samples are summed up by
frame before frames are ordered by clip.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

FRAME_MS, HANG_MS, MIN_SPEECH_MS = 30, 120, 200
MIN_GAP_S = 0.2
MIN_SPEECH_S, MIN_NOISE_S, MAX_SNR_DB = 0.3, 0.2, 40.0


def samples(clips: DataFrame, by: list[str], array: str = "samples") -> DataFrame:
    """Long-form rows of clips that hold their samples as arrays."""
    return clips.select(*by, F.posexplode(array).alias("i", "y"))


def frame_energies(long: DataFrame, by: list[str], frame: int) -> DataFrame:
    """group, idx and db of every whole frame of `frame` samples; the tail is dropped."""
    y = F.col("y").cast("double")
    frames = long.groupBy(*by, F.floor(F.col("i") / frame).alias("idx")).agg(F.count("*").alias("n"), F.avg(y * y).alias("power"))
    return frames.filter(F.col("n") == frame).select(*by, "idx", (F.log10(F.sqrt("power") + 1e-10) * 20).alias("db"))


def _power(samples: Column, start: Column, n: Column) -> Column:
    """Sum of squares of the n samples from start (from 0) on."""
    return F.aggregate(F.slice(samples, start.cast("int") + 1, n.cast("int")), F.lit(0.0), lambda acc, y: acc + y.cast("double") * y.cast("double"))


def clip_frames(clips: DataFrame, by: list[str], frame: int, array: str = "samples") -> DataFrame:
    """frame_energies of clips that hold their samples as arrays, over Arrow; no frames for null or short ones."""
    schema = T.StructType([*[clips.schema[c] for c in by], *T.StructType.fromDDL("db array<double>").fields])
    arrow = to_arrow_schema(schema)

    def levels(samples: pa.ListScalar) -> np.ndarray | None:
        if not samples.is_valid:
            return None
        y = samples.values.to_numpy(zero_copy_only=False).astype(np.float64)
        power = np.square(y[: len(y) // frame * frame]).reshape(-1, frame).mean(axis=1)
        return np.log10(np.sqrt(power) + 1e-10) * 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([levels(v) for v in batch.column(len(by))], arrow.field("db").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], found], schema=arrow)

    framed = clips.select(*by, array).mapInArrow(run, schema)
    return framed.select(*by, F.posexplode("db").alias("idx", "db")).withColumn("idx", F.col("idx").cast("long"))


def active_frames(frames: DataFrame, by: list[str]) -> DataFrame:
    """frames with `active`: above both max - 30 dB and the 20th percentile + 8 dB of the clip."""
    stats = frames.groupBy(*by).agg(F.greatest(F.max("db") - 30, F.percentile("db", F.lit(0.2)) + 8).alias("threshold"), F.count("*").alias("n_frames"))
    return frames.join(stats, by).withColumn("active", F.col("db") > F.col("threshold"))


def runs(active: DataFrame, by: list[str], frame_s: Column, hang: int) -> DataFrame:
    """Spans of active frames with at most `hang` quiet ones between; an open end lasts to the clip's end."""
    order = W.partitionBy(*by).orderBy("idx")
    on = active.filter("active")
    on = on.withColumn("new", F.when(F.col("idx") - F.lag("idx").over(order) <= hang + 1, 0).otherwise(1))
    on = on.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = on.groupBy(*by, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.max("n_frames").alias("n"))
    end = F.when(F.col("n") - 1 - F.col("last") <= hang, F.col("n")).otherwise(F.col("last") + 1)
    return spans.select(*by, (F.col("first") * frame_s).alias("start"), (end * frame_s).alias("end"))


def merged(spans: DataFrame, by: list[str], min_gap_s: float = MIN_GAP_S) -> DataFrame:
    """Spans joined where the next begins at most min_gap_s after all before have ended."""
    order = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = spans.withColumn("new", F.when(F.col("start") - reach <= min_gap_s, 0).otherwise(1))
    cut = cut.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return cut.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def frame_size(sample_rate: int) -> int:
    return max(1, sample_rate * FRAME_MS // 1000)


def frame_segments(frames: DataFrame, by: list[str], frame_s: float) -> DataFrame:
    """Speech spans of each clip by its frames' energy with hangover; short ones go after merging."""
    hang = math.ceil(HANG_MS / FRAME_MS)
    joined = merged(runs(active_frames(frames, by), by, F.lit(frame_s), hang), by)
    return joined.filter(F.col("end") - F.col("start") >= MIN_SPEECH_MS / 1000)


def energy_segments(long: DataFrame, by: list[str], sample_rate: int = 16000) -> DataFrame:
    """frame_segments of long-form samples."""
    frame = frame_size(sample_rate)
    return frame_segments(frame_energies(long, by, frame), by, frame / sample_rate)


def clip_segments(clips: DataFrame, by: list[str], sample_rate: int = 16000, array: str = "samples") -> DataFrame:
    """frame_segments of clips that hold their samples as arrays."""
    frame = frame_size(sample_rate)
    return frame_segments(clip_frames(clips, by, frame, array), by, frame / sample_rate)


def speech_ratio(spans: DataFrame, durations: DataFrame, by: list[str]) -> DataFrame:
    """Share of each clip's duration_s that its spans fill, at most 1; 0 without a duration."""
    total = spans.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("speech_s"))
    share = F.when(F.col("duration_s") > 0, F.least(F.lit(1.0), F.coalesce("speech_s", F.lit(0.0)) / F.col("duration_s"))).otherwise(F.lit(0.0))
    return durations.join(total, by, "left").select(*durations.columns, F.coalesce("speech_s", F.lit(0.0)).alias("speech_s"), share.alias("speech_ratio"))


def speech_mask(long: DataFrame, spans: DataFrame, by: list[str], sample_rate: float) -> DataFrame:
    """Samples with `speech`: inside the union of the spans. Overlapping spans are merged first.

    A range join: spans and samples meet in blocks of samples, so a clip's samples are not gathered.
    """
    block = max(1, int(sample_rate))
    cut = merged(spans, by, 0.0).select(*by, F.greatest(F.lit(0), (F.col("start") * sample_rate).cast("long")).alias("a"), (F.col("end") * sample_rate).cast("long").alias("b"))
    cut = cut.filter("b > a").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    cut = cut.groupBy(*by, "block").agg(F.collect_list(F.struct("a", "b")).alias("inside"))  # at most a second's spans
    placed = long.withColumn("block", F.floor(F.col("i") / block)).join(cut, [*by, "block"], "left")
    within = F.exists("inside", lambda s: (F.col("i") >= s.a) & (F.col("i") < s.b))
    return placed.withColumn("speech", F.coalesce(within, F.lit(False))).drop("block", "inside")


def _snr_of(stats: DataFrame, by: list[str], sample_rate: float) -> DataFrame:
    """(group, n_speech, n_noise, loud, noise) counts of samples and their mean powers to snr_db."""
    signal = F.col("loud") - F.col("noise")
    level = F.greatest(F.lit(-MAX_SNR_DB), F.least(F.lit(MAX_SNR_DB), F.log10(signal / F.col("noise")) * 10))
    value = F.when(F.col("noise") <= 0, F.lit(MAX_SNR_DB)).when(signal <= 0, F.lit(-MAX_SNR_DB)).otherwise(level)
    enough = (F.col("n_speech") >= MIN_SPEECH_S * sample_rate) & (F.col("n_noise") >= MIN_NOISE_S * sample_rate)
    return stats.select(*by, F.when(enough, value).alias("snr_db"))


def snr(long: DataFrame, spans: DataFrame, by: list[str], sample_rate: float = 16000) -> DataFrame:
    """snr_db of each clip; null without enough speech or enough other audio to tell."""
    y = F.col("y").cast("double")
    power = lambda on: F.avg(F.when(on, y * y))
    stats = speech_mask(long, spans, by, sample_rate).groupBy(*by).agg(
        F.count_if("speech").alias("n_speech"), F.count_if(~F.col("speech")).alias("n_noise"), power(F.col("speech")).alias("loud"), power(~F.col("speech")).alias("noise")
    )
    return _snr_of(stats, by, sample_rate)


def clip_snr(clips: DataFrame, spans: DataFrame, by: list[str], sample_rate: float = 16000, array: str = "samples") -> DataFrame:
    """snr of clips that hold their samples as arrays: sums over speech and over the gaps between, without a row a sample."""
    n = F.size(array)
    cut = merged(spans, by, 0.0).select(*by, F.greatest(F.lit(0), (F.col("start") * sample_rate).cast("int")).alias("a"), (F.col("end") * sample_rate).cast("int").alias("b")).filter("b > a")
    speech = cut.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("inside"))
    clips = clips.filter(n > 0).select(*by, F.col(array).alias("_y")).join(speech, by, "left")
    none = F.array().cast("array<struct<a:int,b:int>>")
    n = F.size("_y")
    kept = F.filter(F.transform(F.coalesce("inside", none), lambda s: F.struct(F.least(s.a, n).alias("a"), F.least(s.b, n).alias("b"))), lambda s: s.b > s.a)
    clips = clips.select(*by, "_y", kept.alias("inside"))
    ends = F.concat(F.array(F.lit(0)), F.transform("inside", lambda s: s.b))
    starts = F.concat(F.transform("inside", lambda s: s.a), F.array(n))
    clips = clips.withColumn("outside", F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), F.greatest(a, b).alias("b"))))
    total = lambda spans: F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + _power(F.col("_y"), s.a, s.b - s.a))
    count = lambda spans: F.aggregate(spans, F.lit(0), lambda acc, s: acc + s.b - s.a)
    parts = clips.select(*by, count("inside").alias("n_speech"), count("outside").alias("n_noise"), total("inside").alias("speech"), total("outside").alias("rest"))
    mean = lambda power, n: F.when(F.col(n) > 0, F.col(power) / F.col(n))
    return _snr_of(parts.select(*by, "n_speech", "n_noise", mean("speech", "n_speech").alias("loud"), mean("rest", "n_noise").alias("noise")), by, sample_rate)


def nearest_condition(estimates: DataFrame, by: list[str], conditions: DataFrame) -> DataFrame:
    """estimates with the condition nearest to snr_db, ties to the lower level; null for null or NaN.

    conditions: a column `condition`, clean or a number of dB; a short table, held as an array.
    """
    ladder = conditions.select("condition").distinct().agg(F.collect_list("condition").alias("ladder"))
    value = lambda c: F.when(c == "clean", F.lit(MAX_SNR_DB)).otherwise(c.cast("double"))
    scored = F.transform("ladder", lambda c: F.struct(F.abs(value(c) - F.col("snr_db")).alias("gap"), value(c).alias("level"), c.alias("condition")))
    known = F.col("snr_db").isNotNull() & ~F.isnan("snr_db")
    joined = estimates.join(F.broadcast(ladder))
    return joined.withColumn("condition", F.when(known, F.array_min(scored)["condition"])).drop("ladder")
