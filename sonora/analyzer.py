"""The whole analysis of a table of clips: one nested result row for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora import providers
from sonora.operators import language as L
from sonora.operators import signal as S
from sonora.operators import transcripts as R
from sonora.operators import voice as V
from sonora.schemas import DecodeConfig
from sonora.storage import small, written

BY = ["utt_id"]


class Analyzer:
    """Clips (utt_id, samples, sample_rate, optionally language) at 16 kHz to results.

    transcriber and detector are provider factories, see sonora.providers. policy: a condition of the
    `policies` table, "auto" (by the clip's noise), or None. A call's policy, if given, goes before. A result's
    `performance` says what ran; times are those of the job, not of a clip (transcripts.performance() adds known ones).

    What models return (speech spans, votes on languages, segments) is written to the shared folder when analyze() is
    called, so that each model sees a clip once and all parts of a result go back to the same decode.
    """

    def __init__(
        self,
        transcriber: Callable[[DecodeConfig], Callable],
        detector: Callable[[], Callable],
        vad: Callable[[], Callable] | None = None,
        denoiser: Callable[[np.ndarray, int], np.ndarray] | None = None,
        denoise: bool = False,
        policies: DataFrame | None = None,
        policy: str | None = None,
        model: str = "",
        device: str = "auto",
        compute: str = "auto",
        cuda_devices: int = 0,
    ):
        self.transcriber, self.detector, self.vad, self.denoiser, self.denoise = transcriber, detector, vad, denoiser, denoise
        self.policies, self.policy, self.model = policies, policy, model
        self.device, self.compute = providers.resolved_device(device, compute, cuda_devices)

    def _languages(self, clips: DataFrame, spans: DataFrame) -> DataFrame:
        """Forced languages and votes, each for its own clips: no vote is taken where the language is given."""
        given = F.col("language").isNotNull() & (F.col("language") != "")
        free = clips.filter(~given)
        parts = spans.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("speech_s"))
        cut = free.join(parts, BY, "left")
        windows = cut.select(*BY, "samples", "sample_rate", F.posexplode(L.windows(F.size("samples"), F.col("sample_rate"), F.col("spans"))).alias("chunk", "w"))
        windows = windows.filter((F.col("w.end") - F.col("w.start")) / F.col("sample_rate") >= L.LEAST_CHUNK_S)
        chunks = windows.select(*BY, F.slice("samples", (F.col("w.start") + 1).cast("int"), (F.col("w.end") - F.col("w.start")).cast("int")).alias("samples"), "sample_rate", "chunk")
        votes = written(providers.voted(chunks, self.detector))
        found = L.detected(votes, cut.select(*BY, F.coalesce("speech_s", F.lit(0.0)).alias("speech_s")), BY)
        return found.unionByName(L.forced(clips, BY))

    def analyze(self, clips: DataFrame, cfg: DecodeConfig = DecodeConfig(), policy: str | None = None) -> DataFrame:
        policy = policy or self.policy
        if "language" not in clips.columns:
            clips = clips.withColumn("language", F.lit(None).cast("string"))
        clips = clips.select("utt_id", "samples", "sample_rate", "language")
        missing = False
        if self.denoise:
            clips, missing = S.denoised(clips, self.denoiser)
        spans, backend = providers.speech_spans(clips, self.vad)
        spans = written(spans)
        durations = clips.select(*BY, (F.size("samples") / F.col("sample_rate")).alias("duration_s"), "language")
        ratio = V.speech_ratio(spans, durations, BY)
        lid = self._languages(clips, spans)
        segments = R.gated(written(providers.transcribed(clips.drop("language").join(lid.select(*BY, F.col("code").alias("language")), BY), self.transcriber, cfg)), cfg)

        conditions = clips.select(*BY, F.lit(None if policy in (None, "auto") else policy).cast("string").alias("condition"), F.lit(None).cast("double").alias("snr_db"))
        if policy == "auto":
            estimates = V.clip_snr(clips, spans, BY)
            conditions = V.nearest_condition(estimates, BY, self.policies).select(*BY, "condition", "snr_db")
        words = R.words(segments, BY).join(conditions.select(*BY, "condition"), BY, "left")
        blank = {"reliability": F.lit(None).cast("double"), "accept": F.lit(None).cast("boolean")}
        words = R.word_reliability(words, self.policies) if policy else words.withColumns(blank)

        word = F.struct("pos", "word", "start", "end", "prob", F.round("reliability", 3).alias("reliability"), "accept")
        plain = F.transform(F.array_sort(F.collect_list(word)), lambda w: w.dropFields("pos"))
        by_segment = words.groupBy(*BY, "seg_id").agg(plain.alias("words"))
        records = segments.drop("words").join(by_segment, [*BY, "seg_id"], "left").select(*BY, R.segment_record().alias("segment"))
        listed = records.groupBy(*BY).agg(F.array_sort(F.collect_list("segment")).alias("segments"))
        texts = R.assembled(segments, BY)
        counts = words.groupBy(*BY).agg(F.count("*").alias("n_words"), F.count_if("accept").alias("accepted"), F.count_if(F.col("accept").isNotNull()).alias("judged"))
        heard = spans.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct(F.round("start", 2).alias("start"), F.round("end", 2).alias("end")))).alias("speech_segments"))

        out = ratio.join(clips.select(*BY, "sample_rate"), BY).join(lid.select(*BY, R.language_record().alias("result"), "low_confidence"), BY)
        for part in (texts, listed, counts, heard, conditions):
            out = out.join(part, BY, "left")
        if policy:
            facts = self.policies.select("condition", F.round("threshold", 3).alias("threshold"), "target_risk")
            out = out.join(small(facts), "condition", "left")
        else:
            out = out.withColumns({"threshold": F.lit(None).cast("double"), "target_risk": F.lit(None).cast("double")})
        no_words = F.coalesce("n_words", F.lit(0)) == 0
        chosen = F.when(F.lit(policy == "auto"), F.format_string("auto (SNR %.0f dB)", "snr_db")).otherwise(F.lit("explicit"))
        reliability = F.when(
            F.col("judged") > 0,
            F.struct(
                F.lit("word_prob").alias("estimator"), chosen.alias("selected_by"), "target_risk", "threshold", F.col("judged").alias("words"), "accepted",
                F.round(F.col("accepted") / F.col("judged"), 3).alias("coverage"), (F.col("judged") - F.col("accepted")).alias("review"), "condition",
            ),
        )
        n, flagged = F.coalesce("n_segments", F.lit(0)), F.coalesce("flagged_segments", F.lit(0))
        warned = R.warnings(
            F.col("duration_s"), F.col("speech_ratio"), F.col("low_confidence"), F.col("language").isNotNull() & (F.col("language") != ""), n, flagged,
            F.lit(policy == "auto") & F.col("condition").isNull(), F.lit(policy is not None) & F.col("condition").isNotNull() & no_words & (n > 0), F.lit(missing),
        )
        return out.select(
            *BY,
            F.struct(F.round("duration_s", 2).alias("duration_s"), "sample_rate", F.round("speech_ratio", 3).alias("speech_ratio"), F.lit(backend).alias("vad_backend"), F.coalesce("speech_segments", F.array().cast("array<struct<start:double,end:double>>")).alias("speech_segments")).alias("audio"),
            F.col("result").alias("language"),
            F.struct(F.coalesce("text", F.lit("")).alias("text"), "segments", flagged.alias("flagged_segments")).alias("transcript"),
            F.struct(F.lit(self.model).alias("model"), F.lit(self.device).alias("device"), F.lit(self.compute).alias("compute_type")).alias("performance"),
            warned.alias("warnings"),
            reliability.alias("reliability"),
        )
