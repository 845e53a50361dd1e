"""Decoded segments and words: confidence gate, estimators, per-word reliability, warnings, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sonora.functions.distributions import log_softmax, normalized_entropy
from sonora.operators.calibration import predict
from sonora.schemas import DecodeConfig
from sonora.storage import small

#: A segment is flagged over this no-speech probability, whatever the decode's own knob says.
FLAG_NO_SPEECH = 0.5
#: Share of flagged segments over which an utterance is warned about.
MANY_FLAGGED = 0.4
ESTIMATORS = ("word_prob", "seg_conf", "seg_min_word", "speech_prob")


def gated(segments: DataFrame, cfg: DecodeConfig = DecodeConfig()) -> DataFrame:
    """Segments with confidence and flagged, text trimmed, words rounded, or null without word timestamps."""
    confidence = F.least(F.lit(1.0), F.exp("avg_logprob"))
    rounded = F.transform("words", lambda w: F.struct(w.word.alias("word"), F.round(w.start, 2).alias("start"), F.round(w.end, 2).alias("end"), F.round(w.prob, 3).alias("prob")))
    words = F.when(F.lit(cfg.word_timestamps) & (F.size("words") > 0), rounded)
    out = segments.withColumn("confidence", confidence).withColumn("text", F.trim("text"))
    out = out.withColumn("flagged", (F.col("confidence") < cfg.low_confidence) | (F.col("no_speech_prob") > FLAG_NO_SPEECH))
    return out.withColumn("words", words) if "words" in segments.columns else out


def words(segments: DataFrame, by: list[str], seg: str = "seg_id") -> DataFrame:
    """One row a word, in reading order by seg and pos, with its segment's figures."""
    exploded = segments.select(*by, seg, "confidence", "no_speech_prob", F.posexplode("words").alias("pos", "w"))
    return exploded.select(*by, seg, "pos", "w.*", "confidence", "no_speech_prob")


def estimators(words: DataFrame, by: list[str], seg: str = "seg_id") -> DataFrame:
    """Words with the score of each estimator."""
    segment = W.partitionBy(*by, seg)
    return words.withColumns({"word_prob": F.col("prob"), "seg_conf": F.col("confidence"), "seg_min_word": F.min("prob").over(segment), "speech_prob": 1 - F.col("no_speech_prob")})


def scored_pairs(labelled: DataFrame, by: list[str], order: list[str], names: tuple[str, ...] = ESTIMATORS) -> DataFrame:
    """(by, estimator, seq, score, correct) of words whose label is known.

    seq follows the order columns, a decimal, as the first may be any long (a hash of a path); the others, at most two,
    are non-negative numbers below 2^21.
    """
    seq = F.col(order[0]).cast("decimal(20,0)")
    for column in order[1:]:
        seq = seq * F.lit(1 << 21) + F.col(column)
    known = labelled.filter("correct is not null").withColumn("seq", seq)
    return known.unpivot([*by, "seq", "correct"], list(names), "estimator", "score").select(*by, "estimator", "seq", "score", "correct")


def dropped_labels(labelled: DataFrame, by: list[str]) -> DataFrame:
    """How many words have no label, and how many have one."""
    return labelled.groupBy(*by).agg(F.count_if(F.col("correct").isNull()).alias("dropped"), F.count_if(F.col("correct").isNotNull()).alias("kept"))


def token_scores(tokens: DataFrame, end_of_text: int | None = None, logits: str = "x") -> DataFrame:
    """Tokens (token_id, logits) with p, h1 and h2: the chosen token's probability and two normalised entropies.

    Tokens from end_of_text on (time stamps and marks) go; logits are never exploded.
    """
    lp = F.col("_lp")
    text = tokens if end_of_text is None else tokens.filter(F.col("token_id") < end_of_text)
    scored = text.withColumn("_lp", log_softmax(F.col(logits)))
    chosen = F.exp(F.try_element_at(lp, (F.col("token_id") + 1).cast("int")))
    return scored.withColumns({"p": chosen, "h1": normalized_entropy(lp, 1.0), "h2": normalized_entropy(lp, 2.0)}).drop("_lp", logits)


def token_words(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, word_idx, p, h1, h2) tokens to one row a word: means, and minima of p and h2."""
    return tokens.groupBy(*by, "word_idx").agg(
        F.avg("p").alias("word_prob"), F.min("p").alias("word_min_prob"), F.avg("h1").alias("entropy_h1"), F.avg("h2").alias("entropy_h2"), F.min("h2").alias("entropy_min_h2")
    )


def word_reliability(words: DataFrame, policies: DataFrame, condition: str = "condition") -> DataFrame:
    """Words with reliability (unrounded) and accept, by the policy of their condition; null without one."""
    facts = policies.select(F.col("condition").alias(condition), "knots", "threshold")
    joined = words.join(small(facts), condition, "left")
    reliability = F.when(F.col("threshold").isNotNull(), predict(F.col("prob"), F.col("knots")))
    return joined.withColumn("reliability", reliability).withColumn("accept", F.col("reliability") >= F.col("threshold")).drop("knots", "threshold")


def reliability_summary(annotated: DataFrame, policies: DataFrame, by: list[str], condition: str = "condition") -> DataFrame:
    """Per utterance and condition: words, accepted, review and coverage, with the policy's facts."""
    counts = annotated.filter("accept is not null").groupBy(*by, condition).agg(F.count("*").alias("words"), F.count_if("accept").alias("accepted"))
    counts = counts.withColumns({"review": F.col("words") - F.col("accepted"), "coverage": F.round(F.col("accepted") / F.col("words"), 3)})
    facts = policies.select(F.col("condition").alias(condition), F.round("threshold", 3).alias("threshold"), "target_risk")
    return counts.join(small(facts), condition).withColumn("estimator", F.lit("word_prob"))


def assembled(segments: DataFrame, by: list[str], seg: str = "seg_id") -> DataFrame:
    """Per utterance: text, number of segments and of flagged ones."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seg).alias("seg"), "text")))
    return segments.groupBy(*by).agg(
        F.trim(F.array_join(F.transform(ordered, lambda s: s.text), " ")).alias("text"), F.count("*").alias("n_segments"), F.count_if("flagged").alias("flagged_segments")
    )


def warnings(duration_s: Column, speech_ratio: Column, lid_low: Column, forced: Column, n_segments: Column, flagged: Column, snr_missing: Column, words_missing: Column, denoise_missing: Column) -> Column:
    """Codes of what limits a result, in order of the stages, with a value after `=` where there is one.

    A condition that is null does not apply. cli.NOTES says what the codes mean.
    """
    share = flagged / F.greatest(n_segments, F.lit(1))
    cases = [
        F.when(denoise_missing, F.lit("denoiser_missing")),
        F.when((duration_s > 3.0) & (speech_ratio < 0.25), F.format_string("little_speech=%.2f", speech_ratio)),
        F.when(duration_s < 2.0, F.format_string("short_clip=%.2f", duration_s)),
        F.when(lid_low & ~forced, F.lit("language_uncertain")),
        F.when((n_segments > 0) & (share > MANY_FLAGGED), F.format_string("flagged_segments=%d/%d", flagged, n_segments)),
        F.when(snr_missing, F.lit("noise_unknown")),
        F.when(words_missing, F.lit("words_missing")),
    ]
    return F.array_compact(F.array(*cases))


def review_words(annotated: DataFrame, by: list[str], seg: str = "seg_id", most: int = 12) -> DataFrame:
    """Per utterance the first words to review, and how many more there are."""
    entry = F.struct(F.col(seg).alias("seg"), "pos", F.trim("word").alias("word"), "reliability")
    todo = annotated.filter("not accept").groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return todo.select(*by, F.transform(F.slice("all", 1, most), lambda w: F.struct(w.word.alias("word"), w.reliability.alias("reliability"))).alias("first"), F.greatest(F.size("all") - most, F.lit(0)).alias("more"))


def level_table(results: DataFrame, by: list[str]) -> DataFrame:
    """Per noise level: utterances, mean probability of the language found, mean error rate, flagged segments."""
    return results.groupBy(*by).agg(
        F.count("*").alias("utterances"), F.avg("probability").alias("probability"), F.avg("error").alias("error"), F.sum("flagged_segments").alias("flagged_segments")
    )


def segment_record(with_words: bool = True) -> Column:
    """A segment as it is serialised: times to 2 places, scores to 3, words only where there are any."""
    fields = [
        F.col("seg_id").alias("id"),
        *[F.round(c, 2).alias(c) for c in ("start", "end")],
        "text",
        *[F.round(c, 3).alias(c) for c in ("avg_logprob", "no_speech_prob", "confidence")],
        "flagged",
    ]
    return F.struct(*fields, *(["words"] if with_words else []))


def language_record() -> Column:
    """A language result as it is serialised: probabilities to 4 places, three alternatives, entropy to 3."""
    top = F.transform(F.slice("top", 1, 3), lambda t: F.struct(t.code.alias("code"), F.round(t.p, 4).alias("p")))
    return F.struct("code", "name", F.round("probability", 4).alias("probability"), top.alias("top"), F.round("entropy", 3).alias("entropy"), "chunks_used", "low_confidence", "method")


def performance(elapsed_s: Column, duration_s: Column) -> Column:
    return F.struct(F.round(elapsed_s, 2).alias("total_time_s"), F.when(duration_s > 0, F.round(elapsed_s / duration_s, 3)).alias("rtf"))
