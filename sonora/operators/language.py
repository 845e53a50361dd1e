"""Language votes of audio chunks: windows, fusion of distributions, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Seconds of a chunk, the most chunks of an utterance, and the least seconds of one that votes.
CHUNK_S, MAX_CHUNKS, LEAST_CHUNK_S = 30.0, 3, 1.0
EPS = 1e-6
TOP = 5

#: Names of language codes.
NAMES = {
    "en": "English", "zh": "Chinese", "yue": "Cantonese", "de": "German", "es": "Spanish", "ru": "Russian", "ko": "Korean", "fr": "French", "ja": "Japanese", "pt": "Portuguese",
    "tr": "Turkish", "pl": "Polish", "ca": "Catalan", "nl": "Dutch", "ar": "Arabic", "sv": "Swedish", "it": "Italian", "id": "Indonesian", "hi": "Hindi", "fi": "Finnish",
    "vi": "Vietnamese", "he": "Hebrew", "uk": "Ukrainian", "el": "Greek", "ms": "Malay", "cs": "Czech", "ro": "Romanian", "da": "Danish", "hu": "Hungarian", "ta": "Tamil",
    "no": "Norwegian", "th": "Thai", "ur": "Urdu", "hr": "Croatian", "bg": "Bulgarian", "lt": "Lithuanian", "la": "Latin", "ml": "Malayalam", "cy": "Welsh", "sk": "Slovak",
    "te": "Telugu", "fa": "Persian", "lv": "Latvian", "bn": "Bengali", "sr": "Serbian", "az": "Azerbaijani", "sl": "Slovenian", "kn": "Kannada", "et": "Estonian", "mk": "Macedonian",
}


def name(code: Column) -> Column:
    """A code's name, or the code."""
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def windows(n_samples: Column, sample_rate: Column, segments: Column) -> Column:
    """Up to three (start, end) sample spans: at the first speech, the middle segment and the last 30 s.

    segments: array of (start, end) seconds; without any, the clip's start, middle and end.
    """
    rate, duration = sample_rate.cast("double"), n_samples / sample_rate
    chunk = (F.lit(CHUNK_S) * rate).cast("long")
    none = segments.isNull() | (F.size(segments) <= 0)
    middle = F.try_element_at(segments, F.floor(F.size(segments) / 2).cast("int") + 1)
    last = F.try_element_at(segments, F.lit(-1))
    spoken = F.array(F.try_element_at(segments, F.lit(1))["start"], middle["start"], F.greatest(F.lit(0.0), last["end"] - CHUNK_S))
    plain = F.array(F.lit(0.0), F.greatest(F.lit(0.0), duration / 2 - CHUNK_S / 2), F.greatest(F.lit(0.0), duration - CHUNK_S))
    clamp = lambda a: F.least(F.greatest(F.lit(0), (a * rate).cast("long")), F.greatest(F.lit(0), n_samples - chunk)).cast("long")
    starts = F.slice(F.array_distinct(F.transform(F.when(none, plain).otherwise(spoken), clamp)), 1, MAX_CHUNKS)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + chunk, n_samples.cast("long")).alias("end")))


def long_form(votes: DataFrame, by: list[str], chunk: str = "chunk", distribution: str = "distribution") -> DataFrame:
    """One row for each chunk and language of maps of probabilities."""
    return votes.select(*by, chunk, F.explode(distribution).alias("lang", "p"))


def fused(votes: DataFrame, by: list[str], chunk: str = "chunk", eps: float = EPS) -> DataFrame:
    """group, lang, p: the geometric mean over chunks of (lang, p) rows; a missing language counts as p = 0."""
    chunks = votes.groupBy(*by, chunk).agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("chunks"))
    sums = votes.groupBy(*by, "lang").agg(F.sum(F.ln(F.col("p") + eps)).alias("logs"), F.count("*").alias("present"))
    scored = sums.join(chunks, by).withColumn("logs", F.col("logs") + (F.col("chunks") - F.col("present")) * F.ln(F.lit(eps)))
    group = W.partitionBy(*by)  # of languages: a few dozen rows
    scored = scored.withColumn("weight", F.exp(F.col("logs") - F.max("logs").over(group)))
    return scored.select(*by, "lang", "chunks", (F.col("weight") / F.sum("weight").over(group)).alias("p"))


def detected(votes: DataFrame, speech: DataFrame, by: list[str], chunk: str = "chunk") -> DataFrame:
    """The language result of each row of `speech` (group, speech_s), from votes of chunks long enough.

    Ties in probability go to the smaller code. Without votes: en at 0, low confidence. speech_s null: no
    segments were given.
    """
    found = fused(votes, by, chunk)
    ranked = found.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("order"), F.col("lang").alias("code"), "p"))).alias("ranked"),
        F.max("chunks").alias("chunks_used"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"),
    )
    out = speech.join(ranked, by, "left")
    top = F.transform(F.slice("ranked", 1, TOP), lambda r: F.struct(r.code.alias("code"), r.p.alias("p")))
    code, p = F.coalesce(F.col("ranked")[0]["code"], F.lit("en")), F.coalesce(F.col("ranked")[0]["p"], F.lit(0.0))
    low = F.col("ranked").isNull() | (p < 0.5) | F.coalesce(F.col("speech_s") < 2.0, F.lit(False))
    none = F.array().cast("array<struct<code:string,p:double>>")
    return out.select(
        *by, code.alias("code"), name(code).alias("name"), p.alias("probability"), F.coalesce(top, none).alias("top"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.coalesce("chunks_used", F.lit(0)).cast("long").alias("chunks_used"), low.alias("low_confidence"), F.lit("chunk_vote").alias("method"),
    )


def forced(utterances: DataFrame, by: list[str], language: str = "language") -> DataFrame:
    """The result of utterances whose language is given, without any vote."""
    code = F.col(language)
    top = F.array(F.struct(code.alias("code"), F.lit(1.0).alias("p")))
    return utterances.filter(code.isNotNull() & (code != "")).select(
        *by, code.alias("code"), name(code).alias("name"), F.lit(1.0).alias("probability"), top.alias("top"), F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("chunks_used"),
        F.lit(False).alias("low_confidence"), F.lit("forced").alias("method"),
    )
