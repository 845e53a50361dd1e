"""Queries of decoded segments, words, reliability and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.functions.text import clock
from sonora.operators import language as L
from sonora.operators import metrics as M
from sonora.operators import transcripts as R
from sonora.plans import bindings as B
from sonora.schemas import DecodeConfig

BY = ["utt_id"]
TIMED = DecodeConfig(word_timestamps=True)


def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(R.gated(B.segments(spark, sf_dir)).select("utt_id", "seg_id", "confidence", "flagged"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = B.segments(spark, sf_dir).withColumn("confidence", F.least(F.lit(1.0), F.exp("avg_logprob")))
    return R.words(segments, BY)


def estimator_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(R.estimators(_words(spark, sf_dir), BY).select("utt_id", "seg_id", "pos", *R.ESTIMATORS))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.length("word") % 5 != 0, (F.col("pos") + F.col("utt_id")) % 4 != 0)
    return R.estimators(_words(spark, sf_dir), BY).withColumn("correct", label).withColumn("condition", F.col("utt_id") % 6)


def dropped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dropped_labels(_labelled(spark, sf_dir), ["condition"])


def estimator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = R.scored_pairs(_labelled(spark, sf_dir), ["condition"], ["utt_id", "seg_id", "pos"])
    return B.rounded(M.summary(pairs, ["condition", "estimator"]))


def token_to_word_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("utt_id"), F.posexplode("embedding").alias("i", "x"), F.col("vec_id")
    )
    p = F.abs("x").cast("double")
    return B.rounded(R.token_words(tokens.select("utt_id", F.floor(F.col("i") / 4).alias("word_idx"), p.alias("p"), (p / 2).alias("h1"), (p / 3).alias("h2")), BY))


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 7 % 64).alias("token_id"), F.col("embedding").alias("x"))
    return B.rounded(R.token_scores(tokens, end_of_text=60))


def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.assembled(R.gated(B.segments(spark, sf_dir)), BY)
    found = parts.withColumns({"level": F.col("utt_id") % 6, "probability": (F.col("utt_id") % 10) / F.lit(10.0), "error": F.length("text") / F.lit(9973.0)})
    return B.rounded(R.level_table(found, ["level"]))


def window_constancy_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = B.segments(spark, sf_dir).withColumn("seek", F.floor(F.col("seg_id") / (F.col("utt_id") % 3 + 1)))
    shared = -(F.col("seek") + 1) / F.lit(7.0)
    own = -(F.col("seg_id") + 1) / F.lit(7.0)
    segments = segments.withColumn("avg_logprob", F.when(F.col("utt_id") % 2 == 0, shared).otherwise(own)).withColumn("compression_ratio", F.length("text") / F.lit(100.0))
    return M.window_constancy(segments, BY)


def word_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).withColumn("condition", B.condition_of(F.col("utt_id")))
    return B.rounded(R.word_reliability(words, B.policies(spark)).select("utt_id", "seg_id", "pos", "condition", "reliability", "accept"))


def reliability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).withColumn("condition", B.condition_of(F.col("utt_id")))
    return R.reliability_summary(R.word_reliability(words, B.policies(spark)), B.policies(spark), BY)


def review_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).withColumn("condition", B.condition_of(F.col("utt_id")))
    found = R.review_words(R.word_reliability(words, B.policies(spark)), BY)
    return found.select("utt_id", "more", F.array_join(F.transform("first", lambda w: w.word), " ").alias("words"))


def transcript_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assembled(R.gated(B.segments(spark, sf_dir)), BY)


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.assembled(R.gated(B.segments(spark, sf_dir)), BY)
    n = F.col("utt_id")
    found = R.warnings(
        (n % 9) / F.lit(2.0), (n % 10) / F.lit(20.0), n % 3 == 0, n % 6 == 0, F.col("n_segments"), F.col("flagged_segments"), n % 8 == 0, n % 7 == 0, n % 11 == 0
    )
    return parts.select("utt_id", F.posexplode(found).alias("place", "warning"))


def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = R.gated(B.segments(spark, sf_dir), TIMED)
    record = R.segment_record()
    return segments.select("utt_id", record.alias("r"), clock(F.col("start")).alias("clock")).select(
        "utt_id", F.col("r.id").alias("id"), "clock", "r.start", "r.end", "r.avg_logprob", "r.no_speech_prob", "r.confidence", "r.flagged", F.size("r.words").alias("n_words")
    )


def forced_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id"), F.when(F.col("doc_id") % 3 != 0, F.when(F.col("doc_id") % 7 == 0, F.lit("xx")).otherwise(F.col("lang"))).alias("language"))
    return L.forced(given, BY).select("utt_id", "code", "name", "probability", "low_confidence", "method")


def language_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.table(spark, sf_dir, "documents").select("source", F.col("lang").alias("expected"), F.when(F.col("doc_id") % 10 == 0, F.lit("en")).otherwise(F.col("lang")).alias("code"))
    return M.hit_count(found, ["source"])


def speed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = B.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("model")).agg((F.sum("n_chars") / F.lit(1000.0)).alias("elapsed_s"), (F.count("*") * F.lit(10.0)).alias("duration_s"))
    return B.rounded(M.speed(runs))


QUERIES = {
    "confidence_gate": confidence_gate,
    "estimator_projection": estimator_projection,
    "dropped_labels": dropped_labels,
    "estimator_report": estimator_report,
    "token_to_word_agg": token_to_word_agg,
    "token_scores": token_scores,
    "level_table": level_table,
    "window_constancy_probe": window_constancy_probe,
    "word_reliability": word_reliability,
    "reliability_summary": reliability_summary,
    "review_words": review_words,
    "transcript_assembly": transcript_assembly,
    "warnings": warnings,
    "segment_records": segment_records,
    "forced_language": forced_language,
    "language_hits": language_hits,
    "speed_table": speed_table,
}

_WD = f"with {B.SEGMENTS}, {B.WORDS}"
_LABELLED = f"""{_WD}, ll as (
  select utt_id % 6 as condition, (utt_id * 2097152 + seg_id) * 2097152 + pos as seq, case when length(word) % 5 <> 0 then (pos + utt_id) % 4 <> 0 end as correct,
    prob as word_prob, confidence as seg_conf, min(prob) over (partition by utt_id, seg_id) as seg_min_word, 1 - no_speech_prob as speech_prob from wd)"""
_RELIABLE = f"""{_WD}, {B.POLICIES_SQL},
wc as (select *, {B.CONDITION} as condition from wd),
rl as (select wc.*, po.threshold, po.target_risk, case when po.threshold is not null then {B.predict_sql("prob", "wc.condition")} end as reliability from wc left join po using (condition))"""
_GATED = f"with {B.SEGMENTS}, ga as (select *, least(1, exp(avg_logprob)) as confidence, least(1, exp(avg_logprob)) < 0.85::double or no_speech_prob > 0.5::double as flagged from sg)"
_REPORT = (
    f"{_LABELLED}, sc as (select condition || '/' || estimator as condition, seq, score, correct from (unpivot (select * from ll where correct is not null) on word_prob, seg_conf, seg_min_word, speech_prob into name estimator value score))"
)
_NAMES = ", ".join(f"('{c}', '{n}')" for c, n in L.NAMES.items())


def _report() -> str:
    from sonora.plans import scoring as S

    return f"""{_REPORT}, {S._auroc()}, {S._NT}, {S._ece()}, {S._nce()}, {S._CURVE}, ar as (select condition, avg(risk) as aurc from rc group by 1)
      select split_part(condition, '/', 1)::bigint as condition, split_part(condition, '/', 2) as estimator, count(*) as n, round(avg(correct::int), 6) as accuracy, round(avg(score), 6) as mean_score,
        round(any_value(auroc), 6) as auroc, round(any_value(auc_nt), 6) as auc_nt, round(any_value(ece), 6) as ece, round(any_value(nce), 6) as nce, round(any_value(aurc), 6) as aurc
      from sc join roc using (condition) join ant using (condition) join ec using (condition) join nc using (condition) join ar using (condition) group by sc.condition"""


ORACLE_SQL = {
    "confidence_gate": f"{_GATED} select utt_id, seg_id, round(confidence, 6) as confidence, flagged from ga",
    "estimator_projection": f"""{_WD} select utt_id, seg_id, pos::int as pos, round(prob, 6) as word_prob, round(confidence, 6) as seg_conf,
      round(min(prob) over (partition by utt_id, seg_id), 6) as seg_min_word, round(1 - no_speech_prob, 6) as speech_prob from wd""",
    "dropped_labels": f"{_LABELLED} select condition, count(*) filter (correct is null) as dropped, count(correct) as kept from ll group by 1",
    "estimator_report": _report(),
    "token_to_word_agg": """with t as (select label as utt_id, unnest(range(len(embedding))) // 4 as word_idx, abs(unnest(embedding)::double) as p from embeddings)
      select utt_id, word_idx, round(avg(p), 6) as word_prob, round(min(p), 6) as word_min_prob, round(avg(p / 2), 6) as entropy_h1, round(avg(p / 3), 6) as entropy_h2, round(min(p / 3), 6) as entropy_min_h2
      from t group by 1, 2""",
    "token_scores": f"""with {B.DISTRIBUTIONS} select vec_id, vec_id * 7 % 64 as token_id, round(max(exp(lp)) filter (idx = vec_id * 7 % 64), 6) as p,
      round(greatest(0, least(1, 1 + sum(exp(lp) * lp) / ln(any_value(size)))), 6) as h1, round(greatest(0, least(1, 1 + ln(sum(exp(2 * lp))) / ln(any_value(size)))), 6) as h2
      from lp group by vec_id having vec_id * 7 % 64 < 60""",
    "level_table": f"""{_GATED}, p as (select utt_id, length(trim(string_agg(trim(text), ' ' order by seg_id))) as n, count(*) filter (flagged) as f from ga group by 1)
      select utt_id % 6 as level, count(*) as utterances, round(avg((utt_id % 10) / 10::double), 6) as probability, round(avg(n / 9973::double), 6) as error, sum(f)::bigint as flagged_segments from p group by 1""",
    "window_constancy_probe": f"""with {B.SEGMENTS}, s as (select *, seg_id // (utt_id % 3 + 1) as seek from sg),
      c as (select utt_id, count(*) as segments, count(distinct seek) as windows, count(distinct round(case when utt_id % 2 = 0 then -(seek + 1) / 7::double else -(seg_id + 1) / 7::double end, 9)) as distinct_logprob,
        count(distinct round(no_speech_prob, 9)) as distinct_no_speech, count(distinct round(length(text) / 100::double, 9)) as distinct_compression from s group by 1)
      select *, case when distinct_logprob = windows and windows < segments then 'CONFIRMED' when distinct_logprob = segments then 'REFUTED' else 'INCONCLUSIVE' end as verdict from c""",
    "word_reliability": f"{_RELIABLE} select utt_id, seg_id, pos::int as pos, condition, round(reliability, 6) as reliability, reliability >= threshold as accept from rl",
    "reliability_summary": f"""{_RELIABLE} select utt_id, condition, count(*) as words, count(*) filter (reliability >= threshold) as accepted, count(*) filter (reliability < threshold) as review,
      round(count(*) filter (reliability >= threshold) / count(*)::double, 3) as coverage, any_value(threshold) as threshold, any_value(target_risk) as target_risk, 'word_prob' as estimator
      from rl where threshold is not null group by 1, 2""",
    "review_words": f"""{_RELIABLE}, v as (select utt_id, trim(word) as word, row_number() over (partition by utt_id order by seg_id, pos) as k, count(*) over (partition by utt_id) as n from rl where reliability < threshold)
      select utt_id, greatest(max(n) - 12, 0)::int as more, string_agg(word, ' ' order by k) filter (k <= 12) as words from v group by 1""",
    "transcript_assembly": f"{_GATED} select utt_id, trim(string_agg(trim(text), ' ' order by seg_id)) as text, count(*) as n_segments, count(*) filter (flagged) as flagged_segments from ga group by 1",
    "warnings": f"""{_GATED}, a as (select utt_id as n, count(*) as s, count(*) filter (flagged) as f from ga group by 1),
      w as (select n, list_filter([
        case when n % 11 = 0 then 'denoiser_missing' end,
        case when (n % 9) / 2::double > 3 and (n % 10) / 20::double < 0.25 then 'little_speech=' || format('{{:.2f}}', (n % 10) / 20::double) end,
        case when (n % 9) / 2::double < 2 then 'short_clip=' || format('{{:.2f}}', (n % 9) / 2::double) end,
        case when n % 3 = 0 and not n % 6 = 0 then 'language_uncertain' end,
        case when f / s::double > 0.4::double then 'flagged_segments=' || f || '/' || s end,
        case when n % 8 = 0 then 'noise_unknown' end,
        case when n % 7 = 0 then 'words_missing' end], lambda x: x is not null) as ws from a)
      select n as utt_id, unnest(range(len(ws)))::int as place, unnest(ws) as warning from w""",
    "segment_records": f"""{_GATED} select utt_id, seg_id as id, format('{{:02d}}:{{:05.2f}}', floor("start" / 60)::int, "start" - floor("start" / 60) * 60) as clock, round("start", 2) as "start", round("end", 2) as "end",
      round(avg_logprob, 3) as avg_logprob, round(no_speech_prob, 3) as no_speech_prob, round(confidence, 3) as confidence, flagged, len(ws)::int as n_words from ga""",
    "forced_language": f"""with g as (select doc_id as utt_id, case when doc_id % 7 = 0 then 'xx' else lang end as code from documents where doc_id % 3 <> 0), nm(code, name) as (values {_NAMES})
      select utt_id, g.code, coalesce(name, g.code) as name, 1::double as probability, false as low_confidence, 'forced' as method from g left join nm on g.code = nm.code""",
    "language_hits": "select source, count(*) filter (lang = case when doc_id % 10 = 0 then 'en' else lang end) as hits, count(*) as total from documents group by 1",
    "speed_table": """with r as (select source as model, sum(n_chars) / 1000::double as elapsed_s, count(*) * 10::double as duration_s from documents group by 1)
      select model, round(elapsed_s, 6) as elapsed_s, duration_s, round(elapsed_s / duration_s, 6) as rtf, round(1 / (elapsed_s / duration_s), 6) as times_realtime from r""",
}
