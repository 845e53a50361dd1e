"""Queries of distributions, language votes, voice activity, noise estimates and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.functions import distributions as D
from sonora.operators import language as L
from sonora.operators import signal as S
from sonora.operators import voice as V
from sonora.plans import bindings as B

BY = ["utt_id"]


def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(B.distributions(spark, sf_dir).select("vec_id", F.posexplode("lp").alias("idx", "lp")))


def _entropy(column):
    return lambda spark, sf_dir: B.rounded(B.distributions(spark, sf_dir).select("vec_id", column(F.col("lp")).alias("value")))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.distributions(spark, sf_dir).select(F.col("label").alias("utt_id"), F.col("vec_id").alias("chunk"), F.posexplode("lp").alias("idx", "lp"))
    return rows.select("utt_id", "chunk", F.concat(F.lit("l"), "idx").alias("lang"), F.exp("lp").alias("p"))


def fuse_language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(L.fused(_votes(spark, sf_dir), BY))


def language_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = B.table(spark, sf_dir, "embeddings").select(F.col("label").alias("utt_id")).distinct().withColumn("speech_s", F.col("utt_id") * F.lit(0.5))
    found = L.detected(_votes(spark, sf_dir), speech, BY)
    top = found.select("utt_id", "code", "probability", "entropy", "chunks_used", "low_confidence", F.posexplode("top").alias("place", "t"))
    return B.rounded(top.select("utt_id", "code", "probability", "entropy", "chunks_used", "low_confidence", "place", F.col("t.code").alias("alternative"), F.col("t.p").alias("p")))


def lid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = B.table(spark, sf_dir, "conversations")
    begin = F.col("turn") * F.lit(10.0) + (F.col("conv_id") % 7)
    spans = F.array_sort(F.collect_list(F.struct(begin.alias("start"), (begin + 4).alias("end"))))
    clips = turns.groupBy("conv_id").agg(spans.alias("spans"), (F.max("turn") * 160000 + 50000).alias("n"))
    spans = F.when(F.col("conv_id") % 5 != 0, F.col("spans"))
    return clips.select("conv_id", F.posexplode(L.windows(F.col("n"), F.lit(16000), spans)).alias("place", "w")).select("conv_id", "place", "w.start", "w.end")


def energy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(V.frame_energies(B.signal(spark, sf_dir), BY, 4))


def energy_vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(V.energy_segments(B.signal(spark, sf_dir), BY, B.RATE))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping spans and a later one for each user."""
    users = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("utt_id")).distinct()
    shift = (F.col("utt_id") % 10) / F.lit(50.0)
    spans = F.array(*[F.struct((F.lit(a) + shift).alias("start"), (F.lit(b) + shift).alias("end")) for a, b in ((0.0, 0.3), (0.2, 0.45), (0.66, 0.7))])
    return users.select("utt_id", F.explode(spans).alias("s")).select("utt_id", "s.start", "s.end")


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(V.merged(_spans(spark, sf_dir), BY))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.signal(spark, sf_dir).groupBy("utt_id").agg((F.count("*") / F.lit(float(B.RATE))).alias("duration_s"))


def speech_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(V.speech_ratio(_spans(spark, sf_dir), _durations(spark, sf_dir), BY))


def snr_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(V.snr(B.signal(spark, sf_dir), _spans(spark, sf_dir), BY, B.RATE))


def nearest_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 100) / F.lit(2.0) - 7.5).alias("snr_db"))
    levels = spark.createDataFrame([(c,) for c in B.LEVELS], "condition string")
    return V.nearest_condition(items, BY, levels)


def mel_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.mel_filters(spark))


def filterbank_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = S.filter_centers(spark)
    return B.rounded(scale.withColumn("mel_value", D.hz_to_mel(F.col("hz"))).withColumn("back", D.mel_to_hz(F.col("mel_value"))), 5)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as a clip, repeated to a second or so."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "y")))
    clips = B.signal(spark, sf_dir).groupBy("utt_id").agg(F.transform(ordered, lambda s: s.y.cast("float")).alias("part"))
    return clips.select("utt_id", F.flatten(F.array_repeat("part", F.ceil(F.lit(2000) / F.size("part")).cast("int"))).alias("samples"), F.lit(8000).alias("sample_rate"))


def peak_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = B.signal(spark, sf_dir).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("s"))
    scaled = scaled.select("utt_id", S.peak_normalized(F.transform("s", lambda v: v.y.cast("double"))).alias("x"))
    return B.rounded(scaled.select("utt_id", F.array_max(F.transform("x", lambda v: F.abs(v))).cast("double").alias("peak"), F.size("x").alias("n")), 4)


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resampled(_clips(spark, sf_dir)).select("utt_id", "sample_rate", F.size("samples").alias("n"))


def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.log_mel(_clips(spark, sf_dir), BY), 4)


#: Voices of the pool for babble at most, and samples of each.
POOL_VOICES, POOL_SAMPLES = 64, 16_000


def _voices(clips: DataFrame) -> list[list[float]]:
    """The first samples of the clips with the smallest POOL_VOICES hashes of utt_id; other clips' samples stay where they are."""
    ids = [r.utt_id for r in clips.select("utt_id").orderBy(F.xxhash64("utt_id"), "utt_id").limit(POOL_VOICES).collect()]
    chosen = clips.filter(F.col("utt_id").isin(ids)).select("utt_id", F.slice("samples", 1, POOL_SAMPLES).alias("samples"))
    return [r.samples for r in sorted(chosen.collect(), key=lambda r: r.utt_id)]


def noise_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that each mix reaches, against the level asked for. Babble is of voices taken from the clips."""
    level = F.element_at(F.array(F.lit(20.0), F.lit(5.0), F.lit(-5.0)), (F.col("utt_id") % 3 + 1).cast("int"))
    clean = _clips(spark, sf_dir).withColumn("snr_db", level)
    out, voices = None, _voices(clean)
    for kind in S.NOISES:
        mixed = S.mixed(clean.withColumn("clean", F.col("samples")), kind, pool=voices if kind == "babble" else None)
        power = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
        noise = F.zip_with("samples", "clean", lambda x, y: x.cast("double") - y)
        part = mixed.select("utt_id", F.lit(kind).alias("kind"), "snr_db", F.round(F.log10(power(F.col("clean")) / power(noise)) * 10, 2).alias("reached_db"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "log_softmax": log_softmax,
    "shannon_entropy": _entropy(D.shannon_entropy),
    "renyi_entropy": _entropy(D.renyi_entropy),
    "normalized_entropy": _entropy(D.normalized_entropy),
    "fuse_language_votes": fuse_language_votes,
    "language_topk": language_topk,
    "lid_windows": lid_windows,
    "energy_frames": energy_frames,
    "energy_vad_segments": energy_vad_segments,
    "merge_spans": merge_spans,
    "speech_ratio": speech_ratio,
    "snr_estimate": snr_estimate,
    "nearest_condition": nearest_condition,
    "mel_filterbank": mel_filterbank,
    "filterbank_centers": filterbank_centers,
    "peak_normalized": peak_normalized,
    "resample": resample,
    "log_mel": log_mel,
    "noise_mix": noise_mix,
}

_VOTES = f"""{B.DISTRIBUTIONS},
vt as (select label as utt_id, vec_id as chunk, 'l' || idx as lang, exp(lp) as p from lp),
fl as (select utt_id, lang, sum(ln(p + 1e-6)) + ((select count(distinct chunk) from vt v where v.utt_id = vt.utt_id) - count(*)) * ln(1e-6) as s, (select count(distinct chunk) from vt v where v.utt_id = vt.utt_id) as chunks
  from vt group by utt_id, lang),
fu as (select utt_id, lang, chunks, exp(s - max(s) over (partition by utt_id)) as e from fl),
fp as (select utt_id, lang, chunks, e / sum(e) over (partition by utt_id) as p from fu)"""
_FRAMES = f"""{B.SIGNAL},
fr as (select utt_id, i // 4 as idx, 20 * log10(sqrt(avg(y * y)) + 1e-10) as db from si group by 1, 2 having count(*) = 4)"""
_ISLANDS = """{name}c as (select *, case when "start" - max("end") over (partition by utt_id order by "start", "end" rows between unbounded preceding and 1 preceding) <= {gap} then 0 else 1 end as new from {source}),
{name}i as (select *, sum(new) over (partition by utt_id order by "start", "end" rows unbounded preceding) as island from {name}c),
{name} as (select utt_id, min("start") as "start", max("end") as "end" from {name}i group by utt_id, island)"""
_SPANS = """sp as (select utt_id, a + (utt_id % 10) / 50::double as "start", b + (utt_id % 10) / 50::double as "end"
  from (select distinct user_id as utt_id from events), (values (0.0::double, 0.3::double), (0.2::double, 0.45::double), (0.66::double, 0.7::double)) v(a, b))"""
_MEL = """m as (select 2595.0::double * log10(1 + 8000 / 700::double) as top),
pts as (select k, 700.0::double * (pow(10.0::double, top * k / 81 / 2595.0::double) - 1) as hz from range(82) r(k), m)"""

ORACLE_SQL = {
    "log_softmax": f"with {B.DISTRIBUTIONS} select vec_id, idx::int as idx, round(lp, 6) as lp from lp",
    "shannon_entropy": f"with {B.DISTRIBUTIONS} select vec_id, round(-sum(exp(lp) * lp) filter (lp > -700), 6) as value from lp group by 1",
    "renyi_entropy": f"with {B.DISTRIBUTIONS} select vec_id, round(ln(sum(exp(2 * lp)) filter (lp > -700)) / -1, 6) as value from lp group by 1",
    "normalized_entropy": f"with {B.DISTRIBUTIONS} select vec_id, round(greatest(0, least(1, 1 + sum(exp(lp) * lp) / ln(any_value(size)))), 6) as value from lp group by 1",
    "fuse_language_votes": f"with {_VOTES} select utt_id, lang, chunks, round(p, 6) as p from fp",
    "language_topk": f"""with {_VOTES},
      r as (select *, row_number() over (partition by utt_id order by p desc, lang) as place, -sum(p * ln(p)) over (partition by utt_id) as entropy from fp)
      select a.utt_id, a.lang as code, round(a.p, 6) as probability, round(a.entropy, 6) as entropy, a.chunks as chunks_used, a.p < 0.5 or a.utt_id * 0.5::double < 2 as low_confidence,
        (b.place - 1)::int as place, b.lang as alternative, round(b.p, 6) as p
      from r a join r b using (utt_id) where a.place = 1 and b.place <= 5""",
    "lid_windows": """with t as (select conv_id, turn, turn * 10::double + conv_id % 7 as s from conversations),
      c as (select conv_id, list(s order by s) as ss, max(turn) * 160000 + 50000 as n from t group by 1),
      a as (select conv_id, n, case when conv_id % 5 <> 0 then [ss[1], ss[len(ss) // 2 + 1], greatest(0, ss[-1] + 4 - 30)]
        else [0, greatest(0, n / 16000::double / 2 - 15), greatest(0, n / 16000::double - 30)] end as anchors from c),
      b as (select conv_id, n, k, least(greatest(0, trunc(anchors[k] * 16000)::bigint), greatest(0, n - 480000)) as "start" from a, (values (1), (2), (3)) v(k)),
      d as (select conv_id, n, "start", min(k) as k from b group by all)
      select conv_id, (row_number() over (partition by conv_id order by k) - 1)::int as place, "start", least("start" + 480000, n) as "end" from d""",
    "energy_frames": f"with {_FRAMES} select utt_id, idx, round(db, 6) as db from fr",
    "energy_vad_segments": f"""with {_FRAMES},
      th as (select utt_id, greatest(max(db) - 30, quantile_cont(db, 0.2) + 8) as t, count(*) as n from fr group by 1),
      ac as (select utt_id, idx, n from fr join th using (utt_id) where db > t),
      ar as (select *, case when idx - lag(idx) over (partition by utt_id order by idx) <= 5 then 0 else 1 end as new from ac),
      ai as (select *, sum(new) over (partition by utt_id order by idx rows unbounded preceding) as island from ar),
      ab as (select utt_id, min(idx) as f, max(idx) as l, max(n) as n from ai group by utt_id, island),
      raw as (select utt_id, f * (4 / {B.RATE}::double) as "start", case when n - 1 - l <= 4 then n else l + 1 end * (4 / {B.RATE}::double) as "end" from ab),
      {_ISLANDS.format(name="mg", source="raw", gap="0.2::double")}
      select utt_id, round("start", 6) as "start", round("end", 6) as "end" from mg where "end" - "start" >= 0.2::double""",
    "merge_spans": f"""with {_SPANS}, {_ISLANDS.format(name="mg", source="sp", gap="0.2::double")} select utt_id, round("start", 6) as "start", round("end", 6) as "end" from mg""",
    "speech_ratio": f"""with {_SPANS}, {B.SIGNAL}, du as (select utt_id, count(*) / {B.RATE}::double as duration_s from si group by 1),
      ss as (select utt_id, sum("end" - "start") as speech_s from sp group by 1)
      select utt_id, round(duration_s, 6) as duration_s, round(speech_s, 6) as speech_s, round(least(1, speech_s / duration_s), 6) as speech_ratio from du join ss using (utt_id)""",
    "snr_estimate": f"""with {_SPANS}, {B.SIGNAL}, {_ISLANDS.format(name="mg", source="sp", gap="0::double")},
      ma as (select si.utt_id, y, exists (select 1 from mg where mg.utt_id = si.utt_id and i >= trunc("start" * {B.RATE})::bigint and i < trunc("end" * {B.RATE})::bigint) as sp from si),
      st as (select utt_id, count(*) filter (sp) as a, count(*) filter (not sp) as b, avg(y * y) filter (sp) as pa, avg(y * y) filter (not sp) as pb from ma group by 1)
      select utt_id, case when a >= 0.3::double * {B.RATE} and b >= 0.2::double * {B.RATE} then
        round(case when pb <= 0 then 40 when pa - pb <= 0 then -40 else greatest(-40, least(40, 10 * log10((pa - pb) / pb))) end, 6) end as snr_db from st""",
    "nearest_condition": """with d as (select doc_id as utt_id, case when doc_id % 11 <> 0 then (doc_id % 100) / 2::double - 7.5::double end as snr_db from documents),
      l(condition, v) as (values ('clean', 40), ('20', 20), ('10', 10), ('5', 5), ('0', 0), ('-5', -5)),
      r as (select utt_id, snr_db, condition, row_number() over (partition by utt_id order by abs(v - snr_db), v) as k from d cross join l)
      select utt_id, snr_db, case when snr_db is not null then condition end as condition from r where k = 1""",
    "mel_filterbank": f"""with {_MEL}, f as (select a.k as mel, bin, a.hz as lo, b.hz as mid, c.hz as hi, bin * 40::double as f from pts a join pts b on b.k = a.k + 1 join pts c on c.k = a.k + 2, range(201) r(bin)),
      w as (select mel, bin::int as bin, greatest(0, least((f - lo) / greatest(mid - lo, 1e-9), (hi - f) / greatest(hi - mid, 1e-9))) * 2 / (hi - lo) as w from f)
      select mel, bin, round(w, 6) as w from w where w > 0""",
    "filterbank_centers": f"""with {_MEL} select k - 1 as mel, round(hz, 5) as hz, round(2595.0::double * log10(1 + hz / 700), 5) as mel_value, round(hz, 5) as back from pts where k between 1 and 80""",
    "peak_normalized": f"""with {B.SIGNAL} select utt_id, case when max(abs(y)) < 1e-8 then round(max(abs(y)), 4) else 0.95::double end as peak, count(*)::int as n from si group by 1""",
}
