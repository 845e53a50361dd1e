"""Queries of text normalisation, error rates and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.functions import text as X
from sonora.operators import alignment as A
from sonora.operators import corpora
from sonora.plans import bindings as B


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = B.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.col("text").alias("ref"), B.spoilt(F.col("text")).alias("hyp"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.col("text").alias("ref"), B.spoilt(F.col("text")).alias("hyp"))


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.normalized(F.col(c)) for c in ("ref", "hyp")})


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", X.normalized(F.col("text")).alias("normal"))


def wer_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(_normal(_turns(spark, sf_dir)).select("conv_id", "turn", X.wer(F.col("ref"), F.col("hyp")).alias("wer")))


def cer_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(_normal(_items(spark, sf_dir)).select("item_id", X.cer(F.col("ref"), F.col("hyp")).alias("cer")))


def error_rate_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.element_at(F.array(*[F.lit(c) for c in ("en", "ja", "de", "yue")]), (F.col("item_id") % 4 + 1).cast("int"))
    rate = X.error_rate(F.col("ref"), F.col("hyp"), language)
    return B.rounded(_normal(_items(spark, sf_dir)).select("item_id", language.alias("language"), rate["metric"].alias("metric"), rate["value"].alias("value")))


def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("condition", F.col("item_id") % 4)
    return B.rounded(corpora.joined_wer(items, ["condition"], "item_id"))


def pooled_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(corpora.pooled_wer(_turns(spark, sf_dir).withColumn("condition", F.col("conv_id") % 6), ["condition"]))


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = A.word_labels(_turns(spark, sf_dir))
    return labelled.select("conv_id", "turn", F.posexplode("labels").alias("pos", "correct"))


def emitted_word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("words", F.split("hyp", " "))
    labelled = A.emitted_word_labels(turns)
    return labelled.select("conv_id", "turn", F.posexplode("labels").alias("pos", "correct"))


def alignment_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _normal(_turns(spark, sf_dir)).withColumns({"ref_tokens": X.tokens(F.col("ref")), "hyp_tokens": X.tokens(F.col("hyp"))})
    counts = A.op_counts(F.col("alignment"))
    return A.aligned(split).select("conv_id", "turn", counts.alias("c")).select("conv_id", "turn", "c.*")


def speaker_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = B.table(spark, sf_dir, "documents")
    arrived = documents.select("doc_id", F.col("source").alias("speaker"), "text", (F.col("n_chars") / 15.0).alias("duration_s"))
    return corpora.round_robin(corpora.usable(arrived, "doc_id", "speaker"), "doc_id", limit=60).select("doc_id", "speaker", "place")


def joined_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt_id"), F.col("embedding").alias("samples"), F.concat(F.lit("item "), "label").alias("reference"))
    made = corpora.joined_clip(clips, "utt_id", 3)
    return B.rounded(made.select("reference", F.size("samples").alias("n_samples"), F.aggregate("samples", F.lit(0.0), lambda acc, v: acc + v).alias("total")), 4)


QUERIES = {
    "normalize_text": normalize_text,
    "wer_by_turn": wer_by_turn,
    "cer_by_item": cer_by_item,
    "error_rate_dispatch": error_rate_dispatch,
    "corpus_wer": corpus_wer,
    "pooled_wer": pooled_wer,
    "word_labels": word_labels,
    "emitted_word_labels": emitted_word_labels,
    "alignment_op_counts": alignment_op_counts,
    "speaker_round_robin": speaker_round_robin,
    "joined_clip": joined_clip,
}


def _distance(pairs: str) -> str:
    """Edit distances of (id, r, h) lists: a row of the matrix a step, insertions as a running minimum."""
    return f"""with recursive pr as materialized ({pairs}),
rt as materialized (select id, unnest(range(1, len(r) + 1)) as i, unnest(r) as token from pr), ht as materialized (select id, unnest(range(1, len(h) + 1)) as k, unnest(h) as token from pr),
st(id, i, k, v) as (
  select id, 0::bigint, unnest(range(0, len(h) + 1)), unnest(range(0, len(h) + 1)) from pr
  union all
  select id, i, k, min(a - k) over (partition by id order by k rows unbounded preceding) + k from (
    select st.id, st.i + 1 as i, st.k, case when st.k = 0 then st.i + 1 else least(st.v + 1, lag(st.v) over (partition by st.id order by st.k) + (rt.token <> ht.token)::int) end as a
    from st join rt on rt.id = st.id and rt.i = st.i + 1 left join ht on ht.id = st.id and ht.k = st.k)),
lev as (select pr.*, st.v as d, case when len(r) = 0 then (len(h) > 0)::int::double else st.v / len(r)::double end as rate from st join pr using (id) where st.i = len(r) and st.k = len(h))"""


#: The path through the matrix of _distance(), from its end: a diagonal step where one is optimal, else a deletion, else an insertion.
_PATH = """,
mx as materialized (
  select s.id, s.i, s.k, rt.token = ht.token as same,
    case when s.i > 0 and s.k > 0 and s.v = lag(s.v) over (partition by s.id, s.i - s.k order by s.i) + (rt.token <> ht.token)::int then 'diagonal'
      when s.i > 0 and s.v = lag(s.v) over (partition by s.id, s.k order by s.i) + 1 then 'up' else 'left' end as dir
  from st s left join rt on rt.id = s.id and rt.i = s.i left join ht on ht.id = s.id and ht.k = s.k),
wk(id, i, k) as (
  select id, len(r)::bigint, len(h)::bigint from pr
  union all select id, i - (dir <> 'left')::int, k - (dir <> 'up')::int from wk join mx using (id, i, k) where i > 0 or k > 0),
al as (
  select id, i, k, case dir when 'up' then 'del' when 'left' then 'ins' else case when same then 'eq' else 'sub' end end as op
  from wk join mx using (id, i, k) where i > 0 or k > 0)"""


def _words(text: str) -> str:
    return f"case when {B.normal_sql(text)} = '' then [] else string_split({B.normal_sql(text)}, ' ') end"


def _letters(text: str) -> str:
    return f"regexp_extract_all(replace({B.normal_sql(text)}, ' ', ''), '.')"


_TURNS = f"select conv_id, turn, conv_id * 1000 + turn as id, {_words('text')} as r, {_words(B.SPOILT)} as h from conversations"
_EMITTED = f"""select *, flatten(own) as h from (
  select conv_id, turn, conv_id * 1000 + turn as id, {_words('text')} as r, list_transform(string_split({B.SPOILT}, ' '), lambda e: {_words('e')}) as own from conversations)"""
_LANG = "(['en', 'ja', 'de', 'yue'])[item_id % 4 + 1]"

ORACLE_SQL = {
    "normalize_text": f"select doc_id, {B.normal_sql('text')} as normal from documents",
    "wer_by_turn": _distance(_TURNS) + " select conv_id, turn, round(rate, 6) as wer from lev",
    "cer_by_item": _distance(f"select item_id as id, {_letters('text')} as r, {_letters(B.SPOILT)} as h from benchmark") + " select id as item_id, round(rate, 6) as cer from lev",
    "error_rate_dispatch": _distance(
        f"select item_id as id, {_LANG} as language, case when {_LANG} in ('ja', 'yue') then {_letters('text')} else {_words('text')} end as r,"
        f" case when {_LANG} in ('ja', 'yue') then {_letters(B.SPOILT)} else {_words(B.SPOILT)} end as h from benchmark"
    )
    + " select id as item_id, language, case when language in ('ja', 'yue') then 'cer' else 'wer' end as metric, round(rate, 6) as value from lev",
    "corpus_wer": _distance(
        f"select item_id % 4 as id, {_words('string_agg(text, chr(32) order by item_id)')} as r, {_words('string_agg(hyp, chr(32) order by item_id)')} as h"
        f" from (select item_id, text, {B.SPOILT} as hyp from benchmark) group by item_id % 4"
    )
    + " select id as condition, round(rate, 6) as wer from lev",
    "pooled_wer": _distance(_TURNS) + " select conv_id % 6 as condition, sum(d)::bigint as errors, sum(len(r))::bigint as words, round(sum(d) / sum(len(r))::double, 6) as wer from lev group by 1",
    "alignment_op_counts": _distance(_TURNS) + _PATH + """ select conv_id, turn, count(*) filter (op = 'eq')::int as eq, count(*) filter (op = 'sub')::int as sub,
      count(*) filter (op = 'del')::int as del, count(*) filter (op = 'ins')::int as ins from pr left join al using (id) group by conv_id, turn""",
    "word_labels": _distance(_TURNS) + _PATH + " select conv_id, turn, (k - 1)::int as pos, op = 'eq' as correct from al join pr using (id) where op <> 'del'",
    "emitted_word_labels": _distance(_EMITTED) + _PATH + """,
      ow as (select id, conv_id, turn, unnest(range(len(own))) as pos, unnest(own) as tokens from pr),
      sp as (select *, sum(len(tokens)) over (partition by id order by pos) as last from ow)
      select conv_id, turn, pos::int as pos, (select bool_and(op = 'eq') from al where al.id = sp.id and op <> 'del' and k > last - len(tokens) and k <= last) as correct from sp""",
    "speaker_round_robin": """with a as (
        select doc_id, coalesce(source, '?') as speaker, n_chars / 15::double as s, trim(text) as t, row_number() over (order by doc_id) as seen from documents),
      u as (select doc_id, speaker from a where seen <= 4000 and t <> '' and not contains(t, 'IGNORE_TIME_SEGMENT_IN_SCORING') and len(regexp_extract_all(t, '\\S+')) >= 3 and s >= 2),
      r as (select *, row_number() over (partition by speaker order by doc_id) as turn, min(doc_id) over (partition by speaker) as arrived from u)
      select doc_id, speaker, row_number() over (order by turn, arrived) as place from r qualify place <= 60""".replace("\\\\", "\\"),
    "joined_clip": """with f as (select * from embeddings order by vec_id limit 3)
      select string_agg('item ' || label, ' ' order by vec_id) as reference, sum(len(embedding))::int as n_samples, round(sum(list_sum(list_transform(embedding, lambda x: x::double))), 4) as total from f""",
}
