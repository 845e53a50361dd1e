"""Canonical tables bound to the driver's tables, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sonora.functions.distributions import log_softmax

#: The rate at which four samples of the bound signal make a frame.
RATE = 134


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on their order."""
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def _share(value: Column, of: int) -> Column:
    return value.cast("double") / F.lit(float(of))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "lang", "n_chars").join(labels.select("doc_id", "quality"), "doc_id")
    score = F.floor(F.least("n_chars", F.lit(20000)) / F.lit(200.0)) / F.lit(100.0)
    return joined.select(F.col("lang").alias("condition"), F.col("doc_id").alias("seq"), score.alias("score"), (F.col("quality") == 1).alias("correct"))


SCORED = """sc as (
  select d.lang as condition, d.doc_id as seq, floor(least(d.n_chars, 20000) / 200::double) / 100::double as score, l.quality = 1 as correct
  from documents d join labels l using (doc_id))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    words = F.split("text", r"\s+", -1)
    prob = lambda w, i: _share((F.col("conv_id") * 31 + F.col("turn") * 17 + i * 7 + F.length(w) * 13) % 1000, 999)
    start = F.col("turn") * F.lit(10.0)
    return turns.select(
        F.col("conv_id").alias("utt_id"),
        F.col("turn").alias("seg_id"),
        start.alias("start"),
        (start + 4).alias("end"),
        "text",
        (-_share((F.col("conv_id") * 7 + F.col("turn") * 11) % 40, 80)).alias("avg_logprob"),
        _share((F.col("conv_id") * 13 + F.col("turn") * 29) % 100, 150).alias("no_speech_prob"),
        F.transform(words, lambda w, i: F.struct(w.alias("word"), start.alias("start"), (start + 1).alias("end"), prob(w, i).alias("prob"))).alias("words"),
    )


SEGMENTS = r"""sg as (
  select conv_id as utt_id, turn as seg_id, turn * 10::double as start, turn * 10::double + 4 as "end", text,
    -(((conv_id * 7 + turn * 11) % 40)::double / 80::double) as avg_logprob, ((conv_id * 13 + turn * 29) % 100)::double / 150::double as no_speech_prob,
    regexp_split_to_array(text, '\s+') as ws from conversations)"""
WORDS = """wd as (
  select *, ((utt_id * 31 + seg_id * 17 + pos * 7 + length(word) * 13) % 1000)::double / 999::double as prob
  from (select utt_id, seg_id, avg_logprob, no_speech_prob, least(1, exp(avg_logprob)) as confidence, unnest(ws) as word, unnest(range(len(ws))) as pos from sg))"""


def spoilt(text: Column) -> Column:
    """A hypothesis made of a text: of its words every seventh is left out, others replaced or doubled."""
    words = F.split(text, r"\s+", -1)
    made = F.transform(
        words,
        lambda w, i: F.when(i % 7 == 0, F.array().cast("array<string>")).when(i % 11 == 0, F.array(F.lit("zq"))).when(i % 13 == 0, F.array(w, w)).otherwise(F.array(w)),
    )
    return F.array_join(F.flatten(made), " ")


#: The same in SQL, of a column text.
SPOILT = r"""array_to_string(flatten(list_transform(regexp_split_to_array(text, '\s+'), lambda w, i: case when (i - 1) % 7 = 0 then [] when (i - 1) % 11 = 0 then ['zq']
  when (i - 1) % 13 = 0 then [w, w] else [w] end)), ' ')"""


def normal_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the log softmax of each vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", log_softmax(F.col("embedding")).alias("lp"))


DISTRIBUTIONS = """lx as (select vec_id, label, unnest(range(len(embedding))) as idx, unnest(embedding)::double as x, len(embedding) as size from embeddings),
lp as (select vec_id, label, idx, size, x - m - ln(sum(exp(x - m)) over (partition by vec_id)) as lp from (select *, max(x) over (partition by vec_id) as m from lx))"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, i and y: each user's event values in order of time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return events.select(F.col("user_id").alias("utt_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("y"))


SIGNAL = "si as (select user_id as utt_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as y from events)"

#: Policies for the bound words: (condition, target risk, threshold, knots).
POLICIES = (
    ("clean", 0.02, 0.9, ((0.05, 0.4), (0.3, 0.7), (0.6, 0.68), (0.95, 0.99))),
    ("10", 0.02, 0.8, ((0.1, 0.2), (0.5, 0.6), (0.9, 0.95))),
    ("0", 0.02, 1.1, ((0.2, 0.3), (0.8, 0.7))),
)
LEVELS = ("clean", "20", "10", "5", "0", "-5")


def policies(spark: SparkSession) -> DataFrame:
    rows = [(c, 100, [{"x": x, "y": y} for x, y in knots], threshold, risk, 0.0, 0.0, "") for c, risk, threshold, knots in POLICIES]
    return spark.createDataFrame(rows, "condition string, n_fit long, knots array<struct<x:double,y:double>>, threshold double, target_risk double, coverage double, realized_risk double, notes string")


POLICIES_SQL = (
    "po(condition, target_risk, threshold) as (values " + ", ".join(f"('{c}', {r}::double, {t}::double)" for c, r, t, _ in POLICIES) + "),\n"
    "kn as (select *, lead(x) over w as x1, lead(y) over w as y1, row_number() over w = 1 as first from (values "
    + ", ".join(f"('{c}', {x}::double, {y}::double)" for c, _, _, k in POLICIES for x, y in k)
    + ") v(condition, x, y) window w as (partition by condition order by x))"
)


def predict_sql(score: str, condition: str) -> str:
    """The calibrated score, by a lookup in kn."""
    return f"""(select case when {score} <= min(x) then min_by(y, x) when {score} >= max(x) then max_by(y, x)
      else max(case when x <= {score} and {score} < x1 then y + (y1 - y) * ({score} - x) / (x1 - x) end) end from kn where kn.condition = {condition})"""


def condition_of(utt: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in ("clean", "10", "0", "none")]), (utt % 4 + 1).cast("int"))


CONDITION = "(['clean', '10', '0', 'none'])[utt_id % 4 + 1]"
