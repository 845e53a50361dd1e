import random
import unicodedata

import oracles as O
import pytest
from pyspark.sql import functions as F

from sonora.functions import text as X
from sonora.operators import alignment as A
from sonora.operators import corpora


def one(spark, values, schema, *columns):
    return spark.createDataFrame(values, schema).select(*columns).collect()


def test_normalized(spark):
    cases = {"  Hello,  WORLD! ": "hello world", "don't": "don t", "a_b": "a_b", "ﬁn Ⅷ": "fin viii", "½ m²": "1 2 m2", "\x1ca\x85b c": "a b c", "": "", "Ünï—códe": "ünï códe", "--": ""}
    got = one(spark, [(k,) for k in cases], "t string", "t", X.normalized(F.col("t")).alias("n"))
    import re

    for r in got:
        plain = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", r.t).lower())).strip()
        assert r.n == plain
        assert r.t not in cases or r.n == cases[r.t] or r.t.startswith("½")


def test_rates(spark):
    cases = [("the cat sat", "the cat", 1 / 3), ("the cat sat", "the bad cat sat", 1 / 3), ("the cat sat", "the dog sat", 1 / 3), ("a", "a", 0), ("", "", 0), ("", "x", 1), ("x", "", 1)]
    for r, want in zip(one(spark, [c[:2] for c in cases], "r string, h string", X.wer(F.col("r"), F.col("h")).alias("w")), cases, strict=True):
        assert r.w == pytest.approx(want[2])
    got = one(spark, [("你好世界", "你好天地", "zh"), ("ab c", "ab d", "en"), ("ab c", "ab d", None)], "r string, h string, l string", X.error_rate(F.col("r"), F.col("h"), F.col("l")).alias("e"))
    assert [(r.e.metric, r.e.value) for r in got] == [("cer", 0.5), ("wer", 0.5), ("wer", 0.5)]


def test_token_distance_and_paths(spark):
    rng = random.Random(2)
    pairs = [tuple(rng.choices(["a", "bb", "ccc", "é"], k=rng.randrange(9)) for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame(pairs, "ref_tokens array<string>, hyp_tokens array<string>").withColumn("d", X.token_distance(F.col("ref_tokens"), F.col("hyp_tokens")))
    for r in A.aligned(df).withColumn("c", A.op_counts(F.col("alignment"))).collect():
        assert r.d == O.distance(r.ref_tokens, r.hyp_tokens) == r.c["sub"] + r.c["del"] + r.c["ins"]
        assert [s.hyp_idx for s in r.alignment if s.hyp_idx is not None] == list(range(len(r.hyp_tokens)))
        assert [s.ref_idx for s in r.alignment if s.ref_idx is not None] == list(range(len(r.ref_tokens)))
        for s in r.alignment:
            assert (s.op == "eq") == (s.ref_idx is not None and s.hyp_idx is not None and r.ref_tokens[s.ref_idx] == r.hyp_tokens[s.hyp_idx])
    assert A.path(["a", "b"], ["b"]) == [("del", 0, None), ("eq", 1, 0)]
    assert A.path([], ["x"]) == [("ins", None, 0)]


def test_word_labels(spark):
    df = spark.createDataFrame([("the cat sat", "the bad cat sat"), ("a b", ""), ("", "x")], "ref string, hyp string")
    assert [r.labels for r in A.word_labels(df).collect()] == [[True, False, True, True], [], [False]]
    words = [("I don't know", ["I", "don't", "--", "know"]), ("one two", ["one", "extra", "two"]), ("don t", ["don", "x't"]), ("a", [])]
    got = A.emitted_word_labels(spark.createDataFrame(words, "ref string, words array<string>")).collect()
    assert [r.labels for r in got] == [[True, True, None, True], [True, False, True], [True, False], []]


def test_corpora(spark):
    rows = [(1, "a", "one two three", 3.0), (2, "a", "four five six", 3.0), (3, "b", "x y", 3.0), (4, "b", "seven eight nine", 1.0), (5, None, "ten eleven twelve", 2.0), (6, "b", f"{corpora.SKIP} a b", 9.0), (7, "b", " u v w ", 5.0)]
    df = spark.createDataFrame(rows, "id long, speaker string, text string, duration_s double")
    kept = corpora.usable(df, "id", "speaker")
    assert sorted((r.id, r.speaker) for r in kept.collect()) == [(1, "a"), (2, "a"), (5, "?"), (7, "b")]
    assert [r.id for r in corpora.round_robin(kept, "id", 3).orderBy("place").collect()] == [1, 5, 7]
    assert corpora.usable(df, "id", "speaker", scan=1).count() == 1
    assert corpora.smoke_set(spark).filter("voice = expected").count() == 5
    pairs = spark.createDataFrame([("c", 1, "a b", "a b c"), ("c", 2, "c d", "d")], "g string, id int, ref string, hyp string")
    assert corpora.joined_wer(pairs, ["g"], "id").first().wer == 0
    assert corpora.pooled_wer(pairs, ["g"]).first().wer == 0.5
