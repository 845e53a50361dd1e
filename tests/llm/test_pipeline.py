from collections import Counter, defaultdict

import public_tokenizers
import test_line_dedup
import test_mixing
import test_near_duplicates
import test_packing

import corpus_pipeline
from sonora.llm import language_id, near_duplicates


def by_doc(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mixing", "best_fit_packing"]

    first = stages["language_id"](spark, docs, folder)
    model = language_id.fit(docs)
    assert first.columns == docs.columns
    assert by_doc(first) == [r for r in by_doc(docs) if model.accepts(r[1])]
    assert first.count() > 0.95 * docs.count()

    second = stages["line_dedup"](spark, first, folder)
    gone = defaultdict(set)
    for (_, doc_id, number), _ in test_line_dedup.brute([(r[0], r[1]) for r in by_doc(first)]):
        gone[doc_id].add(number)
    want = []
    for doc_id, text, lang, source, n_chars in by_doc(first):
        if gone[doc_id]:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc_id])
            if not text.split():
                continue
            n_chars = len(text)
        want.append((doc_id, text, lang, source, n_chars))
    assert by_doc(second) == want and second.columns == docs.columns

    third = stages["near_duplicates"](spark, second, folder)
    groups = test_near_duplicates.brute([(r[0], r[1]) for r in want], near_duplicates.DEFAULT)
    assert by_doc(third) == [r for r in want if groups[r[0]][0] == 0 or groups[r[0]][1] == r[0]]
    assert third.columns == docs.columns

    fourth = stages["source_mixing"](spark, third, folder)
    assert fourth.columns == docs.columns
    copies = Counter(r[0] for r in by_doc(fourth))
    texts = {r[0]: (r[1], r[3]) for r in by_doc(third)}
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for doc_id, (text, source) in texts.items():
        n = len(test_mixing.WORD.findall(text))
        sizes[source] += n
        taken[source] += n * copies[doc_id]
        longest[source] = max(longest[source], n)
    target = test_mixing.brute_targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] + 1 for s in sizes)

    last = stages["best_fit_packing"](spark, fourth, folder).collect()
    pieces = Counter(r.doc_id for r in last if r.piece == 0)
    assert pieces == copies
    ids = {i: len(test_packing.EXACT.encode(t, add_special_tokens=False).ids) + 1 for i, (t, _) in texts.items()}
    assert sum(r.length for r in last) == sum(ids[i] * n for i, n in copies.items())
    assert Counter((r.sequence_id, r.offset) for r in last).most_common(1)[0][1] == 1
    bins = len({r.sequence_id for r in last})
    assert bins <= -(-sum(r.length for r in last) // 2048) + 1
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_run_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns named like the stages' own."""
    good = [(i, " ".join(f"the word {j * 7 % 31} of document {i} and the others" for j in range(12)), "en", f"s{i % 3}", 10) for i in range(60)]
    odd = [
        (100, None, "en", "s0", None), (None, good[3][1] + " tail", "en", None, 5), (101, "", None, "s1", 0), (102, "the same " * 60000, "en", None, 1), (103, "?!", "en", "s1", 2),
        (104, good[5][1], None, "s2", 7), (104, good[5][1], None, "s2", 7), (104, "another text under the id of one that is there", "en", "s2", 7), (None, None, None, None, None),
    ]
    extra = {c: "x" for c in ("row", "gone", "node", "copies", "hash", "size", "key", "bucket", "Doc_text", "place")}
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(v) for c, v in extra.items()})
    stages = corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        docs = stage(spark, docs, None)
        assert len(docs.columns) == 15, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 40
    ids = [r.doc_id for r in docs.collect()]
    assert 100 not in ids and 103 not in ids and 102 in ids
    packed = stages[-1][1](spark, docs, None)
    assert packed.filter("piece = 0").count() == len(ids)
    for _, stage in stages:
        assert stage(spark, docs.limit(0), None).count() == 0
