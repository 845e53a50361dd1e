import zlib

import numpy as np

from sonora.llm import language_id as L

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_buckets_of_slices_equal_those_of_the_whole(monkeypatch):
    text = "Straße überall  und\nnirgends " * 40
    whole = np.sort(np.concatenate(list(L.buckets(text))))
    monkeypatch.setattr(L, "SLICE", 64)
    assert (np.sort(np.concatenate(list(L.buckets(text)))) == whole).all()
    raw = L._clean(text)
    assert len(whole) == sum(len(raw) - n + 1 for n in L.GRAMS)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(DOCS)
    model = L.fit(docs)
    rows = L.identify(docs, model).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert L.accepted(docs, model).count() > 0.98 * len(rows)
    assert L.identify(docs, L.fit(docs)).exceptAll(L.identify(docs, model)).count() == 0


def test_edges(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "s") for i in range(40)] + [(100 + i, "der hund und die katze " * 3, "de", "s") for i in range(40)]
    odd = [(200, None, "en", "s"), (201, "", "en", "s"), (202, "123 !!", None, "s"), (203, "the dog" * 100000, None, None), (None, "und die katze", "de", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as lang_pred", "1 as score")
    model = L.fit(docs)
    out = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [out[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3
    assert out[203].lang_pred == "en" and out[None].lang_pred == "de" and out[None].held_out is False
    kept = {r.doc_id for r in L.accepted(docs, model).collect()}
    assert not kept & {200, 201, 202}
    none = L.fit(docs.filter("doc_id < 0"))
    assert none.languages == [] and L.identify(docs, none).filter("lang_pred <> 'und'").count() == 0
    assert L.identify(docs.limit(0), none).count() == 0
