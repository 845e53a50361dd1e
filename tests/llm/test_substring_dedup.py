import random
import re

import numpy as np

from sonora.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_offsets_of_units():
    rng = random.Random(2)
    text = " ".join(rng.choice(("été", "Straße", "plain", "日本", "x")) + rng.choice(("", "\n", " \t")) for _ in range(500))
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts, ends = {s for s, _ in words}, {e for _, e in words}
    high, low, start, end = S.units(text)
    assert len(high) > 60 and set(start.tolist()) <= starts and set(end.tolist()) <= ends
    by = {}
    for h, l, s, e in zip(high, low, start, end, strict=True):
        key = " ".join(WORD.findall(text[s:e])).lower()
        assert by.setdefault((h, l), key) == key
    assert len(set(by.values())) == len(by)


def test_every_shared_passage_is_found():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    for _ in range(300):
        passage = rng.choices(words, k=51)
        a, b = (" ".join(rng.choices(words, k=rng.randrange(80)) + passage + rng.choices(words, k=rng.randrange(80))) for _ in range(2))
        x, y = ({(int(h), int(l)) for h, l in zip(*S.units(t)[:2], strict=True)} for t in (a, b))
        assert x & y


def brute(rows):
    """For each (id, text): the code points inside runs of over 50 words that an earlier place has."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]
        for k in range(len(found) - 50):
            key = tuple(w for w, _, _ in found[k : k + 51])
            if seen.setdefault(key, (doc_id, k)) != (doc_id, k):
                out.setdefault(doc_id, []).append((found[k][1], found[k + 50][2]))
    return out


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    text = dict(rows)
    spans = {}
    for r in S.report(df).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
        head = WORD.findall(text[r.doc_id][r.start :].lower())[: S.UNIT]
        assert WORD.findall(text[r.first_doc_id][r.first_start :].lower())[: S.UNIT] == head
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start)
    runs = brute(rows)
    assert len(runs) > 20
    for doc_id, own in runs.items():
        for start, end in own:  # every run of 51 words that repeats has its middle in a removed span
            assert any(s < end and start < e for s, e in spans[doc_id])
    unit = S.UNIT
    for doc_id in set(spans) - set(runs):  # what else is removed repeats too, in 39 words or more
        for s, e in spans[doc_id]:
            assert len(WORD.findall(text[doc_id][s:e])) >= unit


def test_cleaned_and_edges(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.random()}" for _ in range(60))
    line = " ".join(f"q{i}" for i in range(45))
    rows = [(1, "one " + passage + " end"), (2, "zwei é " + passage.upper().replace("P0", "p0") + "\nAnd more"), (3, None), (4, ""), (5, line + "\nx"), (6, "x\n" + line + "\ny"), (None, passage), (7, "same words " * 20000), (8, passage), (8, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as high", "3 as first")
    spans = S.report(df).collect()
    assert {r.doc_id for r in spans} == {None, 2, 6, 7, 8}
    out = {r.doc_id: r for r in S.cleaned(df).collect()}
    assert out[1].text == rows[0][1] and out[1].removed_spans is None
    assert out[6].text == "x\n\ny" and [tuple(s) for s in out[6].removed_spans] == [(2, 2 + len(line))]
    assert out[2].text.startswith("zwei é ") and out[2].text.endswith("\nAnd more") and len(out[2].text) < 400
    assert S.cleaned(df).columns == [*df.columns, "removed_spans"]
    assert S.report(df.limit(0)).count() == 0 and S.cleaned(df.limit(0)).count() == 0


def test_repeated_runs_go_whole(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(n) for n in (51, 52, 55, 60, 61, 75, 130)]
    rows = [(10 * k + i, " ".join(words(30) + p + words(20))) for k, p in enumerate(passages) for i in range(3)]
    for k, p in enumerate(passages):  # an earlier document has less of it, from either side; one document has it twice
        rows += [(-10 * k - 1, " ".join(words(5) + p[6:45] + words(9))), (200 + k, " ".join(words(5) + p + words(9) + p + words(3)))]
    # a text whose unit also stands earlier in it, in other surroundings
    rows += [(-100, " ".join(passages[3])), (300, " ".join(words(7) + passages[3][9:55] + words(60) + passages[3] + words(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for docs in (df, sample):
        spans = {}
        for r in S.report(docs).collect():
            spans.setdefault(r.doc_id, []).append((r.start, r.end))
        rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
        seen, runs = {}, {}
        for doc_id, text in rows:  # as brute(), but only A-Z lower-cased
            found = [(m.group().encode().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
            for k in range(len(found) - 50):
                key = tuple(w for w, _, _ in found[k : k + 51])
                if seen.setdefault(key, (doc_id, k)) != (doc_id, k):
                    runs.setdefault(doc_id, []).append((found[k][1], found[k + 50][2]))
        assert len(runs) > 20
        left = [(doc_id, s, e) for doc_id, own in runs.items() for s, e in own if not any(a <= s and e <= b for a, b in spans.get(doc_id, ()))]
        assert not left
