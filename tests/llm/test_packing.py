import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonora.llm import packing as P

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def exact():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_ids_are_those_of_tokenizers(text):
    global ENCODER, EXACT
    assert ENCODER.ids(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids


ENCODER, EXACT = P.Encoder(VOCABULARY), exact()


def test_ids_of_every_low_code_point_and_others():
    texts = [f(chr(c)) for c in range(0x250) for f in (str, lambda x: " " + x, lambda x: f"a{x}b{x}", lambda x: x * 3 + " ", lambda x: f"\n{x}\n1{x}")]
    texts += ["<|endoftext|> x", "日本語 テキスト", "a b", "😀😀", ""]
    for text, e in zip(texts, EXACT.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ENCODER.ids(text).tolist() == e.ids


def optimum(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= sizes[k]:
                place(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit_against_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    least = optimum(sizes, 20)
    lengths = np.array(sizes)
    bins, offsets, _, n, bound = P.pack_partition(lengths, 20, True)
    assert bound <= least <= n
    fill = defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        fill[b].append((o, s))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(own)) and sum(s for _, s in own) <= 20


def check(docs, rows):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(own)) and sum(n for _, n in own) <= 2048
    ids = {i: [*e.ids, 0] for (i, _), e in zip(docs, EXACT.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True)}
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == P.cut(len(ids[i]))
        for r in own:
            part = np.array(ids[i][r.start : r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    total = sum(map(len, ids.values()))
    return len(by_sequence), -(-total // 2048)


def test_whole_table_in_several_rounds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = [tuple(r) for r in docs.collect()]
    n, least = check(plain, P.packed_documents(docs, VOCABULARY).collect())
    assert n <= least + 1
    monkeypatch.setattr(P, "ITEMS_PER_TASK", 60)
    n, least = check(plain, P.packed_documents(docs, VOCABULARY).collect())
    assert n <= 1.01 * least + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "é<|endoftext|>"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as length", "8 as piece")
    check(rows, P.packed_documents(docs, VOCABULARY).collect())
    assert P.packed_documents(docs.limit(0), VOCABULARY).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 3000, "doc_id long, text string")
    got = P.packed_documents(same, VOCABULARY).collect()
    assert len(got) == 3000 and len({(r.sequence_id, r.offset) for r in got}) == 3000


def test_rounds_close_gaps():
    rng = random.Random(3)
    lengths = np.array([rng.randint(1, 2048) for _ in range(3000)])
    _, _, free, n, bound = P.pack_partition(lengths, 2048, False)
    assert n <= 1.01 * bound and free.sum() < len(lengths) / 2


def test_a_gap_frees_as_much_as_it_needs(spark, monkeypatch):
    room = np.full(1000, 60)  # each bin is short by little, and 256 of them by too little
    free = P.released(room, 10, 2048)
    assert room[free].sum() >= 11 * 2048 and not free.all()
    assert not P.released(room, 0, 2048).any() and P.released(np.array([2000, 900, 10]), 0, 2048).tolist() == [True, True, False]
    # uncertified partitions of over RELEASED_BINS bins that best fit fills badly
    rng = random.Random(4)
    lengths = [rng.choice((1000, 680, 350, 345, 341, 339)) + rng.randrange(12) for _ in range(4000)]
    monkeypatch.setattr(P, "ITEMS_PER_TASK", 500)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    got = P.pack(df).collect()
    assert sorted(r.id for r in got) == list(range(4000))
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert len(fill) <= len(P.best_fit_decreasing(np.array(lengths), 2048)[1])
