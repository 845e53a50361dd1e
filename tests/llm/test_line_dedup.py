import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sonora.llm import line_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_check_halves_and_variants(a, b):
    near = edits(a, b) <= 1
    assert D.within_one_edit(a, b) == near
    x, y = [[w.encode() for w in s] for s in (a, b)]
    if near and min(len(a), len(b)) >= 2:
        assert set(D.halves(x)) & set(D.halves(y))
    if a and b and a != b:
        v, w = D.variants(x).tolist(), D.variants(y).tolist()
        met = any(p == q for p, q in zip(v[:-1], w[:-1])) and len(a) == len(b) or v[-1] in w[:-1] or w[-1] in v[:-1]
        assert met == near


def compared(words):
    """The kind of edit that a line is compared by, and its units."""
    if len(words) >= 8:
        return "words", words
    return ("characters", tuple(" ".join(words))) if len(" ".join(words)) >= 12 else (None, ())


def brute(rows):
    places = {}
    for doc_id, text in rows:
        for number, line in enumerate((text or "").split("\n") if text else ()):
            if words := tuple(WORD.findall(line)):
                places.setdefault(words, []).append((doc_id is None, doc_id or 0, number))
    first = {w: min(p) for w, p in places.items()}
    units = {w: compared(w) for w in places}
    out = set()
    for words, own in places.items():
        rank, (kind, mine) = first[words], units[words]
        near = kind is not None and any(
            f < rank and units[o][0] == kind and abs(len(units[o][1]) - len(mine)) <= 1 and edits(mine, units[o][1]) <= 1 for o, f in first.items()
        )
        out |= {(p, "near" if near else "exact") for p in own if near or p != rank}
    return out


def got(df):
    return {((r.doc_id is None, r.doc_id or 0, r.line_no), r.kind) for r in D.removed(df).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    bases = [rng.choices(words, k=rng.randrange(1, 16)) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(line)) if line else 0
                line[at : at + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
            lines.append(rng.choice((" ", "  ", "\t")).join(line))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    for r in D.report(df).collect():
        assert (r.first_doc_id, r.first_line_no) < (r.doc_id, r.line_no)


def test_short_lines_by_characters(spark):
    rng = random.Random(9)
    alphabet = "abé日 "
    bases = ["".join(rng.choices(alphabet, k=rng.randrange(3, 40))) for _ in range(25)]
    rows = []
    for i in range(150):
        line = list(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 1, 2))):
            at = rng.randrange(len(line))
            line[at : at + rng.randrange(2)] = rng.choices(alphabet, k=rng.randrange(2))
        rows.append((i, "".join(line)))
    rows += [(200, "All rights reserved."), (201, "All rights  reserved,"), (202, "Al rights reserved."), (203, "All rights"), (204, "All right"), (205, "a b c d e f g hi"), (206, "a b c d e f ghi")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(df) == want
    near = {p[1] for p, kind in want if kind == "near"}
    assert len(near) > 20 and {201, 202} <= near and not {200, 203, 204, 205, 206} & near


def test_a_long_line_of_one_word(spark):
    line = "".join(random.Random(1).choices("abcdef", k=100_000))
    rows = [(1, line), (2, line[:70_000] + line[70_001:]), (3, line[:10] + "x" + line[11:]), (4, line[:5] + line[6:-5] + line[-4:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == {((False, i, 0), "near") for i in (2, 3)}


def test_hot_lines_keep_the_earliest(spark):
    hot = "the same very long line that many documents have in common"
    rows = [(i, f"{hot} {i}\n{hot}\nown {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = D.removed(df).collect()
    assert len(out) == 2 * 400 - 1  # doc 0 keeps its first line; the plain line is one edit from it
    assert {r.kind for r in out} == {"near"}


def test_cleaned_and_edges(spark):
    long = "\n".join(f"line {i} of a long document with quite some words {i * i}" for i in range(3000))
    rows = [(1, "a b\nc"), (2, "c\na b"), (3, None), (4, ""), (5, " \n\n"), (6, "x\n\nc\ny"), (None, "a b\nz"), (7, long), (8, "q"), (8, "q"), (9, "é ü\r\nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "'h' as high", "length(text) as n_chars", "7 as gone")
    out = D.cleaned(df)
    assert out.schema == df.schema
    found = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=str)
    want = [(1, "a b\nc", 5), (3, None, None), (4, "", 0), (5, " \n\n", 3), (6, "x\n\ny", 4), (0, "z", 1), (7, long, len(long)), (8, "q", 1), (8, "q", 1), (9, "é ü\r", 4)]
    assert found == sorted(want, key=str)
    assert D.report(df.limit(0)).count() == 0 and D.cleaned(df.limit(0)).count() == 0
