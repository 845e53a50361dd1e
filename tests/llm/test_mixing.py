import re
from collections import Counter, defaultdict

from sonora.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    free = set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
        if not free:
            return target


def check(docs, rows):
    size = {}
    sizes, taken, expect = defaultdict(int), defaultdict(int), Counter()
    for doc_id, text, source in docs:
        n = len(WORD.findall(text or ""))
        size[doc_id] = (n, source)
        sizes[source] += n
        expect[doc_id] += 1
    assert Counter(r.doc_id for r in rows) == expect
    target = brute_targets(dict(sizes))
    longest = defaultdict(int)
    for r in rows:
        n, source = size[r.doc_id]
        assert r.size == n and r.source_size == sizes[source]
        assert abs(r.target - target[source]) <= 1e-6 * max(1, target[source])
        assert r.taken % n == 0 if n else r.taken == 0
        assert r.taken <= 3 * n
        taken[source] += r.taken
        longest[source] = max(longest[source], n)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * longest[s] + 1, (s, taken[s], target[s])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.report(docs).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], rows)
    assert sorted(map(tuple, mixing.report(docs.repartition(7)).collect())) == sorted(map(tuple, rows))
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect())
    assert got == +want
    assert mixing.mixed(docs).columns == docs.columns


def test_edges(spark):
    rows = [(i, "w " * (i % 7), "a") for i in range(50)] + [(None, "x y", "a"), (60, None, "b"), (61, "", None), (62, "one two", None), (63, "z " * 3000, "é"), (64, "q", "Z"), (65, "q", "Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as `row`", "3 as `copies`", "4 as bucket", "5 as target")
    check(rows, mixing.report(docs).collect())
    assert set(mixing.mixed(docs).columns) == set(docs.columns)
    same = spark.createDataFrame([(1, "a b", "s")] * 100 + [(2, "c", "t")] * 10, "doc_id long, text string, source string")
    assert mixing.report(same).count() == 110
    assert mixing.report(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    blank = docs.filter("text is null or text = ''")
    assert all(r.taken == 0 for r in mixing.report(blank).collect())
