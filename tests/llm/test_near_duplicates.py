import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonora.llm import near_duplicates as N
from sonora.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, rule):
    """component of each (id, text), by an inverted index over all shingles."""
    sets = {i: word_sets(t, rule.shingle) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(y for x in s for y in index[x] if y < i).items():
            if rule.links(n, len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i in sorted(sets):
        least.setdefault(find(i), i)
    return {i: (len(s), least[find(i)]) for i, s in sets.items()}


def check(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.report(df, rule).collect()}
    assert got == brute(rows, rule)


def test_sketch_is_mergeable_and_estimates():
    rng = np.random.default_rng(1)
    pool = N._mixed(np.arange(1, 40000, dtype=np.uint64))
    for n, share in ((40, 0.9), (500, 0.5), (3000, 0.85), (20000, 0.3)):
        common = pool[: int(n * share)]
        a = np.unique(np.r_[common, pool[20000 : 20000 + n - len(common)]])
        b = np.unique(np.r_[common, pool[30000 : 30000 + min(n - len(common), 9000)]])
        x, y, both = N.sketches([a, b, np.union1d(a, b)])
        assert (np.maximum(x, y) == both).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(N.estimated(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]))[0] - true) < 0.12
    shuffled = rng.permutation(pool[:700])
    assert (N.sketches([np.sort(shuffled)]) == N.sketches([pool[:700]])).all()
    assert N.Rule(3, 85).rows == 6 or (1 - 0.85 ** N.Rule(3, 85).rows) ** (256 // N.Rule(3, 85).rows) < 1e-8


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 1), (5, 9), (9, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 5: 1, 7: 1, 9: 1}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "rule"), [(N.BLOCK, N.CONTRACT), (0.5, N.CONTRACT), (N.BLOCK, N.DEFAULT)])
def test_hot_groups_with_chains_against_brute_force(spark, monkeypatch, block, rule):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=120)
    chain = list(base)
    for i in range(160):  # copies with more and more changes, and a chain of copies of copies
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 10))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i * 3, " ".join(copy)))
        if i < 60:
            chain[rng.randrange(len(chain))] = rng.choice(words)
            rows.append((1000 + i, " ".join(chain)))
    for i in range(100):
        own = rng.choices(words, k=rng.randrange(1, 60))
        rows += [(2000 + 2 * i, " ".join(own)), (2001 + 2 * i, " ".join(own[:-1] + ["x"]))]
    check(spark, rows, rule)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, N.CONTRACT)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "É a b c"), (8, "é a b c"), (9, "x y z " * 30000), (10, "x y z " * 20000), (11, "z")]
    check(spark, rows, N.CONTRACT)
    more = spark.createDataFrame([*rows, (None, "one two"), (None, "alone of null"), (4, "one two"), (4, "other words here")], "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as `row`", "4 as n_shingles")
    found = N.report(more).collect()
    assert len(found) == len(rows) + 4
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found if r.doc_id in (None, 4)) == [(0, 0), (0, 4), (4, 4), (4, 4), (4, 4)]
    kept = N.deduplicated(more, N.CONTRACT)
    assert kept.columns == more.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, 11]
    assert N.report(more.limit(0)).count() == 0 and N.deduplicated(more.limit(0)).count() == 0


def test_parts_of_one_text_against_brute_force(spark):
    """Sets within the hub's share nothing outside of it."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(6):
        base = rng.choices(words, k=260)
        for i in range(40):
            n = rng.randrange(150, 260)
            at = rng.choice((0, 0, rng.randrange(0, 260 - n + 1)))
            part = base[at : at + n]
            for _ in range(rng.choice((0, 0, 1, 3))):
                part[rng.randrange(len(part))] = rng.choice(words)
            rows.append((100 * k + i, " ".join(part)))
    check(spark, rows, N.CONTRACT)
    check(spark, rows, N.DEFAULT)


def template(n):
    """Pages of one template that fill the same gaps with words of their own: similarities about 0.77, no links."""
    rows = []
    for i in range(n):
        page = [f"t{k}" for k in range(220)]
        for at in (20, 60, 90, 120, 150, 190, 191):
            page[at] = f"own{i}_{at}"
        rows.append((i, " ".join(page)))
    return rows


def test_pages_of_a_template_are_not_paired(spark, monkeypatch):
    """Twice the pages give about twice the rows of every join."""
    counts = {}
    meetings = N._meetings

    def counted(prefixes, rule):
        index, probes = meetings(prefixes, rule)
        counts[size] = (prefixes.count(), probes.count(), probes.join(index, ["hub", "shingle", "block"]).count())
        return index, probes

    monkeypatch.setattr(N, "_meetings", counted)
    for size in (150, 300):
        rows = template(size)
        similar = N.shingles(rows[0][1], 3), N.shingles(rows[1][1], 3)
        share = len(np.intersect1d(*similar)) / len(np.union1d(*similar))
        assert 0.75 < share < 0.85
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in N.report(df).collect()} == {i: i for i in range(size)}
    assert all(y <= 2.5 * x + 10 for x, y in zip(counts[150], counts[300], strict=True)), counts


def test_recall_at_the_threshold(spark):
    """Of 1,500 pairs just over the threshold, each alone, none is missed."""
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        own = [f"{i}_{k}" for k in range(200)]
        copy = list(own)
        for at in rng.sample(range(2, 197, 3), 5):
            copy[at] = "x" + copy[at]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(copy))]
    similar = (198 - 15) / (198 + 15)
    assert 0.85 <= similar < 0.87
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert N.report(df).filter("component_id = doc_id").count() == 1500
