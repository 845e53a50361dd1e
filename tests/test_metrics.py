import random
import re

import oracles as O
import pytest

from sonora.operators import calibration as C
from sonora.operators import metrics as M

BY = ["g"]


def frame(spark, groups):
    rows = [(g, i, float(s), bool(c)) for g, pairs in groups.items() for i, (s, c) in enumerate(pairs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, seq long, score double, correct boolean")


def groups(n=60, seed=0):
    rng = random.Random(seed)
    return {f"g{k}": [(rng.choice((0.0, 0.1, 0.2, 0.3, 0.5, 0.9, 1.0)), rng.random() < 0.7) for _ in range(rng.randrange(1, 31))] for k in range(n)}


def values(df, column):
    return {r.g: r[column] for r in df.collect()}


@pytest.mark.parametrize("span", [M.SEQ_RANGE, 3])
@pytest.mark.parametrize(("op", "oracle"), [("auroc", O.auroc), ("auc_nt", O.auc_nt), ("ece", O.ece), ("nce", O.nce), ("aurc", lambda p: sum(O.curve(p)) / len(p))])
def test_random_groups_with_ties(spark, monkeypatch, op, oracle, span):
    monkeypatch.setattr(M, "SEQ_RANGE", span)
    own = groups()
    got = values(getattr(M, op)(frame(spark, own), BY), op)
    assert got == {g: (None if (want := oracle(p)) is None else pytest.approx(want, abs=1e-9)) for g, p in own.items()}


@pytest.mark.parametrize("ranges", [M.SCORE_RANGES, 7])
def test_scores_that_are_not_rounded(spark, monkeypatch, ranges):
    monkeypatch.setattr(M, "SCORE_RANGES", ranges)
    rng = random.Random(3)
    own = {k: [(rng.gauss(0.5, w), rng.random() < 0.7) for _ in range(90)] + [(0.5, True), (-0.0, False)] for k, w in (("a", 0.2), ("b", 3.0), (None, 1e-7))}
    df = frame(spark, own)
    assert values(M.auroc(df, BY), "auroc") == {g: pytest.approx(O.auroc(p), abs=1e-9) for g, p in own.items()}
    named = frame(spark, own).filter("g is not null")
    pairs = {g: p for g, p in own.items() if g}
    assert values(M.auc_nt(named, BY), "auc_nt") == {g: pytest.approx(O.auc_nt(p), abs=1e-9) for g, p in pairs.items()}
    assert values(M.aurc(named, BY), "aurc") == {g: pytest.approx(sum(O.curve(p)) / len(p), abs=1e-9) for g, p in pairs.items()}
    assert {r.g: [(k.x, pytest.approx(k.y)) for k in r.knots] for r in C.fit(named, BY).collect()} == {g: O.isotonic(p, True) for g, p in pairs.items()}
    for r in C.threshold_for_risk(named, BY, spark.createDataFrame([(0.2,)], "max_risk double")).collect():
        assert (r.threshold, r.coverage, r.realized_risk) == pytest.approx(O.threshold(pairs[r.g], 0.2))


def test_no_window_orders_a_groups_scores(spark):
    """Windows over a whole group see the totals of ranges only."""
    df = frame(spark, groups(2))
    risks = spark.createDataFrame([(0.2,)], "max_risk double")
    for found in (M.auroc(df, BY), M.auc_nt(df, BY), M.risk_coverage(df, BY), C.threshold_for_risk(df, BY, risks), C.fit(df, BY)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*, \[([^\[\]]*)\], \[([^\[\]]*)\]$", plan, re.M)
        whole = [order for partition, order in windows if re.fullmatch(r"g#\d+", partition)]
        assert whole and all(order.startswith("range#") for order in whole)


def test_known_values(spark):
    T, F = True, False
    own = {"a": [(3, T), (1, T), (2, F), (0, F)], "b": [(0.5, T), (0.5, F)] * 3, "c": [(0.1, F), (0.2, T), (0.8, F), (0.9, T)], "d": [(0.9, T)] * 9 + [(0.9, F)], "e": [(1.0, F)] * 4}
    df = frame(spark, own)
    assert values(M.auroc(df, BY), "auroc") == {"a": 0.75, "b": 0.5, "c": 0.75, "d": 0.5, "e": None}
    assert values(M.auc_nt(df, BY), "auc_nt")["c"] == pytest.approx((1 + 2 / 3) / 2)
    assert values(M.ece(df, BY), "ece")["d"] == pytest.approx(0) and values(M.ece(df, BY), "ece")["e"] == 1
    out = {r.g: r for r in M.summary(df, BY).collect()}
    assert out["d"].n == 10 and out["d"].accuracy == pytest.approx(0.9) and out["e"].nce is None
    assert M.summary(df.limit(0), BY).count() == 0
    outside = frame(spark, {"x": [(1.5, T), (0.5, T)]})
    assert values(M.ece(outside, BY), "ece")["x"] == 0.25


def test_risk_coverage(spark):
    own = groups(10, 3)
    for r in M.risk_coverage(frame(spark, own), BY).collect():
        pairs = own[r.g]
        assert r.risk == pytest.approx(O.curve(pairs)[r.rank - 1]) and r.coverage == pytest.approx(r.rank / len(pairs))


def test_threshold_for_risk(spark):
    own = groups(60, 5) | {"one": [(0.99, 1), (0.95, 1), (0.9, 1), (0.4, 0), (0.3, 1), (0.2, 0)], "none": [(0.9, 0), (0.8, 1), (0.7, 1)]}
    risks = [0.0, 0.05, 0.2, 0.5]
    table = spark.createDataFrame([(r,) for r in risks], "max_risk double")
    for r in C.threshold_for_risk(frame(spark, own), BY, table).collect():
        t, cov, risk = O.threshold(own[r.g], r.max_risk)
        assert (r.threshold, r.coverage, r.realized_risk) == (t, pytest.approx(cov), pytest.approx(risk))


@pytest.mark.parametrize("pooled", [C.POOLED_TOGETHER, 4])
@pytest.mark.parametrize("smooth", [True, False])
def test_isotonic_fit(spark, monkeypatch, smooth, pooled):
    monkeypatch.setattr(C, "POOLED_TOGETHER", pooled)
    monkeypatch.setattr(M, "SEQ_RANGE", 5 if pooled == 4 else M.SEQ_RANGE)
    own = groups(40, 8) | {"plateau": [(0.5, 1)] * 4, "cascade": [(0.1, 1), (0.2, 1), (0.3, 1), (0.4, 0), (0.5, 0)]}
    for r in C.fit(frame(spark, own), BY, smooth).collect():
        want = O.isotonic(own[r.g], smooth)
        assert r.n_fit == len(own[r.g])
        assert [(k.x, pytest.approx(k.y)) for k in r.knots] == want
    if smooth:
        assert {r.g: r.knots[0].y for r in C.fit(frame(spark, own), BY).collect()}["plateau"] == pytest.approx(5 / 6)


def test_predict(spark):
    knots = [{"x": 0.2, "y": 0.1}, {"x": 0.4, "y": 0.5}, {"x": 0.8, "y": 0.3}]
    df = spark.createDataFrame([(s, knots) for s in (0.0, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0)], f"s double, knots {C.KNOTS}")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(C.predict(F.col("s"), F.col("knots"))).collect()] == pytest.approx([0.1, 0.1, 0.3, 0.5, 0.4, 0.3, 0.3])
    assert df.select(C.predict(F.col("s"), F.array().cast(C.KNOTS)).alias("p")).filter("p <> s").count() == 0


def test_policies_split_and_transfer(spark):
    own = {"clean": [(i / 99, i > 30) for i in range(100)], "bad": [(0.9, False), (0.8, False)]}
    df = frame(spark, own)
    policies = C.fit_policies(df, BY, 0.05)
    by = {r.g: r for r in policies.collect()}
    assert by["bad"].threshold == C.ACCEPT_NOTHING and by["bad"].coverage == 0 and by["clean"].realized_risk <= 0.05
    moved = {r.g: r for r in C.transfer(df, policies, BY).collect()}
    assert moved["bad"].verdict == "accepts nothing" and moved["bad"].delivered is None and moved["clean"].verdict == "holds"
    both = {r.g: r for r in C.transfer(df, policies, BY, own_fit=True).collect()}
    assert both["clean"].ece_own == pytest.approx(both["clean"].ece_transferred) and both["clean"].auroc == 1 and both["bad"].auroc is None
    halves = C.interleaved(df, BY)
    assert halves.filter("held_out").count() == 51
    assert halves.filter("g = 'clean' and held_out <> (seq % 2 = 1)").count() == 0
    report = {r.g: r for r in C.held_out_report(frame(spark, {"clean": own["clean"]}), BY).collect()}
    held = own["clean"][1::2]
    knots = O.isotonic(own["clean"][::2], True)
    assert [k[0] for k in knots] == [30 / 99, 98 / 99]
    (x0, y0), (x1, y1) = knots
    after = [(min(max(y0 + (y1 - y0) * (x - x0) / (x1 - x0), y0), y1), c) for x, c in held]
    assert report["clean"].ece_raw == pytest.approx(O.ece(held)) and report["clean"].ece_calibrated == pytest.approx(O.ece(after))
    assert report["clean"].nce_calibrated == pytest.approx(O.nce(after)) and report["clean"].auroc == 1
    assert {r.g: r.coverage_500 for r in C.coverage_matrix(df, BY, (0.5,)).collect()}["clean"] == 1


#: Pairs whose plateaus end twice at each of three scores, in order of score.
TIED = [(0.2, c) for c in (0, 0, 1, 0)] + [(0.5, c) for c in (1, 1, 0, 1, 1, 1, 0)] + [(0.8, c) for c in (1, 1, 1, 1, 0, 1, 1)]


def test_held_out_report_where_knots_share_a_score(spark):
    knots = O.isotonic(TIED, True)
    assert [x for x, _ in knots] == [0.2, 0.2, 0.5, 0.5, 0.8, 0.8] and len({y for _, y in knots}) == 6
    held = [((0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)[i % 7], i % 3 > 0) for i in range(len(TIED))]
    own = {"tied": [pair for both in zip(TIED, held, strict=True) for pair in both]}
    after = [(O.predict(knots, x), c) for x, c in held]
    report = C.held_out_report(frame(spark, own).repartition(5, "seq"), BY).collect()[0]
    assert (report.ece_raw, report.nce_raw) == pytest.approx((O.ece(held), O.nce(held)))
    assert (report.ece_calibrated, report.nce_calibrated) == pytest.approx((O.ece(after), O.nce(after)))


@pytest.mark.parametrize(("risk", "threshold", "accepted"), [(0.25, 4 / 6, 14), (0.15, 3 / 4, 7)])
def test_policy_where_knots_share_a_score(spark, risk, threshold, accepted):
    knots = O.isotonic(TIED, True)
    value = [(O.predict(knots, x), c) for x, c in TIED]
    df = frame(spark, {"tied": TIED}).repartition(5, "seq")
    policies = C.fit_policies(df, BY, risk)
    policy = policies.collect()[0]
    assert [(k.x, pytest.approx(k.y)) for k in policy.knots] == knots and policy.n_fit == len(TIED)
    assert (policy.threshold, policy.coverage, policy.realized_risk) == pytest.approx(O.threshold(value, risk))
    assert policy.threshold == pytest.approx(threshold) and policy.coverage == pytest.approx(accepted / len(TIED))
    moved = C.transfer(df, policies, BY).collect()[0]
    assert moved.accepted == accepted and moved.delivered == pytest.approx(policy.realized_risk)


def test_log_softmax_of_long_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from sonora.functions.distributions import log_softmax

    x = F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.sin(i + F.col("id") * 7) * 5)
    df = spark.range(3).select("id", x.alias("x")).select("id", log_softmax(F.col("x")).alias("lp"))
    for r in df.collect():  # time that grew with the square would be hours
        y = np.sin(np.arange(1, 50_001) + r.id * 7) * 5
        assert np.allclose(r.lp, y - np.log(np.exp(y).sum()), atol=1e-9)


def test_tables_over_the_broadcast_bound_shuffle(spark, monkeypatch):
    from sonora import storage

    df = frame(spark, groups(5, 2))
    calibrators = storage.written(C.fit(df, BY))
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    sent = C.calibrated(df, calibrators, BY)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 10)
    shuffled = C.calibrated(df, calibrators, BY)
    assert "broadcast" in plan(sent) and "broadcast" not in plan(shuffled)
    assert sorted(sent.collect()) == sorted(shuffled.collect())
    assert C.threshold_for_risk(df, BY, spark.createDataFrame([], "max_risk double")).count() == 0
