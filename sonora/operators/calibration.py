"""Isotonic calibration, thresholds for a tolerated risk, and policies that bundle the two.

Scored pairs are as in sonora.operators.metrics. A calibrator is a row (group, n_fit, knots), a policy a
calibrator with threshold, target_risk, coverage and realized_risk. Knots follow each fitted plateau's
last score; smoothing is per plateau, so y may fall from knot to knot, and is left so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sonora.operators import metrics
from sonora.storage import small, written

#: The threshold of a policy that accepts nothing.
ACCEPT_NOTHING = 1.1
#: Pairs that one task pools before the plateaus of all tasks are pooled.
POOLED_TOGETHER = 100_000

KNOTS = "array<struct<x:double,y:double>>"


def pooled(blocks: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Pools adjacent (last x, right, n) until their shares of right strictly rise; exact on counts."""
    out: list[tuple[float, int, int]] = []
    for x, right, n in blocks:
        while out and out[-1][1] * n >= right * out[-1][2]:
            _, more, m = out.pop()
            right, n = right + more, n + m
        out.append((x, right, n))
    return out


def _plateaus(scored: DataFrame, by: list[str]) -> DataFrame:
    """(group, at, x, right, n): plateaus within contiguous ranges of the pairs, in order of `at` and x."""
    cell = scored.withColumn("cell", F.floor(F.col("seq") / metrics.SEQ_RANGE))
    counts = cell.groupBy(*by, "score", "cell").agg(F.count("*").alias("n"))
    places = metrics.preceding(counts, by, ["cell"], ["n"]).select(*by, "score", "cell", F.floor(F.col("before_n") / POOLED_TOGETHER).alias("at"))
    placed = cell.join(places, [*by, "score", "cell"]).select(*by, "at", "score", "seq", "correct")
    schema = T.StructType([*[scored.schema[c] for c in by], *T.StructType.fromDDL("at long, k long, x double, right long, n long").fields])

    def pool(key, pairs):
        import pandas as pd

        pairs = pairs.sort_values(["score", "seq"])
        found = pooled([(x, int(c), 1) for x, c in zip(pairs["score"], pairs["correct"], strict=True)])
        rows = [(*key, k, *block) for k, block in enumerate(found)]
        return pd.DataFrame(rows, columns=schema.names)

    return placed.groupBy(*by, "at").applyInPandas(pool, schema)


def fit(scored: DataFrame, by: list[str], smooth: bool = True) -> DataFrame:
    """group, n_fit and knots: isotonic regression, plateaus smoothed to (right + 1) / (n + 2).

    Ranges of pairs are pooled apart and their plateaus pooled again, which gives the same plateaus;
    plateaus are few, so no task holds a group.
    """
    schema = T.StructType([*[scored.schema[c] for c in by], *T.StructType.fromDDL(f"n_fit long, knots {KNOTS}").fields])

    def finish(key, blocks):
        import pandas as pd

        blocks = blocks.sort_values(["at", "k"])
        found = pooled(list(zip(blocks["x"], blocks["right"].astype(int), blocks["n"].astype(int), strict=True)))
        knots: list[dict] = []
        for x, right, n in found:
            y = (right + 1) / (n + 2) if smooth else right / n
            if knots and abs(knots[-1]["y"] - y) < 1e-12:
                knots[-1]["x"] = x
            else:
                knots.append({"x": x, "y": y})
        return pd.DataFrame([(*key, int(blocks["n"].sum()), knots)], columns=schema.names)

    return _plateaus(scored, by).groupBy(*by).applyInPandas(finish, schema)


def predict(score: Column, knots: Column) -> Column:
    """Linear between knots, constant beyond the ends, the score itself without knots."""
    n = F.size(knots)
    first, last = knots[0], F.element_at(knots, -1)
    lower = F.size(F.filter(knots, lambda k: k.x <= score))
    a, b = F.try_element_at(knots, F.greatest(lower, F.lit(1))), F.try_element_at(knots, lower + 1)
    between = F.when(a.x == b.x, b.y).otherwise(a.y + (b.y - a.y) * (score - a.x) / (b.x - a.x))
    inside = F.when(score <= first.x, first.y).when(score >= last.x, last.y).otherwise(between)
    return F.when(knots.isNull() | (n <= 0), score).otherwise(inside)


def threshold_for_risk(scored: DataFrame, by: list[str], risks: DataFrame) -> DataFrame:
    """For each group and max_risk: the least threshold whose accepted pairs are wrong at most so often.

    Thresholds are distinct scores, accepted is score >= threshold. threshold is null, coverage and
    realized_risk are 0 where no threshold keeps the risk. risks is a short list, a table with a column max_risk.
    """
    counts = metrics.score_counts(scored, by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    curve = metrics.preceding(counts, by, [], ["n", "errors"], descending=True).withColumn("kept", F.col("before_n") + F.col("n"))
    curve = curve.withColumn("risk", (F.col("before_errors") + F.col("errors")) / F.col("kept"))
    tried = curve.join(total, by)
    targets = [r.max_risk for r in risks.select(F.col("max_risk").cast("double")).distinct().collect()]
    point = F.struct("score", (F.col("kept") / F.col("total")).alias("coverage"), "risk")
    best = [F.struct(F.lit(t).cast("double").alias("max_risk"), F.min(F.when(F.col("risk") <= F.lit(t), point)).alias("best")) for t in targets or [0.0]]
    found = tried.groupBy(*by).agg(F.array(*best).alias("best")).select(*by, F.inline("best")).filter(F.lit(bool(targets)))
    return found.select(*by, "max_risk", F.col("best.score").alias("threshold"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("best.risk", F.lit(0.0)).alias("realized_risk"))


def calibrated(scored: DataFrame, calibrators: DataFrame, by: list[str]) -> DataFrame:
    """Pairs with `score` replaced by its calibrated value; groups without a calibrator go."""
    return scored.join(small(calibrators.select(*by, "knots")), by).withColumn("score", predict(F.col("score"), F.col("knots"))).drop("knots")


def fit_policies(scored: DataFrame, by: list[str], target_risk: float = 0.02, notes: str = "") -> DataFrame:
    """A policy for each group: the calibrator, and the threshold read on its own calibrated pairs."""
    calibrators = written(fit(scored, by))
    risks = scored.sparkSession.range(1).select(F.lit(float(target_risk)).alias("max_risk"))
    points = threshold_for_risk(calibrated(scored, calibrators, by), by, risks)
    return calibrators.join(points, by).select(
        *by,
        "n_fit",
        "knots",
        F.coalesce("threshold", F.lit(ACCEPT_NOTHING)).alias("threshold"),
        F.col("max_risk").alias("target_risk"),
        "coverage",
        "realized_risk",
        F.lit(notes).alias("notes"),
    )


def accepts(score: Column, knots: Column, threshold: Column) -> Column:
    return predict(score, knots) >= threshold


def interleaved(scored: DataFrame, by: list[str]) -> DataFrame:
    """Pairs with `held_out`: every second one of a group, in order of seq, the first not."""
    cell = scored.withColumn("cell", F.floor(F.col("seq") / metrics.SEQ_RANGE))
    before = W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cell.groupBy(*by, "cell").agg(F.count("*").alias("n")).select(*by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy(*by, "cell").orderBy("seq")
    placed = cell.join(starts, [*by, "cell"]).withColumn("held_out", (F.col("start") + F.row_number().over(own)) % 2 == 0)
    return placed.drop("cell", "start")


def held_out_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Calibration fitted on one half of each group and measured, raw and calibrated, on the other."""
    halves = interleaved(scored, by)
    held = halves.filter("held_out").drop("held_out")
    after = calibrated(held, written(fit(halves.filter("not held_out").drop("held_out"), by)), by)
    out = metrics.auroc(held, by)
    for name, pairs in (("raw", held), ("calibrated", after)):
        out = out.join(metrics.ece(pairs, by).withColumnRenamed("ece", f"ece_{name}"), by)
        out = out.join(metrics.nce(pairs, by).withColumnRenamed("nce", f"nce_{name}"), by)
    return out


def coverage_matrix(scored: DataFrame, by: list[str], targets: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """Coverage of each group at several tolerated risks, a column each."""
    risks = scored.sparkSession.createDataFrame([(float(t),) for t in targets], "max_risk double")
    points = threshold_for_risk(scored, by, risks)
    columns = [F.max(F.when(F.col("max_risk") == float(t), F.col("coverage"))).alias(f"coverage_{round(t * 1000)}") for t in targets]
    return points.groupBy(*by).agg(*columns)


def transfer(scored: DataFrame, policies: DataFrame, by: list[str], own_fit: bool = False) -> DataFrame:
    """What policies deliver on other pairs: risk, coverage, calibration error and a verdict.

    holds: the delivered risk is at most 1.5 times the target. delivered is null where nothing is accepted.
    own_fit adds the AUROC of the raw scores, and as a bound the error of calibrators fitted on these pairs.
    """
    facts = policies.select(*by, "knots", "threshold", "target_risk")
    pairs = scored.join(small(facts), by).withColumn("score", predict(F.col("score"), F.col("knots"))).drop("knots")
    accepted = F.col("score") >= F.col("threshold")
    out = pairs.groupBy(*by, "target_risk").agg(
        F.count("*").alias("n"), F.count_if(accepted).alias("accepted"), F.sum(F.when(accepted, metrics.wrong())).alias("errors")
    )
    out = out.withColumn("delivered", F.col("errors") / F.when(F.col("accepted") > 0, F.col("accepted"))).withColumn("coverage", F.col("accepted") / F.col("n"))
    verdict = F.when(F.col("accepted") == 0, "accepts nothing").when(F.col("delivered") <= F.col("target_risk") * 1.5, "holds").otherwise("BREAKS")
    moved = metrics.ece(pairs.drop("threshold", "target_risk"), by).withColumnRenamed("ece", "ece_transferred")
    out = out.withColumn("verdict", verdict).drop("n", "errors").join(moved, by)
    if own_fit:
        own = metrics.ece(calibrated(scored, written(fit(scored, by)), by), by).withColumnRenamed("ece", "ece_own")
        out = out.join(own, by).join(metrics.auroc(scored, by), by)
    return out
