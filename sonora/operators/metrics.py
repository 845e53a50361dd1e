"""How well a score tells right from wrong, and how well it is calibrated.

All operators take scored pairs: the group columns, `seq` (unique in a group; it orders ties), `score` double
and `correct` boolean. Undefined values are null. Groups are few and large, so nothing sorts a group in
one task: counts by distinct score, or by score and a range of seq, are summed up first, and their table, one
row a cell, is ordered by ranges of the score. Only the ranges' totals are ordered by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Width of a range of seq; rows of equal score within one are ordered together.
SEQ_RANGE = 65536
#: Ranges of score that [0, 1] is cut into.
SCORE_RANGES = 65536


def wrong() -> Column:
    return F.when(F.col("correct"), F.lit(0)).otherwise(F.lit(1)).cast("long")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top.cast("double") / bottom)


def score_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """n and errors of each distinct score of a group."""
    return scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(wrong()).alias("errors"))


def preceding(cells: DataFrame, by: list[str], order: list[str], sums: list[str], descending: bool = False) -> DataFrame:
    """cells (group, score, ...) with before_<c> for each c of sums: its total over the group's earlier cells.

    Cells follow the score, then order. They are summed up within ranges of the score, so scores that are not rounded
    are spread over tasks; a group's ranges are 65536 at most for scores in [0, 1], in proportion for wider scores.
    Null scores come before all others (last if descending), NaN after.
    """
    way = Column.desc if descending else Column.asc
    least, most = F.lit(-(2**63)), F.lit(2**63 - 1)
    ranged = cells.withColumn("range", F.when(F.isnan("score"), most).otherwise(F.coalesce(F.floor(F.col("score") * SCORE_RANGES), least)))
    earlier = lambda window: window.rowsBetween(W.unboundedPreceding, -1)
    across = earlier(W.partitionBy(*by).orderBy(way(F.col("range"))))
    within = earlier(W.partitionBy(*by, "range").orderBy(way(F.col("score")), *order))
    totals = ranged.groupBy(*by, "range").agg(*[F.sum(c).alias(c) for c in sums])
    keys = [*by, "range"]
    starts = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"start_{c}") for c in sums])
    inside = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"inside_{c}") for c in sums])
    placed = inside.join(starts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return placed.select(*cells.columns, *[(F.col(f"start_{c}") + F.col(f"inside_{c}")).alias(f"before_{c}") for c in sums])


def auroc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their average rank; null if a class is absent."""
    ranked = preceding(score_counts(scored, by), by, [], ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum((F.col("n") - F.col("errors")) * F.col("rank")).alias("ranks"), F.sum(F.col("n") - F.col("errors")).alias("right"), F.sum("errors").alias("errors"))
    right, errors = F.col("right").cast("double"), F.col("errors").cast("double")
    return sums.select(*by, _ratio(F.col("ranks") - right * (right + 1) / 2, right * errors).alias("auroc"))


def running(scored: DataFrame, by: list[str], descending: bool) -> DataFrame:
    """Each pair with its rank in order of score (ties by seq) and the errors up to it."""
    cell = scored.withColumn("cell", F.floor(F.col("seq") / SEQ_RANGE))
    counts = cell.groupBy(*by, "score", "cell").agg(F.count("*").alias("n"), F.sum(wrong()).alias("errors"))
    starts = preceding(counts, by, ["cell"], ["n", "errors"], descending).drop("n", "errors")
    own = W.partitionBy(*by, "score", "cell").orderBy("seq")
    placed = cell.join(starts, [*by, "score", "cell"])
    placed = placed.withColumn("rank", F.col("before_n") + F.row_number().over(own))
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.withColumn("errors", F.col("before_errors") + F.sum(wrong()).over(so_far)).drop("cell", "before_n", "before_errors")


def auc_nt(scored: DataFrame, by: list[str]) -> DataFrame:
    """Average precision of finding errors by low scores; null if a class is absent."""
    found = running(scored, by, descending=False)
    precision = F.avg(F.when(~F.col("correct"), F.col("errors") / F.col("rank")))
    both = F.max("correct") & ~F.min("correct")
    return found.groupBy(*by).agg(F.when(both, precision).alias("auc_nt"))


def bin_of(score: Column, bins: int = 10) -> Column:
    """Equal bins of [0, 1], closed at the right, the first also at the left; null outside."""
    return F.when((score >= 0) & (score <= 1), F.greatest(F.lit(0), F.ceil(score * bins) - 1))


def ece(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error; scores outside [0, 1] count in the denominator only."""
    n = F.sum("n")
    cells = score_counts(scored, by).groupBy(*by, bin_of(F.col("score"), bins).alias("bin"))
    cells = cells.agg(n.alias("n"), (F.sum(F.col("score") * F.col("n")) / n).alias("confidence"), (1 - F.sum("errors") / n).alias("accuracy"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).otherwise(0.0)
    return cells.groupBy(*by).agg(_ratio(F.sum(gap), F.sum("n")).alias("ece"))


def nce(scored: DataFrame, by: list[str], eps: float = 1e-15) -> DataFrame:
    """Normalised cross entropy against always saying the base rate; null if that is 0 or 1."""
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    loss = (F.col("n") - F.col("errors")) * F.ln(p) + F.col("errors") * F.ln(1 - p)
    sums = score_counts(scored, by).groupBy(*by).agg((-F.sum(loss) / F.sum("n")).alias("model"), (1 - F.sum("errors") / F.sum("n")).alias("base"))
    base = F.col("base")
    prior = -(base * F.ln(base) + (1 - base) * F.ln(1 - base))
    return sums.select(*by, F.when((base > 0) & (base < 1), (prior - F.col("model")) / prior).alias("nce"))


def risk_coverage(scored: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and risk of keeping each pair and all that score higher."""
    found = running(scored, by, descending=True)
    total = scored.groupBy(*by).agg(F.count("*").alias("total"))
    return found.join(total, by).select(*by, "seq", "rank", (F.col("rank") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("rank")).alias("risk"))


def aurc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean risk over all coverages."""
    found = running(scored, by, descending=True)
    return found.groupBy(*by).agg(F.avg(F.col("errors") / F.col("rank")).alias("aurc"))


def summary(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """All metrics of each group in a row.

    All but the two that need the order of ties come from one table of counts by distinct score, whose
    shuffle Spark reuses.
    """
    n = F.sum("n")
    plain = score_counts(scored, by).groupBy(*by).agg(n.alias("n"), (1 - F.sum("errors") / n).alias("accuracy"), (F.sum(F.col("score") * F.col("n")) / n).alias("mean_score"))
    for metric in (auroc(scored, by), auc_nt(scored, by), ece(scored, by, bins), nce(scored, by), aurc(scored, by)):
        plain = plain.join(metric, by)
    return plain


def gate_sweep(segments: DataFrame, by: list[str], thresholds: tuple[float, ...] = (0.55, 0.65, 0.75, 0.85, 0.95)) -> DataFrame:
    """Range of segment confidence, and how many segments each candidate threshold flags, in one pass."""
    flagged = [F.count_if(F.col("confidence") < t).alias(f"below_{round(t * 100)}") for t in thresholds]
    return segments.groupBy(*by).agg(
        F.count("*").alias("segments"),
        F.min("confidence").alias("conf_min"),
        F.avg("confidence").alias("conf_mean"),
        F.max("confidence").alias("conf_max"),
        F.max("no_speech_prob").alias("max_no_speech"),
        *flagged,
    )


def hit_count(found: DataFrame, by: list[str]) -> DataFrame:
    """How often the language found is the one expected."""
    return found.groupBy(*by).agg(F.count_if(F.col("code") == F.col("expected")).alias("hits"), F.count("*").alias("total"))


def speed(runs: DataFrame) -> DataFrame:
    """Real-time factor and its inverse of each run of (model, elapsed_s, duration_s)."""
    rtf = _ratio(F.col("elapsed_s"), F.col("duration_s"))
    return runs.withColumn("rtf", rtf).withColumn("times_realtime", _ratio(F.lit(1.0), rtf))


def window_constancy(segments: DataFrame, by: list[str]) -> DataFrame:
    """Whether a segment's figures are those of its decode window, from counts of distinct values."""
    nine = lambda c: F.count_distinct(F.round(F.col(c), 9))
    counts = segments.groupBy(*by).agg(
        F.count("*").alias("segments"),
        F.count_distinct("seek").alias("windows"),
        nine("avg_logprob").alias("distinct_logprob"),
        nine("no_speech_prob").alias("distinct_no_speech"),
        nine("compression_ratio").alias("distinct_compression"),
    )
    per_window = (F.col("distinct_logprob") == F.col("windows")) & (F.col("windows") < F.col("segments"))
    verdict = F.when(per_window, "CONFIRMED").when(F.col("distinct_logprob") == F.col("segments"), "REFUTED").otherwise("INCONCLUSIVE")
    return counts.withColumn("verdict", verdict)
