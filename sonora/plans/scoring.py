"""Queries of ranking, calibration and policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonora.operators import calibration as C
from sonora.operators import metrics as M
from sonora.plans import bindings as B
from sonora.storage import small

BY = ["condition"]
RISKS = (0.05, 0.10, 0.15, 0.20)


def _metric(fn):
    return lambda spark, sf_dir: B.rounded(fn(B.scored(spark, sf_dir), BY))


def _risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in RISKS], "max_risk double")


def gate_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonora.operators.transcripts import gated

    segments = gated(B.segments(spark, sf_dir)).withColumn("level", F.col("utt_id") % 6)
    return B.rounded(M.gate_sweep(segments, ["level"]))


def risk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(C.threshold_for_risk(B.scored(spark, sf_dir), BY, _risks(spark)))


def coverage_at_risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(C.coverage_matrix(B.scored(spark, sf_dir), BY, RISKS))


def interleaved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.interleaved(B.scored(spark, sf_dir), BY)


def _knots(fitted: DataFrame) -> DataFrame:
    return B.rounded(fitted.select("condition", "n_fit", F.posexplode("knots").alias("k", "knot")).select("condition", "n_fit", "k", "knot.x", "knot.y"))


def isotonic_fit_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knots(C.fit(B.scored(spark, sf_dir), BY, smooth=False))


def isotonic_fit_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knots(C.fit(B.scored(spark, sf_dir), BY))


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(C.fit_policies(B.scored(spark, sf_dir), BY, 0.15).drop("knots", "notes"))


def held_out_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(C.held_out_report(B.scored(spark, sf_dir), BY))


def _by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(c) for c in ("clean", "10", "0", "none")]), (F.col("seq") % 4 + 1).cast("int"))
    return B.scored(spark, sf_dir).withColumn("condition", names)


def policy_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = B.policies(spark).select("condition", "knots", "threshold")
    pairs = _by_policy(spark, sf_dir).join(small(policies), "condition")
    value = C.predict(F.col("score"), F.col("knots"))
    return B.rounded(pairs.select("condition", "seq", value.alias("calibrated"), C.accepts(F.col("score"), F.col("knots"), F.col("threshold")).alias("accept")))


def policy_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(C.transfer(_by_policy(spark, sf_dir), B.policies(spark), BY))


def policy_transfer_own_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(C.transfer(_by_policy(spark, sf_dir), B.policies(spark), BY, own_fit=True))


QUERIES = {
    "auroc_by_lang": _metric(M.auroc),
    "auc_nt_by_lang": _metric(M.auc_nt),
    "ece_by_lang": _metric(M.ece),
    "nce_by_lang": _metric(M.nce),
    "risk_coverage_curve": _metric(M.risk_coverage),
    "aurc_by_lang": _metric(M.aurc),
    "metric_summary": _metric(M.summary),
    "gate_threshold_sweep": gate_threshold_sweep,
    "risk_threshold": risk_threshold,
    "coverage_at_risk_matrix": coverage_at_risk_matrix,
    "interleaved_split": interleaved_split,
    "isotonic_fit_raw": isotonic_fit_raw,
    "isotonic_fit_smoothed": isotonic_fit_smoothed,
    "operating_points": operating_points,
    "held_out_report": held_out_report,
    "policy_apply": policy_apply,
    "policy_transfer": policy_transfer,
    "policy_transfer_own_fit": policy_transfer_own_fit,
}



def _auroc(source: str = "sc") -> str:
    return f"""ro as (select condition, correct, rank() over (partition by condition order by score) + (count(*) over (partition by condition, score) - 1) / 2::double as r from {source}),
roc as (
  select condition, case when count(*) filter (correct) > 0 and count(*) filter (not correct) > 0 then
    (sum(r) filter (correct) - count(*) filter (correct) * (count(*) filter (correct) + 1) / 2::double) / (count(*) filter (correct) * count(*) filter (not correct))::double end as auroc
  from ro group by condition)"""


_NT = """no as (
  select condition, correct, row_number() over w as k, sum((not correct)::int) over (w rows unbounded preceding) as e from sc window w as (partition by condition order by score, seq)),
ant as (select condition, case when bool_or(correct) and not bool_and(correct) then avg(e / k::double) filter (not correct) end as auc_nt from no group by condition)"""


def _ece(source: str = "sc", out: str = "ec") -> str:
    return f"""{out}b as (
  select condition, case when score between 0 and 1 then greatest(0, ceil(score * 10) - 1) end as bin, count(*) as n, avg(score) as c, avg(correct::int) as a from {source} group by 1, 2),
{out} as (select condition, sum(case when bin is not null then n * abs(c - a) else 0 end) / sum(n) as ece from {out}b group by condition)"""


def _nce(source: str = "sc", out: str = "nc") -> str:
    return f"""{out}b as (
  select condition, avg(correct::int) as base, -avg(case when correct then ln(least(greatest(score, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) end) as model
  from {source} group by condition),
{out} as (
  select condition, case when base > 0 and base < 1 then (-(base * ln(base) + (1 - base) * ln(1 - base)) - model) / -(base * ln(base) + (1 - base) * ln(1 - base)) end as nce from {out}b)"""


_CURVE = """rc as (
  select condition, seq, row_number() over w as rank, row_number() over w / (count(*) over (partition by condition))::double as coverage,
    sum((not correct)::int) over (w rows unbounded preceding) / (row_number() over w)::double as risk
  from sc window w as (partition by condition order by score desc, seq))"""
_RISKS = "tr(max_risk) as (values " + ", ".join(f"({r}::double)" for r in RISKS) + ")"
_POINTS = f"""{_RISKS},
su as (select condition, score, count(*) as n, sum((not correct)::int) as e from sc group by 1, 2),
cu as (select condition, score, sum(n) over w as kept, sum(e) over w / (sum(n) over w)::double as risk, sum(n) over (partition by condition) as total from su window w as (partition by condition order by score desc)),
pt as (
  select condition, max_risk, min(score) filter (risk <= max_risk) as threshold, coalesce(min_by(kept / total::double, score) filter (risk <= max_risk), 0) as coverage,
    coalesce(min_by(risk, score) filter (risk <= max_risk), 0) as realized_risk
  from cu cross join tr group by 1, 2)"""


def _fit(y: str = "(right_n + 1) / (n + 2)::double", source: str = "sc", at: str = "") -> str:
    """Common table expressions of the isotonic fit of a source; the last, fit, has condition, n_fit, k, x and y."""
    return f"""o{at} as (select condition, row_number() over (partition by condition order by score, seq) as t, score, correct::int as c from {source}),
s{at} as (select *, sum(c) over (partition by condition order by t) as cs from o{at}),
p{at} as (select a.condition, a.t as i, b.t as k, (b.cs - a.cs + a.c) / (b.t - a.t + 1)::double as m from s{at} a join s{at} b on a.condition = b.condition and b.t >= a.t),
q{at} as (select condition, i, k as t, min(m) over (partition by condition, i order by k desc) as m from p{at}),
f{at} as (select condition, t, round(max(m), 12) as y from q{at} group by 1, 2),
b{at} as (select condition, y, max(t) as t, max(score) as x, count(*) as n, sum(c) as right_n from f{at} join s{at} using (condition, t) group by 1, 2),
z{at} as (select condition, sum(n) over (partition by condition) as n_fit, t, x, {y} as y from b{at}),
g{at} as (select *, sum(case when abs(y - prev) < 1e-12 then 0 else 1 end) over (partition by condition order by t) as run from (select *, lag(y) over (partition by condition order by t) as prev from z{at})),
fit{at} as (select condition, n_fit::bigint as n_fit, (row_number() over (partition by condition order by run) - 1)::int as k, max(x) as x, max_by(y, t) as y from g{at} group by condition, n_fit, run)"""


def _calibrated(source: str, out: str) -> str:
    """The pairs of a source with their calibrated scores, by the knots in fit."""
    return f"""kn as (select *, lead(x) over w as x1, lead(y) over w as y1 from fit window w as (partition by condition order by x)),
{out} as (select * replace ({B.predict_sql("score", f"{source}.condition")} as score) from {source} where condition in (select condition from kn))"""


_KNOTS = " select condition, n_fit, k, round(x, 6) as x, round(y, 6) as y from fit"
_PAIRS = "sq as (select (['clean', '10', '0', 'none'])[seq % 4 + 1] as condition, seq, score, correct from sc)"

ORACLE_SQL = {
    "auroc_by_lang": f"with {B.SCORED}, {_auroc()} select condition, round(auroc, 6) as auroc from roc",
    "auc_nt_by_lang": f"with {B.SCORED}, {_NT} select condition, round(auc_nt, 6) as auc_nt from ant",
    "ece_by_lang": f"with {B.SCORED}, {_ece()} select condition, round(ece, 6) as ece from ec",
    "nce_by_lang": f"with {B.SCORED}, {_nce()} select condition, round(nce, 6) as nce from nc",
    "risk_coverage_curve": f"with {B.SCORED}, {_CURVE} select condition, seq, rank, round(coverage, 6) as coverage, round(risk, 6) as risk from rc",
    "aurc_by_lang": f"with {B.SCORED}, {_CURVE} select condition, round(avg(risk), 6) as aurc from rc group by 1",
    "metric_summary": f"""with {B.SCORED}, {_auroc()}, {_NT}, {_ece()}, {_nce()}, {_CURVE}, ar as (select condition, avg(risk) as aurc from rc group by 1)
      select condition, count(*) as n, round(avg(correct::int), 6) as accuracy, round(avg(score), 6) as mean_score, round(any_value(auroc), 6) as auroc, round(any_value(auc_nt), 6) as auc_nt,
        round(any_value(ece), 6) as ece, round(any_value(nce), 6) as nce, round(any_value(aurc), 6) as aurc
      from sc join roc using (condition) join ant using (condition) join ec using (condition) join nc using (condition) join ar using (condition) group by condition""",
    "gate_threshold_sweep": f"""with {B.SEGMENTS}, c as (select utt_id % 6 as level, least(1, exp(avg_logprob)) as conf, no_speech_prob from sg)
      select level, count(*) as segments, round(min(conf), 6) as conf_min, round(avg(conf), 6) as conf_mean, round(max(conf), 6) as conf_max, round(max(no_speech_prob), 6) as max_no_speech,
        {", ".join(f"count(*) filter (conf < 0.{t}::double) as below_{t}" for t in (55, 65, 75, 85, 95))} from c group by level""",
    "risk_threshold": f"with {B.SCORED}, {_POINTS} select condition, round(max_risk, 6) as max_risk, round(threshold, 6) as threshold, round(coverage, 6) as coverage, round(realized_risk, 6) as realized_risk from pt",
    "coverage_at_risk_matrix": f"""with {B.SCORED}, {_POINTS} select condition,
      {", ".join(f"round(max(coverage) filter (max_risk = {r}::double), 6) as coverage_{round(r * 1000)}" for r in RISKS)} from pt group by condition""",
    "interleaved_split": f"with {B.SCORED} select *, (row_number() over (partition by condition order by seq) - 1) % 2 = 1 as held_out from sc",
    "isotonic_fit_raw": f"with {B.SCORED}, {_fit('y')}{_KNOTS}",
    "isotonic_fit_smoothed": f"with {B.SCORED}, {_fit()}{_KNOTS}",
    "operating_points": f"""with {B.SCORED}, {_fit()}, {_calibrated("sc", "ca")},
      su as (select condition, score, count(*) as n, sum((not correct)::int) as e from (select condition, round(score, 12) as score, correct from ca) group by 1, 2),
      cu as (select condition, score, sum(n) over w as kept, sum(e) over w / (sum(n) over w)::double as risk, sum(n) over (partition by condition) as total from su window w as (partition by condition order by score desc))
      select condition, any_value(total)::bigint as n_fit, round(coalesce(min(score) filter (risk <= 0.15), 1.1), 6) as threshold, 0.15::double as target_risk,
        round(coalesce(min_by(kept / total::double, score) filter (risk <= 0.15), 0), 6) as coverage, round(coalesce(min_by(risk, score) filter (risk <= 0.15), 0), 6) as realized_risk
      from cu group by condition""",
    "held_out_report": f"""with {B.SCORED}, ha as (select *, (row_number() over (partition by condition order by seq) - 1) % 2 = 1 as held_out from sc),
      he as (select * from ha where held_out), fi as (select * from ha where not held_out), {_fit(source="fi")}, {_calibrated("he", "ca")},
      {_auroc("he")}, {_ece("he", "er")}, {_nce("he", "nr")}, {_ece("ca", "ek")}, {_nce("ca", "nk")}
      select condition, round(auroc, 6) as auroc, round(er.ece, 6) as ece_raw, round(nr.nce, 6) as nce_raw, round(ek.ece, 6) as ece_calibrated, round(nk.nce, 6) as nce_calibrated
      from roc join er using (condition) join nr using (condition) join ek using (condition) join nk using (condition)""",
    "policy_apply": f"""with {B.SCORED}, {_PAIRS}, {B.POLICIES_SQL}, v as (select sq.condition, seq, threshold, {B.predict_sql("score", "sq.condition")} as calibrated from sq join po using (condition))
      select condition, seq, round(calibrated, 6) as calibrated, calibrated >= threshold as accept from v""",
    "policy_transfer_own_fit": f"""with {B.SCORED}, {_PAIRS}, {B.POLICIES_SQL.replace("kn as", "pk as")},
      v as (select sq.condition, correct, threshold, target_risk, {B.predict_sql("score", "sq.condition").replace("from kn where kn.", "from pk where pk.")} as score from sq join po using (condition)), {_ece("v")},
      t as (select condition, target_risk, count(*) as n, count(*) filter (score >= threshold) as accepted, sum((not correct)::int) filter (score >= threshold) as errors from v group by 1, 2),
      {_fit(source="sq")}, {_calibrated("sq", "ca")}, {_ece("ca", "eo")}, {_auroc("sq")}
      select condition, target_risk, accepted, round(errors / nullif(accepted, 0)::double, 6) as delivered, round(accepted / n::double, 6) as coverage, round(ec.ece, 6) as ece_transferred,
        case when accepted = 0 then 'accepts nothing' when errors / accepted::double <= target_risk * 1.5::double then 'holds' else 'BREAKS' end as verdict,
        round(eo.ece, 6) as ece_own, round(auroc, 6) as auroc
      from t join ec using (condition) join eo using (condition) join roc using (condition)""",
    "policy_transfer": f"""with {B.SCORED}, {_PAIRS}, {B.POLICIES_SQL},
      v as (select sq.condition, correct, threshold, target_risk, {B.predict_sql("score", "sq.condition")} as score from sq join po using (condition)), {_ece("v")},
      t as (select condition, target_risk, count(*) as n, count(*) filter (score >= threshold) as accepted, sum((not correct)::int) filter (score >= threshold) as errors from v group by 1, 2)
      select condition, target_risk, accepted, round(errors / nullif(accepted, 0)::double, 6) as delivered, round(accepted / n::double, 6) as coverage, round(ece, 6) as ece_transferred,
        case when accepted = 0 then 'accepts nothing' when errors / accepted::double <= target_risk * 1.5::double then 'holds' else 'BREAKS' end as verdict
      from t join ec using (condition)""",
}
