import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora import cli, providers
from sonora.analyzer import Analyzer
from sonora.operators import transcripts as R
from sonora.operators.calibration import fit_policies
from sonora.operators.metrics import summary
from sonora.schemas import SEGMENTS, DecodeConfig
from sonora.sources import policies as P
from sonora.sources import bundled, results
from sonora.streaming import scoring

RATE = 16000


def transcriber(cfg):
    def run(samples, rate, language):
        words = [{"word": " good", "start": 0.011, "end": 0.5, "prob": 0.98012}, {"word": " bad", "start": 0.5, "end": 1.0, "prob": 0.05}]
        yield 0, 0.0, 1.004, f" hello {language} ", -0.01, 0.1, words
        yield 1, 1.0, 2.0, " world ", -1.0, 0.1, words[:1]
        yield 2, 2.0, 3.0, "quiet", -0.01, 0.55, None

    return run


def detector():
    return lambda samples, rate, chunk: [(chunk, "en", 0.9), (chunk, "nn", 0.1)]


def clip(seconds=4.0):
    rng = np.random.default_rng(0)
    y = rng.normal(0, 1e-3, int(seconds * RATE))
    y[RATE : int(3 * RATE)] += 0.3 * np.sin(np.arange(len(y[RATE : int(3 * RATE)])) / 10)
    return [float(v) for v in y]


def policies(spark):
    rows = [("clean", i, i / 99, i > 30) for i in range(100)]
    fitted = fit_policies(spark.createDataFrame(rows, "condition string, seq long, score double, correct boolean"), ["condition"], 0.05)
    return fitted.unionByName(fitted.withColumns({"condition": F.lit("0"), "threshold": F.lit(1.1)})).unionByName(fitted.withColumn("condition", F.lit("-5")))


def clips(spark, *rows):
    return spark.createDataFrame([(i, y, RATE, lang) for i, (y, lang) in enumerate(rows)], "utt_id long, samples array<float>, sample_rate int, language string")


def test_performance(spark):
    df = spark.createDataFrame([(2.0, 4.0), (1.0, 0.0)], "e double, d double")
    assert [(r[0].total_time_s, r[0].rtf) for r in df.select(R.performance(F.col("e"), F.col("d"))).collect()] == [(2.0, 0.5), (1.0, None)]


def test_gate(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, " a ", -0.1, 0.55, None), (1, 1, 1.0, 2.0, "b", -0.2, 0.1, None), (1, 2, 2.0, 3.0, "c", 0.5, 0.0, None)], SEGMENTS)
    got = R.gated(df).orderBy("seg_id").collect()
    assert [r.flagged for r in got] == [True, True, False] and got[2].confidence == 1 and got[0].text == "a"


def test_analysis(spark):
    known = policies(spark)
    lens = Analyzer(transcriber, detector, policies=known)
    out = {r.utt_id: r for r in lens.analyze(clips(spark, (clip(), None), (clip(), "de"), ([0.0] * 1600, None)), DecodeConfig(word_timestamps=True), "clean").collect()}
    a = out[0]
    assert a.language.code == "en" and a.language.method == "chunk_vote" and a.audio.vad_backend == "energy" and a.audio.duration_s == 4
    assert a.audio.speech_ratio == pytest.approx(0.5, abs=0.05)
    assert a.transcript.text == "hello en world quiet" and a.transcript.flagged_segments == 2
    assert "flagged_segments=2/3" in a.warnings
    first = a.transcript.segments[0]
    assert [w.accept for w in first.words] == [True, False] and first.words[0].prob == 0.98 and first.end == 1.0
    assert (a.reliability.words, a.reliability.accepted, a.reliability.coverage, a.reliability.selected_by) == (3, 2, 0.667, "explicit")
    assert out[1].language.method == "forced" and out[1].transcript.text.startswith("hello de") and out[1].language.probability == 1
    assert out[2].language.probability == 0 and out[2].warnings[:2] == ["short_clip=0.10", "language_uncertain"]
    text = cli.report(lens.analyze(clips(spark, (clip(), None)), DecodeConfig(word_timestamps=True), "clean")).first().report
    assert text.startswith("# English, 0.") and "\t?\tquiet" in text and "2 of 3 words pass the policy clean (explicit)" in text and "good {bad}" in text and "note: 2/3 segments are doubtful" in text


def test_policies_of_calls(spark):
    known = policies(spark)
    lens = Analyzer(transcriber, detector, policies=known)
    one = clips(spark, (clip(), None))
    plain = lens.analyze(one).first()
    assert plain.reliability is None and plain.transcript.segments[0].words is None
    missing = lens.analyze(one, policy="clean").first()
    assert missing.reliability is None and "words_missing" in missing.warnings
    auto = lens.analyze(one, DecodeConfig(word_timestamps=True), "auto").first()
    assert auto.reliability.condition == "clean" and auto.reliability.selected_by.startswith("auto (SNR ")
    silent = lens.analyze(clips(spark, ([0.0] * RATE * 3, None)), DecodeConfig(word_timestamps=True), "auto").first()
    assert silent.reliability is None and "noise_unknown" in silent.warnings
    held = Analyzer(transcriber, detector, policies=known, policy="0").analyze(one, DecodeConfig(word_timestamps=True)).first()
    assert held.reliability.accepted == 0 and held.reliability.threshold == 1.1
    loud = Analyzer(transcriber, detector, denoise=True).analyze(one).first()
    assert "denoiser_missing" in loud.warnings


def test_models_see_a_clip_once(spark, tmp_path):
    def counted(name):
        with open(tmp_path / f"{name}{uuid.uuid4().hex}", "w"):
            pass

    def heard(cfg):
        run = transcriber(cfg)
        return lambda samples, rate, language: (counted("t"), list(run(samples, rate, language)))[1]

    def voted():
        run = detector()
        return lambda samples, rate, chunk: (counted(f"d{chunk}-"), run(samples, rate, chunk))[1]

    lens = Analyzer(heard, voted, policies=policies(spark))
    found = lens.analyze(clips(spark, (clip(), None), (clip(), None)), DecodeConfig(word_timestamps=True), "auto")
    assert found.count() == 2 and len(found.collect()) == 2
    assert len(list(tmp_path.glob("t*"))) == 2
    chunks = [p.name.split("-")[0] for p in tmp_path.glob("d*")]
    assert chunks and all(chunks.count(c) <= 2 for c in chunks)


def test_bundled_policies(spark):
    rows = bundled.policies(spark).orderBy("condition").collect()
    assert [r.condition for r in rows] == ["-5", "0", "10", "20", "5", "clean"]
    for r in rows:
        xs, ys = [k.x for k in r.knots], [k.y for k in r.knots]
        assert xs == sorted(xs) and 0 <= min(ys) and max(ys) <= 1 and r.target_risk == 0.02 and r.n_fit > 1000
        assert (r.coverage == 0) == (r.threshold == 1.1)


def test_policy_documents(spark, tmp_path):
    known = policies(spark)
    P.save(known, str(tmp_path / "p"))
    back = P.load(spark, str(tmp_path / "p"))
    assert sorted(map(str, back.select(*known.columns).collect())) == sorted(map(str, known.collect()))
    assert [r.condition for r in P.available(back).collect()] == ["-5", "0", "clean"]
    assert P.of_condition(back, "clean").count() == 1
    with pytest.raises(LookupError, match="clean"):
        P.of_condition(back, "7")
    (tmp_path / "one.json").write_text(json.dumps({"calibrator": {"knots_x": [0.1], "knots_y": [0.2]}, "threshold": 0.5, "target_risk": 0.02, "coverage": 1.0, "realized_risk": 0.0}, indent=2))
    row = P.load(spark, str(tmp_path / "one.json")).first()
    assert (row.n_fit, row.condition, row.notes, row.knots[0].x) == (0, "", "", 0.1)


def test_sinks(spark, tmp_path):
    found = Analyzer(transcriber, detector).analyze(clips(spark, (clip(), "en")))
    results.write_json(found, str(tmp_path / "j"))
    results.write_text(found, str(tmp_path / "t"))
    row = json.loads(spark.read.text(str(tmp_path / "j")).first()[0])
    assert set(row) == {"utt_id", "audio", "language", "transcript", "performance", "warnings", "reliability"} and row["reliability"] is None
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "hello en world quiet"
    pairs = spark.createDataFrame([("clean", "word_prob", 1, 0.5, True)], "condition string, estimator string, seq long, score double, correct boolean")
    results.write_pairs(pairs, str(tmp_path / "s"))
    assert results.read_pairs(spark, str(tmp_path / "s")).count() == 1
    results.write_study(summary(pairs.drop("seq").withColumn("seq", F.lit(1)), ["condition", "estimator"]), str(tmp_path / "m"))
    study = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    assert study["condition"] == "clean" and study["estimators"]["word_prob"]["n"] == 1
    assert results.stamped(pairs, model="m").first().run_model == "m"


def test_estimators_and_pairs(spark):
    words = [{"word": "a", "start": 0.0, "end": 1.0, "prob": 0.9}, {"word": "b", "start": 0.0, "end": 1.0, "prob": 0.4}]
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "a b", -0.1, 0.2, words)], SEGMENTS).withColumn("confidence", F.lit(0.7))
    got = R.estimators(R.words(df, ["utt_id"]), ["utt_id"]).orderBy("pos").collect()
    assert [(r.word_prob, r.seg_conf, r.seg_min_word, r.speech_prob) for r in got] == [(0.9, 0.7, 0.4, 0.8), (0.4, 0.7, 0.4, 0.8)]
    labelled = R.estimators(R.words(df, ["utt_id"]), ["utt_id"]).withColumn("correct", F.when(F.col("pos") == 0, F.lit(True)))
    pairs = R.scored_pairs(labelled, [], ["utt_id", "seg_id", "pos"])
    assert sorted((r.estimator, r.score) for r in pairs.collect()) == [("seg_conf", 0.7), ("seg_min_word", 0.4), ("speech_prob", 0.8), ("word_prob", 0.9)]


def test_command_line_arguments():
    args = cli.arguments(["analyze", "x.wav", "--provider", "p", "--reliability", "auto"])
    assert args.beam == 5 and args.reliability == "auto" and not args.no_vad
    assert providers.resolved_device() == ("cpu", "int8") and providers.resolved_device(cuda_devices=1) == ("cuda", "float16")


def test_stream(spark, tmp_path):
    words = [{"word": "a", "start": 0.0, "end": 1.0, "prob": 0.99}, {"word": "b", "start": 0.0, "end": 1.0, "prob": 0.01}]
    from datetime import datetime

    rows = [(1, i, 0.0, 1.0, "a b", -0.1, 0.2, words) for i in range(4)]
    df = spark.createDataFrame(rows, SEGMENTS).withColumns({"condition": F.lit("clean"), "ts": F.lit(datetime(2026, 1, 1)) + F.make_interval(mins=F.col("seg_id"))})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = scoring.coverage(scoring.annotated(stream, policies(spark))).writeStream.format("memory").queryName("coverage").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("coverage").collect()
    assert len(got) == 4 and all((r.words, r.accepted) == (2, 1) for r in got)
