import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora import providers
from sonora.functions import distributions as D
from sonora.operators import language as L
from sonora.operators import signal as S
from sonora.operators import voice as V
from sonora.plans import signals
from sonora.sources import audio

RATE = 16000


def clips(spark, *arrays, rate=RATE):
    return spark.createDataFrame([(i, [float(v) for v in a], rate) for i, a in enumerate(arrays)], "utt_id long, samples array<float>, sample_rate int")


def noisy_tone(rng, snr_db=None):
    t = np.arange(2 * RATE) / RATE
    y = np.concatenate([np.zeros(RATE), 0.4 * np.sin(2 * np.pi * 180 * t), np.zeros(RATE)])
    if snr_db is None:
        return y
    power = np.mean(y[RATE : 3 * RATE] ** 2)
    return y + rng.normal(0, np.sqrt(power / 10 ** (snr_db / 10)), len(y))


def test_distributions(spark):
    rows = [([0.0] * 8,), ([100.0] + [-900.0] * 7,), ([1.0, 2.0, 3.0],), ([5.0],)]
    df = spark.createDataFrame(rows, "x array<double>").withColumn("lp", D.log_softmax(F.col("x")))
    out = df.select("lp", D.shannon_entropy(F.col("lp")).alias("h"), D.renyi_entropy(F.col("lp")).alias("r"), D.renyi_entropy(F.col("lp"), 1.0).alias("r1"), D.normalized_entropy(F.col("lp")).alias("n")).collect()
    for (x,), r in zip(rows, out, strict=True):
        p = np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
        h = -sum(v * np.log(v) for v in p if v > 0)
        assert np.exp(r.lp).sum() == pytest.approx(1) and r.h == pytest.approx(h) == pytest.approx(r.r1)
        assert r.r == pytest.approx(-np.log((p**2).sum())) and r.n == pytest.approx(1 - h / np.log(len(x)) if len(x) > 1 else 1)
    with pytest.raises(ValueError):
        D.renyi_entropy(F.col("lp"), 0)
    maps = spark.createDataFrame([({"a": 0.5, "b": 0.5, "c": 0.0},)], "m map<string,double>")
    assert maps.select(D.map_entropy(F.col("m"))).first()[0] == pytest.approx(np.log(2))


def test_fusion_and_detection(spark):
    votes = [(1, 0, "en", 0.6), (1, 0, "nn", 0.4), (1, 1, "en", 0.5), (1, 1, "nn", 0.1), (1, 2, "en", 0.9), (2, 0, "de", 0.4), (2, 0, "fr", 0.4), (2, 0, "es", 0.2)]
    df = spark.createDataFrame(votes, "u int, chunk int, lang string, p double")
    logs = {"en": np.log([0.6 + 1e-6, 0.5 + 1e-6, 0.9 + 1e-6]).sum(), "nn": np.log([0.4 + 1e-6, 0.1 + 1e-6, 1e-6]).sum()}
    z = sum(np.exp(v) for v in logs.values())
    got = {(r.u, r.lang): r.p for r in L.fused(df, ["u"]).collect()}
    assert got[1, "nn"] == pytest.approx(np.exp(logs["nn"]) / z) and got[1, "en"] + got[1, "nn"] == pytest.approx(1)
    speech = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None)], "u int, speech_s double")
    out = {r.u: r for r in L.detected(df, speech, ["u"]).collect()}
    assert out[1].code == "en" and out[1].name == "English" and not out[1].low_confidence and out[1].chunks_used == 3
    assert out[2].code == "de" and out[2].low_confidence and [t.code for t in out[2].top] == ["de", "fr", "es"]
    assert (out[3].code, out[3].probability, out[3].low_confidence, out[3].top) == ("en", 0, True, [])
    given = spark.createDataFrame([(1, "xx"), (2, None)], "u int, language string")
    forced = L.forced(given, ["u"]).collect()
    assert [(r.u, r.name, r.probability, r.method) for r in forced] == [(1, "xx", 1, "forced")]


def test_language_windows(spark):
    df = spark.createDataFrame([(100 * RATE, [(5.0, 10.0), (50.0, 60.0), (80.0, 99.0)]), (10 * RATE, None), (100 * RATE, [])], "n long, s array<struct<start:double,end:double>>")
    got = [[(w.start / RATE, w.end / RATE) for w in r[0]] for r in df.select(L.windows(F.col("n"), F.lit(RATE), F.col("s"))).collect()]
    assert got == [[(5, 35), (50, 80), (69, 99)], [(0, 10)], [(0, 30), (35, 65), (70, 100)]]


def test_voice_activity(spark):
    rng = np.random.default_rng(1)
    quiet = lambda: rng.normal(0, 1e-4, RATE)
    df = clips(spark, np.r_[quiet(), rng.normal(0, 0.3, RATE), quiet()], quiet()[:100], noisy_tone(rng)[: 3 * RATE])
    spans = V.energy_segments(V.samples(df, ["utt_id"]), ["utt_id"])
    got = sorted((r.utt_id, r.start, r.end) for r in spans.collect())
    assert [g[0] for g in got] == [0, 2]
    assert got[0][1:] == pytest.approx((1, 2), abs=0.06) and got[1][1:] == pytest.approx((1, 3), abs=0.06)
    fallback, backend = providers.speech_spans(df, None)
    assert backend == "energy" and fallback.count() == 2
    with pytest.raises(LookupError):
        providers.speech_spans(df, None, "neural")
    neural, backend = providers.speech_spans(df, lambda: lambda x, r: [(0.0, 0.5), (0.6, 0.7), (2.0, 2.1)])
    assert backend == "neural" and sorted((r.start, r.end) for r in neural.filter("utt_id = 0").collect()) == [(0.0, 0.7), (2.0, 2.1)]


def test_arrays_give_what_rows_give(spark):
    rng = np.random.default_rng(5)
    made = [noisy_tone(rng, 5), rng.normal(0, 0.2, RATE + 77), np.zeros(RATE), rng.normal(0, 0.1, 479), np.zeros(0), np.r_[np.zeros(RATE), noisy_tone(rng)]]
    df, by = clips(spark, *made), ["utt_id"]
    spans = [(i, a, b) for i in range(5) for a, b in ((0.2, 0.5), (0.5, 0.8), (0.7, 1.1), (2.0, 9.0))] + [(0, -1.0, 0.1), (1, 0.1, 0.1), (7, 0.0, 1.0)]
    table = spark.createDataFrame(spans, "utt_id long, start double, end double")
    plain = lambda found: {tuple(r)[:-1]: pytest.approx(r[-1], abs=1e-6) for r in found.collect()}
    for a, b in (
        (V.clip_frames(df, by, 480), V.frame_energies(V.samples(df, by), by, 480)),
        (V.clip_segments(df, by), V.energy_segments(V.samples(df, by), by)),
        (V.clip_snr(df, table, by), V.snr(V.samples(df, by), table, by)),
    ):
        want = plain(b)
        assert want and {tuple(r)[:-1]: r[-1] for r in a.collect()} == want
    assert V.clip_segments(df.limit(0), by).count() == V.clip_snr(df.limit(0), table, by).count() == 0
    nulls = spark.createDataFrame([(1, None)], "utt_id long, samples array<float>")
    assert V.clip_segments(nulls, by).count() == V.clip_snr(nulls, table, by).count() == 0


def brute_runs(mask, hang):
    out, start, quiet = [], None, 0
    for i, on in enumerate(mask):
        if on:
            start, quiet = i if start is None else start, 0
        elif start is not None:
            quiet += 1
            if quiet > hang:
                out.append((start, i - quiet + 1))
                start = None
    return out + [(start, len(mask))] * (start is not None)


def test_runs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random(rng.integers(1, 40)) < 0.25 for _ in range(80)]
    rows = [(k, i, bool(v), len(m)) for k, m in enumerate(masks) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "k int, idx int, active boolean, n_frames int")
    got = sorted((r.k, r.start, r.end) for r in V.runs(df, ["k"], F.lit(1), 4).collect())
    assert got == [(k, a, b) for k, m in enumerate(masks) for a, b in brute_runs(m, 4)]


def test_snr_and_conditions(spark):
    rng = np.random.default_rng(0)
    levels = [20, 10, 5, 0, -5]
    df = clips(spark, *[noisy_tone(rng, s) for s in levels], noisy_tone(rng), np.zeros(RATE))
    spans = spark.createDataFrame([(i, a, b) for i in range(6) for a, b in ((1.0, 2.2), (2.0, 3.0))] + [(6, 0.0, 0.9)], "utt_id long, start double, end double")
    got = {r.utt_id: r.snr_db for r in V.snr(V.samples(df, ["utt_id"]), spans, ["utt_id"]).collect()}
    for i, s in enumerate(levels):
        assert got[i] == pytest.approx(s, abs=1)
    assert got[5] == 40 and got[6] is None
    known = spark.createDataFrame([(c,) for c in ("clean", "20", "10", "5", "0", "-5")], "condition string")
    cases = {38.0: "clean", 19.0: "20", 11.0: "10", 4.5: "5", 0.4: "0", -6.0: "-5", -30.0: "-5", 7.5: "5", 2.5: "0", 30.0: "20", float("nan"): None, None: None}
    table = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "u int, snr_db double")
    assert [r.condition for r in V.nearest_condition(table, ["u"], known).orderBy("u").collect()] == list(cases.values())
    ratio = V.speech_ratio(spans, spark.createDataFrame([(0, 4.0), (6, 0.0), (9, 1.0)], "utt_id long, duration_s double"), ["utt_id"])
    assert {r.utt_id: r.speech_ratio for r in ratio.collect()} == {0: pytest.approx(0.55), 6: 0, 9: 0}


def test_mono_and_peak(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [2.0, 4.0], [0.0, 0.0]],), ([[1.0, 2.0, 3.0], [3.0, 4.0, 5.0]],), ([[1.0, 3.0], [5.0, 7.0]],)], "c array<array<double>>")
    assert [r[0] for r in df.select(S.mono(F.col("c"))).collect()] == [[2.0, 3.0, 0.0], [2.0, 3.0, 4.0], [2.0, 6.0]]
    df = spark.createDataFrame([([0.1, -0.5],), ([0.0, 1e-9],), ([],)], "x array<double>")
    got = [r[0] for r in df.select(S.peak_normalized(F.col("x"))).collect()]
    assert got[0] == pytest.approx([0.19, -0.95]) and got[1] == [0.0, 1e-9] and got[2] == []


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000, 16000])
def test_resampling(rate):
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    y = S.resample_array(x, rate)
    assert abs(len(y) - RATE) <= 2
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(spectrum.argmax() * RATE / len(y) - 440) <= 2
    assert np.abs(y[2000:-2000]).max() == pytest.approx(1, abs=0.02)


def test_mel(spark):
    t = np.arange(RATE) / RATE
    df = clips(spark, np.sin(2 * np.pi * 1000 * t))
    out = np.zeros((101, 80))
    for r in S.log_mel(df, ["utt_id"]).collect():
        out[r.frame, r.mel] = r.value
    centers = [r.hz for r in S.filter_centers(spark).orderBy("mel").collect()]
    assert out.max() - out.min() <= 8 + 1e-9 and abs(out[50].argmax() - np.abs(np.array(centers) - 1000).argmin()) <= 1
    hz = spark.range(0, 8000, 500).select(F.col("id").cast("double").alias("f"), D.mel_to_hz(D.hz_to_mel(F.col("id").cast("double"))).alias("b"))
    assert all(r.b == pytest.approx(r.f, abs=1e-6) for r in hz.collect())
    area = S.mel_filters(spark).groupBy("mel").agg(F.sum("w").alias("w")).filter("mel > 40").collect()
    assert len(area) == 39 and all(r.w * 40 == pytest.approx(1, abs=0.15) for r in area)


@pytest.mark.parametrize("kind", list(S.NOISES))
def test_noise(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, 8000)
    df = clips(spark, x, x).withColumn("snr_db", F.when(F.col("utt_id") == 0, F.lit(5.0)))
    pool = [rng.normal(0, 1, 3000) for _ in range(3)]
    out = {r.utt_id: np.array(r.samples) for r in S.mixed(df, kind, pool=pool).collect()}
    assert 10 * np.log10(np.mean(x**2) / np.mean((out[0] - x) ** 2)) == pytest.approx(5, abs=0.1)
    assert out[1] == pytest.approx(x, abs=1e-6)
    with pytest.raises(ValueError):
        S.mixed(df, "other")


def test_audio_files(spark, tmp_path):
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    (tmp_path / "a.wav").write_bytes(audio.wave_bytes(tone, 8000))
    (tmp_path / "b.wav").write_bytes(b"no wave")
    got = {r.path.rsplit("/")[-1]: r for r in audio.read(spark, str(tmp_path)).collect()}
    assert abs(len(got["a.wav"].samples) - RATE) <= 2 and got["a.wav"].sample_rate == RATE and got["a.wav"].error is None
    assert got["b.wav"].samples is None and got["b.wav"].error
    both = audio.decoded(spark.createDataFrame([("x", b"raw")], "path string, content binary"), fallback=lambda b: (np.ones((20, 2)), RATE)).first()
    assert both.backend == "fallback" and both.samples == [1.0] * 20
    table = spark.createDataFrame([((tmp_path / "a.wav").read_bytes(), " the text ", "scots", None)], "audio binary, text string, accent string, speaker string")
    table.write.parquet(str(tmp_path / "c"))
    row = audio.read_corpus(spark, "accented", str(tmp_path / "c")).first()
    assert row.reference == "the text" and row.meta == {"accent": "scots", "speaker": "?"} and row.duration_s == pytest.approx(1, abs=0.01)
    with pytest.raises(ValueError):
        audio.read_corpus(spark, "other", "x")
    content = (tmp_path / "a.wav").read_bytes()
    spoken = spark.createDataFrame([(f"{k:02d}", content, f"text {k}") for k in (7, 3, 11, 0, 5)], "id string, audio binary, text string").repartition(3)
    spoken.write.parquet(str(tmp_path / "r"))
    rows = audio.read_corpus(spark, "read", str(tmp_path / "r"), limit=3).collect()
    assert sorted(r.reference for r in rows) == ["text 0", "text 3", "text 5"]
    assert {r.meta["accent"] for r in rows} == {"read/US"} and all(r.error is None for r in rows)
    assert audio.read_corpus(spark, "read", str(tmp_path / "r")).count() == 5
    with pytest.raises(ValueError):
        audio.read_corpus(spark, "accented", str(tmp_path / "c"), limit=1)


def test_noise_mix_has_voices_for_babble(spark, monkeypatch):
    pools, mixed = {}, S.mixed

    def seen(clips, kind, **more):
        pools[kind] = more.get("pool")
        return mixed(clips, kind, **more)

    monkeypatch.setattr(S, "mixed", seen)
    rows = signals.noise_mix(spark, "/root/testdata/sf0.001").collect()
    assert pools["babble"]
    own = {tuple(r.samples[: signals.POOL_SAMPLES]) for r in signals._clips(spark, "/root/testdata/sf0.001").collect()}
    assert 6 <= len(pools["babble"]) <= signals.POOL_VOICES and {tuple(v) for v in pools["babble"]} <= own
    assert pools == {"white": None, "pink": None, "babble": pools["babble"]}
    assert {r.kind for r in rows} == set(S.NOISES) and all(r.reached_db == pytest.approx(r.snr_db, abs=0.05) for r in rows)
