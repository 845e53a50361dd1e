"""Sample arrays: mono, resampling, normalisation, spectra, mel features and noise mixing.

What is arithmetic on a clip's array stays in SQL; Fourier transforms, resampling and random noise are numpy
functions over Arrow batches, a clip at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TARGET_RATE = 16000
N_FFT, HOP, N_MELS = 400, 160, 80
PEAK, SILENT = 0.95, 1e-8


def mono(channels: Column) -> Column:
    """array<array<float>> to one array: the mean over the shorter axis, the inner one if both are equal."""
    outer, inner = F.size(channels), F.size(channels[0])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
    by_inner = F.transform(channels, mean)
    by_outer = F.transform(F.sequence(F.lit(0), inner - 1), lambda i: mean(F.transform(channels, lambda c: c[i])))
    return F.when(outer == 0, F.array().cast("array<double>")).when(inner <= outer, by_inner).otherwise(by_outer)


def peak_normalized(samples: Column, peak: float = PEAK) -> Column:
    """Scaled to the peak; silence stays."""
    most = F.array_max(F.transform(samples, lambda v: F.abs(v)))
    return F.when(most.isNull() | (most < SILENT), samples).otherwise(F.transform(samples, lambda v: (v * (peak / most)).cast("float")))


def _per_clip(clips: DataFrame, fn: Callable[..., object], inputs: list[str], out: str, kind: str) -> DataFrame:
    """clips with a column of fn's result on the inputs of each; null where an input is null."""
    schema = T.StructType([*[f for f in clips.schema.fields if f.name != out], T.StructField(out, T.StructType.fromDDL(f"x {kind}")["x"].dataType)])
    arrow, names = to_arrow_schema(schema), clips.columns
    kept = [i for i, n in enumerate(names) if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                rows = zip(*[part.column(names.index(c)).to_pylist() for c in inputs], strict=True)
                found = [None if any(v is None for v in row) else fn(*row) for row in rows]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(found, arrow.field(out).type)], schema=arrow)

    return clips.mapInArrow(run, schema)


def resample_array(x, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """Rational resampling by a windowed sinc filter, in blocks, without the zeros between samples."""
    x = np.asarray(x, np.float64)
    if rate == target or not len(x):
        return x.astype(np.float32)
    up, down = target // gcd(target, rate), rate // gcd(target, rate)
    n_out, widest = -(-len(x) * up // down), max(up, down)
    half = 16 * widest
    taps = np.arange(-half, half + 1)
    kernel = np.sinc(taps / widest) * np.kaiser(2 * half + 1, 8.0)
    kernel *= up / kernel.sum()
    reach = half // up + 1
    padded = np.pad(x, (reach + 1, reach + 1))
    out = np.empty(n_out)
    for at in range(0, n_out, 4096):
        position = np.arange(at, min(at + 4096, n_out)) * down
        centre = position // up
        near = centre[:, None] + np.arange(-reach, reach + 1)
        tap = position[:, None] - near * up + half
        weight = np.where((tap >= 0) & (tap <= 2 * half), kernel[np.clip(tap, 0, 2 * half)], 0.0)
        out[at : at + len(position)] = (weight * padded[np.clip(near + reach + 1, 0, len(padded) - 1)]).sum(axis=1)
    return out.astype(np.float32)


def resampled(clips: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """(samples, sample_rate) at the target rate."""
    fixed = _per_clip(clips, lambda x, r: resample_array(x, r, target), ["samples", "sample_rate"], "samples", "array<float>")
    return fixed.withColumn("sample_rate", F.lit(target))


def canonical(clips: DataFrame, normalize: bool = False) -> DataFrame:
    """`channels` (array of arrays) and sample_rate to mono `samples` at 16 kHz."""
    one = clips.withColumn("samples", mono(F.col("channels")).cast("array<float>")).drop("channels")
    out = resampled(one)
    return out.withColumn("samples", peak_normalized(F.col("samples"))) if normalize else out


def power_array(x, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Power spectrogram [bin, frame] of centred frames under a symmetric Hann window."""
    padded = np.pad(np.asarray(x, np.float64), n_fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    return (np.abs(np.fft.rfft(frames * np.hanning(n_fft), axis=1)) ** 2).T


def mel_filters(spark, sample_rate: int = TARGET_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS) -> DataFrame:
    """(mel, bin, w): triangular filters of unit area, as a table; zero weights are left out."""
    top = 2595.0 * float(np.log10(1 + sample_rate / 2 / 700))
    hz = lambda k: (F.pow(F.lit(10.0), F.lit(top) * k / (n_mels + 1) / 2595.0) - 1) * 700.0
    mels = spark.range(n_mels).select(F.col("id").alias("mel"), hz(F.col("id")).alias("lo"), hz(F.col("id") + 1).alias("mid"), hz(F.col("id") + 2).alias("hi"))
    bins = mels.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))))
    f = F.col("bin") * (sample_rate / n_fft)
    rise, fall = (f - F.col("lo")) / F.greatest(F.col("mid") - F.col("lo"), F.lit(1e-9)), (F.col("hi") - f) / F.greatest(F.col("hi") - F.col("mid"), F.lit(1e-9))
    w = F.greatest(F.lit(0.0), F.least(rise, fall)) * 2.0 / (F.col("hi") - F.col("lo"))
    return bins.select("mel", "bin", w.alias("w")).filter("w > 0")


def filter_centers(spark, sample_rate: int = TARGET_RATE, n_mels: int = N_MELS) -> DataFrame:
    """(mel, hz) of the filters' centres."""
    top = 2595.0 * float(np.log10(1 + sample_rate / 2 / 700))
    hz = (F.pow(F.lit(10.0), F.lit(top) * (F.col("id") + 1) / (n_mels + 1) / 2595.0) - 1) * 700.0
    return spark.range(n_mels).select(F.col("id").alias("mel"), hz.alias("hz"))


def log_mel(clips: DataFrame, by: list[str], sample_rate: int = TARGET_RATE) -> DataFrame:
    """group, frame, mel and value: log energies, none lower than the clip's highest less 8.

    Spectra are made in Python by clip, and meet the filters in one matrix product; the rest is SQL.
    """
    filters = np.zeros((N_MELS, N_FFT // 2 + 1))
    for r in mel_filters(clips.sparkSession, sample_rate).collect():  # 80 filters of a few bins
        filters[r.mel, r.bin] = r.w

    def mel(x) -> list[list[float]]:
        return np.log10(np.maximum(filters @ power_array(x), 1e-10)).T.tolist()

    found = _per_clip(clips.filter(F.size("samples") > N_FFT // 2), mel, ["samples"], "mel", "array<array<double>>")
    top = F.array_max(F.transform("mel", lambda f: F.array_max(f)))
    frames = found.select(*by, top.alias("top"), F.posexplode("mel").alias("frame", "values"))
    values = frames.select(*by, "top", "frame", F.posexplode("values").alias("mel", "value"))
    return values.select(*by, "frame", "mel", F.greatest("value", F.col("top") - 8).alias("value"))


def scaled_noise(clean: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    want = np.mean(clean**2) / 10 ** (snr_db / 10)
    return clean + noise * np.sqrt(want / max(float(np.mean(noise**2)), 1e-12))


def white(n: int, rng: np.random.Generator, pool: list[np.ndarray]) -> np.ndarray:
    return rng.normal(0, 1, n)


def pink(n: int, rng: np.random.Generator, pool: list[np.ndarray]) -> np.ndarray:
    """Power falls as 1 / f; shaped in the frequency domain."""
    spectrum, f = np.fft.rfft(rng.normal(0, 1, n)), np.fft.rfftfreq(n)
    spectrum[1:] /= np.sqrt(f[1:])
    return np.fft.irfft(spectrum, n=n)


def babble(n: int, rng: np.random.Generator, pool: list[np.ndarray]) -> np.ndarray:
    """Six random voices of the pool at random places, repeated where short; white noise without a pool."""
    if not pool:
        return white(n, rng, pool)
    total = np.zeros(n)
    for _ in range(6):
        voice = np.asarray(pool[rng.integers(len(pool))], np.float64)
        voice = np.tile(voice, -(-n // len(voice)))
        start = int(rng.integers(0, max(1, len(voice) - n)))
        total += voice[start : start + n]
    return total


NOISES = {"white": white, "pink": pink, "babble": babble}


def mixed(clips: DataFrame, kind: str, key: str = "utt_id", snr: str = "snr_db", pool: list[np.ndarray] | None = None, seed: int = 0) -> DataFrame:
    """clips with noise of a kind added at `snr` dB; null snr leaves a clip as it is. Seeded by clip and level.

    pool: at most a few hundred voices, sent to the tasks.
    """
    if kind not in NOISES:
        raise ValueError(f"unknown noise {kind!r}; there are {sorted(NOISES)}")
    voices = [np.asarray(v, np.float32) for v in pool or [] if len(v)]

    def add(x, ident, level):
        clean = np.asarray(x, np.float64)
        if not len(clean):
            return x
        rng = np.random.default_rng([seed, int(ident) & 0xFFFFFFFF, int(round(level * 1000)) & 0xFFFFFFFF])
        return scaled_noise(clean, NOISES[kind](len(clean), rng, voices), level).astype(np.float32)

    noisy = _per_clip(clips.filter(F.col(snr).isNotNull()), add, ["samples", key, snr], "samples", "array<float>")
    return noisy.unionByName(clips.filter(F.col(snr).isNull()).select(*noisy.columns))


def denoised(clips: DataFrame, provider: Callable[[np.ndarray, int], np.ndarray] | None) -> tuple[DataFrame, bool]:
    """clips through a denoising function, and whether it was missing."""
    if provider is None:
        return clips, True
    return _per_clip(clips, lambda x, r: np.asarray(provider(np.asarray(x, np.float32), r), np.float32), ["samples", "sample_rate"], "samples", "array<float>"), False
