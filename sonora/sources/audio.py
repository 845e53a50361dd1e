"""Audio files to canonical clips."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonora.operators import signal as S

Decoder = Callable[[bytes], tuple[np.ndarray, int]]


def pcm_wave(content: bytes) -> tuple[np.ndarray, int]:
    """Samples [frame, channel] in [-1, 1] and the rate of a PCM WAV of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float32) / 0x800000 - 1
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels), rate


def wave_bytes(samples: np.ndarray, rate: int = S.TARGET_RATE) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def decoded(files: DataFrame, decoder: Decoder = pcm_wave, fallback: Decoder | None = None, by_axis: int | None = None) -> DataFrame:
    """(path, content) to (path, samples, sample_rate, backend, error): mono at 16 kHz.

    A file that the decoder cannot read goes to the fallback; one that neither reads keeps its row, with an
    error and null samples. by_axis: average that axis of [frame, channel]; None: the shorter one.
    """
    schema = T.StructType.fromDDL("path string, samples array<float>, sample_rate int, backend string, error string")
    arrow = to_arrow_schema(schema)

    def one(path: str, content: bytes) -> tuple:
        error = None
        for name, fn in (("decoder", decoder), ("fallback", fallback)):
            if fn is None:
                continue
            try:
                x, rate = fn(content)
                if x.ndim > 1:
                    x = x.mean(axis=by_axis if by_axis is not None else 1 if x.shape[1] <= x.shape[0] else 0)
                return path, S.resample_array(x, rate), S.TARGET_RATE, name, None
            except Exception as e:  # noqa: BLE001  any container may be damaged in any way
                error = f"{type(e).__name__}: {e}"
        return path, None, None, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4):
                part = batch.slice(at, 4).to_pydict()
                rows = [one(p, c) for p, c in zip(part["path"], part["content"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, **how) -> DataFrame:
    """All audio files under a path."""
    return decoded(spark.read.format("binaryFile").load(path), **how)


def corpus(table: DataFrame, text: str = "text", audio: str = "audio", meta: tuple[str, ...] = ("accent", "l1", "speaker"), **how) -> DataFrame:
    """A table with a binary (or struct of bytes and path) audio column to utterances with a map of metadata.

    Several channels are averaged over frames' second axis. Unknown metadata is `?`.
    """
    kind = table.schema[audio].dataType
    content = F.col(f"{audio}.bytes") if isinstance(kind, T.StructType) else F.col(audio)
    keyed = table.withColumn("path", F.monotonically_increasing_id().cast("string")).withColumn("content", content)
    known = [c for c in meta if c in table.columns]
    facts = F.create_map(*[x for c in known for x in (F.lit(c), F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("?")))]) if known else F.create_map().cast("map<string,string>")
    # The decoder gets what belongs to a clip in its key, so that no join brings it back.
    packed = keyed.withColumn("path", F.to_json(F.struct(F.col("path").alias("id"), F.trim(F.col(text)).alias("reference"), facts.alias("meta"))))
    out = decoded(packed.select("path", "content"), by_axis=1, **how)
    parsed = F.from_json("path", "id long, reference string, meta map<string,string>")
    return out.withColumn("key", parsed).select(F.col("key.id").alias("utt_id"), "samples", "sample_rate", "key.reference", "key.meta", "error").withColumn("duration_s", F.size("samples") / F.col("sample_rate"))


#: Fixed value: the accent of read speech.
READ_ACCENT = "read/US"


def read_speech(table: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("id",), **how) -> DataFrame:
    """A table of read speech to utterances of one accent.

    limit takes the first ones by the order columns, which are unique and not null; they are chosen without their audio.
    """
    if limit is not None:
        table = table.join(table.select(*order).orderBy(*order).limit(limit), list(order), "left_semi")
    return corpus(table.withColumn("accent", F.lit(READ_ACCENT)), meta=("accent",), **how)


def read_corpus(spark: SparkSession, name: str, path: str, readers: dict | None = None, limit: int | None = None) -> DataFrame:
    """A corpus by its name: `read` (read speech, its first `limit` utterances by id) or `accented` (conversations)."""
    if limit is not None and name != "read":
        raise ValueError("only read speech has a limit")
    known = {"read": lambda t: read_speech(t, limit), "accented": corpus} | (readers or {})
    if name not in known:
        raise ValueError(f"unknown corpus {name!r}; there are {sorted(known)}")
    return known[name](spark.read.parquet(path))
