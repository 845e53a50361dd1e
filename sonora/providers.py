"""The seam to neural models: callables that turn clips into tables of fixed schemas.

A provider is made once a Python worker by its factory and gets a clip at a time. Without models, the
tables that such a provider would give can be read from storage instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonora.schemas import SEGMENTS, SPANS, VOTES, DecodeConfig

Clip = tuple[int, np.ndarray, int]


def _applied(clips: DataFrame, factory: Callable[[], Callable], schema: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    held: list[Callable] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(factory())
        for batch in batches:
            for at in range(0, batch.num_rows, 4):
                rows = []
                for utt_id, samples, rate, *more in zip(*[c.to_pylist() for c in batch.slice(at, 4).columns], strict=True):
                    if samples is not None:
                        rows += [(utt_id, *r) for r in held[0](np.asarray(samples, np.float32), rate, *more)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return clips.select("utt_id", "samples", "sample_rate", *extra).mapInArrow(run, kind)


def transcribed(clips: DataFrame, factory: Callable[[DecodeConfig], Callable], cfg: DecodeConfig = DecodeConfig()) -> DataFrame:
    """Segments of clips; the provider gets (samples, rate, language) and yields the fields after utt_id."""
    return _applied(clips, lambda: factory(cfg), SEGMENTS, ["language"])


def voted(chunks: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """Language votes; the provider gets (samples, rate, chunk) and yields (chunk, lang, p)."""
    return _applied(chunks, factory, VOTES, ["chunk"])


def speech_spans(clips: DataFrame, factory: Callable[[], Callable] | None, backend: str = "auto") -> tuple[DataFrame, str]:
    """Speech spans in seconds and the backend that gave them: a provider (neural), or frame energies.

    auto takes the provider if there is one whose factory works, else energies; neural insists on it.
    """
    from sonora.operators import voice

    if backend not in ("auto", "neural", "energy"):
        raise ValueError(f"unknown backend {backend!r}")
    if backend != "energy":
        try:
            if factory is None:
                raise LookupError("there is no neural provider")
            factory()
            return voice.merged(_applied(clips, factory, SPANS), ["utt_id"]), "neural"
        except Exception:
            if backend == "neural":
                raise
    return voice.clip_segments(clips, ["utt_id"]), "energy"


def resolved_device(device: str = "auto", compute: str = "auto", cuda_devices: int = 0) -> tuple[str, str]:
    """auto: cuda where there is a device, else cpu; halves on cuda, else 8-bit integers."""
    if device == "auto":
        device = "cuda" if cuda_devices > 0 else "cpu"
    if compute == "auto":
        compute = "float16" if device == "cuda" else "int8"
    return device, compute
