"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features are byte n-grams of the lower-cased whole text, white space as one space, hashed into
buckets. A text's vector is the average of its n-grams' embeddings; a linear layer and a softmax give
the languages. Embeddings and layer are trained together by stochastic gradient descent in numpy, on a
sample of labelled rows whose size is a parameter. A fifth of the sample sets a temperature, which
calibrates the scores, and the score under which a prediction is rejected.

Only text is an input of a prediction. Null texts and texts without a letter are `und` with score 0,
and always rejected; so is everything when no row is labelled. Texts are read whole, in slices. Ties go to the
language that comes first by code point. Null ids are not held out and are never in the sample. Repeated rows get equal
predictions; in the sample they count as often as they occur. Empty tables give no rows. Of other columns only
doc_id, lang (when fitting) and text are read; accepted() passes all columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonora.llm.common import ROWS_AT_ONCE, bounded_batches, map_rows

UNKNOWN = "und"
BUCKET_BITS = 15
GRAMS = (1, 2, 3, 4)
#: Bytes whose n-grams are held at once.
SLICE = 1 << 18
#: Bound on the labelled rows that a model is fitted on, over all languages.
SAMPLE_ROWS = 2400

_MULTIPLIER = np.uint32(0x9E3779B1)
#: The sample's shares travel as half floats, so many times themselves that small ones are kept.
_SCALE = 4096.0


def _clean(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" "


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, in slices of bounded size."""
    raw = np.frombuffer(_clean(text), np.uint8)
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE + max(GRAMS) - 1].astype(np.uint32)
        key = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            size = min(SLICE, len(raw) - at) if at + SLICE < len(raw) else len(part) - n + 1
            if size <= 0:
                break
            key = key[: len(part) - n + 1] << np.uint32(8) | part[n - 1 :]
            if n in GRAMS:
                yield ((key[:size] + np.uint32(n * 0x1000193)) * _MULTIPLIER >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    """Log-odds of each bucket by language (embeddings times layer), temperature and rejection."""

    languages: list[str]
    odds: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in buckets(text):
            total += self.odds[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def accepts(self, text: str | None) -> bool:
        language, score = self.predict(text)
        return language != UNKNOWN and score >= self.reject_below


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for found in buckets(text):
        counts += np.bincount(found, minlength=len(counts))
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(1, counts.sum())).astype(np.float32)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dimensions: int = 16, epochs: int = 12, rate: float = 8.0, reject_share: float = 0.002, seed: int = 7, scale: float = 1.0) -> Model:
    """Fits embeddings and layer by stochastic gradient descent; every fifth row calibrates.

    The rejection threshold is the score that all but reject_share of the rightly predicted
    calibration rows reach, at most a half. Shares are divided by scale.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, dimensions)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dimensions, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    own = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in rng.permutation(own):
            where, share = features[at][0], features[at][1].astype(np.float32) / scale
            vector = share @ table[where]
            error = _softmax(vector @ layer + bias)
            error[y[at]] -= 1
            back = layer @ error
            layer -= 0.02 * step * np.outer(vector, error)
            bias -= 0.002 * step * error
            table[where] -= step * share[:, None] * back
    odds = (table @ layer).astype(np.float32)
    model = Model(languages, odds, bias.astype(np.float64))
    rows = np.flatnonzero(held) if held.any() else own
    logits = np.array([features[i][1].astype(np.float32) / scale @ odds[features[i][0]] + bias for i in rows], np.float64)
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(rows)), y[rows]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = _softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[rows]]
    model.reject_below = float(min(0.5, np.quantile(right, reject_share))) if len(right) else 0.5
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on about rows / languages labelled rows of each language, at most `rows` in all.

    The sample is the rows of smallest hashed id, so reruns agree; held-out rows are never in it. The
    driver gets one count for each language and the sample's bucket shares.
    """
    known = docs.select(F.col("doc_id"), "lang", "text").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, rows / len(counts) / n)])
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    chosen = known.filter((F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))) < share[F.col("lang")])
    sample = chosen.orderBy(order, "doc_id", F.xxhash64("text"), "lang").limit(rows).select("lang", "text")

    def encode(batch: list[tuple]) -> list[tuple]:
        out = []
        for lang, text in batch:
            where, part = counted(text)
            if len(where):
                out.append((lang, where.astype(np.uint16).tobytes(), (part * _SCALE).astype(np.float16).tobytes()))
        return out

    found = map_rows(sample, encode, "lang string, buckets binary, shares binary").collect()
    features = [(np.frombuffer(r.buckets, np.uint16), np.frombuffer(r.shares, np.float16)) for r in found]
    return train(features, [r.lang for r in found], scale=_SCALE)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, lambda batch: [(i, h, *model.predict(t)) for i, h, t in batch], "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose language the model does not reject."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                yield part.filter(pa.array([model.accepts(t) for t in part.column(at).to_pylist()], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
