r"""Substring deduplication by hashed lines and passages.

Words are runs of anything but space and \t to \r, A-Z lower-cased. Units are the lines of at least UNIT
words and, as repeated passages need not respect lines, passages of UNIT words that begin at anchors: a
word is an anchor if the hash of it and the next word is the least of some WINDOW neighbouring ones.
Which words are anchors within a passage depends on the passage alone, so two texts that share any
UNIT + WINDOW words, wherever these stand, have a unit in common.

Digests (96 bits) are grouped over all documents, the occurrence of the smallest (doc_id, offset) is
kept (null ids last), and the others are removed; overlapping removed units become one span.

A repetition goes on to where it really ends: a second pass groups, by digest again, the PASSAGE-word windows at
every word (not only at anchors) that hold a unit near an end of such a span, and removes all but the first of
each. A repeated PASSAGE has a unit, so it lies in a span or reaches over an end of one: every run of PASSAGE
words or more that an earlier place has is removed whole. Spans are in code points of the original text. A repetition within a document counts too. Rows that repeat an id
and a text have their places in common, so neither is a repetition of the other. Null and empty texts
have no units. Ties cannot occur but between repeated rows. One document's words are held at once, whatever its length.
Empty tables give no rows. cleaned() carries all columns in a struct, so that they may have any names; a column
removed_spans is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sonora.llm.common import BROADCAST_ROWS, ROWS_AT_ONCE, bounded_batches, map_rows, written

#: Words of a unit, and neighbouring words of which one is an anchor: together 51, the least of "over 50".
UNIT, WINDOW = 39, 12
PASSAGE = UNIT + WINDOW

_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(factor), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of any span of words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []
        self._grow(4096)

    def _grow(self, n: int) -> None:
        self.up = [_powers(f, n) for f in _FACTORS]
        self.down = [_powers(pow(f, -1, 1 << 64), n) for f in _FACTORS]

    def spans(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up[0]) <= len(words):
            self._grow(2 * len(self.up[0]))
        out = []
        for up, down in zip(self.up, self.down, strict=True):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(words * up[: len(words)])))
            h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
            h = (h ^ h >> np.uint64(32)) * np.uint64(_FACTORS[1])
            out.append(h ^ h >> np.uint64(29))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


_ROLLING = _Rolling()


def anchors(words: np.ndarray) -> np.ndarray:
    """Positions that are the rightmost least of some WINDOW neighbouring ones."""
    pairs = words[:-1] * np.uint64(_FACTORS[0]) ^ words[1:]
    pairs = (pairs ^ pairs >> np.uint64(31)) * np.uint64(_FACTORS[1])
    if len(pairs) < WINDOW:
        return np.empty(0, np.int64)
    backwards = sliding_window_view(pairs, WINDOW)[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(backwards)) + WINDOW - 1 - backwards)


def _parsed(text: str | None) -> tuple[np.ndarray, ...] | None:
    """Hashes, starts and ends (code points) of a text's words, and the words where lines begin; None if there are under UNIT words."""
    raw = (text or "").encode("utf-8", "replace")
    split = raw.lower().split()
    if len(split) < UNIT:
        return None
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    words = np.fromiter(map(_WORDS.__getitem__, split), np.uint64, len(split))
    line = np.concatenate(([0], np.searchsorted(first, np.flatnonzero(data == 10)), [len(words)]))
    if len(raw) != len(text or ""):
        more = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
        first, last = first - more[first], last - more[last]
    return words, first, last, line


def _unit_words(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every unit, and the one after its last."""
    begin = anchors(words)
    begin = begin[begin + UNIT <= len(words)]
    long = np.flatnonzero(np.diff(line) >= UNIT)
    return np.concatenate((begin, line[long])), np.concatenate((begin + UNIT, line[long + 1]))


def units(text: str | None) -> tuple[np.ndarray, ...]:
    """Two parts of the digest, start and end (code points) of every unit of a text."""
    parsed = _parsed(text)
    if parsed is None:
        none = np.empty(0, np.int64)
        return none, none.astype(np.int32), none, none
    words, first, last, line = parsed
    begin, end = _unit_words(words, line)
    return *_ROLLING.spans(words, begin, end), first[begin], last[end - 1]


def _own_passages(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """The first words of every PASSAGE that repeats within a text, and of the earliest one like it."""
    begin = np.arange(len(words) - PASSAGE + 1)
    seen: dict[tuple[int, int], int] = {}
    high, low = _ROLLING.spans(words, begin, begin + PASSAGE)
    for at, digest in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
        earlier = seen.setdefault(digest, at)
        if earlier != at:
            yield at, earlier


def _emit(batch: list[tuple]) -> Iterable[tuple]:
    """The first occurrence of each unit in a document; others, which go in any case, joined to spans without a digest."""
    for doc_id, text_hash, text in batch:
        parsed = _parsed(text)
        if parsed is None:
            continue
        words, starts, stops, line = parsed
        begin, end = _unit_words(words, line)
        high, low = _ROLLING.spans(words, begin, end)
        columns = (starts[begin], stops[end - 1], high, low, begin, end)
        found = sorted(zip(*(x.tolist() for x in columns), strict=True))
        seen: dict[tuple[int, int], int] = {}
        several, heads, own = set(), [], []
        for start, stop, high, low, word, last in found:
            earlier = seen.setdefault((high, low), start)
            if earlier == start:
                heads.append((high, low, start, stop, word, last))
            else:
                several.add((high, low))
                own.append((start, stop, word, last, earlier, 1))
        for high, low, start, stop, word, last in heads:
            yield doc_id, text_hash, high, low, start, stop, word, last, (high, low) in several, None, 1
        if not own:
            continue
        for at, earlier in _own_passages(words):  # each holds a unit of own
            own.append((int(starts[at]), int(stops[at + PASSAGE - 1]), at, at + PASSAGE, int(starts[earlier]), 0))
        own.sort()
        span = None
        for start, stop, word, last, earlier, n in own:
            if span is not None and start <= span[1]:
                span[1], span[3], span[5] = max(span[1], stop), max(span[3], last), span[5] + n
                continue
            if span is not None:
                yield doc_id, text_hash, None, None, *span[:4], True, *span[4:]
            span = [start, stop, word, last, earlier, n]
        yield doc_id, text_hash, None, None, *span[:4], True, *span[4:]


def _emit_passages(batch: list[tuple]) -> Iterable[tuple]:
    """The first occurrence in a document of each PASSAGE that holds one of the units given by their digests."""
    for doc_id, text_hash, text, digests in batch:
        parsed = _parsed(text)
        if parsed is None or len(parsed[0]) < PASSAGE:
            continue
        words, starts, stops, line = parsed
        begin, end = _unit_words(words, line)
        high, low = _ROLLING.spans(words, begin, end)
        asked = {(d["high"], d["low"]) for d in digests}
        near = np.zeros(len(words) - PASSAGE + 1, bool)
        for at, last, digest in zip(begin.tolist(), end.tolist(), zip(high.tolist(), low.tolist(), strict=True), strict=True):
            if digest in asked:
                near[max(0, last - PASSAGE) : at + 1] = True
        begin = np.flatnonzero(near)
        high, low = _ROLLING.spans(words, begin, begin + PASSAGE)
        columns = (high, low, starts[begin], stops[begin + PASSAGE - 1])
        seen: set[tuple[int, int]] = set()
        for high, low, start, stop in zip(*(x.tolist() for x in columns), strict=True):
            if (high, low) not in seen:
                seen.add((high, low))
                yield doc_id, text_hash, high, low, start, stop


_DOCUMENT = ("doc_id", "text_hash")


def _later(found: DataFrame, *more: Column) -> DataFrame:
    """The rows whose digest has an earlier place, with that place as `first`, and more aggregates of the digest's rows."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    firsts = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("several"), *more).filter("several > 1").drop("several")
    return found.join(firsts, ["high", "low"]).filter(rank != F.col("first"))


def _spanned(again: DataFrame) -> DataFrame:
    """again with `span`, the number of the span that overlapping rows of a document make."""
    order = W.partitionBy(*_DOCUMENT).orderBy("start", "end", "first")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    again = again.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    return again.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))


def _at_ends(again: DataFrame) -> DataFrame:
    """Digests of the units that a PASSAGE over an end of a span can hold: those near an end, and those that repeat within a document."""
    span = W.partitionBy(*_DOCUMENT, "span")
    near = (F.col("word") - F.min("word").over(span) < WINDOW) | (F.max("last").over(span) - F.col("last") < WINDOW)
    marked = _spanned(again).withColumn("near", F.col("inner") | near)
    return marked.filter((F.col("last") - F.col("word") == UNIT) & F.col("near") & F.col("high").isNotNull()).select("high", "low").distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, n_units, first_doc_id and first_start of every span to remove.

    first_doc_id and first_start are where an earlier occurrence of the span's first unit or passage begins: the
    earliest of all, or the document's own first one. n_units counts the units that were matched.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, high long, low int, start int, end int, word int, last int, inner boolean, first_start int, n int"
    found = written(map_rows(source, _emit, schema))
    heads = found.filter("high is not null").drop("first_start", "n")
    # Half of the digest tells which units can repeat at all; only these are grouped by the whole.
    several = heads.groupBy("high").agg(F.count("*").alias("several")).filter("several > 1").select("high")
    met = written(heads.join(several, "high", "left_semi"))
    columns = ("doc_id", "text_hash", "high", "low", "start", "end", "word", "last", "inner", "first", "n")
    again = _later(met.withColumnRenamed("inner", "own"), F.max("own").alias("inner")).withColumn("n", F.lit(1)).select(*columns)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("first_start").alias("start"))
    again = written(again.union(found.filter("high is null").withColumn("first", own).select(*columns)).distinct())

    asked = met.join(written(_at_ends(again)), ["high", "low"], "left_semi")
    asked = written(asked.groupBy(*_DOCUMENT).agg(F.collect_set(F.struct("high", "low")).alias("digests")))
    keys = asked.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
    match = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash"))
    lists = asked.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "digests")
    if keys.count() <= BROADCAST_ROWS:  # else all texts are shuffled, not only those with such a unit
        source = source.join(F.broadcast(keys), match, "left_semi")
    texts = source.join(lists, match)
    passages = written(map_rows(texts.select(*_DOCUMENT, "text", "digests"), _emit_passages, "doc_id long, text_hash long, high long, low int, start int, end int"))
    wider = _later(passages).withColumn("n", F.lit(0)).distinct()

    columns = ("doc_id", "text_hash", "start", "end", "first", "n")
    spans = _spanned(again.select(*columns).union(wider.select(*columns))).groupBy(*_DOCUMENT, "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_units"), F.min(F.struct("start", "end", "first")).alias("at")
    )
    return spans.select(*_DOCUMENT, "start", "end", "n_units", F.col("at.first.doc_id").alias("first_doc_id"), F.col("at.first.start").alias("first_start"))


def report(docs: DataFrame) -> DataFrame:
    """The spans to remove, without the text hash."""
    return repeated(docs).drop("text_hash")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with its columns, the repeated spans cut from text, and removed_spans: their original offsets (null: none)."""
    spans = repeated(docs).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed_spans"))
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "removed_spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "removed_spans"]).alias("row"))
    match = F.col("row.doc_id").cast("long").eqNullSafe(F.col("span_id")) & (F.xxhash64("row.text") == F.col("span_hash"))
    joined = rows.join(spans, match, "left").select("row.*", "removed_spans")
    at = joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                texts = part.column(at).to_pylist()
                for i, own in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for span in reversed(own or ()):
                        texts[i] = texts[i][: span["start"]] + texts[i][span["end"] :]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return bounded_batches(joined).mapInArrow(run, joined.schema)
