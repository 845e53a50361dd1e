r"""Line deduplication by a join of deletion neighbourhoods.

A line's words are runs of anything but space and \t to \r; lines with equal words are equal. Every line
with a word is compared with all lines of all documents: a line goes if an equal line comes earlier, or
a line within one edit (a unit replaced, added or left out). Units are words, between lines of MIN_WORDS words or more,
and code points of the words joined by spaces, between shorter lines of MIN_CHARS code points or more: so an edit is an
eighth of a line at most. Earlier means a smaller (doc_id, line number), null ids last.

1. Lines are hashed (128 bits) and equal lines become one, at its earliest place.
2. Two lines within one edit agree on the first or on the last half of their units, counted for the
   shorter line. So only lines that share a hashed half with another line are candidates.
3. A candidate emits the hash of every variant with one unit of the other half left out, and its own. Lines with an
   equal variant at the same unit differ in that unit, all of them pairwise, so each is joined with the
   earliest of them only; a line that equals another's variant is joined with it. No group of lines is
   listed in pairs.
4. The joined pairs are verified by their edit distance, and the later line of a pair goes.

Lines without words are kept. Null texts have no lines and stay null. Rows that repeat an id have their
places in common, so lines that they share at the same place stay in each. A document that loses all
its lines with words is dropped by cleaned(). One document's lines are held at once, whatever its length. Empty tables
give no rows. cleaned() carries all columns in a struct, so that they may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonora.llm.common import ROWS_AT_ONCE, bounded_batches, map_rows, small, written

#: Shorter lines are compared by characters: one word is too much of them.
MIN_WORDS = 8
#: Lines shorter than both are compared for equality only: one character is too much of them.
MIN_CHARS = 12

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def units(line: bytes) -> list[bytes] | str | None:
    """The words of a line whose words are joined by spaces, or its code points, or None where equality is all."""
    words = line.split(b" ")
    if len(words) >= MIN_WORDS:
        return words
    text = line.decode()
    return text if len(text) >= MIN_CHARS else None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def halves(words: list[bytes] | str) -> list[int]:
    """Hashes such that two lines within one edit have one in common; last halves have odd ones.

    With the first half in common the edit is at (n - 1) // 2 or later, with the last one before (n + 1) // 2.
    """
    n = len(words)
    joined = str.encode if isinstance(words, str) else b" ".join
    first, last = {n // 2, (n - 1) // 2}, {n - n // 2, n - 1 - (n - 1) // 2}
    keys = [(words[:k], k, 0) for k in sorted(first)] + [(words[n - k :], k, 1) for k in sorted(last)]
    return [(xxhash.xxh3_64_intdigest(joined(own), seed=2 * k + odd) & ~1 | odd) - (1 << 63) for own, k, odd in keys]


def variants(words: list[bytes] | str) -> np.ndarray:
    """The hash of the units without each of them in turn, and last that of all of them."""
    n = len(words)
    if isinstance(words, str):
        own = _mixed(np.frombuffer(words.encode("utf-32-le"), np.uint32) * _FACTOR)
    else:
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n)
    powers = np.full(n + 1, _FACTOR, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    before = np.concatenate(([np.uint64(0)], np.cumsum(own * powers[:n])))
    moved = np.concatenate(([np.uint64(0)], np.cumsum(own[1:] * powers[: n - 1])))
    out = np.append(before[:n] + (moved[-1] - moved), before[-1])
    out ^= np.append(np.full(n, n - 1, np.uint64), np.uint64(n)) << np.uint64(40)
    return _mixed(out).view(np.int64)


def within_one_edit(a: list | str, b: list | str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _lines(batch: list[tuple]) -> Iterable[tuple]:
    for doc_id, text_hash, text in batch:
        for number, line in enumerate(text.encode("utf-8", "replace").split(b"\n") if text else ()):
            if words := line.split():
                plain = b" ".join(words)
                digest = xxhash.xxh3_128_intdigest(plain)
                high, low = (digest >> 64) - (1 << 63), (digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                parts = units(plain)
                yield doc_id, text_hash, number, high, low, parts and halves(parts)


def _place(doc_id: str = "doc_id", number: str = "line_no") -> Column:
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(number).alias("line_no"))


def _candidates(docs: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct lines that share a half with another one, numbered in order of rank, and their words.

    (rank, line, high, low, place, shared) and (rank, shared, words); shared is 1 for first, 2 for last, 3 for both.
    """
    keys = distinct.filter("halves is not null").select("line", F.explode("halves").alias("half"))
    met = keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    kind = F.when(F.col("half").bitwiseAND(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(2))
    shared = written(keys.join(met, "half").groupBy("line").agg(F.bit_or(kind).alias("shared")))
    chosen = distinct.join(shared, "line").select("line", "high", "low", "place", "shared").orderBy("place", "high", "low")
    chosen = written(chosen.select(F.monotonically_increasing_id().alias("rank"), "*"))  # sorted, so numbers rise with rank
    ids = chosen.select(F.col("place.doc_id").alias("id")).distinct()
    ids = small(written(ids))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def again(batch: list[tuple]) -> Iterable[tuple]:
        for doc_id, text in batch:
            for number, line in enumerate(text.encode("utf-8", "replace").split(b"\n") if text else ()):
                plain = b" ".join(line.split())
                if units(plain):
                    digest = xxhash.xxh3_128_intdigest(plain)
                    yield doc_id, number, (digest >> 64) - (1 << 63), (digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63), plain

    lines = map_rows(texts, again, "doc_id long, line_no int, high long, low long, words binary")
    found = lines.join(chosen, ["high", "low"]).filter(_place() == F.col("place"))
    return chosen, written(found.groupBy("rank").agg(F.first("shared").alias("shared"), F.first("words").alias("words")))


def _near(candidates: DataFrame) -> DataFrame:
    """(rank, other): each candidate that an earlier one is within one edit of, and the earliest of these."""

    def emit(batch: list[tuple]) -> Iterable[tuple]:
        for rank, shared, words in batch:
            found = variants(units(words)).tolist()
            n = len(found) - 1
            yield found[n], -1, rank
            for at in range(0 if shared & 2 else (n - 1) // 2, n if shared & 1 else (n + 1) // 2):
                yield found[at], at, rank

    emitted = written(map_rows(candidates, emit, "variant long, at int, rank long"))
    met = emitted.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1").select("variant")
    emitted = written(emitted.join(met, "variant", "left_semi"))
    replaced = emitted.filter("at >= 0")
    first = replaced.groupBy("variant", "at").agg(F.min("rank").alias("other"))
    same_place = replaced.join(first, ["variant", "at"]).filter("other < rank").select("rank", "other")
    whole = emitted.filter("at < 0").select("variant", F.col("rank").alias("short"))
    added = replaced.join(whole, "variant").select(F.greatest("rank", "short").alias("rank"), F.least("rank", "short").alias("other"))
    pairs = same_place.union(added).distinct()
    words = candidates.select("rank", "words")
    sides = pairs.join(words, "rank").join(words.select(F.col("rank").alias("other"), F.col("words").alias("other_words")), "other")

    def verify(batch: list[tuple]) -> Iterable[tuple]:
        return [(rank, other) for rank, other, a, b in batch if within_one_edit(units(a), units(b))]

    good = map_rows(sides.select("rank", "other", "words", "other_words"), verify, "rank long, other long")
    return good.groupBy("rank").agg(F.min("other").alias("other"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, kind (exact or near), first_doc_id and first_line_no of every line that goes.

    kind is near, with the earliest verified line, for all places of a line that is within one edit of an earlier one.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    lines = written(map_rows(source, _lines, "doc_id long, text_hash long, line_no int, high long, low long, halves array<long>"))
    distinct = lines.groupBy("high", "low").agg(F.min(_place()).alias("place"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("line"), "*"))  # fixes the numbers
    chosen, candidates = _candidates(docs, distinct)
    near = _near(candidates).join(chosen.select("rank", "line"), "rank")
    near = near.join(chosen.select(F.col("rank").alias("other"), F.col("place").alias("near")), "other").select("line", "near")
    known = distinct.drop("halves").join(near, "line", "left").filter("n > 1 or near is not null").select("high", "low", "place", "near")
    found = lines.select("doc_id", "text_hash", "line_no", "high", "low").join(known, ["high", "low"])
    found = found.filter(F.col("near").isNotNull() | (_place() != F.col("place")))
    first = F.coalesce("near", "place")
    kind = F.when(F.col("near").isNotNull(), F.lit("near")).otherwise(F.lit("exact"))
    return found.select("doc_id", "text_hash", "line_no", kind.alias("kind"), first["doc_id"].alias("first_doc_id"), first["line_no"].alias("first_line_no"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without the lines that go, with all its columns; n_chars, where there is one, follows the text."""
    gone = removed(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    match = F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_hash"))
    spare = "gone" + "_" * max(len(c) for c in docs.columns)  # longer than any column's name
    joined = rows.join(gone, match, "left").select("row.*", F.col("gone").alias(spare))
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    arrow_text = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                texts, keep = part.column(at).to_pylist(), []
                for i, gone_lines in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    keep.append(True)
                    if gone_lines:
                        numbers = set(gone_lines)
                        left = [x for j, x in enumerate(texts[i].split("\n")) if j not in numbers]
                        texts[i] = "\n".join(left)
                        keep[i] = bool(texts[i].encode("utf-8", "replace").split())
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, arrow_text)
                if chars is not None:
                    own = columns[chars]
                    columns[chars] = pa.array([len(t) if t is not None and g else n for t, g, n in zip(texts, part.column(part.num_columns - 1).to_pylist(), own.to_pylist(), strict=True)], own.type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return bounded_batches(joined).mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, kind, first_doc_id and first_line_no of every line that goes."""
    return removed(docs).drop("text_hash")
