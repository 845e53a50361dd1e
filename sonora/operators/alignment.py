"""Edit alignments of token sequences, and labels of tokens and words read from them.

The path is chosen from the end: a diagonal step where one is optimal, else a deletion, else an insertion.
One pair's matrix is held at once, as bytes of steps; pairs come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonora.functions.text import nfkc, normalized, tokens

EQUAL, SUBSTITUTED, DELETED, INSERTED = "eq", "sub", "del", "ins"
STEPS = "array<struct<op:string,ref_idx:int,hyp_idx:int>>"


def path(ref: list[str], hyp: list[str]) -> list[tuple[str, int | None, int | None]]:
    """(op, ref index, hyp index) in reading order; an index is None where the op uses none."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(t, len(names)) for t in s], np.int64) for s in (ref, hyp))
    n, m = len(a), len(b)
    ahead = np.arange(m + 1)
    row = ahead.copy()
    diagonal, up = np.zeros((n + 1, m + 1), bool), np.zeros((n + 1, m + 1), bool)
    for i in range(1, n + 1):
        cost = row[:-1] + (b != a[i - 1])
        new = np.concatenate(([i], np.minimum(row[1:] + 1, cost)))
        new = np.minimum.accumulate(new - ahead) + ahead  # insertions: a running minimum along the row
        diagonal[i, 1:], up[i] = new[1:] == cost, new == row + 1
        row = new
    out, i, j = [], n, m
    while i or j:
        if i and j and diagonal[i, j]:
            i, j = i - 1, j - 1
            out.append((EQUAL if a[i] == b[j] else SUBSTITUTED, i, j))
        elif i and up[i, j]:
            i -= 1
            out.append((DELETED, i, None))
        else:
            j -= 1
            out.append((INSERTED, None, j))
    return out[::-1]


def aligned(pairs: DataFrame, ref: str = "ref_tokens", hyp: str = "hyp_tokens", out: str = "alignment") -> DataFrame:
    """pairs with the alignment of two token arrays; a null array is empty."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.StructType.fromDDL(f"steps {STEPS}")["steps"].dataType)])
    arrow = to_arrow_schema(schema)
    left, right = pairs.columns.index(ref), pairs.columns.index(hyp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [
                    [{"op": o, "ref_idx": i, "hyp_idx": j} for o, i, j in path(a or [], b or [])]
                    for a, b in zip(part.column(left).to_pylist(), part.column(right).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow.field(out).type)], schema=arrow)

    return pairs.mapInArrow(run, schema)


def token_labels(alignment: Column) -> Column:
    """For each hypothesis token, whether it aligned as equal; deletions have no label."""
    own = F.filter(alignment, lambda s: s.hyp_idx.isNotNull())
    return F.transform(own, lambda s: s.op == EQUAL)


def op_counts(alignment: Column) -> Column:
    """Number of steps of each kind."""
    count = lambda op: F.size(F.filter(alignment, lambda s: s.op == op))
    return F.struct(*[count(op).alias(op) for op in (EQUAL, SUBSTITUTED, DELETED, INSERTED)])


def word_labels(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", compatibility: bool = True) -> DataFrame:
    """pairs with `labels` of the words of the normalised hypothesis."""
    split = pairs.withColumns({"ref_tokens": tokens(normalized(F.col(ref), compatibility)), "hyp_tokens": tokens(normalized(F.col(hyp), compatibility))})
    return aligned(split).withColumn("labels", token_labels(F.col("alignment"))).drop("alignment", "ref_tokens", "hyp_tokens")


def emitted_word_labels(pairs: DataFrame, ref: str = "ref", words: str = "words", compatibility: bool = True) -> DataFrame:
    """pairs with `labels` of the words as they were emitted (array of strings).

    Each word is normalised apart and owns its tokens: it is right if all of them align as equal, and its label
    is null if it has none.
    """
    own = F.transform(F.col(words), lambda w: tokens(normalized(w, False)))
    if compatibility:  # Python sees the words joined by a line feed, which no word keeps as a character of its own
        joined = F.split(normalized_lines(F.array_join(words, "\n")), "\n", -1)
        own = F.transform(joined, tokens)
    split = pairs.withColumn("owned", F.when(F.size(words) > 0, own).otherwise(F.array().cast("array<array<string>>")))
    split = split.withColumns({"ref_tokens": tokens(normalized(F.col(ref), compatibility)), "hyp_tokens": F.flatten("owned")})
    found = aligned(split).withColumn("token_labels", token_labels(F.col("alignment")))
    ends = F.transform("owned", lambda t, i: F.aggregate(F.slice("owned", 1, i + 1), F.lit(0), lambda acc, x: acc + F.size(x)))
    own_labels = F.transform(F.arrays_zip(F.col("owned").alias("owned"), ends.alias("ends")), lambda z: F.slice("token_labels", z.ends - F.size(z.owned) + 1, F.size(z.owned)))
    labels = F.transform(own_labels, lambda x: F.when(F.size(x) > 0, F.forall(x, lambda v: v)))
    return found.withColumn("labels", labels).drop("owned", "ref_tokens", "hyp_tokens", "alignment", "token_labels")


def normalized_lines(text: Column) -> Column:
    """normalized() of each line apart, lines kept."""
    return F.array_join(F.transform(F.split(nfkc(text), "\n", -1), lambda line: normalized(line, False)), "\n")
