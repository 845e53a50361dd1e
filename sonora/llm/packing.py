"""Best-fit packing of tokenized documents, with certified repacking.

Documents become token ids and an end id; only what is longer than a sequence is cut, its first piece
being the shorter one. Pieces are packed round by round. A round deals the open pieces over partitions,
packs each by best-fit decreasing, and bounds each partition's bin count from below by dual feasible
functions. A partition whose count meets its bound is certified: no packing of it needs fewer bins. It
gives up only the few bins with much room, and a partition with a gap as many as could close it; the
next round deals these pieces over fewer partitions, or as many as they fill, so that documents move
between partitions, and packs them again. Once a round saves less than a PROGRESS-th of what is above the
bound of all pieces, a partition gives up at most RELEASED_BINS bins with much room. The rounds end when
the count meets that bound, or with one partition.

Partitions have about ITEMS_PER_TASK pieces, dealt without a key, so repeated rows do not gather. Null and empty texts are one end id.
Null ids stay null. Ties in length are packed in the order in which the pieces come. Empty tables give no rows. Only doc_id and
text are read, so other columns may have any names. Texts may be of any length; one is held at once.
Repeated rows are packed one by one. Whole texts are tokenized; the ids are those of the `tokenizers`
library (special tokens' strings are ordinary text). For texts whose code points are all below U+0250
the same vocabulary's rank file gives the same ids, which tests hold against each other, in a quarter
of the time, and is used if it lies beside the vocabulary.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonora.llm.common import map_rows, written

CAPACITY = 2048
END_ID = 0
ITEMS_PER_TASK = 40_000
#: Each round has this many times fewer partitions than the one before.
NARROWING = 8
RELEASED_BINS = 256
PROGRESS = 8


class Encoder:
    """Token ids of texts by a vocabulary file of the `tokenizers` library."""

    def __init__(self, vocabulary: str):
        self.vocabulary, self.held = vocabulary, None
        self.safe = re.compile("[\0-ɏ]*").fullmatch
        self.fast = None
        ranks = Path(vocabulary).with_suffix(".tiktoken")
        if ranks.exists():
            import base64

            import public_tokenizers
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @property
    def exact(self):
        """The tokenizer, loaded with the first text that needs it."""
        if self.held is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.held = Tokenizer.from_file(self.vocabulary)
            self.held.encode_special_tokens = True
        return self.held

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and self.safe(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenized(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    held: list[Encoder] = []

    def rows(batch: list[tuple]) -> list[tuple]:
        if not held:
            held.append(Encoder(vocabulary))
        out = []
        for doc_id, text in batch:
            ids = np.append(held[0].ids(text or ""), np.uint32(END_ID)).astype("<u4")
            out += [(doc_id, k, at, size, zlib.crc32(ids[at : at + size].tobytes())) for k, (at, size) in enumerate(cut(len(ids), capacity))]
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A bin count that no packing of counts[size] items of each size goes below.

    The largest of the sums of dual feasible functions: one family keeps middle sizes, rounds sizes
    over capacity - k up and drops those under k; the other rounds to multiples of 1 / p.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    mass, number = np.cumsum(counts * sizes), np.cumsum(counts)
    k = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    middle = mass[capacity - k] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for p in range(1, 33):
        scaled = sizes * (p + 1)
        value = np.where(scaled % capacity == 0, sizes * p, scaled // capacity * capacity)
        best = max(best, int(-(-int((value * counts).sum()) // (p * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and the room left in each bin; each item goes where it leaves least room."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # a bit for each room that some bin has
    for item in order:
        size = int(lengths[item])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            own = by_room[left].pop()
            if not by_room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, own = capacity, len(room)
            room.append(capacity)
        left -= size
        room[own] = left
        bins[item] = own
        if left:
            by_room[left].append(own)
            open_rooms |= 1 << left
    return bins, np.array(room, np.int64)


def released(room: np.ndarray, gap: int, capacity: int, wide: bool = True) -> np.ndarray:
    """The emptiest bins: enough room together to save gap + 1 bins; without a gap or if not wide, a few that are not nearly full."""
    order = np.argsort(-room, kind="stable")
    least = 0
    if not (wide and gap > 0):
        order, least = order[:RELEASED_BINS], capacity // 32
    before = np.cumsum(room[order]) - room[order]
    out = np.zeros(len(room), bool)
    out[order[(before < capacity * (gap + 1)) & (room[order] > least)]] = True
    return out


def pack_partition(lengths: np.ndarray, capacity: int, last: bool, wide: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """bin, offset and released of each item, the bin count and its bound."""
    bins, room = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    order = np.argsort(bins, kind="stable")
    total = np.cumsum(lengths[order]) - lengths[order]
    starts = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = total - np.maximum.accumulate(np.where(starts, total, 0))
    out = np.zeros(len(room), bool) if last else released(room, len(room) - bound, capacity, wide)
    return bins, offsets, out[bins], len(room), bound


def _round(items: DataFrame, number: int, parts: int, capacity: int, wide: bool) -> DataFrame:
    added = [("sequence_id", T.LongType()), ("offset", T.LongType()), ("part_bins", T.LongType()), ("part_bound", T.LongType()), ("open", T.BooleanType())]
    schema = T.StructType([*items.schema.fields, *[T.StructField(n, t) for n, t in added]])
    arrow = to_arrow_schema(schema)
    at = items.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema(list(arrow)[: len(arrow) - len(added)])).combine_chunks()
        if not table.num_rows:
            return
        lengths = table.column(at).to_numpy().astype(np.int64)
        bins, offsets, freed, n, bound = pack_partition(lengths, capacity, parts == 1, wide)
        first = number << 54 | TaskContext.get().partitionId() << 28
        new = [pa.array(first + bins), pa.array(offsets), pa.array(np.full(len(bins), n)), pa.array(np.full(len(bins), bound)), pa.array(freed)]
        yield from pa.Table.from_arrays([*table.columns, *new], schema=arrow).to_batches(10_000)

    return items.repartition(parts).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items with a `length` of 1 to capacity, with sequence_id and offset of each.

    part_bins and part_bound: the bin count of the partition that last packed the item, and its lower
    bound; equal, they certify the partition. The driver gets the counts of each length, at most
    capacity of them.
    """
    items = written(items)
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r[0]] = r[1]
    bound, parts = lower_bound(counts, capacity), max(1, -(-int(counts.sum()) // ITEMS_PER_TASK))
    done, closed, number, above, wide = None, 0, 0, None, True
    while True:
        packed = written(_round(items, number, parts, capacity, wide))
        found = {r[0]: r[1:] for r in packed.groupBy("open").agg(F.count_distinct("sequence_id"), F.count("*")).collect()}
        closed += found.get(False, (0, 0))[0]
        again, pieces = found.get(True, (0, 0))
        enough = parts == 1 or closed + again <= bound or not again
        kept = packed if enough else packed.filter("not open")
        done = kept if done is None else done.unionByName(kept)
        if enough:
            return done.drop("open")
        items = packed.filter("open").drop("sequence_id", "offset", "part_bins", "part_bound", "open")
        if above is not None and above - (closed + again - bound) < max(1, above // PROGRESS):
            wide = False
        above = closed + again - bound
        fill = -(-pieces // ITEMS_PER_TASK) if wide else 1
        parts, number = max(1, parts // NARROWING, min(parts, fill)), number + 1


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenized(docs, vocabulary, capacity), capacity)
