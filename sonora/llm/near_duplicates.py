r"""Near-duplicate documents by SetSketch registers.

A document's set holds the distinct shingles of its words (A-Z lower-cased runs of anything but space
and \t to \r); a text of fewer words than a shingle has its whole sequence as one. A sketch has 256
registers of 16 bits: truncated minima over exponentially distributed values, exponentially spaced with
base BASE, so that a sketch of a union is the registerwise maximum and equal registers mean similar sets.
The base is close to 1 so that unlike sets rarely have a register in common: else the chance candidates,
which grow with the square of the documents, would outnumber the true ones.

1. Documents with equal sets become one node (128-bit digests of whole sets).
2. Bands of registers are hashed; nodes that share a band are candidates. With the bands chosen for the
   threshold, a pair at it shares none with a probability under 1e-8.
3. In each bucket every node is compared with one hub, the node that shares most buckets. The sketches'
   joint likelihood gives an estimate; pairs far under the threshold go, and the others are verified on
   their whole sets. Verified links are joined to components.
4. Buckets whose nodes, the hub left out, still lie in several components may hide links. There a node x is
   described by its difference D(x) to the hub h: the shingles that only one of both has. As D(x) and D(y) differ
   by what x and y differ by, x and y link if D(x) and D(y) share at least
   |h| - |x & h| - |y & h| + (the least intersection of linked sets of their sizes) shingles. That is 1 or more unless
   both link with the hub. So each node lists D in one order, the shingles rarest in the bucket's nodes first, and a
   linked pair shares one early enough in both lists to leave the others behind it (prefix filter). What near copies, or
   pages of one template, have in common is in no D, or comes last. The node nearer to the hub indexes, the other
   one probes; how near the index is, in blocks, is part of the join's key, so that a list's early part is as short as
   the partner allows. Only pairs across components are made. They are estimated and verified like the first.

Pages of a template that each fill its gaps with text of their own meet nowhere (tested: joined rows follow the pages).
What is left of a square is for pages under the threshold that share many of the shingles that only a few of them have.
No step lists all pairs of a bucket or gathers a bucket in one task. What links is decided on full sets
only, but not all pairs come so far: one at the threshold shares no band with a probability under 1e-8, and its
estimate falls MARGIN under its similarity with one under 2e-7 (Chernoff's bound for 256 registers); step 4 loses none.

Null and empty texts and those without words have no links and are components of their own. Null ids give way to
others as a component's id; a component of null ids only has a null id. Repeated rows have equal sets and one
component. Ties of hubs go to the larger node number, those of ids do not matter. Empty tables give no rows. Other
columns of docs are not read and may have any names, those used here included. Texts may be of any length; one
text's shingles are held at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sonora.llm.common import map_rows, small, written
from sonora.llm.components import connected

REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65535
#: How wide blocks of nearness to a hub are, in shares of its shingles.
BLOCK = 0.005
#: A pair is not verified if its estimate is this far under the threshold (over six standard deviations).
MARGIN = 0.15


@dataclass(frozen=True)
class Rule:
    """Links sets with 100 * intersection >= percent * union."""

    shingle: int
    percent: int

    @property
    def rows(self) -> int:
        """Registers of a band: the most with which a pair at the threshold is missed with under 1e-8."""
        share = self.percent / 100
        fits = [r for r in range(1, 17) if (1 - share**r) ** (REGISTERS // r) < 1e-8]
        return max(fits, default=1)

    def links(self, inter: int, union: int) -> bool:
        return 100 * inter >= self.percent * union


CONTRACT = Rule(3, 85)
DEFAULT = Rule(5, 80)

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M2
    x = (x ^ x >> np.uint64(27)) * _M3
    return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and split exactly at space and \t to \r
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ own[k : k + n]) * _M1
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def _minima(flat: np.ndarray, keys: np.ndarray, doc: np.ndarray, step: np.ndarray | int) -> None:
    """Puts each shingle's value of the stratum `step` into its register of that step."""
    step = np.atleast_1d(np.asarray(step, np.uint64))
    draw = _mixed(keys + (step + np.uint64(1)) * _M1)
    register = (keys + step * (keys >> np.uint64(20) | np.uint64(1))) & np.uint64(REGISTERS - 1)
    np.minimum.at(flat, (doc * REGISTERS + register.astype(np.int64)), step << np.uint64(32) | draw >> np.uint64(32))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set: [set, 256] of uint16.

    A shingle visits the registers in an order of its own, with values from ever higher strata of the
    exponential distribution. So a set is done once all its registers have a value.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(len(sets) * REGISTERS, none, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    for small in (True, False):
        chosen = np.flatnonzero((sizes > 0) & ((sizes < 64) == small))
        if not len(chosen):
            continue
        keys = np.concatenate([sets[i] for i in chosen])
        doc = np.repeat(chosen, sizes[chosen])
        if small:
            for at in range(0, len(keys), 1024):
                part, own = keys[at : at + 1024], doc[at : at + 1024]
                steps = np.tile(np.arange(REGISTERS, dtype=np.uint64), len(part))
                _minima(values, np.repeat(part, REGISTERS), np.repeat(own, REGISTERS), steps)
            continue
        for step in range(REGISTERS):
            for at in range(0, len(keys), 1 << 18):
                _minima(values, keys[at : at + (1 << 18)], doc[at : at + (1 << 18)], step)
            lacking = (values.reshape(-1, REGISTERS) == none).any(axis=1)
            if not lacking[chosen].any():
                break
            stay = lacking[doc]
            keys, doc = keys[stay], doc[stay]
    share = (values.astype(np.float64) / 2.0**32 + 2.0**-33) / REGISTERS
    minimum = -np.log1p(-np.minimum(share, 1 - 2.0**-45)) / RATE
    registers = np.floor(1 - np.log(minimum) / math.log(BASE))
    registers = np.clip(registers, 0, TOP)
    return np.where(values == none, 0, registers).astype("<u2").reshape(-1, REGISTERS)


def estimated(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, steps: int = 101) -> np.ndarray:
    """The similarity of each pair of sketches that is most likely, given the sets' sizes."""
    more, less = (left > right).sum(axis=1)[:, None], (left < right).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    similarity = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)
    above = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p, q = above(u - v * similarity), above(v - u * similarity)
    likelihood = more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))
    return similarity[np.arange(len(left)), likelihood.argmax(axis=1)]


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set and registers, of every row."""

    def rows(batch: list[tuple]) -> Iterable[tuple]:
        sets = [shingles(t, rule.shingle) for _, _, t in batch]
        for (doc_id, text_hash, _), own, registers in zip(batch, sets, sketches(sets), strict=True):
            yield doc_id, text_hash, len(own), xxhash.xxh3_128_digest(own.tobytes()), registers.tobytes()

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(source, rows, "doc_id long, text_hash long, n_shingles long, digest binary, registers binary")


def _whole_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, text_hash), a written table, read from the texts again."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    found = small(wanted).join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("node", "text")
    sets = map_rows(found, lambda batch: [(k, shingles(t, rule.shingle).tobytes()) for k, t in batch], "node long, shingles binary")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))  # one of repeated rows


def _sided(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b), a written table, with the facts of both, named a_* and b_*."""
    pairs = small(pairs)
    for side in ("a", "b"):
        named = [F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in facts.columns if c != "node"]]
        pairs = pairs.join(facts.select(*named), side)
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link: likely by their sketches, then certain by their whole sets."""
    least = rule.percent / 100 - MARGIN

    def likely(batch: list[tuple]) -> Iterable[tuple]:
        a, b, n, left, m, right = zip(*batch, strict=True)
        grid = [np.frombuffer(b"".join(x), "<u2").reshape(-1, REGISTERS) for x in (left, right)]
        score = estimated(*grid, np.array(n, np.float64), np.array(m, np.float64))
        return [(x, y) for x, y, s in zip(a, b, score, strict=True) if s >= least]

    def certain(batch: list[tuple]) -> Iterable[tuple]:
        for a, b, left, right in batch:
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            if rule.links(inter, len(x) + len(y) - inter):
                yield a, b

    sizes = F.least("a_n_shingles", "b_n_shingles") * 100 >= F.greatest("a_n_shingles", "b_n_shingles") * rule.percent
    sketched = _sided(pairs, nodes.select("node", "n_shingles", "registers")).filter(sizes)
    close = map_rows(sketched.select("a", "b", "a_n_shingles", "a_registers", "b_n_shingles", "b_registers"), likely, "a long, b long")
    both = _sided(written(close), sets)
    return map_rows(both.select("a", "b", "a_shingles", "b_shingles"), certain, "a long, b long")


def _differences(star: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(hub, node, root) with n, own (the shingles that only one of node and hub has), near and base.

    near is (100 + percent) * |node & hub| - percent * n, and base (100 + percent) * (|own| - |hub|) + near, so that
    two nodes can link by a shingle at positions i and j of their lists only if base + near of the other one is at
    least (100 + percent) * i, and likewise for j.
    """
    unit = 100 + rule.percent

    def rows(batch: list[tuple]) -> Iterable[tuple]:
        for hub, node, root, left, right in batch:
            x, h = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            own = np.setxor1d(x, h, assume_unique=True)
            near = unit * ((len(x) + len(h) - len(own)) // 2) - rule.percent * len(x)
            yield hub, node, root, len(x), own.view(np.int64).tolist(), near, unit * (len(own) - len(h)) + near, len(h)

    both = star.join(sets.withColumnRenamed("shingles", "x"), "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("h")), "hub")
    return map_rows(both.select("hub", "node", "root", "x", "h"), rows, "hub long, node long, root long, n long, own array<long>, near long, base long, n_hub long")


def _prefixes(found: DataFrame, rule: Rule) -> DataFrame:
    """hub, shingle, node, root, n, near, room and block of the early part of each list: a partner's near and room together are 0 or more.

    Shingles that only nodes of one component list make no pairs; they come first in a node's order.
    """
    listed = found.select("hub", "node", "root", F.explode("own").alias("shingle"))
    counts = listed.groupBy("hub", "shingle").agg(F.count("*").alias("several"), F.min("root").alias("least"), F.max("root").alias("most"))
    met = written(listed.drop("root").join(counts.filter("least < most").select("hub", "shingle", "several"), ["hub", "shingle"]))
    own = W.partitionBy("hub", "node")
    ranked = met.withColumn("later", F.count("*").over(own) - F.row_number().over(own.orderBy("several", "shingle")))
    nearest = found.groupBy("hub").agg(F.max("near").alias("nearest"))
    facts = found.select("hub", "node", "root", "n", "near", "base", "n_hub", F.size("own").alias("d")).join(nearest, "hub")
    at = F.col("d") - 1 - F.col("later")
    room = F.col("base") - at * (100 + rule.percent)
    block = F.floor(F.col("near") / (F.greatest(F.col("n_hub") * BLOCK, F.lit(1.0)) * (100 + rule.percent)))
    early = ranked.join(facts, ["hub", "node"]).filter(room + F.col("nearest") >= 0)
    return early.select("hub", "shingle", "node", "root", "n", "near", room.alias("room"), block.alias("block"))


def _meetings(prefixes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """What indexes (a_*) and what probes (b_*), both with hub, shingle and block to be joined by."""
    facts = ("node", "root", "n", "near", "room")
    index = prefixes.filter(F.col("room") + F.col("near") >= 0).select("hub", "shingle", "block", *[F.col(c).alias(f"a_{c}") for c in facts])
    blocks = index.groupBy("hub", "shingle", "block").agg(
        F.max("a_near").alias("nearest"), F.min("a_n").alias("smallest"), F.max("a_n").alias("largest"), F.min("a_root").alias("least"), F.max("a_root").alias("most")
    )
    able = (F.col("nearest") >= F.col("near")) & (F.col("room") + F.col("nearest") >= 0)
    alike = (F.col("largest") * 100 >= F.col("n") * rule.percent) & (F.col("smallest") * rule.percent <= F.col("n") * 100)
    across = (F.col("least") != F.col("root")) | (F.col("most") != F.col("root"))
    met = prefixes.drop("block").join(blocks, ["hub", "shingle"]).filter(able & alike & across)
    return index, met.select("hub", "shingle", "block", *[F.col(c).alias(f"b_{c}") for c in facts])


def _across(star: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of different roots, of nodes with one hub, that may link."""
    index, probes = _meetings(written(_prefixes(written(_differences(star, sets, rule)), rule)), rule)
    nearer = (F.col("a_near") > F.col("b_near")) | ((F.col("a_near") == F.col("b_near")) & (F.col("a_node") < F.col("b_node")))
    enough = (F.col("a_room") + F.col("b_near") >= 0) & (F.col("b_room") + F.col("a_near") >= 0)
    alike = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * rule.percent
    met = probes.join(index, ["hub", "shingle", "block"]).filter((F.col("a_root") != F.col("b_root")) & nearer & enough & alike)
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _links(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect all nodes that the rule connects."""
    rows = rule.rows
    bands = [F.xxhash64(F.lit(k), F.substring("registers", 2 * k * rows + 1, 2 * rows)) for k in range(REGISTERS // rows)]
    keys = nodes.select("node", F.explode(F.array(*bands)).alias("bucket"))
    counts = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(keys.join(counts, "bucket"))
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weight, "node")
    hubs = weighed.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    pairs = buckets.join(hubs, "bucket").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = written(pairs.distinct())
    wanted = written(nodes.join(weight.select("node"), "node", "left_semi").select("node", "doc_id", "text_hash"))
    sets = written(_whole_sets(docs, wanted, rule))
    first = written(_verified(pairs, nodes, sets, rule))
    roots = connected(first)
    spokes = buckets.join(hubs, "bucket").filter("node <> hub").select("bucket", "node", "hub")
    rooted = spokes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("bucket")
    star = written(rooted.join(several, "bucket", "left_semi").select("hub", "node", "root").distinct())
    rest = written(_across(star, sets, rule).join(pairs, ["a", "b"], "left_anti"))
    return first.union(_verified(rest, nodes, sets, rule))


def grouped(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first_hash of every row.

    component_id is the smallest id of the row's component, first_hash the smallest text hash of the
    component's rows with that id.
    """
    rows = written(described(docs, rule))
    sets = rows.filter("n_shingles > 0").groupBy("digest")
    nodes = sets.agg(
        F.min("doc_id").alias("least_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("place"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"),
    )
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "n_shingles", "registers", F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash"), "place")
    nodes = written(nodes)  # fixes the node numbers
    roots = connected(_links(docs, nodes, rule))
    rooted = nodes.select("node", "digest", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("place").alias("least"))
    found = rooted.join(least, "root").select("digest", "least")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    joined = rows.drop("registers").join(found, "digest", "left").withColumn("least", F.coalesce("least", own))
    return joined.select("doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("first_hash"))


def report(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the id is the component's) of every row."""
    found = grouped(docs, rule)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """The rows of docs, with all their columns, one of each component; rows without words stay.

    Of rows that repeat an id and a text one stays, so also of such rows without words.
    """
    kept = grouped(docs, rule).filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    keys = kept.select(F.xxhash64("doc_id", "text_hash").alias("key"), F.xxhash64(F.lit(1), "text_hash", "doc_id").alias("key2")).distinct()
    text_hash, doc_id = F.xxhash64("text"), F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(doc_id, text_hash).alias("key"), F.xxhash64(F.lit(1), text_hash, doc_id).alias("key2"))
    once = rows.join(keys, ["key", "key2"]).withColumn("nth", F.row_number().over(W.partitionBy("key", "key2").orderBy("key")))
    return once.filter("nth = 1").select("row.*")
