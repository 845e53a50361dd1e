r"""Quality rules as a bitmask ledger.

Every rule is evaluated once on every whole text. The ledger keeps the measurements and one bit for
each rule that fails. Policies are versioned masks over those bits: a document is kept if no bit of
the mask is set. Ablations (what a rule alone removes, what a policy without it would keep) are bitwise
aggregates over the ledger, so no text is read again.

Words are runs of anything but space and \t to \r. A null or empty text has no words; its ratios are
0 and it fails the rules on length. Letters are A-Z, a-z and every code point from U+00C0 on. Rows are independent: repeated rows
get equal results, null ids stay null, and there are no ties. Whole texts of any length are measured; one is held at once.
Empty tables give an empty ledger. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonora.llm.common import map_rows

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_UPPER_LATIN = re.compile(b"\xc3[\x80-\x96\x98-\x9e]")  # À to Þ but ×
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(0xC3, 256))  # from U+00C0 on, by their first bytes


def _count(raw: bytes, chosen: bytes) -> int:
    return len(raw) - len(raw.translate(None, chosen))


def measure(text: str | None) -> tuple:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly at space and \t to \r
    n = len(words)
    spaces = len(raw) - sum(map(len, words))
    seen, again, again_chars, lines = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                again += 1
                again_chars += len(line)
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if windows and len(counts := Counter(windows)) < len(windows):
        until = 0  # words before this one are already counted
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeat += at + 3 - max(at, until)
                until = at + 3
    return (
        n,
        len(text) - spaces,
        _count(raw, _SYMBOLS),
        again,
        repeat,
        lines,
        again_chars,
        len(raw),
        _count(raw, _UPPER) + len(_UPPER_LATIN.findall(raw)),
        _count(raw, _LETTERS),
        len(set(words)),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_bytes", "n_bytes", "n_upper", "n_letters", "n_distinct")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements is true; bits are never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "too_long", "n_words > 1000000"),
    Rule(3, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "repeated_line_bytes", "10 * dup_line_bytes > 3 * n_bytes"),
    Rule(7, "upper_case", "10 * n_upper > 5 * n_letters"),
    Rule(8, "few_letters", "10 * n_letters < 6 * word_chars"),
    Rule(9, "few_distinct", "n_words >= 50 and 100 * n_distinct < 5 * least(n_words, 2000)"),
)


def mask(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


#: Versioned policies: the rules that a document must not fail.
POLICIES = {
    "base-1": mask("too_short", "repeated_windows"),
    "web-1": mask("too_short", "repeated_windows", "word_length", "symbols", "repeated_lines", "repeated_line_bytes", "upper_case", "few_letters", "few_distinct"),
    "web-2": mask("too_short", "repeated_windows", "too_long", "word_length", "symbols", "repeated_lines", "repeated_line_bytes", "upper_case", "few_letters", "few_distinct"),
}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits: every rule evaluated once on every text."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), lambda rows: [(i, *measure(t)) for i, t in rows], schema)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_bits", total)


def kept_by(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def failed_rules(bits: str = "fail_bits") -> Column:
    """The names of the rules whose bits are set."""
    named = [F.when(F.col(bits).bitwiseAND(F.lit(1 << r.bit)) != 0, F.lit(r.name)) for r in RULES]
    return F.array_compact(F.array(*named))


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """One row for each rule of the policy, from the ledger alone.

    n_failed: documents with its bit. n_alone: those that no other rule of the policy fails, which a
    policy without the rule would keep. also_failed: bits of the policy that fail somewhere together
    with it. common_bits: bits that fail wherever it fails (null if nowhere).
    """
    chosen = [r for r in RULES if POLICIES[policy] & 1 << r.bit]
    own = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    counts = entries.groupBy(own.alias("bits")).agg(F.count("*").alias("n"))
    aggregates = []
    for r in chosen:
        has = F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0
        aggregates.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("bits") == 1 << r.bit, F.col("n"))), F.lit(0)).alias("n_alone"),
                F.bit_or(F.when(has, F.col("bits"))).alias("also_failed"),
                F.bit_and(F.when(has, F.col("bits"))).alias("common_bits"),
            )
        )
    return counts.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows"))


def judge(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The ledger with base_failed, and kept: no rule of the base or of the policy fails."""
    entries = ledger(docs)
    return entries.select(
        "doc_id",
        *MEASURES[:5],
        (~kept_by("base-1")).alias("base_failed"),
        (kept_by("base-1") & kept_by(policy)).alias("kept"),
        "fail_bits",
        failed_rules().alias("failed"),
        *MEASURES[5:],
    )
