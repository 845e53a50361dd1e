"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And automaton over several 64-bit words: each rule has a
start bit and a bit for every character but `*`, and a `*` lets the bit before it stay. One pass over
a canonical URL moves the bits of all rules at once; a batch of URLs moves side by side in numpy.

The subject is `host NUL path`, with `?query` after it, so that a rule for a host and its subdomains
is two globs. `*` stands for any bytes, `?` for one byte; patterns are matched to the whole subject.

A null URL, or one without `://`, has an empty host and path, fits no host rule, and is judged by the
globs on its (empty) subject. URLs are bytes of UTF-8 and may be of any length. Of rules that fit, the longest wins, of
equally long ones the first of the policy. Rows are independent: repeated rows get equal results, null ids stay null.
Empty tables give no rows. Only page_id and url are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.llm.common import map_rows

ALLOW, BLOCK = "allow", "block"
_STAR, _ANY = ord("*"), ord("?")


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts so; the longest rule that fits decides."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.host}\0{self.path}*", f"*.{self.host}\0{self.path}*"


class Automaton:
    """Globs as multiword Shift-And masks."""

    def __init__(self, globs: list[bytes]):
        moves: list[tuple[int, int | None]] = []  # bit, byte it takes (None: any)
        loops, starts, self.finals, bit = [], [], [], 0
        for glob in globs:
            starts.append(bit)
            for c in glob:
                if c == _STAR:
                    loops.append(bit)
                else:
                    bit += 1
                    moves.append((bit, None if c == _ANY else c))
            self.finals.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.takes = np.zeros((256, self.words), np.uint64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for at, c in moves:
            self.takes[slice(None) if c is None else c, at // 64] |= np.uint64(1 << at % 64)
        for mask, bits in ((self.start, starts), (self.loop, loops)):
            for at in bits:
                mask[at // 64] |= np.uint64(1 << at % 64)

    def matches(self, subjects: list[bytes]) -> np.ndarray:
        """[subject, glob]: which globs fit which whole subject."""
        order = sorted(range(len(subjects)), key=lambda i: -len(subjects[i]))
        lengths = np.array([len(subjects[i]) for i in order], np.int64)
        text = np.frombuffer(b"".join(subjects[i] for i in order), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(subjects), 1))
        live = len(subjects)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[live - 1] <= at:
                live -= 1
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.takes[text[begin[:live] + at]] | now & self.loop
        out = np.empty((len(subjects), len(self.finals)), bool)
        finals = np.array(self.finals, np.int64)
        hit = state[:, finals // 64] >> (finals % 64).astype(np.uint64) & np.uint64(1)
        out[order] = hit.astype(bool)
        return out


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path and query; empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", "", ""
    rest = url[at + 3 :].split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path, query


@dataclass(frozen=True)
class UrlPolicy:
    """Host rules first, then block globs on the whole subject; what none names is allowed."""

    rules: tuple[HostRule, ...]
    block: tuple[str, ...]

    def compile(self) -> Automaton:
        globs = [g for r in self.rules for g in r.globs()] + list(self.block)
        return Automaton([g.encode() for g in globs])

    def judge(self, machine: Automaton, urls: list[str | None]) -> list[tuple]:
        """host, path, name of the rule or None, verdict and the block globs that fit, of each URL."""
        split = [parts(u) for u in urls]
        subjects = [f"{h}\0{p}?{q}" if q else f"{h}\0{p}" for h, p, q in split]
        hits = machine.matches([s.encode("utf-8", "surrogatepass") for s in subjects])
        n = len(self.rules)
        by_rule = hits[:, 0 : 2 * n : 2] | hits[:, 1 : 2 * n : 2]
        longest = sorted(range(n), key=lambda k: -len(self.rules[k].name))
        out = []
        for (host, path, _), fits, globs in zip(split, by_rule, hits[:, 2 * n :], strict=True):
            named = [self.block[k] for k in np.flatnonzero(globs)]
            rule = next((self.rules[k] for k in longest if fits[k]), None)
            verdict = rule.verdict if rule else BLOCK if named else ALLOW
            out.append((host, path, rule and rule.name, verdict, named))
        return out


#: Rules that a table may hold. Masks take 2 KB for 64 characters of globs, and a URL in a batch 8 bytes.
MAX_RULES = 20_000


def policy_of(rules: DataFrame) -> UrlPolicy:
    """The policy of a table (verdict, host, path, glob): host rules, and block globs where glob is not null.

    Rules come in order of verdict, host, path and glob, repeated ones once; a null path fits all paths. A verdict other
    than allow or block, an allow glob, a row with neither host nor glob, or over MAX_RULES rows is an error: nothing is dropped.
    """
    rows = rules.select("verdict", "host", "path", "glob").distinct().orderBy("verdict", "host", "path", "glob").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    for r in rows:
        if r.verdict not in (ALLOW, BLOCK) or (r.host is None) == (r.glob is None) or (r.glob is not None and r.verdict != BLOCK):
            raise ValueError(f"not a rule: {r}")
    hosts = tuple(HostRule(r.verdict, r.host.translate(_LOWER), r.path or "") for r in rows if r.host is not None)
    return UrlPolicy(hosts, tuple(r.glob for r in rows if r.glob is not None))


#: The production policy: the host rules, and words of hosts that carry spam.
POLICY = UrlPolicy(
    rules=(
        HostRule(ALLOW, "org", "/"),
        HostRule(BLOCK, "example.org", "/es/"),
        HostRule(BLOCK, "example.org", "/en/1"),
        HostRule(ALLOW, "com", "/fr/"),
        HostRule(BLOCK, "com", "/de/"),
    ),
    block=("*casino*\0*", "*cheap-pills*\0*", "*free-bets*\0*", "*spam-farm*\0*", "*adult-*\0*", "*ads-track*\0*", "*\0*/wp-admin/*", "*\0*.exe"),
)


def filter_urls(pages: DataFrame, policy: UrlPolicy = POLICY) -> DataFrame:
    """page_id, host, path, rule, verdict and matched globs of every row; only these two columns are read."""
    held: list[Automaton] = []

    def rows(batch: list[tuple]) -> list[tuple]:
        if not held:
            held.append(policy.compile())
        return [(i, *judged) for (i, _), judged in zip(batch, policy.judge(held[0], [u for _, u in batch]), strict=True)]

    return map_rows(
        pages.select(F.col("page_id").cast("long"), "url"),
        rows,
        "page_id long, host string, path string, rule string, verdict string, matched array<string>",
    )
