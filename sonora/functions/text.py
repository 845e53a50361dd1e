"""Text normalisation and edit distances as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages written without spaces, which are measured by characters.
CHARACTER_LANGUAGES = ("zh", "yue", "ja", "ko", "th", "lo", "my", "km")

# White space and word characters as Python's re has them, spelled for Java.
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_NOT_WORD = rf"[^\p{{L}}\p{{N}}_{_SPACE}]"
#: Texts without any of these are unchanged by NFKC: from U+0300 on marks may combine, below it only these have another form.
_MAY_CHANGE = "[" + "".join(chr(c) for c in range(0x300) if unicodedata.normalize("NFKC", chr(c)) != chr(c)) + "\\x{300}-\\x{10ffff}]"


def nfkc(text: Column) -> Column:
    """NFKC. Only texts that it may change go to Python; the others pass as nulls and stay in the JVM."""

    @F.pandas_udf("string")
    def changed(texts):
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(changed(F.when(text.rlike(_MAY_CHANGE), text)), text)


def normalized(text: Column, compatibility: bool = True) -> Column:
    """NFKC (unless the texts are known to be stable), lower case, punctuation to spaces, spaces collapsed."""
    text = nfkc(text) if compatibility else text
    plain = F.regexp_replace(F.lower(text), _NOT_WORD, " ")
    return F.trim(F.regexp_replace(plain, f"[{_SPACE}]+", " "))


def tokens(normal: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once: inside lambdas Spark evaluates outer expressions for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def token_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two token arrays, by the built-in function on one code point a token."""

    def coded(own: Column, known: Column) -> Column:
        point = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + F.lit(0x10000)), 8, "0")), "UTF-32")
        return F.array_join(F.transform(own, point), "")

    def distance(pair: Column) -> Column:
        return bound(F.array_distinct(F.concat(pair.a, pair.b)), lambda known: F.levenshtein(coded(pair.a, known), coded(pair.b, known)))

    return bound(F.struct(a.alias("a"), b.alias("b")), distance)


def _rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    empty = F.when(n_hyp == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(n_ref == 0, empty).otherwise(distance / n_ref)


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of normalised texts; against an empty reference 0 for an empty hypothesis, else 1."""
    pair = F.struct(tokens(ref).alias("a"), tokens(hyp).alias("b"))
    return bound(pair, lambda p: _rate(token_distance(p.a, p.b), F.size(p.a), F.size(p.b)))


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of normalised texts, spaces left out."""
    a, b = F.replace(ref, F.lit(" "), F.lit("")), F.replace(hyp, F.lit(" "), F.lit(""))
    return _rate(F.levenshtein(a, b), F.length(a), F.length(b))


def error_rate(ref: Column, hyp: Column, language: Column) -> Column:
    """(metric, value): characters for languages without spaces, words for the others."""
    by_character = F.coalesce(language.isin(*CHARACTER_LANGUAGES), F.lit(False))
    return F.struct(F.when(by_character, F.lit("cer")).otherwise(F.lit("wer")).alias("metric"), F.when(by_character, cer(ref, hyp)).otherwise(wer(ref, hyp)).alias("value"))


def clock(seconds: Column) -> Column:
    """mm:ss.ss"""
    return F.format_string("%02d:%05.2f", F.floor(seconds / 60).cast("int"), seconds - F.floor(seconds / 60) * 60)
