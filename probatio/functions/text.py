"""Column functions on text, shared by batch and streaming jobs. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_literal(text: str) -> str:
    """Escape ``text`` so that a regular expression matches it literally."""
    return re.escape(text)


def whole_word(keyword: str) -> str:
    """Case-insensitive pattern for ``keyword`` as a whole word (Unicode letters count)."""
    # the keyword before what must not stand before it: a test of the character before every place takes far longer
    word = regex_literal(keyword)
    return rf"(?iu){word}(?<![\p{{L}}\p{{N}}_]{word})(?![\p{{L}}\p{{N}}_])"


def hits(lower_text: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` occur as substrings of an already lower-cased text."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(lower_text, F.lit(word.lower())).cast("int")
    return total


def any_hit(lower_text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lower_text, F.lit(word.lower()))
    return found


def matched_words(lower_text: Column, words: Sequence[str]) -> Column:
    """The words found, as an array in lexicon order."""
    return F.filter(
        F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(lower_text, w))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Constant map lookup; a missing key gives ``default``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def first_rule(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    expr = None
    for condition, value in rules:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def extension_of(name: Column) -> Column:
    """Last suffix with its dot, lower-cased; empty if the name has none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(.)\.[^./]+$", "$1")


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^./]+)$", 1)


#: Matches folded into one array before it is put away, and characters of a segment of text.
FOLD, SEGMENT = 256, 1024


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_positions(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match as ``array<struct<start:int, raw:string>>``; ``start`` counts characters.

    The pieces between matches and the matches themselves alternate, so the start of match i
    is the length of the pieces up to i plus the length of the matches before i. The running sum is
    folded in chunks of ``FOLD`` matches: an array that grows by one is copied each time, and within
    a chunk that stays short, so the work is in proportion to the matches of a text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast("array<struct<start:int,raw:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["gap"]).cast("int")
        return F.struct((start + F.length(x["raw"])).alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), x["raw"].alias("raw")))).alias("out"))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), empty.alias("out")), add)
        return bound(inner, lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    def placed(raw: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.slice(F.arrays_zip(gaps.alias("gap"), raw.alias("raw")), 1, F.size(raw))
        chunks = bound(steps, lambda s: F.transform(
            F.sequence(F.lit(1), F.size(raw), F.lit(FOLD)), lambda at: F.slice(s, at, FOLD)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,raw:string>>>").alias("out"))
        return F.flatten(F.aggregate(chunks, start, add_chunk, lambda a: a["out"]))

    return bound(found, lambda raw: F.when(F.size(raw) > 0, placed(raw)).otherwise(empty))


def segments(text: Column) -> Column:
    """A text cut into pieces of ``SEGMENT`` characters, from which any place is reached at once."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % SEGMENT), F.lit(0))


def around(parts: Column, start: Column, length: Column, window: int) -> Column:
    """Up to ``window`` characters on both sides of a match at ``start`` (0-based) in :func:`segments`."""
    begin, end = F.greatest(F.lit(0), start - window), start + length + window
    first = F.floor(begin / SEGMENT).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.floor(end / SEGMENT).cast("int") - first + 1), "")
    return F.substring(near, begin - first * SEGMENT + 1, end - begin)
