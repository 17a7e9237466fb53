"""Spans: every match of a pattern in a text with its place, as arrays of structs.

A span has start, end and text.  Matches are marked in one pass of a regular expression and the marks
then cut the text apart, so everything stays in the JVM.  Patterns are Java's; the marks are two
control characters that texts don't hold (they are taken out first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\u0001", "\u0002"
SPAN = "array<struct<start:int,end:int,text:string>>"


def spans(text: Column, pattern: str) -> Column:
    """All matches from left to right, not overlapping; none of a null text.  Places count characters from 0."""
    plain = F.translate(text, _OPEN + _CLOSE, "")
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def placed(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(F.replace(p, F.lit(_CLOSE), F.lit(""))))
        one = lambda piece, n: F.struct(
            F.aggregate(F.slice(lengths, F.lit(1), n + 1), F.lit(0), lambda total, x: total + x).alias("start"), F.substring_index(piece, _CLOSE, 1).alias("text")
        )
        found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).cast("int").alias("end"), s["text"].alias("text")))

    return F.coalesce(F.transform(F.array(parts), placed)[0], F.array().cast(SPAN))


def before(text: Column, start: Column, most: int | None = None) -> Column:
    """What stands before a place, its last `most` characters."""
    whole = F.substring(text, F.lit(1), start)
    return whole if most is None else F.right(whole, F.lit(most))


def after(text: Column, end: Column) -> Column:
    return F.substring(text, end + 1, F.length(text))


def line_before(text: Column, start: Column) -> Column:
    return F.substring_index(before(text, start), "\n", -1)


def covers(outer: Column, inner: Column) -> Column:
    """Whether one span holds another."""
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"])


def part(span_text: Column, pattern: str, group: int) -> Column:
    """A group of the match that a span's text is; empty where the group took no part."""
    return F.regexp_extract(span_text, pattern, group)
