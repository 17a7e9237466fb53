"""Text: titles, handles, words and shingles as column expressions; folding as a pandas UDF."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: words that titles share without meaning the same thing.
STOP_WORDS = "a an and at by for from in of on or the to with".split()


def normal_title(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def handle(name: Column) -> Column:
    """Without one leading @, trimmed, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), "^@", ""))


def words(text: Column, stop: list[str] | None = None) -> Column:
    """The set of words of letters a-z and digits, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS if stop is None else stop)))


def _runs(parts: Column, n: int, between: str) -> Column:
    """The set of runs of n parts.  Each part is looked at n times, whatever the text's length."""
    out = parts
    for k in range(1, n):
        out = F.zip_with(out, F.slice(parts, k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(between), b))
    return F.array_distinct(F.filter(out, lambda run: run.isNotNull()))


def char_grams(text: Column, n: int = 3) -> Column:
    """The set of runs of n characters."""
    return _runs(F.filter(F.split(text, ""), lambda c: c != ""), n, "")


def word_shingles(text: Column, n: int = 3) -> Column:
    """The set of runs of n words."""
    return _runs(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), n, " ")


def mentions(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"@([a-z0-9._]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"\.+$", "")))


def caption_template(text: Column) -> Column:
    """Numbers (with their ordinal endings) and date words as #; null for short captions, which many posts share."""
    dates = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun)[a-z]*\b|\d+(st|nd|rd|th)?"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), dates, "#"), r"\s+", " "))
    return F.when(F.length(bare) >= 80, bare)


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def tri_state(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def byline(hosts: Column) -> Column:
    """A, B & C."""
    n = F.size(hosts)
    return F.when(n <= 1, F.array_join(hosts, "")).otherwise(
        F.concat(F.array_join(F.slice(hosts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" & "), F.element_at(hosts, -1))
    )


def initials(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
    return F.upper(F.array_join(F.transform(F.slice(parts, 1, 2), lambda p: F.substring(p, 1, 1)), ""))


@functools.cache
def _letters() -> tuple[str, str]:
    """Characters whose compatibility form is one other character beside marks, and that character."""
    pairs = []
    for code in range(0x80, 0x20000):
        form = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(form) == 1 and form[0] != chr(code) and not 0xD800 <= code < 0xE000:
            pairs.append((chr(code), form[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """As `fold_accents`, as an expression; what stands for several characters (a ligature) stays."""
    return F.regexp_replace(F.translate(text, *_letters()), r"\p{M}+", "")


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Compatibility form without combining marks."""

    def fold(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    return text.map(fold)


_DASHES = {ord(c): "-" for c in "‐‑‒–—―−"} | {ord(c): "'" for c in "‘’‛"} | {ord(c): '"' for c in "“”„"}
_JSON_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


@F.pandas_udf(T.StringType())
def decode_text(text: pd.Series) -> pd.Series:
    """Entities (nested up to three times) and \\uXXXX escapes resolved, dashes and quotes plain, NFKC."""

    def decode(t):
        if t is None:
            return None
        for _ in range(3):
            if (plain := html.unescape(t)) == t:
                break
            t = plain
        t = _JSON_ESCAPE.sub(lambda m: chr(int(m[1], 16)), t).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return unicodedata.normalize("NFKC", t.translate(_DASHES))

    return text.map(decode)


@F.pandas_udf(T.StringType())
def fold_calendar_line(line: pd.Series) -> pd.Series:
    """RFC 5545 folding: no line is longer than 75 octets, and no character is cut."""

    def fold(s):
        if s is None:
            return None
        out, room, part = [], 75, ""
        for c in s:
            size = len(c.encode())
            if size > room:
                out.append(part)
                part, room = " ", 74
            part, room = part + c, room - size
        return "\r\n".join([*out, part])

    return line.map(fold)


def calendar_text(text: Column) -> Column:
    """RFC 5545 escaping."""
    out = text
    for plain, escaped in ((r"\\", r"\\\\"), (";", r"\\;"), (",", r"\\,"), (r"\r?\n", r"\\n")):
        out = F.regexp_replace(out, plain, escaped)
    return out
