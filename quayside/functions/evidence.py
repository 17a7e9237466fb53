"""Dates and clocks printed in a post's text, as expressions over spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times
from .spans import after, before, covers, line_before, part, spans

# Month names as they are printed, one of them as text recognition misreads it, and weekdays.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "oet": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
WEEKDAY = r"(?i)\b(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b"
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
# How dates, ranges and clocks are printed.  Longer names first, so that none hides another.
_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
TILES = r"(?im)^[ \t]*(\d{1,2})\s+(\d{1,2})\s+(\d{4}|\d{2})[ \t\r\n]*\bMONTH\s+DAY\s+YEAR\b"
KOREAN = r"(?<!\d)(?:(?:19|20)\d{2}년\s*)?(\d{1,2})월\s*(\d{1,2})일(?!\d)"
MONTH_NAME = rf"(?i)\b({_NAME})(?:\.\s*|\s+)(\d{{1,2}})(?:st|nd|rd|th)?\b"
DAY_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_NAME})\b"
NUMERIC = r"(?<![\w/.$])(\d{4}-)?(\d{1,2})(?<between>[/.-])(\d{1,2})(?:\k<between>(\d{4}|\d{2}))?(?![\w/])"
NUMERIC_RANGE = r"(?i)(?<![\w/.$])(\d{1,2})/(\d{1,2})\s*(?:[-–—]|to|thru|through)\s*(\d{1,2})/(\d{1,2})(?![\w/])"
CLOCK = r"(?i)\b\d{1,2}(?::\d{2})?\s*[ap]\.?m\.?|\b\d{1,2}:\d{2}\b|\bnoon\b|\bmidnight\b"
# What makes a bare fraction no date, and what makes it one.
MEASURED_BEFORE, MEASURED_AFTER = r"(?i)\b(?:room|suite|building|price|cost|reading)\s*$", r"(?i)^\s*(?:price|off|cups?|tbsp|tsp|inches|hours?|full)\b|^[ \t]*of\b"
UNTIL, DUE = r"(?i)\b(?:on|until|through|thru|by)\s*$", r"(?i)\b(?:apps?|applications?|submissions?|forms?)\s+(?:are\s+)?(?:due|close[sd]?)\s*:?[ \t]*$"
OCCASION, SCHEDULE = r"(?i)\b(?:recruitment|meeting|mixer|social|workshop|orientation|tabling|fair|deadline)\s*$", r"(?i)\b(?:meetings?|events?|recruitment)\s+(?:schedule|timeline)\b"
FULL_RANGE = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap]\.?m\.?)(?:\s*(?:[-–—]|to)\s*|\s+)(\d{1,2})(?::(\d{2}))?\s*([ap]\.?m\.?)\b"
COMPACT_RANGE = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(?:[-–—]|to)\s*(\d{1,2})(?::(\d{2}))?\s*([ap]\.?m\.?)\b"

DATE = "array<struct<form:string,month:int,day:int,start:int,end:int>>"
_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _month(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))[F.lower(name)]


def _inside(pattern: str) -> str:
    """A pattern without its flags at the front, to stand inside another."""
    return re.sub(r"^\(\?\w+\)", "", pattern)


def scanned_dates(text: Column) -> Column:
    """Every date-shaped token: form, month, day, start, end, by form and place; no calendar is asked.

    Forms: labeled (tiles under MONTH DAY YEAR, the first only), month_name, day_month, numeric (with a
    year), bare (5/28 or 5.28).
    """

    def of(form, pattern: str, month, day) -> Column:
        one = lambda s: F.struct(
            (form(s["text"]) if callable(form) else F.lit(form)).alias("form"), month(s["text"]).cast("int").alias("month"), day(s["text"]).cast("int").alias("day"), s["start"].alias("start"), s["end"].alias("end")
        )
        return F.transform(spans(text, pattern), one)

    take = lambda pattern, group: lambda t: part(t, pattern, group)
    named = lambda pattern, group: lambda t: _month(part(t, pattern, group))
    yearful = lambda t: (part(t, NUMERIC, 1) != "") | (part(t, NUMERIC, 5) != "")
    numeric = of(lambda t: F.when(yearful(t), "numeric").when(part(t, NUMERIC, 3).isin("/", "."), "bare"), NUMERIC, take(NUMERIC, 2), take(NUMERIC, 4))
    return F.concat(
        F.slice(of("labeled", TILES, take(TILES, 1), take(TILES, 2)), 1, 1),
        of("month_name", KOREAN, take(KOREAN, 1), take(KOREAN, 2)),
        of("month_name", MONTH_NAME, named(MONTH_NAME, 1), take(MONTH_NAME, 2)),
        of("day_month", DAY_MONTH, named(DAY_MONTH, 2), take(DAY_MONTH, 1)),
        F.filter(numeric, lambda d: d["form"].isNotNull()),
    )


def is_calendar_day(month: Column, day: Column) -> Column:
    """Whether some year has the day."""
    last = F.element_at(F.array(*map(F.lit, _DAYS)), F.when(month.between(1, 12), month).otherwise(1))
    return month.between(1, 12) & day.between(1, last)


def _borne_out(text: Column, date: Column, ranges: Column) -> Column:
    """Whether a bare 5/28 reads as a date by what stands around it."""
    ahead, behind, line = before(text, date["start"], 20), after(text, date["end"]), line_before(text, date["start"])
    slash = F.contains(F.substring(text, date["start"] + 1, date["end"] - date["start"]), F.lit("/"))
    labelled = line.rlike(WEEKDAY + r"[ \t,().]*$")
    measured = ahead.rlike(MEASURED_BEFORE) | behind.rlike(MEASURED_AFTER) | (behind.rlike(r"(?i)^\s*of\b") & ~labelled)
    column = text.rlike(SCHEDULE) & (F.trim(F.regexp_replace(line, r"\s+", "")) == "") & (F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d{1,2}/\d{1,2}\b"), F.lit(0))) >= 2)
    dated = slash & (line.rlike(DUE) | line.rlike(OCCASION) | column)
    real = lambda r, m, d: is_calendar_day(part(r["text"], NUMERIC_RANGE, m).cast("int"), part(r["text"], NUMERIC_RANGE, d).cast("int"))
    ranged = F.exists(ranges, lambda r: covers(r, date) & real(r, 1, 2) & real(r, 3, 4))
    beside = before(text, date["start"], 24).rlike(WEEKDAY + r"[\s,().]{0,8}$") | behind.rlike(r"(?i)^[\s,().]{0,8}" + _inside(WEEKDAY))
    return ~measured & ((slash & ahead.rlike(UNTIL)) | text.rlike(CLOCK) | dated | ranged | beside)


def printed_dates(text: Column) -> Column:
    """The scanned dates that pin down a calendar day; a bare one needs company."""
    ranges = spans(text, NUMERIC_RANGE)
    return F.filter(scanned_dates(text), lambda d: is_calendar_day(d["month"], d["day"]) & ((d["form"] != "bare") | _borne_out(text, d, ranges)))


def evidence_days(text: Column) -> Column:
    """The distinct days, each month * 100 + day, in order."""
    return F.array_sort(F.array_distinct(F.transform(printed_dates(text), lambda d: d["month"] * 100 + d["day"])))


_END = rf"({_inside(WEEKDAY)[2:-2]}),?\s+({_NAME})(?:\.\s*|\s+)(\d{{1,2}})(?:st|nd|rd|th)?\b(?:\s*,?\s*((?:19|20)\d{{2}})\b)?"
WEEKDAY_RANGE = rf"(?i)\b{_END}\s*(?:[-–—]|to|through|thru)\s*\b{_END}"


def weekday_range_days(text: Column, year: Column) -> Column:
    """Days of ranges such as Fri, Oct 2 - Sun, Oct 4: struct(day, printed), printed telling whether a year is.

    A range has seven days at most, and both weekdays must be those of its dates, in the printed year
    or else in `year`.
    """

    def days(s: Column) -> Column:
        get = lambda g: F.nullif(part(s["text"], WEEKDAY_RANGE, g), F.lit(""))
        first_year, last_year = get(4), get(8)
        date = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, _month(m).cast("string"), d), F.lit("yyyy-M-d")).cast("date")
        first, last = date(F.coalesce(first_year, last_year, year.cast("string")), get(2), get(3)), date(F.coalesce(last_year, first_year, year.cast("string")), get(6), get(7))
        named = lambda d, g: F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d) + 1) == F.lower(F.substring(get(g), 1, 3))
        good = F.datediff(last, first).between(0, 6) & named(first, 1) & named(last, 5)
        printed = first_year.isNotNull() | last_year.isNotNull()
        each = F.transform(F.sequence(first, last), lambda d: F.struct(d.alias("day"), printed.alias("printed")))
        return F.when(F.coalesce(good, F.lit(False)), each).otherwise(F.array().cast("array<struct<day:date,printed:boolean>>"))

    return F.array_distinct(F.flatten(F.transform(spans(text, WEEKDAY_RANGE), days)))


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    """Minutes since midnight of a twelve-hour clock, null where there is none such."""
    h, m = hour.cast("int"), F.coalesce(F.nullif(minute, F.lit("")), F.lit("0")).cast("int")
    return F.when(h.between(1, 12) & m.between(0, 59), (h % 12 + F.when(F.lower(half).startswith("p"), 12).otherwise(0)) * 60 + m)


def time_range(text: Column) -> Column:
    """HH:MM-HH:MM of the only time range; in 11-3PM the half belongs to the end, so it starts in the morning."""
    full, compact = spans(text, FULL_RANGE), spans(text, COMPACT_RANGE)

    def read(found: Column, pattern: str, groups: tuple[int, ...], shifts: bool) -> Column:
        get = lambda g: part(found["text"], pattern, g)
        start, end = _clock(get(groups[0]), get(groups[1]), get(groups[2])), _clock(get(groups[3]), get(groups[4]), get(groups[5]))
        if shifts:
            start = F.when(start > end, (start + 720) % 1440).otherwise(start)
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        shown = lambda m: F.concat(two(F.floor(m / 60)), F.lit(":"), two(m % 60))
        return F.concat(shown(start), F.lit("-"), shown(end))

    first = read(F.get(full, F.lit(0)), FULL_RANGE, (1, 2, 3, 4, 5, 6), False)
    second = read(F.get(compact, F.lit(0)), COMPACT_RANGE, (1, 2, 5, 3, 4, 5), True)
    return F.when(F.size(full) + F.size(compact) == 1, F.when(F.size(full) == 1, first).otherwise(second))


def midnight_end(text: Column, starts: Column, ends: Column) -> Column:
    """`times.repaired_end` by what a text prints: its only day, in no other year, and its only time range."""
    start = times.campus_time(starts)
    only_day = evidence_days(text) == F.array(F.month(start) * 100 + F.dayofmonth(start))
    other_year = F.exists(spans(text, MONTH_NAME + r"\s*,?\s*(?:19|20)\d{2}\b"), lambda s: F.right(s["text"], F.lit(4)).cast("int") != F.year(start))
    day = F.when(only_day & ~other_year, F.date_format(start, "MM-dd"))
    return times.repaired_end(starts, ends, time_range(text), day)


def grounded(quote: Column, text: Column) -> Column:
    """The quote stands in the text as whole tokens: no letter, digit or price sign touches it."""
    literal = F.concat(F.lit(r"(?<![\w$])\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.coalesce((quote != "") & F.regexp_like(text, literal), F.lit(False))
