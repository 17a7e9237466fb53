"""Whether a text bears out a day or a clock that is claimed of it.

Printed days decide by themselves: with a printed year only in that year, else at their next or
nearest occurrence after the post.  Words such as tomorrow, this Friday or this week become intervals
of days anchored at the post's campus day; they count for days that the text doesn't print.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times
from .evidence import _NAME, COMPACT_RANGE, FULL_RANGE, MONTH_NAME, TILES, WEEKDAYS, _clock, _month, evidence_days, scanned_dates, time_range, weekday_range_days
from .spans import after, part, spans

# How ranges inside a month, years of dates, relative days, clocks and zones are printed.
_TO = r"\s*(?:[-–—]|to|through|thru)\s*"
MONTH_RANGE = MONTH_NAME + _TO + r"(?:the\s+)?(\d{1,2})(?:st|nd|rd|th)?\b(?:\s*,?\s*((?:19|20)\d{2})\b)?"
YEAR_RANGE = MONTH_NAME + _TO + rf"(?:({_NAME})\.?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*((?:19|20)\d{{2}})\b"
KOREAN_YEAR = r"((?:19|20)\d{2})년\s*(\d{1,2})월\s*(\d{1,2})일(?!\d)"
NAMED_DAY = r"(?i)\b(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)s?\b"
DAY_RANGE, DAILY = r"(?i)(?:-|–|—|\bto\b|\bthrough\b)\s*(?:\n\s*)?(?:mon|tue|wed|thu|fri|sat|sun)", r"(?i)\b(?:daily|every day)\b"
THIS_DAY = r"(?i)\bthis\s+(?:coming\s+)?(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tues?|wed|thur?s?|fri|sat|sun)\b"
THIS_WEEK, NEXT_WEEK = r"(?i)\b(?:this|for\s+the)\s+week\b(?!\s+of\b)(?!\s*\d)", r"(?i)\bnext\s+week\s+(?:on\s+)?(?=mon|tue|wed|thu|fri|sat|sun)[^.!?\n]*"
HALF_CLOCK, FULL_CLOCK = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap](?:\.?m)?)(?!\w)", r"(?i)\b(\d{1,2}):(\d{2})(?!\s*[ap](?:\.?m)?\b)\b"
CLOCK_ZONE = r"\b\d{1,2}(?::\d{2}(?:\s*[aApP]\.?[mM]\.?)?|\s*[aApP]\.?[mM]\.?)\s*\(?(ET|EST|EDT|CT|CST|CDT|MT|MST|MDT|UTC|GMT)\b"
ZONE_NAME = r"(?i)\b(Eastern|Central|Mountain)\s+(?:(?:Standard|Daylight)\s+)?Time\b"
# Zones by their names' first letter, and those of a fixed offset.
REGIONS = {"E": "America/New_York", "C": "America/Chicago", "M": "America/Denver"}
OFFSETS = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "UTC": "+00:00", "GMT": "+00:00"}

INTERVAL = "struct<first:date,last:date,weekdays:array<int>>"


def _weekday(name: Column) -> Column:
    """0 for Monday to 6."""
    return F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(F.substring(name, 1, 3))).cast("int") - 1


def _number(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def _date(year: Column, month: Column, number: Column) -> Column:
    """A day of the calendar, else null."""
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), number.cast("string")), F.lit("yyyy-M-d")).cast("date")


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def named_weekdays(text: Column) -> Column:
    """The weekdays that a text names, 0 for Monday; two in a range stand for those between as well."""
    printed = F.transform(spans(text, NAMED_DAY), lambda s: _weekday(s["text"]))

    def filled(days: Column) -> Column:
        first, last = F.get(days, F.lit(0)), F.get(days, F.lit(1))
        between = F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda i: F.pmod(first + i, F.lit(7)))
        return F.when(text.rlike(DAILY), F.array(*map(F.lit, range(7)))).when((F.size(days) == 2) & text.rlike(DAY_RANGE), F.array_union(days, between)).otherwise(F.array_distinct(days))

    return F.array_sort(F.transform(F.array(printed), filled)[0])


def relative_days(text: Column, posted: Column, week_scoped: Column | bool = False) -> Column:
    """Intervals of days that words anchor at the post's campus day; weekdays, where not null, are those that count in it.

    week_scoped: the text is a lineup of one week, so that "this week" and "next week on" date its weekdays.
    """
    today = times.campus_day(posted)
    start = F.date_sub(today, F.dayofweek(today) - 1)
    scoped = F.lit(week_scoped) if isinstance(week_scoped, bool) else week_scoped
    none = F.lit(None).cast("array<int>")
    interval = lambda first, last, weekdays=none: F.struct(first.alias("first"), last.alias("last"), weekdays.alias("weekdays")).cast(INTERVAL)
    some = lambda when, it: F.when(when, F.array(it)).otherwise(_empty(INTERVAL))
    this = F.transform(spans(text, THIS_DAY), lambda s: F.date_add(today, F.pmod(_weekday(part(s["text"], THIS_DAY, 1)) - F.weekday(today), F.lit(7))))
    following = F.filter(spans(text, NEXT_WEEK), lambda s: scoped)
    return F.concat(
        some(text.rlike(r"(?i)\b(today|tonight)\b"), interval(today, today)),
        some(text.rlike(r"(?i)\btomorrow\b"), interval(F.date_add(today, 1), F.date_add(today, 1))),
        F.transform(this, lambda d: interval(d, d)),
        some(scoped & text.rlike(THIS_WEEK), interval(today, F.date_add(start, 6), named_weekdays(text))),
        F.transform(following, lambda s: interval(F.date_add(start, 7), F.date_add(start, 13), named_weekdays(s["text"]))),
    )


def _printed_years(day: Column, text: Column, ranges: Column) -> Column:
    """The years printed with a day."""
    number = _number(day)
    year = lambda t: t.cast("int")
    mine = lambda found, months, days: (_month(months) * 100 + days.cast("int")) == number
    of_weekdays = F.transform(F.filter(weekday_range_days(text, F.year(day)), lambda d: d["printed"] & (_number(d["day"]) == number)), lambda d: F.year(d["day"]))
    of_ranges = F.transform(F.filter(ranges, lambda r: r["year"].isNotNull() & (r["ordinal"] | (_number(r["first"]) == number) | (_number(r["last"]) == number))), lambda r: r["year"])
    korean = F.filter(spans(text, KOREAN_YEAR), lambda s: part(s["text"], KOREAN_YEAR, 2).cast("int") * 100 + part(s["text"], KOREAN_YEAR, 3).cast("int") == number)
    tiles = F.filter(F.slice(spans(text, TILES), 1, 1), lambda s: part(s["text"], TILES, 1).cast("int") * 100 + part(s["text"], TILES, 2).cast("int") == number)
    of_tiles = F.transform(tiles, lambda s: F.when(F.length(part(s["text"], TILES, 3)) == 2, year(part(s["text"], TILES, 3)) + 2000).otherwise(year(part(s["text"], TILES, 3))))
    dates = F.filter(scanned_dates(text), lambda d: d["month"] * 100 + d["day"] == number)
    inside = lambda d: F.regexp_extract_all(F.substring(text, d["start"] + 1, d["end"] - d["start"]), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    behind = lambda d: F.filter(F.array(F.regexp_extract(after(text, d["end"]), r"^\s*,?\s*((?:19|20)\d{2})\b", 1)), lambda y: y != "")
    of_dates = F.transform(F.flatten(F.transform(dates, lambda d: F.concat(inside(d), behind(d)))), year)

    def at_ends(s: Column) -> Column:
        get = lambda g: part(s["text"], YEAR_RANGE, g)
        return mine(s, get(1), get(2)) | mine(s, F.coalesce(F.nullif(get(3), F.lit("")), get(1)), get(4))

    trailing = F.transform(F.filter(spans(text, YEAR_RANGE), at_ends), lambda s: year(part(s["text"], YEAR_RANGE, 5)))
    return F.concat(of_weekdays, of_ranges, F.transform(korean, lambda s: year(part(s["text"], KOREAN_YEAR, 1))), of_tiles, of_dates, trailing)


def day_supported(day: Column, text: Column, posted: Column, week_scoped: Column | bool = False) -> Column:
    """Whether a text bears out a day (date), given when it was posted (UTC; null: unknown)."""
    number = _number(day)
    iso = F.array_contains(F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)), F.date_format(day, "yyyy-MM-dd"))
    found = spans(text, MONTH_RANGE)
    ordinals = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bday\s+(\d{1,2})\s*:"), F.lit(1)), lambda n: n.cast("int"))
    get = lambda s, g: part(s["text"], MONTH_RANGE, g)
    bounds = F.transform(
        found,
        lambda s: F.struct(
            _date(F.year(day), _month(get(s, 1)), get(s, 2)).alias("first"), _date(F.year(day), _month(get(s, 1)), get(s, 3)).alias("last"), F.nullif(get(s, 4), F.lit("")).cast("int").alias("year")
        ),
    )
    # a span of days names its ends only; days inside it need a label of their own
    inner = lambda r: (F.size(found) == 1) & day.between(r["first"], r["last"]) & F.array_contains(ordinals, F.datediff(day, r["first"]) + 1)
    ranges = F.transform(F.filter(bounds, lambda r: F.coalesce(r["first"] <= r["last"], F.lit(False))), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), r["year"].alias("year"), inner(r).alias("ordinal")))
    of_weekdays = F.exists(weekday_range_days(text, F.year(day)), lambda d: _number(d["day"]) == number)

    def decided(known: Column) -> Column:
        printed = F.array_contains(evidence_days(text), number) | of_weekdays | F.exists(known, lambda r: (_number(r["last"]) == number) | r["ordinal"])
        today = times.campus_day(posted)
        around = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: _date(F.year(today) + k, F.month(day), F.dayofmonth(day))), lambda d: d.isNotNull())
        upcoming = F.array_min(F.filter(around, lambda d: d >= today))
        nearest = F.array_min(F.transform(around, lambda d: F.struct(F.abs(F.datediff(d, today)).alias("far"), d.alias("day"))))["day"]
        yearless = F.coalesce((day == upcoming) | (day == nearest), posted.isNull())
        dated = F.transform(F.array(_printed_years(day, text, known)), lambda years: F.when(F.size(years) > 0, F.array_contains(years, F.year(day))).otherwise(yearless))[0]
        said = F.exists(relative_days(text, posted, week_scoped), lambda i: day.between(i["first"], i["last"]) & (i["weekdays"].isNull() | F.array_contains(i["weekdays"], F.weekday(day))))
        return F.when(printed, dated).otherwise(posted.isNotNull() & said)

    return F.coalesce(iso | F.transform(F.array(ranges), decided)[0], F.lit(False))


def printed_clocks(text: Column) -> Column:
    """Minutes since midnight of every clock that a text prints."""
    half = F.transform(spans(text, HALF_CLOCK), lambda s: _clock(part(s["text"], HALF_CLOCK, 1), part(s["text"], HALF_CLOCK, 2), part(s["text"], HALF_CLOCK, 3)))
    minutes = lambda hhmm: F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 4, 2).cast("int")
    ends = lambda s: F.transform(F.array(time_range(s["text"])), lambda r: F.array(minutes(r), minutes(F.right(r, F.lit(5)))))[0]
    ranged = F.flatten(F.transform(F.concat(spans(text, FULL_RANGE), spans(text, COMPACT_RANGE)), ends))
    full = F.transform(spans(text, FULL_CLOCK), lambda s: part(s["text"], FULL_CLOCK, 1).cast("int") * 60 + part(s["text"], FULL_CLOCK, 2).cast("int"))
    word = lambda name, at: F.when(text.rlike(rf"(?i)\b{name}\b"), F.array(F.lit(at))).otherwise(_empty("int"))
    whole = F.concat(half, ranged, full, word("noon", 720), word("midnight", 0))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda m: m.isNotNull())))


def clock_supported(clock: Column, text: Column) -> Column:
    """Whether a text prints a wall clock (timestamp_ntz), to the minute."""
    at = F.hour(clock) * 60 + F.minute(clock)
    return F.coalesce(F.array_contains(printed_clocks(text), at) & (F.date_format(clock, "ss.SSSSSS") == "00.000000"), F.lit(False))


def named_zones(text: Column) -> Column:
    """Zones, besides the campus's, that a text names for a time: offsets and regions."""
    lookup = lambda table, key: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]
    names = F.concat(F.transform(spans(text, CLOCK_ZONE), lambda s: F.regexp_extract(s["text"], CLOCK_ZONE, 1)), F.transform(spans(text, ZONE_NAME), lambda s: part(s["text"], ZONE_NAME, 1)))
    zones = F.flatten(F.transform(names, lambda n: F.array(lookup(OFFSETS, n), lookup(REGIONS, F.upper(F.substring(n, 1, 1))))))
    return F.array_distinct(F.filter(zones, lambda z: z.isNotNull()))
