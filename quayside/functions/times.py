"""Time: stored in UTC (timestamp_ntz read as UTC), read in campus time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAMPUS = "America/Los_Angeles"
_OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def campus_time(ts: Column) -> Column:
    """The campus wall clock of a UTC timestamp_ntz."""
    return F.convert_timezone(F.lit("UTC"), F.lit(CAMPUS), ts)


def utc_time(wall: Column) -> Column:
    """The UTC timestamp_ntz of a campus wall clock; times that a clock change skips give null."""
    utc = F.convert_timezone(F.lit(CAMPUS), F.lit("UTC"), wall)
    return F.when(campus_time(utc) == wall, utc)


def campus_day(ts: Column) -> Column:
    return F.to_date(campus_time(ts))


def day_key(ts: Column) -> Column:
    return F.date_format(campus_time(ts), "yyyy-MM-dd")


def month_bucket(ts: Column) -> Column:
    return F.to_date(F.date_trunc("month", campus_time(ts)))


def is_campus_midnight(ts: Column) -> Column:
    return F.date_format(campus_time(ts), "HH:mm:ss") == "00:00:00"


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def strict_instant(text: Column) -> Column:
    """UTC timestamp_ntz of an ISO instant; null without an offset or where it can't be read."""
    return F.when(F.trim(text).rlike(_OFFSET), F.try_to_timestamp(F.trim(text))).cast("timestamp_ntz")


def instant_or_utc(text: Column) -> Column:
    """As strict_instant, but a clock without an offset is UTC."""
    return F.try_to_timestamp(F.trim(text)).cast("timestamp_ntz")


def instant_or_campus(text: Column) -> Column:
    """As strict_instant, but a clock without an offset is campus time."""
    naive = utc_time(F.try_to_timestamp(F.trim(text)).cast("timestamp_ntz"))
    return F.when(F.trim(text).rlike(_OFFSET), strict_instant(text)).otherwise(naive)


def sort_at(kind: Column, starts: Column, ends: Column) -> Column:
    """A deadline that spans whole campus days is due at 23:59 of its first day; all else sorts by its start."""
    due = utc_time((F.date_trunc("day", campus_time(starts)) + F.expr("INTERVAL '23:59' HOUR TO MINUTE")).cast("timestamp_ntz"))
    whole = (kind == "student_deadline") & (ends > starts) & is_campus_midnight(starts) & is_campus_midnight(ends)
    return F.when(F.coalesce(whole, F.lit(False)), due).otherwise(starts)


def is_date_only(all_day: Column, starts: Column, ends: Column) -> Column:
    """Said to last all day, from a campus midnight, for one campus day at most."""
    short = F.datediff(campus_day(ends), campus_day(starts)) <= 1
    return F.coalesce(all_day & is_campus_midnight(starts) & (ends > starts) & short, F.lit(False))


def relevance(starts: Column, ends: Column, midnight: Column) -> Column:
    """True: still to come, False: past, null: unknown.  Ends are exclusive, starts inclusive."""
    return F.when(ends.isNotNull(), ends > midnight).when(starts.isNotNull(), starts >= midnight)


def was_stale(posted: Column, starts: Column, ends: Column, grace_hours: int = 24) -> Column:
    """Whether an event was over by more than the grace when it was posted; recaps get no grace."""
    return F.coalesce(F.coalesce(ends, starts) < posted - F.expr(f"INTERVAL '{grace_hours}' HOUR"), F.lit(False))


def repaired_end(starts: Column, ends: Column, printed_range: Column, printed_day: Column) -> Column:
    """A midnight end on the day of an afternoon start means the next midnight, if the text prints just that day and range.

    printed_range: HH:MM-HH:MM of the text's only range; printed_day: MM-dd of its only date.
    """
    start, end = campus_time(starts), campus_time(ends)
    wrong = (F.to_date(start) == F.to_date(end)) & is_campus_midnight(ends) & (F.hour(start) >= 12) & (end <= start)
    printed = (printed_day == F.date_format(start, "MM-dd")) & (printed_range == F.concat(F.date_format(start, "HH:mm"), F.lit("-00:00")))
    return F.when(F.coalesce(wrong & printed, F.lit(False)), utc_time((end + F.expr("INTERVAL '1' DAY")).cast("timestamp_ntz"))).otherwise(ends)
