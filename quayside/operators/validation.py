"""Checks of decisions and of the occurrences they claim, as tables of rules; and schedules expanded to sessions.

A rule is a name and a condition that fails a row.  All rules are evaluated in one pass; the first of
them that fails, in their order, is the row's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import support, times
from ..functions.evidence import COMPACT_RANGE, FULL_RANGE, evidence_days, time_range
from ..functions.spans import spans
from ..sources.tables import cut, spread

# What roles a date has in a post of each kind, and what kinds publish.
ROLES = {
    "activity": ["occurrence"], "deadline": ["cutoff"], "application": ["application_window", "program_duration", "none"], "service_schedule": ["recurring_hours", "occurrence"],
    "announcement": ["observance", "notice_period", "none"],
    "uncertain": ["occurrence", "cutoff", "application_window", "program_duration", "recurring_hours", "observance", "notice_period", "none"],
}
PUBLISHED = ("activity", "deadline", "service_schedule")
# Words of reasoning in a venue, a dated cutoff, and a corrected schedule.
REASONING = (
    r"(?i)\b(?:impl(?:ied|ies|y)|infer(?:red|s)?|presum(?:ed|ably)|assum(?:ed|ing)|likely|probabl[ey]|possibl[ey]|perhaps|maybe|unspecified"
    r"|not\s+(?:specified|stated|mentioned|given|listed)|mention(?:ed|s)?|based\s+on|guess(?:ed)?)\b"
)
CUTOFF = r"(?i)\b(?:deadlines?|applications?\s+(?:are\s+)?(?:due|closes?)|apply\s+by)\b(?:[ \t]*:?[ \t]*\n[^\n!?]{0,100}|[^\n!?]{0,100})"
CORRECTED = r"(?i)\b(?:(?:room\s*(?:&|and)\s*time|time|schedule)\s+(?:update|correction)|(?:new official|updated|revised|corrected)\s+schedule)\b"
MOST_DAYS, MOST_WINDOWS, MOST_SESSIONS, MOST_SECONDS = 120, 4, 100, 86_400

Rules = list[tuple[str, Column]]


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows with `error`: the first rule that fails, null if none does.  A condition that is null doesn't fail."""
    return rows.withColumn("error", F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)))


def decision_rules() -> Rules:
    """Of kind, date_role, reason, activity_evidence, date_evidence (texts cited), occurrences (how many), has_schedule, source_text."""
    kind, role = F.col("kind"), F.col("date_role")
    table = F.create_map(*(x for k, roles in ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, roles)))))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    published = kind.isin(*PUBLISHED)
    choices = (F.col("occurrences") > 0).cast("int") + F.col("has_schedule").cast("int")
    dated = F.exists(spans(F.col("source_text"), CUTOFF), lambda s: F.size(evidence_days(s["text"])) > 0)
    windowed = role.isin("application_window", "program_duration")
    return [
        ("unknown decision", ~F.coalesce(kind.isin(*ROLES), F.lit(False)) | role.isNull() | blank("reason")),
        ("kind and role disagree", ~F.array_contains(table[kind], role)),
        ("a dated cutoff is a deadline", (kind == "application") & dated),
        ("no activity evidence", published & blank("activity_evidence")),
        ("no date evidence", (published | windowed) & blank("date_evidence")),
        ("too many occurrences", F.col("occurrences") > MOST_SESSIONS),
        ("incompatible choices", (choices > 1) | (~published & (choices > 0))),
        ("nothing to publish", kind.isin("activity", "deadline") & (choices == 0)),
        ("hours need a schedule", (role == "recurring_hours") & (F.col("occurrences") > 0)),
        ("no schedule of this kind", F.col("has_schedule") & ~kind.isin("service_schedule", "activity")),
    ]


def _next_day(wall: Column) -> Column:
    return (F.date_trunc("day", wall) + F.expr("INTERVAL '1' DAY")).cast("timestamp_ntz")


def with_read_bounds(occurrences: DataFrame) -> DataFrame:
    """starts_at and ends_at (wall clocks) as they are meant: a day's last second is its end, a day alone ends at midnight, and so does an evening that ends at its own day's 00:00."""
    start, end, whole = F.col("starts_at"), F.col("ends_at"), F.col("all_day")
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    first = F.when(whole & (clock(start) == "23:59:59"), F.date_trunc("day", start).cast("timestamp_ntz")).otherwise(start)
    last = F.when(whole & (clock(end) == "23:59:59"), _next_day(end)).when(whole & end.isNull() & (clock(first) == "00:00:00"), _next_day(first))
    evening = ~whole & (F.to_date(end) == F.to_date(start)) & (clock(end) == "00:00:00") & (F.hour(start) >= 12)
    return occurrences.withColumns({"starts_at": first, "ends_at": last.when(evening, _next_day(end)).otherwise(end)})


def _offset_known(wall: Column, offset: Column, zones: Column) -> Column:
    """Whether an offset (minutes) is that of the campus, or of a zone that is named, at a wall clock."""
    seconds = lambda utc: F.unix_timestamp(wall.cast("timestamp")) - F.unix_timestamp(utc.cast("timestamp"))
    of = lambda zone: F.floor(seconds(F.convert_timezone(zone, F.lit("UTC"), wall)) / 60)
    return F.exists(F.concat(F.array(F.lit(times.CAMPUS)), zones), lambda z: of(z) == offset)


def _one_range(fragment: Column) -> Column:
    """HH:MM-HH:MM of a fragment that prints just one time range."""
    found = F.array_distinct(F.filter(F.transform(F.concat(spans(fragment, FULL_RANGE), spans(fragment, COMPACT_RANGE)), lambda s: time_range(s["text"])), lambda r: r.isNotNull()))
    return F.when(F.size(found) == 1, found[0])


def _ranges_of_occasion(text: Column) -> Column:
    """The time ranges that a text prints for the occurrence's title and day: of the whole text and of each paragraph by itself."""
    plain = lambda t: F.regexp_replace(F.lower(t), r"(?U)\W+", " ")
    short = F.trim(plain(F.regexp_replace("title", r"^[A-Z][A-Z0-9.-]{1,7}\s+", "")))
    day = F.array(F.month("starts_at") * 100 + F.dayofmonth("starts_at"))
    fragments = F.array_union(F.array(text), F.split(text, r"\n\s*\n"))
    fits = F.filter(fragments, lambda f: F.contains(plain(f), short) & (evidence_days(f) == day))
    return F.array_distinct(F.filter(F.transform(fits, _one_range), lambda r: r.isNotNull()))


def occurrence_rules() -> Rules:
    """Of title, all_day, starts_at, ends_at (read wall clocks), start_offset, end_offset (minutes), location,
    location_evidence, activity_evidence, date_evidence (texts cited), posted_at, kind, caption, texts (all fields), cites_caption."""
    start, end, whole, cited = F.col("starts_at"), F.col("ends_at"), F.col("all_day"), F.coalesce("date_evidence", F.lit(""))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    week = F.col("kind") == "activity"
    supported = lambda day: support.day_supported(day, cited, F.col("posted_at"), week)
    midnight = lambda c: F.date_format(c, "HH:mm:ss") == "00:00:00"
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    zones = support.named_zones(cited)
    reasons = F.exists(spans(F.col("location"), REASONING), lambda s: ~F.contains(F.lower(F.coalesce("location_evidence", F.lit(""))), F.lower(s["text"])))
    ranges = F.array_distinct(F.flatten(F.transform("texts", _ranges_of_occasion)))
    own = _ranges_of_occasion(F.coalesce("caption", F.lit("")))
    printed = lambda r: (F.substring(r, 1, 5) == F.date_format(start, "HH:mm")) & (end.isNull() | (F.substring(r, 7, 5) == F.date_format(end, "HH:mm")))
    follows = F.col("caption").rlike(CORRECTED) & F.col("cites_caption") & ~whole & (F.size(own) == 1) & F.exists(own, printed)
    return [
        ("no title", blank("title")),
        ("venue not cited", ~blank("location") & blank("location_evidence")),
        ("venue is reasoning", reasons),
        ("no activity evidence", blank("activity_evidence")),
        ("no date evidence", blank("date_evidence")),
        ("no start", start.isNull()),
        ("offset disagrees", ~_offset_known(start, F.col("start_offset"), zones) | ~_offset_known(end, F.col("end_offset"), zones)),
        ("ends before it starts", end <= start),
        ("longer than a day", ~whole & (seconds > MOST_SECONDS)),
        ("day not supported", ~supported(F.to_date(start))),
        ("no midnight bounds", whole & (end.isNull() | ~midnight(start) | ~midnight(end))),
        ("last day not supported", whole & ~supported(F.date_sub(F.to_date(end), 1))),
        ("start clock not supported", ~whole & ~support.clock_supported(start, cited)),
        ("end clock not supported", ~whole & end.isNotNull() & ~support.clock_supported(end, cited)),
        ("ranges conflict", (F.size(ranges) > 1) & ~F.coalesce(follows, F.lit(False))),
        ("hours needed", (F.col("kind") == "service_schedule") & (whole | end.isNull())),
    ]


def schedule_rules() -> Rules:
    """Of first_day, last_day, weekdays (0 for Monday), windows (start, end as HH:mm), date_evidence, posted_at, kind."""
    first, last, text = F.col("first_day"), F.col("last_day"), F.coalesce("date_evidence", F.lit(""))
    supported = lambda day: support.day_supported(day, text, F.col("posted_at"), F.col("kind") == "activity")
    minutes = lambda hhmm: F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 4, 2).cast("int")
    inorder = F.array_sort("windows")
    overlap = F.exists(F.zip_with(F.slice(inorder, F.lit(1), F.size(inorder) - 1), F.slice(inorder, F.lit(2), F.size(inorder)), lambda a, b: a["end"] > b["start"]), lambda bad: bad)
    clocks = support.printed_clocks(text)
    count = F.size("windows") * F.size(F.filter(F.sequence(first, last), lambda d: F.array_contains("weekdays", F.weekday(d))))
    bounded = F.datediff(last, first).between(0, MOST_DAYS)
    return [
        ("no bounded range", F.coalesce(~(bounded & supported(first) & supported(last)), F.lit(True))),
        ("no weekdays", F.coalesce((F.size("weekdays") < 1) | F.exists("weekdays", lambda d: ~d.between(0, 6)), F.lit(True))),
        ("other weekdays than printed", ~(F.array_sort(F.array_distinct("weekdays")) == support.named_weekdays(text))),
        ("windows", F.coalesce(~F.size("windows").between(1, MOST_WINDOWS), F.lit(True))),
        ("windows overlap", F.exists("windows", lambda w: w["start"] >= w["end"]) | overlap),
        ("window clock not supported", F.exists("windows", lambda w: ~F.array_contains(clocks, minutes(w["start"])) | ~F.array_contains(clocks, minutes(w["end"])))),
        ("too many sessions", F.when(bounded, count > MOST_SESSIONS)),
    ]


def expanded_schedules(schedules: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """key, starts_at, ends_at (UTC) of every session of the schedules that pass, and the others with their error.

    Schedules that say the same are judged and expanded once, dealt to all cores.
    """
    said = [c for c in schedules.columns if c != key]
    named = schedules.withColumn("said", F.sha2(F.to_json(F.struct(*said)), 256))
    checked = cut(judged(spread(cut(named.drop(key).dropDuplicates(["said"]))), schedule_rules()).select("said", "first_day", "last_day", "weekdays", "windows", "error"))
    good = checked.filter("error IS NULL")
    days = good.select("said", "weekdays", "windows", F.explode(F.sequence("first_day", "last_day")).alias("day")).filter(F.array_contains("weekdays", F.weekday("day")))
    each = days.select("said", "day", F.explode("windows").alias("w"))
    at = lambda hhmm: times.utc_time(F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), hhmm), F.lit("yyyy-MM-dd HH:mm")))
    sessions = each.groupBy("said").agg(F.collect_list(F.struct(at(F.col("w.start")).alias("starts_at"), at(F.col("w.end")).alias("ends_at"))).alias("sessions"))  # MOST_SESSIONS at most
    bad = named.join(checked.filter("error IS NOT NULL").select("said", "error"), "said").select(*schedules.columns, "error")
    return named.select(key, "said").join(sessions, "said").select(key, F.inline("sessions")), bad
