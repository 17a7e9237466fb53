"""The read path: visible and active listings, filters, pages, facets, calendar and search.

Every function takes the listings DataFrame and explicit instants, and returns a plan; filters stay
plain comparisons, so that they reach the Parquet scan where the column is stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, times
from ..sources.listings import GROUPS, MOVED

PUBLIC_KINDS = ("student_event", "student_deadline")
PAGE, MOST_PER_PAGE, CALENDAR_DAYS = 24, 60, 42


@dataclass(frozen=True)
class FeedQuery:
    category: str = "all"
    search: str = ""
    when: str = "all"
    free_food: bool = False
    deadlines: bool = False
    host_group: str = "all"

    @staticmethod
    def from_params(params: dict[str, str]) -> FeedQuery:
        """Unknown values mean all; old names still work."""
        category = {"social": "hangout"}.get(params.get("cat", "all"), params.get("cat", "all"))
        food = params.get("food") == "1" or category == "free_food"
        known = ("hangout", "get_involved", "career", "academic", "sports", "arts", "volunteering")
        when = params.get("when", "all")
        group = params.get("host", "all")
        return FeedQuery(
            category if category in known else "all",
            params.get("q", ""),
            when if when in ("today", "week", "weekend") else "all",
            food,
            params.get("deadlines") == "1",
            group if group in set(GROUPS.values()) else "all",
        )


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def with_sort(listings: DataFrame) -> DataFrame:
    return listings.withColumn("sort_at", times.sort_at(F.col("content_kind"), F.col("starts_at"), F.col("ends_at"))).withColumn("day", times.campus_day(F.col("starts_at")))


def public(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("content_kind").isin(*PUBLIC_KINDS))


def active(listings: DataFrame, now: str) -> DataFrame:
    return listings.filter(F.coalesce("ends_at", "starts_at") >= instant(now))


def after_cursor(sort_at: str, row_id: str) -> Column:
    at = instant(sort_at)
    return (F.col("sort_at") > at) | ((F.col("sort_at") == at) & (F.col("id") > row_id))


def resumed(listings: DataFrame, sort_at: str, row_id: str) -> DataFrame:
    """Rows after the cursor's row; where that row is gone, its instant is repeated, and readers drop what they have."""
    gone = listings.filter((F.col("id") == row_id) & (F.col("sort_at") == instant(sort_at))).select(F.lit(True).alias("there")).limit(1)
    repeat = listings.filter((F.col("sort_at") == instant(sort_at)) & (F.col("id") <= row_id)).join(F.broadcast(gone), F.lit(True), "left_anti")  # one row at most
    return listings.filter(after_cursor(sort_at, row_id)).unionByName(repeat)


def still_active(page_rows: DataFrame, now: str) -> DataFrame:
    """A stored page without what has ended since; the cursor is that of the stored page."""
    return active(page_rows, now)


def request_ranges(first: str, last: str, days: int = CALENDAR_DAYS) -> list[tuple[str, str]]:
    """A range of days cut into requests of at most `days` days."""
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    starts = range(start.toordinal(), end.toordinal() + 1, days)
    return [(date.fromordinal(n).isoformat(), date.fromordinal(min(n + days - 1, end.toordinal())).isoformat()) for n in starts]


def page(listings: DataFrame, size: int = PAGE, cursor: tuple[str, str] | None = None) -> DataFrame:
    """One page in feed order; one row more than asked for tells that there are more."""
    size = max(1, min(size, MOST_PER_PAGE))
    rows = listings.filter(after_cursor(*cursor)) if cursor else listings
    return rows.orderBy("sort_at", "id").limit(size + 1)


def day_range(when: str, today: Column) -> tuple[Column, Column] | None:
    """First and last day of a window; a week runs Sunday to Saturday, what has passed of it is left out."""
    sunday = times.week_start(today)
    saturday = F.date_add(sunday, 6)
    if when == "today":
        return today, today
    if when == "week":
        return F.greatest(today, sunday), saturday
    if when == "weekend":
        on_sunday = F.dayofweek(today) == 1
        return F.when(on_sunday, today).otherwise(saturday), F.when(on_sunday, today).otherwise(F.date_add(saturday, 1))
    return None


def host_groups(handles: Column, host_type: Column) -> Column:
    """Groups of the own directory type; a host that is moved by hand counts for its new group only."""
    by_type = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    moved = F.create_map(*[F.lit(x) for kv in MOVED.items() for x in kv])
    first = F.coalesce(moved[F.element_at(handles, 1)], by_type[host_type])
    rest = F.transform(F.slice(handles, 2, 10), lambda h: moved[h])
    return F.array_distinct(F.filter(F.concat(F.array(first), rest), lambda g: g.isNotNull()))


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "title", "description", "host", "host_handle", F.array_join("host_handles", " "), "location"))


def predicates(query: FeedQuery, today: str) -> dict[str, Column]:
    """One condition per facet; those that aren't asked for hold always."""
    out = {f: F.lit(True) for f in ("category", "search", "when", "food", "deadlines", "group")}
    if query.category != "all":
        out["category"] = F.col("category") == query.category
    needle = query.search.strip().removeprefix("@").lower()
    if needle:
        out["search"] = haystack().contains(needle)
    if days := day_range(query.when, F.lit(today).cast("date")):
        out["when"] = F.col("day").between(*days)
    if query.free_food:
        out["food"] = F.col("has_free_food")
    if query.deadlines:
        out["deadlines"] = F.col("content_kind") == "student_deadline"
    if query.host_group != "all":
        out["group"] = F.array_contains(host_groups(F.col("host_handles"), F.col("host_type")), query.host_group)
    return out


def all_but(conditions: dict[str, Column], facet: str | None = None) -> Column:
    out = F.lit(True)
    for name, condition in conditions.items():
        if name != facet:
            out = out & condition
    return out


def filtered(listings: DataFrame, query: FeedQuery, today: str) -> DataFrame:
    return listings.filter(all_but(predicates(query, today)))


def facet_counts(listings: DataFrame, query: FeedQuery, today: str) -> DataFrame:
    """facet, value, n: every facet counted with all other conditions in force, in one pass over the rows."""
    conditions = predicates(query, today)
    day = F.lit(today).cast("date")
    windows = F.array(F.lit("all"), *(F.when(F.col("day").between(*day_range(w, day)), F.lit(w)) for w in ("today", "week", "weekend")))
    groups = F.concat(F.array(F.lit("all")), host_groups(F.col("host_handles"), F.col("host_type")))
    labels = [
        ("category", F.array(F.lit("all"), F.when(F.col("category") != "other", F.col("category")))),
        ("when", windows),
        ("food", F.array(F.when(F.col("has_free_food"), F.lit("free_food")))),
        ("deadlines", F.array(F.when(F.col("content_kind") == "student_deadline", F.lit("deadline")))),
        ("group", groups),
    ]
    pairs = F.concat(
        *(F.when(all_but(conditions, facet), F.transform(values, lambda v: F.concat(F.lit(facet + "|"), v))).otherwise(F.array().cast("array<string>")) for facet, values in labels)
    )
    counted = listings.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counted.select(F.substring_index("label", "|", 1).alias("facet"), F.substring_index("label", "|", -1).alias("value"), "n")


def calendar_counts(listings: DataFrame, first: str, days: int = CALENDAR_DAYS) -> DataFrame:
    """day, n, level for at most 42 days; what has ended stays visible."""
    days = max(1, min(days, CALENDAR_DAYS))
    start = F.lit(first).cast("date")
    n = F.col("n")
    counted = listings.filter((F.col("day") >= start) & (F.col("day") < F.date_add(start, days))).groupBy("day").agg(F.count("*").alias("n"))
    return counted.withColumn("level", F.when(n >= 6, 3).when(n >= 3, 2).otherwise(1))


def calendar_grid(months: DataFrame) -> DataFrame:
    """month, day, in_month: whole weeks from the Sunday on or before the first to the Saturday on or after the last day."""
    first = times.week_start(F.col("month"))
    last = F.last_day("month")
    grid = F.explode(F.sequence(first, F.date_add(times.week_start(last), 6)))
    return months.select("month", grid.alias("day")).withColumn("in_month", F.date_trunc("month", "day").cast("date") == F.col("month"))


def by_day(listings: DataFrame) -> DataFrame:
    """listings with their place in the feed order of their day; a day's rows stay rows, however many there are."""
    return listings.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("sort_at", "id")))


def merged_pages(loaded: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of both by id, the loaded ones win."""
    both = loaded.withColumn("rank", F.lit(0)).unionByName(fetched.withColumn("rank", F.lit(1)))
    first = Window.partitionBy("id").orderBy("rank")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")


def search_directory(directory: DataFrame, text: str, most: int = 8) -> DataFrame:
    """handle, label, score: exact 4, prefix 3, start of a word 2, anywhere 1; the best few."""
    needle = text.strip().removeprefix("@").lower()
    label, handle = F.lower("label"), F.col("handle")
    score = (
        F.when((label == needle) | (handle == needle), 4)
        .when(label.startswith(needle) | handle.startswith(needle), 3)
        .when(F.concat(F.lit(" "), label).contains(" " + needle), 2)
        .when(label.contains(needle) | handle.contains(needle), 1)
    )
    return directory.withColumn("score", score).filter("score IS NOT NULL").orderBy(F.desc("score"), "label", "handle").limit(most)


def tags(kind: Column, category: Column, food: Column, rsvp: Column) -> Column:
    return F.array_join(
        F.filter(
            F.array(F.when(kind == "student_deadline", F.lit("Deadline")), F.when(category != "other", F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))), F.when(food, F.lit("Free food")), F.when(rsvp.isNotNull(), F.lit("RSVP"))),
            lambda t: t.isNotNull(),
        ),
        ", ",
    )


def calendar_entry(listings: DataFrame) -> DataFrame:
    """id, body: an iCalendar event; dates for all-day rows, an hour where no end is printed."""
    stamp = lambda ts: F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("T"), F.date_format(ts, "HHmmss"), F.lit("Z"))
    end = F.coalesce(F.col("ends_at"), F.expr("starts_at + INTERVAL '1' HOUR"))
    dates = F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(times.campus_day(F.col("starts_at")), "yyyyMMdd"))
    clock = F.concat(F.lit("DTSTART:"), stamp(F.col("starts_at")), F.lit("\r\nDTEND:"), stamp(end))
    only = times.is_date_only(F.col("all_day"), F.col("starts_at"), F.col("ends_at"))
    summary = texts.fold_calendar_line(F.concat(F.lit("SUMMARY:"), texts.calendar_text(F.col("title"))))
    return listings.select("id", F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id"), F.when(only, dates).otherwise(clock), summary, F.lit("END:VEVENT")).alias("body"))
