"""Queries of the read path and of scalar functions, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, daylight, evidence, support, texts, times, urls, vocabulary
from ..operators import feed, sessions, validation
from ..sources.listings import GROUPS, HOST_TYPES, MOVED, NOW, TODAY, VIEW_SQL, campus_sql, listings, utc_sql
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True):
    """Register a function by its name, with its oracle over the listings view or the tables."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = (VIEW_SQL if view else "") + sql
        return run

    return add


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return feed.with_sort(listings(spark, folder))


def _public(spark: SparkSession, folder: str) -> DataFrame:
    return feed.active(feed.public(_rows(spark, folder)), NOW)


_PUBLIC = f"content_kind IN ('student_event', 'student_deadline') AND coalesce(ends_at, starts_at) >= TIMESTAMP '{NOW}'"


@query(f"SELECT id, title, sort_at, day, host, category FROM listings WHERE {_PUBLIC} ORDER BY sort_at, id LIMIT 25")
def feed_page_first(spark, folder):
    return feed.page(_public(spark, folder)).select("id", "title", "sort_at", "day", "host", "category")


_CURSOR = ("1998-07-01 12:00:00", "ig_club_20_p500")


@query(f"SELECT id, sort_at FROM listings WHERE {_PUBLIC} AND (sort_at > TIMESTAMP '{_CURSOR[0]}' OR (sort_at = TIMESTAMP '{_CURSOR[0]}' AND id > '{_CURSOR[1]}')) ORDER BY sort_at, id LIMIT 61")
def feed_page_cursor(spark, folder):
    return feed.page(_public(spark, folder), 99, _CURSOR).select("id", "sort_at")


_FILTER = feed.FeedQuery(category="hangout", search=" @Club_1", when="all", free_food=False)


@query(f"SELECT id, day FROM listings WHERE {_PUBLIC} AND category = 'hangout' AND contains(lower(concat_ws(' ', title, description, host, host_handle, array_to_string(host_handles, ' '), location)), 'club_1')")
def feed_filtered(spark, folder):
    return feed.filtered(_public(spark, folder), _FILTER, TODAY).select("id", "day")


@query(f"SELECT id, day FROM listings WHERE content_kind IN ('student_event', 'student_deadline') AND has_free_food AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-20'")
def feed_week_food(spark, folder):
    return feed.filtered(feed.public(_rows(spark, folder)), feed.FeedQuery(when="week", free_food=True), TODAY).select("id", "day")


_TYPE_SQL = "CASE host_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items()) + " END"
_MOVED_SQL = lambda h: "CASE " + h + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MOVED.items()) + " END"
_GROUPS_SQL = f"list_distinct(list_filter([coalesce({_MOVED_SQL('host_handles[1]')}, {_TYPE_SQL}), {_MOVED_SQL('host_handles[2]')}], lambda x: x IS NOT NULL))"
_FACETS = feed.FeedQuery(category="sports", when="week")


@query(
    f"""SELECT facet, value, count(*) AS n FROM (
      SELECT 'category' AS facet, unnest(CASE WHEN category <> 'other' THEN ['all', category] ELSE ['all'] END) AS value FROM listings WHERE {_PUBLIC} AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-20'
      UNION ALL SELECT 'when', 'all' FROM listings WHERE {_PUBLIC} AND category = 'sports'
      UNION ALL SELECT 'when', 'today' FROM listings WHERE {_PUBLIC} AND category = 'sports' AND day = DATE '1998-06-15'
      UNION ALL SELECT 'when', 'week' FROM listings WHERE {_PUBLIC} AND category = 'sports' AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-20'
      UNION ALL SELECT 'when', 'weekend' FROM listings WHERE {_PUBLIC} AND category = 'sports' AND day BETWEEN DATE '1998-06-20' AND DATE '1998-06-21'
      UNION ALL SELECT 'food', 'free_food' FROM listings WHERE {_PUBLIC} AND category = 'sports' AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-20' AND has_free_food
      UNION ALL SELECT 'deadlines', 'deadline' FROM listings WHERE {_PUBLIC} AND category = 'sports' AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-20' AND content_kind = 'student_deadline'
      UNION ALL SELECT 'group', unnest(list_concat(['all'], {_GROUPS_SQL})) FROM listings WHERE {_PUBLIC} AND category = 'sports' AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-20'
    ) GROUP BY facet, value"""
)
def facet_counts(spark, folder):
    return feed.facet_counts(_public(spark, folder), _FACETS, TODAY)


@query(f"SELECT count(*) AS n FROM listings WHERE {_PUBLIC} AND day >= DATE '1998-06-15' AND day < DATE '1998-06-21'")
def week_count(spark, folder):
    return feed.filtered(_public(spark, folder), feed.FeedQuery(when="week"), TODAY).agg(F.count("*").alias("n"))


@query(
    "SELECT day, count(*) AS n, CASE WHEN count(*) >= 6 THEN 3 WHEN count(*) >= 3 THEN 2 ELSE 1 END AS level FROM listings WHERE content_kind IN ('student_event', 'student_deadline') "
    "AND day >= DATE '1998-05-31' AND day < DATE '1998-07-12' GROUP BY day"
)
def calendar_counts(spark, folder):
    return feed.calendar_counts(feed.public(_rows(spark, folder)), "1998-05-31", 99)


@query(
    """SELECT month, day, date_trunc('month', day) = month AS in_month FROM (
      SELECT month, CAST(unnest(generate_series(month - CAST(dayofweek(month) AS INTEGER), last_day(month) + CAST(6 - dayofweek(last_day(month)) AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders))""",
    view=False,
)
def calendar_grid(spark, folder):
    months = table(spark, folder, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).distinct()
    return feed.calendar_grid(months)


@query("SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY sort_at, id) AS place FROM listings WHERE content_kind = 'student_deadline'")
def day_groups(spark, folder):
    return feed.by_day(_rows(spark, folder).filter("content_kind = 'student_deadline'")).select("day", "id", F.col("place").cast("long").alias("place"))


@query(f"SELECT CAST({campus_sql('ts')} AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", view=False)
def day_groups_events(spark, folder):
    day = times.campus_day(F.col("ts").cast("timestamp_ntz")).alias("day")
    return table(spark, folder, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """SELECT handle, label, score FROM (SELECT handle, label, CASE WHEN lower(label) = 'club 1' OR handle = 'club 1' THEN 4 WHEN starts_with(lower(label), 'club 1') OR starts_with(handle, 'club 1') THEN 3
      WHEN contains(' ' || lower(label), ' club 1') THEN 2 WHEN contains(lower(label), 'club 1') OR contains(handle, 'club 1') THEN 1 END AS score
      FROM (SELECT DISTINCT host_handle AS handle, host AS label FROM listings)) WHERE score IS NOT NULL ORDER BY score DESC, lower(label), handle LIMIT 8"""
)
def search_clubs(spark, folder):
    directory = listings(spark, folder).select(F.col("host_handle").alias("handle"), F.col("host").alias("label")).distinct()
    return feed.search_directory(directory.withColumn("label", F.col("label")), "Club 1").select("handle", "label", "score")


@query("SELECT id, CASE WHEN len(host_handles) = 1 THEN host_handles[1] ELSE host_handles[1] || ' & ' || host_handles[2] END AS byline FROM listings")
def public_hosts(spark, folder):
    return listings(spark, folder).select("id", texts.byline(F.col("host_handles")).alias("byline"))


@query("SELECT id, starts_at, ends_at, sort_at FROM listings WHERE content_kind = 'student_deadline'")
def sort_at_deadlines(spark, folder):
    return _rows(spark, folder).filter("content_kind = 'student_deadline'").select("id", "starts_at", "ends_at", "sort_at")


# of a time that a clock change repeats, the first is meant
@query(
    f"""SELECT o_orderkey, CASE WHEN {campus_sql('u - INTERVAL 1 HOUR')} = wall THEN u - INTERVAL 1 HOUR WHEN {campus_sql('u')} = wall THEN u END AS utc FROM
      (SELECT o_orderkey, wall, {utc_sql('wall')} AS u FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS wall FROM orders))""",
    view=False,
)
def wall_clock(spark, folder):
    wall = F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0)")
    return table(spark, folder, "orders").select("o_orderkey", times.utc_time(wall).alias("utc"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+')) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical, starts_with(url, 'http') AS is_http FROM pages", view=False)
def url_normalize(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.http_url(F.col("url")).isNotNull().alias("is_http"))


_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', '')"
_PATH = "regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = "array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|fbclid)='))), '&')"


@query(f"SELECT page_id, CASE WHEN p <> '' OR q <> '' THEN h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS identity FROM (SELECT page_id, {_HOST} AS h, {_PATH} AS p, {_QUERY} AS q FROM pages)", view=False)
def rsvp_identity(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.rsvp_identity(F.col("url")).alias("identity"))


@query(f"SELECT page_id, nullif(regexp_replace(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '([^/]+)/?$', 1), '[.][^.]*$', ''), '') AS media_key FROM pages", view=False)
def media_key(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.media_key(F.col("url")).alias("media_key"))


@query("SELECT o_orderkey, CAST(3000000000000000000 + CAST(o_orderkey AS HUGEINT) * 123456789 AS VARCHAR) AS media_id FROM orders", view=False)
def shortcode_media_id(spark, folder):
    """Ids of nineteen digits, written in base 64 and read back."""
    number = F.lit(3_000_000_000_000_000_000).cast("long") + F.col("o_orderkey") * 123_456_789
    letters = (F.substring(F.lit(urls.SHORTCODE), (F.shiftrightunsigned(number, 6 * i).bitwiseAND(63) + 1).cast("int"), F.lit(1)) for i in reversed(range(11)))
    code = F.concat(*letters)
    return table(spark, folder, "orders").select("o_orderkey", urls.shortcode_to_media_id(code).cast("string").alias("media_id"))


def _score_sql(category: str) -> str:
    parts = []
    for phrases, (in_title, in_text) in vocabulary.CONCEPTS[category]:
        pattern = classify.whole_words(phrases).replace("'", "''")
        second = f" WHEN regexp_matches(lower(description), '{pattern}') THEN {in_text}" if in_text else ""
        parts.append(f"CASE WHEN regexp_matches(lower(title), '{pattern}') THEN {in_title}{second} ELSE 0 END")
    spoken = [t for t, c in vocabulary.HOST_TYPES.items() if c == category]
    if spoken:
        parts.append(f"CASE WHEN host_type = '{spoken[0]}' THEN 1 ELSE 0 END")
    return " + ".join(parts)


_SCORES = ", ".join(f"{_score_sql(c)} AS s_{c}" for c in vocabulary.PRIORITY)
_BEST = "greatest(" + ", ".join(f"s_{c}" for c in vocabulary.PRIORITY) + ")"
_PICK = f"CASE WHEN {_BEST} < 2 THEN 'other' " + " ".join(f"WHEN s_{c} = {_BEST} THEN '{c}'" for c in vocabulary.PRIORITY) + " END"


@query(f"SELECT title, description, host_type, {_PICK} AS inferred FROM (SELECT *, {_SCORES} FROM (SELECT DISTINCT title, description, host_type FROM listings))")
def category_infer(spark, folder):
    rows = listings(spark, folder).select("title", "description", "host_type").distinct()
    return rows.withColumn("inferred", classify.category(F.col("title"), F.col("description"), F.col("host_type")))


_KINDS = ["activity", "deadline", "application", "uncertain"]


def kind_sql(assessed: str) -> str:
    """The kind of a row of the pools of titles and texts, each said to be what it is."""
    return f"""CASE WHEN {assessed} IN ('announcement', 'uncertain') THEN 'other'
      WHEN {assessed} IS NULL AND title = 'Club Closed for Break' AND description <> 'Proceeds benefit a good cause' THEN 'other'
      WHEN title = 'Bake Sale Fundraiser' OR description = 'Proceeds benefit a good cause' THEN 'fundraiser'
      WHEN source NOT IN ('instagram', 'manual') AND title <> 'Fall General Meeting' AND description <> 'All students welcome. Refreshments served' THEN 'other'
      WHEN {assessed} = 'activity' AND title = 'Scholarship Application Deadline' THEN 'student_deadline'
      WHEN {assessed} = 'activity' THEN 'student_event' WHEN {assessed} = 'deadline' THEN 'student_deadline' WHEN {assessed} = 'application' THEN 'student_application' WHEN {assessed} IS NOT NULL THEN 'other'
      WHEN title = 'Scholarship Application Deadline' THEN 'student_deadline'
      WHEN description = 'Applications are now open for our 10-week program' AND title NOT IN ('Fall General Meeting', 'Boba Social', 'Career Fair Prep Workshop', 'Research Symposium', 'Art Showcase') THEN 'student_application'
      ELSE 'student_event' END"""


@query(
    f"""SELECT title, description, source, assessed, {kind_sql('assessed')} AS kind FROM
        (SELECT DISTINCT title, description, source, CASE WHEN k % 5 < 4 THEN {['activity', 'deadline', 'application', 'uncertain']}[k % 5 + 1] END AS assessed FROM listings)"""
)
def content_kind(spark, folder):
    assessed = F.when(F.col("k") % 5 < 4, F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("k") % 5 + 1).cast("int"))).alias("assessed")
    rows = listings(spark, folder).select("title", "description", "source", assessed).distinct()
    return rows.withColumn("kind", classify.content_kind(F.col("source"), F.col("title"), F.col("description"), F.col("assessed")))


# Texts, whether they offer food, and whether they ask to sign up.
_OFFERS = [
    ("Free pizza will be provided. RSVP today", True, True), ("No food, but free tacos for members!", True, False), ("Bring your own lunch. No registration needed", False, False),
    ("Tickets $5, dinner included", False, False), ("Dinner included!", True, False), ("Refreshments not provided", False, False), ("Free hot coffee; sign-up is optional", True, False),
    ("Pizza for sale, $2. Register here", False, True), ("Snacks are provided at 6.30 pm", True, False), ("free food for $3", False, False), ("Without refreshments but lunch will be served", True, False),
    ("don't need to register, just sign up online", False, True), ("Free: iced matcha and stickers", True, False), ("We'll have light snacks", True, False), ("Kona Ice while supplies last", True, False),
    ("Free parking at dinner", False, False), ("Free raffle with pizza", False, False), ("Admission: $8. Pizza included", False, False), ("Raffle tickets $2. Pizza is served", True, False),
    ("free admission; boba", False, False), ("We will not offer free food", False, False), ("Serving hot tacos & drinks, first come", True, False), ("Coffee chats included", False, False), ("Pizza and games provided", True, False),
]
_FOOD_TEXTS = ["Free pizza will be provided. RSVP today", "No food, but free tacos for members!", "All students welcome. Refreshments served"]


@query(
    f"""SELECT DISTINCT o.text || chr(10) || chr(10) || description AS text, o.food OR list_contains({_FOOD_TEXTS}, description) AS food, o.signup OR description = 'Free pizza will be provided. RSVP today' AS signup
      FROM (SELECT [{", ".join("{'text': '" + t.replace("'", "''") + f"', 'food': {f}, 'signup': {s}}}" for t, f, s in _OFFERS)}][k % 24 + 1] AS o, description FROM listings)"""
)
def free_food_signup(spark, folder):
    offer = F.element_at(F.array(*(F.lit(t) for t, _, _ in _OFFERS)), (F.col("k") % 24 + 1).cast("int"))
    rows = listings(spark, folder).select(F.concat(offer, F.lit("\n\n"), "description").alias("text")).distinct()
    return rows.select("text", classify.free_food(F.col("text")).alias("food"), classify.signup_required(F.col("text")).alias("signup"))


# Titles with a text, and whether they offer boba; slides, and whether they are a member's profile; audiences, and what they mean.
_BOBA = [
    ("Games & Boba", "", True), ("Boba Social", "Meet us", True), ("Boba Tea House Trip", "", False), ("boba house run", "", False), ("Boba Fundraiser", "", False), ("Boba fundy", "", False), ("Boba $3", "", False),
    ("No boba this week", "", False), ("Boba & Paint", "Boba not provided", False), ("BOBA NIGHT", "boba for sale", False), ("Bobatalk", "", False), ("Boba and donate", "", False), ("Boba for purchase", "", False), ("Boba Study Jam", "free boba", True),
]
_SLIDES = [
    ("HOBBIES\nVolleyball\nFun Fact: I cook", True), ("Major: Math\nMAJOR: Physics", False), ("* Pronouns she/her\n- favourite songs: all", True), ("Name: A\nYear: 2", False), ("Our hobbies\nMajor news", False),
    ("Life song\n\nTransferred from RCC", True), ("funfact: x\nfun fact: y", False), ("Career aspiration\nFavorite street food", True), ("Majors fair", False),
]
_AUDIENCES = [
    ([], "unspecified"), (["Students"], "student"), (["Faculty_Staff"], "restricted"), (["Faculty", "General Public/Off-Campus Community"], "unspecified"), (["Parents/Family"], "restricted"),
    (["Alumni", "Graduate student"], "student"), (["Everyone"], "unspecified"), (["Studentship"], "unspecified"), (["All audiences", "donors"], "unspecified"), (["Staffing"], "unspecified"), (["Prospective employers"], "restricted"),
]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    f"""SELECT id, [{", ".join(str(want) for *_, want in _BOBA)}][k % 14 + 1] AS boba, [{", ".join(str(want) for _, want in _SLIDES)}][k % 9 + 1] AS profile, [{", ".join(f"'{want}'" for _, want in _AUDIENCES)}][k % 11 + 1] AS audience FROM listings"""
)
def slide_rules(spark, folder):
    """Titles, slides and audiences by key, beside what each is."""
    at = lambda values, n: F.element_at(F.array(*values), (F.col("k") % n + 1).cast("int"))
    rows = listings(spark, folder).select(
        "id",
        at([F.lit(t) for t, _, _ in _BOBA], 14).alias("title"),
        at([F.lit(t) for _, t, _ in _BOBA], 14).alias("text"),
        at([F.lit(t) for t, _ in _SLIDES], 9).alias("slide"),
        at([F.array(*map(F.lit, a)).cast("array<string>") for a, _ in _AUDIENCES], 11).alias("audiences"),
    )
    boba = classify.boba_offer(F.col("title"), F.col("text"))
    return rows.select("id", boba.alias("boba"), classify.is_member_profile(F.col("slide")).alias("profile"), classify.audience(F.col("audiences")).alias("audience"))


_PLACES = ["Zoom", "HUB 302", "Online via Zoom link in bio", "Discord: https://discord.gg/abc", "Zoom ID 123 456", "Google Meet and room 5", "virtual only", "Teams building", ""]
_SPACED = "' ' || regexp_replace(lower(location), '[^a-z0-9:/.]+', '  ', 'g') || ' '"


@query(
    f"""SELECT location, regexp_matches(lower(location), '{classify.PLATFORM}') AND regexp_replace(regexp_replace({_SPACED}, '{classify.FILLER}', ' ', 'g'), '[^a-z]+', '', 'g') = '' AS online, count(*) AS n FROM
      (SELECT location FROM listings UNION ALL SELECT (['{"', '".join(_PLACES)}'])[k % 9 + 1] || CASE WHEN k % 2 = 0 THEN '' ELSE ' ' || location END FROM listings) GROUP BY 1, 2"""
)
def online_location(spark, folder):
    rows = listings(spark, folder)
    made = F.concat(F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("k") % 9 + 1).cast("int")), F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "location")))
    both = rows.select("location").unionByName(rows.select(made.alias("location")))
    return both.groupBy("location", classify.is_online_only(F.col("location")).alias("online")).agg(F.count("*").alias("n"))


# Texts, the days that they pin down (month * 100 + day), and their only time range.
_PRINTED = [
    ("Join us on Oct 5 at 7pm", [1005], None), ("10/12 at 3PM", [1012], None), ("score 3/4", [], None), ("May 31st, 11-3PM", [531], "11:00-15:00"), ("5월 8일", [508], None), ("Feb 30 party", [], None), ("Meet 12/25/2025 from 1-3PM", [1225], "13:00-15:00"),
    ("31 of January", [131], None), ("12\n25\n2026\nMONTH DAY YEAR", [1225], None), ("room 3/4 at 7pm", [], None), ("1/2 cups of milk at noon", [], None), ("Psychology TUESDAY 11/17\nof gratitude", [1117], None), ("recruitment is 10/8-10/11", [1008, 1011], None),
    ("10/8 to 14/40", [], None), ("applications are due: 10/9", [1009], None), ("GENERAL MEETING SCHEDULE\n10/5\n10/12", [1005, 1012], None), ("signups close Thursday (6/11)", [611], None), ("Happy Friday! 1/2 price boba", [], None), ("on 5.62", [], None),
    ("OET 6 and Sept. 12th, 10-12PM", [912, 1006], "10:00-12:00"), ("2026-05-28, 5PM 7PM", [528], "17:00-19:00"), ("1-3PM or 2-4PM", [], None), ("11-1AM until 3/4", [304], "23:00-01:00"),
]


@query(
    f"""SELECT id, [{", ".join("'" + ",".join(map(str, days)) + "'" for _, days, _ in _PRINTED)}][k % 23 + 1] AS days, [{", ".join(f"'{r}'" if r else "NULL" for *_, r in _PRINTED)}][k % 23 + 1] AS range FROM listings"""
)
def evidence_dates(spark, folder):
    """Days and ranges printed into texts by key: every form, with near misses; the listing's own text on a line below."""
    printed = F.element_at(F.array(*(F.lit(t) for t, *_ in _PRINTED)), (F.col("k") % 23 + 1).cast("int"))
    rows = listings(spark, folder).select("id", F.concat(printed, F.lit("\n"), "description").alias("text"))
    return rows.select("id", F.array_join(evidence.evidence_days(F.col("text")), ",").alias("days"), evidence.time_range(F.col("text")).alias("range"))


@query(
    """, printed AS (SELECT id, k, title, day, CASE WHEN k % 4 = 3 THEN day - 1 ELSE day END AS said, CASE WHEN k % 5 = 4 THEN day + 7 ELSE day + CAST(k % 3 AS INTEGER) END AS last FROM listings)
      SELECT id, CAST(unnest(generate_series(day, last, INTERVAL 1 DAY)) AS DATE) AS day, k % 2 = 0 AS printed FROM printed WHERE k % 4 < 3 AND k % 5 < 4 AND (k % 2 = 0 OR year(last) = year(day))"""
)
def weekday_ranges(spark, folder):
    """Ranges of weekdays and dates of up to three days, some too long, some with a wrong weekday, every other with its year."""
    k, day = F.col("k"), F.to_date(times.campus_time(F.col("starts_at")))
    last = F.when(k % 5 == 4, F.date_add(day, 7)).otherwise(F.date_add(day, (k % 3).cast("int")))
    name = lambda d: F.date_format(d, "EEEE")
    said = F.when(k % 4 == 3, F.date_add(day, -1)).otherwise(day)
    year = lambda d: F.when(k % 2 == 0, F.date_format(d, ", yyyy")).otherwise("")
    end = lambda weekday, d: F.concat(name(weekday), F.lit(", "), F.date_format(d, "MMM d"), year(d))
    rows = listings(spark, folder).select("id", F.year(day).alias("year"), F.concat(F.lit("Open "), end(said, day), F.when(k % 7 < 3, " - ").otherwise(" through "), end(last, last), F.lit(" for all")).alias("text"))
    found = rows.select("id", F.explode(evidence.weekday_range_days(F.col("text"), F.col("year"))).alias("d"))
    return found.select("id", "d.day", "d.printed")


@query("SELECT id, k % 6 IN (0, 2, 3) AS day_ok, k % 5 < 4 AS clock_ok FROM listings")
def borne_out(spark, folder):
    """Days and clocks claimed of posts that print them, with a wrong year, another day or another minute, or name them by a word."""
    k, local = F.col("k"), times.campus_time(F.col("starts_at"))
    day = F.to_date(local)
    ahead = F.element_at(F.array(*map(F.lit, (10, 10, 1, 3, 10, 1))), (k % 6 + 1).cast("int"))
    posted = times.utc_time((F.date_sub(day, ahead).cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")).cast("timestamp_ntz"))
    words = F.array(
        F.date_format(day, "MMM d"), F.concat(F.date_format(day, "MMM d, "), F.year(day) + 1), F.lit("tomorrow"), F.concat(F.lit("this "), F.date_format(day, "EEEE")), F.date_format(F.date_add(day, 2), "MMM d"), F.lit("today"),
    )
    clock = F.when(k % 5 < 4, local).otherwise(local + F.expr("INTERVAL '1' MINUTE"))
    rows = listings(spark, folder).select("id", day.alias("day"), local.alias("local"), posted.alias("posted"), F.concat(F.lit("Join us "), F.element_at(words, (k % 6 + 1).cast("int")), F.lit(" at "), F.date_format(clock, "h:mm a"), F.lit("!")).alias("text"))
    return rows.select("id", support.day_supported(F.col("day"), F.col("text"), F.col("posted")).alias("day_ok"), support.clock_supported(F.col("local"), F.col("text")).alias("clock_ok"))


@query(
    """, posts AS (SELECT *, 'p' || k AS source_key, lower(title) AS t FROM listings WHERE k % 3 = 0)
      SELECT source_key, 0 AS occurrence, 'Register by Friday' || chr(10) || 'Day one ' || strftime(day, '%b %-d') || CASE WHEN description LIKE '%fundraising%' THEN '' ELSE chr(10) || 'bring ' || description END AS text FROM posts
      UNION ALL SELECT source_key, 1, 'Register by Friday' || chr(10) || 'Then ' || title || ' again' || chr(10) || 'until late' FROM posts
      UNION ALL SELECT 'p' || k, 0, 'Come ' || title || chr(10) || 'to ' || location FROM listings WHERE k % 3 = 1
      UNION ALL SELECT 'p' || k, 1, 'Come ' || title || chr(10) || 'to ' || location FROM listings WHERE k % 3 = 1"""
)
def session_slices(spark, folder):
    """Posts of two sessions, one told by its date and one by its title, and posts of one title; a line on fundraising is nobody's."""
    rows = listings(spark, folder).filter("k % 3 < 2").withColumns({"source_key": F.concat(F.lit("p"), "k"), "day": F.to_date(times.campus_time(F.col("starts_at")))})
    several = F.col("k") % 3 == 0
    shared = F.concat_ws("\n", F.lit("Welcome all"), F.lit("Register by Friday"), F.concat(F.lit("Day one "), F.date_format("day", "MMM d")), F.concat(F.lit("bring "), "description"), F.concat(F.lit("Then "), "title", F.lit(" again")), F.lit("until late"))
    fields = rows.select("source_key", F.lit("caption").alias("field"), F.lit(0).alias("position"), F.when(several, shared).otherwise(F.concat(F.lit("Come "), "title")).alias("text"))
    fields = fields.unionByName(rows.filter(~several).select("source_key", F.lit("slide_1_ocr").alias("field"), F.lit(1).alias("position"), F.concat(F.lit("to "), "location").alias("text")))
    cites = F.array(F.lit("caption"))
    first = rows.select("source_key", F.lit(0).alias("occurrence"), F.when(several, "Grand Opening Ceremony").otherwise(F.col("title")).alias("title"), "starts_at", cites.alias("fields"))
    second = rows.select("source_key", F.lit(1).alias("occurrence"), "title", (F.col("starts_at") + F.expr("INTERVAL '5' DAY")).alias("starts_at"), cites.alias("fields"))
    return sessions.session_texts(fields, first.unionByName(second))


@query(
    f""", days AS (SELECT id, day, unnest(generate_series(day, day + 14, INTERVAL 1 DAY)) AS d FROM listings WHERE k % 7 > 0)
      SELECT id, {utc_sql("d + to_hours(CAST(w AS INTEGER))")} AS starts_at, {utc_sql("d + to_hours(CAST(w + 2 AS INTEGER))")} AS ends_at FROM days, (SELECT unnest([9, 13]) AS w)
      WHERE isodow(d) IN (isodow(day), isodow(day + 2))"""
)
def schedule_expand(spark, folder):
    """A schedule per listing: two weeks from its day, two weekdays, two windows, all printed; every seventh claims one weekday only and gives nothing."""
    day = F.to_date(times.campus_time(F.col("starts_at")))
    last, other = F.date_add(day, 14), F.date_add(day, 2)
    shown = lambda d: F.date_format(d, "MMM d, yyyy")
    text = F.concat(shown(day), F.lit(" to "), shown(last), F.lit(" on "), F.date_format(day, "EEEE"), F.lit(" and "), F.date_format(other, "EEEE"), F.lit(", 9am-11am and 1pm-3pm"))
    window = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    rows = listings(spark, folder).select(
        "id", day.alias("first_day"), last.alias("last_day"), F.when(F.col("k") % 7 == 0, F.array(F.weekday(day))).otherwise(F.array(F.weekday(day), F.weekday(other))).alias("weekdays"),
        F.array(window("09:00", "11:00"), window("13:00", "15:00")).alias("windows"), text.alias("date_evidence"), F.lit(None).cast("timestamp_ntz").alias("posted_at"), F.lit("service_schedule").alias("kind"),
    )
    return validation.expanded_schedules(rows, "id")[0]


@query("SELECT id, CASE k % 6 WHEN 1 THEN 'no title' WHEN 2 THEN 'venue is reasoning' WHEN 3 THEN 'day not supported' WHEN 4 THEN 'start clock not supported' WHEN 5 THEN 'hours needed' END AS error FROM listings")
def occurrence_errors(spark, folder):
    """Occurrences claimed of posts that print their day and clock: one in six is right, the others fail one rule each."""
    k, wall = F.col("k"), times.campus_time(F.col("starts_at"))
    day = F.to_date(wall)
    rows = listings(spark, folder).select("id", "k", wall.alias("starts_at"), day.alias("day"), "title")
    said = F.when(k % 6 == 3, F.date_add("day", 2)).otherwise(F.col("day"))
    clock = F.when(k % 6 == 4, F.col("starts_at") + F.expr("INTERVAL '1' MINUTE")).otherwise(F.col("starts_at"))
    text = F.concat(F.date_format(said, "MMM d, yyyy, "), F.date_format(clock, "h:mm a"))
    # of a clock that a change repeats, the first
    offset = (F.unix_timestamp(F.col("starts_at").cast("timestamp")) - F.unix_timestamp(F.convert_timezone(F.lit(times.CAMPUS), F.lit("UTC"), F.col("starts_at")).cast("timestamp"))) / 60
    claimed = rows.select(
        "id", F.when(k % 6 == 1, " ").otherwise(F.col("title")).alias("title"), F.lit(False).alias("all_day"), "starts_at", F.lit(None).cast("timestamp_ntz").alias("ends_at"), offset.cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"),
        F.when(k % 6 == 2, "Barn (probably)").otherwise("Barn").alias("location"), F.lit("Barn").alias("location_evidence"), F.lit("said").alias("activity_evidence"), text.alias("date_evidence"), F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        F.when(k % 6 == 5, "service_schedule").otherwise("activity").alias("kind"), F.lit("").alias("caption"), F.array(text).alias("texts"), F.lit(True).alias("cites_caption"),
    )
    return validation.judged(validation.with_read_bounds(claimed), validation.occurrence_rules()).select("id", "error")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 'unknown decision' WHEN doc_id % 9 = 2 THEN 'kind and role disagree' WHEN doc_id % 9 = 3 THEN 'no activity evidence' WHEN doc_id % 9 = 4 THEN 'incompatible choices'
      WHEN doc_id % 9 = 5 THEN 'nothing to publish' WHEN doc_id % 9 = 6 THEN 'hours need a schedule' WHEN doc_id % 9 = 7 THEN 'a dated cutoff is a deadline' END AS error FROM documents""",
    view=False,
)
def decision_errors(spark, folder):
    """Decisions about documents, with one fault each by id."""
    n = F.col("doc_id") % 9
    rows = table(spark, folder, "documents").select(
        "doc_id", F.when(n == 1, "party").when(n == 6, "service_schedule").when(n == 7, "application").otherwise("activity").alias("kind"),
        F.when(n == 2, "cutoff").when(n == 6, "recurring_hours").when(n == 7, "none").otherwise("occurrence").alias("date_role"), F.lit("because").alias("reason"), F.when(n != 3, "said").alias("activity_evidence"), F.lit("then").alias("date_evidence"),
        F.when(n.isin(5, 7), 0).otherwise(1).alias("occurrences"), (n == 4).alias("has_schedule"), F.when(n == 7, "Apply by Oct 14").otherwise("All welcome").alias("source_text"),
    )
    return validation.judged(rows, validation.decision_rules()).select("doc_id", "error")


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN content_kind = 'student_deadline' THEN 'Deadline' END,
      CASE category WHEN 'other' THEN NULL WHEN 'get_involved' THEN 'Get Involved' ELSE upper(category[1]) || category[2:] END,
      CASE WHEN has_free_food THEN 'Free food' END, CASE WHEN rsvp_url IS NOT NULL THEN 'RSVP' END], lambda x: x IS NOT NULL), ', ') AS tags FROM listings"""
)
def tags_and_ranges(spark, folder):
    return listings(spark, folder).select("id", feed.tags(F.col("content_kind"), F.col("category"), F.col("has_free_food"), F.col("rsvp_url")).alias("tags"))


@query(
    """SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest FROM conversations GROUP BY conv_id""",
    view=False,
)
def conversation_sessions(spark, folder):
    rows = table(spark, folder, "conversations")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(roles, ">").alias("roles"), F.max(F.length("text").cast("long")).alias("longest"))


@query(
    "SELECT id, title, src FROM (SELECT id, title, 'loaded' AS src FROM listings WHERE k % 3 = 0 UNION ALL SELECT id, upper(title), 'fetched' FROM listings WHERE k % 6 = 0 AND k % 3 <> 0 OR k % 3 = 1)"
)
def merge_pages(spark, folder):
    rows = listings(spark, folder)
    loaded = rows.filter("k % 3 = 0").select("id", "title", F.lit("loaded").alias("src"))
    fetched = rows.filter("k % 6 = 0 OR k % 3 = 1").select("id", F.upper("title").alias("title"), F.lit("fetched").alias("src"))
    return feed.merged_pages(loaded, fetched)


@query()
def calendar_entries(spark, folder):
    return feed.calendar_entry(listings(spark, folder))


@query(
    f"""SELECT id, round(elevation, 4) AS elevation, CASE WHEN elevation > 6 THEN 'day' WHEN elevation > -4 THEN 'golden' ELSE 'night' END AS daypart FROM (
      SELECT id, degrees(asin(sin(n) * sin(dec) + cos(n) * cos(dec) * cos(radians((18.697374558 + 24.06570982441908 * d) * 15 + {daylight.LONGITUDE}) - ra))) AS elevation FROM (
      SELECT id, d, radians({daylight.LATITUDE}) AS n, asin(sin(e) * sin(l)) AS dec, atan2(cos(e) * sin(l), cos(l)) AS ra FROM (
      SELECT id, d, radians(23.439 - 0.00000036 * d) AS e, radians(280.459 + 0.98564736 * d + 1.915 * sin(g) + 0.02 * sin(2 * g)) AS l FROM (
      SELECT id, d, radians(357.529 + 0.98560028 * d) AS g FROM (SELECT id, CAST(epoch(starts_at) - 946728000 AS DOUBLE) / 86400 AS d FROM listings WHERE starts_at IS NOT NULL)))))"""
)
def solar_daypart(spark, folder):
    rows = listings(spark, folder).filter("starts_at IS NOT NULL").select("id", daylight.solar_elevation(F.col("starts_at")).alias("elevation"))
    return rows.select("id", F.round("elevation", 4).alias("elevation"), daylight.daypart(F.col("elevation")).alias("daypart"))
