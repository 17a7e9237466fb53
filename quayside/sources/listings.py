"""A deterministic listings table over orders and customers, in Spark and in DuckDB SQL.

The synthetic tables have no event vocabulary, so titles, texts and places come from literal pools
by key.  Both forms below must stay equal; the oracles are built on the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

TITLES = [
    "Fall General Meeting", "Boba Social", "Career Fair Prep Workshop", "Volleyball Tournament", "Open Mic Night", "Beach Cleanup", "Research Symposium",
    "Scholarship Application Deadline", "Bake Sale Fundraiser", "Movie Night", "Club Closed for Break", "Summer Research Fellowship", "Resume Review", "Art Showcase", "Study Break", "Weekly Hangout",
]
TEXTS = [
    "Free pizza will be provided. RSVP today", "No food, but free tacos for members!", "Applications are now open for our 10-week program", "Bring your own lunch. No registration needed",
    "Tickets $5, dinner included", "All students welcome. Refreshments served", "Proceeds benefit a good cause", "Meet recruiters and bring a resume",
    "Volunteers needed for the food drive", "Join us on Zoom with @club_3", "Talk by our fundraising chair", "Board games and snacks for sale",
]
PLACES = ["Zoom", "HUB 302", "The Hub, Room 302", "", "Online via Zoom link in bio", "Rec Center", "Bell Tower", "Discord: https://discord.gg/abc"]
KINDS = ["student_event", "student_event", "student_deadline", "student_event", "student_application", "student_event", "fundraiser", "student_event", "other", "student_event"]
HOST_TYPES = ["service", "athletics", "arts-and-expression", "academic-professional", "fraternity-sorority", "cultural", "none"]
CATEGORIES = ["hangout", "get_involved", "career", "academic", "sports", "arts", "volunteering", "other"]
NOW, TODAY = "1998-06-15 19:00:00", "1998-06-15"
#: Named groups of directory types, and a host that is moved by hand.
GROUPS = {"service": "service", "athletics": "active", "arts-and-expression": "culture", "cultural": "culture", "fraternity-sorority": "greek"}
MOVED = {"club_5": "service"}


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_orderdate")
    k, c = F.col("k"), F.col("c")
    handle = F.concat(F.lit("club_"), (c % 40).cast("string"))
    starts = F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(c % 24 AS INT), 0, 0)")
    add = lambda hours: F.expr(f"starts_at + INTERVAL '{hours}' HOUR")
    second = F.concat(F.lit("club_"), ((c + 7) % 40).cast("string"))
    return (
        o.withColumn("starts_at", starts)
        .withColumn("host_handle", handle)
        .select(
            F.concat(F.lit("ig_"), "host_handle", F.lit("_p"), k.cast("string")).alias("id"),
            "k",
            "c",
            _pick(TITLES, k).alias("title"),
            _pick(TEXTS, c).alias("description"),
            _pick(PLACES, k + c).alias("location"),
            F.concat(F.lit("Club "), (c % 40).cast("string")).alias("host"),
            "host_handle",
            F.when(k % 6 == 0, F.array("host_handle", second)).otherwise(F.array("host_handle")).alias("host_handles"),
            _pick(HOST_TYPES, c % 40).alias("host_type"),
            "starts_at",
            F.when(k % 4 == 1, add(1)).when(k % 4 == 2, add(3)).when(k % 4 == 3, add(24)).alias("ends_at"),
            F.when(k % 4 == 3, True).when(k % 4 != 0, False).alias("all_day"),
            _pick(CATEGORIES, k).alias("category"),
            _pick(KINDS, k).alias("content_kind"),
            F.when(k % 9 == 0, "campus_website").when(k % 11 == 0, "manual").otherwise("instagram").alias("source"),
            (k % 5 == 0).alias("has_free_food"),
            (k % 13 == 0).alias("is_locked"),
            F.when(k % 3 == 1, F.concat(F.lit("https://forms.gle/"), (k % 500).cast("string")))
            .when(k % 3 == 2, F.concat(F.lit("HTTPS://Example.com/Sign/"), (k % 300).cast("string"), F.lit("/?utm_source=ig&b=2&a=1")))
            .alias("rsvp_url"),
        )
    )


def _sql_pick(values: list[str], at: str) -> str:
    return "(" + "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[(({at}) % {len(values)}) + 1]"


LISTINGS_SQL = f"""
SELECT 'ig_club_' || (c % 40) || '_p' || k AS id, k, c, {_sql_pick(TITLES, 'k')} AS title, {_sql_pick(TEXTS, 'c')} AS description,
  {_sql_pick(PLACES, 'k + c')} AS location, 'Club ' || (c % 40) AS host, 'club_' || (c % 40) AS host_handle,
  CASE WHEN k % 6 = 0 THEN ['club_' || (c % 40), 'club_' || ((c + 7) % 40)] ELSE ['club_' || (c % 40)] END AS host_handles,
  {_sql_pick(HOST_TYPES, 'c % 40')} AS host_type, s AS starts_at,
  CASE k % 4 WHEN 1 THEN s + INTERVAL 1 HOUR WHEN 2 THEN s + INTERVAL 3 HOUR WHEN 3 THEN s + INTERVAL 24 HOUR END AS ends_at,
  CASE k % 4 WHEN 3 THEN true WHEN 0 THEN NULL ELSE false END AS all_day, {_sql_pick(CATEGORIES, 'k')} AS category, {_sql_pick(KINDS, 'k')} AS content_kind,
  CASE WHEN k % 9 = 0 THEN 'campus_website' WHEN k % 11 = 0 THEN 'manual' ELSE 'instagram' END AS source,
  k % 5 = 0 AS has_free_food, k % 13 = 0 AS is_locked,
  CASE k % 3 WHEN 1 THEN 'https://forms.gle/' || (k % 500) WHEN 2 THEN 'HTTPS://Example.com/Sign/' || (k % 300) || '/?utm_source=ig&b=2&a=1' END AS rsvp_url
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_custkey % 24 AS INTEGER)) AS s FROM orders)
"""


def campus_sql(ts: str) -> str:
    return f"(({ts}) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')"


def utc_sql(wall: str) -> str:
    return f"(({wall}) AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC')"


#: `listings` with the campus clock and the sort instant.
VIEW_SQL = f"""
WITH base AS ({LISTINGS_SQL}),
local AS (SELECT *, {campus_sql('starts_at')} AS ls, {campus_sql('ends_at')} AS le FROM base),
listings AS (SELECT *, CAST(ls AS DATE) AS day,
  CASE WHEN content_kind = 'student_deadline' AND ends_at > starts_at AND ls = date_trunc('day', ls) AND le = date_trunc('day', le)
       THEN {utc_sql("date_trunc('day', ls) + INTERVAL '23 hours 59 minutes'")} ELSE starts_at END AS sort_at FROM local)
"""
