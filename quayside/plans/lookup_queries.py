"""Queries of lookups, single decisions and collection runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times, urls
from ..operators import changes, feed, lookups
from ..sources.listings import NOW, VIEW_SQL, listings, utc_sql
from ..sources.tables import table
from .feed_queries import kind_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = (VIEW_SQL if view else "") + sql
        return run

    return add


def _rows(spark, folder):
    return feed.with_sort(listings(spark, folder))


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- lookups -----------------------------------------------------------------------------------

@query("SELECT place, id, title FROM (SELECT 0 AS place, * FROM listings WHERE k = 65 UNION ALL SELECT 2, * FROM listings WHERE k = 33 UNION ALL SELECT 3, * FROM listings WHERE k = 7)")
def lookup_by_ids(spark, folder):
    """Ids in an order of their own, one of them named twice and one that doesn't exist."""
    rows = listings(spark, folder)
    by_key = {r.k: r.id for r in rows.filter("k IN (7, 33, 65)").select("k", "id").collect()}  # three ids
    ids = [by_key[65], "none", by_key[33], by_key[65], by_key[7]]
    place = F.array_position(F.array(*map(F.lit, dict.fromkeys(ids))), F.col("id")) - 1
    return lookups.rows_by_ids(rows, ids).select(place.cast("int").alias("place"), "id", "title")


@query("SELECT id, title, content_kind FROM listings WHERE k = (SELECT max(k) FROM listings WHERE content_kind = 'fundraiser')")
def point_lookup(spark, folder):
    """A listing that the feed doesn't show is still found by its id."""
    rows = listings(spark, folder)
    wanted = rows.filter("content_kind = 'fundraiser'").agg(F.max_by("id", "k")).first()[0]  # one value
    return lookups.row_by_id(rows, wanted).select("id", "title", "content_kind")


def _sources(spark, folder):
    """Sources of five keys each."""
    rows = listings(spark, folder).filter("source = 'instagram'").withColumn("source_key", F.concat(F.lit("instagram:post:"), F.floor(F.col("k") / 5).cast("string")))
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("id"))))
    return rows.groupBy("source_key").agg(ids(F.col("k") % 5 < 3).alias("event_ids"), ids(F.col("k") % 5 < 4).alias("known_event_ids"), (F.min("k") % 11 == 0).alias("deleted"))


_SOURCES = """, src AS (SELECT 'instagram:post:' || (k // 5) AS source_key, k, id FROM listings WHERE source = 'instagram'),
  deleted AS (SELECT source_key, min(k) % 11 = 0 AS deleted FROM src GROUP BY 1)
"""


@query(
    _SOURCES
    + """SELECT source_key, count(*) FILTER (k % 5 < 3) AS events, count(*) FILTER (k % 5 < 4) AS known FROM src GROUP BY 1
      HAVING source_key IN ('instagram:post:3', 'instagram:post:40') OR bool_or(k % 5 < 3 AND k IN (65, 66, 67, 68, 69)) OR bool_or(k % 5 < 4 AND k BETWEEN 129 AND 134)"""
)
def registry_slice(spark, folder):
    rows = listings(spark, folder).filter("k BETWEEN 65 AND 69 OR k BETWEEN 129 AND 134").select("k", "id").collect()  # eleven ids
    own, known = [r.id for r in rows if r.k < 70], [r.id for r in rows if r.k > 70]
    found = lookups.registry_slice(_sources(spark, folder), ["instagram:post:3", "instagram:post:40"], own, known)
    return found.select("source_key", F.size("event_ids").cast("long").alias("events"), F.size("known_event_ids").cast("long").alias("known"))


@query(
    """SELECT c_name AS handle, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Curated ' || c_custkey END, CASE WHEN c_custkey % 5 <> 0 THEN 'Full ' || c_custkey END, c_name) AS label,
      CAST(coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN -c_custkey END) AS VARCHAR) AS user_id, c_custkey % 3 = 0 AS curated FROM customer""",
    view=False,
)
def roster_enrichment(spark, folder):
    """Followed profiles beside curated accounts: a third is curated, some without a label, some profiles without a name or id."""
    c, key = table(spark, folder, "customer"), F.col("c_custkey")
    followed = c.select(F.col("c_name").alias("handle"), F.when(key % 5 != 0, F.concat(F.lit("Full "), key)).otherwise("").alias("label"), F.when(key % 7 != 0, key).alias("user_id"))
    curated = c.filter(key % 3 == 0).select(F.upper("c_name").alias("handle"), F.when(key % 2 == 0, F.concat(F.lit("Curated "), key)).otherwise("").alias("label"), (-key).alias("user_id"))
    found = lookups.enriched_roster(lookups.roster(followed, curated), curated)
    return found.withColumn("user_id", F.col("user_id").cast("string"))


@query(
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'skipped' WHEN c_custkey % 2 = 0 THEN 'unchanged' WHEN c_custkey % 3 = 0 THEN 'filled' ELSE 'failed' END AS state FROM customer) GROUP BY 1""",
    view=False,
)
def id_filling(spark, folder):
    c, key = table(spark, folder, "customer"), F.col("c_custkey")
    accounts = c.select(F.when(key % 11 == 0, " @ ").otherwise(F.concat(F.lit(" @"), F.upper("c_name"))).alias("handle"), F.when(key % 2 == 0, key).alias("user_id"))
    found = c.filter(key % 3 == 0).select(F.lower("c_name").alias("handle"), key.alias("user_id"))
    return lookups.state_counts(lookups.filled_ids(accounts, found), "state")


@query(
    """SELECT handle, label FROM (SELECT lower(c_name) AS handle, CASE WHEN c_custkey % 2 = 0 THEN 'Label ' || c_custkey ELSE c_name END AS label FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
      WHERE handle NOT IN ('customer#000000004', 'customer#000000009')""",
    view=False,
)
def club_directory(spark, folder):
    c, key = table(spark, folder, "customer"), F.col("c_custkey")
    accounts = c.filter(key % 2 == 0).select(F.upper("c_name").alias("handle"), F.concat(F.lit("Label "), key).alias("label"))
    return lookups.known_clubs(c.filter(key % 3 == 0).select(F.col("c_name").alias("handle")), accounts, ["customer#000000004", "customer#000000009"])


@query("SELECT id, CASE WHEN (k % 40) % 2 = 0 THEN 'Owner ' || k % 40 ELSE CASE WHEN (c % 40) % 3 = 0 THEN 'Handle ' || c % 40 END END AS account FROM listings")
def roster_fallback(spark, folder):
    """The roster has the even owners and every third collected account."""
    posts = listings(spark, folder).select("id", F.concat(F.lit("Owner_"), F.col("k") % 40).alias("owner"), F.concat(F.lit("HANDLE_"), F.col("c") % 40).alias("handle"))
    n = F.col("id")
    accounts = spark.range(40).filter(n % 2 == 0).select(F.concat(F.lit("owner_"), n).alias("handle"), F.concat(F.lit("Owner "), n).alias("label"))
    accounts = accounts.unionByName(spark.range(40).filter(n % 3 == 0).select(F.concat(F.lit("handle_"), n).alias("handle"), F.concat(F.lit("Handle "), n).alias("label")))
    return lookups.roster_of_posts(posts, accounts).select("id", "account")


@query("SELECT l.id AS event_id, r.id AS other_event_id, l.starts_at AS first_start, r.starts_at AS other_start FROM listings l JOIN listings r ON r.k = l.k + 32 WHERE l.k % 64 = 1 AND l.k % 5 > 0 AND r.k % 5 > 0")
def live_pairs(spark, folder):
    """A queue of pairs 32 keys apart, over listings of which every fifth is gone."""
    rows = listings(spark, folder)
    left, right = rows.filter("k % 64 = 1").select(F.col("id").alias("event_id"), (F.col("k") + 32).alias("k")), rows.select(F.col("id").alias("other_event_id"), "k")
    return lookups.live_pairs(left.join(right, "k").drop("k"), rows.filter("k % 5 > 0"))


@query("SELECT id, title FROM listings WHERE k IN (33, 65)")
def merge_pair_fetch(spark, folder):
    rows = listings(spark, folder)
    a, b = (r.id for r in rows.filter("k IN (33, 65)").select("id").collect())  # two ids
    gone = lookups.merge_pair_rows(rows, a, "gone").unionByName(lookups.merge_pair_rows(rows, a, a))
    return lookups.merge_pair_rows(rows, a, b).unionByName(gone).select("id", "title")


@query(
    _SOURCES
    + f"""SELECT source_key, string_agg(id, ',' ORDER BY id) AS ids FROM src JOIN listings USING (id, k) JOIN deleted USING (source_key)
      WHERE k % 5 < 3 AND NOT deleted AND starts_at BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 3 DAY
      AND (k // 5) % 4 <> 1 AND NOT ((k // 5) % 4 = 2 AND (k // 5) % 10 < 6) GROUP BY 1"""
)
def due_sources(spark, folder):
    """A quarter of the sources was seen present, a quarter missing, (key % 10) hours ago."""
    sources = _sources(spark, folder)
    n = F.substring_index("source_key", ":", -1).cast("long")
    checked = (_ts(NOW) - F.make_dt_interval(F.lit(0), (n % 10).cast("int"))).alias("checked_at")
    checks = sources.filter(n % 4 > 0).select("source_key", F.when(n % 4 == 1, "present").when(n % 4 == 2, "missing").otherwise("unknown").alias("status"), checked)
    found = lookups.due_sources(sources, listings(spark, folder), checks, NOW)
    return found.select("source_key", F.array_join("ids", ",").alias("ids"))


@query(_SOURCES + f"SELECT DISTINCT source_key FROM src JOIN listings USING (id, k) WHERE k % 5 < 3 AND coalesce(ends_at, starts_at) > TIMESTAMP '{NOW}'")
def supporting_posts(spark, folder):
    return lookups.supporting_posts(_sources(spark, folder), listings(spark, folder), NOW)


@query("SELECT k AS media_id FROM listings WHERE k % 5 > 0 AND k % 3 = 0 AND k % 4 = 1")
def failed_downloads(spark, folder):
    k = F.col("k")
    rows = listings(spark, folder)
    posts = rows.select(k.alias("media_id"), F.when(k % 5 > 0, F.concat(F.lit("code"), k)).otherwise("").alias("shortcode"))
    extractions = rows.select(k.alias("media_id"), F.when(k % 3 == 0, "error").otherwise("ok").alias("status"), F.when(k % 4 == 1, "download").otherwise("ocr").alias("stage"))
    return lookups.failed_downloads(posts, extractions).select("media_id")


@query("SELECT user_id, last_scan_at FROM (SELECT user_id, max(CASE WHEN user_id % 7 > 0 THEN ts END) AS last_scan_at FROM events GROUP BY 1) ORDER BY last_scan_at NULLS FIRST, user_id LIMIT 40", view=False)
def oldest_attempts(spark, folder):
    seen = table(spark, folder, "events").groupBy("user_id").agg(F.max(F.when(F.col("user_id") % 7 > 0, F.col("ts"))).alias("last_scan_at"))
    accounts, checkpoints = seen.select(F.col("user_id").alias("handle")), seen.filter("last_scan_at IS NOT NULL").select(F.col("user_id").alias("handle"), "last_scan_at")
    return lookups.oldest_attempts(accounts, checkpoints, 40).select(F.col("handle").alias("user_id"), "last_scan_at")


@query(
    """SELECT user_id AS source_key, ts AS assessed_at, event_type AS origin, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_type DESC, event_id DESC) AS n
      FROM (SELECT user_id, CASE WHEN event_id % 3 > 0 THEN date_trunc('day', ts) END AS ts, event_type, max(event_id) AS event_id FROM events GROUP BY ALL)) WHERE n = 1""",
    view=False,
)
def latest_assessments(spark, folder):
    """Candidates of one key per day and origin."""
    e = table(spark, folder, "events")
    day = F.when(F.col("event_id") % 3 > 0, F.date_trunc("day", "ts").cast("timestamp_ntz"))
    candidates = e.groupBy(F.col("user_id").alias("source_key"), day.alias("assessed_at"), F.col("event_type").alias("origin")).agg(F.max("event_id").alias("event_id"))
    return lookups.latest_assessments(candidates)


@query("SELECT c % 40 AS group_id, arg_max(id, k) AS newest FROM listings GROUP BY 1")
def newest_source(spark, folder):
    return lookups.newest_media(listings(spark, folder).select((F.col("c") % 40).alias("group_id"), F.col("k").alias("media"), "id"))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN (page_id % 13) * 10 >= (page_id % 7) * 20 THEN 'a' ELSE 'b' END AS largest FROM pages""",
    view=False,
)
def largest_image(spark, folder):
    """Two images of each page; every fourth page has none with a link."""
    p = F.col("page_id")
    image = lambda url, width, height: F.struct(F.when(p % 4 != 0, F.lit(url)).alias("url"), width.cast("int").alias("width"), F.lit(height).alias("height"))
    return table(spark, folder, "pages").select("page_id", lookups.largest_image(F.array(image("a", p % 13, 10), image("b", p % 7, 20))).alias("largest"))


_SESSIONS = "(SELECT k // 8 AS post, k, title, date_trunc('day', starts_at) + to_hours(CAST(k % 3 AS INTEGER)) AS starts_at FROM listings)"


@query(
    f"""SELECT k, CASE WHEN s > 1 THEN CASE WHEN t > 1 THEN stamp || '-' || substr(sha256(lower(title)), 1, 6) ELSE stamp END END AS suffix FROM
      (SELECT *, count(*) OVER (PARTITION BY post) AS s, count(*) OVER (PARTITION BY post, stamp) AS t FROM (SELECT *, strftime(starts_at, '%Y%m%dT%H%MZ') AS stamp FROM {_SESSIONS}))"""
)
def session_suffixes(spark, folder):
    day = F.date_trunc("day", "starts_at").cast("timestamp_ntz")
    rows = listings(spark, folder).select(F.floor(F.col("k") / 8).alias("post"), "k", "title", (day + F.make_dt_interval(F.lit(0), (F.col("k") % 3).cast("int"))).alias("starts_at"))
    return lookups.session_stamps(rows).select("k", "suffix")


@query("SELECT k FROM (SELECT k, count(*) OVER (PARTITION BY k // 4) AS n FROM listings WHERE k % 5 <> 2) WHERE n <= 3")
def season_cap(spark, folder):
    rows = listings(spark, folder).filter("k % 5 <> 2").select(F.floor(F.col("k") / 4).alias("post"), "k")
    return lookups.without_seasons(rows, 3).select("k")


@query(
    """SELECT owner, count(*) AS n FROM (SELECT CASE WHEN source = 'instagram' AND k % 2 = 0 THEN 'instagram' WHEN source = 'campus_website' AND k % 2 = 1 THEN 'retired_campus' ELSE 'other' END AS owner FROM listings) GROUP BY 1"""
)
def import_owners(spark, folder):
    rows = listings(spark, folder).withColumn("id", F.when(F.col("k") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("ucr_events_"), "k")))
    return rows.groupBy(lookups.import_owner().alias("owner")).agg(F.count("*").alias("n"))


@query(
    """SELECT k // 5 AS source_key, bool_and(CASE WHEN ends_at IS NOT NULL THEN NOT ends_at > TIMESTAMP '1998-06-15 07:00:00' WHEN k % 17 = 0 THEN false ELSE NOT starts_at >= TIMESTAMP '1998-06-15 07:00:00' END) AS finished
      FROM listings GROUP BY 1"""
)
def source_relevance(spark, folder):
    """Every seventeenth start without an end is unknown."""
    start = F.when(~((F.col("k") % 17 == 0) & F.col("ends_at").isNull()), F.col("starts_at"))
    dates = listings(spark, folder).select(F.floor(F.col("k") / 5).alias("source_key"), start.alias("starts_at"), "ends_at")
    return lookups.finished_sources(dates, "1998-06-15 07:00:00")


_CUT = "1998-06-01 00:00:00"


@query(
    f"""SELECT k, CASE k % 8 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN starts_at < TIMESTAMP '{_CUT}' WHEN 3 THEN greatest(starts_at, ends_at) < TIMESTAMP '{_CUT}'
      WHEN 4 THEN (CAST(starts_at AS DATE) + 1)::TIMESTAMP AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC' < TIMESTAMP '{_CUT}' ELSE false END AS finished FROM listings"""
)
def retention_payloads(spark, folder):
    """Payloads of every kind: failed, an announcement, occurrences without and with an end, schedules, none, unreadable, unknown."""
    k, iso = F.col("k"), lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.concat(F.lit('{"starts_at":"'), iso(F.col("starts_at")), F.lit('"}'))
    two = F.concat(F.lit('{"starts_at":"'), iso(F.col("starts_at")), F.lit('","ends_at":"'), iso(F.col("ends_at")), F.lit('"}'))
    result = (
        F.when(k % 8 == 1, '"kind":"announcement"')
        .when(k % 8 == 2, F.concat(F.lit('"kind":"activity","occurrences":['), one, F.lit("]")))
        .when(k % 8 == 3, F.concat(F.lit('"kind":"deadline","occurrences":['), one, F.lit(","), two, F.lit("]")))
        .when(k % 8 == 4, F.concat(F.lit('"kind":"service_schedule","schedule":{"last_day":"'), F.date_format("starts_at", "yyyy-MM-dd"), F.lit('"}')))
        .when(k % 8 == 5, '"kind":"activity","occurrences":[]')
        .when(k % 8 == 6, '"kind":"activity","occurrences":[{"starts_at":"soon"}]')
        .otherwise('"kind":"something"')
    )
    payload = F.concat(F.lit('{"status":"'), F.when(k % 8 == 0, "error").otherwise("complete"), F.lit('","result":{'), F.coalesce(result, F.lit("")), F.lit("}}"))
    return listings(spark, folder).select("k", lookups.payload_finished(payload, _ts(_CUT)).alias("finished"))


@query(
    """SELECT string_agg(handle || '=' || n, ',' ORDER BY handle) AS pairs FROM (SELECT host_handle AS handle, count(*) AS n FROM listings GROUP BY 1)"""
)
def object_map(spark, folder):
    counts = listings(spark, folder).groupBy(F.col("host_handle").alias("handle")).agg(F.count("*").alias("n"))
    entries = F.transform(F.map_entries("by_key"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return lookups.grouped_map(counts, "handle", "n").select(F.array_join(entries, ",").alias("pairs"))


@query("SELECT id, k % 2 = 0 AS all_day FROM listings WHERE NOT is_locked AND k % 4 <> 3 AND k % 7 <> 2 AND k % 5 <> 1")
def precision_backfill(spark, folder):
    """Every fourth payload has two occurrences, every seventh another start, every fifth no precision."""
    k = F.col("k")
    start = F.date_format(F.when(k % 7 == 2, F.expr("starts_at + INTERVAL '1' MINUTE")).otherwise(F.col("starts_at")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.when(k % 5 == 1, "").otherwise(F.concat(F.lit(',"all_day":'), F.when(k % 2 == 0, "true").otherwise("false")))
    one = F.concat(F.lit('{"starts_at":"'), start, F.lit('"'), said, F.lit("}"))
    payload = F.concat(F.lit('{"status":"complete","result":{"occurrences":['), one, F.when(k % 4 == 3, F.concat(F.lit(","), one)).otherwise(""), F.lit("]}}"))
    return lookups.only_precision(listings(spark, folder).select("id", "is_locked", "starts_at", payload.alias("payload")))


@query(
    """SELECT 'club_' || p AS profile, count(*) FILTER (k % 3 > 0) AS wanted, count(*) FILTER (k % 3 > 0 AND k % 5 > 0) AS found, count(*) FILTER (k % 3 > 0 AND k % 5 = 0) AS missing,
      count(*) FILTER (k % 3 = 0 AND k % 5 > 0) AS extra, count(*) FILTER (k % 3 > 0 AND k % 5 = 0) = 0 AS complete FROM range(45) AS r(p) LEFT JOIN listings ON c % 40 = p AND p < 40 GROUP BY 1"""
)
def profile_completeness(spark, folder):
    rows = listings(spark, folder).select(F.col("host_handle").alias("profile"), "id", "k")
    return lookups.completeness(spark.range(45).select(F.concat(F.lit("club_"), "id").alias("profile")), rows.filter("k % 3 > 0"), rows.filter("k % 5 > 0"))


@query(f"SELECT id, starts_at AS changed_at FROM listings WHERE content_kind IN ('student_event', 'student_deadline') AND coalesce(ends_at, starts_at) >= TIMESTAMP '{NOW}' ORDER BY sort_at, id LIMIT 500")
def sitemap(spark, folder):
    return lookups.sitemap(feed.active(feed.public(_rows(spark, folder)), NOW).withColumn("updated_at", F.lit(None).cast("timestamp_ntz")))


# --- decisions ---------------------------------------------------------------------------------


def _merges(spark, folder):
    """Merges of a listing and the one 32 keys on, with each reason for a refusal in turn."""
    rows = listings(spark, folder).withColumn("updated_at", F.col("starts_at"))
    left = rows.filter("k % 64 = 1").select("k", F.col("id").alias("kept_id"), F.col("starts_at").alias("kept_updated_at"))
    right = rows.select((F.col("k") - 32).alias("k"), F.col("id").alias("removed_id"), F.col("starts_at").alias("removed_updated_at"))
    m, k = left.join(right, "k"), F.floor(F.col("k") / 64) % 6
    merges = m.select(
        F.col("k").alias("merge_id"),
        "kept_id",
        F.when(k == 1, F.col("kept_id")).when(k == 2, F.lit("gone")).otherwise(F.col("removed_id")).alias("removed_id"),
        F.when(k == 4, F.create_map(F.lit("title"), F.lit("x"))).otherwise(F.create_map(F.lit("location"), F.lit("Merged Hall"), F.lit("has_free_food"), F.lit("true"))).alias("changes"),
        F.when(k == 3, F.expr("kept_updated_at + INTERVAL '1' SECOND")).otherwise(F.col("kept_updated_at")).alias("kept_updated_at"),
        "removed_updated_at",
    )
    return rows, merges


_MERGES = ", m AS (SELECT l.k, l.id AS kept_id, r.id AS removed_id, l.k // 64 % 6 AS t FROM listings l JOIN listings r ON r.k = l.k + 32 WHERE l.k % 64 = 1), ok AS (SELECT * FROM m WHERE t IN (0, 5))\n"


@query(_MERGES + "SELECT k AS merge_id, ['', 'same listing', 'gone', 'changed since', 'column not allowed'][t + 1] AS reason FROM m WHERE t BETWEEN 1 AND 4")
def merge_refusals(spark, folder):
    rows, merges = _merges(spark, folder)
    return changes.merge_refusals(merges, rows)


def _allowed(spark, folder):
    rows, merges = _merges(spark, folder)
    return rows, merges.join(changes.merge_refusals(merges, rows), "merge_id", "left_anti")


@query(
    _MERGES
    + """SELECT id, CASE WHEN kept_id IS NOT NULL THEN 'Merged Hall' ELSE location END AS location, kept_id IS NOT NULL OR has_free_food AS has_free_food FROM listings LEFT JOIN (SELECT kept_id FROM ok) ON id = kept_id
      WHERE id NOT IN (SELECT removed_id FROM ok)"""
)
def merge_pair(spark, folder):
    rows, merges = _allowed(spark, folder)
    return changes.merged_listings(rows, merges).select("id", "location", "has_free_food")


@query(
    _MERGES
    + _SOURCES[:-1]
    + """, e AS (SELECT source_key, id, k % 5 < 3 AS own, k % 5 < 4 AS known FROM src), moved AS (SELECT source_key, kept_id FROM e JOIN ok ON removed_id = id WHERE own)
      SELECT source_key, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT id AS x FROM e WHERE e.source_key = d.source_key AND own AND id NOT IN (SELECT removed_id FROM ok) UNION SELECT kept_id FROM moved WHERE moved.source_key = d.source_key)) AS event_ids,
        (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT id AS x FROM e WHERE e.source_key = d.source_key AND known UNION SELECT kept_id FROM moved WHERE moved.source_key = d.source_key)) AS known_event_ids FROM deleted d"""
)
def merge_pair_sources(spark, folder):
    _, merges = _allowed(spark, folder)
    moved = changes.merged_sources(_sources(spark, folder).select("source_key", "event_ids", "known_event_ids"), merges)
    listed = lambda c: F.nullif(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    return moved.select("source_key", listed("event_ids"), listed("known_event_ids"))


@query(
    _MERGES
    + """, s AS (SELECT id AS event_id, k, starts_at FROM listings WHERE k % 3 = 0)
      SELECT kept_id AS event_id, 'free_food:v2:title-day:' || lower(l.title) || '|' || strftime(l.day, '%Y%m%d') AS notification_key, min(s.starts_at) AS notified_at
      FROM ok JOIN s ON s.event_id = removed_id JOIN listings l ON l.id = kept_id WHERE kept_id NOT IN (SELECT event_id FROM s) GROUP BY 1, 2"""
)
def merge_pair_alerts(spark, folder):
    rows, merges = _allowed(spark, folder)
    sent = rows.filter("k % 3 = 0").select(F.col("id").alias("event_id"), F.concat(F.lit("key "), "k").alias("notification_key"), F.col("starts_at").alias("notified_at"))
    return changes.merged_alerts(sent, merges, rows)


@query(_MERGES + "SELECT least(kept_id, removed_id) AS event_id, greatest(kept_id, removed_id) AS other_event_id, 'duplicate' AS status, kept_id AS kept_event_id FROM ok")
def merge_pair_records(spark, folder):
    return changes.merge_records(_allowed(spark, folder)[1])


@query("SELECT id, CASE WHEN k % 10 = 1 THEN 'Edited' ELSE title END AS title, CASE WHEN k % 20 = 1 THEN 'By hand' ELSE location END AS location, is_locked OR k % 10 = 1 AS is_locked FROM listings")
def edit_locks(spark, folder):
    rows = listings(spark, folder)
    edits = rows.filter("k % 10 = 1").select("id", F.lit("Edited").alias("title"), F.when(F.col("k") % 20 == 1, "By hand").alias("location"))
    return changes.edited(rows, edits).select("id", "title", "location", "is_locked")


@query("SELECT 'tombstone' AS what, count(*) AS n, sum(k) AS keys FROM listings WHERE k % 10 = 1 OR k % 14 = 0 UNION ALL SELECT 'left', count(*), sum(k) FROM listings WHERE k % 10 <> 1")
def delete_by_hand(spark, folder):
    rows = listings(spark, folder)
    tombstones, left = changes.removed_by_hand(rows, rows.filter("k % 14 = 0").select(F.col("id").alias("event_id")), rows.filter("k % 10 = 1"))
    keyed = tombstones.join(rows.select(F.col("id").alias("event_id"), "k"), "event_id")
    return keyed.agg(F.lit("tombstone").alias("what"), F.count("*").alias("n"), F.sum("k").alias("keys")).unionByName(left.agg(F.lit("left").alias("what"), F.count("*").alias("n"), F.sum("k").alias("keys")))


@query(f"SELECT * FROM (SELECT id, content_kind, {kind_sql('CAST(NULL AS VARCHAR)')} AS new_content_kind FROM listings WHERE NOT is_locked AND source <> 'instagram') WHERE new_content_kind <> content_kind")
def kind_backfill(spark, folder):
    return changes.kind_backfill(listings(spark, folder))


@query("SELECT user_id AS handle, CASE WHEN user_id % 3 = 0 THEN DATE '2024-01-01' ELSE CAST(arg_min(ts, event_id) AS DATE) END AS activated FROM events WHERE user_id % 2 = 0 GROUP BY 1", view=False)
def activation_claims(spark, folder):
    e = table(spark, folder, "events").filter("user_id % 2 = 0")
    entries = e.select(F.col("user_id").alias("handle"), F.col("ts").cast("timestamp_ntz").alias("activated_at"), F.col("event_id").alias("seq"))
    stored = e.filter("user_id % 3 = 0").select(F.col("user_id").alias("handle"), _ts("2024-01-01 00:00:00").alias("activated_at")).distinct()
    return changes.claimed_activations(stored, entries).select("handle", F.to_date("activated_at").alias("activated"))


def _routed(spark, folder):
    e = table(spark, folder, "events")
    seq = F.col("event_id")
    items = e.select(F.col("user_id").alias("handle"), F.when(seq % 50 > 0, F.floor(seq / 2)).alias("media_id"), F.col("ts").cast("timestamp_ntz").alias("posted_at"), seq.alias("seq"))
    boundary = e.select(F.col("user_id").alias("handle")).distinct().select("handle", F.when(F.col("handle") % 10 > 0, _ts("2024-01-10 00:00:00")).alias("boundary"))
    archive = e.filter(seq % 20 == 2).select(F.floor(seq / 2).alias("media_id")).distinct()
    return changes.routed_items(items, boundary, archive)


_ROUTED = """WITH i AS (SELECT user_id AS handle, CASE WHEN event_id % 50 > 0 THEN event_id // 2 END AS media_id, ts, event_id AS seq,
    event_id % 50 = 0 OR user_id % 10 = 0 AS bad, ts < TIMESTAMP '2024-01-10' AS old, (event_id // 2) % 10 = 1 AS archived FROM events),
  r AS (SELECT *, CASE WHEN bad THEN 'bad' WHEN old THEN 'old' WHEN archived OR row_number() OVER (PARTITION BY media_id, bad OR old ORDER BY seq) > 1 THEN 'seen' ELSE 'new' END AS route FROM i)
"""


@query(_ROUTED + "SELECT handle, route, count(*) AS n FROM r GROUP BY 1, 2", view=False)
def late_items(spark, folder):
    """Items with bad rows, accounts without a boundary, archived posts and repeats of a post in the run."""
    return _routed(spark, folder).groupBy("handle", "route").agg(F.count("*").alias("n"))


@query(
    _ROUTED
    + """, c AS (SELECT handle, count(DISTINCT media_id) AS posts, bool_or(route = 'bad') AS bad FROM r GROUP BY 1), d AS (SELECT *, handle % 4 > 0 AND handle % 3 > 0 AND NOT bad AND posts < 70 AS ok FROM c)
      SELECT handle, CASE WHEN ok THEN TIMESTAMP '2024-02-01' WHEN handle % 2 = 0 THEN TIMESTAMP '2024-01-05' END AS scanned_through, CASE WHEN ok THEN 'ok' ELSE 'incomplete' END AS last_status,
        CASE WHEN ok THEN 'ok' WHEN handle % 5 = 1 THEN 'error' ELSE 'warn' END AS level FROM d""",
    view=False,
)
def advanced_checkpoints(spark, folder):
    """Runs that fail for a quarter of the accounts and don't cover a third; a fifth had failed before."""
    routed = _routed(spark, folder)
    h = F.col("handle")
    handles = table(spark, folder, "events").select(F.col("user_id").alias("handle")).distinct()
    state = handles.select("handle", _ts("2024-01-01 00:00:00").alias("activated_at"), F.when(h % 2 == 0, _ts("2024-01-05 00:00:00")).alias("scanned_through"), F.when(h % 5 == 1, "incomplete").otherwise("ok").alias("last_status"))
    run = handles.select("handle", (h % 4 > 0).alias("covered"), (h % 3 > 0).alias("succeeded"))
    return changes.advanced_checkpoints(state, routed, run, 70, "2024-02-01 00:00:00").drop("activated_at")


@query(
    """SELECT handle, min(page) AS page FROM (SELECT user_id AS handle, page, old AND coalesce(lag(old) OVER (PARTITION BY user_id ORDER BY page), false) AS stop FROM
      (SELECT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS page, bool_and(event_type <> 'purchase') AS old FROM events GROUP BY 1, 2)) WHERE stop GROUP BY 1""",
    view=False,
)
def feed_stop(spark, folder):
    """A page per user and day, all old where nothing was bought."""
    page = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("page")
    pages = table(spark, folder, "events").groupBy(F.col("user_id").alias("handle"), page).agg(F.bool_and(F.col("event_type") != "purchase").alias("all_old"))
    return changes.feed_stop(pages)


@query("SELECT reuse, count(*) AS n FROM (SELECT p.k, i, i > 0 AND p.k % 3 > 0 AND p.k % 4 > 0 AS reuse FROM (SELECT k FROM listings) p, range(3) AS r(i)) GROUP BY 1")
def image_reuse(spark, folder):
    """Three images of each post: the first is never saved, every third post's content changed, every fourth failed before."""
    k = F.col("k")
    image = lambda i: F.struct(F.concat(k, F.lit(f"-{i}")).alias("image"), F.concat(k, F.lit(f"v{i}")).alias("digest"))
    posts = listings(spark, folder).select(k.alias("media_id"), F.lit("new caption").alias("caption"), F.array(*map(image, range(3))).alias("images"))
    saved = listings(spark, folder).select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    saved = saved.select(F.concat(k, F.lit("-"), "i").alias("image"), F.concat(k, F.when(k % 3 > 0, "v").otherwise("old"), "i").alias("digest"), F.when(k % 4 > 0, "ok").otherwise("failed").alias("status"))
    return changes.image_work(posts, saved).groupBy("reuse").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 0.8 * 200000 THEN 'charged to the limit' WHEN (o_orderkey % 100) * 2000.0 + 2000.0 > 0.8 * 200000 THEN 'no room for another item' END AS reason FROM orders", view=False)
def charge_coverage(spark, folder):
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", changes.charge_limited((F.col("o_orderkey") % 100).cast("double"), F.lit(2000.0), F.col("o_totalprice"), F.lit(200000.0), 0.8).alias("reason"))


@query(
    """WITH RECURSIVE a AS (SELECT user_id AS key, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT key, id, t0, n, t0 + 36000 AS reset, 1 AS used FROM a WHERE n = 1 UNION ALL
        SELECT a.key, a.id, a.t0, a.n, CASE WHEN w.reset <= a.t0 THEN a.t0 + 36000 ELSE w.reset END, CASE WHEN w.reset <= a.t0 THEN 1 ELSE least(w.used + 1, 4) END FROM w JOIN a ON a.key = w.key AND a.n = w.n + 1)
      SELECT key, id, used <= 3 AS ok, CASE WHEN used <= 3 THEN 0 ELSE greatest(1, reset - t0) END AS retry_after FROM w""",
    view=False,
)
def rate_limit(spark, folder):
    """Ten hours and three attempts, so that windows of the test table fill."""
    attempts = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("id"))
    return changes.rate_limit(attempts, 600, 3)


# --- small steps -------------------------------------------------------------------------------

_LINKS = [
    "https://forms.gle/abc", "forms.gle/ab cd", "bit.ly/x y", "https://www.instagram.com/p/1", "https://bit.ly/", "https://maps.app.goo.gl/z", "https://www.google.com/maps/place/1", "https://goo.gl/maps/2",
    "example.com/sign", "link in bio", "https://tinyurl.com/q", "https://google.com/forms/1",
]
_FOUND = [0, "https://forms.gle/abcd", None, None, None, None, None, None, "https://example.com/sign", None, 10, 11]
_LINK_SQL = "[" + ", ".join("NULL" if f is None else "'" + (_LINKS[f] if isinstance(f, int) else f) + "'" for f in _FOUND) + "]"


@query(f"SELECT id, CASE WHEN k % 12 = 1 AND k % 5 = 0 THEN NULL ELSE ({_LINK_SQL})[k % 12 + 1] END AS link FROM listings")
def rsvp_links(spark, folder):
    """Links of every kind; a slide prints the spaced short link as a line of its own, but for every fifth."""
    k = F.col("k")
    slide = F.when(k % 5 == 0, "scan forms.gle/ab cd").otherwise("Scan me\n Forms.gle/ab cd \nbit.ly/x y now")
    return listings(spark, folder).select("id", urls.rsvp_url(F.element_at(F.array(*map(F.lit, _LINKS)), (k % 12 + 1).cast("int")), slide).alias("link"))


@query("SELECT id, k % 6 IN (0, 1) AS allowed FROM listings")
def image_hosts(spark, folder):
    images = ["https://a.cdninstagram.com/1.jpg", "https://store.example.com/storage/v1/object/public/event-flyers/a/1.jpg", "http://a.cdninstagram.com/1.jpg", "https://cdninstagram.com/1.jpg", "https://store.example.com/other/1.jpg", "nothing"]
    image = F.element_at(F.array(*map(F.lit, images)), (F.col("k") % 6 + 1).cast("int"))
    return listings(spark, folder).select("id", urls.is_stored_image(image, "store.example.com").alias("allowed"))


@query("SELECT id, starts_at + to_hours(CAST(k % 60 AS INTEGER)) - INTERVAL 1 DAY > coalesce(ends_at, starts_at) AS stale FROM listings")
def stale_posts(spark, folder):
    posted = F.col("starts_at") + F.make_dt_interval(F.lit(0), (F.col("k") % 60).cast("int"))
    return listings(spark, folder).select("id", times.was_stale(posted, F.col("starts_at"), F.col("ends_at")).alias("stale"))


@query(
    f"""SELECT id, {utc_sql("CASE WHEN k % 3 < 2 AND (k % 2 = 0 OR strftime(d, '%m-%d') = '01-01') THEN d + INTERVAL 1 DAY ELSE d END")} AS ends_at FROM (SELECT id, k, CAST(ls AS DATE) AS d FROM listings)"""
)
def midnight_ends(spark, folder):
    """Starts at 20:00 on the campus whose end was read as the midnight before; the range and the day are printed for some.  Clock changes are among the days."""
    midnight = F.date_trunc("day", times.campus_time(F.col("starts_at"))).cast("timestamp_ntz")
    rows = listings(spark, folder).select("id", "k", times.utc_time((midnight + F.expr("INTERVAL '20' HOUR")).cast("timestamp_ntz")).alias("s"), times.utc_time(midnight).alias("e"))
    end = F.col("e")
    day = F.when(F.col("k") % 2 == 0, F.date_format(times.campus_time(F.col("s")), "MM-dd")).otherwise("01-01")
    return rows.select("id", times.repaired_end(F.col("s"), end, F.when(F.col("k") % 3 < 2, "20:00-00:00").otherwise("20:00-23:00"), day).alias("ends_at"))


@query("SELECT id, sort_at FROM listings WHERE k <> 65 AND sort_at >= (SELECT sort_at FROM listings WHERE k = 65) AND content_kind = 'student_event'")
def resumed_feed(spark, folder):
    """The row of the cursor is gone, so its instant is repeated."""
    rows = _rows(spark, folder)
    cursor = rows.filter("k = 65").select("sort_at", "id").first()  # one row
    return feed.resumed(rows.filter("k <> 65 AND content_kind = 'student_event'"), str(cursor.sort_at), cursor.id).select("id", "sort_at")


@query("SELECT id, CASE WHEN k % 4 = 0 THEN 'https://cdn/' || k WHEN k % 3 > 0 THEN 'https://s/storage/v1/object/public/event-flyers/c/' || k || '.jpg' END AS image_url FROM listings")
def stored_images(spark, folder):
    """Every fourth image lies elsewhere; of the rest every third file is missing."""
    k = F.col("k")
    flyer = F.concat(F.lit("https://s/storage/v1/object/public/event-flyers/c/"), k, F.lit(".jpg"))
    rows = listings(spark, folder).select("id", "k", F.when(k % 4 == 0, F.concat(F.lit("https://cdn/"), k)).otherwise(flyer).alias("image_url"))
    stored = rows.filter(k % 3 > 0).select(F.concat(F.lit("c/"), k, F.lit(".jpg")).alias("path"))
    return lookups.with_stored_images(rows, stored).select("id", "image_url")
