"""Queries of publication, retention and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed, ledger, publish
from ..sources import tables
from ..sources.listings import NOW, VIEW_SQL, campus_sql, listings
from ..sources.tables import table

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


def _registry(spark, folder):
    """Sources of five keys each, their updates, and tombstones."""
    rows = listings(spark, folder).filter("source = 'instagram'").withColumn("source_key", F.concat(F.lit("instagram:post:"), F.floor(F.col("k") / 5).cast("string")))
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("id"))))
    sources = rows.groupBy("source_key").agg(ids(F.col("k") % 5 < 3).alias("event_ids"), ids(F.col("k") % 5 < 4).alias("known_event_ids"))
    updates = rows.groupBy("source_key").agg(F.when(F.min("k") % 7 == 0, "error").otherwise("complete").alias("status"), ids(F.col("k") % 5 > 1).alias("row_ids"), ids(F.col("k") % 5 == 4).alias("known_event_ids"))
    deleted = listings(spark, folder).filter("k % 19 = 0").select(F.col("id").alias("event_id"))
    return sources, updates, deleted


_REGISTRY = """, src AS (SELECT 'instagram:post:' || (k // 5) AS source_key, k, id FROM listings WHERE source = 'instagram'),
  held AS (SELECT id FROM listings WHERE k % 19 = 0 OR is_locked),
  st AS (SELECT source_key, min(k) % 7 = 0 AS err FROM src GROUP BY 1),
  aliases AS (SELECT source_key, id FROM src JOIN st USING (source_key) WHERE k % 5 = 4 OR (NOT err AND k % 5 < 4)),
  proposed AS (SELECT source_key, id FROM src WHERE k % 5 > 1),
  stuck AS (SELECT DISTINCT source_key FROM (SELECT * FROM aliases EXCEPT SELECT * FROM proposed) WHERE id IN (SELECT id FROM held)),
  supported AS (SELECT source_key, id FROM proposed WHERE id NOT IN (SELECT id FROM held) AND ((source_key, id) IN (SELECT source_key, id FROM aliases) OR source_key NOT IN (SELECT source_key FROM stuck))),
  events_now AS (SELECT source_key, id FROM supported JOIN st USING (source_key) WHERE NOT err UNION SELECT source_key, id FROM src JOIN st USING (source_key) WHERE err AND (k % 5 < 3 OR k % 5 = 4)),
  known_now AS (SELECT source_key, id FROM aliases JOIN st USING (source_key) WHERE NOT err UNION SELECT source_key, id FROM supported JOIN st USING (source_key) WHERE NOT err UNION SELECT source_key, id FROM src JOIN st USING (source_key) WHERE err AND (k % 5 < 4 OR k % 5 = 4))
"""


@query(
    _REGISTRY
    + """SELECT st.source_key, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM events_now e WHERE e.source_key = st.source_key), '') AS event_ids,
      coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM known_now e WHERE e.source_key = st.source_key), '') AS known_event_ids FROM st"""
)
def publish_state(spark, folder):
    sources, updates, deleted = _registry(spark, folder)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c)
    return publish.publish(listings(spark, folder), sources, deleted, updates).select("source_key", listed("event_ids"), listed("known_event_ids"))


@query(
    _REGISTRY
    + """SELECT id FROM listings WHERE NOT is_locked AND source = 'instagram' AND id NOT IN (SELECT id FROM events_now)
      AND id IN (SELECT id FROM (SELECT source_key, id FROM aliases JOIN st USING (source_key) WHERE NOT err EXCEPT SELECT source_key, id FROM supported))"""
)
def publish_deletes(spark, folder):
    sources, updates, deleted = _registry(spark, folder)
    rows = listings(spark, folder)
    return publish.retired_listings(rows, sources, publish.publish(rows, sources, deleted, updates))


@query(", src AS (SELECT 'instagram:post:' || (k // 5) AS source_key, CASE WHEN k % 6 = 0 THEN id || 'm' ELSE id END AS id FROM listings WHERE source = 'instagram' AND k % 5 < 3) SELECT source_key, string_agg(DISTINCT id, ',' ORDER BY id) AS event_ids FROM src GROUP BY 1")
def remap_sources(spark, folder):
    sources = _registry(spark, folder)[0]
    moves = listings(spark, folder).filter("k % 6 = 0").select(F.col("id").alias("old"), F.concat("id", F.lit("m")).alias("new"))
    return publish.remap_sources(sources, moves).withColumn("event_ids", F.array_join("event_ids", ","))


@query(f"SELECT id, greatest(starts_at, coalesce(ends_at, starts_at)) AS ended_at FROM listings WHERE greatest(starts_at, coalesce(ends_at, starts_at)) < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND NOT is_locked AND source <> 'manual' ORDER BY 2, 1 LIMIT 50")
def retire_batch(spark, folder):
    return publish.retire_batch(listings(spark, folder), NOW)


def _files(spark, folder):
    pages = table(spark, folder, "pages").select(F.concat(F.lit("club/"), "page_id", F.lit(".jpg")).alias("path"))
    named = listings(spark, folder).select(F.concat(F.lit("club/"), (F.col("k") % 200 * 2).cast("string"), F.lit(".jpg")).alias("path"))
    return pages, publish.file_references(named, named.filter("path LIKE '%7.jpg'"))


@query("SELECT path FROM (SELECT 'club/' || page_id || '.jpg' AS path FROM pages) WHERE path NOT IN (SELECT 'club/' || (k % 200 * 2) || '.jpg' FROM listings) ORDER BY path LIMIT 500")
def unused_files(spark, folder):
    return publish.unused_files(*_files(spark, folder), most=None)


@query("SELECT DISTINCT 'club/' || (k % 200 * 2) || '.jpg' AS path FROM listings WHERE 'club/' || (k % 200 * 2) || '.jpg' NOT IN (SELECT 'club/' || page_id || '.jpg' FROM pages)")
def missing_files(spark, folder):
    return publish.missing_files(*_files(spark, folder))


def _attempts(spark, folder):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "neutral").otherwise("ok")
    return table(spark, folder, "events").select(F.col("user_id").alias("handle"), F.col("ts").alias("at"), F.col("event_id").alias("id"), outcome.alias("outcome"))


_ATTEMPTS = "SELECT user_id AS handle, ts AS t, event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'neutral' ELSE 'ok' END AS outcome FROM events"


@query(
    f"""SELECT handle, max(run) AS longest, max(run) >= 3 AS stops FROM (SELECT handle, island, CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS run FROM
      (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY handle ORDER BY t, id) AS island FROM ({_ATTEMPTS}) WHERE outcome <> 'neutral') GROUP BY 1, 2) GROUP BY 1""",
    view=False,
)
def failure_streaks(spark, folder):
    return ledger.failure_streaks(_attempts(spark, folder))


@query(
    f"SELECT level, count(*) AS n FROM (SELECT CASE WHEN outcome <> 'failed' THEN 'ok' WHEN lag(outcome) OVER (PARTITION BY handle ORDER BY t, id) = 'failed' THEN 'error' ELSE 'warn' END AS level FROM ({_ATTEMPTS})) GROUP BY 1",
    view=False,
)
def status_changes(spark, folder):
    return ledger.status_changes(_attempts(spark, folder)).groupBy("level").agg(F.count("*").alias("n"))


def _checkpoints(spark, folder):
    ts = F.col("ts")
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("handle")).agg(F.min(ts).alias("activated_at"), F.max(F.when(F.col("event_type") == "click", ts)).alias("scanned_through"))


_CHECKPOINTS = "SELECT user_id AS handle, min(ts) AS activated_at, max(ts) FILTER (event_type = 'click') AS scanned_through FROM events GROUP BY 1"


@query(f"SELECT handle, greatest(activated_at, coalesce(scanned_through - INTERVAL 300 SECOND, activated_at)) AS boundary FROM ({_CHECKPOINTS})", view=False)
def watermark_boundary(spark, folder):
    return ledger.boundaries(_checkpoints(spark, folder))


@query(
    f"""SELECT handle, activated_at, CASE WHEN handle % 3 = 0 THEN scanned_through - INTERVAL 1 HOUR ELSE scanned_through END AS scanned_through FROM ({_CHECKPOINTS})""",
    view=False,
)
def checkpoint_merge(spark, folder):
    local = _checkpoints(spark, folder).filter("handle % 2 = 0 OR handle % 3 <> 0")
    back = F.when(F.col("handle") % 3 == 0, F.expr("scanned_through - INTERVAL '1' HOUR")).otherwise(F.col("scanned_through"))
    return ledger.merged_checkpoints(local, _checkpoints(spark, folder).withColumn("scanned_through", back))


@query(
    f"""SELECT event_id AS media_id, user_id AS handle FROM events JOIN ({_CHECKPOINTS}) c ON user_id = handle
      WHERE event_type = 'purchase' AND ts >= greatest(activated_at, coalesce(scanned_through - INTERVAL 300 SECOND, activated_at)) AND event_id % 10 <> 0""",
    view=False,
)
def new_post_antijoin(spark, folder):
    posts = table(spark, folder, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("media_id"), F.col("user_id").alias("handle"), F.col("ts").alias("posted_at"))
    known = posts.filter("media_id % 10 = 0")
    return ledger.new_posts(posts, ledger.boundaries(_checkpoints(spark, folder)), known).select("media_id", "handle")


@query(
    """WITH p AS (SELECT c_mktsegment AS name, count(*) AS weight FROM customer GROUP BY 1), b AS (SELECT name, CAST(floor(10007 * weight / (SELECT sum(weight) FROM p)) AS BIGINT) AS base, row_number() OVER (ORDER BY name) AS n FROM p)
      SELECT name, CAST(base + CASE WHEN n <= 10007 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS share FROM b""",
    view=False,
)
def budget_split(spark, folder):
    parts = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("weight"))
    return ledger.split_budget(parts, 10007)


@query(
    f"""SELECT hour, CAST(floor((n - 1) / 20.0) AS BIGINT) AS batch, min(handle) AS "first", count(*) AS n FROM (SELECT handle, hour, row_number() OVER (PARTITION BY hour ORDER BY boundary, handle) AS n FROM
      (SELECT handle, boundary, date_trunc('hour', boundary) AS hour FROM (SELECT event_id AS handle, ts AS boundary FROM events))) GROUP BY 1, 2""",
    view=False,
)
def job_batches(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("handle"), F.col("ts").alias("boundary"))
    return ledger.job_batches(rows, 20)


@query(
    f"""SELECT month, slot, count(*) AS n FROM (SELECT month, CASE WHEN (n - 1) // 1000 < 3 THEN (n - 1) // 1000 ELSE -1 END AS slot FROM
      (SELECT month, row_number() OVER (PARTITION BY month ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(date_trunc('month', {campus_sql('ts')}) AS DATE) AS month FROM events))) GROUP BY 1, 2""",
    view=False,
)
def quota_slots(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return ledger.quota_slots(rows, 1000, 3).groupBy("month", F.col("slot").cast("long").alias("slot")).agg(F.count("*").alias("n"))


_NKEY = "'title-day:' || lower(trim(title)) || '|' || strftime(day, '%Y-%m-%d')"


@query(f"SELECT key AS notification_key, min(id) AS id FROM (SELECT id, k, has_free_food AND coalesce(ends_at, starts_at) > TIMESTAMP '{NOW}' AS due, {_NKEY} AS key FROM listings) WHERE due AND key NOT IN (SELECT {_NKEY} FROM listings WHERE k % 30 = 0) GROUP BY 1")
def notify_ledger(spark, folder):
    rows = listings(spark, folder)
    sent = rows.filter("k % 30 = 0").select(ledger.notification_key().alias("notification_key"))
    return ledger.to_notify(rows, sent, NOW)


@query("SELECT id, min(starts_at) AS notified_at FROM (SELECT CASE WHEN k % 3 = 0 THEN 'g' || (k % 50) ELSE id END AS id, starts_at FROM listings WHERE k % 2 = 0) GROUP BY 1")
def alerts_inherit(spark, folder):
    rows = listings(spark, folder)
    sent = rows.filter("k % 2 = 0").select("id", F.col("starts_at").alias("notified_at"))
    moves = rows.filter("k % 3 = 0").select(F.col("id").alias("old"), F.concat(F.lit("g"), (F.col("k") % 50).cast("string")).alias("new"))
    return ledger.inherited_alerts(sent, moves)


_CHECKS = "SELECT user_id AS id, ts AS t, CAST(ts AS DATE) AS run, event_type = 'error' AS missing FROM events"


@query(
    f"""WITH c AS ({_CHECKS}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS n FROM c) WHERE n = 1),
      o AS (SELECT run FROM f GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (missing) * 2 > count(*))
      SELECT id FROM c WHERE missing AND run NOT IN (SELECT run FROM o) GROUP BY 1 HAVING count(*) >= 2 AND max(t) >= min(t) + INTERVAL 6 HOUR""",
    view=False,
)
def withdrawal_confirm(spark, folder):
    checks = table(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.to_date("ts").alias("run"), (F.col("event_type") == "error").alias("missing"))
    return ledger.withdrawals(checks)


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)", view=False)
def cache_reuse(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    status = F.when(F.col("doc_id") % 3 == 0, "complete").otherwise("failed").alias("status")
    return ledger.cache_misses(rows, rows.select("hash", status)).select("doc_id")


@query(
    """SELECT host_handle, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, array_to_string(list_sort(list_filter(list_distinct(list(category)), lambda x: x NOT IN ('other', 'arts'))), ',') AS without,
      list_contains(list(category), 'sports') AS sporty FROM listings GROUP BY 1"""
)
def array_set_ops(spark, folder):
    found = listings(spark, folder).groupBy("host_handle").agg(F.array_sort(F.collect_set("category")).alias("c"))
    two = F.array(F.lit("other"), F.lit("arts"))
    return found.select("host_handle", F.array_join("c", ",").alias("categories"), F.array_join(F.array_except("c", two), ",").alias("without"), F.arrays_overlap("c", F.array(F.lit("sports"))).alias("sporty"))


@query(
    """SELECT id, array_to_string(list_filter([CASE WHEN trim(t) = '' THEN 'no title' END, CASE WHEN e < starts_at THEN 'ends before start' END, CASE WHEN NOT regexp_matches(u, '^(https?|HTTPS?)://[^ ]+$') THEN 'bad link' END], lambda x: x IS NOT NULL), ',') AS errors
      FROM (SELECT id, starts_at, CASE WHEN k % 31 = 0 THEN ' ' ELSE title END AS t, CASE WHEN k % 37 = 1 THEN starts_at - INTERVAL 1 HOUR ELSE ends_at END AS e, CASE WHEN k % 41 = 0 THEN 'ftp://x' ELSE rsvp_url END AS u FROM listings)
      WHERE trim(t) = '' OR e < starts_at OR NOT regexp_matches(u, '^(https?|HTTPS?)://[^ ]+$')"""
)
def constraint_quarantine(spark, folder):
    rows = listings(spark, folder)
    broken = rows.withColumns(
        {
            "title": F.when(F.col("k") % 31 == 0, " ").otherwise(F.col("title")),
            "ends_at": F.when(F.col("k") % 37 == 1, F.expr("starts_at - INTERVAL '1' HOUR")).otherwise(F.col("ends_at")),
            "rsvp_url": F.when(F.col("k") % 41 == 0, "ftp://x").otherwise(F.col("rsvp_url")),
        }
    )
    bad = tables.split_quarantine(broken.withColumn("errors", tables.listing_errors()))[1]
    return bad.select("id", F.array_join("errors", ",").alias("errors"))


@query("SELECT id, count(*) AS sources FROM (SELECT k // 5 AS s, id FROM listings WHERE source = 'instagram' AND k % 5 < 3) GROUP BY 1")
def support_map(spark, folder):
    return publish.support_counts(_registry(spark, folder)[0])


@query(f"SELECT id, CASE WHEN ends_at IS NOT NULL THEN ends_at > TIMESTAMP '1998-06-15 07:00:00' ELSE starts_at >= TIMESTAMP '1998-06-15 07:00:00' END AS relevant FROM listings")
def row_relevance(spark, folder):
    from ..functions import times

    return listings(spark, folder).select("id", times.relevance(F.col("starts_at"), F.col("ends_at"), feed.instant("1998-06-15 07:00:00")).alias("relevant"))


@query("SELECT id, CASE WHEN k % 4 = 0 THEN 'https://cdn/' || k ELSE NULL END AS image, k % 4 = 0 AS changed FROM listings")
def media_relink(spark, folder):
    """Media elements take their URL from a table by key; rows without a hit are unchanged."""
    rows = listings(spark, folder).select("id", F.col("k").cast("string").alias("media_key"))
    found = listings(spark, folder).filter("k % 4 = 0").select(F.col("k").cast("string").alias("media_key"), F.concat(F.lit("https://cdn/"), F.col("k").cast("string")).alias("image"))
    return rows.join(found, "media_key", "left").select("id", "image", F.col("image").isNotNull().alias("changed"))


@query("SELECT id, array_to_string(list_sort(list_filter(host_handles, lambda h: h IN ('club_1', 'club_2', 'club_3', 'club_7', 'club_8'))), ',') AS members FROM listings WHERE len(list_filter(host_handles, lambda h: h IN ('club_1', 'club_2', 'club_3', 'club_7', 'club_8'))) > 0")
def author_membership(spark, folder):
    roster = spark.range(1).select(F.explode(F.array(*(F.lit(f"club_{n}") for n in (1, 2, 3, 7, 8)))).alias("handle"))
    authors = listings(spark, folder).select("id", F.explode("host_handles").alias("handle")).join(F.broadcast(roster), "handle")  # five rows
    return authors.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("handle")), ",").alias("members"))
