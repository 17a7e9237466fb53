"""Lookups and small relational steps around the stored tables: by id, by membership, by recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times

#: Lists of ids that a caller names are literals of the plan up to this length, and a table beyond it.
LITERAL_IDS = 1000


def _named(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """rows whose column is one of values: pushed to the scan while they are few, else a semi join."""
    values = list(dict.fromkeys(values))
    if len(values) <= LITERAL_IDS:
        return rows.filter(F.col(column).isin(values))
    ids = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return rows.join(ids, column, "left_semi")


def rows_by_ids(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of these ids, each once, in the order in which the ids are first named."""
    ids = list(dict.fromkeys(ids))
    order = rows.sparkSession.createDataFrame([(v, n) for n, v in enumerate(ids)], "id string, place int")
    return rows.join(order, "id").orderBy("place").drop("place")


def row_by_id(rows: DataFrame, row_id: str) -> DataFrame:
    """One row whatever its kind: a link to a listing goes on working when its kind changes."""
    return rows.filter(F.col("id") == row_id).limit(1)


def registry_slice(sources: DataFrame, keys: list[str] | None = None, event_ids: list[str] | None = None, known_event_ids: list[str] | None = None) -> DataFrame:
    """Sources named by key, or that own or know one of the ids; all of them where nothing is asked for."""
    if keys is None and event_ids is None and known_event_ids is None:
        return sources
    holds = F.lit(False)
    if keys:
        holds = holds | F.col("source_key").isin(keys)
    for column, values in (("event_ids", event_ids), ("known_event_ids", known_event_ids)):
        if values:
            holds = holds | F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False))
    return sources.filter(holds)


def roster(followed: DataFrame, curated: DataFrame) -> DataFrame:
    """The followed accounts, or the curated ones while none are followed."""
    some = followed.select(F.lit(True).alias("some")).limit(1)
    fallback = curated.join(F.broadcast(some), how="left_anti", on=F.lit(True))  # one row at most
    return followed.unionByName(fallback, allowMissingColumns=True)


def enriched_roster(followed: DataFrame, curated: DataFrame) -> DataFrame:
    """handle, label, user_id, curated: what is curated wins, names of profiles fill its gaps, the profile's id is newest."""
    own = curated.select(F.lower("handle").alias("key"), F.col("label").alias("own_label"), F.col("user_id").alias("own_id"))
    met = followed.withColumn("key", F.lower("handle")).join(own, "key", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return met.select("handle", F.coalesce(given("own_label"), given("label"), "handle").alias("label"), F.coalesce("user_id", "own_id").alias("user_id"), F.col("own_label").isNotNull().alias("curated"))


def filled_ids(accounts: DataFrame, found: DataFrame) -> DataFrame:
    """accounts with user_id filled from found (handle, user_id), and the state of each: unchanged, filled, failed or skipped.

    An account without a handle is skipped; one that has an id isn't looked up again.
    """
    handle = F.lower(F.regexp_replace(F.trim("handle"), "^@", ""))
    looked = accounts.withColumn("handle", handle).join(found.select("handle", F.col("user_id").alias("found_id")), "handle", "left")
    state = F.when(F.coalesce("handle", F.lit("")) == "", "skipped").when(F.col("user_id").isNotNull(), "unchanged").when(F.col("found_id").isNotNull(), "filled").otherwise("failed")
    return looked.withColumn("state", state).withColumn("user_id", F.coalesce("user_id", "found_id")).drop("found_id")


def state_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def known_clubs(activity: DataFrame, accounts: DataFrame, anonymous: list[str]) -> DataFrame:
    """handle, label: activity handles and the roster, whose label wins; anonymous ones are left out."""
    both = activity.select(F.lower("handle").alias("handle"), F.col("handle").alias("label"), F.lit(1).alias("rank"))
    both = both.unionByName(accounts.select(F.lower("handle").alias("handle"), "label", F.lit(0).alias("rank")))
    best = both.groupBy("handle").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))
    return best.filter(~F.col("handle").isin(anonymous))


def roster_of_posts(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """posts with the label of their owner's account, else of the account they were collected from."""
    label = lambda key, name: accounts.select(F.lower("handle").alias(key), F.col("label").alias(name))
    lowered = posts.withColumns({"owner_key": F.lower("owner"), "handle_key": F.lower("handle")})
    met = lowered.join(label("owner_key", "owner_label"), "owner_key", "left").join(label("handle_key", "handle_label"), "handle_key", "left")
    return met.withColumn("account", F.coalesce("owner_label", "handle_label")).drop("owner_key", "handle_key", "owner_label", "handle_label")


def live_pairs(queue: DataFrame, listings: DataFrame) -> DataFrame:
    """Review pairs both of whose listings are live, by the start of the first."""
    side = lambda end, name: listings.select(F.col("id").alias(end), F.col("starts_at").alias(name))
    return queue.join(side("event_id", "first_start"), "event_id").join(side("other_event_id", "other_start"), "other_event_id").orderBy("first_start", "event_id", "other_event_id")


def merge_pair_rows(listings: DataFrame, kept: str, removed: str) -> DataFrame:
    """Both rows of a pair; none where it isn't a pair or one of them is gone."""
    both = listings.filter(F.col("id").isin(kept, removed))
    whole = both.agg((F.count_distinct("id") == (2 if kept != removed else 3)).alias("whole")).filter("whole")
    return both.join(F.broadcast(whole), F.lit(True), "left_semi")  # one row at most


def due_sources(sources: DataFrame, listings: DataFrame, checks: DataFrame, now: str, days: int = 3, hours: int = 6) -> DataFrame:
    """source_key, ids: listings that start within `days` days, of sources that are not deleted and still need a look.

    checks: source_key, status (present or missing), checked_at.  What was seen present is done; what
    was missing is looked at again after `hours` hours.
    """
    at = F.lit(now).cast("timestamp_ntz")
    soon = listings.filter((F.col("starts_at") >= at) & (F.col("starts_at") <= at + F.expr(f"INTERVAL '{days}' DAY"))).select("id")
    owned = sources.filter(~F.coalesce("deleted", F.lit(False))).select("source_key", F.explode(F.array_distinct("event_ids")).alias("id")).join(soon, "id", "left_semi")
    recent = (F.col("status") == "missing") & (F.col("checked_at") > at - F.expr(f"INTERVAL '{hours}' HOUR"))
    done = checks.filter((F.col("status") == "present") | recent).select("source_key")
    return owned.join(done, "source_key", "left_anti").groupBy("source_key").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def supporting_posts(sources: DataFrame, listings: DataFrame, now: str) -> DataFrame:
    """source_key of the posts that support a listing still to end; a listing without dates isn't live."""
    live = listings.filter(F.coalesce("ends_at", "starts_at") > F.lit(now).cast("timestamp_ntz")).select("id")
    return sources.select("source_key", F.explode("event_ids").alias("id")).join(live, "id", "left_semi").select("source_key").distinct()


def failed_downloads(posts: DataFrame, extractions: DataFrame) -> DataFrame:
    """Posts with a shortcode whose saved extraction failed while downloading."""
    failed = extractions.filter("status = 'error' AND stage = 'download'").select("media_id")
    return posts.filter("shortcode IS NOT NULL AND shortcode <> ''").join(failed, "media_id", "left_semi")


def oldest_attempts(accounts: DataFrame, checkpoints: DataFrame, most: int) -> DataFrame:
    """The accounts whose last attempt lies furthest back, those never tried first."""
    return accounts.join(checkpoints.select("handle", "last_scan_at"), "handle", "left").orderBy(F.col("last_scan_at").asc_nulls_first(), "handle").limit(most)


def latest_assessments(candidates: DataFrame) -> DataFrame:
    """Of each source the candidate assessed last; of equal times the one from the registry.

    candidates: source_key, assessed_at (null: oldest), origin (cache or registry).
    """
    return candidates.groupBy("source_key").agg(F.max_by(F.struct(*(c for c in candidates.columns if c != "source_key")), F.struct("assessed_at", "origin")).alias("a")).select("source_key", "a.*")


def newest_media(groups: DataFrame) -> DataFrame:
    """group_id and the member of the highest media number, then id."""
    return groups.groupBy("group_id").agg(F.max_by("id", F.struct("media", "id")).alias("newest"))


def largest_image(images: Column) -> Column:
    """Of an array of structs with url, width and height, the url of the largest area; the first of equal ones."""
    area = lambda i: F.coalesce(i["width"].cast("long") * i["height"].cast("long"), F.lit(0))
    usable = F.filter(images, lambda i: i["url"].isNotNull())
    numbered = F.transform(usable, lambda i, n: F.struct(area(i).alias("area"), (-n).alias("first"), i["url"].alias("url")))
    return F.array_max(numbered)["url"]


def session_stamps(sessions: DataFrame) -> DataFrame:
    """sessions (post, title, starts_at) with their id suffix: none for the only one of a post, the UTC minute,
    and the title's hash after it where two sessions of a post start together."""
    stamp = F.date_format("starts_at", "yyyyMMdd'T'HHmm'Z'")
    of_post = Window.partitionBy("post")
    counted = sessions.withColumn("stamp", stamp).withColumn("sessions", F.count("*").over(of_post)).withColumn("together", F.count("stamp").over(Window.partitionBy("post", "stamp")))
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " ")))
    suffix = F.when(F.col("together") > 1, F.concat("stamp", F.lit("-"), F.substring(F.sha2(title, 256), 1, 6))).otherwise(F.col("stamp"))
    return counted.withColumn("suffix", F.when(F.col("sessions") > 1, suffix)).drop("stamp", "together", "sessions")


def without_seasons(sessions: DataFrame, most: int = 10) -> DataFrame:
    """Sessions of posts that list at most `most`: a longer list is a season's schedule and publishes nothing."""
    return sessions.withColumn("sessions", F.count("*").over(Window.partitionBy("post"))).filter(F.col("sessions") <= most).drop("sessions")


def import_owner() -> Column:
    """Which importer owns a row, by its source and the namespace of its id."""
    owned = lambda source, prefix: (F.col("source") == source) & F.col("id").startswith(prefix)
    return F.when(owned("instagram", "ig_"), "instagram").when(owned("campus_website", "ucr_events_"), "retired_campus").otherwise("other")


def finished_sources(dates: DataFrame, midnight: str) -> DataFrame:
    """source_key, finished: every known date of a source is over; one unknown date keeps it, and so does having none.

    dates: source_key, starts_at, ends_at, one row per known date.
    """
    over = times.relevance(F.col("starts_at"), F.col("ends_at"), F.lit(midnight).cast("timestamp_ntz"))
    return dates.groupBy("source_key").agg(F.bool_and(F.coalesce(~over, F.lit(False))).alias("finished"))


def payload_finished(payload: Column, cutoff: Column) -> Column:
    """Whether an assessment (JSON text) tells of nothing that ends at or after the cutoff (UTC).

    Only complete ones count; announcements and applications are never in the way; a schedule ends
    with its last campus day; of occurrences every one must have ended; what can't be read is not over.
    """
    occurrence = "array<struct<starts_at:string,ends_at:string>>"
    known = F.from_json(payload, f"status string, result struct<kind:string,schedule:struct<last_day:string>,occurrences:{occurrence}>")
    kind, schedule, each = known["result"]["kind"], known["result"]["schedule"], known["result"]["occurrences"]
    after = times.utc_time(F.date_add(F.try_to_timestamp(schedule["last_day"]).cast("date"), 1).cast("timestamp_ntz"))
    instant = lambda text: times.instant_or_utc(text)

    def ended(o: Column) -> Column:
        readable = (o["ends_at"].isNull() | instant(o["ends_at"]).isNotNull()) & instant(o["starts_at"]).isNotNull()
        return readable & (F.greatest(instant(o["starts_at"]), instant(o["ends_at"])) < cutoff)

    by_date = F.when(schedule.isNotNull(), after < cutoff).otherwise((F.size(each) > 0) & F.forall(each, lambda o: F.coalesce(ended(o), F.lit(False))))
    dated = kind.isin("activity", "deadline", "service_schedule")
    return F.coalesce((known["status"] == "complete") & (kind.isin("announcement", "application") | (dated & F.coalesce(by_date, F.lit(False)))), F.lit(False))


def grouped_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One map of all values by key: {key: value}, of keys that are unique and few (a batch's own)."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("by_key"))


def only_precision(sources: DataFrame) -> DataFrame:
    """id, all_day from payloads with exactly one occurrence that says it, and says when the listing starts.

    sources: id, is_locked, starts_at and payload (JSON text).
    """
    schema = "status string, result struct<occurrences:array<struct<starts_at:string,all_day:boolean>>>"
    read = sources.withColumn("p", F.from_json("payload", schema)).filter("NOT is_locked AND p.status = 'complete' AND size(p.result.occurrences) = 1")
    each = read.select("id", "starts_at", F.explode("p.result.occurrences").alias("o"))
    return each.filter(F.col("o.all_day").isNotNull() & (times.instant_or_utc(F.col("o.starts_at")) == F.col("starts_at"))).select("id", F.col("o.all_day").alias("all_day"))


def completeness(profiles: DataFrame, reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """profile, wanted, found, missing, extra, complete for every profile, also those that neither side names."""
    r = reference.select("profile", "id").distinct().withColumn("r", F.lit(1))
    c = candidate.select("profile", "id").distinct().withColumn("c", F.lit(1))
    n = lambda cond: F.count(F.when(cond, 1))
    has_r, has_c = F.col("r").isNotNull(), F.col("c").isNotNull()
    counts = r.join(c, ["profile", "id"], "full").groupBy("profile").agg(n(has_r).alias("wanted"), n(has_r & has_c).alias("found"), n(has_r & ~has_c).alias("missing"), n(~has_r & has_c).alias("extra"))
    return profiles.select("profile").join(counts, "profile", "left").na.fill(0).withColumn("complete", F.col("missing") == 0)


def sitemap(listings: DataFrame, most: int = 500) -> DataFrame:
    """The first active listings in feed order: id and when it was last changed."""
    return listings.orderBy("sort_at", "id").limit(most).select("id", F.coalesce("updated_at", "starts_at").alias("changed_at"))


def with_stored_images(rows: DataFrame, stored: DataFrame, column: str = "image_url", marker: str = "/storage/v1/object/public/event-flyers/") -> DataFrame:
    """rows whose image is null where it names a file of the own storage that isn't there; other links stay."""
    path = F.when(F.col(column).contains(marker), F.substring_index(column, marker, -1))
    met = rows.withColumn("image_path", path).join(stored.select(F.col("path").alias("image_path"), F.lit(True).alias("stored")), "image_path", "left")
    return met.withColumn(column, F.when(F.col("image_path").isNull() | F.col("stored"), F.col(column))).drop("image_path", "stored")
