"""State transitions of single decisions and of collection runs, as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, texts, times

#: Fixed: what a merge may change of the kept listing.
MERGEABLE = ("has_free_food", "rsvp_required", "hosts", "ends_at", "rsvp_url", "image_url", "location")


def merge_refusals(merges: DataFrame, listings: DataFrame) -> DataFrame:
    """merge_id, reason of merges that can't be made; the first reason that holds.

    merges: merge_id, kept_id, removed_id, changes (map of column to text), kept_updated_at,
    removed_updated_at.
    """
    side = lambda end, name: listings.select(F.col("id").alias(end), F.col("updated_at").alias(name))
    met = merges.join(side("kept_id", "kept_now"), "kept_id", "left").join(side("removed_id", "removed_now"), "removed_id", "left")
    other = F.size(F.array_except(F.map_keys("changes"), F.array(*map(F.lit, MERGEABLE)))) > 0
    reason = (
        F.when(F.col("kept_id") == F.col("removed_id"), "same listing")
        .when(F.col("kept_now").isNull() | F.col("removed_now").isNull(), "gone")
        .when((F.col("kept_now") != F.col("kept_updated_at")) | (F.col("removed_now") != F.col("removed_updated_at")), "changed since")
        .when(F.coalesce(other, F.lit(False)), "column not allowed")
    )
    return met.select("merge_id", reason.alias("reason")).filter("reason IS NOT NULL")


def merged_listings(listings: DataFrame, merges: DataFrame) -> DataFrame:
    """Listings after merges that were not refused: the removed ones are gone, the kept ones have the changes."""
    changes = merges.groupBy("kept_id").agg(F.max_by("changes", "merge_id").alias("changes")).withColumnRenamed("kept_id", "id")
    left = listings.join(merges.select(F.col("removed_id").alias("id")), "id", "left_anti").join(changes, "id", "left")
    types = dict(listings.dtypes)
    for name in MERGEABLE:
        if name in types and not types[name].startswith("array"):
            asked = F.coalesce(F.map_contains_key("changes", F.lit(name)), F.lit(False))
            left = left.withColumn(name, F.when(asked, F.col("changes")[name].try_cast(types[name])).otherwise(F.col(name)))
    return left.select(listings.columns)


def merged_sources(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """Sources that supported a removed listing support the kept one instead, and know both."""
    pairs = merges.select(F.col("removed_id").alias("id"), "kept_id")
    moved = sources.select("source_key", F.explode("event_ids").alias("id")).join(pairs, "id").groupBy("source_key").agg(F.collect_set("id").alias("gone"), F.collect_set("kept_id").alias("new"))
    met = sources.join(moved, "source_key", "left")
    touched = F.col("gone").isNotNull()
    ids = F.array_sort(F.array_union(F.array_except("event_ids", "gone"), "new"))
    known = F.array_sort(F.array_union("known_event_ids", "new"))
    return met.select("source_key", F.when(touched, ids).otherwise(F.col("event_ids")).alias("event_ids"), F.when(touched, known).otherwise(F.col("known_event_ids")).alias("known_event_ids"))


def merged_alerts(sent: DataFrame, merges: DataFrame, listings: DataFrame) -> DataFrame:
    """Alerts to add: that of a removed listing, under the kept one's title and day, unless that has one or the key is taken."""
    title = F.concat(F.lit("free_food:v2:title-day:"), texts.normal_title(F.col("title")), F.lit("|"), F.date_format(times.campus_time(F.col("starts_at")), "yyyyMMdd"))
    named = listings.select(F.col("id").alias("kept_id"), title.alias("notification_key"))
    free = merges.join(sent.select(F.col("event_id").alias("kept_id")), "kept_id", "left_anti")
    moved = free.join(sent.select(F.col("event_id").alias("removed_id"), "notified_at"), "removed_id").join(named, "kept_id")
    first = moved.groupBy("kept_id", "notification_key").agg(F.min("notified_at").alias("notified_at"))
    return first.join(sent.select("notification_key"), "notification_key", "left_anti").select(F.col("kept_id").alias("event_id"), "notification_key", "notified_at")


def merge_records(merges: DataFrame) -> DataFrame:
    """The decisions to store: ids in byte order, and which one was kept."""
    return merges.select(F.least("kept_id", "removed_id").alias("event_id"), F.greatest("kept_id", "removed_id").alias("other_event_id"), F.lit("duplicate").alias("status"), F.col("kept_id").alias("kept_event_id"))


def edited(listings: DataFrame, edits: DataFrame) -> DataFrame:
    """Listings with edits by hand (id, title, location, has_free_food; null: left alone) applied; an edit locks its row."""
    new = edits.select("id", *(F.col(c).alias(f"new_{c}") for c in edits.columns if c != "id"), F.lit(True).alias("touched"))
    met = listings.join(new, "id", "left")
    for c in edits.columns:
        if c != "id":
            met = met.withColumn(c, F.coalesce(F.col(f"new_{c}"), F.col(c)))
    return met.withColumn("is_locked", F.coalesce("touched", F.lit(False)) | F.col("is_locked")).select(listings.columns)


def removed_by_hand(listings: DataFrame, tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tombstones first, then the listings without the removed ones: what fails between leaves no listing that returns."""
    marked = tombstones.unionByName(ids.select(F.col("id").alias("event_id")).distinct().join(tombstones, "event_id", "left_anti"))
    return marked, listings.join(ids.select("id"), "id", "left_anti")


def kind_backfill(listings: DataFrame, to_kind: str | None = None, skip: tuple[str, ...] = ("instagram",)) -> DataFrame:
    """id, content_kind, new_content_kind of unlocked rows that the rules now call something else.

    Rows of sources whose kind came from more than title and description are skipped.
    """
    new = classify.content_kind(F.col("source"), F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.lit(None).cast("string"))
    found = listings.filter(~F.col("is_locked") & ~F.col("source").isin(*skip)).select("id", "content_kind", new.alias("new_content_kind")).filter("new_content_kind <> content_kind")
    return found.filter(F.col("new_content_kind") == to_kind) if to_kind else found


def claimed_activations(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The stored activation of every entry: the first claim of a handle stays, whatever is claimed later."""
    first = entries.groupBy("handle").agg(F.min_by("activated_at", "seq").alias("claimed"))
    return first.join(stored.select("handle", "activated_at"), "handle", "left").select("handle", F.coalesce("activated_at", "claimed").alias("activated_at"))


def routed_items(items: DataFrame, boundary: DataFrame, archive: DataFrame) -> DataFrame:
    """items with their route: bad (no id or time), old (before the account's boundary), seen (archived, or earlier in the run) or new.

    items: handle, media_id, posted_at, pinned, seq.  Old items are counted and never stored; pinned ones
    tell nothing about where a feed ends.
    """
    met = items.join(boundary, "handle", "left").join(archive.select("media_id", F.lit(True).alias("archived")), "media_id", "left")
    bad = F.col("media_id").isNull() | F.col("posted_at").isNull() | F.col("boundary").isNull()
    old = F.col("posted_at") < F.col("boundary")
    repeat = F.row_number().over(Window.partitionBy("media_id", bad | old).orderBy("seq")) > 1
    route = F.when(bad, "bad").when(old, "old").when(F.col("archived") | repeat, "seen").otherwise("new")
    return met.withColumn("route", route).drop("archived", "boundary")


def advanced_checkpoints(state: DataFrame, routed: DataFrame, run: DataFrame, limit: int, scan_start: str) -> DataFrame:
    """state after a run: progress moves to the run's start only for accounts that were read whole.

    That is: the run succeeded, the account was covered, none of its rows was bad and it stayed below
    the limit.  run: handle, covered, succeeded.  The level of a failure is `warn` the first time.
    """
    counts = routed.groupBy("handle").agg(F.count_distinct("media_id").alias("posts"), F.bool_or(F.col("route") == "bad").alias("bad"))
    met = state.join(run, "handle", "left").join(counts, "handle", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    complete = yes("succeeded") & yes("covered") & ~yes("bad") & (F.coalesce("posts", F.lit(0)) < limit)
    return met.select(
        "handle",
        "activated_at",
        F.when(complete, F.lit(scan_start).cast("timestamp_ntz")).otherwise(F.col("scanned_through")).alias("scanned_through"),
        F.when(complete, "ok").otherwise("incomplete").alias("last_status"),
        F.when(complete, "ok").when(F.coalesce("last_status", F.lit("ok")) == "incomplete", "error").otherwise("warn").alias("level"),
    )


def feed_stop(pages: DataFrame) -> DataFrame:
    """handle, page: the first page at which the walk through an ordered feed ends, the second all-old page in a row.

    pages: handle, page, all_old.  Accounts without such a page are not in the result.
    """
    order = Window.partitionBy("handle").orderBy("page")
    twice = F.col("all_old") & F.coalesce(F.lag("all_old").over(order), F.lit(False))
    return pages.withColumn("stop", twice).filter("stop").groupBy("handle").agg(F.min("page").alias("page"))


def image_work(posts: DataFrame, saved: DataFrame) -> DataFrame:
    """media_id, image, reuse: an image's saved reading is used again while its own content is the same.

    posts: media_id, caption, images (array of struct<image, digest>).  saved: image, digest, status.  A
    changed caption asks for no new reading; one that failed is read again.
    """
    each = posts.select("media_id", F.explode("images").alias("i")).select("media_id", "i.image", "i.digest")
    done = saved.filter("status = 'ok'").select("image", "digest").distinct().withColumn("reuse", F.lit(True))
    return each.join(done, ["image", "digest"], "left").select("media_id", "image", F.coalesce("reuse", F.lit(False)).alias("reuse"))


def charge_limited(exported: Column, price: Column, charged: Column, most: Column, share: float = 1.0) -> Column:
    """Why a run's export may be cut by its budget: what was charged reached the share, or would with one more item; null if neither."""
    room = most * F.lit(share)
    return F.when(charged >= room, "charged to the limit").when(exported * price + price > room, "no room for another item")


def rate_limit(attempts: DataFrame, minutes: int = 10, most: int = 5) -> DataFrame:
    """attempts (key, at, id) with `ok` and `retry_after`: a window opens with the first attempt after the last one closed.

    Windows follow from one another, so the attempts of a key pass in order of time as a sorted stream
    that remembers one window, however many there are.
    """
    kind = attempts.schema["key"].dataType
    sorted_rows = attempts.select("key", F.unix_timestamp(F.col("at").cast("timestamp")).alias("second"), "at", F.col("id").cast("long").alias("id"))
    sorted_rows = sorted_rows.repartition("key").sortWithinPartitions("key", "at", "id").select("key", "second", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reset, n = object(), 0, 0
        for batch in batches:
            ok, wait = [], []
            for key, second in zip(batch.column("key").to_pylist(), batch.column("second").to_pylist(), strict=True):
                if key != now or reset <= second:
                    now, reset, n = key, second + minutes * 60, 0
                n = min(n + 1, most + 1)
                ok.append(n <= most)
                wait.append(0 if n <= most else max(1, reset - second))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(ok, pa.bool_()), pa.array(wait, pa.int64())], ["key", "id", "ok", "retry_after"])

    return sorted_rows.mapInArrow(run, f"key {kind.simpleString()}, id long, ok boolean, retry_after long")
