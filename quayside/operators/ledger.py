"""Incremental state: watermarks, streaks, budgets, quotas, notifications, confirmations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, times


def boundaries(checkpoints: DataFrame, overlap_seconds: int = 300) -> DataFrame:
    """handle, boundary: the later of the activation and the progress less an overlap."""
    back = F.col("scanned_through") - F.expr(f"INTERVAL '{overlap_seconds}' SECOND")
    return checkpoints.select("handle", F.greatest("activated_at", back).alias("boundary"))


def new_posts(posts: DataFrame, boundary: DataFrame, known: DataFrame) -> DataFrame:
    """Posts at or after their account's boundary that no run has seen, each id once, the earliest first."""
    fresh = posts.join(boundary, "handle").filter("posted_at >= boundary").join(known.select("media_id"), "media_id", "left_anti")
    first = Window.partitionBy("media_id").orderBy("posted_at", "handle")
    return fresh.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "boundary")


def merged_checkpoints(local: DataFrame, durable: DataFrame) -> DataFrame:
    """The durable activation wins; of progress the earlier."""
    l, d = local.alias("l"), durable.alias("d")
    return l.join(d, F.col("l.handle") == F.col("d.handle"), "full").select(
        F.coalesce("d.handle", "l.handle").alias("handle"),
        F.coalesce("d.activated_at", "l.activated_at").alias("activated_at"),
        F.least("l.scanned_through", "d.scanned_through").alias("scanned_through"),
    )


def failure_streaks(attempts: DataFrame, stop: int = 3) -> DataFrame:
    """handle, longest run of failures, whether it stops the collector; neutral attempts neither reset nor add.

    attempts: handle, at, id, outcome (ok, failed, neutral).  Runs are islands between successes.
    """
    order = Window.partitionBy("handle").orderBy("at", "id")
    islands = attempts.filter("outcome <> 'neutral'").withColumn("island", F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(order))
    runs = islands.groupBy("handle", "island").agg(F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0)).alias("run"))
    return runs.groupBy("handle").agg(F.max("run").alias("longest")).withColumn("stops", F.col("longest") >= stop)


def status_changes(attempts: DataFrame) -> DataFrame:
    """The first failure in a row warns, the next ones are errors."""
    order = Window.partitionBy("handle").orderBy("at", "id")
    last = F.lag("outcome").over(order)
    return attempts.withColumn("level", F.when(F.col("outcome") != "failed", "ok").when(last == "failed", "error").otherwise("warn"))


def split_budget(parts: DataFrame, cents: int) -> DataFrame:
    """name, share: whole cents by weight; what rounding leaves goes one each to the first names."""
    whole = parts.agg(F.sum("weight").alias("total"))
    floor = parts.crossJoin(F.broadcast(whole)).withColumn("base", F.floor(F.lit(cents) * F.col("weight") / F.col("total")).cast("long"))  # one row
    left = floor.agg((F.lit(cents) - F.sum("base")).alias("left"))
    ranked = floor.withColumn("n", F.row_number().over(Window.orderBy("name")))  # one row per part of the budget
    return ranked.crossJoin(F.broadcast(left)).select("name", (F.col("base") + F.when(F.col("n") <= F.col("left"), 1).otherwise(0)).alias("share"))


def job_batches(checkpoints: DataFrame, size: int = 100) -> DataFrame:
    """hour, batch, first, n: accounts by the hour of their boundary, in chunks."""
    hour = F.date_trunc("hour", "boundary").cast("timestamp_ntz")
    ranked = checkpoints.withColumn("hour", hour).withColumn("n", F.row_number().over(Window.partitionBy("hour").orderBy("boundary", "handle")))
    return ranked.groupBy("hour", F.floor((F.col("n") - 1) / size).alias("batch")).agg(F.min("handle").alias("first"), F.count("*").alias("n"))


def quota_slots(requests: DataFrame, per_slot: int, slots: int) -> DataFrame:
    """id, month, slot: requests fill the slots of their campus month in turn; slot -1 is refused."""
    month = times.month_bucket(F.col("ts"))
    n = F.row_number().over(Window.partitionBy("month").orderBy("ts", "id"))
    slot = F.floor((n - 1) / per_slot).cast("int")
    return requests.withColumn("month", month).withColumn("slot", F.when(slot < slots, slot).otherwise(-1))


def notification_key() -> F.Column:
    """Title and day, else the link, else the id."""
    title = texts.normal_title(F.col("title"))
    return F.coalesce(
        F.when((title != "") & F.col("starts_at").isNotNull(), F.concat(F.lit("title-day:"), title, F.lit("|"), times.day_key(F.col("starts_at")))),
        F.concat(F.lit("url:"), F.col("rsvp_url")),
        F.concat(F.lit("id:"), F.col("id")),
    )


def to_notify(listings: DataFrame, sent: DataFrame, now: str) -> DataFrame:
    """notification_key, id: listings with free food still to come, one per key that wasn't sent."""
    due = listings.filter(F.col("has_free_food") & (F.coalesce("ends_at", "starts_at") > F.lit(now).cast("timestamp_ntz")))
    keyed = due.withColumn("notification_key", notification_key()).join(sent.select("notification_key"), "notification_key", "left_anti")
    return keyed.groupBy("notification_key").agg(F.min("id").alias("id"))


def inherited_alerts(sent: DataFrame, moves: DataFrame) -> DataFrame:
    """id, notified_at: alerts follow merged listings; the earliest of a survivor counts."""
    moved = sent.join(moves.select(F.col("old").alias("id"), "new"), "id", "left").select(F.coalesce("new", "id").alias("id"), "notified_at")
    return moved.groupBy("id").agg(F.min("notified_at").alias("notified_at"))


def withdrawals(checks: DataFrame, hours: int = 6) -> DataFrame:
    """id: missing in two checks at least `hours` hours apart; a first look that misses over half of four or more is an outage."""
    first = checks.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter("n = 1")
    runs = first.groupBy("run").agg(F.count("*").alias("looked"), F.sum(F.col("missing").cast("int")).alias("lost"))
    outage = runs.filter("looked >= 4 AND lost * 2 > looked").select("run")
    seen = checks.join(outage, "run", "left_anti").filter("missing")
    span = seen.groupBy("id").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    return span.filter((F.col("n") >= 2) & (F.col("b") >= F.col("a") + F.expr(f"INTERVAL '{hours}' HOUR"))).select("id")


def cache_misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose content hash has no reusable decision: none, or one that failed and may be tried again."""
    usable = cache.filter("status <> 'failed'").select("hash").distinct()
    return rows.join(usable, "hash", "left_anti")
