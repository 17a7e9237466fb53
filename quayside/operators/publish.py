"""State transitions as pure functions: publication, merging, retiring, file references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def no_ids() -> Column:
    return F.array().cast("array<string>")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows and the stored ones that it doesn't replace."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def insert_absent(stored: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return stored.unionByName(new.join(stored.select(key) if isinstance(key, str) else stored.select(*key), key, "left_anti"))


def sync_queue(pending: DataFrame, wanted: DataFrame, decided: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to insert and rows to delete, so that what is pending is what is wanted and not decided."""
    return wanted.join(pending, key, "left_anti").join(decided, key, "left_anti"), pending.join(wanted, key, "left_anti")


def changed(columns: list[str]) -> Column:
    """Whether n_ columns differ from o_ columns, nulls compared as values."""
    side = lambda p: F.struct(*(F.col(p + c) for c in columns))
    return ~side("n_").eqNullSafe(side("o_"))


def publish(listings: DataFrame, sources: DataFrame, deleted: DataFrame, updates: DataFrame) -> DataFrame:
    """source_key, event_ids, known_event_ids, retired per update.

    sources: source_key, event_ids, known_event_ids.  updates: source_key (once in a batch), status
    (complete or error), row_ids, known_event_ids.  A failed source only gains support.  A complete
    one supports its rows but for deleted and locked ones; an id it never had isn't taken up while
    an old one that it no longer proposes is deleted or locked.
    """
    stored = sources.select("source_key", F.col("event_ids").alias("s_ids"), F.col("known_event_ids").alias("s_known"))
    base = updates.join(stored, "source_key", "left").withColumns({"s_ids": F.coalesce("s_ids", no_ids()), "s_known": F.coalesce("s_known", no_ids())})
    base = base.withColumn("aliases", F.when(F.col("status") == "error", F.array_distinct("known_event_ids")).otherwise(F.array_union(F.array_union("known_event_ids", "s_known"), "s_ids")))
    blocked = deleted.select(F.col("event_id").alias("id")).unionByName(listings.filter("is_locked").select("id")).distinct()
    # which of the ids that an update names are blocked: exploded and joined by id, then gathered per source
    named = base.select("source_key", F.explode(F.array_union("row_ids", "aliases")).alias("id")).join(blocked, "id", "left_semi")
    held = named.groupBy("source_key").agg(F.collect_set("id").alias("held"))
    base = base.join(held, "source_key", "left").withColumn("held", F.coalesce("held", no_ids()))
    proposed = F.array_distinct("row_ids")
    gone_and_held = F.size(F.array_intersect(F.array_except("aliases", proposed), F.col("held"))) > 0
    supported = F.filter(F.array_except(proposed, F.col("held")), lambda i: F.array_contains(F.col("aliases"), i) | ~gone_and_held)
    error = F.col("status") == "error"
    return base.select(
        "source_key",
        F.when(error, F.array_union("s_ids", "aliases")).otherwise(supported).alias("event_ids"),
        F.when(error, F.array_union("s_known", "aliases")).otherwise(F.array_union("aliases", supported)).alias("known_event_ids"),
        F.when(error, no_ids()).otherwise(F.array_except("aliases", supported)).alias("retired"),
    )


def retired_listings(listings: DataFrame, sources: DataFrame, published: DataFrame) -> DataFrame:
    """Ids to delete: retired, imported and unlocked, and supported by no source any more."""
    now = upsert(sources.select("source_key", "event_ids"), published.select("source_key", "event_ids"), "source_key")
    support = now.select(F.explode("event_ids").alias("id")).distinct()
    old = published.select(F.explode("retired").alias("id")).distinct()
    rows = listings.filter(~F.col("is_locked") & F.col("id").startswith("ig_") & (F.col("source") == "instagram"))
    return rows.join(old, "id", "left_semi").join(support, "id", "left_anti").select("id")


def support_counts(sources: DataFrame) -> DataFrame:
    """id, how many sources support it."""
    return sources.select("source_key", F.explode("event_ids").alias("id")).groupBy("id").agg(F.countDistinct("source_key").alias("sources"))


def remap_sources(sources: DataFrame, moves: DataFrame) -> DataFrame:
    """sources with ids moved (old, new), each id once."""
    each = sources.select("source_key", F.posexplode("event_ids").alias("pos", "old")).join(moves, "old", "left")
    return each.select("source_key", F.coalesce("new", "old").alias("id")).groupBy("source_key").agg(F.array_sort(F.collect_set("id")).alias("event_ids"))


def retire_batch(listings: DataFrame, now: str, days: int = 30, most: int = 50) -> DataFrame:
    """The oldest listings that ended over `days` days ago, unlocked and not entered by hand."""
    ended = F.greatest("starts_at", "ends_at")
    past = ended < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY")
    return listings.filter(past & ~F.col("is_locked") & (F.col("source") != "manual")).select("id", ended.alias("ended_at")).orderBy("ended_at", "id").limit(most)


def file_references(*named: DataFrame) -> DataFrame:
    """The distinct paths that tables name in their column `path`."""
    out = named[0].select("path")
    for df in named[1:]:
        out = out.unionByName(df.select("path"))
    return out.filter("path IS NOT NULL").distinct()


def unused_files(files: DataFrame, references: DataFrame, most: int | None = 500) -> DataFrame:
    """Stored files that nothing names: a hash anti join on the path, up to a clamped number."""
    limit = max(0, min(1000, 500 if most is None else most))
    return files.join(references, "path", "left_anti").orderBy("path").limit(limit)


def missing_files(files: DataFrame, references: DataFrame) -> DataFrame:
    return references.join(files.select("path"), "path", "left_anti")
