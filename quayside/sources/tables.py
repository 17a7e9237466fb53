"""Readers: Parquet tables, JSON archives with quarantine, and adapters to one post schema."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times, urls

POST = "media_id string, handle string, posted_at string, caption string, media array<struct<index:int,is_video:boolean,image_url:string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files make fewer: heavy work on a small table is shared, a large one isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_FOLDERS: list[str] = []
#: With it, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without it gets one of its own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FOLDERS:
        _FOLDERS.append("file://" + tempfile.mkdtemp(prefix="quayside-"))
    return _FOLDERS[0]


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what follows is planned by itself, with columns pruned.

    Nothing reads the shuffle files of its query again, so they go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def once_each(rows: DataFrame, columns: list[str], *layers: dict[str, Column]) -> DataFrame:
    """The distinct values of these columns with layers of values that depend on them alone: computed once, dealt to all cores."""
    each = spread(cut(rows.select(*columns).distinct()))
    for layer in layers:
        each = each.withColumns(layer)
    return cut(each)


def join_same(rows: DataFrame, each: DataFrame, columns: list[str]) -> DataFrame:
    """rows with what `each` has for the same values of columns; nulls are the same."""
    taken = each.select(*(F.col(c).alias(f"of {c}") if c in columns else F.col(c) for c in each.columns))
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of {c}")) for c in columns))
    return rows.join(taken, same).drop(*(f"of {c}" for c in columns))


def read_archive(spark: SparkSession, path: str, handles: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts of a JSON archive, and the files' rows that can't be used.

    No handles: all posts; an empty list: none.  A broken file or a post without media_id goes to the second table.
    """
    rows = spark.read.schema(POST + ", broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("multiLine", True).json(path)
    good = F.col("broken").isNull() & F.col("media_id").isNotNull()
    posts = rows.filter(good).drop("broken")
    if handles is not None:
        posts = posts.filter(F.col("handle").isin(handles)) if handles else posts.limit(0)
    return posts, rows.filter(~good)


def gap_fill(local: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """local and what only the mirror has; local rows are never replaced."""
    return local.unionByName(mirror.join(local.select(key), key, "left_anti"))


def official_posts(rows: DataFrame) -> DataFrame:
    """Rows of the official collector as posts, with the reasons against each row in `errors`."""
    posted = times.strict_instant(F.col("timestamp"))
    errors = problems(
        ("no id", F.col("id").isNull()),
        ("no owner", F.col("ownerUsername").isNull()),
        ("bad timestamp", posted.isNull()),
        ("no image", F.col("displayUrl").isNull()),
    )
    return rows.select(F.col("id").alias("media_id"), F.lower("ownerUsername").alias("handle"), posted.alias("posted_at"), "caption", urls.media_key(F.col("displayUrl")).alias("media_key"), errors.alias("errors"))


def problems(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that fail; null counts as failing none."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks)), lambda p: p.isNotNull())


def split_quarantine(rows: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.size(errors) == 0).drop(errors), rows.filter(F.size(errors) > 0)


def listing_errors() -> Column:
    """Constraints of the listings table."""
    return problems(
        ("no title", F.trim("title") == ""),
        ("ends before start", F.col("ends_at") < F.col("starts_at")),
        ("bad link", ~F.col("rsvp_url").rlike("(?i)^https?://[^ ]+$")),
        ("bad kind", ~F.col("content_kind").isin("student_event", "student_deadline", "student_application", "fundraiser", "other")),
    )
