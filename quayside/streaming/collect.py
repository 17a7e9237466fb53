"""Collection as a stream of micro-batches: the batch functions, called once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def posts_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def stored_posts(spark: SparkSession, store: str, schema: str, but: int | None = None) -> DataFrame:
    """The posts of all stored batches, but one that runs again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema + ", batch long")
    rows = spark.read.schema(schema + ", batch long").parquet(store)
    return rows if but is None else rows.filter(F.col("batch") != but)


def new_snapshots(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Of each media_id that is not known the first snapshot; no id is ever forgotten and none is too late."""
    first = posts.groupBy("media_id").agg(F.min_by(F.struct(*posts.columns), F.struct("posted_at", "handle")).alias("p")).select("p.*")
    return first.join(known.select("media_id"), "media_id", "left_anti").select(posts.columns)


def collect(posts: DataFrame, store: str, checkpoint: str, notify: Callable[[DataFrame, int], None] | None = None) -> None:
    """Append posts that the store doesn't have and hand each batch on.

    The store itself is the index of what is known, so nothing depends on how late a post comes.  A
    batch that runs again replaces its own folder: a failure between the two loses and repeats nothing.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in posts.dtypes)

    def write(batch: DataFrame, number: int) -> None:
        known = stored_posts(batch.sparkSession, store, schema, number)
        new_snapshots(batch, known).write.mode("overwrite").parquet(f"{store}/batch={number}")
        if notify:
            notify(batch.sparkSession.read.schema(schema).parquet(f"{store}/batch={number}"), number)

    posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(store: DataFrame) -> DataFrame:
    """handle, scanned_through, posts: what the stored batches say."""
    return store.groupBy("handle").agg(F.max("posted_at").alias("scanned_through"), F.count("*").alias("posts"))
