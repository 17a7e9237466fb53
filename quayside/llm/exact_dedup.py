"""Exact deduplication as a stateful stream.

A run lands its documents in a content store, as Parquet.  A Structured Streaming aggregation keyed
by digest keeps, without expiry, for every digest: the row that stays (identifier and content
locator: run, file, row), the first row that ever had it, and the size of the group.  The state
lives in RocksDB on the executors' disks and in the checkpoint folder; a later run over the same
work folder goes on where the last one ended.  Equal digests are only a hit: the full bytes of all
rows behind every hit are compared, those of earlier runs read back by their locators, and digests
that stand for different texts are split for good.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import join_counted, own_folder, written

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small store reserves megabytes of disk
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Where a row's content is: the run that landed it, and file and row in that run's folder.
PLACE = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
KEEP = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("older", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
STATE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep", KEEP), T.StructField("first", PLACE), T.StructField("group_size", T.LongType())])
#: Digests of hits are looked up by this many bits of a hash, so the table sent to all tasks has 2**18 rows at most.
PREFIX_BITS = 18


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """values hold while a stream starts, which copies the session's settings."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_run(spark: SparkSession, folder: str) -> int:
    """The highest number of a run's folder (run=k) below folder; -1 where there is none."""
    at, files = _folder(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(n[4:]) for n in names if n.startswith("run=")), default=-1)


def land(docs: DataFrame, work: str, run: int, digest=sha256_digest) -> T.StructType:
    """Add docs to the content store: a digest, and the whole row in one struct, so that no name can clash.

    A run that failed while landing is landed again over what it left.  Null texts count as empty;
    an empty table leaves a run without rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(digest(text).alias("digest"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    slim.write.mode("overwrite").parquet(f"{work}/landed/run={run}")
    return slim.schema


def _landed(spark: SparkSession, work: str, schema: T.StructType, files: list[str] | None = None) -> DataFrame:
    """The content store's rows with their place; of all runs, or of some files only."""
    rows = spark.read.schema(schema).option("basePath", f"{work}/landed").parquet(*(files or [f"{work}/landed"]))
    run = F.regexp_extract("_metadata.file_path", r"/run=(\d+)/[^/]*$", 1).cast("int")
    place = F.struct(run.alias("run"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select("digest", "doc", place.alias("place"))


def run_stream(spark: SparkSession, work: str, run: int, schema: T.StructType, files_per_batch: int = 4096, partitions: int | None = None) -> None:
    """Drain what was landed into the keyed state; changed states go to changes/run=k/batch=n.

    The number of state partitions is that of the first run (`partitions`, or shuffle partitions).
    """
    whole = T.StructType([*schema.fields, T.StructField("run", T.IntegerType())])
    stream = spark.readStream.schema(whole).option("basePath", f"{work}/landed").option("maxFilesPerTrigger", files_per_batch).parquet(f"{work}/landed")
    doc_id = F.col("doc.doc_id").cast("long")
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    slim = stream.select("digest", doc_id.alias("doc_id"), "run", file.alias("file"), row.alias("row"))
    state = slim.groupBy("digest").agg(
        # of equal ids, what was landed first stays; null ids are the smallest
        F.max(F.struct("doc_id", (-F.col("run")).alias("older"), "file", "row")).alias("keep"),
        F.min(F.struct("run", "file", "row")).alias("first"),
        F.count("*").alias("group_size"),
    )

    def write_changes(changes: DataFrame, batch: int) -> None:
        # a batch that runs again after a failure overwrites its own folder
        changes.write.mode("overwrite").parquet(f"{work}/changes/run={run}/batch={batch}")

    # a run without rows makes no batch; its table of changes exists all the same
    spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{work}/changes/run={run}/batch=-1")
    settings = STATE_SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    with _settings(spark, settings):
        query = state.writeStream.outputMode("update").foreachBatch(write_changes).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def newest_states(spark: SparkSession, work: str, since: int) -> DataFrame:
    """The newest state of every digest that a run from `since` on has seen."""
    rows = spark.read.schema(T.StructType([*STATE.fields, T.StructField("run", T.IntegerType()), T.StructField("batch", T.LongType())])).option("basePath", f"{work}/changes").parquet(f"{work}/changes")
    newest = F.max_by(F.struct("keep", "first", "group_size"), F.struct("run", "batch")).alias("s")
    return rows.filter(F.col("run") >= since).groupBy("digest").agg(newest).select("digest", "s.keep", "s.first", "s.group_size")


def _near_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest hashes like a hit's, and few others; nothing is shuffled."""
    lead = F.pmod(F.xxhash64("digest"), F.lit(1 << PREFIX_BITS))
    prefixes = F.broadcast(hits.select(lead.alias("lead")).distinct())  # 2**18 rows at most
    return rows.withColumn("lead", lead).join(prefixes, "lead", "left_semi").drop("lead")


def collided_digests(new: DataFrame, old: DataFrame | None, hits: DataFrame) -> DataFrame:
    """Digests among hits whose rows, new ones and the first one of an earlier run, don't all have the same bytes.

    Copies meet as one least and one greatest text per task, so a large group is no heavy key.
    """
    texts = _near_hits(new, hits).select("digest", F.coalesce("doc.text", F.lit("")).alias("text"))
    if old is not None:
        texts = texts.unionByName(old)
    spread = texts.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return spread.filter(F.col("least") != F.col("most")).select("digest")


def _first_texts(spark: SparkSession, work: str, schema: T.StructType, hits: DataFrame, since: int) -> DataFrame | None:
    """digest, text of the first row of hits that earlier runs landed, read by locator from their files only."""
    old = hits.filter(F.col("first.run") < since).select("first")
    files = old.select(F.col("first.run").alias("run"), F.col("first.file").alias("file")).distinct().collect()  # files of the store, not documents
    if not files:
        return None
    stored = _landed(spark, work, schema, [f"{work}/landed/run={f.run}/{f.file}" for f in files])
    return stored.join(old.withColumnRenamed("first", "place"), "place", "left_semi").select("digest", F.coalesce("doc.text", F.lit("")).alias("text"))


def _keep_place() -> Column:
    return F.struct((-F.col("keep.older")).alias("run"), F.col("keep.file").alias("file"), F.col("keep.row").alias("row"))


def _decided(docs: DataFrame, digest, files_per_batch: int, work: str | None, partitions: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows that this run landed; the newest states of their digests, collided ones left out; and those, by text."""
    spark = docs.sparkSession
    work = work or own_folder(spark, "exact-dedup")
    since = _last_run(spark, f"{work}/finished") + 1  # what a failed run landed is checked with this one
    run = max(since, _last_run(spark, f"{work}/landed") + 1)
    schema = land(docs, work, run, digest)
    run_stream(spark, work, run, schema, files_per_batch, partitions)
    states = written(newest_states(spark, work, since), "digest-state")
    hits = states.filter("group_size > 1")
    rows = _landed(spark, work, schema)
    new = rows.filter(F.col("place.run") >= since)
    at, files = _folder(spark, f"{work}/collided")
    known = spark.read.schema("digest binary").parquet(f"{work}/collided") if files.exists(at) else None
    bad = collided_digests(new, _first_texts(spark, work, schema, hits, since), hits)
    bad = written(bad if known is None else bad.unionByName(known).distinct(), "collided")
    mine, split = rows.filter(F.col("place.run") == run), None
    if bad.limit(1).count():
        bad.write.mode("overwrite").parquet(f"{work}/collided")
        # the full texts of all runs' rows with such a digest are the groups
        again = written(_near_hits(rows, bad).join(bad, "digest", "left_semi").select("digest", F.coalesce("doc.text", F.lit("")).alias("text"), F.col("doc.doc_id").cast("long").alias("doc_id"), "place"), "collided-rows")
        keep = F.max(F.struct("doc_id", (-F.col("place.run")).alias("older"), F.col("place.file").alias("file"), F.col("place.row").alias("row"))).alias("keep")
        split = written(again.groupBy("digest", "text").agg(keep, F.count("*").alias("group_size")), "collided-groups")
        states = states.join(bad, "digest", "left_anti")
    spark.range(1).select(F.lit(run).alias("finished")).write.mode("overwrite").parquet(f"{work}/finished/run={run}")
    return mine, states, split


def exact_dedup(docs: DataFrame, digest=sha256_digest, files_per_batch: int = 4096, work: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_run, keep_file, keep_row.

    Null texts count as empty and so are copies of one another.  Of equal texts the row with the
    largest doc_id stays (null ids are smallest); of rows that repeat an id and its text, the one
    landed first.  With the `work` folder of earlier runs, groups and sizes go over all of them, and
    a text has one kept row whatever is landed again.  An empty table gives no rows; further
    columns are not looked at and may have any name.  `digest` can be a weaker hash: collisions are
    found by comparing full texts, also with those of earlier runs, and resolved.
    """
    mine, states, split = _decided(docs, digest, files_per_batch, work, partitions)
    slim = mine.select("digest", F.col("doc.doc_id").cast("long").alias("doc_id"), "place", _text_sha(digest, mine).alias("text_sha256"))
    states = states.select("digest", "keep", "group_size", F.col("group_size").alias("many"))
    out = join_counted(slim, states, "digest")
    if split is not None:
        texts = mine.select("digest", F.coalesce("doc.text", F.lit("")).alias("text"), F.col("doc.doc_id").cast("long").alias("doc_id"), "place", F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("text_sha256"))
        parted = join_counted(texts, split.withColumn("many", F.col("group_size")), ["digest", "text"])
        out = out.unionByName(parted.select(out.columns))
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("place") == _keep_place()).alias("kept"),
        "text_sha256",
        (-F.col("keep.older")).alias("keep_run"),
        F.col("keep.file").alias("keep_file"),
        F.col("keep.row").alias("keep_row"),
    )


def _text_sha(digest, rows: DataFrame) -> Column:
    return F.lower(F.hex("digest")) if digest is sha256_digest else F.sha2(F.coalesce(rows["doc.text"], F.lit("")), 256)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Null texts are copies of the empty text; an empty table gives no rows.  Only rows of groups
    with several members can go, so what is looked up is the rows that go.
    """
    mine, states, split = _decided(docs, sha256_digest, 4096, None, None)
    hits = states.filter("group_size > 1").select("digest", "keep", F.col("group_size").alias("many"))
    near = _near_hits(mine.select("digest", "place"), hits)
    gone = join_counted(near, hits, "digest").filter(F.col("place") != _keep_place()).select("place")
    if split is not None:
        texts = mine.select("digest", F.coalesce("doc.text", F.lit("")).alias("text"), "place")
        gone = gone.unionByName(texts.join(split.select("digest", "text", "keep"), ["digest", "text"]).filter(F.col("place") != _keep_place()).select("place"))
    return mine.join(written(gone, "copies"), "place", "left_anti").select("doc.*")
