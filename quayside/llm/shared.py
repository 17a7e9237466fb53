"""What the operators share: tables in the shared folder, and texts inside Arrow tasks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: list[str] = []
#: Folders of tables, and the threads that wrote them.
_WRITTEN: dict[str, int] = {}
#: A key is hot from HOT_ROWS rows and one in HOT_KEYS of all rows on.
HOT_ROWS, HOT_KEYS = 32, 10_000
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: With it, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is unset a temporary folder of this process serves, in a local session only.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="quayside-"))
    return _OWN_ROOT[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def own_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that goes with the tables that `written` makes."""
    path = new_folder(spark, name)
    _WRITTEN[path] = threading.get_ident()
    return path


def small_batches(spark: SparkSession) -> None:
    """Tasks get whole texts by the thousand, not by the ten thousand: what a batch holds is memory twice, in the JVM and in Python."""
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # very long texts


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a cut in the lineage that survives lost executors.

    Nothing reads the shuffle files of its query again, so they go at once.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = own_folder(spark, name)
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> set[str]:
    """The folders of the tables that `written` made in this thread and nobody has deleted."""
    return {p for p, thread in list(_WRITTEN.items()) if thread == threading.get_ident()}


def remove_written(spark: SparkSession, folders: Iterable[str] | None = None, read_by: Iterable[DataFrame] = ()) -> int:
    """Delete the tables that `written` made in this process, or those in `folders`, once the results that read them are stored.

    Those that DataFrames in `read_by` read stay.
    """
    gone = [p for p in (list(_WRITTEN) if folders is None else folders) if p in _WRITTEN]
    if gone and read_by:
        read = {part for df in read_by for file in df.inputFiles() for part in file.split("/")[:-1]}
        gone = [p for p in gone if p.rsplit("/", 1)[1] not in read]
    for folder in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.pop(folder, None)
    return len(gone)


def free_name(df: DataFrame, name: str) -> str:
    """name, or what comes first of name_1, name_2, .. that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def join_counted(rows: DataFrame, table: DataFrame, on: str | list[str], many: str = "many", total: int | None = None) -> DataFrame:
    """rows joined with table, which has one row per key and says in `many` how many rows have the key.

    A key of a share of 1 / HOT_KEYS of all rows or more is hot: there are HOT_KEYS of them at most,
    so their part of the table is sent to all tasks and their rows stay where they are.
    """
    least = max(HOT_ROWS, -(-(rows.count() if total is None else total) // HOT_KEYS))
    hot = F.broadcast(table.filter(F.col(many) >= least).drop(many))  # HOT_KEYS rows at most
    on = [on] if isinstance(on, str) else on
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col(many) < least).drop(many), on)
    return rows.join(hot, on).unionByName(rest)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few files is dealt to all cores, so that heavy work on it is shared."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most max_rows, so that one piece's Python objects stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, max_rows):
            yield batch.slice(start, max_rows)
