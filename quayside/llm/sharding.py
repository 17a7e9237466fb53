"""Sharding by fixed virtual slots.

Rows hash into thousands of slots that never change.  Bytes and rows are summed per slot, and a
versioned map says which shard each slot belongs to.  Balancing edits that map only: a slot moves
as a whole, so no row is hashed anew.  Everything that touches rows is DataFrame functions; the
driver sees one row per slot, a fixed number.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, written

SLOTS = 4096
ROW_OVERHEAD = 8
#: Repeats of a row that are made from one count.
REPEATS = 4096
#: A map is edited if that brings the shard farthest from the mean nearer by this share of the mean.
TOLERANCE = 0.005


def slot_rows(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot per row.

    The size is the text's UTF-8 bytes (null: none) plus eight.  The slot is a hash of doc_id, size,
    checksum and, of rows equal in all three, the repeat's number: so it follows from the rows alone,
    however they are partitioned and whatever else is in the table.  Copies of a text with different
    ids go to different slots, and so do the texts of one id and very many repeats of one row.

    Equal rows are counted, not numbered one by one: their repeats are made again from the count, a
    few thousand to a row, so a row that is a third of the table is spread over many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n - 1) DIV {REPEATS} AS INT)"))))
    parts = parts.repartition("doc_id", "text_crc32", "part")
    first = F.col("part").cast("long") * REPEATS
    each = parts.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, F.least(F.col("n"), first + REPEATS) - 1)).alias("repeat"))
    return each.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "repeat"), F.lit(slots)).cast("int").alias("vslot"))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt to the shards in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(slot_to_shard: list[int], slot_bytes: list[int], shards: int) -> list[int]:
    """The next version of a map: the same but for the slots that have to move.

    Shards above the mean give up slots, largest first, as long as they stay above it without
    them, and then their smallest ones; the slots given up go, largest first, to the lightest
    shard.  A new shard (shards grown) starts empty and so takes most of them.
    """
    owner = list(slot_to_shard)
    held: list[list[int]] = [[] for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
        load[shard] += slot_bytes[slot]
    mean = sum(slot_bytes) / shards
    moving: list[int] = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-slot_bytes[s], s)):
            if load[shard] - slot_bytes[slot] >= mean and slot_bytes[slot]:
                load[shard] -= slot_bytes[slot]
                moving.append(slot)
        gone = set(moving)
        rest = [s for s in held[shard] if s not in gone and slot_bytes[s]]
        for slot in sorted(rest, key=lambda s: (slot_bytes[s], s)):
            if load[shard] <= mean:
                break
            load[shard] -= slot_bytes[slot]
            moving.append(slot)
    lightest = [(load[shard], shard) for shard in range(shards)]
    heapq.heapify(lightest)
    for slot in sorted(moving, key=lambda s: (-slot_bytes[s], s)):
        weight, shard = heapq.heappop(lightest)
        owner[slot] = shard
        heapq.heappush(lightest, (weight + slot_bytes[slot], shard))
    return owner


def _array(values: list[int]) -> Column:
    """A fixed-length array as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def store_map(spark: SparkSession, path: str, version: int, slot_to_shard: list[int], slot_bytes: list[int]) -> None:
    """Add a version of the map to the table at path: version, vslot, shard, bytes.

    It is written aside and moved to the folder of its version by whoever makes that version's mark
    first; the other of two runs at once fails and has changed nothing.
    """
    pairs = F.arrays_zip(_array(slot_to_shard).alias("shard"), _array(slot_bytes).alias("bytes"))
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    rows = spark.range(1).select(F.posexplode(pairs).alias("vslot", "of")).select("vslot", F.col("of.shard").cast("int").alias("shard"), F.col("of.bytes").alias("bytes"))
    rows.coalesce(1).write.parquet(aside)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        mine = files.createNewFile(at(f"{path}/_version-{version}"))
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        mine = False
    if not mine:
        files.delete(at(aside), True)
        raise ValueError(f"version {version} of the map at {path} was stored by another run")
    files.rename(at(aside), at(f"{path}/version={version}"))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """A version of a stored map, the newest unless one is named, and its number; None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == version).select("vslot", "shard").collect()  # one row per slot
    return (version, [r.shard for r in sorted(rows, key=lambda r: r.vslot)]) if rows else None


def _loads(owner: list[int], slot_bytes: list[int], shards: int) -> list[int]:
    load = [0] * shards
    for slot, shard in enumerate(owner):
        load[shard] += slot_bytes[slot]
    return load


def next_map(owner: list[int], slot_bytes: list[int], shards: int) -> list[int] | None:
    """The edited map; None where an edit isn't worth it: all shards exist, and none gets nearer to the mean by TOLERANCE of it."""
    # slots of shards that are no more are dealt anew
    start = [shard if shard < shards else slot % shards for slot, shard in enumerate(owner)]
    edited = rebalanced(start, slot_bytes, shards)
    before, after = _loads(start, slot_bytes, shards), _loads(edited, slot_bytes, shards)
    mean = sum(slot_bytes) / shards
    worst = lambda load: max(abs(b - mean) for b in load)
    if start == owner and (worst(before) - worst(after) <= TOLERANCE * mean or not mean):
        return None
    return edited


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Deal all rows into shards of nearly equal bytes; `slot` is the row's place in its shard.

    The newest version of the map at map_path is loaded and edited for these rows' bytes and this
    number of shards, and stored as the next version where it changed.  Without a stored map,
    version 0 deals slots in turn and version 1 is balanced.  Null texts count as empty, null ids
    and repeated rows spread over the slots, an empty table gives no rows, and further columns of
    docs are not looked at.
    """
    spark = docs.sparkSession
    rows = written(slot_rows(docs, slots), "slotted-rows")
    totals = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # one row per slot
    slot_bytes, slot_count = [0] * slots, [0] * slots
    for row in totals:
        slot_bytes[row.vslot], slot_count[row.vslot] = row["bytes"], row["n"]
    path = map_path or new_folder(spark, "slot-map")
    stored = load_map(spark, path)
    if stored is None:
        stored = 0, first_map(shards, slots)
        store_map(spark, path, 0, stored[1], slot_bytes)
    version, owner = stored
    if len(owner) != slots:
        raise ValueError(f"the stored map has {len(owner)} slots, not {slots}: the number of slots is fixed")
    edited = next_map(owner, slot_bytes, shards)
    if edited is not None:
        owner = edited
        store_map(spark, path, version + 1, owner, slot_bytes)
    base, filled = [0] * slots, [0] * shards
    for slot in range(slots):
        base[slot] = filled[owner[slot]]
        filled[owner[slot]] += slot_count[slot]
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(within) - 1)
    at = F.col("vslot") + 1
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(_array(owner), at).cast("int").alias("shard"),
        (F.element_at(_array(base), at) + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
