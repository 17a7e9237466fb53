"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous steps.

Pieces are range-sorted by length, longest first, on Spark; the place in that order is a piece's
rank.  Open gaps are kept sorted by size.  In a step all pieces of the next length sweep for their
successor, the smallest gap that holds them; where several want the same gaps, rank decides; the
gaps shrink, and the length sweeps again until it is placed, opening sequences when no gap fits.
Pieces of one length and sequences with one gap are alike, so the sweep runs over runs of equal
sizes: at most `capacity` lengths and as many gaps, however many documents there are.  What comes
out is a table from intervals of ranks to sequences, and every piece looks itself up in it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, texts_of, written
from .tokens import token_counter

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids and a final 0, cut where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in slices(batches, 1000):
            out: list[tuple[int, int, int, int, int]] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), counter.ids(texts_of(batch)), strict=True):
                ids += b"\0\0\0\0"
                for k in range(0, len(ids) // 4, capacity):
                    cut = ids[4 * k : 4 * (k + capacity)]
                    out.append((doc_id, k // capacity, k, len(cut) // 4, zlib.crc32(cut)))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Intervals of ranks (first rank, first sequence, offset) and the number of sequences.

    counts: pieces of each length; rank 0 is the first of the longest.
    """
    sizes: list[int] = []  # gaps that are open, sorted
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to intervals of sequences (first, how many)
    placed: list[tuple[int, int, int]] = []
    sequences = rank = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap <= 0 or many <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            each = gap // length  # the next of this length fits best where this one went
            full = min(many, left // each)
            for k in range(each if full else 0):
                placed.append((rank, first, capacity - gap + k * length))
                rank += full
            leave(gap - each * length, first, full)
            left -= full * each
            if full < many:
                first, many = first + full, many - full
                if left:  # fewer than one sequence's fill: the last of this length
                    for k in range(left):
                        placed.append((rank, first, capacity - gap + k * length))
                        rank += 1
                    leave(gap - left * length, first, 1)
                    first, many, left = first + 1, many - 1, 0
                leave(gap, first, many)
    return np.array(placed, np.int64).reshape(-1, 3), sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and have one piece, the id 0; repeated rows are packed each; null
    ids stay; an empty table gives no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer, capacity), "pieces")
    ordered = pieces.repartitionByRange(F.col("length").desc(), "doc_id", "piece", "ids_crc32").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    part = F.spark_partition_id()
    ordered = ordered.select("*", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("place"))
    ordered = written(ordered, "ordered-pieces")
    # sorted by length, a part holds few lengths: one row per part and one more per length
    found = ordered.groupBy("part", "length").agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    rows_of: dict[int, int] = {}
    for row in found:
        counts[row.length] = counts.get(row.length, 0) + row["n"]
        rows_of[row.part] = rows_of.get(row.part, 0) + row["n"]
    before, total = {}, 0
    for p in sorted(rows_of):
        before[p] = total
        total += rows_of[p]
    plan, _ = best_fit(counts, capacity)
    shared = spark.sparkContext.broadcast((plan, before))  # its size follows from the capacity and the number of parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = np.asarray(batch.column("place")) + np.array([before[p] for p in batch.column("part").to_pylist()], np.int64)
            at = np.searchsorted(plan[:, 0], rank, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(plan[at, 1] + rank - plan[at, 0]), pa.array(plan[at, 2])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ordered.mapInArrow(run, PIECES + ", sequence_id long, offset long")
