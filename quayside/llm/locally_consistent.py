"""Fingerprints of texts by locally consistent parsing.

A text is a sequence of names, its code points at first.  A level of the parse replaces runs of one
name by one name each, labels every name by deterministic coin tossing against its left neighbour
until six labels are left, and starts a phrase at each local maximum of the labels.  A phrase's name
is a hash of the names in it; phrases are the names of the next level.  Where a phrase starts depends
on five names to the left and one to the right, so equal passages have equal phrases but for a few at
their ends, wherever they stand.  A phrase has two names at least, so a text of n characters has one
name, its root, after log2 n levels.

The fingerprint holds the root and, of the three lowest levels, a sketch of the multiset of phrase
names: the least hash of a name and the number of its occurrence in each of BINS bins.  Likeness is the share of equal bins at the highest level that
both texts fill well, an estimate of how many phrases they have in common.

All levels are array operations over many texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts_of, written

LEVELS, BINS, FILLED = 3, 64, 24
#: Characters parsed at once (a longer text is alone), and of a partition.
CHARACTERS, PARTITION_CHARACTERS = 1 << 20, 64 << 20
ROUNDS = 4  # 64-bit names to 128, 14, 8 and 6 labels
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _without_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs, and names in which a run of a name has one of its own."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]) | first)
    lengths = np.diff(starts, append=len(names)).astype(np.uint64)
    return starts, np.where(lengths > 1, _mixed(names[starts] + _C * lengths), names[starts])


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, different beside each other within a text."""
    labels = names
    for _ in range(ROUNDS):
        one = labels.dtype.type(1)
        differ = labels[1:] ^ labels[:-1]
        place = np.zeros(len(labels), labels.dtype)
        place[1:] = np.bitwise_count((differ & -differ) - one)
        place[first] = 0  # as if the left neighbour differed in the lowest bit
        place = np.minimum(place, labels.dtype.type(8 * labels.dtype.itemsize - 1))  # equal neighbours: a collision of hashes
        labels = (2 * place + ((labels >> place) & one)).astype(np.uint8)
    return labels


def parse_level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of the phrases.  first marks where a text begins; a text has one name at least."""
    runs, names = _without_runs(names, first)
    first = first[runs]
    labels = _labels(names, first)
    top = np.zeros(len(names), bool)
    top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    top[np.flatnonzero(first)[1:] - 1] = False  # the last of a text has no right neighbour
    starts = np.flatnonzero(top | first)
    place = np.arange(len(names)) - np.repeat(starts, np.diff(starts, append=len(names)))
    lengths = np.diff(starts, append=len(names)).astype(np.uint64)
    return runs[starts], _mixed(np.add.reduceat(_mixed(names + _C * (place.astype(np.uint64) + np.uint64(1))), starts) + lengths)


def phrases(text: str) -> list[tuple[list[int], list[int]]]:
    """For every level of a text, where its phrases start (code points) and their names; the last level has one phrase."""
    names = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    out, places = [], np.arange(len(names))
    while len(names) and (not out or len(names) > 1):
        first = np.zeros(len(names), bool)
        first[0] = True
        starts, names = parse_level(names, first)
        places = places[starts]
        out.append((places.tolist(), names.tolist()))
    return out


def _sketched(names: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The least hash in each bin of each text's names, 1 to 255; 0 where a bin is empty.  A name counts as often as it occurs."""
    own = names + _C * text.astype(np.uint64)
    order = np.argsort(own)
    begins = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
    occurrence = np.empty(len(names), np.uint64)
    occurrence[order] = np.arange(len(names)) - np.repeat(begins, np.diff(begins, append=len(names)))
    hashed = _mixed((names ^ _C) + _A * occurrence)
    least = np.full(texts * BINS, 0xFFFF, np.uint16)
    np.minimum.at(least, text * BINS + (hashed & np.uint64(BINS - 1)).astype(np.int64), ((hashed >> np.uint64(40)) & np.uint64(0x7FFF)).astype(np.uint16))
    return np.where(least == 0xFFFF, 0, 1 + _mixed(least.astype(np.uint64)) % np.uint64(255)).astype(np.uint8).reshape(texts, BINS)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of 8 + LEVELS * BINS bytes per text: its root, then the sketches.  An empty text has zeros."""
    out = np.zeros((len(texts), 8 + LEVELS * BINS), np.uint8)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHARACTERS):
            size += len(texts[end])
            end += 1
        _parse_into(out[at:end], texts[at:end])
        at = end
    return out


def _parse_into(out: np.ndarray, texts: list[str]) -> None:
    lengths = np.array([len(t) for t in texts])
    owner = np.flatnonzero(lengths)  # of each text that has names left
    if not len(owner):
        return
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    names, lengths = _mixed(names), lengths[owner]
    level = 0
    while len(owner):
        first = np.zeros(len(names), bool)
        begins = np.cumsum(lengths) - lengths
        first[begins] = True
        starts, names = parse_level(names, first)
        lengths = np.diff(np.searchsorted(starts, begins), append=len(starts))
        text = np.repeat(np.arange(len(owner)), lengths)
        if level < LEVELS:
            out[owner, 8 + level * BINS : 8 + (level + 1) * BINS] = _sketched(names, text, len(owner))
        done = lengths == 1
        roots = names[(np.cumsum(lengths) - lengths)[done]]
        out[owner[done], :8] = np.maximum(roots, np.uint64(1)).astype(">u8").view(np.uint8).reshape(-1, 8)  # zero is the empty text's
        names, owner, lengths, level = names[~done[text]], owner[~done], lengths[~done], level + 1


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each two rows of `fingerprints`: 1 for equal ones, 0 for an empty text and another."""
    x, y = (rows[:, 8:].reshape(len(rows), LEVELS, BINS) for rows in (a, b))
    some, equal = ((x > 0) | (y > 0)).sum(axis=2), ((x == y) & (x > 0)).sum(axis=2)
    share = equal / np.maximum(some, 1)
    filled = np.minimum((x > 0).sum(axis=2), (y > 0).sum(axis=2)) >= FILLED
    level = np.where(filled.any(axis=1), LEVELS - 1 - np.argmax(filled[:, ::-1], axis=1), 0)
    return np.where((a == b).all(axis=1), 1.0, share[np.arange(len(a)), level])


def likeness_of(a: str, b: str) -> float:
    """`likeness` of two fingerprints in the form of their column."""
    rows = [np.frombuffer(bytes.fromhex(f), np.uint8)[None] for f in (a, b)]
    return float(likeness(*rows)[0])


def fingerprint_texts(docs: DataFrame, column: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column, 400 hexadecimal digits; a null text counts as empty.  An existing column of the name is replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([f.tobytes().hex() for f in fingerprints(texts.fillna("").tolist())])

    return docs.withColumn(name, of(F.col(column)))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the beginning of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, is_next: a partition sorted so that each row's next one follows it, the last one's as a further row.

    Buckets are ranges of (doc_id, hash of the text), cut where a range partitioning of these two numbers
    was.  The first row of a bucket is the next one of the last of the bucket before, of which it gets one copy.
    """
    low = -(1 << 63)  # null ids come first
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(low)), "hash": F.xxhash64("text")})
    keys = written(rows.select("id", "hash", F.length("text").alias("size")), "parse-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_CHARACTERS)
    ranged = keys.select("id", "hash").repartitionByRange(parts, "id", "hash")
    found = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "hash")).alias("m")).collect()  # a row per part
    firsts = np.array(sorted((r.m.id, r.m.hash) for r in found), np.int64).reshape(-1, 2)
    buckets = max(1, len(firsts))

    @F.pandas_udf("bucket int, is_first boolean")
    def bucket_of(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        i, h = ids.to_numpy(), hashes.to_numpy()
        left, right = np.searchsorted(firsts[:, 0], i, "left"), np.searchsorted(firsts[:, 0], i, "right")
        own = right - 1
        for k in np.flatnonzero(right > left):  # the id of a bucket's first: the hash decides
            own[k] = left[k] + np.searchsorted(firsts[left[k] : right[k], 1], h[k], "right") - 1
        return pd.DataFrame({"bucket": own.astype(np.int32), "is_first": (firsts[own, 0] == i) & (firsts[own, 1] == h)})

    dealt = rows.withColumn("b", bucket_of("id", "hash")).select("*", "b.*")
    before = F.pmod(F.col("bucket") - 1, F.lit(buckets)).alias("bucket")
    nexts = dealt.filter("is_first").groupBy(before).agg(F.min("text").alias("text"))  # equal rows are one, before they move
    both = dealt.select("doc_id", "id", "hash", "text", "bucket", F.lit(False).alias("is_next")).unionByName(nexts.withColumn("is_next", F.lit(True)), allowMissingColumns=True)
    return both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("is_next", "id", "hash", "text").select("doc_id", "text", "is_next")


SHAPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text (`edited`), and its likeness to that and to the next document.

    The next document is that of the next doc_id; the first follows the last, so a single one follows
    itself.  Null ids come first; repeated ids are ordered by a hash of their texts, so equal rows are
    beside each other.  A null text counts as empty, whose fingerprint is zeros.  An empty table gives no
    rows.  Other columns are not looked at.  A task holds a batch of texts, and 80 bytes for each
    character of those parsed at once (`CHARACTERS`, or the longest text).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next one is still to come, and its fingerprint
        for batch in batches:
            texts = texts_of(batch)
            ids, is_next = batch.column("doc_id").to_pylist(), batch.column("is_next").to_pylist()
            rows = held + list(zip(ids, texts, is_next, fingerprints(texts), strict=True))
            held = rows[-1:]
            here, there = [r for r in rows[:-1] if not r[2]], [b for a, b in zip(rows, rows[1:], strict=False) if not a[2]]
            if not here:
                continue
            changed = [edited(a[1], b[1]) for a, b in zip(here, there, strict=True)]
            own, others, of_changed = np.array([r[3] for r in here]), np.array([r[3] for r in there]), fingerprints(changed)
            columns = [
                pa.array([r[0] for r in here], pa.int64()),
                pa.array([len(r[1]) for r in here], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([f.tobytes().hex() for f in own]),
                pa.array([f.tobytes().hex() for f in of_changed]),
                pa.array(likeness(own, of_changed)),
                pa.array(likeness(own, others)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHAPE.split(", ")])

    return _in_order(docs).mapInArrow(run, SHAPE)
