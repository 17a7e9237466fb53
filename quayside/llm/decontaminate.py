"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item has a fingerprint over its five-word shingles.  A document's windows of as many
words as an item has are fingerprinted from running bit counts; an index over five Hamming blocks
finds all items whose fingerprint lies within the radius of a window's (if five blocks differ by
over three bits each, the whole differs by 20 or more, beyond the radius of 19); the similarity of
the shingles, weighted by how often they occur, is then computed exactly.  Windows without a single
shingle of any item cannot be similar and are not fingerprinted.  A text shorter than an item is one
window and compared exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, slices, texts_of, written

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
#: Hamming blocks (bits of each) and the distance within which a block is looked up.
BLOCKS, NEAR = (13, 13, 13, 13, 12), 3
#: Items and characters of one pass over the documents, which bound what is sent to the tasks.
PASS_ITEMS, PASS_CHARS = 1000, 2_000_000
#: Passes of one stage, whose indexes the tasks hold together.
PASSES = 4
FILTER_BITS = 20
_WORD = re.compile(r"\w+")
HIT = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
_KNOWN: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word; words are runs of letters, digits and _, lower-cased."""
    words = _WORD.findall(text.lower())
    if len(_KNOWN) > 400_000:
        _KNOWN.clear()
    for w in set(words).difference(_KNOWN):
        _KNOWN[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `words` words; of the whole, if it has fewer."""
    if not len(hashes):
        return hashes
    words = min(words, len(hashes))
    out = np.zeros(len(hashes) - words + 1, np.uint64)
    for k in range(words):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of `size` shingles: a bit is set if it is in over half of them."""
    counts = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(_bits(hashes), axis=0, out=counts[1:])
    inside = counts[size:] - counts[:-size]
    return np.packbits(2 * inside > size, axis=1).view(">u8").ravel().astype(np.uint64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser over the sum of the greater counts."""
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class ItemIndex:
    """Items by shingle and by Hamming block; find() gives the items that a text's windows hold."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids, self.counts, self.sizes, self.widths, prints = [], [], [], [], []
        by_shingle: dict[tuple[int, int], list[int]] = {}
        for item_id, text in items:
            words = word_hashes(text)
            if not len(words):
                continue  # nothing to find
            found = shingles(words)
            k = len(self.ids)
            self.ids.append(item_id)
            self.counts.append(Counter(found.tolist()))
            self.sizes.append(len(found))
            self.widths.append(min(WORDS, len(words)))
            prints.append(window_fingerprints(found, len(found))[0])
            for h in self.counts[-1]:
                by_shingle.setdefault((self.widths[-1], h), []).append(k)
        self.prints = np.array(prints, np.uint64)
        self.kinds = np.array([s * 10 + w for s, w in zip(self.sizes, self.widths, strict=True)], np.int64)
        self.by_shingle = by_shingle
        self.filters = {}
        for width in set(self.widths):
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[np.array([h & ((1 << FILTER_BITS) - 1) for w, h in by_shingle if w == width], np.int64)] = True
            self.filters[width] = seen
        self.tables = []
        shift = 64
        for bits in BLOCKS:
            shift -= bits
            value = ((self.prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            near = np.array([sum(1 << b for b in flipped) for k in range(NEAR + 1) for flipped in combinations(range(bits), k)], np.int64)
            keys = (value[:, None] ^ near[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            first = np.searchsorted(keys[order], np.arange((1 << bits) + 1))
            self.tables.append((shift, bits, first, np.repeat(np.arange(len(value)), len(near))[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) whose fingerprints lie within the radius."""
        windows, items = [], []
        for shift, bits, first, listed in self.tables:
            value = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            many = first[value + 1] - first[value]
            at = np.repeat(np.arange(len(prints)), many)
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[value], many)
            near = np.bitwise_count(prints[at] ^ self.prints[listed[place]]) <= RADIUS
            windows.append(at[near])
            items.append(listed[place][near])
        pairs = np.unique(np.concatenate(windows) * len(self.prints) + np.concatenate(items))
        return pairs // len(self.prints), pairs % len(self.prints)

    def find(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, best similarity, first word, last word + 1) of every item held by the text."""
        if not self.ids:
            return []
        words = word_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        for width, seen in self.filters.items():
            if len(words) < width:
                continue
            hashes = shingles(words, width)
            at = np.flatnonzero(seen[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            self._whole_text(hashes, width, at, best)
            hits: dict[int, list[int]] = {}  # size of a window to where shingles of such items are
            for p in at.tolist():
                for size in {self.sizes[k] for k in self.by_shingle.get((width, int(hashes[p])), ())}:
                    if size <= len(hashes):
                        hits.setdefault(size, []).append(p)
            for size, places in hits.items():
                self._windows(hashes, width, size, places, best)
        return sorted((self.ids[k], round(s, 6), a, b) for k, (s, a, b) in best.items())

    def _whole_text(self, hashes: np.ndarray, width: int, at: np.ndarray, best: dict) -> None:
        """A text shorter than an item is one window, compared at once with all such items that share a shingle."""
        own, size = None, len(hashes)
        for k in {k for p in at.tolist() for k in self.by_shingle.get((width, int(hashes[p])), ())}:
            if self.similarity * self.sizes[k] <= size < self.sizes[k]:
                own = own or Counter(hashes.tolist())
                alike = weighted_similarity(self.counts[k], own)
                if alike >= self.similarity:
                    best[k] = (alike, 0, size + width - 1)

    def _windows(self, hashes: np.ndarray, width: int, size: int, places: list[int], best: dict) -> None:
        start = 0
        while start < len(places):
            stop = start
            while stop + 1 < len(places) and places[stop + 1] - places[stop] < size and places[stop] - places[start] < 65536:
                stop += 1
            low, high = max(0, places[start] - size + 1), min(len(hashes), places[stop] + size)
            near = hashes[low:high]
            windows, items = self.candidates(window_fingerprints(near, size))
            fits = self.kinds[items] == size * 10 + width
            for w, k in zip(windows[fits].tolist(), items[fits].tolist(), strict=True):
                alike = weighted_similarity(self.counts[k], Counter(near[w : w + size].tolist()))
                if alike >= self.similarity and alike > best.get(k, (0.0,))[0]:
                    best[k] = (alike, low + w, low + w + size + width - 1)
            start = stop + 1


def benchmark_passes(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items with text, in passes of bounded size; null ids and texts hold nothing to find."""
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-found["n"] // PASS_ITEMS), -(-found["chars"] // PASS_CHARS))
    for k in range(passes):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        yield sorted((r.item_id, r.text) for r in part.collect())


def with_hits(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, column: str = "hits", clean_only: bool = False) -> DataFrame:
    """docs with all its columns and the items each text holds: array of item_id, similarity, start, end (words).

    One pass over the texts per bounded part of the benchmark, PASSES of them in one stage and
    without a shuffle.  A larger benchmark goes on over a written table, and the indexes of the
    stage before are freed, so what tasks hold doesn't grow with it.  With `clean_only` texts with
    hits leave on the way.
    """
    out, sent = docs.withColumn(column, F.array().cast(HIT)), []
    for items in benchmark_passes(benchmark):
        if len(sent) == PASSES:
            out = written(out, "benchmark-hits")
            for old in sent:
                old.destroy()
            sent = []
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, similarity))
        sent.append(index)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 200):
                at = batch.schema.get_field_index(column)
                old = batch.column(at)
                new = [(o or []) + [{"item_id": i, "similarity": s, "start": a, "end": b} for i, s, a, b in index.value.find(t)] for o, t in zip(old.to_pylist(), texts_of(batch), strict=True)]
                columns = [pa.array(new, old.type) if k == at else batch.column(k) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(run, out.schema)
        if clean_only:
            out = out.filter(F.size(column) == 0)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, max_similarity, hits.

    Null and empty texts hold nothing; items with null or wordless texts are found nowhere; an item
    of fewer than five words is one shingle; repeated items are found each; repeated documents give
    repeated rows; an empty table on either side is fine; further columns are not looked at.
    """
    found = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, similarity)
    ids = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    best = F.coalesce(F.array_max(F.col("hits.similarity")), F.lit(0.0))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), ids.alias("item_ids"), best.alias("max_similarity"), "hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names.

    Null and empty texts hold nothing and stay; repeated rows and ties are judged alike; an empty
    benchmark leaves all rows, an empty table gives none.
    """
    column = free_name(docs, "quayside_hits")
    return with_hits(docs, benchmark, similarity, column, clean_only=True).drop(column)
