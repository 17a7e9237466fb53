"""SimHash near-duplicate detection by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into groups of correlated bits.  If the groups' thresholds t_i
satisfy sum(t_i + 1) = radius + 1, two fingerprints within the radius differ by at most t_i bits
in some group i.  Groups differ in how many candidates they let through, so the thresholds are
allotted unequally, by dynamic programming over estimated candidate counts.  Each fingerprint is
indexed once per group and probes all values within t_i of its own; fingerprints that meet are
verified by their exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_roots
from .shared import HOT_KEYS, free_name, join_counted, remove_written, slices, texts_of, written, written_so_far

BITS = 64
SEED = 42
#: Estimated cost of a probe that is shuffled and sorted, in units of one comparison of fingerprints.
PROBE_COST = 200.0
#: A run of fingerprints with one key is compared pairwise up to this length, and by flooding beyond.
PAIRWISE = 64
#: Of a long run, so many fingerprints are compared with the rest at once.
STEP = 128
#: Shingles are ordered by their counts in so many texts at least; so many of the commonest have counts.
SAMPLED, COMMON = 20_000, 100_000
#: Of a long run of sets, so many are compared with all; two blocks of so many are compared at once.
PIVOTS, BLOCK = 4, 512
#: A run of more sets than this is never brought into one task.
HOT_RUN = 200_000
#: Numbers of bit groups that are tried; fingerprints whose pairs candidates are estimated from, at most.
PARTS, SAMPLE = (2, 3, 4, 5), 2048
#: Fingerprints of one key that one task compares, at most; longer runs are cut into blocks.
LONGEST = 200_000


# --- fingerprints ----------------------------------------------------------------------------


def shingle_hashes(text: str, words: int, chunk: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, some at a time.

    A-Z are lower-cased; words are parted by space and 0x09-0x0D.  A text with fewer words than a
    shingle gives one shingle, a text with none gives none.
    """
    parts = text.encode().lower().split()
    if not parts:
        return
    whole = b" ".join(parts)
    if len(parts) < words:
        yield np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
        return
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), chunk):
        yield np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at : at + chunk], ends[at : at + chunk], strict=True)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes: a bit is 1 if set in over half of them; zero for none.  As a signed long."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n).view(">i8")[0]) if n else 0


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text's shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp (long) per row."""
    rows = docs.select(*keep, "text")
    schema = rows.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t, words) for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fps], [*keep, "fp"])

    return rows.mapInArrow(run, schema)


# --- the plan of probes ----------------------------------------------------------------------


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each two bits are both set (64 x 64), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in slices(batches, 4096):
            fps = np.asarray(batch.column(0)).astype(">i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int64()), pa.array(cells)], ["cell", "n"])

    sums = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    cells = np.zeros(BITS * BITS + 1)
    for row in sums:
        cells[row.cell] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def bit_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into groups, correlated ones together: those left elsewhere then part more pairs."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, -1)
    free, groups = list(range(BITS)), []
    for part in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - part)
        pairs = near[np.ix_(free, free)]
        group = [free[int(np.argmax(pairs.max(axis=1)))]]
        free.remove(group[0])
        while len(group) < size:
            best = free[int(np.argmax(near[np.ix_(free, group)].mean(axis=1)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within_chance(differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that 0, 1, .. most or fewer bits differ, of bits that differ with these chances."""
    exactly = np.zeros(len(differ) + 1)
    exactly[0] = 1
    for d in differ:
        exactly[1:] = exactly[1:] * (1 - d) + exactly[:-1] * d
        exactly[0] *= 1 - d
    return np.cumsum(exactly)[: most + 1]


def within_groups(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """For each group, the share of the pairs of fps that differ in 0, 1, 2, .. or fewer of its bits."""
    if len(fps) < 2:
        return [np.zeros(len(g) + 1) for g in groups]
    counts = [np.zeros(len(g) + 1, np.int64) for g in groups]
    for at in range(0, len(fps) - 1, 256):
        apart = fps[at : at + 256, None] ^ fps[None, at + 1 :]
        later = np.arange(at + 1, len(fps))[None, :] > np.arange(at, min(at + 256, len(fps)))[:, None]
        for k, group in enumerate(groups):
            counts[k] += np.bincount(np.bitwise_count(apart & np.uint64(_mask(group) % (1 << BITS)))[later], minlength=len(group) + 1)
    return [np.cumsum(c) / c.sum() for c in counts]


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], radius: int, measured: list[np.ndarray] | None = None) -> tuple[list[int], float]:
    """The cheapest t_i >= -1 with sum(t_i + 1) = radius + 1, and their estimated cost.

    Shares of pairs are `measured` on a sample; below its resolution bits count as independent.  Of
    equally cheap allotments the one with fewer probes is taken.
    """
    p = np.diag(both) / max(n, 1)
    best: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
    for k, group in enumerate(groups):
        chance = within_chance(2 * p[group] * (1 - p[group]), min(radius, len(group)))
        if measured is not None:
            chance = np.maximum(chance, measured[k][: len(chance)])
        probes, cost = 0, {-1: (0.0, 0)}
        for t in range(len(chance)):
            probes += math.comb(len(group), t)
            cost[t] = (probes * n * PROBE_COST + chance[t] * n * n / 2, probes)
        step: dict[int, tuple[float, int, list[int]]] = {}
        for used, (paid, made, chosen) in best.items():
            for t, (c, m) in cost.items():
                total = (paid + c, made + m, [*chosen, t])
                if used + t + 1 <= radius + 1 and (used + t + 1 not in step or total < step[used + t + 1]):
                    step[used + t + 1] = total
        best = step
    return best[radius + 1][2], best[radius + 1][0]


def _mask(bits) -> int:
    """These bits, counted from the highest, as a signed long."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def probe_masks(groups: list[list[int]], allotted: list[int]) -> list[tuple[int, int, int]]:
    """(group, mask of its bits, bits to flip) for every probe, as signed longs; no flip: the index."""
    return [
        (i, _mask(group), _mask(flipped))
        for i, (group, t) in enumerate(zip(groups, allotted, strict=True))
        for k in range(t + 1)
        for flipped in combinations(group, k)
    ]


def plan_probes(nodes: DataFrame, radius: int, parts: tuple[int, ...] = PARTS) -> list[tuple[int, int, int]]:
    """The probes for all fingerprints of nodes, for the cheapest number of groups of those given.

    None where there are no two fingerprints.  Candidates are estimated from the pairs of at most
    SAMPLE fingerprints, chosen by a hash; any plan finds the same pairs, a good one fast.
    """
    n, both = bit_statistics(nodes)
    if n < 2:
        return []
    picked = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in picked], np.int64).view(np.uint64)
    found = []
    for count in parts:
        groups = bit_groups(n, both, count)
        allotted, cost = thresholds(n, both, groups, radius, within_groups(sample, groups))
        masks = sum(math.comb(len(g), k) for g, t in zip(groups, allotted, strict=True) for k in range(t + 1))
        found.append((cost, masks, count, groups, allotted))
    _, _, _, groups, allotted = min(found)
    return probe_masks(groups, allotted)


# --- links -----------------------------------------------------------------------------------


def run_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what lies within the radius inside each run of equal keys.

    Short runs: every pair within the radius.  Long runs: by flooding, from a fingerprint to all
    not yet reached within the radius of it and on from those, which gives one link per reached
    fingerprint and no pairs, however many are alike.
    """
    bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(bounds, len(keys)))
    run_of = np.repeat(np.arange(len(sizes)), sizes)
    # places whose run has a member `shift` further on; they get fewer with every shift
    at = np.flatnonzero((sizes <= PAIRWISE)[run_of] & (sizes > 1)[run_of])
    last = (bounds + sizes - 1)[run_of[at]]
    a, b = [], []
    for shift in range(1, PAIRWISE):
        inside = at + shift <= last
        at, last = at[inside], last[inside]
        if not len(at):
            break
        x, y = fps[at], fps[at + shift]
        linked = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        a.append(x[linked])
        b.append(y[linked])
    for k in np.flatnonzero(sizes > PAIRWISE):
        left = np.unique(fps[bounds[k] : bounds[k] + sizes[k]])
        while len(left) > 1:
            near = np.bitwise_count(left[:STEP, None] ^ left) <= radius
            linked = np.flatnonzero(near.sum(axis=1) > 1)
            if not len(linked):
                left = left[STEP:]  # none of these has a link
                continue
            front, left = [left[linked[0]]], left[linked[0] + 1 :]
            while front and len(left):
                x = front.pop()
                reached = np.bitwise_count(left ^ x) <= radius
                a.append(np.full(int(reached.sum()), x))
                b.append(left[reached])
                front += list(left[reached])
                left = left[~reached]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _probed(nodes: DataFrame, probes: list[tuple[int, int, int]]) -> DataFrame:
    """part, key, fp: every fingerprint under its own keys and those it probes; made in the tasks."""
    table = np.array(probes, np.int64).reshape(-1, 3)
    shared = nodes.sparkSession.sparkContext.broadcast((table[:, 0].astype(np.int32), table[:, 1], table[:, 2]))  # a row per probe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mask, flip = shared.value
        for batch in slices(batches, max(1, 200_000 // max(len(part), 1))):
            fps = np.asarray(batch.column(0))
            for at in range(0, len(part), 200_000):
                here = slice(at, at + 200_000)
                keys = (fps[:, None] & mask[here]) ^ flip[here]
                parts = np.broadcast_to(part[here], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(parts.ravel()), pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], ["part", "key", "fp"])

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long")


def _linked(dealt: DataFrame, names: list[str], radius: int, most: int | None) -> DataFrame:
    """a, b and the key columns: links inside runs of equal keys of dealt, which is sorted by them.

    A run of more than `most` fingerprints is not looked at but named: a and b are null.
    """
    keys = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(n, pa.int64()) for n in ("a", "b", *names)]

        def emit(table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            apart = np.zeros(max(len(table[0]) - 1, 0), bool)
            for c in table[:keys]:
                apart |= c[1:] != c[:-1]
            a, b = run_links(np.cumsum(np.append(0, apart)), table[keys].view(np.uint64), radius)
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), *[none] * keys], schema=pa.schema(kinds))

        def named(key: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (None, None, *map(int, key))], schema=pa.schema(kinds))

        held: list[list[np.ndarray]] = []
        n, over = 0, None  # over: the key of a run that is too long, of which no row is held
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(i)).astype(np.int64) for i in range(keys + 1)]
            if over is not None:
                same = np.logical_and.reduce([now[k] == over[k] for k in range(keys)])
                now = [c[int(same.sum()) :] for c in now]
                if not len(now[0]):
                    continue
                yield named(over)
                over = None
            held.append(now)
            last = tuple(c[-1] for c in now[:keys])
            same = np.logical_and.reduce([now[k] == last[k] for k in range(keys)])
            n += len(same)
            if same.all() and (most is None or n <= most):
                continue  # a run that may go on
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = n - int(np.logical_and.reduce([whole[k] == last[k] for k in range(keys)]).sum())
            yield from emit([c[:cut] for c in whole])
            held, n = [[c[cut:] for c in whole]], n - cut
            if most is not None and n > most:
                held, n, over = [], 0, last
        if over is not None:
            yield named(over)
        elif held:
            yield from emit([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(run, "a long, b long, " + ", ".join(f"{n} long" for n in names))


def fingerprint_links(nodes: DataFrame, radius: int, parts: tuple[int, ...] = PARTS, most: int = LONGEST) -> DataFrame:
    """a, b: links between the distinct fingerprints of nodes (fp) whose components are those of
    all pairs within the radius.

    Fingerprints of one key meet in one task, up to `most`; those of a longer run are dealt into
    blocks, and every two blocks meet in a task of their own.
    """
    probes = plan_probes(nodes, radius, parts)
    if not probes:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    keyed = _probed(nodes, probes)
    dealt = keyed.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    found = written(_linked(dealt, ["part", "key"], radius, most), "fingerprint-links")
    links = found.filter("a IS NOT NULL").select("a", "b")
    long = found.filter("a IS NULL").select(F.col("part").cast("int").alias("part"), "key")
    if not long.limit(1).count():
        return links
    rows = written(keyed.join(long, ["part", "key"], "left_semi").distinct(), "fingerprint-long-runs")
    sizes = rows.groupBy("part", "key").agg(F.ceil(F.count("*") / (most // 2 or 1)).alias("blocks"))
    blocks = rows.join(F.broadcast(sizes), ["part", "key"])  # runs of over `most` fingerprints: few
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = blocks.select(F.col("part").cast("long").alias("part"), "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    names = ["part", "key", "i", "j"]
    more = _linked(pairs.repartition(*names).sortWithinPartitions(*names, "fp"), names, radius, None)
    return links.unionByName(more.select("a", "b"))


# --- near copies -----------------------------------------------------------------------------


def distinct_shingles(text: str, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def _least_common(n: int, similarity: float) -> int:
    """So many of its n shingles a set has in common, at least, with any set of that similarity."""
    return math.ceil(similarity * n - 1e-9)


def _common_shingles(whole: DataFrame, row: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the commonest shingles of a sample of texts.

    They only order shingles from rare to common: any order finds the same pairs, a good one fast.
    """
    every = max(1, whole.count() // SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            sets = [distinct_shingles(t, words) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["hash"])

    sample = whole.filter(F.pmod(F.xxhash64(row), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "hash").limit(COMMON).collect()
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in top], np.int64)[order]


def _prefixes(whole: DataFrame, row: str, words: int, similarity: float) -> DataFrame:
    """row, number of shingles, digest and SimHash of the set, and its rarest shingles: two sets of the similarity share one of these."""
    common = whole.sparkSession.sparkContext.broadcast(_common_shingles(whole, row, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = common.value
        for batch in slices(batches, 100):
            sizes, digests, prints, rarest = [], [], [], []
            for text in texts_of(batch):
                own = distinct_shingles(text, words)
                sizes.append(len(own))
                prints.append(majority([own]))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                often = np.zeros(len(own), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    often = np.where(hashes[at] == own, counts[at], 0)
                # own is sorted, so equal counts stay in the order of hashes
                rarest.append(own[np.argsort(often, kind="stable")][: len(own) - _least_common(len(own), similarity) + 1].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rarest)]), pa.int32()), pa.array(np.concatenate(rarest)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), lists], [row, "n", "digest", "fp", "rarest"])

    return whole.select(row, "text").mapInArrow(run, f"{row} long, n int, digest binary, fp long, rarest array<long>")


def _least_shared(n: np.ndarray, x, y, similarity: float) -> np.ndarray:
    """So many shingles sets of these sizes have in common at least, if they have the similarity."""
    return np.ceil(similarity / (1 + similarity) * (n[x] + n[y]) - 1e-9).astype(np.int64)


def _may_be_alike(n: np.ndarray, at: np.ndarray, x, y, similarity: float) -> np.ndarray:
    """Whether sets can have the similarity, given their sizes and the places of a shingle that both have.

    In common are at most all before it and all from it on; so a pair of the similarity fits at every shared shingle.
    """
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    most = np.minimum(at[x], at[y]) + np.minimum(n[x] - at[x], n[y] - at[y])
    return (small >= similarity * large - 1e-9) & (most >= _least_shared(n, x, y, similarity))


def run_candidates(keys: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float, pairwise: int, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Candidate pairs (places) inside runs of equal keys, the places in long runs, and how many of the pairs are of short runs.

    Short runs give every pair that may be alike.  Of a long run only the pairs with its first
    members are given; what these leave unconnected is for links_inside.
    """
    bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(bounds, len(keys)))
    run_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.flatnonzero((sizes <= pairwise)[run_of] & (sizes > 1)[run_of])
    last = (bounds + sizes - 1)[run_of[place]]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shift in range(1, pairwise):
        inside = place + shift <= last
        place, last = place[inside], last[inside]
        if not len(place):
            break
        fits = _may_be_alike(n, at, place, place + shift, similarity)
        a.append(place[fits])
        b.append(place[fits] + shift)
    short = sum(map(len, a))
    long = [np.zeros(0, np.int64)]
    for k in np.flatnonzero(sizes > pairwise):
        members = np.arange(bounds[k], bounds[k] + sizes[k])
        long.append(members)
        for pivot in members[:pivots]:
            others = members[members > pivot]
            fits = _may_be_alike(n, at, pivot, others, similarity)
            a.append(np.full(int(fits.sum()), pivot))
            b.append(others[fits])
    return np.concatenate(a), np.concatenate(b), np.concatenate(long), short


def links_inside(rows: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different roots that connect all pairs of the similarity; none that is not needed."""
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    of, ids = of[shared[ids]], (np.cumsum(shared) - 1)[ids[shared[ids]]]
    order = np.argsort(ids, kind="stable")
    of, ids = of[order], ids[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        first, last = np.searchsorted(ids, [low, low + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[of[first:last], ids[first:last] - low] = 1
        common += has @ has.T
    both = common.astype(np.float64)
    alike = (both >= similarity * (sizes[:, None] + sizes - both)) & (roots[:, None] != roots)
    parent = {r: r for r in roots.tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        p, q = find(int(roots[x])), find(int(roots[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(rows[x]), int(rows[y])))
    return out


def _whole_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The rows of a partition sorted by its first columns, regrouped so that rows equal in these stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for c in range(columns):
            values = np.asarray(batch.column(c))
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut or (held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in range(columns))):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _candidates(prints: DataFrame, row: str, similarity: float) -> DataFrame:
    """a, b: candidate pairs of rows; and with b null the members a of long runs, with the run's hash.

    Of a pair seen in short runs `shared` counts the shingles seen and `needed` says how many of their
    rarest two sets of the similarity share at least.  A pair of a long run is a candidate at once.
    """
    # all of a set but its rarest shingles
    rest = lambda n: np.ceil(similarity * n - 1e-9).astype(np.int64) - 1
    names, pairwise, pivots = ["a", "b", "hash", "shared", "needed"], PAIRWISE, PIVOTS
    keyed = prints.select(F.posexplode("rarest").alias("at", "hash"), row, "n").select("hash", row, "n", "at")
    total = prints.agg(F.coalesce(F.sum(F.size("rarest").cast("long")), F.lit(0)).alias("n")).first().n
    least = max(HOT_RUN, -(-total // HOT_KEYS))
    # a long run fills its bucket, so only the hashes of buckets that full are counted one by one
    bucket = F.pmod("hash", F.lit(1 << 16)).alias("bucket")
    full = keyed.groupBy(bucket).agg(F.count("*").alias("size")).filter(F.col("size") > least).select("bucket")
    inside = keyed.select("hash", bucket).join(F.broadcast(full), "bucket")
    hot = written(inside.groupBy("hash").agg(F.count("*").alias("size")).filter(F.col("size") > least).select("hash"), "near-hot-runs")  # HOT_KEYS rows at most
    kept = keyed.join(F.broadcast(hot), "hash", "left_anti")
    dealt = kept.repartition("hash").sortWithinPartitions("hash", row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, 1):
            keys, rows, n, at = (table.column(c).to_numpy() for c in range(4))
            n, at = n.astype(np.int64), at.astype(np.int64)
            a, b, long, short = run_candidates(keys, n, at, similarity, pairwise, pivots)
            if len(a):
                needed = _least_shared(n, a, b, similarity) - rest(np.maximum(n[a], n[b]))
                needed[short:] = 0
                ends = np.stack([np.minimum(rows[a], rows[b]), np.maximum(rows[a], rows[b]), needed])
                ends, shared = np.unique(ends, axis=1, return_counts=True)
                for k in range(0, len(shared), 50_000):
                    x, y, z = ends[:, k : k + 50_000]
                    now = shared[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64()), pa.array(now.astype(np.int32)), pa.array(z.astype(np.int32))], names)
            for k in range(0, len(long), 50_000):
                now = long[k : k + 50_000]
                none = pa.nulls(len(now), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(rows[now]), pa.nulls(len(now), pa.int64()), pa.array(keys[now]), none, none], names)

    found = dealt.mapInArrow(run, "a long, b long, hash long, shared int, needed int")
    return found.unionByName(_candidates_of_hot_runs(keyed.join(F.broadcast(hot), "hash"), row, similarity)) if hot.limit(1).count() else found


def _candidates_of_hot_runs(members: DataFrame, row: str, similarity: float) -> DataFrame:
    """As `_candidates` gives them for long runs, for runs that no task holds whole.

    A few members of each run go to all tasks, and every member meets them where it is.
    """
    first = members.groupBy("hash", F.pmod(F.xxhash64(row), F.lit(max(1, PIVOTS))).alias("k")).agg(F.min(F.struct(F.col(row).alias("row"), "n", "at")).alias("pivot"))
    met = members.join(F.broadcast(first.select("hash", "pivot")), "hash").filter(F.col(row) != F.col("pivot.row"))  # PIVOTS rows for each of HOT_KEYS runs at most
    n, m, at, of = F.col("n").cast("long"), F.col("pivot.n").cast("long"), F.col("at").cast("long"), F.col("pivot.at").cast("long")
    common = F.least(at, of) + F.least(n - at, m - of)
    alike = (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (common >= F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))
    none = lambda kind: F.lit(None).cast(kind)
    pairs = met.filter(alike).select(F.least(row, "pivot.row").alias("a"), F.greatest(row, "pivot.row").alias("b"), none("long").alias("hash"), F.lit(1).alias("shared"), F.lit(0).alias("needed"))
    return pairs.unionByName(members.select(F.col(row).alias("a"), none("long").alias("b"), "hash", none("int").alias("shared"), none("int").alias("needed")))


def _alike(whole: DataFrame, pairs: DataFrame, row: str, words: int, similarity: float) -> DataFrame:
    """The pairs of rows (a, b) whose shingle sets have the similarity."""
    wanted = written(pairs.select(F.col("a").alias(row)).unionByName(pairs.select(F.col("b").alias(row))).distinct(), "near-rows")
    sets = written(_shingle_sets(whole, wanted, row, words), "near-shingles")
    side = lambda c: sets.select(F.col(row).alias(c), F.col("hashes").alias(f"of_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("n"), F.size("of_a").alias("na"), F.size("of_b").alias("nb"))
    return both.filter(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _links_of_long_runs(whole: DataFrame, members: DataFrame, roots: DataFrame, row: str, words: int, similarity: float) -> DataFrame:
    """a, b: links that connect every pair of the similarity inside a long run and not yet in one component.

    A run is cut into blocks, and each two blocks are compared in a task of their own.
    """
    named = members.join(roots.withColumnRenamed("node", row), row, "left").select("hash", row, F.coalesce("root", row).alias("root"))
    runs = named.groupBy("hash").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).filter("least <> most")
    left = written(join_counted(named, runs.select("hash", "size", F.col("size").alias("many")), "hash"), "near-left")
    sets = written(_shingle_sets(whole, left.select(row).distinct(), row, words), "near-left-shingles")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(row), F.col("blocks")).cast("int")
    dealt = left.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), row, "root")
    dealt = dealt.join(sets, row).select("hash", "i", "j", row, "root", "hashes").repartition("hash", "i", "j").sortWithinPartitions("hash", "i", "j", row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(slices(batches, 1000), 3):
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in range(3)])
            bounds = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            rows, of = (table.column(c).to_numpy() for c in (3, 4))
            out = []
            for first, last in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
                own = [np.asarray(s.values) for s in table.column(5).slice(first, last - first)]
                out += links_inside(rows[first:last], of[first:last], own, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _simhash_pairs(sets: DataFrame, row: str, radius: int) -> DataFrame:
    """a, b: rows whose SimHashes are equal or linked, each fingerprint standing for its first row."""
    firsts = written(sets.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("many")), "near-fingerprints")
    linked = fingerprint_links(firsts.select("fp"), radius)
    side = lambda c, n: firsts.select(F.col("fp").alias(c), F.col("first").alias(n))
    across = linked.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    inside = join_counted(sets.select(row, "fp"), firsts, "fp").filter(F.col(row) != F.col("first")).select(F.col("first").alias("a"), F.col(row).alias("b"))
    return across.unionByName(inside).distinct()


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 5) -> DataFrame:
    """The rows of docs but one of each group of near copies, with all their columns.

    Near copies have at least `similarity` of all their distinct shingles in common (Jaccard); none
    is missed.  Equal sets are joined first.  Then SimHashes of the sets link at `radius` or fewer
    bits, found by the generalised pigeonhole and verified by the exact similarity.  Fingerprints
    of that similarity may lie much further apart, so what they leave unconnected is completed by
    an exact prefix filter: of n shingles the n - ceil(similarity * n) + 1 rarest index a set; two
    sets of that similarity share one of them, and how many at least follows from their sizes.
    Where over PAIRWISE sets share a shingle, they are first compared with a few of them, and those
    that this leaves unconnected with one another, in blocks.  Of a group the row with the smallest
    doc_id stays (null ids last, then the first row).  Null texts count as empty and are copies of
    one another; further columns are kept, whatever their names; an empty table gives no rows.
    Its tables go as soon as no later step reads them; the result reads the texts and the groups only.
    """
    spark, before = docs.sparkSession, written_so_far()
    row = free_name(docs, "quayside_row")
    whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-input")
    prints = written(_prefixes(whole, row, words, similarity), "near-prefixes")
    firsts = written(prints.groupBy("digest").agg(F.min(row).alias("first"), F.count("*").alias("many")), "near-sets")
    equal = join_counted(prints.select(row, "digest"), firsts, "digest").filter(F.col(row) != F.col("first")).select(F.col("first").alias("a"), F.col(row).alias("b"))
    equal = written(equal, "near-equal")
    sets = written(prints.join(equal.select(F.col("b").alias(row)), row, "left_anti"), "near-distinct")
    remove_written(spark, written_so_far() - before, [whole, equal, sets])
    links = written(_alike(whole, written(_simhash_pairs(sets, row, radius), "near-simhash"), row, words, similarity).unionByName(equal), "near-links")
    remove_written(spark, written_so_far() - before, [whole, sets, links])
    roots = written(component_roots(links), "near-roots")
    found = written(_candidates(sets, row, similarity), "near-candidates")
    remove_written(spark, written_so_far() - before, [whole, links, roots, found])
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed")).filter("shared >= needed").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    open_pairs = written(pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "near-pairs")
    links = written(links.unionByName(_alike(whole, open_pairs, row, words, similarity)), "near-more-links")
    remove_written(spark, written_so_far() - before, [whole, links, found])
    roots = written(component_roots(links), "near-more-roots")
    members = found.filter("b IS NULL").select("hash", F.col("a").alias(row))
    if members.limit(1).count():
        more = _links_of_long_runs(whole, members, roots, row, words, similarity)
        roots = written(component_roots(written(links.unionByName(more), "near-all-links")), "near-all-roots")
    remove_written(spark, written_so_far() - before, [whole, roots])
    ids = whole.select(F.col(row).alias("node"), F.col("doc_id").cast("long").alias("doc_id"))
    best = roots.join(ids, "node").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    dropped = roots.join(best, "root").filter("node <> best.node").select(F.col("node").alias(row))
    return whole.join(dropped, row, "left_anti").drop(row)


def _shingle_sets(whole: DataFrame, wanted: DataFrame, row: str, words: int) -> DataFrame:
    """Distinct shingle hashes of the wanted rows.  A table of 2**18 places at most, sent to all tasks,
    leaves most other texts where they are."""
    place = F.pmod(F.xxhash64(row), F.lit(1 << 18))
    places = F.broadcast(wanted.select(place.alias("place")).distinct())
    texts = whole.select(row, "text").withColumn("place", place).join(places, "place", "left_semi").select(row, "text").join(wanted, row, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            sets = [distinct_shingles(t, words).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], [row, "hashes"])

    return texts.mapInArrow(run, f"{row} long, hashes array<long>")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id
    reachable over links.  Null and empty texts have fingerprint zero and link like any other;
    null ids never name a component unless it has no others; repeated rows stay; an empty table
    gives no rows; further columns are not looked at.  Equal fingerprints are joined before the
    search, so copies cost nothing and a bucket holds different fingerprints only; a fingerprint of
    very many rows gets its component without a shuffle.
    """
    rows = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")), "fingerprint-nodes")
    roots = written(component_roots(fingerprint_links(nodes, radius, parts)), "fingerprint-roots")
    linked = roots.join(nodes.select(F.col("fp").alias("node"), "least"), "node")
    named = roots.join(linked.groupBy("root").agg(F.min("least").alias("named")), "root").select(F.col("node").alias("fp"), "named")
    labels = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"), "many"), "fingerprint-labels")
    return join_counted(rows, labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
