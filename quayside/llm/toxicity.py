"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and word beginnings, and of what runs on without white space its parts.  All terms
that tell the classes of the labelled sample apart (chi squared beyond chance) make the vocabulary;
their document frequencies are counted over the whole corpus.  A bounded set of labelled examples
goes into an inverted index whose lists are cut into blocks of examples and know the largest weight
in each.  For every text, blocks are opened in the order of their upper bounds until none left can
hold one of the k nearest, and only the postings of opened blocks are read, so the neighbours are
exact.  Their labels vote, weighted by similarity; the vote is calibrated on left-out examples;
neighbours are returned as evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, texts_of, written

#: Labelled rows that terms are chosen from, at most; a sample by a hash of doc_id.
MAX_LABELLED = 20_000
#: Examples of each class in the index, at most.
MAX_EXAMPLES = 2048
#: A term has to be in so many labelled rows: of fewer, no test can say what they tell.
MIN_ROWS = 5
NEIGHBOURS = 24
BLOCK = 64
#: So many blocks are opened first, and four times as many each time after.
FIRST_BLOCKS = 8
#: Weight of the term that every text has: texts without telling terms are near each other.
COMMON = 1.0
#: What is longer than a word can be is cut into all its parts of this length.
LONGEST, PART = 64, 5
#: Fixed: lengths of the word beginnings that count as terms.
BEGINNINGS = (4, 5, 6, 7)
_EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„‘’…–—¿¡"


def terms_of(chunk: str) -> tuple[str, ...]:
    """The terms of what stands between white space: the bare word, and its beginnings with a *."""
    word = chunk.lower().strip(_EDGE)
    if not word:
        return ()
    if len(word) > LONGEST:  # no word: all its parts of one length
        return tuple("~" + word[k : k + PART] for k in range(len(word) - PART + 1))
    return (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n))


@dataclass
class Vectors:
    """Texts to sparse unit vectors: position of each term, and its weight by rarity."""

    place: dict[str, int]
    idf: np.ndarray

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"place": self.place, "idf": self.idf, "known": {}}

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """How often each vocabulary term occurs, and the number of words."""
        found: dict[int, int] = {}
        chunks = Counter(text.split())
        known, place = self.known, self.place
        if len(known) > 300_000:
            known.clear()
        for chunk, n in chunks.items():
            at = known.get(chunk)
            if at is None:
                at = tuple(place[t] for t in terms_of(chunk) if t in place)
                if len(chunk) <= LONGEST:
                    known[chunk] = at
            for i in at:
                found[i] = found.get(i, 0) + n
        return found, chunks.total()

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions (sorted) and weights; the last position is the common term.  Empty: no words."""
        found, total = self.counts(text)
        if not total:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.array(sorted(found), np.int64)
        weights = np.log1p(np.array([found[i] for i in at.tolist()], float) * (100 / total)) * self.idf[at]
        weights = np.append(weights, COMMON)
        return np.append(at, len(self.idf)), weights / np.sqrt((weights * weights).sum())


class BlockMaxIndex:
    """Examples by block and term, with the largest weight of each term in each block of examples.

    Terms are counted up to `terms`; the last one is that of all texts.  It has no postings: its
    share of a cosine is a constant per example, with a largest one per block.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, terms: int):
        # alike examples share blocks, so that bounds of other blocks are low
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, int(labels[i]), i))
        self.labels, self.ids, self.n, self.terms = labels[order].astype(float), ids[order], len(order), terms
        rows = np.concatenate([np.full(len(vectors[i][0]), k) for k, i in enumerate(order)]).astype(np.int64) if order else np.zeros(0, np.int64)
        at = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        self.blocks = -(-self.n // BLOCK)
        self.common = np.zeros(self.n)
        shared = at == terms - 1
        self.common[rows[shared]] = weight[shared]
        rows, at, weight = rows[~shared], at[~shared], weight[~shared]
        self.most = np.zeros((terms, self.blocks))
        np.maximum.at(self.most, (at, rows // BLOCK), weight)
        np.maximum.at(self.most[-1], np.arange(self.n) // BLOCK, self.common)
        code = at * max(self.blocks, 1) + rows // BLOCK  # a list is a block's part of a term
        by = np.lexsort((rows, code))
        self.rows, self.weights = rows[by], weight[by]
        self.first = np.searchsorted(code[by], np.arange(terms * self.blocks + 1))

    def _scores(self, opened: np.ndarray, at: np.ndarray, weight: np.ndarray, common: float) -> tuple[np.ndarray, np.ndarray]:
        """The examples of these blocks and their cosines, from the blocks' postings alone."""
        lists = (at[:, None] * self.blocks + opened).ravel()
        start = self.first[lists]
        many = self.first[lists + 1] - start
        ends = np.cumsum(many)
        read = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - many), many)
        parts = np.repeat(np.repeat(weight, len(opened)), many) * self.weights[read]
        inside = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        inside = inside[inside < self.n]
        return inside, np.bincount(self.rows[read], parts, self.n)[inside] + common * self.common[inside]

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, nearest first, ties by place; `but` is left out."""
        at, weight = vector
        if not len(at) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weight @ self.most[at]
        common = float(weight[-1]) if at[-1] == self.terms - 1 else 0.0
        own = at < self.terms - 1
        order = np.argsort(-bound, kind="stable")
        done, best, similar = 0, np.zeros(0, np.int64), np.zeros(0)
        step = FIRST_BLOCKS
        while done < self.blocks:
            floor = similar[k - 1] if len(similar) >= k else 0.0
            opened = order[done : done + step]
            opened = opened[bound[opened] > 0] if len(similar) < k else opened[bound[opened] >= floor - 1e-12]
            if not len(opened):
                break
            new, score = self._scores(opened, at[own], weight[own], common)
            some = (score > 0) & (new != but)
            best, similar = np.append(best, new[some]), np.append(similar, score[some])
            top = np.lexsort((best, -np.round(similar, 12)))[:k]
            best, similar = best[top], similar[top]
            done, step = done + step, step * 4
        return best, similar

    def vote(self, near: tuple[np.ndarray, np.ndarray]) -> float:
        """Share of toxic neighbours, weighted by closeness."""
        best, similar = near
        weight = 1 / (1.02 - np.minimum(similar, 1.0))
        return float((weight * self.labels[best]).sum() / weight.sum()) if len(best) else float("nan")


@dataclass
class Model:
    vectors: Vectors
    index: BlockMaxIndex
    slope: float
    offset: float
    prior: float

    def __post_init__(self):
        self.held: dict[bytes, tuple] = {}

    def score(self, text: str) -> tuple[float, list[dict]]:
        """Calibrated score, and the three nearest examples."""
        vector = self.vectors.vector(text)
        key = vector[0].tobytes() + vector[1].tobytes()
        if key in self.held:
            return self.held[key]
        best, similar = near = self.index.nearest(vector, NEIGHBOURS)
        vote = self.index.vote(near)
        score = self.prior if math.isnan(vote) else calibrated(vote, self.slope, self.offset)
        out = score, [{"doc_id": int(self.index.ids[i]), "cosine": float(c), "toxic": int(self.index.labels[i])} for i, c in zip(best[:3], similar[:3], strict=True)]
        if len(vector[0]) <= 2 and len(self.held) < 10_000:  # few terms: many texts share the vector
            self.held[key] = out
        return out


def _logit(vote):
    p = np.clip(vote, 0.005, 0.995)
    return np.log(p / (1 - p))


def calibrated(vote: float, slope: float, offset: float) -> float:
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, slope * float(_logit(vote)) + offset)))))


def fit_calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit on the votes' log odds, by Newton's method."""
    x = np.stack([_logit(votes), np.ones(len(votes))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - 0.01 * (beta - np.array([1.0, 0.0]))
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


# --- on Spark --------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, toxic, text of at most `most` rows that may be learned from, chosen by a hash of doc_id."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows


def choose_terms(rows: DataFrame) -> list[str]:
    """All terms whose chi squared between the classes, by the number of rows that have them, is beyond chance.

    Of m terms that tell nothing, chance alone lifts about one over 2 ln m; terms below that are left
    out.  How many there are is bounded by what MAX_LABELLED rows hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: dict[str, list[int]]) -> pa.RecordBatch:
            terms = list(found)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([found[t][c] for t in terms], pa.int64()) for c in (0, 1))], ["term", "calm", "toxic"])

        found: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                for term in {t for chunk in set(text.split()) for t in terms_of(chunk)}:
                    found.setdefault(term, [0, 0])[1 if label else 0] += 1
            if len(found) > 200_000:
                yield out(found)
                found = {}
        yield out(found)

    totals = {bool(r.toxic): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    calm, toxic = float(totals.get(False, 0)), float(totals.get(True, 0))
    if not calm or not toxic:
        return []
    counts = rows.select("text", "toxic").mapInArrow(run, "term string, calm long, toxic long").groupBy("term").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic"))
    n = calm + toxic
    a, b = F.col("toxic"), F.col("calm")
    gap = a * (calm - b) - b * (toxic - a)
    chi = n * gap * gap / ((a + b) * (n - a - b + 1e-9) * calm * toxic)
    rated = written(counts.filter(a + b >= MIN_ROWS).select("term", chi.alias("chi")), "rated-terms")
    best = rated.filter(F.col("chi") > 2 * math.log(max(rated.count(), 1))).orderBy(F.desc("chi"), "term")
    return [r.term for r in best.select("term").collect()]


def document_frequencies(docs: DataFrame, place: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are: the whole corpus."""
    reader = Vectors(place, np.zeros(len(place)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(place) + 1, np.int64)
        for batch in slices(batches):
            for text in texts_of(batch):
                found, _ = reader.counts(text)
                sums[list(found)] += 1
                sums[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "n"])

    sums = np.zeros(len(place) + 1)
    for row in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row per term
        sums[row["at"]] = row["n"]
    return sums[:-1], int(sums[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None where a class has no labelled rows."""
    rows = written(labelled_rows(docs, labels), "labelled")
    terms = choose_terms(rows)
    sizes = {bool(r.t): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return None
    place = {t: i for i, t in enumerate(terms)}
    seen, n = document_frequencies(docs, place)
    vectors = Vectors(place, np.log((n + 1) / (seen + 1)) + 0.1)
    picked = [rows.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "text", F.lit(k).alias("label")).limit(MAX_EXAMPLES) for k, c in ((1, "toxic > 0"), (0, "toxic <= 0"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [vectors.vector(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([m[0].tolist() for m in made], pa.list_(pa.int64())), pa.array([m[1].tolist() for m in made], pa.list_(pa.float64()))], ["doc_id", "label", "at", "weight"])

    examples = picked[0].unionByName(picked[1]).mapInArrow(run, "doc_id long, label int, at array<long>, weight array<double>").collect()
    examples = sorted((e for e in examples if e["at"]), key=lambda e: e.doc_id)
    index = BlockMaxIndex([(np.array(e["at"]), np.array(e.weight)) for e in examples], np.array([e.label for e in examples], int), np.array([e.doc_id for e in examples]), len(terms) + 1)
    where = {int(d): i for i, d in enumerate(index.ids)}
    votes = np.array([index.vote(index.nearest((np.array(e["at"]), np.array(e.weight)), NEIGHBOURS, but=where[e.doc_id])) for e in examples])
    given = np.array([e.label for e in examples], float)
    prior = sizes[True] / (sizes[True] + sizes[False])
    share = max(given.mean(), 1e-6) if len(given) else prior
    weights = np.where(given > 0, prior / share, (1 - prior) / max(1 - share, 1e-6))
    ok = ~np.isnan(votes)
    slope, offset = fit_calibration(votes[ok], given[ok], weights[ok]) if ok.any() else (1.0, 0.0)
    return Model(vectors, index, slope, offset, prior)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence.

    Only labels of rows that are not held out are learned from; a score depends on the text alone.
    Null and empty texts get the share of toxic rows; null ids are not held out; repeated rows
    give repeated scores; without labels of both classes every score is 0; an empty table gives no
    rows; further columns are not looked at.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and MAX_EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in slices(batches):
            scored = [shared.value.score(t) if shared.value else (0.0, []) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in scored], pa.float64()), pa.array([e for _, e in scored], near)], ["doc_id", "held_out", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
