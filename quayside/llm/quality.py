"""Quality classification by co-training over two views of a document.

One classifier reads the text's content (hashed words and word pairs, shapes of words and lines,
repetition, symbols), the other what is known about the page (source, language, length); no feature
is in both.  Both start from a bounded sample of labelled rows.  In every round each view scores all
documents, and the ones it is sure of are handed over as pseudo-labels to train the other view.  At
the end both views are calibrated on labelled rows that took no part in training, combined by a
logistic layer fitted on further ones, and applied to all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, texts_of, written

#: Labelled rows that are learned from, at most; a sample by a hash of doc_id.
MAX_LABELLED = 20_000
ROUNDS = 3
#: Pseudo-labels of each class that a view hands over per round, at most: a sample of distinct sure
#: rows by a hash, from all documents; and how sure it has to be.
HANDED, SURE = 400, 0.95
#: Of ten parts of the labelled rows, so many train; two calibrate the views, the rest fit the layer.
TRAINING = 6
#: Hashed places for words, and as many for pairs of words.
WORD_PLACES = 64
#: Hashed places for the values of source and language.
META_PLACES = 64

TEXT_FEATURES = (
    "bias mean_word long_words upper_words upper_letters digits symbols pipes bangs other_letters distinct_words "
    "top_word top_three adjacent_repeats distinct_lines top_line short_lines mean_line end_marks commas symbol_ends stop_like entropy longest_run"
).split()
_SYMBOL_END = re.compile(r"[#$%&*+=^~|]{2,}")
_KNOWN: dict[str, int] = {}


def word_features(words: list[str]) -> np.ndarray:
    """Signed counts of words and of pairs of neighbours in hashed places, scaled to length one each."""
    if len(_KNOWN) > 400_000:
        _KNOWN.clear()
    for w in set(words).difference(_KNOWN):
        _KNOWN[w] = xxhash.xxh64_intdigest(w.casefold())
    hashes = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    pairs = (hashes[1:] ^ (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(2 * WORD_PLACES)
    for k, found in enumerate((hashes, pairs)):
        counts = np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=2 * WORD_PLACES)
        signed = counts[0::2] - counts[1::2]
        out[k * WORD_PLACES : (k + 1) * WORD_PLACES] = signed / max(float(np.sqrt((signed * signed).sum())), 1.0)
    return out


def text_features(text: str) -> list[float]:
    """Shares, shapes and hashed words; all finite, whatever the text, and none grows with its length."""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [1.0] + [0.0] * (len(TEXT_FEATURES) - 1 + 2 * WORD_PLACES)
    counts = Counter(words)
    top = counts.most_common(3)
    letters = sum(map(str.isalpha, text)) if len(text) < 4096 else _letters(text)
    upper_words = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    lines = [s for line in text.split("\n") if (s := line.strip())]
    line_counts = Counter(lines)
    raw = np.frombuffer(text.encode(), np.uint8)
    byte = np.bincount(raw, minlength=256)
    ascii_letters = byte[65:91].sum() + byte[97:123].sum()
    share = byte[byte > 0] / len(raw)
    symbols = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    plain = int(byte[33] + byte[39] + byte[44] + byte[46] + byte[63] + byte[45])
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = len(_SYMBOL_END.findall(text))
    run, longest = 1, 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return [
        1.0,
        min(len(text) / n, 40) / 10,
        sum(k for w, k in counts.items() if len(w) > 20) / n,
        upper_words / n,
        byte[65:91].sum() / max(ascii_letters, 1),
        byte[48:58].sum() / chars,
        (symbols - plain) / chars * 10,
        byte[124] / n,
        byte[33] / n,
        max(letters - int(ascii_letters), 0) / chars,
        len(counts) / n,
        top[0][1] / n,
        sum(k for _, k in top) / n,
        repeats / n,
        len(line_counts) / max(len(lines), 1),
        max(line_counts.values(), default=0) / max(len(lines), 1),
        sum(len(s) < 20 for s in lines) / max(len(lines), 1),
        min(len(text) / max(len(lines), 1), 2000) / 500,
        (byte[46] + byte[63]) / n,
        byte[44] / n,
        ends / n,
        sum(k for w, k in counts.items() if len(w) <= 3) / n,
        float(-(share * np.log2(share)).sum()) / 5,
        math.log1p(longest),
        *word_features(words).tolist(),
    ]


def _letters(text: str) -> int:
    return sum(k for c, k in Counter(text).items() if c.isalpha())


def meta_features(source: str | None, lang: str | None, length: int) -> list[float]:
    """Hashed source and language, and the length's magnitude; never what the text says."""
    from zlib import crc32

    out = [0.0] * (META_PLACES + 12)
    out[crc32(f"s:{source}".encode()) % META_PLACES] += 1.0
    out[crc32(f"l:{lang}".encode()) % META_PLACES] += 1.0
    out[META_PLACES + min(int(math.log2(length + 1) / 2), 10)] = 1.0
    out[META_PLACES + 11] = 1.0
    return out


@dataclass
class View:
    """Logistic regression on standardised features, and its calibration (slope, offset)."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    held: dict = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return np.clip(z, -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.logit(x) + self.offset, -30, 30)


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        move = np.linalg.solve(curve, x.T @ (w * (y - p)) - penalty * beta)
        beta += move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-6:
            break
    return beta


def fit_view(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> View:
    """Weighted by class, so that pseudo-labels don't move the prior."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    constant = scale < 1e-9
    mean[constant], scale[constant] = 0.0, 1.0
    view = View(np.zeros(x.shape[1]), mean, scale)
    z = np.clip((x - mean) / scale, -8, 8)
    balance = np.where(y > 0, 0.5 / max((w * y).sum(), 1e-9), 0.5 / max((w * (1 - y)).sum(), 1e-9)) * w.sum()
    view.weights = _newton(z, y, w * balance, penalty=1.0)
    return view


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    text: View
    meta: View
    layer: np.ndarray  # weights of the two calibrated log odds, and an offset

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.calibrated(xt), self.meta.calibrated(xm)
        return sigmoid(a), sigmoid(b), sigmoid(self.layer[0] * a + self.layer[1] * b + self.layer[2])


# --- on Spark --------------------------------------------------------------------------------

FEATURES = "row long, doc_id long, xt binary, xm binary"


def featured(docs: DataFrame) -> DataFrame:
    """row, doc_id and both views' features of every document; n_chars plays no part, the text's length does."""
    for name in ("source", "lang"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            xt = [np.array(text_features(t), "<f4").tobytes() for t in texts]
            xm = [np.array(meta_features(s, l, len(t)), "<f4").tobytes() for s, l, t in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(xt, pa.binary()), pa.array(xm, pa.binary())], ["row", "doc_id", "xt", "xm"])

    return rows.mapInArrow(run, FEATURES)


def _matrix(values: list[bytes]) -> np.ndarray:
    """Features as they are stored, a row to each."""
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1).astype(float)


def sure_rows(features: DataFrame, views: dict[str, View], known: DataFrame) -> list:
    """For each view and class, HANDED rows that it is sure of, from all documents without a known label.

    Among sure rows a hash of the features decides, so that what is handed over is varied and a
    large group of copies isn't all of it.
    """
    shared = features.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = {"text": _matrix(batch.column("xt").to_pylist()), "meta": _matrix(batch.column("xm").to_pylist())}
                p = [pa.array(sigmoid(shared.value[v].calibrated(x[v]))) for v in ("text", "meta")]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("xt"), batch.column("xm"), *p], ["row", "doc_id", "xt", "xm", "pt", "pm"])

    scored = features.mapInArrow(run, FEATURES + ", pt double, pm double").join(F.broadcast(known), "doc_id", "left_anti")
    found = []
    sure = scored.filter(F.greatest("pt", "pm", 1 - F.col("pt"), 1 - F.col("pm")) >= SURE)
    kinds = F.array(
        F.when(F.col("pt") >= SURE, F.lit("text1")), F.when(F.col("pt") <= 1 - SURE, F.lit("text0")), F.when(F.col("pm") >= SURE, F.lit("meta1")), F.when(F.col("pm") <= 1 - SURE, F.lit("meta0"))
    )
    sure = sure.select("xt", "xm", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), F.xxhash64("xt", "xm").alias("h"))
    # one row per distinct features and kind in each of a fixed number of places: bounded, and copies count once
    place = F.pmod("h", F.lit(HANDED))
    first = sure.groupBy("kind", place.alias("place")).agg(F.min(F.struct("h", "xt", "xm")).alias("r"))
    for row in first.select("kind", "r.xt", "r.xm").collect():  # 4 kinds x HANDED rows at most
        found.append((row.kind, _matrix([row.xt])[0], _matrix([row.xm])[0]))
    return found


def co_train(features: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """None where a class has no labelled rows."""
    rows = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = written(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "quality-labels")  # `most` rows
    given = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min(F.struct("xt", "xm")).alias("x")).orderBy("doc_id").limit(most).collect()
    if len({bool(g.quality) for g in given}) < 2:
        return None
    y = np.array([float(g.quality > 0) for g in given])
    xt, xm = _matrix([bytes(g.x.xt) for g in given]), _matrix([bytes(g.x.xm) for g in given])
    # the part of a label follows from its id: training, calibration of the views, the layer
    part = np.array([(g.doc_id * 2654435761 >> 7) % 10 for g in given])
    train, kept, last = part < TRAINING, (part >= TRAINING) & (part < TRAINING + 2), part >= TRAINING + 2
    if min(len(set(y[of])) for of in (train, kept, last)) < 2:  # too few labels for three parts
        train = np.arange(len(y)) % 2 == 1
        if min(len(set(y[of])) for of in (train, ~train)) < 2:
            train = np.ones(len(y), bool)
        kept = last = ~train if not train.all() else train
    sets = {"text": [(xt[train], y[train], np.ones(train.sum()))], "meta": [(xm[train], y[train], np.ones(train.sum()))]}

    def fitted() -> dict[str, View]:
        views = {}
        for name, x in (("text", xt), ("meta", xm)):
            views[name] = view = fit_view(*(np.concatenate(c) for c in zip(*sets[name], strict=True)))
            view.slope, view.offset = _newton(np.stack([view.logit(x[kept]), np.ones(kept.sum())], 1), y[kept], np.ones(kept.sum()), penalty=0.1)
            view.slope = max(view.slope, 0.0)  # a view that knows nothing must not vote against itself
        return views

    views = fitted()
    for _ in range(rounds):
        handed = sure_rows(features, views, chosen.select("doc_id"))
        if not handed:
            break
        sets["text"], sets["meta"] = sets["text"][:1], sets["meta"][:1]
        for name, column in (("meta", 1), ("text", 2)):
            to = "text" if name == "meta" else "meta"
            mine = [(h[column if to == "text" else 2], float(h[0][-1])) for h in handed if h[0].startswith(name)]
            if mine:
                # all that is handed over weighs half of what is labelled
                weight = 0.5 * train.sum() / len(mine)
                sets[to].append((np.array([x for x, _ in mine]), np.array([c for _, c in mine]), np.full(len(mine), min(weight, 1.0))))
        views = fitted()
    a, b = views["text"].calibrated(xt[last]), views["meta"].calibrated(xm[last])
    layer = _newton(np.stack([a, b, np.ones(len(a))], 1), y[last], np.ones(len(a)), penalty=0.1)
    return CoTrained(views["text"], views["meta"], layer)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, quality, keep (quality >= 0.5).

    Null and empty texts have the features of an empty text; unknown sources and languages are
    values like others; null ids can't be labelled; repeated rows give repeated scores; without
    labels of both classes every score is null and every row is kept; an empty table gives no
    rows; further columns are not looked at.
    """
    features = written(featured(docs), "quality-features")
    return _scored(features, co_train(features, labels)).drop("row")


def _scored(features: DataFrame, model: CoTrained | None) -> DataFrame:
    if model is None:
        none = F.lit(None).cast("double")
        return features.select("row", "doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("quality"), F.lit(True).alias("keep"))
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = shared.value.scores(_matrix(batch.column("xt").to_pylist()), _matrix(batch.column("xm").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, scores)], ["row", "doc_id", "text_score", "meta_score", "quality"])

    return features.mapInArrow(run, "row long, doc_id long, text_score double, meta_score double, quality double").withColumn("keep", F.col("quality") >= 0.5)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score_quality keeps, with all their columns.

    Rows count as in score_quality: null texts as empty, any null or tie as a value like others,
    repeated rows alike; without labels of both classes all rows stay; an empty table gives no rows.
    The features are computed once for learning; the last pass reads a text, computes its features
    again and decides on the spot, so that no text is moved.
    """
    features = written(featured(docs), "quality-features")
    model = co_train(features, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            texts = texts_of(batch)
            nothing = [None] * len(texts)
            sources, langs = (batch.column(c).to_pylist() if c in batch.schema.names else nothing for c in ("source", "lang"))
            xt = np.array([text_features(t) for t in texts], "<f4").astype(float)
            xm = np.array([meta_features(s, l, len(t)) for s, l, t in zip(sources, langs, texts, strict=True)])
            yield batch.filter(pa.array(shared.value.scores(xt, xm)[2] >= 0.5))

    return docs.mapInArrow(run, docs.schema)
