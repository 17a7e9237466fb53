import random
import zlib

import numpy as np
from quayside.llm.toxicity import BlockMaxIndex, calibrated, fit, score_toxicity, terms_of

from .conftest import SCHEMA, prose


def corpus(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = prose(i).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron", "trash", "loser"]))
        rows.append((i, " ".join(words), "en", "s", 1, None, None, None, None))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = corpus(spark)
    got = score_toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(zlib.crc32(str(e.doc_id).encode()) % 5 for r in got for e in r.evidence)


def test_neighbours_are_exact():
    r = np.random.default_rng(1)
    dense = np.where(r.random((500, 40)) < 0.1, r.random((500, 40)), 0)
    dense[:, 39] = 0.2
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    index = BlockMaxIndex(vectors, np.zeros(500, int), np.arange(500), 40)
    for i in range(100):
        best, similar = index.nearest(vectors[i], 10)
        want = np.sort(dense @ dense[i])[::-1][:10]
        assert np.allclose(similar, want)


def test_blocks_that_cannot_win_are_not_read(monkeypatch):
    n = 64 * 40
    vectors = [(np.array([i // 64, 40]), np.array([0.98, 0.2])) for i in range(n)]
    index = BlockMaxIndex(vectors, np.arange(n) % 2, np.arange(n), 41)
    read = []
    whole = BlockMaxIndex._scores
    monkeypatch.setattr(BlockMaxIndex, "_scores", lambda self, opened, *rest: read.extend(opened) or whole(self, opened, *rest))
    best, similar = index.nearest(vectors[70], 24)
    assert len(read) == 8 and np.allclose(similar, 0.98**2 + 0.2**2) and list(best) == sorted(best)  # ties by place


def test_query_against_brute_force(spark):
    docs, labels = corpus(spark)
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(1000, " ".join(prose(k) for k in range(300)) + " you moron", *[None] * 7), (1001, "x" * 300, *[None] * 7)], SCHEMA))
    model = fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = len(model.vectors.idf) + 1

    def dense(i):
        at, weight = model.vectors.vector(texts[i])
        out = np.zeros(size)
        out[at] = weight
        return out

    examples = np.array([dense(int(i)) for i in model.index.ids])
    for r in score_toxicity(docs, labels).collect():
        cosines = examples @ dense(r.doc_id)
        order = np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12)))[:24]
        assert np.allclose([e.cosine for e in r.evidence], cosines[order][:3])
        weight = 1 / (1.02 - np.minimum(cosines[order], 1.0))
        vote = (weight * model.index.labels[order]).sum() / weight.sum()
        assert abs(r.score - calibrated(vote, model.slope, model.offset)) < 1e-9


def test_unspaced_text_and_long_words_are_read():
    assert "~scum!"[:5] == "~scum" and any("scum" in t for t in terms_of("a" * 90 + "scum" + "b" * 90))
    assert terms_of("Trash!")[0] == "trash" and terms_of("...") == ()


def test_awkward_rows(spark, docs, no_docs):
    _, labels = corpus(spark)
    assert score_toxicity(docs, labels).count() == docs.count()
    assert score_toxicity(no_docs, labels).count() == 0
    none = spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.0}
