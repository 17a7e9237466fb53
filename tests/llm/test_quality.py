import numpy as np
from quayside.llm.quality import good_documents, score_quality, text_features

from .conftest import SCHEMA, prose


def corpus(spark):
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = prose(i) + "." if good else " ".join(w.upper() + "!!" for w in prose(i).split())
        rows.append((i, text, "en", f"s{i % 4}", len(text), None, None, None, None))
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r.keep for r in score_quality(docs, labels).collect()}
    assert len(got) == 240
    assert np.mean([got[i] == (i % 3 > 0) for i in range(120, 240)]) > 0.97


def test_stage_decides_like_the_scores(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in good_documents(docs, labels).collect()}
    assert kept == {r.doc_id for r in score_quality(docs, labels).filter("keep").collect()}
    assert good_documents(docs, labels).columns == docs.columns


def test_awkward_rows(spark, docs, no_docs):
    _, labels = corpus(spark)
    assert score_quality(docs, labels).count() == docs.count()
    assert score_quality(no_docs, labels).count() == 0
    assert score_quality(docs.select("doc_id", "text"), labels).count() == docs.count()


def test_without_labels_all_stay(spark, docs):
    none = spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, none).filter("keep").count() == docs.count()
    assert good_documents(docs, none).count() == docs.count()


def test_features_are_finite():
    for text in ("", " ", "a", "\n\n", "😀" * 5000, prose(1, 9000), "| | |"):
        assert np.isfinite(text_features(text)).all()
