"""Every operator and every stage over a table without rows, and over one row of nulls beside columns with clashing names."""

import corpus_pipeline
import pytest
from quayside.llm import queries
from quayside.llm.shared import free_name, join_counted
from quayside.llm.simhash import plan_probes, thresholds

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, component string",
}
CLASHES = "quayside_row string, quayside_hits string, digest string, doc struct<text:string>, place string, fp string, row string, many string, entities string"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Two folders of tables: without rows, and with one row of nulls."""
    out = {}
    for name, rows in (("empty", 0), ("nulls", 1)):
        folder = str(tmp_path_factory.mktemp(name))
        for table, schema in {"documents": DOCUMENTS + ", " + CLASHES, **TABLES}.items():
            shape = spark.createDataFrame([], schema)
            df = spark.createDataFrame([(None,) * len(shape.columns)] * rows, shape.schema)
            df.write.parquet(f"{folder}/{table}.parquet")
        out[name] = folder
    return out


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n != "pipeline"))
def test_operator(spark, folders, name):
    extra = 1 if name == "op10_chat_format" else 0  # conversation -1 is always there
    assert queries.QUERIES[name](spark, folders["empty"]).count() == extra
    got = queries.QUERIES[name](spark, folders["nulls"]).collect()
    assert len(got) == (0 if name == "op13_embedding_whitening" else 1 + extra)  # a null vector is no row


def test_stages(spark, folders):
    for name, rows in (("empty", 0), ("nulls", 1)):
        docs = spark.read.parquet(f"{folders[name]}/documents.parquet")
        columns = docs.columns
        for stage, run in corpus_pipeline.STAGES[:-1]:
            docs = run(spark, docs, folders[name])
            assert (stage, docs.columns) == (stage, columns) and docs.count() == rows
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folders[name]).count() == rows
        assert corpus_pipeline.run(spark, folders[name]).count() == rows


def test_no_probes_without_two_fingerprints(spark):
    for rows in ([], [(5,)]):
        assert plan_probes(spark.createDataFrame(rows, "fp long"), 7) == []
    import numpy as np

    allotted, _ = thresholds(0, np.zeros((64, 64)), [list(range(32)), list(range(32, 64))], 3)
    assert sum(t + 1 for t in allotted) == 4 and max(allotted) <= 2  # of equal costs the one with fewer probes


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 100), ("none", 101)], "k string, i long")
    table = spark.createDataFrame([("hot", 100, "a"), ("cold", 1, "b")], "k string, many long, v string")
    got = sorted((r.k, r.i, r.v) for r in join_counted(rows, table, "k").collect())
    assert got == [("cold", 100, "b")] + [("hot", i, "a") for i in range(100)]
    assert free_name(rows, "K") == "K_1" and free_name(rows, "x") == "x"
