import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F
from quayside.llm import queries
from quayside.llm.exact_dedup import exact_dedup, land, without_copies
from quayside.llm.shared import new_folder


def weak(text):
    """A digest with many collisions."""
    return F.encode(F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(3)).cast("string"), "UTF-8")


def check(docs, got):
    rows = docs.collect()
    groups = defaultdict(list)
    for d in rows:
        groups[d.text or ""].append(d.doc_id)
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want


def test_groups(docs):
    check(docs, exact_dedup(docs).collect())


def test_many_batches_give_the_same(docs):
    check(docs, exact_dedup(docs.repartition(7), files_per_batch=1).collect())


def test_collisions_are_found_by_their_bytes(docs):
    check(docs, exact_dedup(docs, digest=weak).collect())


def test_a_later_run_goes_on(spark, docs):
    work = new_folder(spark, "stream")
    first = exact_dedup(docs.filter("doc_id = 7"), work=work).collect()
    assert [(r.group_size, r.kept) for r in first] == [(1, True)]
    row = exact_dedup(docs.filter("doc_id = 8"), work=work).first()
    assert (row.group_size, row.keep_id, row.kept, row.keep_run) == (2, 8, True, 1)


def test_what_is_landed_twice_is_kept_once(spark, docs):
    work = new_folder(spark, "stream")
    runs = [exact_dedup(docs, work=work).collect() for _ in range(3)]
    texts = {r.text or "" for r in docs.collect()}
    assert [sum(r.kept for r in run) for run in runs] == [len(texts), 0, 0]
    assert [sorted(r.group_size for r in run) for run in runs] == [sorted(k * r.group_size for r in runs[0]) for k in (1, 2, 3)]


def test_collisions_with_earlier_runs_are_found_by_their_bytes(spark):
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i % 10}") for i in ids], "doc_id long, text string")
    one = lambda text: F.encode(F.lit("same"), "UTF-8") if text is not None else None
    work = new_folder(spark, "stream")
    assert [r.kept for r in exact_dedup(rows(1), one, work=work).collect()] == [True]
    got = {r.doc_id: r for r in exact_dedup(rows(2, 11), one, work=work).collect()}
    assert (got[2].keep_id, got[2].group_size, got[11].keep_id, got[11].group_size) == (2, 1, 11, 2)
    got = {r.doc_id: r for r in exact_dedup(rows(3, 12, 21), one, work=work).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {3: (3, 1, True), 12: (12, 2, True), 21: (21, 3, True)}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert all(r.text_sha256 == sha(f"text {i % 10}") for i, r in got.items())


def test_a_run_that_failed_is_taken_up(spark, docs):
    work = new_folder(spark, "stream")
    land(docs.filter("doc_id = 7"), work, 0)  # and then nothing
    got = exact_dedup(docs.filter("doc_id = 8"), work=work).collect()
    assert [(r.group_size, r.keep_id) for r in got] == [(2, 8)]


def test_kept_rows_keep_their_columns(docs):
    got = without_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (r.text or "" for r in got.collect()))) == sorted({r.text or "" for r in docs.collect()})


def test_any_column_name_is_kept(spark):
    names = ["doc_id", "text", "digest", "doc", "place", "run", "row", "quayside_row", "keep", "many"]
    odd = spark.createDataFrame([(1, "a", *names[2:]), (2, "a", *names[2:]), (3, None, *names[2:])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    assert sorted(r.doc_id for r in exact_dedup(odd).filter("kept").collect()) == [2, 3]
    got = without_copies(odd)
    assert got.columns == names and sorted(map(tuple, got.collect())) == [(2, "a", *names[2:]), (3, None, *names[2:])]


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert without_copies(no_docs).count() == 0


def test_query_equals_oracle(spark):
    folder, name = "/root/testdata/sf0.001", "op5_streaming_exact_dedup"
    got = queries.QUERIES[name](spark, folder)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = base.execute(queries.ORACLES[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
