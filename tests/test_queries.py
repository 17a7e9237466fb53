"""Every query with an oracle equals it on the smallest tables, and those over pairs of listings on larger ones too."""

import math

import duckdb
import pytest
from quayside.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LARGER, PAIRS = "/root/testdata/sf0.01", ["duplicate_features", "corrected_reposts", "review_pairs"]


def views(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def oracle():
    return views(FOLDER)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return "null"
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.6g}" if not hasattr(value, "isoformat") else str(value)
    return str(value).removesuffix(" 00:00:00")


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    want = oracle.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", PAIRS)
def test_query_on_larger_tables(spark, name):
    got, want = registry.QUERIES[name](spark, LARGER).toPandas(), views(LARGER).execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
