"""Whitening against numpy's eigenvalue solver, over wide and narrow blocks and odd vectors."""

import numpy as np
import pytest
from quayside.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def plain(vectors, k):
    """x, the exact deviations, and whitening up to signs, computed whole."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return x, ((n * x - s) ** 2).sum(axis=1), c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def check(found, ids, vectors, k):
    _, deviation, white, explained = plain(vectors, k)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == len(ids) * k
    for c in range(k):
        column = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(column @ white[:, c])
        assert np.abs(column * sign - white[:, c]).max() < 1e-8
        assert abs(got[ids[0], c + 1].explained / explained[c] - 1) < 1e-9
    assert [int(got[i, 1].deviation) for i in ids] == deviation.tolist()
    assert {r.n for r in found} == {len(ids)} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    path = f"/root/testdata/{folder}"
    table = sorted(spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect())
    found = queries.QUERIES["op13_embedding_whitening"](spark, path).collect()
    check(found, [r.vec_id for r in table], [r.embedding for r in table], 32)


@pytest.mark.parametrize("width", [3, 6, 40])
def test_narrow_blocks_are_iterated(spark, width):
    """Few strong directions in 40 dimensions: a block of them converges, without all 40."""
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((300, 40)) * (3.0 ** -np.arange(40) * 50 + 0.05)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    check(whitening.whiten(df, components=3, width=width).collect(), list(range(300)), vectors, 3)
    rows, size = whitening.usable_vectors(df.select("embedding"), "embedding")
    *_, passes = whitening.principal_components(rows, "embedding", 3, whitening._sums(rows, "embedding", size), size, width)
    assert passes == 1 if width == 40 else passes > 1


def test_flat_spectrum_widens_the_block(spark):
    r = np.random.default_rng(2)
    vectors = r.standard_normal((200, 30)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vectors)], SCHEMA)
    check(whitening.whiten(df, components=4, width=4).collect(), list(range(200)), vectors, 4)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [[0.5, 1.0, -1.0], [2.0, 0.0, 0.25], [2.0, 0.0, 0.25], [-3.0, 1.5, 8.0], [1.0, 1.0, 1.0]]
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, -inf, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v, None, None) for i, v in enumerate(good + odd)], SCHEMA)
    check(whitening.whiten(df).collect(), list(range(5)), good, 3)
    # null and repeated keys
    df = spark.createDataFrame([(None, v, None, None) for v in good], SCHEMA)
    assert whitening.whiten(df).filter("vec_id IS NULL").count() == 15


def test_fewer_directions_than_asked(spark):
    line = [[float(k), 2.0 * k, 0.0] for k in range(6)]
    df = spark.createDataFrame([(i, v, None, None) for i, v in enumerate(line)], SCHEMA)
    found = whitening.whiten(df).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0], None, None) for i in range(4)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none).columns == whitening.whiten(df).columns


def test_large_entries_stay_exact(spark):
    big = [[1e12, -1e12], [1e12, 1e12], [0.0, 3.0], [5e12, 1.0]]
    df = spark.createDataFrame([(i, v, None, None) for i, v in enumerate(big)], SCHEMA)
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x)]
    want = [sum((4 * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()}
    assert [got[i] for i in range(4)] == want
