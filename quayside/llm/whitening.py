"""Whitening of embeddings by matrix-free block subspace iteration.

A block Q of directions is held on the driver, d x b numbers, whatever the number of rows.  Each
pass over the table computes the exact mean's centred product C'(CQ) in its tasks, C never leaving
them; partial products are added up by a shuffle.  Rayleigh-Ritz inside the block gives components
and their residuals.  A component is certified once its residual is nothing beside the largest
eigenvalue.  While some are not, the block is made orthonormal by QR and multiplied again; where the
spectrum is so flat that this would take long, random directions widen the block, to all d at most,
where one pass settles all.

Entries are whole numbers (`quantised`), so sums, the count and deviations are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: A component is certified at a residual of TOLERANCE times the largest eigenvalue; what is below RANK times it has no direction.
TOLERANCE, RANK = 1e-13, 1e-11
#: The block widens if more than PATIENCE further passes are in sight.
PATIENCE, MOST_PASSES = 6, 200
SCALE, SHIFT = 64, 1_000_000
#: Larger entries have no exact double, so they are no usable numbers.
LARGEST = float(1 << 52)


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as whole numbers."""
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64) + SHIFT


def _matrices(batch: pa.RecordBatch, column: str, size: int, most: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x) of a batch in pieces; every row has a vector of this size."""
    for start in range(0, batch.num_rows, most):
        rows = batch.column(column).slice(start, most)
        yield start, quantised(np.asarray(rows.flatten()).reshape(len(rows), size))


def usable_vectors(table: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has only finite entries, as `vector`: array<double>, and their dimension.

    The dimension is the commonest one of these vectors, the larger of equals; vectors of another one
    lie in another space and are left out, as those without entries are, and those with an entry whose
    whole number is beyond 2^52.
    """
    given = F.col(vector)
    bad = F.exists(given, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) * SCALE >= LARGEST))
    rows = table.filter(given.isNotNull() & (F.size(given) > 0) & ~bad).withColumn(vector, given.cast("array<double>"))
    first = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = first[0]["size"] if first else 0
    return rows.filter(F.size(vector) == size), size


def _sums(rows: DataFrame, vector: str, size: int) -> tuple[int, list[int], int]:
    """n, the exact sum of each dimension, and the largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, total = 0, 0, [0] * size
        for batch in batches:
            for _, x in _matrices(batch, vector, size):
                # two halves, so that no sum of a piece overflows
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
                total = [t + (h << 26) + w for t, h, w in zip(total, high, low, strict=True)]
                n, most = n + len(x), max(most, int(np.abs(x).max()))
        if n:
            columns = [pa.array(range(size), pa.int32()), pa.array([n] * size), pa.array([most] * size), pa.array(map(Decimal, total), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", "most", "total"])

    parts = rows.select(vector).mapInArrow(run, "i int, n long, most long, total decimal(38,0)")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("total").alias("total")).collect()
    return found[0]["n"], [int(r.total) for r in sorted(found)], max(r.most for r in found)


def _centred(x: np.ndarray, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact (Python's whole numbers where 64 bits don't hold it), and x - S / n as double."""
    if n * most < 1 << 61:
        exact = n * x - np.array(sums, np.int64)
    else:
        exact = n * x.astype(object) - np.array(sums, object)
    return exact, exact.astype(np.float64) / n


def _product(rows: DataFrame, vector: str, n: int, sums: list[int], most: int, block: np.ndarray) -> tuple[np.ndarray, float]:
    """C'(C block) / n over the centred rows C, and the trace of C'C / n."""
    size, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace, some = np.zeros((size, width)), np.zeros(size), False
        for batch in batches:
            for _, x in _matrices(batch, vector, size):
                c = _centred(x, n, sums, most)[1]
                total += c.T @ (c @ block)
                trace += (c * c).sum(axis=0)
                some = True
        if some:
            flat = pa.array(np.column_stack([total, trace]).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.FixedSizeListArray.from_arrays(flat, width + 1).cast(pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select(vector).mapInArrow(run, "i int, v array<double>")
    found = parts.groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width + 1))).collect()
    table = np.array([r[1:] for r in sorted(found)])  # one row per dimension
    return table[:, :-1] / n, float(table[:, -1].sum()) / n


def principal_components(rows: DataFrame, vector: str, k: int, fitted: tuple[int, list[int], int], size: int, width: int | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k leading eigenvalues and unit eigenvectors (as columns), the trace, and the passes taken.

    There are fewer than k where the vectors span less.  `width` is that of the first block (2 k).
    """
    n, sums, most = fitted
    random = np.random.default_rng(seed)
    width = min(size, max(k, width or 2 * k))
    block = np.linalg.qr(random.standard_normal((size, width)))[0]
    before = math.inf
    for passes in range(1, MOST_PASSES + 1):
        image, trace = _product(rows, vector, n, sums, most, block)
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)  # Rayleigh-Ritz
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        vectors, image = block @ turn, image @ turn
        top = max(values[0], 0.0)
        # a block of all directions holds every eigenvector, up to the rounding that its residuals show
        residuals = np.linalg.norm(image - vectors * values, axis=0)[:k]
        worst = float(residuals.max(initial=0.0))
        if top == 0 or worst <= TOLERANCE * top or block.shape[1] == size:
            if worst > math.sqrt(size) * 100 * TOLERANCE * top:
                raise ArithmeticError(f"residual {worst} in a block of all directions")
            kept = min(k, int((values > RANK * trace).sum())) if trace > 0 else 0
            return values[:kept], vectors[:, :kept] / np.linalg.norm(vectors[:, :kept], axis=0), trace, passes
        rate = worst / before  # 0 for the first residual of a block
        slow = rate >= 1 or (rate > 0 and math.log(TOLERANCE * top / worst) / math.log(rate) > PATIENCE)
        wider = min(size, 2 * block.shape[1]) - block.shape[1] if slow else 0
        before = math.inf if wider else worst
        block = np.linalg.qr(np.column_stack([image, top * random.standard_normal((size, wider))]))[0]
    raise ArithmeticError(f"not certified after {MOST_PASSES} passes")


def _identity_error(rows: DataFrame, vector: str, fitted: tuple[int, list[int], int], size: int, matrix: np.ndarray) -> float:
    """How far the covariance of the whitened rows is from the identity, measured over all of them."""
    n, sums, most = fitted
    k = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((k, k + 1)), False
        for batch in batches:
            for _, x in _matrices(batch, vector, size):
                z = _centred(x, n, sums, most)[1] @ matrix
                total += np.column_stack([z.T @ z, z.sum(axis=0)])
                some = True
        if some:
            flat = pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.FixedSizeListArray.from_arrays(flat, k + 1).cast(pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select(vector).mapInArrow(run, "i int, v array<double>")
    found = parts.groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(k + 1))).collect()
    table = np.array([r[1:] for r in sorted(found)]) / n
    mean = table[:, -1]
    return float(np.abs(table[:, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, width: int | None = None) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Rows with a null vector, a null, NaN or infinite entry, or no entry are left out; `usable_vectors`
    says what happens to vectors of another length.  Repeated rows and null or repeated keys are rows
    like others.  There are as many components as the vectors span, `components` at most: fewer for
    fewer dimensions or rows, none where all vectors are equal, and no rows then; an empty table gives
    no rows.  Of equal eigenvalues any orthonormal directions are taken, the same for all rows.
    `deviation` is exact; it is null where 38 digits don't hold it.  Other columns are not looked at.
    """
    spark = table.sparkSession
    named = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    name = free_name(table.select(key), "component")  # a key called component keeps its name
    shape = f"key {named.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, size = usable_vectors(named, "vector")
    fitted = _sums(rows, "vector", size) if size else (0, [], 0)
    if not size:
        return spark.createDataFrame([], shape).withColumnRenamed("component", name).withColumnRenamed("key", key)
    values, vectors, trace, _ = principal_components(rows, "vector", components, fitted, size, width)
    k = len(values)
    matrix = vectors / np.sqrt(values)
    error = _identity_error(rows, "vector", fitted, size, matrix) if k else 0.0
    explained = (values / trace).tolist() if k else []
    n, sums, most = fitted
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in _matrices(batch, "vector", size, 1024):
                if not k:
                    continue
                exact, centred = _centred(x, n, sums, most)
                # squares fit into 64 bits only while the entries are this small
                small = exact.dtype != object and int(np.abs(exact).max()) ** 2 * size < 1 << 62
                squares = ((exact if small else exact.astype(object)) ** 2).sum(axis=1).tolist()
                deviation = pa.array([Decimal(s) if s < limit else None for s in squares], pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(start, len(x)).take(at),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, n)),
                        deviation.take(at),
                        pa.array((centred @ matrix).ravel()),
                        pa.array(explained * len(x)),
                        pa.array(np.full(len(x) * k, error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, shape).withColumnRenamed("component", name).withColumnRenamed("key", key)
