"""Whitening of embeddings by the exact spectrum of their integer scatter.

Entries become whole numbers; tasks sum products of distinct vectors exactly, the scatter matrix (dimension squared, whatever
the number of vectors) meets on the driver, residues of its characteristic polynomial are computed in tasks, a prime each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import exact_spectrum as es
from strophe.llm.common import written

#: Primes a task works through.
PRIMES_A_TASK = 16


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``axes`` holds unit vectors over n times their deviation, so that
    (n * x - sums) @ axes is white; ``shares`` of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    shares: list[float]
    identity_error: float = 0.0


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry as a long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """A vector that is there and holds finite numbers only."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exactly: in doubles while every sum stays below 2^53, else in whole numbers of any size."""
    top = int(np.abs(x).max(initial=0))
    if top * top * max(len(x), 1) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and n * sums of products - products of sums of the vectors ``x``; a task returns dimension squared / 2 rows."""
    i, j = np.triu_indices(dims)
    where_i, where_j = [-1, *[-1] * dims, *i.tolist()], [-1, *range(dims), *j.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            sums = sums + x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 1 << 40 else sums + x.sum(axis=0).astype(object)
            products = products + _products(x)
        if n:
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(where_i, pa.int32()), pa.array(where_j, pa.int32()), pa.array([str(v) for v in values])], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {(r["i"], r["j"]): int(r["v"]) for r in rows}
    n, sums = found.get((-1, -1), 0), [found.get((-1, k), 0) for k in range(dims)]
    return n, sums, [[n * found.get((min(a, b), max(a, b)), 0) - sums[a] * sums[b] for b in range(dims)] for a in range(dims)]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first; residues modulo primes come from tasks."""
    moduli = es.primes(2 * es.coefficient_bound(matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([es.residue(matrix, moduli[k]).tolist() for k in at], pa.list_(pa.int64()))], ["id", "c"])

    rows = spark.range(0, len(moduli), 1, ceil(len(moduli) / PRIMES_A_TASK)).mapInArrow(run, "id long, c array<long>").collect()
    return es.from_residues([moduli[r["id"]] for r in rows], [r["c"] for r in rows])


#: Whole numbers below this are computed in 64 bits.
SMALL = 1 << 62


def _tops(x: np.ndarray, model: Whitening) -> tuple[int, int]:
    return int(np.abs(x).max(initial=0)), max((abs(v) for v in model.sums), default=0)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened components of whole vectors: n * x - sums is exact before it becomes a double."""
    top, sums = _tops(x, model)
    kind = np.int64 if model.n * top + sums < SMALL else object
    return (x.astype(kind) * model.n - np.array(model.sums, dtype=kind)).astype(np.float64) @ model.axes


def _deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Sum of (n * x - sums)^2 per row, exactly: in 64 bits if all of it fits, else from n^2 x.x - 2 n x.sums + sums.sums, whose
    parts mostly do, so that only one long number a row is left."""
    (top, sums), dims = _tops(x, model), x.shape[1]
    if (model.n * top + sums) ** 2 * dims < SMALL:
        c = x * model.n - np.array(model.sums, dtype=np.int64)
        return (c * c).sum(axis=1)
    y = x if top * max(top, sums) * dims < SMALL else x.astype(object)
    squares, mixed = (y * y).sum(axis=1), (y * np.array(model.sums, dtype=y.dtype)).sum(axis=1)
    return squares.astype(object) * (model.n * model.n) - mixed.astype(object) * (2 * model.n) + sum(v * v for v in model.sums)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity: means first, then centred products."""
    dims, k = model.axes.shape

    def summed(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(of(_projected(_matrix(b.column(0), dims), model)) for b in batches)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])
        rows = fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / model.n

    mean = summed(lambda w: w.sum(axis=0))
    return float(np.abs(summed(lambda w: (w - mean).T @ (w - mean)).reshape(k, k) - np.eye(k)).max())


def fitted(spark: SparkSession, fit: DataFrame, dims: int, count: int = 4) -> Whitening:
    """Whitening from a table of distinct whole vectors ``x``. Components of eigenvalue zero don't exist: there are as many
    as the rank allows."""
    n, sums, matrix = scatter(fit, dims)
    trace = sum(matrix[i][i] for i in range(dims))
    if trace == 0:
        return Whitening(n, sums, np.zeros((dims, 0)), [])
    axes, shares = [], []
    for value, v in es.components(matrix, characteristic_polynomial(spark, matrix), count):
        deviation = value.sqrt()  # n times the deviation of x along the component
        axes.append([float(e / deviation) for e in v])
        shares.append(float(value / Decimal(trace)))
    model = Whitening(n, sums, np.array(axes).T, shares)
    return Whitening(n, sums, model.axes, shares, _identity_error(fit, model))


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 4, scale: int = 256) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries go; so do rows of another length than the most frequent one
    (of equally frequent ones the longest), as they have no place in the same space. The fit list holds each whole vector
    once, so repeated rows change nothing but come out repeated; keys may be null or repeated. Entries are cut to
    the range of a long. There are fewer components than ``count`` where the rank is lower, hence no rows
    for an empty table or a single distinct vector. Equal eigenvalues take orthogonal vectors of their space. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector))).select(F.col(key).alias("_key"), whole(F.col(vector), scale).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = sizes["d"] if sizes else 0
    rows = rows.where(F.size("x") == dims)
    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fitted(spark, written(rows.select("x").distinct(), "fit"), dims, count) if dims else Whitening(0, [], np.zeros((0, 0)), [])
    k = len(model.shares)
    if k == 0:
        return spark.createDataFrame([], schema).withColumnRenamed("_key", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            white, squares = _projected(x, model), _deviations(x, model)
            deviation = pa.array(squares).cast(pa.decimal128(38, 0)) if squares.dtype != object else pa.array([Decimal(int(v)) for v in squares], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(white)), k))
            size = len(white) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), len(white)), pa.int32()), pa.array(np.full(size, model.n)), deviation.take(each),
                 pa.array(white.ravel()), pa.array(np.tile(model.shares, len(white))), pa.array(np.full(size, model.identity_error))],
                ["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
