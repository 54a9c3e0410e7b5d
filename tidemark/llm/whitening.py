"""Embedding whitening from bit-sliced cross-products.

Entries become integers, x = floor(scale * c) + offset. Within a batch each dimension is shifted by its least value and
cut into bit planes, packed across rows into words of 64; the product sum of two dimensions is the sum over their planes
of 2^(p + q) times the set bits of the planes' AND. A task adds up its batches and gives one row for each pair of
dimensions, Spark adds those of all tasks, and the covariance n * P - S S' is centred in whole numbers before it is
divided and decomposed. What reaches the driver follows the dimensions, never the rows.

Vectors that are null or hold null or non-finite entries are dropped, as are empty ones and those whose length is not
the most frequent one (the longer of equally frequent ones). Entries beyond 2^62 / scale count as that. Components whose
variance is less than 1e-11 of the largest are not numbered: rounding hides them; equal vectors therefore give no rows,
nor does an empty table. Ids may be null or repeated, rows are handled one by one; other columns are not read.
``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_LIMB = 60  # product sums travel as high and low parts, so that a decimal holds the sum of any number of tasks
LEAST_VARIANCE = 1e-11


def fixed_point(c: np.ndarray, scale: int, offset: int) -> np.ndarray:
    limit = float(1 << 62)
    return np.floor(np.clip(c * float(scale), -limit, limit)).astype(np.int64) + offset


def product_sums(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Exact sums of x_a * x_b (Python integers) and of x_a over the rows."""
    n, dims = x.shape
    low = x.min(0)
    y = x.view(_U) - low.view(_U)  # wraps to the right difference, whatever the range
    bits = np.array([max(1, int(top).bit_length()) for top in y.max(0)])
    owner = np.repeat(np.arange(dims), bits)
    first = np.cumsum(bits) - bits
    shift = (np.arange(len(owner)) - first[owner]).astype(_U)
    words = -(-n // 64)
    planes = np.zeros((len(owner), words), _U)
    columns = np.ascontiguousarray(y.T)
    for k, (d, s) in enumerate(zip(owner, shift)):
        planes[k].view(np.uint8)[: -(-n // 8)] = np.packbits(((columns[d] >> s) & _U(1)).astype(bool))
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for k, plane in enumerate(planes):
        counts[k, k:] = np.bitwise_count(planes[k:] & plane).sum(1, dtype=np.int64)
        counts[k:, k] = counts[k, k:]
    small = 2 * int(bits.max()) + n.bit_length() < 62
    weight = (_U(1) << shift).astype(np.int64 if small else object)
    by_row = np.add.reduceat(counts * weight[:, None] * weight, first, axis=0)
    shifted = np.add.reduceat(by_row, first, axis=1).astype(object)
    ones = counts.diagonal().astype(object) * weight.astype(object)
    sums = np.add.reduceat(ones, first)
    base = low.astype(object)
    products = shifted + np.outer(base, sums) + np.outer(sums, base) + n * np.outer(base, base)
    return products, [int(s) + n * int(b) for s, b in zip(sums, base)]


def squared_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for each row, exact; null beyond a long."""
    base = [s // n for s in sums]
    near = x.astype(object) - np.array(base, object) if np.abs(x).max(initial=0) >= 1 << 61 else x - np.array(base, np.int64)
    rest = np.array([s - n * b for s, b in zip(sums, base)], object)  # n * x - S = n * (x - base) - rest
    reach = n * (int(np.abs(near).max(initial=0)) + 1)
    if x.shape[1] * reach * reach < 1 << 63:
        u = near.astype(np.int64) * n - rest.astype(np.int64)
        return (u * u).sum(1).tolist()
    if reach >= 1 << 58:
        u = near.astype(object) * n - rest
        return [v if v < 1 << 63 else None for v in (u * u).sum(1).tolist()]
    u = np.abs(near.astype(np.int64) * n - rest.astype(np.int64))
    high, low = u >> 29, u & ((1 << 29) - 1)
    groups = np.arange(0, x.shape[1], 16)
    part = lambda v: np.add.reduceat(v, groups, axis=1).astype(object).sum(1)
    total = (part(high * high) << 58) + (part(high * low) << 30) + part(low * low)
    return [v if v < 1 << 63 else None for v in total.tolist()]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), dims)


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


class Fit:
    """Count, sums and covariance of the vectors, and the components: ``vectors`` (a column each) and ``values``."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], most: int):
        self.n, self.sums = n, sums
        dims = range(len(sums))
        self.covariance = np.array([[(n * products[a][b] - sums[a] * sums[b]) / (n * n) for b in dims] for a in dims])
        values, vectors = np.linalg.eigh(self.covariance)
        order = [k for k in np.argsort(-values, kind="stable")[:most].tolist() if values[k] > LEAST_VARIANCE * values[-1] and values[k] > 0]
        self.values, self.vectors = values[order], vectors[:, order]
        if order:
            self.vectors = self.vectors * np.sign(self.vectors[np.abs(self.vectors).argmax(0), np.arange(len(order))])
        self.explained = self.values / float(np.trace(self.covariance))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - part) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, dims: int, scale: int, offset: int, most: int) -> Fit:
    """One pass over (vec_id, v): the product sums of all vectors, added up exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                p, s = product_sums(fixed_point(_matrix(batch.column(0), dims), scale, offset))
                n, sums, products = n + batch.num_rows, sums + np.array(s, object), products + p
        if not n:
            return
        a, b = np.triu_indices(dims)
        values = [*products[a, b].tolist(), *sums.tolist(), n]
        a, b = [*a.tolist(), *range(dims), -1], [*b.tolist(), *[-1] * dims, -1]
        high, low = zip(*(divmod(v, 1 << _LIMB) for v in values))
        big = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(map(int, high)), pa.int64()).cast(big) if max(map(abs, high)) < 1 << 62 else _decimals(high), pa.array(list(map(int, low)), pa.int64()).cast(big)], names=["a", "b", "high", "low"])

    parts = vectors.select("v").mapInArrow(run, "a int, b int, high decimal(38,0), low decimal(38,0)")
    total = parts.groupBy("a", "b").agg(F.sum("high").cast("string").alias("high"), F.sum("low").cast("string").alias("low")).toArrow()
    n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for a, b, high, low in zip(*(c.to_pylist() for c in total.columns)):
        value = (int(high) << _LIMB) + int(low)
        if a < 0:
            n = value
        elif b < 0:
            sums[a] = value
        else:
            products[a][b] = products[b][a] = value
    return Fit(n, sums, products, most)


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def identity_error(vectors: DataFrame, model: Fit, dims: int, scale: int, offset: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            z = model.whiten(fixed_point(_matrix(batch.column(0), dims), scale, offset))
            sums, products = sums + z.sum(0), products + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(size * size + size), pa.int32()), pa.array(np.concatenate((products.ravel(), sums)))], names=["k", "value"])

    total = vectors.select("v").mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).toPandas().sort_values("k")["value"].to_numpy() / model.n
    mean = total[size * size :]
    return float(np.abs(total[: size * size].reshape(size, size) - np.outer(mean, mean) - np.eye(size)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 32) -> DataFrame:
    """vec_id, component int, n long, deviation long, whitened double, explained double, identity_error double: a row
    for each vector and component."""
    vectors = _vectors(rows, id_col, vector_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = lengths["dims"]
    vectors = vectors.where(F.size("v") == dims)
    model = fit(vectors, dims, scale, offset, components)
    size = len(model.values)
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, dims, scale, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = fixed_point(_matrix(batch.column(1), dims), scale, offset)
            row = pa.array(np.repeat(np.arange(n), size))
            deviation = pa.array(squared_deviation(x, model.n, model.sums), pa.int64())
            columns = [batch.column(0).take(row), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), n)), pa.array(np.full(n * size, model.n)), deviation.take(row), pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * size, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return vectors.select("vec_id", "v").mapInArrow(run, schema)
