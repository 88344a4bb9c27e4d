"""Embedding whitening on an exact covariance from bit-sliced scatter sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows whose bit planes are packed at once; a multiple of 64.
BLOCK_ROWS = 4096
#: Scaled entries beyond this, where doubles are no longer whole, count as this.
LARGEST = float(1 << 53)
#: Sums are carried in limbs of so many bits, so that a long holds the sum over any table.
LIMB = 16


@dataclass(frozen=True)
class Whitening:
    """What maps an integer vector to its components; ``low`` is subtracted from entries first."""

    low: np.ndarray
    high: np.ndarray
    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact: of longs where they hold it, else of Python's integers."""
        total = np.array(self.total, object)
        if self.n * int((self.high - self.low).max(initial=0)) < 1 << 62:
            return self.n * y - total.astype(np.int64)
        return y.astype(object) * self.n - total

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 * c) + 1000000 of each entry; rows with a null or non-finite entry go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten()
            entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
            keep[row[~np.isfinite(entries)]] = False
            chosen = entries[keep[row]]
            x = np.floor(np.clip(chosen * SCALE, -LARGEST, LARGEST)).astype(np.int64) + OFFSET
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(keep)), pa.ListArray.from_arrays(bounds, pa.array(x))], names=["vec_id", "x"]
            )

    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, x array<long>")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def extents(fit: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest entry of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            low, high = np.minimum(low, x.min(axis=0, initial=low.max())), np.maximum(high, x.max(axis=0, initial=high.min()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    found = fit.mapInArrow(run, "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = found.orderBy("dim").toPandas()  # one row per dimension
    return rows["low"].to_numpy(np.int64), rows["high"].to_numpy(np.int64)


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit p of dimension i of all rows, packed into words: planes[p, i, word]."""
    rows, dims = y.shape
    words = -(-rows // 64)
    planes = np.zeros((bits, dims, words * 8), np.uint8)
    for p in range(bits):
        planes[p, :, : -(-rows // 8)] = np.packbits(((y >> p) & 1).astype(np.uint8), axis=0).T
    return planes.view(np.uint64)


def add_scatter(planes: np.ndarray, sums: np.ndarray, products: np.ndarray) -> None:
    """Add the block's sums and cross-products: counts of common bits, weighted by their places.

    ``sums[limb, i]`` and ``products[limb, i, j]`` (j >= i) count in units of 2 ** (LIMB * limb).
    """
    bits, dims, _ = planes.shape
    own = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    for p in range(bits):
        sums[p // LIMB] += own[p] << (p % LIMB)
    for i in range(dims):
        for p in range(bits):
            common = np.bitwise_count(planes[p, i] & planes[:, i:]).sum(axis=2, dtype=np.int64)
            for q in range(bits):
                products[(p + q) // LIMB, i, i:] += common[q] << ((p + q) % LIMB)


def scatter(fit: DataFrame, low: np.ndarray, bits: int) -> tuple[list[int], list[list[int]]]:
    """Exact sums of y = x - low per dimension, and of the products of all pairs of dimensions."""
    dims, limbs = len(low), (2 * bits) // LIMB + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros((limbs, dims), np.int64), np.zeros((limbs, dims, dims), np.int64)
        for batch in batches:
            y = _matrix(batch.column(0), dims) - low
            for a in range(0, len(y), BLOCK_ROWS):
                add_scatter(bit_planes(y[a : a + BLOCK_ROWS], bits), sums, products)
        limb, i, j = np.nonzero(products)
        own_limb, own = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([i, own])), pa.array(np.concatenate([j, np.full(len(own), -1)])),
                pa.array(np.concatenate([limb, own_limb])), pa.array(np.concatenate([products[limb, i, j], sums[own_limb, own]])),
            ],
            names=["i", "j", "limb", "total"],
        )

    parts = fit.mapInArrow(run, "i long, j long, limb long, total long").groupBy("i", "j", "limb").agg(F.sum("total").alias("total"))
    sums, products = [0] * dims, [[0] * dims for _ in range(dims)]
    for r in parts.collect():  # at most limbs for each pair of dimensions, however many rows
        part = r["total"] << (LIMB * r["limb"])
        if r["j"] < 0:
            sums[r["i"]] += part
        else:
            products[r["i"]][r["j"]] += part
    return sums, products


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """The covariance, divisor n: centred as integers, and only then made a double."""
    dims = len(sums)
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    return out


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Learn from a table of different integer vectors ``x`` of ``dims`` entries; None if it is empty."""
    n = fit.count() if dims else 0
    if not n:
        return None
    low, high = extents(fit, dims)
    bits = max(1, int((high - low).max()).bit_length())
    sums, products = scatter(fit, low, bits)
    v = covariance(n, sums, products)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * dims * np.finfo(float).eps]
    return Whitening(low, high, n, sums, values[order], vectors[:, order], float(np.trace(v)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, as measured on its rows."""
    dims, k = len(model.low), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = model.whitened(model.centred(_matrix(batch.column(0), dims) - model.low))
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "total"])

    moments = np.zeros((k + 1, k))
    for r in fit.mapInArrow(run, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        moments[r["i"], r["j"]] = r["total"] / model.n
    mean = moments[k]
    return float(np.abs(moments[:k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(centred: np.ndarray) -> pa.Array:
    """Sum over dimensions of squares, exact; null where a long does not hold it."""
    estimate = (centred.astype(np.float64) ** 2).sum(axis=1)
    if centred.dtype != object and estimate.max(initial=0.0) < float(1 << 62):
        return pa.array((centred**2).sum(axis=1))
    out = []
    for row, about in zip(centred, estimate, strict=True):
        whole = sum(int(c) ** 2 for c in row) if about < 1e19 else 1 << 63
        out.append(whole if whole < 1 << 63 else None)
    return pa.array(out, pa.int64())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Project all vectors on the unit principal components of their integer forms, at unit variance.

    Entries become integers; each different integer vector counts once. Its entries above the
    dimension's lowest are packed as bit planes across rows, and the numbers of rows in which two
    planes are both set, weighted by the planes' places, are the exact sums of products. The
    covariance is centred in integers; only its eigenvectors are floating point. A task holds one
    block of rows, and the driver one entry per pair of dimensions.

    Returns a row per vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained and identity_error. Rows with a null or non-finite entry give none. All other
    vectors take part if they have as many entries as most of them (of equally frequent lengths the
    greater); others and empty ones give no rows. Repeated rows and rows without an id are projected
    alike. Components without variance are left out, so one vector or copies of one give no rows.
    ``deviation`` is null where a long does not hold it. Entries beyond 2 ** 53 / 64 count as that.
    An empty table gives no rows; other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(integer_vectors(embeddings), "integer-vectors")
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    rows = rows.where(F.size("x") == dims)
    fit = stored(rows.select("x").distinct(), "different-vectors")
    model = fit_whitening(fit, dims, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, error = len(model.values), identity_error(fit, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                m = len(part)
                centred = model.centred(_matrix(part.column(1), dims) - model.low)
                repeated = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(repeated), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n)), deviations(centred).take(repeated),
                        pa.array(model.whitened(centred).ravel()), pa.array(np.tile(model.values / model.trace, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
