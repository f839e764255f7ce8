"""Whitening of integer-quantised embeddings by Chan's merging of moments.

Each partition gives the count, mean and centred scatter of its vectors; two of them
merge into those of their union, in a tree of tasks.  The driver decomposes the one
matrix that is left, of the vectors' width.  A second pass merges the moments of the
whitened vectors, which shows how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: An eigenvalue below this share of the largest, for each dimension, is rounding.
NOISE = np.finfo(float).eps
_LONG = float(2**63)


class Moments(NamedTuple):
    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Of both sets together."""
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(0)
    centred = x - mean
    # what rounding of the mean left
    rest = centred.mean(0)
    return Moments(len(x), mean + rest, centred.T @ centred - len(x) * np.outer(rest, rest))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, width)


def _gather(width: int, change: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = moments(change(_rows(batch.column(0), width)))
                total = total.merged(part) if total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([total.mean]), pa.array([total.scatter.ravel()])], ["n", "mean", "scatter"])

    return gather


def merged_moments(vectors: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments | None:
    """Moments of all rows of the one column, an array of ``width`` numbers, after ``change``; None of an empty table."""
    parts = vectors.mapInArrow(_gather(width, change or (lambda x: x.astype(float))), "n long, mean array<double>, scatter array<double>")
    one = parts.rdd.map(lambda r: [Moments(r.n, np.array(r.mean), np.array(r.scatter).reshape(len(r.mean), -1))])
    # an empty list is the zero of the tree, for tables without rows
    total = one.treeAggregate([], _joined, _joined, depth=3)
    return total[0] if total else None


def _joined(a: list[Moments], b: list[Moments]) -> list[Moments]:
    return [a[0].merged(b[0])] if a and b else a or b


class Whitener(NamedTuple):
    """x is whitened as (x - total / n) @ axes."""

    n: int
    total: list[int]
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - total / n: the quotient as a whole number and a rest, so that large numbers lose nothing."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([s % self.n / self.n for s in self.total])
        return (x - whole).astype(float) - rest

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - total) ** 2 over dimensions; None beyond 64 bits."""
        rough = (self.centred(x) ** 2).sum(1) * float(self.n) ** 2
        if rough.size and rough.max() < _LONG / 4 and self.n * float(np.abs(x).max()) < _LONG / 4:
            apart = self.n * x - np.array(self.total, np.int64)
            return (apart * apart).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in exact]


def fitted(found: Moments, total: list[int], components: int) -> Whitener:
    """Unit eigenvectors by falling eigenvalue, at most ``components``; those of eigenvalue zero are left out."""
    covariance = found.scatter / found.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = min(components, int((values > max(values[0], 0) * NOISE * len(values)).sum()))
    return Whitener(found.n, total, vectors[:, :real] / np.sqrt(values[:real]), values[:real] / np.trace(covariance) if real else values[:0])


def _whiten(shared, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = model.axes.shape[1]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _rows(batch.column(1), len(model.total))
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n))]
            columns += [pa.array(model.deviation(x), pa.int64()).take(each), pa.array(model(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["__row", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whiten


def quantised(embedding: Column) -> Column:
    """floor(64 c) + 1000000 of each entry as long; null where the vector is null, empty, or holds null or non-finite entries."""
    values = embedding.cast("array<double>")
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(values) > 0) & ~bad, F.transform(values, lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")))


def whitened(vectors: DataFrame, keep: list[str], embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns ``keep`` with component, n, deviation, whitened, explained and identity_error: a row for each row and component.

    The model is fitted on each distinct quantised vector once.  Rows without a whole
    vector go; so do rows of another width than the most frequent one among distinct
    vectors (of equally frequent ones the smaller).  Components of eigenvalue zero
    have no rows: fewer than ``components`` where the distinct vectors span less, none
    if there is one vector only.  Repeated rows each have their rows.  ``deviation`` is null
    where 64 bits cannot hold it.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.struct(*keep).alias("__row"), quantised(F.col(embedding)).alias("x")).where("x IS NOT NULL")
    distinct = stored(rows.select("x").distinct(), "vectors")
    widths = distinct.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = f"__row {rows.schema['__row'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    columns = [F.col("__row")[c].alias(c) for c in keep] + ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if widths is None:
        return spark.createDataFrame([], schema).select(columns)
    width = widths.w
    own = F.size("x") == width
    fit = distinct.where(own)
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    total = [int(s) for _, s in sorted(map(tuple, sums))]
    model = fitted(merged_moments(fit, width), total, components)
    shared = spark.sparkContext.broadcast(model)
    k = model.axes.shape[1]
    error = 0.0
    if k:
        again = merged_moments(fit, width, lambda x: shared.value(x))
        error = float(np.abs(again.scatter / again.n - np.eye(k)).max())
    return rows.where(own).mapInArrow(_whiten(shared, error), schema).select(columns)
