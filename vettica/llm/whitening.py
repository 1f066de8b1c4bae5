"""Embedding whitening by shifted Cholesky QR.

The centred rows A are never gathered.  A pass over the rows adds up the Gram matrix
of what the triangular factors found so far make of them; its Cholesky factor is the
next one.  The first pass shifts the diagonal, which makes the factorisation succeed
for any conditioning (Fukaya and others, 2020); the passes after it bring the rows to
orthogonality.  With R the product of the factors, A = QR, and the singular vectors
and values of the small R are the components and their deviations.

Rows are centred before they are multiplied: whole numbers exactly, by the integer
mean and then its rest.  What reaches the driver is the sums (one per dimension) and
at most ``PARTS`` partial Gram matrices; what is broadcast is a few matrices of the
vectors' own dimension, which does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettica.llm.common import bound_batches

#: Partial matrices that reach the driver.
PARTS = 64
#: Gram passes: one shifted, then two that orthogonalise.
PASSES = 3
#: Deviations below this share of the largest count as none.
RANK_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Whitening:
    """``components`` has one unit column for each eigenvalue, largest first."""

    count: int
    sums: list[int | float]
    total: float
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e / self.total) for e in self.eigenvalues]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _centre(self.count, self.sums)


def usable(column: str) -> Column:
    """Whether a vector is there and all its entries are finite; an empty one is not."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(column, entry) & (F.size(column) > 0), F.lit(False))


def _rows(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    return vectors.where(usable(column) & (F.size(column) == dimension))


def _centre(count: int, sums: list[int | float]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a part that is subtracted first, exactly, and the rest of it."""
    if all(isinstance(s, int) for s in sums):
        return np.array([s // count for s in sums], np.int64), np.array([s % count / count for s in sums])
    return np.zeros(len(sums)), np.array(sums) / count


def _centred(column: pa.Array, dimension: int, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return (rows - centre[0]).astype(np.float64) - centre[1]


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """X with X @ factor = rows, for an upper triangular factor, a column at a time."""
    solved = np.empty_like(rows)
    for j in range(rows.shape[1]):
        solved[:, j] = (rows[:, j] - solved[:, :j] @ factor[:j, j]) / factor[j, j]
    return solved


def _gram(vectors: DataFrame, column: str, centre: tuple[np.ndarray, np.ndarray], factors: list[np.ndarray], projection: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves, or of their
    projection with a column of ones added."""
    dimension = len(centre[1])
    size = dimension if projection is None else projection.shape[1] + 1

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in source:
            rows = _centred(batch.column(0), dimension, centre)
            for factor in factors:
                rows = _solved(rows, factor)
            if projection is not None:
                rows = np.c_[rows @ projection, np.ones(len(rows))]
            total += rows.T @ rows
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "gram": pa.array([total.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("part")
        total = sum(np.frombuffer(g.as_buffer()) for g in ordered.column("gram"))
        return pa.table({"gram": pa.array([total.tobytes()], pa.binary())})

    partial = vectors.select(column).mapInArrow(run, "part int, gram binary")
    summed = partial.groupBy(F.col("part") % PARTS).applyInArrow(add, "gram binary").collect()
    return sum((np.frombuffer(g) for g in sorted(bytes(r.gram) for r in summed)), np.zeros(size * size)).reshape(size, size)


def _factor(gram: np.ndarray, count: int, shifted: bool, last: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram, its diagonal shifted where asked or needed.

    The last factor must be exact: for a Gram matrix that is singular, since the rows
    do not fill the space, it is the symmetric root instead."""
    dimension = len(gram)
    values, vectors = np.linalg.eigh(gram)
    singular = values[0] <= 1e-8 * values[-1]
    if last and singular:
        return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    if shifted or singular:
        unit = np.finfo(float).eps / 2
        gram = gram + np.eye(dimension) * 11 * (count * dimension + dimension * (dimension + 1)) * unit * values[-1]
    return np.linalg.cholesky(gram).T


def fit(vectors: DataFrame, column: str, components: int = 32) -> Whitening | None:
    """The leading components of the covariance (divisor n) of all usable vectors.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and
    so are those whose length is not the most frequent one (ties: the longer).
    Repeated rows count each.  Directions without deviation are no components, so
    there can be fewer than asked for; without any, or without rows, the result is
    None.  Other columns are not read."""
    bound_batches(vectors)
    kept = vectors.select(column).where(usable(column))
    lengths = kept.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head()
    if lengths is None:
        return None
    dimension = lengths["length"]
    kept = _rows(kept, column, dimension)
    places = kept.select(F.posexplode(column).alias("place", "entry")).groupBy("place").agg(F.sum("entry").alias("sum"), F.count("entry").alias("count"))
    by_place = {r["place"]: r for r in places.collect()}
    count, sums = by_place[0]["count"], [by_place[i]["sum"] for i in range(dimension)]
    centre = _centre(count, sums)

    factors: list[np.ndarray] = []
    product = np.eye(dimension)
    for step in range(PASSES):
        gram = _gram(kept, column, centre, factors)
        if not gram.any():
            return None
        factor = _factor(gram, count, shifted=step == 0, last=step == PASSES - 1)
        factors.append(factor)
        product = factor @ product
    _, deviations, axes = np.linalg.svd(product / np.sqrt(count))
    rank = int((deviations > RANK_TOLERANCE * deviations[0]).sum())
    leading = min(components, rank)
    return Whitening(count, sums, float((deviations**2).sum()), deviations[:leading] ** 2, axes[:leading].T.copy())


def whiten(vectors: DataFrame, column: str, model: Whitening, into: str = "whitened") -> DataFrame:
    """The vectors' rows with ``into``: one entry per component, array of doubles.

    Rows whose vector the fit leaves out go; a column named ``into`` is replaced."""
    bound_batches(vectors)
    centre, dimension = model.centre(), len(model.sums)
    projection = model.components / np.sqrt(model.eigenvalues)
    kept = _rows(vectors.drop(into) if into != column else vectors, column, dimension)
    schema = T.StructType([f for f in kept.schema if f.name != into] + [T.StructField(into, T.ArrayType(T.DoubleType()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = _centred(batch.column(batch.schema.get_field_index(column)), dimension, centre) @ projection
            ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
            arrays = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != into}
            arrays[into] = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return kept.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    bound_batches(vectors)
    projection = model.components / np.sqrt(model.eigenvalues)
    kept = _rows(vectors.select(column), column, len(model.sums))
    gram = _gram(kept, column, model.centre(), [], projection) / model.count
    means = gram[-1, :-1]
    covariance = gram[:-1, :-1] - np.outer(means, means)
    return float(np.abs(covariance - np.eye(len(covariance))).max())
