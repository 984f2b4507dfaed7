"""Whitening of embeddings by a matrix-free block Lanczos iteration.

Entries become whole numbers, x = floor(SCALE * c) + SHIFT. The covariance of x is never formed over the rows: a pass over the vectors gives
its product with a block of ``BLOCK`` directions, every task adding up its own rows' (x - mean) ((x - mean) . Q) and one row a dimension being
summed by Spark. Each pass adds a block to an orthonormal basis, orthogonalised twice against all of it (full reorthogonalisation).
A direction that falls into the space already spanned (breakdown) is replaced by a fresh random one, so that no eigenspace is missed.
Ritz pairs come from the products themselves, which stay on the driver with the basis (dimensions by basis, never rows), and the
iteration ends when the true residuals |V y - e y| of the wanted components are within ``TOLERANCE`` of the largest eigenvalue, or when the basis
fills the space, where the Ritz pairs are exact but for rounding. A last pass measures the whitened vectors' covariance.

The total variance comes from the deviations, sum of (n x - S)^2 of each row, exact integers from the sums S of all rows.

Defined cases: a vector that is null, holds a null or non-finite entry, or an entry beyond +-``LARGEST`` is dropped, as is one
whose length isn't the most common one (the shorter of two) or is 0; null ids and repeated rows take part, each row as a row; constant dimensions
have no variance; only components with an eigenvalue above 1e-12 of the largest are given, so fewer rows or dimensions than
components give fewer, and vectors that are all equal give no rows; eigenvalues that tie have no natural order, any basis of their space
is given; an empty table gives an empty result; a deviation beyond 38 digits is null; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import small_batches, staged

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**20  # entries beyond are dropped, so that x fits an int and a task's sums a long
BLOCK = 32  # directions of a pass: reading and decoding a row then costs about as much as multiplying it
TOLERANCE = 1e-14
FLOOR = 1e-12  # smallest eigenvalue, as a share of the largest, that a component needs


@dataclass(frozen=True)
class Fit:
    """What whitening needs: rows and their sums by dimension, components (dimensions by k) with eigenvalues, the trace and the passes it took."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    residual: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def whole_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the vectors that take part, written once."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    scaled = F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("int"))
    made = staged(rows.filter(fine).select(F.col(key), scaled.alias("x")), "whole-vectors")
    common = made.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return made.filter(F.size("x") == common[0].d) if common else made


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def column_sums(x: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch).sum(axis=0, dtype=np.int64)
                n, total = n + batch.num_rows, part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate(([n], total)).astype(np.int64))], ["i", "s"])

    got = {r.i: int(r.s) for r in x.select("x").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = got.pop(-1, 0)
    return n, [got[i] for i in sorted(got)]


def product(x: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over the rows of (x - mean) ((x - mean) . q): one pass; a row for each dimension comes back."""
    shared = x.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = shared.value
        total = np.zeros_like(q)
        for batch in batches:
            if batch.num_rows:
                centred = _matrix(batch) - mean
                total += centred.T @ (centred @ q)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["i", *(f"y{j}" for j in range(q.shape[1]))])

    names = [f"y{j}" for j in range(q.shape[1])]
    parts = x.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros_like(q)
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.i] = [r[c] for c in names]
    shared.unpersist()
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, width: int) -> np.ndarray:
    """``width`` directions, or as many as the space has left, orthonormal and orthogonal to ``basis``: the block's own first, then random ones."""
    d, made = len(basis), []
    width = min(width, d - basis.shape[1])
    at = 0
    while len(made) < width:
        fresh = at >= block.shape[1]
        v = rng.standard_normal(d) if fresh else block[:, at].copy()
        at += 1
        before = np.linalg.norm(v)
        if before == 0:
            continue
        span = np.column_stack([basis, *made]) if made else basis
        for _ in range(2):
            v -= span @ (span.T @ v)
        after = np.linalg.norm(v)
        if after <= 1e-10 * before:  # breakdown: the direction is spanned already
            continue
        v /= after
        v -= span @ (span.T @ v)
        made.append(v / np.linalg.norm(v))
    return np.column_stack(made) if made else np.empty((d, 0))


def block_lanczos(multiply, d: int, k: int, *, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The ``k`` largest eigenpairs of a symmetric operator of ``d`` dimensions, given as ``multiply(directions)``: (values, vectors, passes, residual).

    ``residual`` is the largest |A y - e y| as a share of the largest value.
    """
    rng = np.random.default_rng(seed)
    block, k = min(max(block, k), d), min(k, d)
    basis = image = np.empty((d, 0))
    q = orthonormal(np.empty((d, 0)), basis, rng, block)
    passes = 0
    while True:
        made = multiply(q)
        passes += 1
        basis, image = np.column_stack([basis, q]), np.column_stack([image, made])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        largest = max(abs(values[0]), np.finfo(float).tiny)
        residual = float(np.linalg.norm(image @ turn - vectors * values, axis=0).max() / largest)
        if residual <= tolerance or basis.shape[1] == d:
            return values, vectors, passes, residual
        q = orthonormal(made, basis, rng, block)


def deviation(sums: list[int], n: int) -> F.Column:
    """Sum over the dimensions of (n x - S)^2 as decimal(38,0), exact."""
    wide = "decimal(38,0)"
    from_mean = F.zip_with(F.col("x"), F.array(*[F.lit(s).cast(wide) for s in sums]), lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s).cast("decimal(19,0)"))
    return F.aggregate(from_mean, F.lit(0).cast(wide), lambda total, v: F.try_add(total, F.try_multiply(v, v)).cast(wide))


def fit(x: DataFrame, k: int = 8) -> Fit | None:
    """The ``k`` leading components of the covariance (divisor n) of whole vectors; None without rows."""
    n, sums = column_sums(x)
    if not n:
        return None
    mean = np.array([float(Fraction(s, n)) for s in sums])
    values, vectors, passes, residual = block_lanczos(lambda q: product(x, mean, q) / n, len(sums), k)
    trace = x.agg(F.sum(deviation(sums, n).cast("double") / F.lit(float(n)) / F.lit(float(n)))).head()[0] or 0.0
    fine = values > max(values[0], 0) * FLOOR
    return Fit(n, sums, vectors[:, fine], values[fine], trace / n, passes, residual)


def project(x: DataFrame, fitted: Fit) -> DataFrame:
    """Whole vectors with ``w``, their whitened coordinates: (x - mean) on each component over the root of its eigenvalue."""
    small_batches(x.sparkSession, 8192)
    shared = x.sparkSession.sparkContext.broadcast((fitted.mean, fitted.components / np.sqrt(fitted.eigenvalues)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scaled = shared.value
        for batch in batches:
            w = ((_matrix(batch) - mean) @ scaled).reshape(-1) if batch.num_rows else np.empty(0)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(scaled.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(w))], [*batch.schema.names, "w"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(run, f"{schema}, w array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k + 1, k)), 0
        for batch in batches:
            if batch.num_rows:
                w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
                n += len(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1, dtype=np.int32)), pa.array(np.append(total.reshape(-1), n))], ["i", "s"])

    got = {r.i: r.s for r in projected.select("w").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = got.pop(k * (k + 1))
    total = np.array([got[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())  # the means are 0 but for rounding


def whiten(rows: DataFrame, k: int = 8, *, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector and component: ``key``, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    small_batches(rows.sparkSession, 8192)
    x = whole_vectors(rows, vector, key)
    fitted = fit(x, k)
    shape = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.eigenvalues):
        return x.select(F.col(key), *[F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in shape.split(", ")]).limit(0)
    projected = project(x, fitted)
    error = identity_error(projected, len(fitted.eigenvalues))
    out = projected.select(F.col(key), deviation(fitted.sums, fitted.n).alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(e)) for e in fitted.explained]), F.col("at") + 1)
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
