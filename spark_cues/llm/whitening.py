"""Embedding whitening: principal components of an exact covariance by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, ship_package

COMPONENTS, SCALE = 4, 256
#: Quadrature nodes on the upper half of a contour; rounds of projection at most.
NODES, MAX_ROUNDS = 8, 60
#: Eigenvalues beyond the wanted ones that an interval may take in to end in a wide gap.
SPARE = 8
#: Rows whose products are added together in a task.
BLOCK = 4096
_EXACT = float(1 << 53)


# --- eigenpairs of a symmetric matrix ----------------------------------------------------------------------------------


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally congruent tridiagonal matrix (reflections)."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        if not v.any():
            continue
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Counts of eigenvalues above any shift, by Sylvester's law: the positive pivots of the shifted matrix."""

    def __init__(self, a: np.ndarray):
        self.size, self.scale = len(a), float(np.abs(a).sum(axis=1).max())
        self.main, self.off = _tridiagonal(a)

    def above(self, shift: float) -> int:
        least = max(self.scale, 1e-300) * np.finfo(float).eps ** 2
        count, pivot = 0, 1.0
        for k in range(self.size):
            pivot = self.main[k] - shift - (self.off[k - 1] ** 2 / pivot if k else 0.0)
            pivot = -least if abs(pivot) < least else pivot
            count += pivot > 0
        return count

    def between(self, place: int, width: float) -> tuple[float, float]:
        """Bounds, at most ``width`` apart, of the ``place``-th largest eigenvalue (from 1)."""
        low, high = -self.scale, self.scale
        low, high = low - width, high + width
        while high - low > width:
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= place else (low, middle)
        return low, high


def contour_nodes(low: float, high: float, count: int = NODES) -> list[tuple[complex, complex]]:
    """Gauss-Legendre nodes and weights of the half circle over ``[low, high]``; the lower half is its conjugate."""
    places, weights = np.polynomial.legendre.leggauss(count)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi * (1 + places) / 2)
    return [(centre + radius * t, w * radius * t / 2) for t, w in zip(turn, weights, strict=True)]


def eigenpairs_within(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of a symmetric matrix in ``(low, high)``, falling, and unit eigenvectors.

    Each round solves complex shifted systems along the contour, which projects a block of vectors onto the interval's
    eigenspace, and takes Rayleigh-Ritz pairs of the result, until residuals no longer shrink.
    """
    size, scale = len(a), max(float(np.abs(a).max()), 1e-300)
    width = min(size, max(count + 2, 2 * count))
    basis = np.random.default_rng(seed).normal(size=(size, width))
    shifted = [(np.linalg.inv(z * np.eye(size) - a) if size <= 512 else None, z, w) for z, w in contour_nodes(low, high)]
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    stalled = 0
    for _ in range(MAX_ROUNDS):
        whole = np.zeros((size, width))
        for inverse, z, w in shifted:
            solved = inverse @ basis if inverse is not None else np.linalg.solve(z * np.eye(size) - a, basis)
            whole += (w * solved).real
        basis = np.linalg.qr(whole)[0]
        values, inner = np.linalg.eigh(basis.T @ a @ basis)
        basis = basis @ inner
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        values, vectors = values[inside], basis[:, inside]
        if len(inside) != count:
            continue
        off = float(np.linalg.norm(a @ vectors - vectors * values, axis=0).max()) if count else 0.0
        stalled = 0 if best is None or off < 0.5 * best[0] else stalled + 1
        if best is None or off < best[0]:
            best = off, values, vectors
        if off <= 4 * np.finfo(float).eps * scale * size or (stalled >= 3 and off <= 1e-9 * scale * size):
            break
    if best is None or best[0] > 1e-9 * scale * size:
        raise ArithmeticError(f"no {count} eigenpairs between {low} and {high}")
    return best[1], best[2]


def top_eigenpairs(a: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest positive eigenvalues, falling, with unit eigenvectors; fewer where the rank is less.

    The interval's lower end lies in the widest relative gap below the wanted eigenvalues, found by inertia counts; the
    number of pairs found must equal the count of the interval, so none is missed.
    """
    if not len(a) or not np.abs(a).max() > 0:
        return np.empty(0), np.empty((len(a), 0))
    counts = Inertia(a)
    top = counts.between(1, counts.scale * 1e-12)[1]
    floor = top * len(a) * 4 * np.finfo(float).eps  # below this, an eigenvalue can't be told from zero
    rank = counts.above(floor)
    want = min(count, rank)
    places = range(want, min(rank, want + SPARE) + 1)
    bounds = {k: counts.between(k, counts.scale * 1e-12) if k <= len(a) else (-top, -top) for k in range(want, places[-1] + 2)}
    gap = {k: bounds[k][0] - max(bounds[k + 1][1], 0.0) for k in places}
    chosen = max(places, key=lambda k: gap[k] / k)
    low = (bounds[chosen][0] + max(bounds[chosen + 1][1], -floor if chosen == rank else 0.0)) / 2
    high = top + 0.05 * (top - low)
    inside = counts.above(low) - counts.above(high)
    values, vectors = eigenpairs_within(a, low, high, inside)
    return values[:want], vectors[:, :want]


# --- exact sums --------------------------------------------------------------------------------------------------------


def _as_rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(batches: Iterator[np.ndarray], products: bool) -> tuple[int, list[int]]:
    """Number of rows and exact sums of the columns, or of the products of columns, of integer rows."""
    n, total = 0, None
    for rows in batches:
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            n += len(part)
            large = float(np.abs(part).max(initial=0))
            if products:
                fits = large * large * len(part) < _EXACT  # then doubles hold every partial sum exactly
                kind = part.astype(np.float64 if fits else object)
                found = (kind.T @ kind)[np.triu_indices(part.shape[1])]
            else:
                found = part.sum(axis=0) if large * len(part) < 2**62 else part.astype(object).sum(axis=0)
            found = [int(v) for v in found]
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
    return n, total or []


_SUM = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 0))])


def exact_sums(rows: DataFrame, centre: list[int] | None = None) -> tuple[int, list[int]]:
    """Rows of ``x`` (``array<long>``) and the exact sum of each dimension; with a ``centre``, of each product of two centred dimensions.

    Tasks add what they read; one row a cell and task is shuffled, and as many rows as there are cells come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array(centre or 0, dtype=np.int64)
        n, total = _added((_as_rows(b.column(0)) - shift for b in batches if b.num_rows), centre is not None)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["cell", "n", "total"])

    found = rows.select("x").mapInArrow(run, _SUM).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cell").collect()
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


# --- whitening ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitener:
    """Fitted on distinct integer vectors: their number and sums, eigenvalues falling, unit eigenvectors as columns, the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred rows projected on each component, over the root of its eigenvalue."""
        centre = [s // self.n for s in self.sums]  # whole numbers are taken off exactly, the rest in doubles
        rest = np.array([(s - c * self.n) / self.n for s, c in zip(self.sums, centre, strict=True)])
        return ((x - np.array(centre, dtype=np.int64)) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of ``(n x - S)^2`` of each row."""
        large = max(1, int(np.abs(x).max(initial=0))) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if x.shape[1] * large * large < 2**63 else object
        off = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        return [int(v) for v in (off * off).sum(axis=1)]


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """``(n, sums, V)`` of a table of ``x``: the covariance, divisor n, of integer vectors, each entry rounded once.

    Rows are centred at the mean's whole part before they are multiplied; the products' sums are exact, and the rest of
    the mean is taken off in exact fractions.
    """
    n, sums = exact_sums(fit)
    if not n:
        return 0, [], np.empty((0, 0))
    centre = [s // n for s in sums]
    _, products = exact_sums(fit, centre)
    left = [s - c * n for s, c in zip(sums, centre, strict=True)]
    out = np.empty((len(sums),) * 2)
    for value, i, j in zip(products, *np.triu_indices(len(sums)), strict=True):
        out[i, j] = out[j, i] = float(Fraction(value * n - left[i] * left[j], n * n))
    return n, sums, out


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on a table of ``x``; None where no dimension varies.  The driver holds one square of the dimensions."""
    n, sums, v = covariance(fit)
    values, vectors = top_eigenpairs(v, components)
    return Whitener(n, tuple(sums), values, vectors, float(np.trace(v))) if len(values) else None


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity, measured over all of them."""
    m = len(whitener.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(m), np.zeros((m, m))
        for b in batches:
            if b.num_rows:
                w = whitener.whiten(_as_rows(b.column(0)))
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(m * m + m), pa.int32()), pa.array(np.concatenate([sums, products.ravel()]))], names=["cell", "v"])

    total = [r["v"] for r in fit.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()]
    mean = np.array(total[:m]) / whitener.n
    return float(np.abs(np.array(total[m:]).reshape(m, m) / whitener.n - np.outer(mean, mean) - np.eye(m)).max())


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, keep: tuple[Column, ...] = ()) -> DataFrame:
    """``(vec_id, *keep, x)`` of rows whose vector is finite throughout, as whole numbers ``floor(scale * c)``.

    Left out: null and empty vectors, and those with null, NaN or infinite entries.  Entries must stay below 2^53 in size.
    """
    c = F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    kept = vectors.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, finite))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), *keep, F.transform(c, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _of_one_length(rows: DataFrame) -> DataFrame:
    """Vectors of the most frequent length, the longer one in a tie."""
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (lengths["n"] if lengths else 0))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable row and component.

    The whitener is fitted on each distinct integer vector once, so copies don't weigh; all rows are whitened by it,
    repeated ids and null ids included.  Vectors that aren't finite, are empty, or have another length than most take no
    part.  There are as many components as the covariance has rank, ``components`` at most: none, and so no rows, for an
    empty table or one distinct vector.  Eigenvectors have either sign, the same for all rows.  Other columns are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    rows = _of_one_length(quantized(vectors, id_col, vector_col))
    # Read three times: sums, products, the check.  Copies meet in tasks before they are shuffled.
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    found = fit_whitener(fit, components)
    if found is None:
        return spark.createDataFrame([], schema)
    error, m = identity_error(fit, found), len(found.values)
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, count = _as_rows(b.column(1)), b.num_rows
            ids = b.column(0).take(pa.array(np.repeat(np.arange(count), m)))
            deviation = [v for v in found.deviations(x) for _ in range(m)]
            columns = [ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, found.n)), pa.array(deviation, pa.decimal128(38, 0)), pa.array(found.whiten(x).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
