"""Whitening of embeddings; the leading components of their covariance are found by slicing its spectrum.

Vectors are fitted and scored on Spark: distinct vectors by a shuffle, their sums and centred products block by block in
tasks. What reaches the driver is one matrix of dimension x dimension, whatever the number of rows. Its eigenvalues
are isolated by inertia: the factors LDL' of V - s*I have as many positive pivots as V has eigenvalues above s, so halving
intervals by such counts leaves one eigenvalue in each. Rayleigh quotient iteration then converges cubically to it, and two
counts beside the value certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 4
SCALE = 256
MOST_DIMENSIONS = 4096  # a matrix of 134 MB
BLOCK = 4096
_BUNCH = (1 + 17**0.5) / 8


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` lie above ``shift``: positive pivots of LDL' with blocks of one or two (Bunch and Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0
    tiny = np.finfo(float).tiny / np.finfo(float).eps

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        size = 1
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = int(column.argmax())
            most, r = column[r], k + 1 + r
            if abs(a[k, k]) < _BUNCH * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other >= _BUNCH * most * most:
                    pass
                elif abs(a[r, r]) >= _BUNCH * other:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            pivot = a[k, k] if abs(a[k, k]) > tiny else -tiny
            above += pivot > 0
            below = a[k + 1 :, k] / pivot
            a[k + 1 :, k + 1 :] -= np.outer(below, a[k, k + 1 :])
        else:
            above += 1  # a block of two has one pivot of either sign
            below = np.linalg.solve(a[k : k + 2, k : k + 2], a[k : k + 2, k + 2 :])
            a[k + 2 :, k + 2 :] -= a[k + 2 :, k : k + 2] @ below
        k += size
    return above


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the symmetric ``matrix``, falling, and their unit vectors in rows.

    Equal eigenvalues, or such as differ by rounding only, get orthogonal vectors of their common space. A value that
    the counts beside it do not certify raises.
    """
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    close = 64 * max(n, 1) * np.finfo(float).eps * norm
    known: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = inertia_above(matrix, shift)
        return known[shift]

    values, vectors = [], np.zeros((0, n))
    for k in range(1, min(count, n) + 1):
        if norm == 0:
            values.append(0.0)
            vectors = np.vstack([vectors, np.eye(n)[k - 1]])
            continue
        low, high = -norm - close, norm + close  # above(low) >= k > above(high)
        for shift in known:
            if known[shift] >= k:
                low = max(low, shift)
            else:
                high = min(high, shift)
        found = None
        while found is None and high - low > close:
            if known.get(low, n) == k and known.get(high, 0) == k - 1:
                found = _rayleigh(matrix, vectors, low, high, close)
            middle = (low + high) / 2
            if above(middle) >= k:
                low = middle
            else:
                high = middle
        found = found or _rayleigh(matrix, vectors, low - 4 * close, high + 4 * close, close)
        if found is None:
            raise ArithmeticError(f"eigenvalue {k} did not converge")
        value, vector = found
        if above(value - 8 * close) < k or above(value + 8 * close) >= k:
            raise ArithmeticError(f"the counts do not certify eigenvalue {k}")
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


def _rayleigh(matrix: np.ndarray, found: np.ndarray, low: float, high: float, close: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval, orthogonal to the vectors ``found``; None if it leaves the interval.

    The eigenvalues of ``found`` are moved far below the others first, so that equal ones don't drown the vector that is sought.
    """
    n = len(matrix)
    if len(found):
        matrix = matrix - (found.T * (np.einsum("ij,jk,ik->i", found, matrix, found) + np.abs(matrix).sum(axis=1).max())) @ found
    x = np.random.default_rng(n).standard_normal(n)
    shift, value = (low + high) / 2, None
    for step in range(40):
        try:
            x = np.linalg.solve(matrix - shift * np.eye(n), x)
        except np.linalg.LinAlgError:  # the shift is the eigenvalue to the last bit
            x = np.linalg.solve(matrix - (shift + close / 64) * np.eye(n), x)
        x /= np.abs(x).max()
        for _ in range(2):
            x -= found.T @ (found @ x)
        length = np.linalg.norm(x)
        if not np.isfinite(length) or length == 0:
            return None
        x /= length
        image = matrix @ x
        value = float(x @ image)
        if np.linalg.norm(image - value * x) <= close:
            return (value, x) if low + close < value < high - close else None
        if step >= 2:  # two steps of inverse iteration first: they turn to the eigenvalue next to the middle
            if not low <= value <= high:
                return None
            shift = value
    return None


@dataclass(frozen=True)
class Whitening:
    """What the rows need: the number of distinct vectors, their exact sums, unit vectors in rows and eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance; the others are rounding."""
        return self.values > 1e-12 * max(self.trace, 0.0) if self.n else np.zeros(0, bool)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` on the components over their deviations; NaN where a component has no variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.sqrt(np.where(self.usable, self.values, np.nan))
        return ((x - mean) @ self.vectors.T) / scale


def integers(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows whose vector is neither null nor holds null or non-finite entries; x is floor(scale * entry) as longs."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    return docs.select(F.col(id_col).alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))).select("id", whole.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of longs, shorter vectors filled up by zeros."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            column = part.column(at)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths == dimension).all():
                yield part, flat.reshape(-1, dimension)
            else:
                x = np.zeros((part.num_rows, dimension), np.int64)
                row = np.repeat(np.arange(part.num_rows), lengths)
                x[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
                yield part, x


def _summed(df: DataFrame, fn, rows: int, columns: int) -> np.ndarray:
    """The sum over tasks of ``fn``'s matrices of rows x columns: a row of the matrix is added up by Spark, so no task holds all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fn(batches)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    out = np.zeros((rows, columns))
    for r in df.mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        out[r.i, r.j] = r.s
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of the vectors ``x`` of ``distinct``, a written table of distinct vectors; two passes: sums, then centred products.

    The dimension is that of the longest vector, at most MOST_DIMENSIONS. Without vectors, or with empty ones only, there are no components.
    """
    dimension = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if dimension > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimension} entries; a covariance has room for {MOST_DIMENSIONS}")
    if not dimension:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n = distinct.count()
    per_entry = distinct.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    totals = {r.d: int(r.s) for r in per_entry.toLocalIterator()}
    sums = [totals.get(d, 0) for d in range(dimension)]
    mean = np.array([s / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _matrices(batches, dimension):
            centred = x - mean
            total = centred.T @ centred if total is None else total + centred.T @ centred
        return total

    covariance = _summed(distinct.select("x"), products, dimension, dimension) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_components(covariance, components)
    return Whitening(n, sums, vectors, values, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, fitted: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the components with a variance; None without any."""
    usable, dimension = fitted.usable, len(fitted.sums)
    k = int(usable.sum())
    if not k:
        return None

    def means(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _matrices(batches, dimension):
            part = fitted.whitened(x)[:, usable].sum(axis=0, keepdims=True)
            total = part if total is None else total + part
        return total

    mean = _summed(distinct.select("x"), means, 1, k)[0] / fitted.n

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _matrices(batches, dimension):
            w = fitted.whitened(x)[:, usable] - mean
            total = w.T @ w if total is None else total + w.T @ w
        return total

    return float(np.abs(_summed(distinct.select("x"), products, k, k) / fitted.n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n*x - S)^2; None where a long cannot hold one."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(s) for s in sums), default=0)
    if most < 2**63 and most * most * max(len(sums), 1) < 2**63:
        y = x * np.int64(n) - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [f if f < 2**63 else None for f in found]


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable row of ``docs`` and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries go; empty vectors stay and count as zeros, as do the missing entries
    of shorter vectors. Rows that repeat an id or a vector all stay, and the fit takes each vector once. Components are
    min(``components``, dimension); one without variance (below 1e-12 of the trace) has null for whitened and is left out of
    identity_error. explained is null if there is no variance at all; deviation is null where a long cannot hold it.
    Tables without usable rows give empty tables. Further columns are ignored; ids may have any type and be null.
    """
    vectors = integers(docs, id_col, vector_col, scale)
    distinct, _ = common.written(vectors.select("x").distinct(), "vectors")
    fitted = fit(distinct, components)
    error, dimension, k = identity_error(distinct, fitted), len(fitted.sums), len(fitted.values)
    explained = [float(v / fitted.trace) if fitted.trace > 0 else None for v in fitted.values]
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, dimension, 1) if k else ():
            m = len(x)
            w = fitted.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n, np.int64)),
                    pa.array([d for d in _deviations(x, fitted.n, fitted.sums) for _ in range(k)], pa.int64()),
                    pa.array(w, pa.float64(), mask=np.isnan(w)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
