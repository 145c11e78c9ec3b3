"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X are orthogonalised by passes that each sum up one Gram matrix: the first adds a
shift to its diagonal, so that the Cholesky factor exists for any condition number; every pass
solves triangular systems for the rows of the next. The product of all factors is the R of X, and
the singular values and vectors of R are the deviations and directions of the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.vectors import added_up, finite, matrix_of

#: Integer vectors: floor of SCALE times a component, plus SHIFT; at most MOST in size before it.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 40
#: A pass ends the sequence if its Gram matrix is the identity up to this.
ORTHOGONAL = 1e-12
MOST_PASSES = 6
_LOW = np.int64((1 << 28) - 1)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as int64; components beyond MOST count as that."""
    return np.clip(np.floor(vectors * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Whitening:
    """Number, sums and components of the vectors of the fit list."""

    n: int
    sums: tuple[int, ...]
    factors: tuple[np.ndarray, ...]  # triangular, one a pass; the last one first
    components: np.ndarray           # [dims, found], unit columns, the largest deviation first
    variances: np.ndarray            # [found], falling
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n with one rounding where the difference is an int64."""
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def apart(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: int64, or Python's integers where those would not hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < 1 << 55:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return apart(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sums of squares of n * x - sums.

    In int64 each difference is cut at 28 bits, so that no sum of products of the parts overflows.
    """
    d = apart(x, n, sums)
    if d.dtype == object:
        return [int(v) for v in (d * d).sum(axis=1)] if d.size else [0] * len(d)
    d = np.abs(d)
    high, low = d >> np.int64(28), d & _LOW
    parts = [(a * b).reshape(len(d), -1) for a, b in ((high, high), (high, low), (low, low))]
    step = 64  # products are below 2^56: as many fit into an int64
    out = [0] * len(d)
    for first in range(0, d.shape[1], step):
        hh, hl, ll = (p[:, first:first + step].sum(axis=1).tolist() for p in parts)
        out = [o + (a << 56) + (b << 29) + c for o, a, b, c in zip(out, hh, hl, ll)]
    return out


def fit_rows(vectors: DataFrame) -> tuple[DataFrame, int | None]:
    """vec_id and embedding of the rows that take part, and the length of their vectors."""
    rows = vectors.select("vec_id", "embedding").filter(
        F.col("embedding").isNotNull() & finite("embedding"))
    length = rows.groupBy(F.size("embedding").alias("dims")).count().filter("dims > 0").orderBy(
        F.desc("count"), F.desc("dims")).first()
    if length is None:
        return rows.limit(0), None
    return rows.filter(F.size("embedding") == length.dims), length.dims


def _triangle(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """The upper triangle R with R'R the Gram matrix, plus a shift if asked for or needed."""
    dims, unit = len(gram), np.finfo(float).eps / 2
    norm = float(np.linalg.norm(gram, 2)) if gram.size else 0.0
    shift = 11 * (rows * dims + dims * (dims + 1)) * unit * norm
    for add in ([0.0] if not shifted else []) + [shift * 10.0 ** k for k in range(12)]:
        try:
            return np.linalg.cholesky(gram + max(add, 0.0) * np.eye(dims)).T
        except np.linalg.LinAlgError:
            continue
    return np.eye(dims)  # all rows are equal


def _root(gram: np.ndarray) -> np.ndarray:
    """W with W'W the Gram matrix, where that is singular."""
    values, vectors = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def solved(rows: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows q with q R_k ... R_1 = row, by substitution through one triangle after the other.

    `factors` are R_k to R_1; R_1, of the first pass, is solved first.
    """
    for factor in reversed(factors):
        out = np.empty_like(rows, order="F")
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
        rows = out
    return rows


def fit(rows: DataFrame, dims: int, components: int = 32) -> Whitening | None:
    """Components of the vectors of :func:`fit_rows`; None where there are none.

    One pass for number and sums (exact), then passes for Gram matrices until the rows are
    orthonormal up to rounding. A task keeps one matrix of dims by dims. Directions in which the
    vectors do not differ (constant or dependent dimensions, fewer vectors than dimensions) have
    no deviation to divide by; they are no components, so there may be fewer than asked for.
    """

    def summed(batch: pa.RecordBatch) -> np.ndarray:
        x = integers(matrix_of(batch))
        return np.concatenate(
            [[len(x)], (x >> np.int64(31)).sum(axis=0), (x & np.int64(0x7FFFFFFF)).sum(axis=0)])

    rows = rows.select("embedding")
    total = added_up(rows, summed, np.int64)
    if total is None:
        return None
    n = int(total[0])
    sums = tuple((int(h) << 31) + int(low) for h, low in zip(total[1:dims + 1], total[dims + 1:]))
    factors: tuple[np.ndarray, ...] = ()
    for number in range(MOST_PASSES):
        def gram_of(batch: pa.RecordBatch, before=factors) -> np.ndarray:
            q = solved(centred(integers(matrix_of(batch)), n, sums), before)
            return (q.T @ q).ravel()

        gram = added_up(rows, gram_of, np.float64).reshape(dims, dims)
        if number == 0 and not gram.any():
            return Whitening(n, sums, (), np.zeros((dims, 0)), np.zeros(0), 0.0)
        last = number == MOST_PASSES - 1
        if number >= 2 and np.abs(gram - np.eye(dims)).max() < ORTHOGONAL * dims:
            factors = (_triangle(gram, n, False), *factors)
            break
        singular = np.linalg.eigvalsh(gram)[0] < 0.5 if number >= 2 else False
        if singular or last:
            factors = (_root(gram), *factors)
            break
        factors = (_triangle(gram, n, number == 0), *factors)
    whole = factors[-1]
    for factor in reversed(factors[:-1]):
        whole = factor @ whole
    _, deviation, directions = np.linalg.svd(whole)
    variances = deviation ** 2 / n
    found = deviation > 64 * dims * np.finfo(float).eps * deviation[0]
    kept = min(int(found.sum()), components)
    return Whitening(n, sums, factors, directions[:kept].T, variances[:kept],
                     float(variances.sum()))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity."""
    kept = len(model.variances)
    if not kept:
        return 0.0

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.whitened(integers(matrix_of(batch)))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = added_up(rows.select("embedding"), moments, np.float64) / model.n
    mean, second = total[:kept], total[kept:].reshape(kept, kept)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(kept)).max())


def whitened(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Whitened coordinates of every vector: vec_id, n, deviation, whitened, explained, error.

    `vectors` has vec_id and embedding; further columns are ignored. Rows whose vector is null,
    empty, or holds null or non-finite entries take no part, nor do those of another length than
    most have (ties: the longer one). Repeated rows and null ids are rows like others, in the fit
    and in the result. `whitened` (array of doubles) has an entry for each component that was
    found, up to `components`; `explained` (array) their shares of the whole variance;
    `deviation` (decimal(38,0)) is the exact sum of (n * x - sums)^2, null beyond 38 digits.
    No vectors give no rows; vectors that are all equal give rows with empty arrays. Components
    depend on the order of summation in their last bits, but are the same for all rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, "
              "explained array<double>, identity_error double")
    rows, dims = fit_rows(vectors)
    model = fit(rows, dims, components) if dims else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    share = (model.variances / model.trace).tolist() if len(model.variances) else []
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        own = sent.value
        for batch in batches:
            x = integers(matrix_of(batch))
            size, kept = len(x), len(own.variances)
            w = own.whitened(x) if size else np.zeros((0, kept))
            sizes = np.arange(size + 1, dtype=np.int32) * kept
            exact = deviations(x, own.n, own.sums) if size else []
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(np.full(size, own.n, np.int64)),
                pa.array([Decimal(d) if d < 10 ** 38 else None for d in exact],
                         pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(sizes), pa.array(w.ravel())),
                pa.array([share] * size, pa.list_(pa.float64())),
                pa.array(np.full(size, error))],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
