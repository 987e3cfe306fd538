"""Whitening of embeddings on eigenvectors refined in mixed precision.

The covariance is gathered on Spark in two passes: exact integer sums first, then products of the centred vectors,
each task handing on one ``d x d`` block that is summed entry by entry. Its eigenvectors are found in two precisions.
LAPACK gives them in float32; then the iteration of Ogita and Aishima ("Iterative refinement for symmetric eigenvalue
decomposition", 2018) corrects all of them at once with nothing but matrix products in extended precision, doubling the
right digits each time. Its correction divides by differences of eigenvalues, so where those are not resolved, it only
makes vectors orthogonal. Such clusters get a sub-solve of their own (their part II, 2019): the matrix restricted to the
span of a cluster and shifted by its mean, which resolves the differences, is solved and the cluster's vectors are
rotated; then the iteration goes on.

Only the ``d x d`` matrix and ``d`` numbers reach the driver, whatever the number of vectors; ``d`` is the length of a
vector. Vectors are read four times (sums, products, check of the result, output), always narrow.

Entries are taken as whole numbers, ``floor(64 c) + 1000000``, so sums are exact and the same on any partitioning.
Left out are: null vectors, empty ones, vectors with null or non-finite entries or with one of ``2^44`` or more in size,
and vectors of another length than most have (of the longer, if two lengths are equally frequent). Repeated rows count as
often as they occur. A component without variance cannot be scaled to unit variance and is not returned: of equal vectors,
of a single one and of an empty table nothing is. Equal eigenvalues leave the choice of their vectors open; any
orthogonal choice whitens. ``deviation`` is null where it does not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
# Entries from here on are treated as not finite: their whole numbers would not be exact.
LARGEST = float(1 << 44)
# Extended precision where the machine has it; plain double elsewhere.
WIDE = np.longdouble
ROUNDS = 30
_BLOCK = 4096


# --- eigenvectors -----------------------------------------------------------------------------------------------


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of wide numbers from double products that are exact.

    Rows of ``a`` and columns of ``b`` are cut into slices of so few bits that sums of their products fit a double;
    NumPy multiplies wide numbers without BLAS, some hundred times slower.
    """
    inner = max(a.shape[1], 1)
    bits = (53 - int(np.ceil(np.log2(inner)))) // 2
    count = -(-66 // bits)
    left, right = _slices(a, bits, count, 1), _slices(b, bits, count, 0)
    out = np.zeros((a.shape[0], b.shape[1]), WIDE)
    # Small terms first.
    for total in range(count - 1, -1, -1):
        for i in range(total + 1):
            (x, sx), (y, sy) = left[i], right[total - i]
            out += (x @ y).astype(WIDE) * sx * sy
    return out


def _slices(m: np.ndarray, bits: int, count: int, axis: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Whole numbers of ``bits`` bits as doubles, with their units by row or column; their sum is ``m``."""
    largest = np.abs(m).max(axis=axis, keepdims=True)
    unit = np.exp2(np.ceil(np.log2(np.where(largest > 0, largest, 1)))).astype(WIDE)
    out = []
    for _ in range(count):
        unit = unit / WIDE(1 << bits)
        whole = np.rint(m / unit)
        out.append((whole.astype(np.float64), unit))
        m = m - whole * unit
    return out


def refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One step of the iteration, in wide numbers.

    Gives new vectors, eigenvalues, a table of the pairs whose eigenvalues are not resolved, and the largest correction.
    """
    d = len(matrix)
    r = np.eye(d, dtype=WIDE) - product(vectors.T, vectors)
    s = product(vectors.T, product(matrix, vectors))
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    size = abs(values).max(initial=0)
    rounding = 16 * d * np.finfo(WIDE).eps * size
    resolution = max(2 * (_norm(off) + size * _norm(r)), rounding)
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= resolution
    correction = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return vectors + product(vectors, correction), values, close, float(np.abs(correction).max(initial=0))


def _norm(m: np.ndarray) -> np.floating:
    """A bound of the spectral norm, at most ``sqrt(d)`` above it: the largest absolute row sum."""
    return np.abs(m).sum(axis=1).max(initial=0)


def sub_solve(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Vectors of a cluster, rotated within their span to the eigenvectors of the shifted matrix there."""
    own = vectors[:, members]
    shifted = matrix - np.eye(len(matrix), dtype=WIDE) * values[members].mean()
    small = product(own.T, product(shifted, own))
    size = np.abs(small).max()
    if size == 0:
        return own
    small = (small + small.T) / (2 * size)
    return product(own, np.linalg.eigh(small.astype(np.float64))[1].astype(WIDE))


def clusters(values: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Runs of eigenvalues, in falling order, whose neighbours are not resolved."""
    order = np.argsort(-values, kind="stable")
    apart = ~close[order[:-1], order[1:]]
    return [run for run in np.split(order, np.flatnonzero(apart) + 1) if len(run) > 1]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, of a symmetric matrix, to double precision.

    Each round refines, and where eigenvalues stay unresolved solves their clusters. It ends when a round moves no
    vector by more than the double precision; equal eigenvalues end it by being left as any orthogonal choice.
    """
    d = len(matrix)
    size = np.abs(matrix).max(initial=0)
    if d == 0 or size == 0:
        return np.zeros(d), np.eye(d)
    scaled = matrix.astype(WIDE) / WIDE(size)
    scaled = (scaled + scaled.T) / 2
    vectors = np.linalg.eigh(scaled.astype(np.float32))[1].astype(WIDE)
    small = float(np.finfo(np.float64).eps) / 8
    before = np.inf
    for _ in range(ROUNDS):
        vectors, values, close, moved = refine(scaled, vectors)
        if moved > 1e-3:
            continue
        rotated = False
        for members in clusters(values, close):
            own = sub_solve(scaled, vectors, values, members)
            turn = product(vectors[:, members].T, own)
            # A cluster that its sub-solve leaves in place up to sign and order is as resolved as it can be.
            rotated |= bool(np.abs(np.abs(turn).max(axis=0) - 1).max() > small)
            vectors[:, members] = own
        # Close to the rounding of wide numbers, corrections stop shrinking.
        if not rotated and (moved <= small or before / 2 < moved < 1e-12):
            break
        before = moved
    # Eigenvalues close to the rounding of the wide numbers keep moving within their span; what counts there is that
    # all vectors are orthogonal.
    for _ in range(4):
        vectors = vectors + product(vectors, np.eye(d, dtype=WIDE) - product(vectors.T, vectors)) / 2
    values = (vectors * product(scaled, vectors)).sum(axis=0) / (vectors * vectors).sum(axis=0)
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * WIDE(size)).astype(np.float64), vectors[:, order].astype(np.float64)


# --- passes over the vectors -------------------------------------------------------------------------------------


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of ``table`` whose vector takes part (see above)."""
    v = F.col(vector)
    number = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(LARGEST), F.lit(False))
    kept = table.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, number))
    lengths = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size(v) == (lengths.d if lengths else 0))


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers ``floor(64 c)``, without the offset, which no sum here needs."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(len(column), -1)


def _sums(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension, of the whole numbers without offset."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for batch in batches:
            whole = _whole(batch.column(0)) if batch.num_rows else np.zeros((0, 0), np.int64)
            count += len(whole)
            # The sum of so many numbers below 2^50 fits 64 bits.
            for start in range(0, len(whole), _BLOCK):
                part = whole[start : start + _BLOCK].sum(axis=0).astype(object)
                total = part if total is None else total + part
        if total is not None:
            text = [str(int(x)) for x in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(text)), pa.int32()), pa.array([count] * len(text), pa.int64()), pa.array(text)],
                names=["dim", "n", "s"],
            )

    parts = rows.select(vector).mapInArrow(add, "dim int, n bigint, s string")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(found.collect())
    return (found[0].n if found else 0), [int(r.s) for r in found]


def _centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` by dimension: exact 64-bit numbers where they fit, whole Python numbers otherwise."""
    largest = int(np.abs(whole).max(initial=0)) * n + max(map(abs, sums), default=0)
    kind = np.int64 if largest < 1 << 62 else object
    return whole.astype(kind) * n - np.array(sums, dtype=kind)


def _products(rows: DataFrame, centre, d: int) -> np.ndarray:
    """Sum over all rows of ``y y^T`` for ``y = centre(batch)``; one block of each task, summed on Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), np.longdouble)
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                y = centre(batch.slice(start, _BLOCK))
                total += y.T @ y
        for i in range(d):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (i + 1), pa.int32()), pa.array(range(i + 1), pa.int32()), pa.array(total[i, : i + 1].astype(float))],
                names=["i", "j", "v"],
            )

    out = np.zeros((d, d))
    for r in rows.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


@dataclass
class Whitening:
    """``n`` vectors were seen, with exact ``sums``; ``axes``: one column per component; ``variances``: its eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return _centred(whole, self.n, self.sums)

    def project(self, exact: np.ndarray) -> np.ndarray:
        return (exact.astype(np.float64) / self.n) @ (self.axes / np.sqrt(self.variances))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all ``rows`` (already :func:`usable`), and how far its result is from unit covariance."""
    n, sums = _sums(rows, vector)
    d = len(sums)
    only = rows.select(vector)

    def deviations(batch: pa.RecordBatch) -> np.ndarray:
        return _centred(_whole(batch.column(0)), n, sums).astype(np.float64) / n

    covariance = _products(only, deviations, d) / max(n, 1) if n else np.zeros((0, 0))
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    # Beyond rounding, and not more than the rank: anything smaller is a dimension without variance.
    real = values > d * np.finfo(np.float64).eps * max(trace, 0) * 4
    keep = np.flatnonzero(real)[:components]
    fitted = Whitening(n, sums, vectors[:, keep], values[keep], trace)
    if len(keep):
        fitted.identity_error = _identity_error(only, fitted)
    return fitted


def _identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; their mean is taken off before multiplying."""
    k = len(fitted.variances)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(k, np.longdouble), 0
        for batch in batches:
            total += fitted.project(fitted.centred(_whole(batch.column(0)))).sum(axis=0)
            count += batch.num_rows
        names = ["j", "v"]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.astype(float))], names=names)

    sums = rows.mapInArrow(add, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()
    mean = np.zeros(k)
    for r in sums:
        mean[r.j] = r.v / fitted.n

    def deviations(batch: pa.RecordBatch) -> np.ndarray:
        return fitted.project(fitted.centred(_whole(batch.column(0)))) - mean

    return float(np.abs(_products(rows, deviations, k) / fitted.n - np.eye(k)).max())


_ADDED = "__component int, __n bigint, __deviation bigint, __whitened double, __explained double, __identity_error double"


def apply(rows: DataFrame, fitted: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``rows`` and component: the columns ``keep`` (all but the vector) and those of the whitening."""
    keep = [c for c in rows.columns if c != vector] if keep is None else keep
    schema = T.StructType([rows.schema[c] for c in keep] + T.StructType.fromDDL(_ADDED).fields)
    k = len(fitted.variances)
    chosen = rows.select(*keep, F.col(vector).alias("__vector"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = fitted.centred(_whole(batch.column(len(keep))))
            m = batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            arrays = [batch.column(c).take(each) for c in range(len(keep))]
            arrays += [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fitted.n, np.int64)),
                pa.array(_squares(exact), pa.int64()).take(each),
                pa.array(fitted.project(exact).reshape(-1)),
                pa.array(np.tile(fitted.variances / fitted.trace, m)),
                pa.array(np.full(m * k, fitted.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return chosen.mapInArrow(spread, schema) if k else rows.sparkSession.createDataFrame([], schema)


def _squares(exact: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null beyond 64 bits."""
    if exact.size == 0:
        return [0] * len(exact)
    largest = max(abs(int(exact.min())), abs(int(exact.max())))
    kind = np.int64 if largest * largest * exact.shape[1] < 1 << 63 else object
    return [v if v < 1 << 63 else None for v in (exact.astype(kind) ** 2).sum(axis=1).tolist()]


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """``table`` whitened on its first ``components`` components, in long form (see :func:`apply`)."""
    rows = usable(table, vector)
    return apply(rows, fit(rows, vector, components), vector, keep)
