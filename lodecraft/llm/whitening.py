"""Whitening of vectors: an exact centred scatter from the executors, cyclic Jacobi rotations on the driver, projections on the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import quantised

#: Rows that are multiplied at once, and magnitude below which their products add up exactly in doubles.
ROWS, PLAIN = 8192, 1 << 20
#: Exact sums travel as four limbs of 40 bits, the last one signed.
LIMB, LIMBS = 40, 4
MOST = 1 << 62


class Whitening(NamedTuple):
    """Fitted on ``n`` vectors: exact sums of each dimension, eigenvalues in falling order, unit eigenvectors in columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self, k: int) -> np.ndarray:
        """Centred vectors times this are whitened; components without variance are zero."""
        live = self.values[:k] > len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0)
        return np.where(live, self.vectors[:, :k] / np.sqrt(np.where(live, self.values[:k], 1.0)), 0.0)


def _matrix(column: pa.Array, dims: int, shift: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector is filled up with zeros before the shift."""
    flat = np.clip(column.flatten().to_numpy(zero_copy_only=False), -MOST, MOST)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims) + shift
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out + shift


def _exact(rows: DataFrame, partial) -> dict[int, int]:
    """Sums of whole numbers of any size: ``partial`` makes one array of each part of the rows, Spark adds them up by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = partial(batch.column(1).slice(at, ROWS))
                total = part if total is None else total + part
        if total is not None:
            limbs = [[(v >> LIMB * k) & ((1 << LIMB) - 1) if k < LIMBS - 1 else v >> LIMB * k for v in total] for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), *(pa.array(x, pa.int64()) for x in limbs)], ["place", *(f"l{k}" for k in range(LIMBS))])

    parts = rows.mapInArrow(run, "place long, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    found = parts.groupBy("place").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    return {r.place: sum(r[1 + k] << LIMB * k for k in range(LIMBS)) for r in found}


def jacobi(matrix: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix.

    Each sweep rotates every pair of dimensions once; the pairs of a round share no dimension, so they are rotated together. It ends when every
    off-diagonal entry vanishes beside the geometric mean of its two diagonal ones, which keeps small eigenvalues accurate.
    """
    a, d, eps = np.array(matrix, float), len(matrix), np.finfo(float).eps
    v, least = np.eye(d), eps * eps * np.trace(np.abs(matrix)) / max(d, 1)
    seats = [*range(d), *([-1] * (d % 2))]
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[: len(seats) // 2], seats[::-1]) if min(x, y) >= 0]
        rounds.append(np.array(pairs, int).reshape(-1, 2))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    for _ in range(sweeps):
        turned = False
        for pairs in rounds:
            p, q = pairs[:, 0], pairs[:, 1]
            off = a[p, q]
            need = np.abs(off) > eps * np.sqrt(np.abs(a[p, p] * a[q, q])) + least
            if not need.any():
                continue
            turned, p, q, off = True, p[need], q[need], off[need]
            tau = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for x in (a, a.T, v):  # columns, rows, vectors
                x[:, p], x[:, q] = c * x[:, p] - s * x[:, q], s * x[:, p] + c * x[:, q]
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def _rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))
    return rows.where("x is not null")


def fit(rows: DataFrame, shift: int) -> Whitening | None:
    """The whitening of rows (vec_id, x array<long>) whose entries are shifted by ``shift``; None without rows.

    Two passes: sums, then the scatter around the sums' rounded means, both in whole numbers, so the covariance is exact until its last division
    and does not depend on how rows are dealt. The driver gets dims squared numbers.
    """
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return None
    if not dims:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0)

    def add(column: pa.Array) -> np.ndarray:
        x = _matrix(column, dims, shift)
        return x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) >= 1 << 48 else x.sum(axis=0).astype(object)

    found = _exact(rows, add)
    sums = [found[i] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(dims)

    def scatter(column: pa.Array) -> np.ndarray:
        x = _matrix(column, dims, shift)
        wide = np.abs(x).max(axis=1, initial=0) >= 1 << 61
        z = x[~wide] - np.array([min(max(c, -MOST), MOST) for c in centre], np.int64)
        plain = np.abs(z).max(axis=1, initial=0) < PLAIN
        some = z[plain].astype(float)
        total = (some.T @ some).astype(np.int64).astype(object)
        for odd in (z[~plain].astype(object), x[wide].astype(object) - np.array(centre, object)):
            if len(odd):
                total = total + odd.T @ odd
        return total[upper]

    found = _exact(rows, scatter)
    rest = [s - n * c for s, c in zip(sums, centre)]
    exact = np.zeros((dims, dims), object)
    for place, (i, j) in enumerate(zip(*upper)):
        exact[i, j] = exact[j, i] = n * found[place] - rest[i] * rest[j]
    covariance = np.array([[c / (n * n) for c in row] for row in exact])
    values, own = jacobi(covariance)
    return Whitening(n, sums, values, own, sum(exact[i, i] for i in range(dims)) / (n * n))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where all of them fit, else as Python's integers."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(d: np.ndarray) -> pa.Array:
    if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    from decimal import Decimal

    squares = (sum(int(v) * int(v) for v in row) for row in d)
    return pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the first ``k`` components.

    Entries become x = floor(scale * c) + shift. ``n`` rows are fitted; ``deviation``, the sum over dimensions of (n * x - sum)**2, is exact (decimal,
    null beyond 38 digits). ``whitened`` is the centred vector on the unit eigenvector of the component, by the root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace; ``identity_error`` the largest absolute entry of the covariance of ``whitened``, measured over all rows, minus the identity.

    Executors make the scatter, the driver turns it (``dims`` squared numbers) by Jacobi rotations and broadcasts dims * k numbers. Rows are not shuffled.

    Defined cases: vectors that are null or hold null or non-finite entries are left out; those shorter than the longest are filled up with zeros;
    entries beyond 2**62 after scaling count as 2**62. Null and repeated ids are rows like others. Components without variance (copies of one vector, fewer
    rows than dimensions) are 0 in ``whitened`` and ``explained``, and ``identity_error`` leaves them out. Fewer dimensions than ``k``: as many
    components; none: no rows. Other columns, whatever their names, are ignored. No rows: no rows.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col, scale)
    found = fit(rows, shift)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    n, sums, dims = found.n, found.sums, len(found.values)
    k = min(k, dims)
    turn = spark.sparkContext.broadcast(found.matrix(k))
    live = np.abs(turn.value).any(axis=0)
    explained = np.where(live, found.values[:k] / (found.trace or 1.0), 0.0)

    def project(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums).astype(float) / n) @ turn.value

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(_matrix(batch.column(1), dims, shift))
            first, second = first + w.sum(axis=0), second + w.T @ w
        place = np.arange(k * k + k)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([second.ravel(), first]))], ["place", "part"])

    parts = {r.place: r.total for r in rows.mapInArrow(moments, "place long, part double").groupBy("place").agg(F.sum("part").alias("total")).collect()}
    mean = np.array([parts[k * k + i] for i in range(k)]) / n
    covariance = np.array([parts[i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs((covariance - np.eye(k))[np.ix_(live, live)]).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims, shift)
            took = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [batch.column(0).take(took), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n))]
            columns += [_deviations(_centred(x, n, sums)).take(took), pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
