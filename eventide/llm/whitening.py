"""Whitening of embeddings: blockwise QR in Spark, then a bidiagonal qd solver for the few directions wanted.

The distinct whole-number vectors are the fit list. Their count and sums are exact. Each task reduces its centred rows to a
triangular factor R, block by block (QR of the factor so far stacked on the next block), and factors are stacked and
reduced again in Spark until few are left; their size depends on the dimensions only. R has the same singular values and right
singular vectors as all centred rows, and squaring the data is avoided. Householder steps make R bidiagonal;
the differential qd algorithm with shifts (dqds) finds all singular values to high relative accuracy, each shift a lower bound
from the diagonal of the inverse, which the qd transform yields on its way; a twisted factorisation of the tridiagonal
product minus an eigenvalue gives its vector, joined where the two sweeps disagree least. Should eigenvalues be so close that two
vectors agree, the later one is found by inverse iteration with the earlier ones projected out.

Nulls: null vectors and those with a null or non-finite component take no part; a null id stays. Repeated rows are answered each
time and count once in the fit. Vectors of unequal length are filled up with zeros. Directions without variance (eigenvalue below
dimensions times the rounding unit of the largest) are left out, so a table of equal vectors or an empty one gives no rows. ``deviation``
is null where it exceeds a long. A vector's sign is chosen so that its largest component is positive. Other columns, whatever
their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import written
from .vectors import matrix, whole_vectors

BLOCK = 4096
FACTORS_AT_ONCE = 16
EPS = float(np.finfo(float).eps)
WHITENED = "vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, the difference taken in whole numbers where they fit."""
    if not x.size or n * int(np.abs(x).max()) + int(np.abs(sums).max()) < 1 << 62:
        return (n * x - sums) / n
    return x - sums / n


def _reduced(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


# ---- the bidiagonal solver ----------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U' R V, and the Householder vectors of V (the k-th acts from column k + 1 on)."""
    a, n, right = r.astype(float).copy(), r.shape[1], []

    def reflector(v: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(v)
        if size == 0.0 or not v[1:].any():
            return None
        h = v.copy()
        h[0] += np.copysign(size, v[0])
        return h / np.linalg.norm(h)

    for k in range(n):
        h = reflector(a[k:, k])
        if h is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        h = reflector(a[k, k + 1 :]) if k + 1 < n else None
        if h is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ h, h)
        right.append(h)
    return a.diagonal().copy(), a.diagonal(1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One transform: new q and e, a lower bound of the smallest eigenvalue after it, and whether the shift was too large."""
    new_q, new_e, d, inverse = [], [], q[0] - shift, 0.0
    for i in range(len(e)):
        if d < 0.0:
            return q, e, 0.0, True
        inverse = inverse + 1 / d if d > 0.0 else float("inf")
        top = d + e[i]
        if top == 0.0:  # nothing above: the rest is a problem of its own
            ratio, d_next = 0.0, q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            d_next = d * ratio - shift
        new_q.append(top)
        new_e.append(e[i] * ratio)
        d = d_next
    if d < 0.0:
        return q, e, 0.0, True
    inverse = inverse + 1 / d if d > 0.0 else float("inf")
    new_q.append(d)
    return new_q, new_e, 1 / inverse, False


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B of the bidiagonal B, falling: dqds with splitting and deflation."""
    found: list[float] = []
    waiting = [([float(d) ** 2 for d in diagonal], [float(s) ** 2 for s in above], 0.0)] if len(diagonal) else []
    tiny = (10 * EPS) ** 2
    while waiting:
        q, e, done = waiting.pop()
        bound, stuck = 0.0, 0
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (done + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], done))
                q, e, bound = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            shift = bound * (1 - 4 * EPS * len(q)) if bound > EPS * done else 0.0
            q, e, bound, too_far = _dqds(q, e, shift)
            if too_far:
                bound, stuck = bound / 2, stuck + 1
                if stuck > 3:
                    q, e, bound, _ = _dqds(q, e, 0.0)
                    stuck = 0
            else:
                done += shift
        found.append(done + q[0])
    return np.sort(np.asarray(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Vector of a tridiagonal block (diagonal a, beside it b) for an eigenvalue, and its residual."""
    n = len(a)
    least = EPS * max(float(np.abs(a).max()), float(np.abs(b).max()) if n > 1 else 0.0, 1e-300) * EPS
    down, up = np.empty(n), np.empty(n)
    guarded = lambda v: v if abs(v) > least else least
    down[0], up[-1] = guarded(a[0] - value), guarded(a[-1] - value)
    for i in range(1, n):
        down[i] = guarded(a[i] - value - b[i - 1] ** 2 / down[i - 1])
        up[n - 1 - i] = guarded(a[n - 1 - i] - value - b[n - 1 - i] ** 2 / up[n - i])
    gamma = down + up - (a - value)
    k = int(np.abs(gamma).argmin())
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -b[i] * z[i + 1] / down[i]
    for i in range(k + 1, n):
        z[i] = -b[i - 1] * z[i - 1] / up[i]
    size = float(np.linalg.norm(z))
    return z / size, abs(float(gamma[k])) / size


def _without(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            v = v - (o @ v) * o
    return v


def _inverse_iteration(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """A vector for the eigenvalue orthogonal to the others, by solving with the whole tridiagonal matrix."""
    n, scale = len(a), max(float(np.abs(a).max()), 1e-300)
    dense = np.diag(a - value) + np.diag(b, 1) + np.diag(b, -1) + np.eye(n) * scale * EPS * 4
    v = _without(np.cos(np.arange(1, n + 1) * 1.7), others)
    for _ in range(4):
        v = _without(np.linalg.solve(dense, v / np.linalg.norm(v)), others)
    return v / np.linalg.norm(v)


def leading_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Unit eigenvectors of B'B for its largest eigenvalues, by twisted factorisations of its unreduced blocks."""
    a = diagonal**2 + np.r_[0.0, above**2]
    b = diagonal[:-1] * above
    n, found = len(a), []
    cuts = np.flatnonzero(np.abs(b) <= EPS * EPS * (a[:-1] + a[1:])) + 1
    blocks = list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, n].tolist()))
    for value in values:
        options = []
        for low, high in blocks:
            part, residual = _twisted(a[low:high], b[low : high - 1], float(value))
            z = np.zeros(n)
            z[low:high] = part
            z = _without(z, found)
            size = float(np.linalg.norm(z))
            if size > 0.9:  # else it is a vector that is there already
                options.append((residual, z / size))
        best = min(options, key=lambda o: o[0], default=None)
        if best is None or best[0] > 1e3 * EPS * float(values[0]):
            best = 0.0, _inverse_iteration(a, b, float(value), found)
        found.append(best[1])
    return found


@dataclass(frozen=True)
class Directions:
    """Unit directions (rows) with variance, falling; the variances; the sum of all variances."""

    vectors: np.ndarray
    variances: np.ndarray
    total: float


def directions(r: np.ndarray, n: int, most: int) -> Directions:
    """Leading principal directions of n centred rows from their triangular factor."""
    size = r.shape[1]
    square = np.zeros((size, size))
    square[: len(r)] = r
    diagonal, above, right = bidiagonal(square)
    values = squared_singular_values(diagonal, above)
    wanted = values[:most]
    wanted = wanted[wanted > EPS * size * values[0]] if size and values[0] > 0 else wanted[:0]
    vectors = []
    for z in leading_vectors(diagonal, above, wanted):
        for k in range(size - 1, -1, -1):
            h = right[k]
            if h is not None:
                z[k + 1 :] -= 2 * h * (h @ z[k + 1 :])
        z /= np.linalg.norm(z)
        vectors.append(z if z[np.abs(z).argmax()] > 0 else -z)
    return Directions(np.asarray(vectors).reshape(len(vectors), size), wanted / n, float(values.sum()) / n)


# ---- the work on rows ---------------------------------------------------------------------

def _column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; one row per task and dimension is summed up."""
    def add(batches):
        n, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n, sums = n + len(x), sums + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width)), pa.array(np.r_[n, sums])], names=["dimension", "s"])

    found = fit.mapInArrow(add, "dimension bigint, s bigint").groupBy("dimension").agg(F.sum("s").alias("s")).collect()
    by = {r["dimension"]: r["s"] for r in found}
    return by.get(-1, 0), [by.get(k, 0) for k in range(width)]


def _triangular(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of all centred rows: one factor per task, stacked and reduced in Spark until few are left."""
    width = len(sums)

    def rows(cell: bytes) -> np.ndarray:
        return np.frombuffer(cell, float).reshape(-1, width)

    def reduce_rows(batches):
        factor = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                factor = _reduced([factor, centred(matrix(batch.column(0).slice(at, BLOCK)), n, sums)])
        if len(factor):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([factor.tobytes()], pa.binary())], names=["part", "factor"])

    def stack(table: pa.Table) -> pa.Table:
        factor = np.zeros((0, width))
        ordered = sorted(zip(table.column("part").to_pylist(), table.column("factor").to_pylist()))
        for _, cell in ordered:
            factor = _reduced([factor, rows(cell)])
        return pa.table({"part": pa.array([ordered[0][0] // FACTORS_AT_ONCE], pa.int64()), "factor": pa.array([factor.tobytes()], pa.binary())})

    factors = written(fit.mapInArrow(reduce_rows, "part bigint, factor binary"), "factors")
    while factors.count() > FACTORS_AT_ONCE:
        group = F.floor(F.col("part") / FACTORS_AT_ONCE).alias("group")
        factors = written(factors.groupBy(group).applyInArrow(stack, "part bigint, factor binary"), "factors")
    found = sorted((r["part"], bytes(r["factor"])) for r in factors.collect())
    return _reduced([np.zeros((0, width)), *(rows(cell) for _, cell in found)])


def _identity_error(fit: DataFrame, n: int, sums: np.ndarray, weights: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, from sums of products over all its rows."""
    k = weights.shape[1]

    def add(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = centred(matrix(batch.column(0)), n, sums) @ weights if batch.num_rows else np.zeros((0, k))
            total += np.r_[w.T @ w, w.sum(0)[None]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

    found = fit.mapInArrow(add, "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:
        total[r["cell"]] = r["s"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every kept row and component."""
    chosen = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("vector"))
    table = written(whole_vectors(chosen, "vector", scale).select("vec_id", "x"), "whole-vectors")
    schema = WHITENED.format(kind=table.schema["vec_id"].dataType.simpleString())
    nothing = vectors.sparkSession.createDataFrame([], schema)
    first = table.select(F.size("x").alias("size")).first()
    if first is None:
        return nothing
    fit = written(table.select("x").distinct(), "fit-list")
    n, exact = _column_sums(fit, first["size"])
    sums = np.asarray(exact, np.int64)
    found = directions(_triangular(fit, n, sums), n, components) if first["size"] else Directions(np.zeros((0, 0)), np.zeros(0), 0.0)
    if not len(found.vectors):
        return nothing
    weights = (found.vectors / np.sqrt(found.variances)[:, None]).T
    explained = found.variances / found.total
    error = _identity_error(fit, n, sums, weights)
    k = len(found.vectors)

    def deviations(x: np.ndarray) -> pa.Array:
        most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return pa.array(np.square(n * x - sums).sum(1))
        whole = [sum((n * c - s) ** 2 for c, s in zip(row, exact)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = matrix(some.column(1))
                w, m = centred(x, n, sums) @ weights, len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        deviations(x).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.mapInArrow(project, schema)
