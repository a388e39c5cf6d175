"""Embedding whitening from singular values, without ever forming a covariance.

The centred rows are reduced to one triangle R by orthogonal transformations,
block by block in the tasks and then in a tree. R is made bidiagonal by
Householder reflections, its singular values come from the differential
quotient-difference algorithm with shifts, each accurate relative to itself,
and the directions from twisted factorisations at these values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, frugal, stored

EPS = np.finfo(float).eps
#: Scaled entries beyond this are taken for non-finite, so that sums of a task fit in 64 bits.
LARGEST = 1 << 40


@dataclass(frozen=True)
class Shape:
    components: int = 8
    scale: int = 1024  # entries are counted in parts of one over this, rounded down
    offset: int = 100_000  # and moved by this
    block: int = 4096  # rows that one QR step takes in
    fan_in: int = 16  # triangles that one task joins
    most_dimensions: int = 4096  # a triangle of so many takes 67 MB; more raise


# --- small dense algorithms -------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, beta) with (I - tau v v') x = beta e1 and v[0] = 1."""
    v, below = x.copy(), np.linalg.norm(x[1:])
    if below == 0:
        return np.r_[1.0, v[1:]], 0.0, float(x[0])
    beta = -np.copysign(np.hypot(x[0], below), x[0])
    tau = (beta - x[0]) / beta
    v[1:] /= x[0] - beta
    v[0] = 1.0
    return v, float(tau), float(beta)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """(diagonal, superdiagonal, right reflectors) of the upper bidiagonal B with r = U B V'."""
    a, d = np.array(r, float), r.shape[1]
    right = []
    for k in range(d):
        v, tau, a[k, k] = _reflector(a[k:, k])
        a[k:, k + 1 :] -= tau * np.outer(v, v @ a[k:, k + 1 :])
        if k < d - 2:
            v, tau, a[k, k + 1] = _reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= tau * np.outer(a[k + 1 :, k + 1 :] @ v, v)
            right.append((v, tau))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def back_transformed(z: np.ndarray, right: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """V z for the right reflectors of `bidiagonal`."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        v, tau = right[k]
        z[k + 1 :] -= tau * np.outer(v, v @ z[k + 1 :])
    return z


def _dqds_step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float] | None:
    """One transformation with shift tau, and the least of what stood on the diagonal; None where the shift was too large."""
    d = q[0] - tau
    least, qs, es = d, [], []
    if d < 0:
        return None
    for k in range(len(e)):
        top = d + e[k]
        if top <= 0:
            return None
        ratio = q[k + 1] / top
        qs.append(top)
        es.append(e[k] * ratio)
        d = d * ratio - tau
        least = min(least, d)
        if d < 0 or d != d:
            return None
    qs.append(d)
    return qs, es, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of a bidiagonal matrix, falling. Subtractions are of shifts alone, so that each is accurate relative to itself."""
    found: list[float] = []
    work = [((diagonal * diagonal).tolist(), (above * above).tolist(), 0.0)]
    while work:
        q, e, moved = work.pop()
        while q:
            n = len(q)
            if n == 1 or e[-1] <= EPS * EPS * (moved + q[-1]) or q[-1] == 0 and e[-1] <= EPS * EPS * moved:
                found.append(moved + q.pop())
                if n > 1:
                    e.pop()
                continue
            # a border that no longer matters splits the matrix
            split = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1])) and e[k] <= EPS * EPS * max(q[k], q[k + 1])), None)
            if split is not None:
                work.append((q[: split + 1], e[:split], moved))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            # the smaller eigenvalue of the last two rows is near the least of all; a shift may not exceed that
            a, b, c = q[-2] + (e[-3] if n > 2 and len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            low = (q[-2] * q[-1]) / (0.5 * (a + b) + np.sqrt(0.25 * (a - b) ** 2 + c)) if a + b > 0 else 0.0
            tau = min(float(low), min(q)) * (1 - 8 * EPS)
            step = None
            for _ in range(6):
                step = _dqds_step(q, e, tau)
                if step is not None:
                    break
                tau *= 0.5
            if step is None:
                tau, step = 0.0, _dqds_step(q, e, 0.0)
            if step is None:  # a zero on the diagonal: one value is zero, and a plain step brings it to the end
                q = [max(x, np.finfo(float).tiny) for x in q]
                continue
            q, e, _ = step
            moved += tau
    return np.sort(np.array(found))[::-1]


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, against: list[np.ndarray]) -> np.ndarray:
    """The unit eigenvector of B'B for a value, from the factorisation that is twisted where its residual is least.

    `against` holds the vectors of values too near to be told apart; should
    the best twist give one of these again, the next best is taken.
    """
    n = len(diagonal)
    d, low = diagonal * diagonal, above / diagonal[:-1]
    tiny = np.finfo(float).tiny * 1e30
    safe = lambda x: x if abs(x) > tiny else tiny
    down, up = np.zeros(n), np.zeros(n)
    left, right = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    down[0] = -value
    for k in range(n - 1):
        left[k] = d[k] * low[k] / safe(down[k] + d[k])
        down[k + 1] = left[k] * low[k] * down[k] - value
    up[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        t = d[k] / safe(d[k] * low[k] ** 2 + up[k + 1])
        right[k] = low[k] * t
        up[k] = up[k + 1] * t - value
    order = np.argsort(np.abs(down + up + value), kind="stable")
    for r in order.tolist():
        z = np.zeros(n)
        z[r] = 1.0
        for k in range(r - 1, -1, -1):
            z[k] = -left[k] * z[k + 1]
        for k in range(r, n - 1):
            z[k + 1] = -right[k] * z[k]
        z /= np.linalg.norm(z)
        if not np.isfinite(z).all():
            continue
        for _ in range(2):
            for x in against:
                z = z - (x @ z) * x
        size = np.linalg.norm(z)
        if size > 1e-4:
            return z / size
    raise ArithmeticError("no direction was found for a singular value")


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, unit right vectors as columns) of the first components of a triangle, and the sum of all squared values."""
    scale = np.abs(r).max(initial=0.0)
    d = r.shape[1]
    if not scale:
        return np.zeros(min(components, d)), np.eye(d)[:, :components], 0.0
    a, b, right = bidiagonal(r / scale)
    # exact zeros on the diagonal (fewer rows than dimensions) give way to values that are zero beside the others
    floor = EPS * EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) > floor, a, floor)
    starts = np.r_[0, 1 + np.flatnonzero(np.abs(b) <= EPS * EPS * np.sqrt(np.abs(a[:-1] * a[1:]))), d]
    parts = []  # unreduced blocks have no two equal values, and vectors of different blocks are orthogonal
    for lo, hi in zip(starts, starts[1:], strict=False):
        parts += [(v, int(lo), int(hi)) for v in dqds(a[lo:hi], b[lo : hi - 1])]
    total = float(sum(v for v, _, _ in parts))
    parts.sort(key=lambda x: -x[0])
    values, vectors = [], []
    for v, lo, hi in parts[:components]:
        near = [z[lo:hi] for w, z, l in zip(values, vectors, [p[1] for p in parts], strict=False) if l == lo and w - v <= 1e-6 * w]
        z = np.zeros(d)
        z[lo:hi] = twisted_vector(a[lo:hi], b[lo : hi - 1], v, near) if hi - lo > 1 else 1.0
        values.append(v)
        vectors.append(z)
    out = back_transformed(np.stack(vectors, 1), right)
    return np.array(values) * scale * scale, out, total * scale * scale


# --- Spark ------------------------------------------------------------------


def usable(column: pa.Array, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer rows) of the vectors of a column by their dimension, without those that are null, empty or hold null, non-finite or vast entries."""
    column = column.cast(pa.list_(pa.float64())) if column.type.value_type != pa.float64() else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(sizes)
    for d in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == d)
        with np.errstate(invalid="ignore", over="ignore"):
            rows = np.floor(flat[(ends[places] - d)[:, None] + np.arange(d)] * shape.scale)
            good = (np.abs(rows) < LARGEST).all(1)
        yield places[good], rows[good].astype(np.int64) + shape.offset


@dataclass(frozen=True)
class Fit:
    """What whitening needs of the fit list; whole and rest are S = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def known(self) -> np.ndarray:
        """Which values are above what rounding makes of zero."""
        return self.values > len(self.whole) * EPS * 16 * self.values.max(initial=0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return self.centred(x) @ (self.vectors / np.where(self.known(), np.sqrt(self.values), np.inf))

    def deviation(self, x: np.ndarray) -> pa.Array:
        d = x - self.whole
        if self.n * float(np.abs(d).max(initial=0)) * np.sqrt(d.size or 1) < 2e9:
            d = self.n * d - self.rest
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        exact = self.n * d.astype(object) - self.rest.astype(object)
        sums = [int(v) for v in (exact * exact).sum(1)]
        return pa.array([v if v < 10**38 else None for v in sums], pa.decimal128(38, 0))


def sums(vectors: DataFrame, column: str, shape: Shape) -> tuple[int, int, list[int]]:
    """(dimension, rows, exact sums) of the dimension that most usable vectors have (ties: the smaller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        total: dict[int, list] = {}
        for b in batches:
            for _, rows in usable(b.column(0), shape):
                own = total.setdefault(rows.shape[1], [0, np.zeros(rows.shape[1], object)])
                own[0] += len(rows)
                own[1] += rows.sum(0).astype(object)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int64()), pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array(s.tolist(), pa.decimal128(38, 0))], ["d", "n", "at", "s"])

    df = vectors.select(column).mapInArrow(run, "d long, n long, at long, s decimal(38,0)")
    # of each task one row per entry, added before the shuffle; then one per entry of each dimension
    df = stored(df.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "sums")
    top = df.where("at = 0 AND n > 0").orderBy(F.desc("n"), "d").first()
    if top is None:
        return 0, 0, []
    if top.d > shape.most_dimensions:
        raise ValueError(f"vectors of {top.d} dimensions are too long")
    rows = df.where(F.col("d") == top.d).orderBy("at").collect()  # one per dimension
    return top.d, top.n, [int(r.s) for r in rows]


def triangle(vectors: DataFrame, column: str, whole: np.ndarray, rest: np.ndarray, n: int, shape: Shape) -> np.ndarray:
    """R of the centred usable rows, with R'R their scatter: QR by blocks in each task, the tasks' triangles in a tree."""
    d = len(whole)
    schema = "number long, r binary"

    def taken(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([state, rows]), mode="r")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frugal()
        state = np.zeros((0, d))
        for b in batches:
            for _, rows in usable(b.column(0), shape):
                if rows.shape[1] == d:
                    for k in range(0, len(rows), shape.block):
                        state = taken(state, (rows[k : k + shape.block] - whole) - rest / n)
        if len(state):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tobytes()], pa.binary())], ["number", "r"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        state, number = np.zeros((0, d)), None
        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                state, number = taken(state, np.frombuffer(r.as_buffer(), float).reshape(-1, d)), k
        if number is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number // shape.fan_in], pa.int64()), pa.array([state.tobytes()], pa.binary())], ["number", "r"])

    found = stored(vectors.select(column).mapInArrow(reduce, schema), "triangles")
    while True:
        count = found.count()
        if count <= shape.fan_in:
            break
        parts = -(-count // shape.fan_in)
        ranked = found.repartitionByRange(parts, "number")  # at most about fan_in triangles a task
        found = stored(ranked.mapInArrow(join, schema), "triangles")
    state = np.zeros((0, d))
    for r in sorted(found.collect(), key=lambda r: (r.number, r.r)):  # at most fan_in triangles
        state = taken(state, np.frombuffer(bytes(r.r), float).reshape(-1, d))
    return np.vstack([state, np.zeros((max(0, d - len(state)), d))])


def fitted(vectors: DataFrame, column: str, shape: Shape = Shape()) -> Fit | None:
    """The fit over all usable vectors; None if there is none."""
    d, n, s = sums(vectors, column, shape)
    if not n:
        return None
    whole, rest = np.array([x // n for x in s], np.int64), np.array([x % n for x in s], np.int64)
    values, right, total = directions(triangle(vectors, column, whole, rest, n, shape), shape.components)
    return Fit(n, whole, rest, values / n, right, total / n)


def identity_error(vectors: DataFrame, column: str, fit: Fit, shape: Shape) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, from the whitened rows themselves; None if no component has a value."""
    k = int(fit.known().sum())
    if not k:
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        fit = shared.value
        total = np.zeros((k + 1) * k)
        for b in batches:
            for _, rows in usable(b.column(0), shape):
                if rows.shape[1] == len(fit.whole):
                    y = fit.whitened(rows)[:, :k]
                    total += np.r_[y.sum(0), (y.T @ y).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], ["at", "s"])

    got = vectors.select(column).mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    s = np.zeros((k + 1) * k)
    for r in got:
        s[r["at"]] = r["s"]
    mean, second = s[:k] / fit.n, s[k:].reshape(k, k) / fit.n  # the mean is zero but for rounding, so nothing cancels
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, keep: list[str], column: str = "embedding", shape: Shape = Shape()) -> DataFrame:
    """The columns `keep` of every usable vector, n, deviation (decimal), whitened (an array), explained (an array) and identity_error.

    Entries become integers (times `scale`, rounded down, plus `offset`). The
    arrays go by falling variance and have up to `components` entries; a
    component whose variance is zero beside the largest has null in whitened,
    and null in explained where all are zero. `deviation` is the exact sum of
    squares of n times the row less the sums, null beyond 38 digits.

    Vectors that are null or empty or hold null or non-finite entries (or
    entries beyond 2^40 as integers) are left out, and those whose dimension is
    not that of most. Repeated rows count as often as they occur. An empty
    table, or one without usable vectors, gives no rows. Columns of `keep`
    named like a result give way to it; other names clash with nothing.

    Four passes over the vectors: sums, triangles, what whitening made of the
    covariance, and the rows. Between them one row per task and entry, one
    triangle per task and the fit pass; only the last `fan_in` triangles meet
    on the driver, whatever the number of rows.
    """
    results = ["n", "deviation", "whitened", "explained", "identity_error"]
    kept = Kept(keep, *results)
    inner = kept.inner
    rows = vectors.select(*kept.columns(), F.col(f"`{column}`").cast("array<double>").alias("_vector"))
    doubles = T.ArrayType(T.DoubleType())
    schema = rows.select(*inner).schema.add("n", "long").add("deviation", "decimal(38,0)").add("whitened", doubles).add("explained", doubles).add("identity_error", "double")
    fit = fitted(rows, "_vector", shape)
    if fit is None:
        return kept.restored(vectors.sparkSession.createDataFrame([], schema), *results)
    error = identity_error(rows, "_vector", fit, shape)
    shared = vectors.sparkSession.sparkContext.broadcast(fit)  # dimensions times components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        fit = shared.value
        k = len(fit.values)
        unknown = ~fit.known()
        explained = pa.array(fit.values / fit.trace if fit.trace else [None] * k, pa.float64())
        for b in batches:
            for places, x in usable(b.column(len(inner)), shape):
                if x.shape[1] != len(fit.whole) or not len(x):
                    continue
                m, y = len(x), fit.whitened(x)
                flat = pa.array(y.ravel(), pa.float64(), mask=np.tile(unknown, m))
                offsets = pa.array(np.arange(0, (m + 1) * k, k), pa.int32())
                shares = explained.take(pa.array(np.tile(np.arange(k), m)))
                own = [b.column(i).take(pa.array(places)) for i in range(len(inner))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([fit.n] * m, pa.int64()), fit.deviation(x), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, shares), pa.array([error] * m, pa.float64())], [*inner, *results])

    return kept.restored(rows.mapInArrow(run, schema), *results)
