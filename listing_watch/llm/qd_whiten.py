"""Whitening of vectors by a bidiagonal qd solver.

Vectors are counted in whole steps, x = floor(64 c) + 1000000, so that counts, sums and deviations are
exact. All rows are fitted:

1. Each task centres its rows by the exact mean and reduces them block by block to a triangular R
   (QR of R over the next block). The tasks' R are reduced FAN at a time until one is left; R'R / n is
   the covariance, which is never formed.
2. Householder reflections from both sides bring R to an upper bidiagonal B.
3. dqds with deflation finds the squares of B's singular values to high relative accuracy.
4. For each, stationary and progressive qd transforms of B'B - s meet where the twisted factorisation
   has its least pivot; two sweeps from there give the direction. Directions of values that lie close
   together are made orthogonal and refined in the space they span.
5. The directions, taken back through the reflections, over sqrt(s / n) are the whitening.

The driver holds one d x d matrix, d the vectors' length; tasks hold that and a block of rows.

Defined results: rows whose vector is null, holds a null or non-finite entry or one beyond 2^46, or is
not of the most common length (the longer on ties) take no part. Rows that repeat an id are rows of
their own; null ids stay. Components without variance are left out: there are at most as many as R
has rank. `deviation` is null where it does not fit a long. Without rows the result is empty. Columns
made here start with `qw_`; a caller's column of such a name gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, stored, unpacked

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK = 2048
FAN = 32
LARGEST = 2.0**46
EPS = float(np.finfo(float).eps)
CLOSE = 1e-3
MADE = ["qw_component", "qw_n", "qw_deviation", "qw_whitened", "qw_explained", "qw_identity_error"]


def valid(vec: Column) -> Column:
    """Not null and every entry finite and countable."""
    v = vec.cast("array<double>")
    return F.coalesce(vec.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)), F.lit(False))


def counted(vectors: pa.Array, d: int) -> np.ndarray:
    """x of a column of vectors of length d."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(STEPS * flat).astype(np.int64).reshape(-1, d) + OFFSET


# bidiagonal form, singular values, directions ------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, superdiagonal, right reflections) of R under Householder reflections; a reflection
    is (first place, unit vector)."""
    a = r.copy()
    d = a.shape[0]
    right = []

    def unit(x: np.ndarray) -> np.ndarray | None:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not np.any(x[1:]):
            return None
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = unit(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 1:
            w = unit(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                right.append((k + 1, w))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds transform, and its least d; that is negative where the shift was too large."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        q2[k] = d + e[k]
        if d < 0 or q2[k] <= 0:
            return q2, e2, min(d, -1.0) if d < 0 else (0.0 if shift == 0 else -1.0)
        t = q[k + 1] / q2[k]
        e2[k] = e[k] * t
        d = d * t - shift
        least = min(least, d)
    q2[n - 1] = d
    return q2, e2, least


def squared_singular_values(diag: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, by dqds."""
    tiny = (max(np.abs(diag).max(initial=0.0), np.abs(over).max(initial=0.0)) * EPS) ** 2
    if tiny == 0:
        return np.zeros(len(diag))
    found: list[float] = []
    todo = [(np.maximum(diag * diag, tiny * EPS), over * over, 0.0)]
    while todo:
        q, e, total = todo.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(total + q[0])
                break
            small = e <= EPS * EPS * (total + np.minimum(q[:-1], q[1:]))
            if small[-1]:
                found.append(total + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = np.flatnonzero(small)
            if len(cut):
                k = int(cut[-1]) + 1
                todo.append((q[:k], e[: k - 1], total))
                q, e = q[k:], e[k:]
                continue
            # the least eigenvalue of the last two rows is an upper bound of the least of all
            s = q[-2] + e[-1] + q[-1]
            gap = np.sqrt(max(0.0, (q[-2] + e[-1] - q[-1]) ** 2 + 4 * q[-1] * e[-1]))
            guess = 2 * q[-2] * q[-1] / (s + gap) if s + gap > 0 else 0.0
            for shift in (guess * (1 - 1e-10), guess * 0.75, guess * 0.25, 0.0):
                q2, e2, least = _dqds(q, e, shift)
                if least >= 0:
                    break
            q, e, total = q2, e2, total + shift
    return np.sort(np.maximum(found, 0.0))[::-1]


def twisted_direction(diag: np.ndarray, over: np.ndarray, value: float) -> np.ndarray:
    """A unit vector z with B'B z near value * z, from the twisted factorisation of B'B - value."""
    n = len(diag)
    floor = EPS * max(np.abs(diag).max(), np.abs(over).max(initial=0.0))
    a = np.where(np.abs(diag) < floor * EPS, floor * EPS, diag)
    dd, ll = a * a, over / a[:-1]
    low = floor * floor

    def pivot(x: float) -> float:
        return x if abs(x) > low * EPS else np.copysign(low * EPS, x)

    s, plus = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        plus[i] = dd[i] * ll[i] / pivot(s[i] + dd[i])
        s[i + 1] = plus[i] * ll[i] * s[i] - value
    p, minus = np.empty(n), np.empty(max(n - 1, 0))
    p[n - 1] = dd[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = dd[i] / pivot(dd[i] * ll[i] ** 2 + p[i + 1])
        minus[i] = ll[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    z = np.nan_to_num(z, posinf=1e150, neginf=-1e150)
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def directions(diag: np.ndarray, over: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit columns z): right singular directions of B for the given squared values. In a
    group of close values the twisted directions, and others where those repeat, are made orthogonal
    and turned to diagonal form within their span."""
    n = len(diag)
    zs = np.array([twisted_direction(diag, over, v) for v in values]).T.reshape(n, -1)
    b = np.diag(diag) + np.diag(over, 1)
    out, vals, i = zs.copy(), values.astype(float).copy(), 0
    while i < len(values):
        j = i + 1
        while j < len(values) and values[j - 1] - values[j] <= CLOSE * values[j - 1]:
            j += 1
        if j - i > 1:
            basis: list[np.ndarray] = []
            fresh = np.random.default_rng(i)
            # next to the group's mean, so that a solution lies in the group but for one part in 10^7
            near = b.T @ b - float(values[i:j].mean()) * (1 + 1e-10) * np.eye(n)
            for z in zs[:, i:j].T:
                size = 0.0
                while size < 0.1:
                    for _ in range(2):
                        for y in [*out[:, :i].T, *basis]:
                            z = z - y * (y @ z)
                    size = np.linalg.norm(z)
                    if size < 0.1:  # a direction found before: another one of the group
                        z = fresh.standard_normal(n)
                        for _ in range(2):
                            z = np.linalg.solve(near, z / np.linalg.norm(z))
                        z /= np.linalg.norm(z)
                basis.append(z / size)
            y = np.array(basis).T
            inner = b @ y
            _, sv, vt = np.linalg.svd(inner, full_matrices=False)
            out[:, i:j], vals[i:j] = y @ vt.T, sv**2
        i = j
    return vals, out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, unit columns, sum of all squared values) of R: the leading ones, those
    that are not zero to working precision."""
    diag, over, right = bidiagonal(r)
    every = squared_singular_values(diag, over)
    rank = int((every > (len(diag) * EPS) ** 2 * every[:1].max(initial=0.0)).sum())
    values, z = directions(diag, over, every[: min(most, rank)])
    for at, w in reversed(right):
        z[at:] -= 2 * np.outer(w, w @ z[at:])
    return values, z, float((r * r).sum())


# passes over the rows --------------------------------------------------------------------------


def _tree(parts: DataFrame, merge: Callable[[dict | None, dict], dict], name: str) -> dict | None:
    """The one row that is left of `parts` (with an int column `part`) when FAN of them at a time are
    merged; None if there are none. Every step is a written table."""
    schema = parts.schema
    names = [f.name for f in schema.fields if f.name != "part"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            for r in b.to_pylist():
                k = r["part"] // FAN
                if k != key and held is not None:
                    yield pa.RecordBatch.from_pylist([{"part": key, **held}], b.schema)
                    held = None
                key, held = k, merge(held, {n: r[n] for n in names})
            last = b.schema
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"part": key, **held}], last)

    d = stored(parts, name)
    n = d.count()
    while n > 1:
        d = stored(d.repartition(F.floor(F.col("part") / FAN)).sortWithinPartitions("part").mapInArrow(fold, schema), name)
        n = d.count()
    row = d.first()
    return None if row is None else {k: row[k] for k in names}


def _int_array(x: np.ndarray) -> pa.Array:
    return pa.array([x.tolist()], pa.list_(pa.int64()))


@dataclass(frozen=True)
class Fit:
    """A fitted whitening: n rows, sums S, squared values over n, unit columns, and shares of the trace."""

    n: int
    sums: np.ndarray
    variance: np.ndarray
    columns: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, to double precision: the whole part is taken off first."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.columns / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        rough = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        if rough.max(initial=0.0) < 2.0**60:
            off = self.n * (x - self.sums // self.n) - self.sums % self.n
            return (off * off).sum(axis=1).tolist()
        big = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in big]


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, np.int64)
        for b in batches:
            x = counted(b.column(0), d)
            n, s = n + len(x), s + x.sum(axis=0)
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), _int_array(s)], names=["n", "s"])

    parts = rows.mapInArrow(add, "n long, s array<long>")
    total = parts.select("n", F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # d rows
    s = np.zeros(d, np.int64)
    for r in total:
        s[r["k"]] = r["s"]
    return (total[0]["n"] if total else 0), s


def _triangle(rows: DataFrame, d: int, fit: Fit) -> np.ndarray:
    """R of the centred rows."""

    def reduce(held: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([held, more]), mode="r")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_row = np.zeros((0, d)), False
        for b in batches:
            x = fit.centred(counted(b.column(0), d))
            for i in range(0, len(x), BLOCK):
                held, any_row = reduce(held, x[i : i + BLOCK]), True
        if any_row:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(held: dict | None, more: dict) -> dict:
        if held is None:
            return more
        return {"r": reduce(np.reshape(held["r"], (-1, d)), np.reshape(more["r"], (-1, d))).ravel().tolist()}

    row = _tree(rows.mapInArrow(block, "part int, r array<double>"), merge, "triangles")
    r = np.reshape(row["r"], (-1, d)) if row else np.zeros((0, d))
    return np.vstack([r, np.zeros((d - len(r), d))])


def fit_whitening(vectors: DataFrame, vec: str, components: int = COMPONENTS) -> Fit | None:
    """Fits all valid vectors of a column; None without any."""
    v = vectors.select(F.col(f"`{vec}`").alias("v")).filter(valid(F.col("v")))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or sizes["d"] == 0:
        return None
    d = sizes["d"]
    rows = v.filter(F.size("v") == d)
    n, s = _sums(rows, d)
    none = np.zeros(0)
    bare = Fit(n, s, none, np.zeros((d, 0)), none)
    values, columns, total = principal(_triangle(rows, d, bare), components)
    return Fit(n, s, values / n, columns, values / total if total else none)


def identity_error(vectors: DataFrame, vec: str, fit: Fit) -> float:
    """The largest entry of the whitened rows' covariance beside the identity. Rows are centred by
    their task's mean, and the parts' means by the joint one, before anything is multiplied."""
    d, k = fit.columns.shape

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for b in batches:
            w = fit.whitened(counted(b.column(0), d))
            if len(w):
                mean = w.mean(axis=0)
                held = merge(held, {"n": len(w), "mean": mean.tolist(), "c": ((w - mean).T @ (w - mean)).ravel().tolist()})
        if held:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held["n"]], pa.int64()), pa.array([held["mean"]], pa.list_(pa.float64())), pa.array([held["c"]], pa.list_(pa.float64()))], names=["part", "n", "mean", "c"])

    def merge(a: dict | None, b: dict) -> dict:
        if a is None:
            return b
        n, ma, mb = a["n"] + b["n"], np.array(a["mean"]), np.array(b["mean"])
        off = mb - ma
        c = np.array(a["c"]) + np.array(b["c"]) + (np.outer(off, off) * (a["n"] * b["n"] / n)).ravel()
        return {"n": n, "mean": (ma + off * (b["n"] / n)).tolist(), "c": c.tolist()}

    v = vectors.select(F.col(f"`{vec}`").alias("v")).filter(valid(F.col("v")) & (F.size("v") == d))
    row = _tree(v.mapInArrow(scatter, "part int, n long, mean array<double>, c array<double>"), merge, "whitened-covariance")
    return float(np.abs(np.reshape(row["c"], (k, k)) / row["n"] - np.eye(k)).max(initial=0.0)) if row else 0.0


def whiten(vectors: DataFrame, vec: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """For each valid row and component the columns `keep` (None: all), qw_component (from 1), qw_n,
    qw_deviation, qw_whitened, qw_explained and qw_identity_error."""
    fit = fit_whitening(vectors, vec, components)
    d = packed(vectors, keep, MADE, v=F.col(f"`{vec}`")).filter(valid(F.col("v")))
    d = d.filter(F.size("v") == fit.columns.shape[0]) if fit else d.limit(0)
    error = identity_error(vectors, vec, fit) if fit else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                x = counted(b.column(1), fit.columns.shape[0])
                w = fit.whitened(x)
                k = w.shape[1]
                at = pa.array(np.repeat(np.arange(len(x)), k))
                row = b.column(0).take(at)
                cols = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, fit.n, np.int64)),
                    pa.array(fit.deviation(x), pa.int64()).take(at),
                    pa.array(w.ravel()),
                    pa.array(np.tile(fit.explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.record_batch([row, *cols], names=["row", *MADE])

    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    out = T.StructType([d.schema["row"], *[T.StructField(name, kind) for name, kind in zip(MADE, kinds)]])
    return unpacked(d.mapInArrow(project, out), *MADE)
