"""Whitening by an incremental eigendecomposition.

Every partition keeps the count, the mean and the spectrum (eigenvalues and
eigenvectors) of its centred scatter.  A vector changes the scatter by a centred
rank-one term; the new eigenvalues are the roots of a secular equation, found in
all intervals at once after deflation, and the new eigenvectors follow from the
recomputed update vector.  Spectra of partitions are combined in a tree by the
same updates: each eigenpair of the smaller is a rank-one term of the larger, and
so is the difference of the means.  A last pass over all vectors forms their exact
covariance in the combined basis (Rayleigh-Ritz); its small eigenproblem gives the
components to double precision.  One more pass measures the covariance of the
whitened values.

Tasks and driver hold matrices of the vectors' length, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.topk import integers
from fieldloom.sources.scratch import Scratch

EPS = np.finfo(float).eps
#: Spectra that one task combines.
FAN = 8
_SPECTRUM = "n long, total array<long>, e array<double>, u array<double>"


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) = 0 for rising ``d`` and positive ``z2`` and ``rho``.

    Returns for each root the index of its nearer pole and its distance from it,
    so that differences to all poles keep their relative precision.
    """
    n, total = len(d), rho * z2.sum()
    right = np.append(d[1:], d[-1] + total)
    gap = right - d
    pole = np.arange(n)
    # The sign of the function in the middle of an interval tells the nearer pole.
    mid = 1 + rho * (z2 / (d - (d + gap / 2)[:, None])).sum(1)
    nearer = np.where((mid < 0) & (pole < n - 1), pole + 1, pole)
    shift = d - d[nearer][:, None]  # poles as seen from each root's own
    lo, hi = np.where(nearer > pole, -gap / 2, 0.0), np.where(nearer > pole, 0.0, np.where(mid < 0, gap, gap / 2))
    lo = np.where((nearer == pole) & (mid < 0), gap / 2, lo)
    x = (lo + hi) / 2
    left = pole[None, :] <= pole[:, None]
    a_at, b_at = pole, np.minimum(pole + 1, n - 1)
    todo = np.ones(n, bool)
    for _ in range(80):
        delta = shift - x[:, None]
        term = rho * z2 / delta
        slope = term / delta
        f = 1 + term.sum(1)
        todo &= np.abs(f) > 4 * EPS * (1 + np.abs(term).sum(1))
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        todo &= hi - lo > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))
        if not todo.any():
            break
        # Interpolate by two poles that match value and slope on either side.
        da, db = delta[pole, a_at], delta[pole, b_at]
        s1 = np.where(left, slope, 0).sum(1)
        s2 = slope.sum(1) - s1
        with np.errstate(all="ignore"):
            c = f - da * s1 - db * s2
            p, q = (da + db) * f - da * db * (s1 + s2), da * db * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            last = -f / (s1 + s2)
            step[-1] = last[-1]  # beyond the last pole
            if n > 1:  # its two last poles bound the outermost root
                dy, dz = delta[-1, -2], delta[-1, -1]
                y, w = slope[-1, :-1].sum(), slope[-1, -1]
                c1, p1, q1 = f[-1] - dy * y - dz * w, (dy + dz) * f[-1] - dy * dz * (y + w), dy * dz * f[-1]
                r1 = np.sqrt(abs(p1 * p1 - 4 * q1 * c1))
                out = (p1 + r1) / (2 * c1) if p1 >= 0 else 2 * q1 / (p1 - r1)
                step[-1] = out if np.isfinite(out) and out * f[-1] <= 0 else step[-1]
        new = x + step
        bad = ~np.isfinite(new) | (new <= lo) | (new >= hi)
        x = np.where(todo, np.where(bad, (lo + hi) / 2, new), x)
    return nearer, x


def rank_one(e: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of u diag(e) u' + rho v v' for rising ``e``; directions without scatter are left out."""
    norm = np.linalg.norm(v)
    if not norm or not rho:
        return e, u
    rho, v = rho * norm * norm, v / norm
    z = u.T @ v
    rest = v - u @ z
    again = u.T @ rest
    z, rest = z + again, rest - u @ again
    out = np.linalg.norm(rest)
    if u.shape[1] < len(v) and out > 64 * EPS:  # a direction that the basis lacks starts with eigenvalue 0
        u, e, z = np.column_stack([rest / out, u]), np.append(0.0, e), np.append(out, z)
    tol = 8 * EPS * max(e[-1] if len(e) else 0.0, rho)
    keep = rho * np.abs(z) > tol
    close = np.flatnonzero(np.diff(e[keep]) <= tol)
    if len(close):  # turn equal eigenvalues until one of them has all of the update
        u, e, z = u.copy(), e.copy(), z.copy()
        at = np.flatnonzero(keep)
        for i in close:
            a, b = at[i], at[i + 1]
            r = np.hypot(z[a], z[b])
            if not r:
                continue
            c, s = z[b] / r, z[a] / r
            if abs((e[b] - e[a]) * c * s) > tol:
                continue
            u[:, [a, b]] = u[:, [a, b]] @ np.array([[c, s], [-s, c]])
            e[a], e[b] = e[a] * c * c + e[b] * s * s, e[a] * s * s + e[b] * c * c
            z[a], z[b], keep[a] = 0.0, r, False
        order = np.argsort(e, kind="stable")
        e, u, z, keep = e[order], u[:, order], z[order], keep[order]
    d, w = e[keep], z[keep]
    if not len(d):
        return e, u
    nearer, x = secular_roots(d, w * w, rho)
    delta = (d - d[nearer][:, None]) - x[:, None]  # pole i less root j at [j, i]
    n = len(d)
    # The update vector whose exact roots these are.
    ratio = np.ones((n, n))
    gaps = d[:, None] - d[None, :]
    i, j = np.arange(n), np.arange(n)[:, None]
    low = j < i
    ratio[low] = (delta / np.where(gaps == 0, 1, -gaps))[low]
    high = (j >= i) & (j < n - 1)
    over = np.vstack([gaps[1:], np.ones((1, n))])  # d[j + 1] - d[i]
    ratio[high] = (-delta / np.where(over == 0, 1, over))[high]
    ratio[n - 1] = -delta[n - 1]
    zhat = np.sqrt(np.abs(ratio.prod(0))) * np.sign(w)
    vec = (zhat / delta).T
    vec /= np.linalg.norm(vec, axis=0)
    new_e, new_u = np.append(e[~keep], d[nearer] + x), np.column_stack([u[:, ~keep], u[:, keep] @ vec])
    order = np.argsort(new_e, kind="stable")
    return np.maximum(new_e[order], 0.0), new_u[:, order]


class Spectrum:
    """Count, exact sums and scatter of some integer vectors."""

    def __init__(self, d: int, n: int = 0, total: list[int] | None = None, e: np.ndarray | None = None, u: np.ndarray | None = None):
        self.n, self.total = n, total or [0] * d
        self.e, self.u = (np.empty(0), np.empty((d, 0))) if e is None else (e, u)

    def add(self, x: np.ndarray, copies: int) -> None:
        if self.n:
            mean = np.array([t / self.n for t in self.total])
            self.e, self.u = rank_one(self.e, self.u, x - mean, self.n * copies / (self.n + copies))
        self.n += copies
        self.total = [a + int(b) * copies for a, b in zip(self.total, x)]

    def merge(self, other: Spectrum) -> Spectrum:
        if len(other.e) > len(self.e) or not self.n:
            return other.merge(self) if other.n else self
        if not other.n:
            return self
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.total, other.total)])
        self.e, self.u = rank_one(self.e, self.u, apart, self.n * other.n / (self.n + other.n))
        for value, v in zip(other.e, other.u.T):
            self.e, self.u = rank_one(self.e, self.u, v, value)
        self.n, self.total = self.n + other.n, [a + b for a, b in zip(self.total, other.total)]
        return self

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((self.n, self.total, self.e.tolist(), self.u.ravel().tolist()), kinds)], names=["n", "total", "e", "u"])

    @staticmethod
    def rows(tab) -> list[Spectrum]:
        out = []
        for n, total, e, u in zip(*(tab.column(c).to_pylist() for c in ("n", "total", "e", "u"))):
            out.append(Spectrum(len(total), n, total, np.array(e), np.array(u).reshape(len(total), len(e))))
        return out


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(len(col), d)


def _combine(tab: pa.Table) -> pa.Table:
    """One spectrum from those of a group, in pairs."""
    some = Spectrum.rows(tab)
    while len(some) > 1:
        some = [a.merge(b) for a, b in zip(some[::2], some[1::2])] + some[len(some) // 2 * 2 :]
    return pa.Table.from_batches([some[0].batch()])


class Centre:
    """Exact centring: x less S / n with one rounding."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        self.pivot = np.array([t // n for t in total], np.int64)
        self.rest = [t - n * int(p) for t, p in zip(total, self.pivot)]  # in [0, n)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as integers: longs where they fit, Python's otherwise."""
        near = x - self.pivot
        if (int(np.abs(near).max(initial=0)) + 1) * self.n < 1 << 62:
            return near * self.n - np.array(self.rest, np.int64)
        return near.astype(object) * self.n - np.array(self.rest, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)


def _tree(parts: DataFrame, tmp: Scratch, schema: str, add) -> pa.Table:
    """One row from ``parts(part, ...)``, ``FAN`` rows added in each task, level by level."""
    while True:
        parts = tmp.write(parts, "parts")
        last = parts.agg(F.max("part")).first()[0]
        if not last:
            return parts.toArrow()

        def one(key, tab):
            out = add(tab.drop_columns(["part"]))
            return out.add_column(0, "part", pa.array([key[0].as_py()], pa.int64()))

        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("next")).applyInArrow(one, schema)


def _numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The row that a partition gives, with the partition's number."""
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *batch.columns], names=["part", *batch.schema.names])


def _gram(vectors: DataFrame, tmp: Scratch, d: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred vectors in a basis, over all rows."""
    k, held = basis.shape[1], vectors.sparkSession.sparkContext.broadcast((centre, basis))
    flat = lambda g: pa.array([g.ravel().tolist()], pa.list_(pa.float64()))

    def part(batches):
        (centre, basis), g = held.value, np.zeros((k, k))
        for b in batches:
            y = centre(_matrix(b.column("x"), d)) @ basis
            g += y.T @ y
        yield _numbered(pa.RecordBatch.from_arrays([flat(g)], names=["g"]))

    def add(tab: pa.Table) -> pa.Table:
        return pa.table({"g": flat(np.asarray(tab.column("g").combine_chunks().flatten()).reshape(tab.num_rows, -1).sum(0))})

    got = _tree(vectors.select("x").mapInArrow(part, "part long, g array<double>"), tmp, "part long, g array<double>", add)
    held.unpersist()
    return np.asarray(got.column("g").combine_chunks().flatten()).reshape(k, k) / centre.n


def decompose(vectors: DataFrame, tmp: Scratch, d: int) -> tuple[Centre, np.ndarray, np.ndarray]:
    """Centring, falling eigenvalues and unit eigenvectors of the covariance of ``vectors(x)``, all of length ``d``."""

    def run(batches):
        got = Spectrum(d)
        for b in batches:
            rows, copies = np.unique(_matrix(b.column("x"), d), axis=0, return_counts=True)  # equal vectors are one update
            for x, c in zip(rows, copies.tolist()):
                got.add(x, c)
        yield _numbered(got.batch())

    schema = f"part long, {_SPECTRUM}"
    got = Spectrum.rows(_tree(vectors.select("x").mapInArrow(run, schema), tmp, schema, _combine))[0]
    centre = Centre(got.n, got.total)
    basis = np.linalg.qr(np.column_stack([got.u[:, ::-1], np.eye(d)]))[0][:, :d]
    e, w = np.linalg.eigh(_gram(vectors, tmp, d, centre, basis))  # Rayleigh-Ritz
    return centre, e[::-1], basis @ w[:, ::-1]


def _whiten(vectors: DataFrame, tmp: Scratch, d: int, most: int) -> DataFrame:
    centre, e, u = decompose(vectors, tmp, d)
    k = min(most, int((e > d * EPS * max(e[0], 0) * 64).sum())) if e[0] > 0 else 0
    share, scale = e[:k] / e.sum() if k else e[:0], u[:, :k] / np.sqrt(e[:k])
    error = float(np.abs(_gram(vectors, tmp, d, centre, scale) - np.eye(k)).max()) if k else 0.0
    held = vectors.sparkSession.sparkContext.broadcast((centre, scale))
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches):
        centre, scale = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 4_096):
                part = b.slice(lo, 4_096)
                x = _matrix(part.column("x"), d)
                whole, rows = centre.scaled(x), part.num_rows
                top = int(np.abs(whole).max(initial=0))
                if d * top * top >= 1 << 63:
                    far = [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in r) for r in whole)]
                else:
                    far = (whole.astype(np.int64) ** 2).sum(1)
                y = centre(x) @ scale
                cols = [part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, centre.n)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(y.ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in out.split(", ")])

    return vectors.mapInArrow(run, out)


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors(vec_id, embedding)``.

    Components c become the integers floor(scale * c) + offset.  Vectors that are
    null or hold null, non-finite or huge (beyond 2^53 / scale) components have no
    rows.  Repeated rows count as often as they occur; null ids are kept.  Vectors
    of each length are whitened by themselves, with their own ``n``.  Components
    without variance are left out, so equal or single vectors, empty vectors and
    an empty table give no rows.  ``deviation`` is null where it exceeds a long.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "whitening")
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("x")).where("x is not null")
    rows = tmp.write(read.withColumn("x", F.transform("x", lambda v: v + offset)), "rows")
    lengths = sorted(r.d for r in rows.groupBy(F.size("x").alias("d")).count().collect() if r.d)  # one row a length
    out = None
    for d in lengths:
        got = _whiten(rows.where(F.size("x") == d), tmp, d, components)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out
