"""Reduced-order models from packed snapshots ``(dof, xs array<double>)``.

One pass gives the m x m Gram matrix of the m snapshots; the driver solves the
small problem; one map gives the modes.  Gram matrices square the condition
number, so singular values under 1e-7 of the largest are cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.spatial import in_blocks
from fieldloom.sources.scratch import Scratch

CUT = 1e-7
#: Numbers that a task holds in the Gram matrices of its keys at most.
HELD = 1 << 22


def pack(snapshots: DataFrame) -> DataFrame:
    """``dof, xs`` from long ``dof, step, value`` rows, in step order."""
    g = snapshots.groupBy("dof").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("p"))
    return g.select("dof", F.col("p.value").alias("xs"))


def _block(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def gram(packed: DataFrame, center: bool = True) -> DataFrame:
    """``i, j, s`` for i <= j: inner products of snapshots, each dof's mean over steps removed first.

    Rows with a null or another length than the first batch's are an error of
    the data and raise; an empty table gives no rows.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = _block(b.column("xs"))
                x = x - x.mean(1, keepdims=True) if center else x
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(total[i, j])})

    return packed.select(F.col("xs").cast("array<double>").alias("xs")).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def to_matrix(g: DataFrame) -> np.ndarray:
    rows = g.collect()  # m * (m + 1) / 2 numbers
    m = max((r.j for r in rows), default=-1) + 1
    out = np.zeros((m, m))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def apply_right(packed: DataFrame, right: np.ndarray, name: str = "phi", center: bool = True, keys: tuple[str, ...] = ("dof",)) -> DataFrame:
    """``keys, mean`` and each row times a small m x k matrix."""
    held = packed.sparkSession.sparkContext.broadcast(right)
    kinds = dict(packed.dtypes)
    src = packed.select(*[F.col(k).cast("long").alias(k) if k == "dof" else F.col(k) for k in keys], F.col("xs").cast("array<double>").alias("xs"))

    def run(batches):
        for b in batches:
            x = _block(b.column("xs"))
            mean = x.mean(1) if center else np.zeros(len(x))
            y = (x - mean[:, None]) @ held.value if len(x) else x
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(mean), pa.array(list(y), pa.list_(pa.float64()))], names=[*keys, "mean", name])

    return src.mapInArrow(run, ", ".join(f"`{k}` {'long' if k == 'dof' else kinds[k]}" for k in keys) + f", mean double, {name} array<double>")


@dataclass
class Pod:
    modes: DataFrame  # dof, mean, phi
    sigma: np.ndarray
    temporal: np.ndarray  # mode x step
    energy: np.ndarray


def _eigen(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (none negative), largest first, and vectors whose largest entry is positive."""
    w, v = np.linalg.eigh(g)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) if len(w) else v


def _kept(w: np.ndarray, n_modes: int | None, energy: float) -> int:
    s, cum = np.sqrt(w), np.cumsum(w) / max(w.sum(), 1e-300)
    keep = int((s > CUT * s[0]).sum()) if len(s) and s[0] > 0 else 0
    return min(keep, n_modes if n_modes is not None else int(np.searchsorted(cum, energy) + 1))


def pod_fit(packed: DataFrame, n_modes: int | None = None, energy: float = 0.9999, weight: str | None = None, keys: tuple[str, ...] = ("dof",)) -> Pod:
    """Modes, singular values, temporal coefficients and cumulative energy.

    ``weight`` is a column with the diagonal of the inner product, in which the
    modes are then orthonormal.
    """
    if weight:
        sums = gram_by(packed.withColumn("__one", F.lit(0)), "__one", weight).drop("__one")
    else:
        sums = gram(packed)
    w, v = _eigen(to_matrix(sums))
    k = _kept(w, n_modes, energy)
    s, v = np.sqrt(w[:k]), v[:, :k]
    return Pod(apply_right(packed, v / s, keys=keys), s, s[:, None] * v.T, (np.cumsum(w) / max(w.sum(), 1e-300))[:k])


def pod_fit_matrix(packed: DataFrame, matrix: DataFrame, n_modes: int) -> Pod:
    """The same with a sparse symmetric inner product ``matrix(row, col, value)`` over the dofs.

    One join gives W X; X' W X is then a sum over dofs.
    """
    tmp = Scratch(packed.sparkSession, "weighted")
    m = len(packed.select("xs").first().xs)
    c = F.transform("xs", lambda v: v.cast("double") - F.aggregate("xs", F.lit(0.0), lambda a, b: a + b) / F.size("xs"))
    x = packed.select("dof", c.alias("c"))
    product = matrix.join(x.withColumnRenamed("dof", "col"), "col").groupBy(F.col("row").alias("dof")).agg(*[F.sum(F.col("value") * F.col("c")[i]).alias(f"y{i}") for i in range(m)])
    both = tmp.write(x.join(product, "dof").select("c", F.array(*[f"y{i}" for i in range(m)]).alias("y")), "product")

    def run(batches):
        total = np.zeros((m, m))
        for b in batches:
            if b.num_rows:
                total += _block(b.column("c")).T @ _block(b.column("y"))
        i, j = np.indices((m, m))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(total.ravel())})

    g = to_matrix(both.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")))
    w, v = _eigen((g + g.T) / 2)
    k = _kept(w, n_modes, 1.0)
    s, v = np.sqrt(w[:k]), v[:, :k]
    return Pod(apply_right(packed, v / s), s, s[:, None] * v.T, (np.cumsum(w) / max(w.sum(), 1e-300))[:k])


def pod_project(states: DataFrame, modes: DataFrame, by: str = "state") -> DataFrame:
    """``by, mode, coef``: inner products of many states ``by, dof, value`` minus the mean with every mode.

    ``modes(dof, mean, phi)`` need not be those the states were fitted on.  One
    join by dof, and sums of one row a state and mode.
    """
    k = F.explode(F.transform("phi", lambda p, i: F.struct(i.cast("int").alias("mode"), (p * (F.col("value") - F.col("mean"))).alias("v"))))
    return states.select(by, "dof", "value").join(modes.select("dof", "mean", "phi"), "dof").select(by, k.alias("t")).groupBy(by, "t.mode").agg(F.sum("t.v").alias("coef"))


def pod_reconstruct(coefs: DataFrame, modes: DataFrame, by: str = "state") -> DataFrame:
    """``by, dof, value``: the mean plus the coefficients ``by, mode, coef`` times the modes.

    A state's coefficients are one small row; every state meets every dof, since
    that is the result.
    """
    packed = coefs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("mode", "coef"))).alias("c"))
    out = None
    for part in in_blocks(packed):
        value = F.aggregate("c", F.col("mean"), lambda a, s: a + s["coef"] * F.get("phi", s["mode"]))
        rows = modes.select("dof", "mean", "phi").crossJoin(part).select(by, "dof", value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def pod_randomized(packed: DataFrame, k: int, oversample: int = 10, power: int = 2, seed: int = 0) -> Pod:
    """The leading ``k`` modes by a random range finder, for too many snapshots to hold their m x m matrix.

    Each pass over the rows gives the Gram matrix of Y = X Omega and X' Y, m x l
    numbers in all; power iterations replace Omega by the orthonormal X' Y.
    """
    m = len(packed.select("xs").first().xs)
    omega = np.random.default_rng(seed).normal(size=(m, min(m, k + oversample)))
    for _ in range(power):
        omega = np.linalg.qr(_sketch(packed, omega)[1])[0]
    g, c = _sketch(packed, omega)
    w, v = _eigen(g)
    keep = w > CUT**2 * w[0]
    half = v[:, keep] / np.sqrt(w[keep])  # Y half has orthonormal columns
    u, s, vt = np.linalg.svd(half.T @ c.T, full_matrices=False)
    u, s, vt = u[:, :k], s[:k], vt[:k]
    sign = np.sign(vt[np.arange(len(s)), np.abs(vt).argmax(1)])
    return Pod(apply_right(packed, omega @ half @ (u * sign)), s, s[:, None] * vt * sign[:, None], np.cumsum(s**2) / max((s**2).sum(), 1e-300))


def _sketch(packed: DataFrame, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Y'Y and X'Y for Y = X omega, rows centred, in one pass."""
    held, (m, n) = packed.sparkSession.sparkContext.broadcast(omega), omega.shape

    def run(batches):
        total = np.zeros((n + m, n))
        for b in batches:
            if b.num_rows:
                x = _block(b.column("xs"))
                x = x - x.mean(1, keepdims=True)
                y = x @ held.value
                total += np.vstack([y.T @ y, x.T @ y])
        i = np.arange(n + m)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "r"])

    rows = packed.select(F.col("xs").cast("array<double>").alias("xs")).mapInArrow(run, "i int, r array<double>")
    got = rows.groupBy("i").agg(*[F.sum(F.col("r")[j]).alias(f"r{j}") for j in range(n)]).toPandas().sort_values("i")  # l + m rows of l numbers
    a = got[[f"r{j}" for j in range(n)]].to_numpy() if len(got) else np.zeros((n + m, n))
    return a[:n], a[n:]


def multifield_pod(fields: DataFrame, n_modes: int, coupled: bool = True) -> DataFrame:
    """``field, dof, mean, phi`` of ``fields(field, dof, xs)``: one basis of the stacked fields, or one for each field."""
    if coupled:
        return pod_fit(fields, n_modes=n_modes, keys=("field", "dof")).modes
    return pod_modes_by(fields, "field", n_modes)


def pod_modes_by(packed: DataFrame, key: str, n_modes: int, weight: str | None = None) -> DataFrame:
    """``key, dof, mean, phi``: the basis of each key.

    A key's Gram matrix is one small group; its small right factor is a row that
    meets the key's rows in a join.
    """
    kind = dict(packed.dtypes)[key]

    def solve(pdf):
        g = np.zeros((pdf.j.max() + 1,) * 2)
        g[pdf.i, pdf.j] = g[pdf.j, pdf.i] = pdf.s
        w, v = _eigen(g)
        k = _kept(w, n_modes, 1.0)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "r": [list((v[:, :k] / np.sqrt(w[:k])).T)]})

    right = Scratch(packed.sparkSession, "bases").write(gram_by(packed, key, weight).groupBy(key).applyInPandas(solve, f"`{key}` {kind}, r array<array<double>>"), "right")
    x = packed.select(key, "dof", F.col("xs").cast("array<double>").alias("xs")).withColumn("mean", F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / F.size("xs"))
    dot = lambda r: F.aggregate(F.zip_with("xs", r, lambda a, b: (a - F.col("mean")) * b), F.lit(0.0), lambda a, v: a + v)
    return x.join(right, key).select(key, "dof", "mean", F.transform("r", dot).alias("phi"))


def pod_error(packed: DataFrame, pod: Pod) -> DataFrame:
    """Relative L2 and largest absolute error of the reconstruction of every snapshot value."""
    held = packed.sparkSession.sparkContext.broadcast(pod.temporal)
    both = packed.join(pod.modes, "dof").select(F.col("xs").cast("array<double>").alias("xs"), "mean", "phi")

    def run(batches):
        for b in batches:
            x, phi = _block(b.column("xs")), _block(b.column("phi"))
            e = x - np.asarray(b.column("mean"))[:, None] - phi @ held.value
            yield pa.RecordBatch.from_pydict({"e2": pa.array([(e**2).sum()]), "x2": pa.array([(x**2).sum()]), "top": pa.array([np.abs(e).max() if e.size else 0.0])})

    s = both.mapInArrow(run, "e2 double, x2 double, top double").agg(F.sum("e2").alias("e2"), F.sum("x2").alias("x2"), F.max("top").alias("max_abs"))
    return s.select(F.sqrt(F.col("e2") / F.col("x2")).alias("relative_l2"), "max_abs")


def subspace_distance(a: DataFrame, b: DataFrame) -> float:
    """Root of the summed squared principal angles of two orthonormal mode tables."""

    def run(batches):
        for r in batches:
            if r.num_rows:
                g = _block(r.column("p")).T @ _block(r.column("q"))
                i, j = np.indices(g.shape)
                yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(g.ravel())})

    rows = a.select("dof", F.col("phi").alias("p")).join(b.select("dof", F.col("phi").alias("q")), "dof").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k * k numbers
    g = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1))
    for r in rows:
        g[r.i, r.j] = r.s
    return float(np.sqrt((np.arccos(np.clip(np.linalg.svd(g, compute_uv=False), -1, 1)) ** 2).sum()))


@dataclass
class Dmd:
    eigenvalues: np.ndarray
    amplitudes: np.ndarray
    modes: DataFrame  # dof, mean (0), re_im: real parts then imaginary parts


def _dmd_small(g: np.ndarray, rank: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, amplitudes and the m x k matrix that turns snapshots into modes."""
    a, c = g[:-1, :-1], g[:-1, 1:]
    w, v = np.linalg.eigh(a)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    s = np.sqrt(w)
    k = int((s > CUT * s[0]).sum())
    k = min(k, rank) if rank else k
    v, s = v[:, :k], s[:k]
    lam, vec = np.linalg.eig((v / s).T @ c @ (v / s))
    order = np.lexsort((lam.imag, -np.abs(lam)))
    lam, vec = lam[order], vec[:, order]
    right = np.zeros((len(g), k), complex)
    right[1:] = (v / s) @ vec / np.where(np.abs(lam) > 1e-14, lam, 1)
    b = np.linalg.lstsq(right.conj().T @ g @ right, right.conj().T @ g[:, 0], rcond=None)[0]
    return lam, b, right


def dmd_fit(packed: DataFrame, rank: int | None = None) -> Dmd:
    """Exact dynamic modes from ONE Gram matrix of all snapshots.

    X1'X1 and X1'X2 are slices of it.  Eigenvalues are sorted by size, then by
    imaginary part; each mode is turned so that its first amplitude is real.
    """
    lam, b, right = _dmd_small(to_matrix(gram(packed, center=False)), rank)
    return Dmd(lam, b, apply_right(packed, np.hstack([right.real, right.imag]), "re_im", center=False))


@dataclass
class MrDmd:
    levels: list  # (eigenvalues, step) of each level
    fitted: DataFrame  # dof, mean (0), xs: the sum of the levels' reconstructions at every snapshot


def mrdmd_fit(packed: DataFrame, levels: int, ranks: int) -> MrDmd:
    """Dynamic modes of the snapshots, then of what they leave at every second snapshot, and so on.

    A level's reconstruction is a linear map of the snapshots, so all levels come
    from one m x m Gram matrix: no pass over the rows but the first and the last.
    Coarser levels are repeated to the full number of snapshots.
    """
    g = to_matrix(gram(packed, center=False))
    m = len(g)
    rest, total, out = np.eye(m), np.zeros((m, m)), []  # snapshots of this level and the fitted sum, as maps of the given ones
    for level in range(levels):
        n = rest.shape[1]
        if n < 3:
            break
        lam, b, right = _dmd_small(rest.T @ g @ rest, ranks)
        if not len(lam):
            break
        fit = rest @ (right @ (b[:, None] * lam[:, None] ** np.arange(n))).real
        out.append((lam, 2**level))
        total += fit[:, np.minimum(np.arange(m) // 2**level, n - 1)]
        rest = (rest - fit)[:, ::2]
    return MrDmd(out, apply_right(packed, total, "xs", center=False))


def dmd_posterior(spark: SparkSession, omega: np.ndarray, resid_std: float, n: int, seed: int = 0) -> DataFrame:
    """``mode, re_mean, re_std, im_mean, im_std, frequency_mean, frequency_std`` of ``n`` noisy draws of continuous eigenvalues.

    A draw depends on seed, draw and mode alone.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "id", "mode", F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.log(u(2 * k))) * F.cos(2 * F.pi() * u(2 * k + 1))
    modes = F.array(*[F.struct(F.lit(k).alias("mode"), F.lit(float(w.real)).alias("re"), F.lit(float(w.imag)).alias("im")) for k, w in enumerate(omega)])
    rows = spark.range(n).select("id", F.explode(modes).alias("m")).select("id", "m.*")
    rows = rows.select("mode", (F.col("re") + resid_std * normal(0)).alias("re"), (F.col("im") + resid_std * normal(1)).alias("im")).withColumn("frequency", F.col("im") / (2 * np.pi))
    return rows.groupBy("mode").agg(*[f(c).alias(f"{c}_{t}") for c in ("re", "im", "frequency") for t, f in (("mean", F.avg), ("std", F.stddev_pop))])


def dmd_predict_uncertain(dmd: Dmd, noise: float, steps: list[int], n: int = 1000, seed: int = 0) -> DataFrame:
    """``dof, step, mean, std`` of ``n`` draws of the dynamics around the fit.

    A draw adds normal noise to the continuous eigenvalues (both parts), to the
    amplitudes and to every mode value.  The noise of the mode values is integrated
    exactly; that of the k eigenvalues and amplitudes is drawn on the driver and
    enters through the moments of the 2 k time factors at each step, so the rows
    are read once and no draw leaves the driver.
    """
    rng, k = np.random.default_rng(seed), len(dmd.eigenvalues)
    omega = np.log(np.asarray(dmd.eigenvalues, complex) + 1e-300) + noise * (rng.normal(size=(n, k)) + 1j * rng.normal(size=(n, k)))
    amplitude = dmd.amplitudes + noise * rng.normal(size=(n, k))
    centre, spread, extra = [], [], []
    for t in steps:
        f = amplitude * np.exp(omega * t)
        f = np.hstack([f.real, -f.imag])  # as the real and imaginary parts of a mode's value meet them
        centre.append(f.mean(0))
        spread.append(np.linalg.cholesky(np.cov(f.T, bias=True).reshape(2 * k, 2 * k) + 1e-14 * np.eye(2 * k) * max(np.abs(f).max() ** 2, 1e-300)))
        extra.append(noise**2 * (f[:, :k] ** 2).sum(1).mean())
    held = dmd.modes.sparkSession.sparkContext.broadcast((np.array(centre), spread, extra))

    def run(batches):
        for b in batches:
            x, dof = _block(b.column("re_im")), np.asarray(b.column("dof"))
            if not len(x):
                continue
            centre, spread, extra = held.value
            mean = x @ centre.T
            std = np.sqrt(np.column_stack([((x @ c) ** 2).sum(1) + e for c, e in zip(spread, extra)]))
            yield pa.RecordBatch.from_pydict({"dof": pa.array(np.repeat(dof, len(steps)), pa.int64()), "step": pa.array(np.tile(steps, len(x)), pa.int32()), "mean": pa.array(mean.ravel()), "std": pa.array(std.ravel())})

    return dmd.modes.mapInArrow(run, "dof long, step int, mean double, std double")


def dmd_predict(dmd: Dmd, steps: list[int]) -> DataFrame:
    """``dof, step, value``: real part of the modes times amplitudes and powers of the eigenvalues."""
    t = (dmd.amplitudes[:, None] * dmd.eigenvalues[:, None] ** np.array(steps)[None, :])
    right = np.vstack([t.real, -t.imag])
    spec = dmd.modes.sparkSession.sparkContext.broadcast(right)

    def run(batches):
        for b in batches:
            y = _block(b.column("re_im")) @ spec.value
            yield pa.RecordBatch.from_pydict({"dof": pa.array(np.repeat(np.asarray(b.column("dof")), len(steps)), pa.int64()), "step": pa.array(np.tile(steps, len(y)), pa.int32()), "value": pa.array(y.ravel())})

    return dmd.modes.mapInArrow(run, "dof long, step int, value double")


def koopman_spectrum(spark: SparkSession, eigenvalues: np.ndarray, dt: float = 1.0) -> DataFrame:
    """``mode, re, im, growth, frequency, stable``: continuous eigenvalues log(lambda + 1e-10) / dt; stable inside the unit circle."""
    w = np.log(np.asarray(eigenvalues, complex) + 1e-10) / dt
    rows = [(k, float(x.real), float(x.imag), float(c.real), float(c.imag / (2 * np.pi)), bool(abs(x) < 1)) for k, (x, c) in enumerate(zip(eigenvalues, w))]
    return spark.createDataFrame(rows, "mode int, re double, im double, growth double, frequency double, stable boolean")


def _chosen(modes: DataFrame, score, used: list[int]):
    """The row ``dof, phi`` of the highest score, ties by the smaller dof."""
    left = modes.where(~F.col("dof").isin(used)) if used else modes
    return left.select("dof", "phi", score.alias("r")).agg(F.max_by(F.struct("dof", "phi"), F.struct("r", -F.col("dof"))).alias("b")).first().b


def deim_points(modes: DataFrame, k: int) -> list[int]:
    """Greedy interpolation dofs: the largest residual of each mode in turn; only the chosen rows reach the driver."""
    points, rows = [], []
    for j in range(k):
        value = F.col("phi")[j]
        if points:
            u = np.array(rows)
            for i, x in enumerate(np.linalg.solve(u[:, :j], u[:, j])):
                value = value - float(x) * F.col("phi")[i]
        best = _chosen(modes, F.abs(value), points)
        points.append(best.dof)
        rows.append(list(best.phi))
    return points


def pivot_rows(phi: np.ndarray, k: int) -> list[int]:
    """Rows that QR with column pivoting of phi' chooses: each time the one with the largest part outside the chosen rows' span."""
    rest, size = phi.copy(), (phi**2).sum(1)
    out: list[int] = []
    for _ in range(min(k, len(phi))):
        value = np.round(size, 12)
        value[out] = -1.0
        best = int(value.argmax())
        q = rest[best] / max(np.linalg.norm(rest[best]), 1e-300)
        dot = rest @ q
        rest = rest - np.outer(dot, q)
        size = (rest**2).sum(1)
        out.append(best)
    return out


def _winners(dof: np.ndarray, phi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dof, kind="stable")  # ties go to the smaller dof
    best = order[pivot_rows(phi[order], k)]
    return dof[best], phi[best]


#: Rounds' width of a tournament: so many partitions' winners meet in one task.
FAN = 8


def qdeim_points(modes: DataFrame, k: int) -> list[int]:
    """Interpolation dofs by a tournament of pivoted QR factorisations.

    Every partition's rows, batch by batch with the winners so far, give k winners;
    winners of ``FAN`` partitions meet in a task, level by level, and the last k are
    the points in order of choice.  The rows are read once whatever k; a single
    partition is plain pivoted QR.
    """
    schema = "part long, place int, dof long, phi array<double>"

    def packed(part, dof, phi) -> pa.RecordBatch:
        n = len(dof)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(dof, pa.int64()), pa.array(list(phi), pa.list_(pa.float64()))], names=["part", "place", "dof", "phi"])

    def first(batches):
        from pyspark import TaskContext

        dof, phi = np.empty(0, np.int64), None
        for b in batches:
            if b.num_rows:
                x = _block(b.column("phi"))
                dof, phi = _winners(np.r_[dof, np.asarray(b.column("dof"))], x if phi is None else np.vstack([phi, x]), k)
        yield packed(TaskContext.get().partitionId(), dof, [] if phi is None else phi)

    def meet(key, tab):
        dof, phi = _winners(np.asarray(tab.column("dof")), _block(tab.column("phi").combine_chunks()), k)
        return pa.Table.from_batches([packed(key[0].as_py(), dof, phi)])

    tmp = Scratch(modes.sparkSession, "tournament")
    now = tmp.write(modes.select(F.col("dof").cast("long").alias("dof"), F.col("phi").cast("array<double>").alias("phi")).mapInArrow(first, schema), "winners")
    while now.agg(F.max("part")).first()[0]:
        now = tmp.write(now.groupBy(F.floor(F.col("part") / FAN).alias("next")).applyInArrow(meet, schema), "winners")
    return [r.dof for r in now.sort("place").select("dof").collect()]  # k rows


def gnat_points(modes: DataFrame, residual_modes: DataFrame, k: int) -> list[int]:
    """The same over the state's and the residual's modes side by side."""
    both = modes.join(residual_modes.select("dof", F.col("phi").alias("theta")), "dof").select("dof", F.concat("phi", "theta").alias("phi"))
    return qdeim_points(both, k)


def interpolation_error(modes: DataFrame, points: list[int], k: int) -> float:
    """The factor by which interpolation at the dofs exceeds the best error: the norm of (P' Phi)^-1."""
    rows = {r.dof: r.phi[:k] for r in modes.where(F.col("dof").isin(points)).select("dof", "phi").collect()}  # k rows
    return float(1 / np.linalg.svd(np.array([rows[p] for p in points]), compute_uv=False)[-1])


def _log_map(g: np.ndarray, base: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Tangent at a subspace towards another; both, and the answer, as coefficients of a stack with Gram matrix ``g``."""
    step = other @ np.linalg.pinv(base.T @ g @ other) - base
    s, v = _eigen(step.T @ g @ step)
    s = np.sqrt(s)
    return step @ (v * np.where(s > 1e-10, np.arctan(s) / np.maximum(s, 1e-300), 1.0)) @ v.T


def _exp_map(g: np.ndarray, base: np.ndarray, tangent: np.ndarray) -> np.ndarray:
    """The subspace at the end of a geodesic, orthonormal."""
    s, v = _eigen(tangent.T @ g @ tangent)
    s = np.sqrt(s)
    end = base @ (v * np.cos(s)) @ v.T + tangent @ (v * np.where(s > 1e-10, np.sin(s) / np.maximum(s, 1e-300), 1.0)) @ v.T
    return end @ np.linalg.inv(np.linalg.cholesky(end.T @ g @ end)).T


def _karcher(g: np.ndarray, parts: list[np.ndarray], weights: np.ndarray, rounds: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Weighted mean of subspaces: from the heaviest one along the mean tangent until that is short."""
    mean = parts[int(np.argmax(weights))]
    for _ in range(rounds):
        tangent = sum(w * _log_map(g, mean, e) for w, e in zip(weights, parts))
        mean = _exp_map(g, mean, tangent)
        if np.sqrt(max(np.trace(tangent.T @ g @ tangent), 0.0)) < tol:
            break
    return mean


def interpolate_basis(bases: DataFrame, params: list, at, method: str = "idw") -> DataFrame:
    """``dof, phi``, and ``mean`` where ``bases(dof, basis, phi[, mean])`` has one: a basis at a new parameter.

    ``params`` are numbers or vectors, as ``at`` is.  ``idw`` weighs the modes by
    inverse distance, ``spline`` by a natural cubic spline in one parameter
    (held at its ends), ``rbf`` by thin-plate radial functions; ``grassmann``
    weighs tangents at the nearest basis by inverse distance, ``karcher`` is the
    mean of the subspaces with these weights.  Means take the weights of the
    modes, inverse distances on the manifold.  All answers lie in the span of the
    stacked bases, so one Gram matrix of that stack gives them; each dof must be
    in every basis.
    """
    has_mean = "mean" in bases.columns
    fields = ["basis", "phi", *(["mean"] if has_mean else [])]
    sets = bases.groupBy("dof").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    packed = sets.select("dof", F.flatten(F.transform("s", lambda s: s["phi"])).alias("xs"), *([F.transform("s", lambda s: s["mean"]).alias("means")] if has_mean else []))
    packed = Scratch(bases.sparkSession, "interpolate").write(packed, "stack")
    g = to_matrix(gram(packed.select("dof", "xs"), center=False))
    n = len(params)
    k = len(g) // n
    part = [np.eye(len(g))[:, i * k : (i + 1) * k] for i in range(n)]
    x, to = np.asarray(params, float).reshape(n, -1), np.atleast_1d(np.asarray(at, float))
    dist = np.linalg.norm(x - to, axis=1)
    idw = 1 / (dist + 1e-10)
    weights = idw / idw.sum()
    if method == "grassmann":
        base = part[int(dist.argmin())]
        coef = _exp_map(g, base, sum(w * _log_map(g, base, e) for w, e in zip(weights, part)))
    elif method == "karcher":
        coef = _karcher(g, part, weights)
    else:
        if method == "spline":
            if x.shape[1] != 1:
                raise ValueError("a spline needs one parameter")
            weights = _spline_weights(x[:, 0], float(to[0]))
        elif method == "rbf":
            weights = _tps_weights(x, to)
        elif method != "idw":
            raise ValueError(f"no interpolation {method}")
        coef = sum(w * e for w, e in zip(weights, part))
        coef = coef @ np.linalg.inv(np.linalg.cholesky(coef.T @ g @ coef)).T
    out = apply_right(packed, coef, center=False).select("dof", "phi")
    if not has_mean:
        return out
    mean = F.aggregate(F.zip_with("means", F.array(*[F.lit(float(w)) for w in weights]), lambda m, w: m * w), F.lit(0.0), lambda a, v: a + v)
    return out.join(packed.select("dof", mean.alias("mean")), "dof").select("dof", "mean", "phi")


def _tps_weights(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weight of each value in its thin-plate interpolant with a linear tail."""
    phi = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0)
    tail = np.c_[np.ones(len(x)), x]
    apart = lambda a: np.linalg.norm(a[:, None] - x[None], axis=2)
    a = np.block([[phi(apart(x)), tail], [tail.T, np.zeros((tail.shape[1],) * 2)]])
    return (np.r_[phi(apart(at[None]))[0], 1.0, at] @ np.linalg.pinv(a))[: len(x)]


def _spline_weights(params: np.ndarray, at: float) -> np.ndarray:
    """Weight of each value in its natural cubic spline, held at the ends beyond them."""
    order = np.argsort(params)
    x, n, out = np.asarray(params, float)[order], len(params), np.zeros(len(params))
    at = float(np.clip(at, x[0], x[-1]))
    if n == 1:
        return np.ones(1)
    h = np.diff(x)
    a, r = np.eye(n), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    second = np.linalg.solve(a, r)
    j = int(np.clip(np.searchsorted(x, at) - 1, 0, n - 2))
    p, q = (x[j + 1] - at) / h[j], (at - x[j]) / h[j]
    w = p * np.eye(n)[j] + q * np.eye(n)[j + 1] + h[j] ** 2 / 6 * ((p**3 - p) * second[j] + (q**3 - q) * second[j + 1])
    out[order] = w
    return out


def leverage_sample(modes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` dofs without replacement, in proportion to their leverage; the draw depends on seed and dof alone."""
    lev = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v * v)
    u = (F.pmod(F.xxhash64(F.lit(seed), "dof"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return modes.select("dof", lev.alias("leverage")).withColumn("key", -F.log(u) / F.col("leverage")).orderBy("key", "dof").limit(n).select("dof", "leverage")


def gram_by(packed: DataFrame, key: str, weight: str | None = None, center: bool = True) -> DataFrame:
    """``key, i, j, s``: one Gram matrix for each key (field, run or parameter), all in one pass.

    ``weight`` is a column of the rows' diagonal inner product.
    """
    from fieldloom.operators.regress import group_codes

    kind = dict(packed.dtypes)[key]
    src = packed.select(key, F.col("xs").cast("array<double>").alias("xs"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def run(batches):
        total: dict = {}

        def flush(field):
            for name, g in total.items():
                i, j = np.triu_indices(len(g))
                yield pa.RecordBatch.from_pydict({key: pa.array([name] * len(i), field), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(g[i, j])})
            total.clear()

        field = None
        for b in batches:
            field = b.schema.field(0).type
            if not b.num_rows:
                continue
            x, w = _block(b.column("xs")), np.asarray(b.column("w"))
            x = x - x.mean(1, keepdims=True) if center else x
            code, first = group_codes([b.column(0)], b.num_rows)
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(first) + 1))
            for k, name in enumerate(b.column(0).take(pa.array(first)).to_pylist()):
                rows = order[cut[k] : cut[k + 1]]
                g = (x[rows] * w[rows, None]).T @ x[rows]
                total[name] = total[name] + g if name in total else g
                if len(total) * g.size > HELD:  # many keys are handed on before they fill the task's memory
                    yield from flush(field)
        yield from flush(field)

    return src.mapInArrow(run, f"`{key}` {kind}, i int, j int, s double").groupBy(key, "i", "j").agg(F.sum("s").alias("s"))


def pod_per_group(packed: DataFrame, key: str, n_modes: int, weight: str | None = None) -> DataFrame:
    """``key, mode, sigma, energy`` of each key's basis; a key's matrix is one small group."""
    kind = dict(packed.dtypes)[key]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((pdf.j.max() + 1,) * 2)
        g[pdf.i, pdf.j] = g[pdf.j, pdf.i] = pdf.s
        w = np.maximum(np.linalg.eigvalsh(g)[::-1], 0)
        k = min(n_modes, len(w))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * k, "mode": np.arange(k, dtype=np.int32), "sigma": np.sqrt(w[:k]), "energy": np.cumsum(w)[:k] / max(w.sum(), 1e-300)})

    return gram_by(packed, key, weight).groupBy(key).applyInPandas(solve, f"{key} {kind}, mode int, sigma double, energy double")


def kernel_dmd_eigenvalues(packed: DataFrame, kernel: str = "linear", gamma: float = 1.0, degree: int = 2, rank: int | None = None, reg: float = 1e-6) -> np.ndarray:
    """Eigenvalues of kernel dynamic modes; every kernel here is a function of the one Gram matrix."""
    g = to_matrix(gram(packed, center=False))
    d = np.diag(g)
    k = {"linear": lambda: g, "polynomial": lambda: (1 + g) ** degree, "rbf": lambda: np.exp(-gamma * np.maximum(d[:, None] + d[None] - 2 * g, 0))}[kernel]()
    a, c = k[:-1, :-1], k[1:, :-1]
    w, v = np.linalg.eigh(a + reg * np.eye(len(a)))
    w, v = w[::-1], v[:, ::-1]
    n = int((w > CUT**2 * w[0]).sum())
    n = min(n, rank) if rank else n
    s = np.sqrt(w[:n])
    lam = np.linalg.eigvals((v[:, :n] / s).T @ c @ (v[:, :n] / s))
    return lam[np.lexsort((lam.imag, -np.abs(lam)))]


def lift(columns: list[str], kind: str = "polynomial", degree: int = 2, centers=(), eps: float = 1.0) -> list[tuple[str, Column]]:
    """Names and columns of the state itself and its observables.

    ``polynomial``: products of up to ``degree`` columns, with repetition;
    ``rbf``: exp(-eps |x - c|^2) for each centre; ``fourier``: sines and cosines
    of the first ``degree`` multiples.
    """
    out = [(c, F.col(c)) for c in columns]
    if kind == "polynomial":
        for d in range(2, degree + 1):
            for t in combinations_with_replacement(columns, d):
                p = F.col(t[0])
                for c in t[1:]:
                    p = p * F.col(c)
                out.append(("*".join(t), p))
    elif kind == "rbf":
        out += [(f"rbf{i}", F.exp(-eps * sum((F.col(x) - float(v)) ** 2 for x, v in zip(columns, c)))) for i, c in enumerate(centers)]
    elif kind == "fourier":
        out += [(f"{f}({k}{c})", getattr(F, f)(k * F.col(c))) for c in columns for k in range(1, degree + 1) for f in ("sin", "cos")]
    else:
        raise ValueError(f"no observables {kind}")
    return out


@dataclass
class Koopman:
    operator: np.ndarray  # next observables = operator @ observables
    eigenvalues: np.ndarray  # by size
    modes: np.ndarray  # columns: right eigenvectors, each observable's share of a mode
    error: float  # relative, of the fit


def koopman_fit(pairs: DataFrame, lifted: list, lifted_next: list, rank: int | None = None) -> Koopman:
    """Least squares on lifted pairs from one pass; ``rank`` keeps the leading directions of the lifted states."""
    from fieldloom.operators.regress import gram_matrix, normal_equations, solve

    p = len(lifted)
    g = gram_matrix(normal_equations(pairs, [*lifted, *lifted_next]), 2 * p)
    if rank and rank < p:
        w, v = _eigen(g[:p, :p])
        v = v[:, :rank] / np.sqrt(np.maximum(w[:rank], 1e-300))
        k = g[p:, :p] @ v @ v.T
    else:
        k = solve(g, p).T
    rest = np.trace(g[p:, p:]) - 2 * (k.T * g[:p, p:]).sum() + np.trace(k @ g[:p, :p] @ k.T)
    lam, vec = np.linalg.eig(k)
    order = np.lexsort((lam.imag, -np.abs(lam)))[: rank or p]
    return Koopman(k, lam[order], vec[:, order], float(np.sqrt(max(rest, 0.0) / max(np.trace(g[p:, p:]), 1e-300))))


def edmd_fit(states: DataFrame, columns: list[str], by: str, step: str, kind: str = "polynomial", degree: int = 2, rank: int | None = None, **more) -> Koopman:
    """Lifted dynamics of the series ``by, step, columns``: consecutive steps are met by rank, lifted and fitted."""
    from fieldloom.operators.order import next_rows

    rows = next_rows(states.select(by, step, *columns), by, [step], [step, *columns])
    rows = rows.where(F.col(f"next_{step}") == F.col(step) + 1)
    now = [c for _, c in lift(columns, kind, degree, **more)]
    after = rows.select("*", *[c.alias(f"__now{i}") for i, c in enumerate(now)]).drop(*columns).withColumnsRenamed({f"next_{c}": c for c in columns})
    return koopman_fit(after, [F.col(f"__now{i}") for i in range(len(now))], now, rank)
