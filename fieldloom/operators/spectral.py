"""Smallest eigenpairs of a graph Laplacian, and what is built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.graph import laplacian, symmetric
from fieldloom.operators.order import quantiles
from fieldloom.sources.scratch import Scratch


#: Pairs of a bucket of the matrix.
BUCKET = 2_000_000


def _columns(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def _product(lap: DataFrame, x: DataFrame, cols: list[str]) -> DataFrame:
    """The matrix times a block of vectors ``row, v0, v1, ...``."""
    return lap.join(x.withColumnRenamed("row", "col"), "col").groupBy("row").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in cols])


def _gram(a: DataFrame, b: DataFrame, cols: list[str]) -> np.ndarray:
    """k x k inner products of two blocks; one row reaches the driver."""
    j = a.join(b.withColumnsRenamed({c: f"w_{c}" for c in cols}), "row")
    r = j.agg(*[F.sum(F.col(p) * F.col(f"w_{q}")).alias(f"{p}_{q}") for p in cols for q in cols]).first()
    return np.array([[r[f"{p}_{q}"] or 0.0 for q in cols] for p in cols])


def _mix(x: DataFrame, m: np.ndarray, cols: list[str]) -> DataFrame:
    return x.select("row", *[sum((float(m[i, j]) * F.col(c) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"v{j}") for j in range(m.shape[1])])


def smallest_modes(lap: DataFrame, n_modes: int, rounds: int = 6, degree: int = 8, tol: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues and ``row, v0, v1, ...`` of the smallest eigenpairs of a symmetric matrix with spectrum in [0, 2].

    Chebyshev-filtered subspace iteration: a round multiplies a block of n_modes
    + 4 vectors ``degree`` times (one join and one grouped sum each), which damps
    the part of the spectrum above the block, and solves the small projected
    problem on the driver.  Vectors stay distributed; each round is a written
    table.  It ends when the wanted eigenvalues move less than ``tol``.
    """
    tmp, k = Scratch(lap.sparkSession, "modes"), n_modes + 4
    cols = _columns(k)
    lap = tmp.write(lap, "matrix")
    rows = lap.select("row").distinct()
    k = min(k, rows.count())
    cols, n_modes = _columns(k), min(n_modes, k)
    x = tmp.write(rows.select("row", *[((F.pmod(F.xxhash64("row", F.lit(i)), F.lit(20001)) - 10000) / 10000.0).alias(c) for i, c in enumerate(cols)]), "start")
    cut, last, w = 1.0, None, np.zeros(k)
    for _ in range(rounds):
        lo, hi = cut, 2.0001
        mid, half = (hi + lo) / 2, (hi - lo) / 2
        step = lambda v: _product(lap, v, cols).withColumnsRenamed({c: f"l_{c}" for c in cols})
        old, now = x, tmp.write(step(x).join(x, "row").select("row", *[((F.col(f"l_{c}") - mid * F.col(c)) / half).alias(c) for c in cols]), "filtered")
        for _ in range(degree - 1):
            t = step(now).join(now, "row").join(old.withColumnsRenamed({c: f"o_{c}" for c in cols}), "row")
            after = tmp.write(t.select("row", *[(2 * (F.col(f"l_{c}") - mid * F.col(c)) / half - F.col(f"o_{c}")).alias(c) for c in cols]), "filtered")
            tmp.drop(old)
            old, now = now, after
        g = _gram(now, now, cols)
        d = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        e, v = np.linalg.eigh(g * np.outer(d, d))
        base = d[:, None] * v / np.sqrt(np.maximum(e, 1e-14 * e[-1]))
        ortho = tmp.write(_mix(now, base, cols), "basis")
        small = _gram(ortho, _product(lap, ortho, cols), cols)
        w, v = np.linalg.eigh((small + small.T) / 2)
        x = tmp.write(_mix(ortho, v, cols), "modes")
        tmp.drop(now, old, ortho)
        cut = float(min(max(w[-1], 1e-3), 1.9))
        if last is not None and np.abs(w[:n_modes] - last).max() < tol:
            break
        last = w[:n_modes]
    return w[:n_modes], x.select("row", *cols[:n_modes])


def heat_signature(values: np.ndarray, modes: DataFrame, n_times: int = 8) -> DataFrame:
    """``row, signature``: sums of squared modes times exp(-t lambda) at times spaced evenly in logarithm."""
    some = values[values > 1e-8]
    lo, hi = (4 * np.log(10) / some.max(), 4 * np.log(10) / some.min()) if len(some) else (1.0, 1.0)
    at = np.geomspace(lo, hi, n_times)
    sums = [sum((F.col(f"v{i}") ** 2 * float(np.exp(-t * w)) for i, w in enumerate(values)), F.lit(0.0)) for t in at]
    return modes.select("row", F.array(*sums).alias("signature"))


def spectral_project(field: DataFrame, modes: DataFrame, n_modes: int) -> np.ndarray:
    """Coefficients of ``field(row, value)`` on the modes; one row reaches the driver."""
    r = field.join(modes, "row").agg(*[F.sum(F.col("value") * F.col(f"v{i}")).alias(f"v{i}") for i in range(n_modes)]).first()
    return np.array([r[f"v{i}"] or 0.0 for i in range(n_modes)])


def spectral_reconstruct(coefs: np.ndarray, modes: DataFrame) -> DataFrame:
    return modes.select("row", sum((float(c) * F.col(f"v{i}") for i, c in enumerate(coefs)), F.lit(0.0)).alias("value"))


def _grams(j: DataFrame, cols: list[str]) -> dict[int, np.ndarray]:
    """k x k inner products of the blocks ``v0, v1, ...`` and ``w_v0, w_v1, ...`` in each part; one row a part reaches the driver."""
    sums = j.groupBy("part").agg(F.array(*[F.sum(F.col(p) * F.col(f"w_{q}")) for p in cols for q in cols]).alias("g"))
    return {r.part: np.array(r.g, float).reshape(len(cols), -1) for r in sums.collect()}


def _mix_parts(x: DataFrame, mats: dict[int, np.ndarray], cols: list[str]) -> DataFrame:
    """Each part's block times its own small matrix."""
    k = len(cols)
    table = x.sparkSession.createDataFrame([(int(p), m.T.ravel().tolist()) for p, m in mats.items()], "part int, m array<double>")
    dot = lambda j: F.aggregate(F.zip_with(F.array(*cols), F.slice("m", j * k + 1, k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.join(F.broadcast(table), "part").select("row", "part", *[dot(j).alias(f"v{j}") for j in range(k)])  # one row a part


def modes_by_part(edges: DataFrame, n_modes: int, rounds: int = 4, degree: int = 6, tol: float = 1e-3) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Smallest eigenvalues by part and ``row, part, v0, v1, ...`` of the Laplacians of all parts' graphs at once.

    ``edges(src, dst, weight, part)`` hold each pair once and join nodes of one part.
    The matrix of all parts is block diagonal, so one product serves all of them;
    inner products, small eigenproblems and the filter's bounds are each part's own.
    The number of joins does not depend on the number of parts.  The matrix lies in
    buckets of its columns, so a product shuffles vectors and sums alone; blocks of
    vectors are met by merge joins, since each broadcast would pass through the driver.
    A part whose whole space fits the block is not filtered.
    """
    tmp, k = Scratch(edges.sparkSession, "parts"), n_modes + 4
    cols = _columns(k)
    lap = tmp.bucketed(laplacian(edges.select("src", "dst", "weight")), "matrix", "col", 1 + edges.count() // BUCKET)
    rows = edges.select(F.col("src").alias("row"), "part").unionByName(edges.select(F.col("dst").alias("row"), "part")).distinct()
    x = tmp.write(rows.select("row", "part", *[((F.pmod(F.xxhash64("row", F.lit(i)), F.lit(20001)) - 10000) / 10000.0).alias(c) for i, c in enumerate(cols)]), "start")
    size = {r.part: r["count"] for r in x.groupBy("part").count().collect()}  # one row a part
    cut = dict.fromkeys(size, 1.0)
    last: dict[int, np.ndarray] = {}
    values: dict[int, np.ndarray] = {}
    product = lambda v: _product(lap, v.select("row", *cols).hint("merge"), cols).withColumnsRenamed({c: f"w_{c}" for c in cols})
    for _ in range(rounds):
        # Centre and half width of what is damped; (lambda + 1e6) / 1e6 is 1, so such a filter leaves all directions.
        span = [(int(p), -1e6, 1e6) if n <= k else (int(p), (2.0001 + cut[p]) / 2, (2.0001 - cut[p]) / 2) for p, n in size.items()]
        bound = x.sparkSession.createDataFrame(span, "part int, mid double, half double")
        now = x.join(F.broadcast(bound), "part")  # one row a part
        for at in range(degree):
            t = now.join(product(now).hint("merge"), "row")
            shift = lambda c: (F.col(f"w_{c}") - F.col("mid") * F.col(c)) / F.col("half")
            new = [shift(c) if at == 0 else 2 * shift(c) - F.col(f"o_{c}") for c in cols]
            after = tmp.write(t.select("row", "part", "mid", "half", *[v.alias(c) for v, c in zip(new, cols)], *[F.col(c).alias(f"o_{c}") for c in cols]), "filtered")
            tmp.drop(now)
            now = after
        base, dead = {}, {}
        for p, g in _grams(now.select("part", *cols, *[F.col(c).alias(f"w_{c}") for c in cols]), cols).items():
            d = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
            e, v = np.linalg.eigh(g * np.outer(d, d))
            dead[p] = np.arange(k) < k - size[p]  # a part of few nodes has fewer directions than the block
            base[p] = np.where(dead[p], 0.0, d[:, None] * v / np.sqrt(np.maximum(e, 1e-14 * e[-1])))
        ortho = tmp.write(_mix_parts(now, base, cols), "basis")
        turn = {}
        for p, small in _grams(ortho.join(product(ortho).hint("merge"), "row"), cols).items():
            w, v = np.linalg.eigh((small + small.T) / 2 + np.diag(np.where(dead[p], 10.0, 0.0)))
            values[p], turn[p] = w[:n_modes], v
            cut[p] = float(min(max(w[~(w > 5)][-1], 1e-3), 1.9))
        tmp.drop(x)
        x = tmp.write(_mix_parts(ortho, turn, cols), "modes")
        tmp.drop(now, ortho)
        if last and all(np.abs(values[p] - last[p]).max() < tol for p in values):
            break
        last = dict(values)
    tmp.drop(lap)
    return values, x.select("row", "part", *cols[:n_modes])


def spectral_bisect(edges: DataFrame, n_parts: int = 2, rounds: int = 4) -> DataFrame:
    """``id, part``: nodes above and at most at the median of the second mode, again within each half.

    All parts of a level are solved together (``modes_by_part``), so the work is
    log2(n_parts) solves.  Parts split n // 2 : rest while nodes always halve, so
    a number that is not a power of two is unbalanced.  A part is split by its own
    graph; nodes without an edge inside their part stay in its first half.
    """
    tmp = Scratch(edges.sparkSession, "bisect")
    both = tmp.write(symmetric(edges).where("src < dst"), "edges")
    nodes = both.select(F.col("src").alias("id")).unionByName(both.select(F.col("dst").alias("id"))).distinct()
    lab = tmp.write(nodes.select("id", F.lit(0).alias("part"), F.lit(n_parts).alias("n")), "labels")
    for _ in range((n_parts - 1).bit_length()):
        open_ = lab.where("n > 1")
        inside = both.join(open_.select(F.col("id").alias("src"), "part"), "src").join(open_.select(F.col("id").alias("dst"), F.col("part").alias("other")), "dst").where("part = other")
        inside = tmp.write(inside.select("src", "dst", "weight", "part"), "inside")
        half = F.floor(F.col("n") / 2).cast("int")
        if inside.isEmpty():
            high = None
        else:
            _, modes = modes_by_part(inside, 2, rounds)
            second = tmp.write(modes.select(F.col("row").alias("id"), "part", F.round("v1", 9).alias("v")), "second")
            mid = quantiles(second, "v", [0.5], ["part"]).select("part", F.col("q0").alias("mid"))
            high = second.join(F.broadcast(mid), "part").where("v > mid").select("id", F.lit(True).alias("high"))  # one row a part
        now = lab.withColumn("high", F.lit(False)) if high is None else lab.join(high, "id", "left").withColumn("high", F.coalesce("high", F.lit(False)))
        new = now.select("id", F.when(F.col("high"), F.col("part") + half).otherwise(F.col("part")).cast("int").alias("part"), F.when(F.col("n") <= 1, F.col("n")).when(F.col("high"), F.col("n") - half).otherwise(half).cast("int").alias("n"))
        new = tmp.write(new, "labels")
        tmp.drop(lab, inside)
        lab = new
    return lab.select("id", "part")
