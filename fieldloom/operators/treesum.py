"""Sums of a kernel over all points of a table, by a tree of boxes with bounded error.

The support is cut into boxes at medians, as for nearest neighbours.  A box and a
query that are far from each other meet through a few moments of the box; the
error of that expansion is bounded for each unit of weight, and a box counts as
far where the bound is at most the tolerance.  Boxes that are never far enough
are met point by point, in blocks.  So the sums of n queries over m points take
about n log m expansions and n near boxes, and the total error is at most the
tolerance times the sum of the weights' sizes.  Points of one place are one point
of their summed weights, and queries of one place are answered once, so n and m
are numbers of distinct places.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.spatial import BLOCK, MAX_LEAVES, PER_LEAF, _Boxes, _coordinates
from fieldloom.sources.scratch import Scratch

#: Points of a box, about.
PER_BOX = 64


class Gaussian:
    """exp(-eps |x - y|^2) for each column of weights, by Taylor expansion of second order about the box's middle."""

    def __init__(self, eps: float, d: int, columns: int):
        self.eps, self.d, self.columns, self.weights = eps, d, columns, columns
        self.pairs = [(i, j) for i in range(d) for j in range(i, d)]
        self.each = 1 + d + len(self.pairs)

    def moments(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One row a point; rows add up."""
        base = np.concatenate([np.ones((len(h), 1)), h, np.stack([h[:, i] * h[:, j] for i, j in self.pairs], 1)], 1)
        return (w[:, :, None] * base[:, None]).reshape(len(h), -1)

    def shift(self, m: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Moments about a middle from which the old one lies at ``by``."""
        m, d = m.reshape(len(m), self.columns, self.each), self.d
        out = m.copy()
        zero, one = m[:, :, 0], m[:, :, 1 : 1 + d]
        out[:, :, 1 : 1 + d] += zero[:, :, None] * by[:, None]
        for k, (i, j) in enumerate(self.pairs):
            out[:, :, 1 + d + k] += one[:, :, i] * by[:, None, j] + one[:, :, j] * by[:, None, i] + zero * (by[:, i] * by[:, j])[:, None]
        return out.reshape(len(m), -1)

    def far(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        m, e = m.reshape(len(m), self.columns, self.each), self.eps
        s = m[:, :, 0] + 2 * e * (m[:, :, 1 : 1 + self.d] * v[:, None]).sum(2)
        for k, (i, j) in enumerate(self.pairs):
            s = s + (2 * e * e * (1 if i == j else 2) * v[:, i] * v[:, j] - (e if i == j else 0.0))[:, None] * m[:, :, 1 + self.d + k]
        return np.exp(-e * (v**2).sum(1))[:, None] * s

    def error(self, v: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bound of the third-order remainder by Cramer's inequality for Hermite functions."""
        near = np.maximum(np.linalg.norm(v, axis=1) - radius, 0.0)
        return 1.0865 * (2 * self.eps) ** 1.5 * radius**3 / math.sqrt(6) * np.exp(-self.eps * near**2 / 2)

    def direct(self, q: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.exp(-self.eps * sum((q[:, None, i] - x[None, :, i]) ** 2 for i in range(self.d))) @ w


class Logarithm:
    """Real part of Q log(z - c) over complex weights Q (two columns) in the plane, by a multipole expansion."""

    columns, weights, order = 1, 2, 10

    def moments(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = (w[:, 0] + 1j * w[:, 1])[:, None] * (h[:, 0] + 1j * h[:, 1])[:, None] ** np.arange(self.order + 1)
        return np.concatenate([m.real, m.imag], 1)

    def shift(self, m: np.ndarray, by: np.ndarray) -> np.ndarray:
        k = self.order + 1
        m, b = m[:, :k] + 1j * m[:, k:], by[:, 0] + 1j * by[:, 1]
        out = np.stack([sum(math.comb(n, j) * m[:, j] * b ** (n - j) for j in range(n + 1)) for n in range(k)], 1)
        return np.concatenate([out.real, out.imag], 1)

    def far(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        k = self.order + 1
        m, z = m[:, :k] + 1j * m[:, k:], v[:, 0] + 1j * v[:, 1]
        s = m[:, 0] * np.log(z)
        for n in range(1, k):
            s = s - m[:, n] / (n * z**n)
        return s.real[:, None]

    def error(self, v: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bound of the series' rest; infinite where points of the box lie on both sides of the angle's cut."""
        far = np.linalg.norm(v, axis=1)
        ratio = radius / np.maximum(far, 1e-300)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            rest = ratio ** (self.order + 1) / ((self.order + 1) * (1 - ratio)) + 1e-10 / np.maximum(far - radius, 1e-300)
        cut = (np.abs(v[:, 1]) <= radius) & (v[:, 0] <= radius)
        return np.where((ratio >= 1) | cut, np.inf, rest)

    def direct(self, q: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        dx, dy = q[:, None, 0] - x[None, :, 0], q[:, None, 1] - x[None, :, 1]
        return (np.log(np.sqrt(dx * dx + dy * dy) + 1e-10) @ w[:, 0] - np.arctan2(dy, dx) @ w[:, 1])[:, None]


def _middles(boxes: _Boxes) -> None:
    """Middle and radius of every box that holds points."""
    some = boxes.count > 0
    with np.errstate(invalid="ignore"):
        boxes.middle = np.where(some[:, None], (boxes.low + boxes.high) / 2, 0.0)
        boxes.radius = np.where(some, np.linalg.norm(np.where(some[:, None], boxes.high - boxes.low, 0.0), axis=1) / 2, 0.0)


def tree_sums(query: DataFrame, support: DataFrame, kernel, d: int, tolerance: float) -> DataFrame:
    """``id, s array<double>``: each query's kernel sums over ``support(p, w array<double>)``.

    ``query(id, p)`` holds distinct whole ids.  Rows without finite coordinates or
    weights are left out of the support; such queries get no row.  An empty support
    sums up to zeros.
    """
    spark = query.sparkSession
    tmp = Scratch(spark, "treesum")
    p = lambda i: F.col("p")[i]
    sound = F.col("p").isNotNull() & (F.size("p") >= d)
    for i in range(d):
        sound = sound & p(i).isNotNull() & ~F.isnan(p(i)) & (F.abs(p(i)) < float("inf"))
    place_of = [p(i).cast("double").alias(f"c{i}") for i in range(d)]
    at, spot = [f"c{i}" for i in range(d)], F.array(*[f"c{i}" for i in range(d)]).alias("p")
    held = support.where(sound & F.col("w").isNotNull() & ~F.exists("w", lambda v: v.isNull() | F.isnan(v))).select(*place_of, F.col("w").cast("array<double>").alias("w"))
    held = held.groupBy(*at).agg(*[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(kernel.weights)])
    held = tmp.write(held.select(spot, F.array(*[f"w{i}" for i in range(kernel.weights)]).alias("w")), "support")
    every_ask = query.where(sound).select(F.col("id").cast("long").alias("id"), *place_of)
    places = tmp.write(every_ask.groupBy(*at).agg(F.min("id").alias("id")), "places")
    asked = places.select("id", spot)
    n = held.count()
    if not n:
        return every_ask.select("id", F.array_repeat(F.lit(0.0), kernel.columns).alias("s"))
    depth = max(0, min(MAX_LEAVES, n // PER_BOX).bit_length() - 1)
    sample = held.where(F.pmod(F.xxhash64("p", "w"), F.lit(n)) < PER_LEAF << depth).select("p").limit(4 * PER_LEAF << depth).toPandas()  # some rows a box
    boxes = _Boxes(np.array(sample.p.tolist(), float).reshape(len(sample), -1)[:, :d] if len(sample) else np.empty((0, d)), depth)
    cuts = spark.sparkContext.broadcast(boxes)

    def place(batches):
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(cuts.value.leaf(_coordinates(t.column(0), d)), pa.int64())], names=["p", "w", "leaf"])

    placed = tmp.write(held.mapInArrow(place, "p array<double>, w array<double>, leaf long"), "placed")
    ends = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(p(i)).alias(f"{m}{i}") for m, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]).toPandas()  # MAX_LEAVES rows at most
    boxes.fill(ends.leaf.to_numpy(np.int64), ends.n.to_numpy(np.int64), *(ends[[f"{m}{i}" for i in range(d)]].to_numpy(float).reshape(-1, d) for m in ("lo", "hi")))
    _middles(boxes)
    full = spark.sparkContext.broadcast(boxes)
    weights = lambda col: np.asarray(pc.list_flatten(col), float).reshape(len(col), -1)
    size = kernel.moments(np.zeros((1, d)), np.zeros((1, kernel.weights))).shape[1]

    def sums(batches):
        for t in batches:
            if t.num_rows:
                leaf = np.asarray(t.column("leaf"))
                m = kernel.moments(_coordinates(t.column("p"), d) - full.value.middle[leaf + full.value.inner], weights(t.column("w")))
                of, at = np.unique(leaf, return_inverse=True)
                total = np.zeros((len(of), size))
                np.add.at(total, at, m)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *[pa.array(c) for c in total.T]], names=["leaf", *[f"m{k}" for k in range(size)]])

    got = placed.mapInArrow(sums, "leaf long, " + ", ".join(f"m{k} double" for k in range(size))).groupBy("leaf").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(size)]).toPandas()  # MAX_LEAVES rows at most
    boxes.moments = np.zeros((len(boxes.count), size))
    boxes.moments[got.leaf.to_numpy(np.int64) + boxes.inner] = got[[f"m{k}" for k in range(size)]].to_numpy(float)
    for level in range(depth - 1, -1, -1):
        i = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
        boxes.moments[i] = sum(kernel.shift(boxes.moments[c], boxes.middle[c] - boxes.middle[i]) for c in (2 * i + 1, 2 * i + 2))
    full = spark.sparkContext.broadcast(boxes)

    def expand(batches):
        tree = full.value
        for t in batches:
            for at in range(0, t.num_rows, 2_000):
                s = t.slice(at, 2_000)
                x, total = _coordinates(s.column("p"), d), np.zeros((s.num_rows, kernel.columns))
                row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
                for level in range(depth + 1):
                    some = tree.count[node] > 0
                    row, node = row[some], node[some]
                    v = x[row] - tree.middle[node]
                    far = kernel.error(v, tree.radius[node]) <= tolerance
                    np.add.at(total, row[far], kernel.far(v[far], tree.moments[node[far]]))
                    row, node = row[~far], node[~far]
                    if level < depth:
                        row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
                every = pa.array(np.concatenate([np.arange(len(x)), row]))
                leaf = pa.array(np.concatenate([np.full(len(x), -1), node - tree.inner]), pa.int64())
                far_sums = pa.concat_arrays([pa.array(list(total), pa.list_(pa.float64())), pa.nulls(len(row), pa.list_(pa.float64()))])
                yield pa.RecordBatch.from_arrays([s.column("id").take(every), s.column("p").take(every), leaf, far_sums], names=["id", "p", "leaf", "s"])

    met = tmp.write(asked.mapInArrow(expand, "id long, p array<double>, leaf long, s array<double>"), "met")
    near = met.where("leaf >= 0").select("id", "p", "leaf")
    load = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("ni")).join(near.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("nq")), "leaf")
    load = F.broadcast(tmp.write(load, "load"))  # MAX_LEAVES rows at most
    spots = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = near.join(load, "leaf").select("leaf", spots("ni").alias("ib"), F.pmod(F.xxhash64("id"), "nq").alias("qb"), "id", "p", F.lit(None).cast("array<double>").alias("w"))
    right = placed.join(load, "leaf").select("leaf", F.pmod(F.xxhash64("p", "w"), "ni").alias("ib"), spots("nq").alias("qb"), F.lit(None).cast("long").alias("id"), "p", "w")

    def direct(tab: pa.Table) -> pa.Table:
        asks = np.asarray(pc.is_valid(tab.column("id")))
        x, q = tab.filter(pa.array(~asks)).combine_chunks(), tab.filter(pa.array(asks)).combine_chunks()
        points = _coordinates(x.column("p").combine_chunks(), d)
        w, at = weights(x.column("w").combine_chunks()) if len(points) else np.zeros((0, kernel.weights)), _coordinates(q.column("p").combine_chunks(), d)
        out = [kernel.direct(at[k : k + 500], points, w) for k in range(0, len(at), 500)]
        return pa.table({"id": q.column("id"), "s": pa.array(list(np.concatenate(out)) if out else [], pa.list_(pa.float64()))})

    some = left.unionByName(right).groupBy("leaf", "ib", "qb").applyInArrow(direct, "id long, s array<double>")
    every = met.where("leaf < 0").select("id", "s").unionByName(some)
    sums = every.groupBy("id").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(kernel.columns)]).alias("s"))
    sums = tmp.write(places.join(sums, "id").select(*at, "s"), "sums")
    return every_ask.join(sums, at).select("id", "s")
