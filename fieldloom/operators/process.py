"""A Gaussian process on all of its training rows, whatever their number.

The squared-exponential kernel is nothing beside the noise between points further
apart than ``reach`` lengths.  Training places are cut into slabs of twice that
width along one axis, so a slab's covariance meets only the next slab's: the
matrix is block tridiagonal, and what other slabs add to a slab is one matrix and
one vector from either side.  Runs of slabs are condensed to their first slabs in
parallel, these are swept in both directions, and each run then passes the sums on
to its own slabs, where candidates are scored.  Nothing is drawn or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.order import dense_ids
from fieldloom.sources.scratch import Scratch

#: Candidate places of one group.
PLACES = 20_000
EPS = 2.0**-52
_TRAIN, _LEFT, _RIGHT, _ASK = range(4)


def lower_inverse(c: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix by halves.

    Products instead of one large solve: threaded solves of some BLAS builds never
    return in a process that has forked, as a driver has.
    """
    n = len(c)
    if n <= 32:
        return np.linalg.solve(c, np.eye(n)) if n else c
    h = n // 2
    a, b = lower_inverse(c[:h, :h]), lower_inverse(c[h:, h:])
    return np.block([[a, np.zeros((h, n - h))], [-b @ c[h:, :h] @ a, b]])


def reach(noise: float) -> float:
    """Distance in lengths beyond which the kernel is less than a rounding error of the noise."""
    return sqrt(-2 * log(EPS * min(max(noise, EPS), 1.0)))


def finite(p: Column) -> Column:
    return p.isNotNull() & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


class _Slab:
    """Places of a slab in a fixed order: coordinates, mean values, noises of these means, covariance."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: np.ndarray, length: float):
        order = np.lexsort(x.T)
        self.x, self.y, self.length = x[order], y[order], length
        self.k = self.cross(self) + np.diag(s[order])

    def cross(self, other: _Slab) -> np.ndarray:
        return kernel(self.x, other.x, self.length)


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    d2 = 0.0
    for i in range(a.shape[1]):
        d2 = d2 + (a[:, i, None] - b[None, :, i]) ** 2
    return np.exp(-0.5 * d2 / length**2)


def _slabs(tab: pa.Table, length: float) -> list[_Slab]:
    rank, rows = np.asarray(tab.column("rank")), tab.num_rows
    x = np.asarray(tab.column("p").combine_chunks().flatten(), float).reshape(rows, -1)
    y, s = np.asarray(tab.column("y")), np.asarray(tab.column("s"))
    return [_Slab(x[rank == r], y[rank == r], s[rank == r], length) for r in np.unique(rank)]


class _Message:
    """What the slabs beyond take from a slab's covariance and values."""

    def __init__(self, m: np.ndarray, e: np.ndarray):
        self.m, self.e = m, e

    @classmethod
    def none(cls, n: int) -> _Message:
        return cls(np.zeros((n, n)), np.zeros(n))

    @classmethod
    def read(cls, v: np.ndarray) -> _Message:
        n = (int(sqrt(4 * len(v) + 1)) - 1) // 2
        return cls(v[: n * n].reshape(n, n), v[n * n :])

    def flat(self) -> np.ndarray:
        return np.r_[self.m.ravel(), self.e]

    def __add__(self, other: _Message) -> _Message:
        return _Message(self.m + other.m, self.e + other.e)


class _Solved:
    """Inverse factor of a slab's covariance less its messages, and its values by it."""

    def __init__(self, k: np.ndarray, y: np.ndarray, less: _Message):
        self.inverse = lower_inverse(np.linalg.cholesky(k - less.m))
        self.z = self.inverse @ (y - less.e)
        #: Its part in the log marginal likelihood.
        self.log = float(np.log(np.diag(self.inverse)).sum() - 0.5 * self.z @ self.z)

    def to(self, cross: np.ndarray) -> _Message:
        w = self.inverse @ cross
        return _Message(w.T @ w, w.T @ self.z)


def _condensed(slabs: list[_Slab], after: bool) -> tuple[_Message, _Message, np.ndarray, float]:
    """A run without its inner slabs: messages to its first slab and to the next run's, the two slabs' coupling, the log part.

    ``after`` tells that the last slab is the next run's first.
    """
    first, inner = slabs[0], slabs[1 : len(slabs) - after]
    here, ahead, total = _Message.none(len(first.y)), _Message.none(len(slabs[-1].y)), 0.0
    into, far = None, (slabs[1].cross(first) if len(slabs) > 1 else np.zeros((0, len(first.y))))
    for at, slab in enumerate(inner, 1):
        got = _Solved(slab.k, slab.y, into or _Message.none(len(slab.y)))
        total += got.log
        f = got.inverse @ far
        here = here + _Message(f.T @ f, f.T @ got.z)
        if at + 1 < len(slabs):
            w = got.inverse @ slab.cross(slabs[at + 1])
            into, far = _Message(w.T @ w, w.T @ got.z), -w.T @ f
    return here, (into or ahead) if after else _Message.none(0), far if after else np.zeros((0, len(first.y))), total


def _swept(first: list[_Slab], here: list[_Message], ahead: list[_Message], far: list[np.ndarray]) -> tuple[list[_Message], list[_Message], float]:
    """Messages to the runs' first slabs from all slabs before and from all after them, and the log part."""
    n, total = len(first), 0.0
    left, right = [_Message.none(len(first[0].y))], [here[-1]]
    for c in range(n):
        got = _Solved(first[c].k, first[c].y, here[c] + left[c])
        total += got.log
        if c + 1 < n:
            left.append(ahead[c] + got.to(far[c].T))
    for c in range(n - 2, -1, -1):
        right.append(here[c] + _Solved(first[c + 1].k, first[c + 1].y, ahead[c] + right[-1]).to(far[c]))
    return left, right[::-1], total


def _scores(slabs: list[_Slab], left: _Message | None, right: _Message | None, rank: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances at the places ``x``, each seen by the slab of its ``rank`` (from 0) and the next one."""
    n = len(slabs)
    before = [left or _Message.none(len(slabs[0].y))]
    for a, b in zip(slabs, slabs[1:]):
        before.append(_Solved(a.k, a.y, before[-1]).to(a.cross(b)))
    behind = [right or _Message.none(len(slabs[-1].y))]
    for a, b in zip(slabs[::-1], slabs[-2::-1]):
        behind.append(_Solved(a.k, a.y, behind[-1]).to(a.cross(b)))
    behind = behind[::-1]
    mean, var, length = np.zeros(len(x)), np.ones(len(x)), slabs[0].length
    for r in np.unique(rank):
        a = slabs[r]
        k, y, px = a.k - before[r].m, a.y - before[r].e, a.x
        if r + 1 < n:
            b, c = slabs[r + 1], a.cross(slabs[r + 1])
            k = np.block([[k, c], [c.T, b.k - behind[r + 1].m]])
            y, px = np.r_[y, b.y - behind[r + 1].e], np.vstack([px, b.x])
        got = _Solved(k, y, _Message.none(len(y)))
        rows = np.flatnonzero(rank == r)
        for at in range(0, len(rows), 500):
            i = rows[at : at + 500]
            v = kernel(x[i], px, length) @ got.inverse.T
            mean[i], var[i] = v @ got.z, 1 - (v * v).sum(1)
    return mean, var


class SlabProcess:
    """A squared-exponential process on every training row ``p, y``; rows without finite coordinates or value observe nothing.

    Rows of one place are one observation of their mean with that much less noise,
    which changes no prediction.  The axis is the one whose fullest slab holds the
    fewest places; a task holds the square of a slab's places for each slab of a
    run (about the root of the number of slabs), so points that are dense along
    every axis need tasks of that size.
    """

    def __init__(self, train: DataFrame, length: float, noise: float):
        self.spark, self.length, self.noise, self.width = train.sparkSession, length, noise, 2 * reach(noise) * length
        self.tmp = Scratch(self.spark, "process")
        rows = train.select(F.col("p").cast("array<double>").alias("p"), F.col("y").cast("double").alias("y")).where(finite(F.col("p")) & finite(F.array("y")))
        places = self.tmp.write(rows.groupBy("p").agg(F.avg("y").alias("y"), F.count("*").alias("n"), F.var_pop("y").alias("spread")), "observed")
        load = places.select(F.posexplode("p").alias("axis", "v")).groupBy("axis", F.floor(F.col("v") / self.width).alias("slab")).count()
        load = load.groupBy("axis").agg(F.max("count").alias("most"), F.count("*").alias("slabs")).orderBy("most", "axis").first()  # one row an axis
        self.axis, self.slabs = (load.axis, load.slabs) if load else (0, 0)
        self.run = max(1, ceil(sqrt(self.slabs)))
        #: Runs; the last one may be shorter.
        self.runs = -(-self.slabs // self.run)
        self.places, self._sums = places, None
        if self.slabs:
            slab = places.withColumn("slab", F.floor(F.col("p")[self.axis] / self.width))
            self.ranks = dense_ids(slab.select("slab").distinct(), ["slab"], "rank", 0, self.tmp)
            own = slab.join(self.ranks, "slab").select("rank", "p", "y", (noise / F.col("n")).alias("s"), F.floor(F.col("rank") / self.run).alias("own"))
            run = F.explode(F.when((F.col("rank") % self.run == 0) & (F.col("own") > 0), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))).alias("run")
            #: Each run's places, and those of the next run's first slab.
            self.members = self.tmp.write(own.select(run, "rank", "p", "y", "s"), "members")

    def _messages(self) -> DataFrame:
        """``run, kind, v, log``: for each run the messages to its first slab from before and to the next run's first from behind."""
        if self._sums is not None:
            return self._sums
        length, step = self.length, self.run

        def condense(key: tuple, tab: pa.Table) -> pa.Table:
            run = key[0].as_py()
            here, ahead, far, total = _condensed(_slabs(tab, length), bool((np.asarray(tab.column("rank")) == (run + 1) * step).any()))
            parts = [here.flat(), ahead.flat(), far.ravel()]
            return pa.table({"run": pa.array([run]), **{c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(("here", "ahead", "far"), parts)}, "log": pa.array([total])})

        parts = self.tmp.write(self.members.groupBy("run").applyInArrow(condense, "run long, here array<double>, ahead array<double>, far array<double>, log double"), "condensed")
        first = self.members.where(F.col("rank") == F.col("run") * step)
        # A row for each run: about the root of the number of slabs meets here.
        first = first.groupBy("run").agg(F.collect_list(F.struct("p", "y", "s")).alias("of"))
        rows = first.join(parts, "run").select(F.lit(0).alias("all"), "run", F.flatten("of.p").alias("p"), F.col("of.y").alias("y"), F.col("of.s").alias("s"), "here", "ahead", "far", "log")

        def sweep(tab: pa.Table) -> pa.Table:
            tab = tab.sort_by("run")
            col = lambda c: [np.asarray(v.values, float) for v in tab.column(c)]
            first = [_Slab(p.reshape(len(y), -1), y, s, length) for p, y, s in zip(col("p"), col("y"), col("s"))]
            sizes = [len(f.y) for f in first]
            far = [f.reshape(-1, n) for f, n in zip(col("far"), sizes)]
            left, right, total = _swept(first, [_Message.read(v) for v in col("here")], [_Message.read(v) for v in col("ahead")], far)
            n = len(first)
            total += float(np.sum(tab.column("log")))
            return pa.table({
                "run": pa.array([*range(n), *range(n - 1)], pa.int64()),
                "kind": pa.array([_LEFT] * n + [_RIGHT] * (n - 1), pa.int32()),
                "v": pa.array([m.flat() for m in (*left, *right[1:])], pa.list_(pa.float64())),
                "log": pa.array([total] + [0.0] * (2 * n - 2)),
            })

        self._sums = self.tmp.write(rows.groupBy("all").applyInArrow(sweep, "run long, kind int, v array<double>, log double"), "messages")
        return self._sums

    def score(self, asked: DataFrame) -> DataFrame:
        """``p, mean, std`` at distinct places ``p``; without finite coordinates they are not numbers."""
        sound = finite(F.col("p"))
        nothing = asked.select("p", F.when(sound, 0.0).otherwise(float("nan")).alias("mean"), F.when(sound, 1.0).otherwise(float("nan")).alias("std"))
        if not self.slabs:
            return nothing
        length, step = self.length, self.run
        # A place sees the slab of its half and the next one: what is further off is beyond the reach.
        seen = F.floor(F.col("p")[self.axis] / self.width - 0.5)
        near = self.ranks.select(F.explode(F.array(F.col("slab"), F.col("slab") - 1)).alias("seen"), "rank").groupBy("seen").agg(F.min("rank").alias("rank"))
        placed = self.tmp.write(asked.withColumn("seen", F.when(sound, seen)).join(near, "seen", "left").select("p", "rank", F.floor(F.col("rank") / step).alias("run")), "asked")
        load = placed.where("run is not null").groupBy("run").agg(F.ceil(F.count("*") / PLACES).alias("blocks"))
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        none = F.lit(None).cast("double")
        rows = self.members.join(load, "run").select("run", block, F.lit(_TRAIN).alias("kind"), "rank", "p", "y", "s")
        if self.runs > 1:
            rows = rows.unionByName(self._messages().join(load, "run").select("run", block, "kind", F.lit(0).cast("long").alias("rank"), F.col("v").alias("p"), none.alias("y"), none.alias("s")))
        asks = placed.join(load, "run").select("run", F.pmod(F.xxhash64("p"), F.col("blocks")).alias("block"), F.lit(_ASK).alias("kind"), "rank", "p", none.alias("y"), none.alias("s"))

        def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tab = pa.Table.from_batches(batches)
            kind = np.asarray(tab.column("kind"))
            part = lambda k: tab.filter(pa.array(kind == k))
            ask, message = part(_ASK), {}
            for k in (_LEFT, _RIGHT):
                for v in part(k).column("p"):
                    message[k] = _Message.read(np.asarray(v.values, float))
            if ask.num_rows:
                x = np.asarray(ask.column("p").combine_chunks().flatten(), float).reshape(ask.num_rows, -1)
                mean, var = _scores(_slabs(part(_TRAIN), length), message.get(_LEFT), message.get(_RIGHT), np.asarray(ask.column("rank")) - key[0].as_py() * step, x)
                yield pa.RecordBatch.from_arrays([ask.column("p").combine_chunks(), pa.array(mean), pa.array(np.sqrt(np.maximum(var, 1e-10)))], names=["p", "mean", "std"])

        got = rows.unionByName(asks).groupBy("run", "block").applyInArrow(meet, "p array<double>, mean double, std double")
        alone = nothing.join(placed.where("run is null").select("p"), "p", "left_semi")
        return got.unionByName(alone)

    def log_marginal(self) -> float:
        """Log marginal likelihood of all training rows."""
        if not self.slabs:
            return 0.0
        # Rows of one place: their deviations from the mean are noise alone.
        n, spread, logs, more = self.places.agg(F.sum("n"), F.sum(F.col("n") * F.col("spread")), F.sum(F.log("n")), F.sum(F.col("n") - 1)).first()
        alike = (0.5 * spread / self.noise + 0.5 * more * log(self.noise)) if more else 0.0
        return float(self._messages().agg(F.sum("log")).first()[0] - alike - 0.5 * logs - 0.5 * n * log(2 * np.pi))
