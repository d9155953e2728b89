"""Nearest-neighbour and radius joins, and what is built on them.

Points are ``(id, p)`` with ``p array<double>`` of two or three coordinates.
Radius joins bucket points in cubes of the radius.  Nearest neighbours use cells
of bounded load: medians of a bounded sample cut the space into boxes, and a
point meets only the boxes that can hold one of its neighbours.  Both are
equi-joins, never cross joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

#: Boxes at most and sampled points for each; members and queries of one block of a box.
MAX_LEAVES, PER_LEAF, BLOCK = 1 << 16, 8, 2_000
#: Rows on either side of a tile of a radius join, distances of a partition of tiles, and of one step in a tile.
TILE, WORK, STEP = 16_384, 200_000_000, 500_000
#: Rows of a small side that are broadcast at once; more take more passes.
SMALL_ROWS = 20_000


def in_blocks(small: DataFrame, rows: int = SMALL_ROWS) -> list[DataFrame]:
    """``small`` in parts of about ``rows`` rows, each marked for broadcast: its size is counted, not promised."""
    n = max(1, -(-small.count() // rows))
    part = F.pmod(F.xxhash64(*small.columns), F.lit(n))
    return [F.broadcast(small.where(part == k) if n > 1 else small) for k in range(n)]


def _tiles(a: DataFrame, b: DataFrame, r: float, d: int) -> tuple[DataFrame, list[str]]:
    """Rows of ``a`` (``query`` 1, in the cubes around their own) and of ``b`` (0) by tiles, and the tiles' keys.

    A tile is a block of ``TILE`` rows of a cube's members and one of the rows
    that meet the cube, so that no task holds a dense cube.  A row is repeated for
    the blocks of the other side, so the tiles' size decides how much is shuffled;
    tiles are dealt to partitions by the distances that there are to work out.
    """
    spark = a.sparkSession
    tmp = Scratch(spark, "radius")
    sound = F.col("p").isNotNull()
    for i in range(d):
        sound = sound & F.col("p")[i].isNotNull() & ~F.isnan(F.col("p")[i]) & (F.abs(F.col("p")[i]) < float("inf"))
    cube = [f"c{i}" for i in range(d)]
    own = lambda t: t.where(sound).select(*t.columns, *[F.floor(F.col("p")[i] / r).alias(c) for i, c in enumerate(cube)])
    around = F.explode(F.array(*[F.struct(*[(F.col(c) + F.lit(s)).alias(c) for c, s in zip(cube, t)]) for t in product((-1, 0, 1), repeat=d)])).alias("to")
    held, asks = own(b), own(a).select(*a.columns, around).select(*a.columns, "to.*")
    count = lambda t, name: t.groupBy(*cube).agg(F.count("*").alias(name))
    blocks = lambda name: F.ceil(F.col(name) / TILE)
    load = tmp.write(count(held, "members").join(count(asks, "queries"), cube).select(*cube, "members", "queries", blocks("members").alias("ni"), blocks("queries").alias("nq")), "load")
    work = load.agg(F.sum(F.col("members").cast("double") * F.col("queries"))).first()[0] or 0.0
    load = load.drop("members", "queries")
    spots = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    left = asks.join(load, cube).select(*cube, spots("ni").alias("ib"), mine("nq").alias("qb"), F.lit(1).alias("query"), *a.columns)
    right = held.join(load, cube).select(*cube, mine("ni").alias("ib"), spots("nq").alias("qb"), F.lit(0).alias("query"), *b.columns)
    keys, parts = [*cube, "ib", "qb"], 1 + int(work // WORK)
    tiles = left.unionByName(right)
    return (tiles.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else tiles), keys


def _distances(tab: pa.Table, d: int):
    """Members' rows, and for ``STEP`` distances at a time (one query at least) the queries' rows and their distances to the members."""
    query, p = np.asarray(tab.column("query")), _coordinates(tab.column("p").combine_chunks(), d)
    qi, xi = np.flatnonzero(query == 1), np.flatnonzero(query == 0)
    few = max(1, STEP // max(len(xi), 1))
    for at in range(0, len(qi) if len(xi) else 0, few):
        q, total = qi[at : at + few], 0.0
        for i in range(d):
            step = p[q, i][:, None] - p[xi, i]
            step *= step
            total = total + step
        yield xi, q, np.sqrt(total, out=total)


def radius_join(a: DataFrame, b: DataFrame, r: float, d: int = 2) -> DataFrame:
    """All pairs ``id, other, dist`` with dist < r; rows without finite coordinates meet nothing. Ids are integers.

    The side that is repeated for the adjoining cubes is ``a``; pairs come out
    tile by tile, in batches of at most ``STEP`` (or one query's) pairs.
    """
    rows = lambda t: t.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"))
    tiles, keys = _tiles(rows(a), rows(b), r, d)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = pa.Table.from_batches(batches)
        ids = np.asarray(tab.column("id"))
        for xi, q, dist in _distances(tab, d):
            i, j = np.nonzero(dist < r)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][i]), pa.array(ids[xi][j]), pa.array(dist[i, j])], names=["id", "other", "dist"])

    return tiles.groupBy(*keys).applyInArrow(meet, "id long, other long, dist double")


def _cone_sums(cells: DataFrame, value: str, r: float, d: int) -> DataFrame:
    """``id, s, w``: sums of (r - dist) * value and of (r - dist) over the cells within r; no pair leaves its tile.

    A null value adds nothing to ``s``, which is null where all values are.
    """
    rows = cells.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"), F.col(value).cast("double").alias("v"))
    tiles, keys = _tiles(rows, rows, r, d)

    def cones(tab: pa.Table) -> pa.Table:
        ids, known = np.asarray(tab.column("id")), np.asarray(pc.is_valid(tab.column("v")))
        v = np.asarray(pc.fill_null(tab.column("v"), 0.0))
        out = [[np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)], [np.empty(0, bool)]]
        for xi, q, dist in _distances(tab, d):
            near = dist < r
            w = np.where(near, r - dist, 0.0)
            s = w @ v[xi] if np.isfinite(v[xi]).all() else np.where(near, w * v[xi], 0.0).sum(1)
            for col, x in zip(out, (ids[q], s, w.sum(1), (near & known[xi]).any(1) if not known[xi].all() else near.any(1))):
                col.append(x)
        return pa.table(dict(zip(("id", "s", "w", "known"), [np.concatenate(c) for c in out])))

    sums = tiles.groupBy(*keys).applyInArrow(cones, "id long, s double, w double, known boolean").groupBy("id")
    sums = sums.agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.max("known").alias("known")).where("w > 0")
    return sums.select("id", F.when(F.col("known"), F.col("s")).alias("s"), "w")


class _Boxes:
    """A complete binary tree of median cuts and the boxes and counts of the points in its nodes.

    Node 0 is the root, 2 i + 1 and 2 i + 2 are the children of i; the last
    level's nodes are the leaves.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        d = sample.shape[1]
        self.depth, self.inner = depth, (1 << depth) - 1
        self.axis, self.cut = np.zeros(self.inner, np.int64), np.zeros(self.inner)
        of = np.zeros(len(sample), np.int64)
        for level in range(depth):
            lo, n = (1 << level) - 1, 1 << level
            low, high = np.full((n, d), np.inf), np.full((n, d), -np.inf)
            np.minimum.at(low, of - lo, sample), np.maximum.at(high, of - lo, sample)
            axis = np.where(np.isfinite(high - low), high - low, 0).argmax(1)
            v = sample[np.arange(len(sample)), axis[of - lo]]
            order = np.lexsort((v, of))
            first = np.searchsorted(of[order], np.arange(lo, lo + n))
            count = np.bincount(of - lo, minlength=n)
            mid = np.minimum(first + np.maximum(count - 1, 0) // 2, max(len(sample) - 1, 0))
            self.axis[lo : lo + n], self.cut[lo : lo + n] = axis, v[order][mid] if len(sample) else 0.0
            of = self._down(sample, of)

    def _down(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = self._down(x, at)
        return at - self.inner

    def fill(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n = self.inner + (1 << self.depth)
        self.count, self.low, self.high = np.zeros(n, np.int64), np.full((n, low.shape[1]), np.inf), np.full((n, low.shape[1]), -np.inf)
        at = leaf + self.inner
        self.count[at], self.low[at], self.high[at] = count, low, high
        for level in range(self.depth - 1, -1, -1):
            i = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
            a, b = 2 * i + 1, 2 * i + 2
            self.count[i] = self.count[a] + self.count[b]
            self.low[i], self.high[i] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def near(self, x: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the leaves that may hold one of their ``need`` nearest points."""
        at = self.leaf(x) + self.inner
        while (few := (self.count[at] < need) & (at > 0)).any():
            at = np.where(few, (at - 1) // 2, at)
        with np.errstate(invalid="ignore"):
            far = np.maximum(np.abs(x - self.low[at]), np.abs(x - self.high[at]))
        reach = np.where(self.count[at] >= need, (far**2).sum(1) * (1 + 1e-9), np.inf)
        row, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
        for level in range(self.depth + 1):
            gap = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0.0)
            ok = (self.count[node] > 0) & ((gap**2).sum(1) <= reach[row])
            row, node = row[ok], node[ok]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
        return row, node - self.inner


def _coordinates(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(col), np.float64).reshape(len(col), -1)[:, :d]


def _nearest(k: int, d: int, exclude_self: bool):
    """The k nearest points of a block to each of its queries, ties by id."""

    def one(tab):
        query = np.asarray(tab.column("query"))
        qi, xi = np.flatnonzero(query == 1), np.flatnonzero(query == 0)
        ids, p = np.asarray(tab.column("id")), _coordinates(tab.column("p").combine_chunks(), d)
        xi = xi[np.argsort(ids[xi], kind="stable")]
        got = [[], [], []]
        for at in range(0, len(qi) if len(xi) else 0, 500):
            q = qi[at : at + 500]
            dist = np.sqrt(sum((p[q, None, i] - p[None, xi, i]) ** 2 for i in range(d)))
            if exclude_self:
                dist[ids[q][:, None] == ids[xi][None]] = np.inf
            order = np.argsort(dist, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(dist, order, 1)
            r, c = np.nonzero(best < np.inf)
            for col, v in zip(got, (ids[q][r], ids[xi][order[r, c]], best[r, c])):
                col.append(v)
        cols = [np.concatenate(c) if c else np.empty(0) for c in got]
        return pa.table({"id": pa.array(cols[0].astype(np.int64)), "other": pa.array(cols[1].astype(np.int64)), "dist": pa.array(cols[2].astype(float))})

    return one


def knn_join(a: DataFrame, b: DataFrame, k: int, d: int = 2, exclude_self: bool = True) -> DataFrame:
    """``id, rank, other, dist``: the k nearest points of ``b``, ties by id; ids are integers.

    Boxes hold about ``4 k`` points each whatever their distribution, since their
    cuts are medians of a bounded sample (with more than ``MAX_LEAVES`` boxes'
    worth of points they hold more).  The distance to the far corner of a box
    with enough points bounds a query's reach, so it meets just the boxes within
    it.  A box of many equal points, or of many queries, is met in blocks.  Rows
    without finite coordinates meet nothing.
    """
    spark = a.sparkSession
    tmp, need = Scratch(spark, "knn"), k + int(exclude_self)
    sound = F.col("p").isNotNull() & (F.size("p") >= d)
    for i in range(d):
        sound = sound & F.col("p")[i].isNotNull() & ~F.isnan(F.col("p")[i]) & (F.abs(F.col("p")[i]) < float("inf"))
    rows = lambda t: t.where(sound).select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"))
    held = rows(b)
    n = held.count()
    depth = max(0, min(MAX_LEAVES, n // max(4 * k, 32)).bit_length() - 1)
    share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(n, 1))) < PER_LEAF << depth
    sample = held.where(share).select("p").toPandas()  # about PER_LEAF rows a box
    boxes = _Boxes(np.array(sample.p.tolist(), float).reshape(len(sample), -1)[:, :d] if len(sample) else np.empty((0, d)), depth)
    cuts = spark.sparkContext.broadcast(boxes)

    def place(batches):
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(cuts.value.leaf(_coordinates(t.column(1), d)), pa.int64())], names=["id", "p", "leaf"])

    placed = tmp.write(held.mapInArrow(place, "id long, p array<double>, leaf long"), "placed")
    ends = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.col("p")[i]).alias(f"{m}{i}") for m, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]).toPandas()  # MAX_LEAVES rows at most
    boxes.fill(ends.leaf.to_numpy(np.int64), ends.n.to_numpy(np.int64), *(ends[[f"{m}{i}" for i in range(d)]].to_numpy(float).reshape(-1, d) for m in ("lo", "hi")))
    full = spark.sparkContext.broadcast(boxes)

    def reach(batches):
        for t in batches:
            for at in range(0, t.num_rows, 2_000):
                s = t.slice(at, 2_000)
                row, leaf = full.value.near(_coordinates(s.column(1), d), need)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([s.column(0).take(take), s.column(1).take(take), pa.array(leaf, pa.int64())], names=["id", "p", "leaf"])

    asked = tmp.write(rows(a).mapInArrow(reach, "id long, p array<double>, leaf long"), "asked")
    load = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("ni")).join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("nq")), "leaf")
    load = F.broadcast(tmp.write(load, "load"))  # MAX_LEAVES rows at most
    spots = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    left = asked.join(load, "leaf").select("leaf", spots("ni").alias("ib"), own("nq").alias("qb"), F.lit(1).alias("query"), "id", "p")
    right = placed.join(load, "leaf").select("leaf", own("ni").alias("ib"), spots("nq").alias("qb"), F.lit(0).alias("query"), "id", "p")
    near = left.unionByName(right).groupBy("leaf", "ib", "qb").applyInArrow(_nearest(k, d, exclude_self), "id long, other long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "other")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "other", "dist")


def idw_interpolate(points: DataFrame, values: DataFrame, query: DataFrame, k: int = 4, d: int = 2) -> DataFrame:
    """Inverse-distance weighted mean of the k nearest values."""
    near = knn_join(query, points, k, d, exclude_self=False)
    w = 1.0 / (F.col("dist") + 1e-10)
    return near.join(values.select(F.col("id").alias("other"), "value"), "other").groupBy("id").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def _stencils(points: DataFrame, query: DataFrame, k: int, d: int, extra: DataFrame | None = None) -> DataFrame:
    """``id, p, q`` (and ``v``): each query with the coordinates (and values) of its k nearest points, nearest first."""
    near = knn_join(query, points, k, d, exclude_self=False)
    rows = near.join(points.select(F.col("id").alias("other"), F.col("p").alias("q")), "other")
    more = ["other"]
    if extra is not None:
        rows, more = rows.join(extra.select(F.col("id").alias("other"), F.col("value").cast("double").alias("v")), "other"), ["other", "v"]
    packed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "q", *more))).alias("s"))  # k entries
    return packed.join(query.select("id", "p"), "id").select("id", F.col("p").cast("array<double>").alias("p"), F.flatten("s.q").cast("array<double>").alias("q"), *[F.col(f"s.{c}").alias(c) for c in more])


def _by_size(batch: pa.RecordBatch, d: int):
    """Rows of ``_stencils`` of equal stencil size together: rows, centres (n, d) and points (n, k, d)."""
    size = np.asarray(pc.list_value_length(batch.column("other")))
    for k in np.unique(size).tolist():
        rows = np.flatnonzero(size == k)
        for part in np.array_split(rows, max(1, len(rows) // 2_000)):
            take = pa.array(part)
            yield part, _coordinates(batch.column("p").take(take), d), np.asarray(pc.list_flatten(batch.column("q").take(take)), float).reshape(len(part), k, -1)[:, :, :d]


def rbf_interpolate(points: DataFrame, values: DataFrame, query: DataFrame, k: int = 12, d: int = 2) -> DataFrame:
    """Local thin-plate spline with a linear tail over the k nearest values; many small systems are solved at once."""
    rows = _stencils(points, query, k, d, values)
    phi = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0)

    def solve(batches):
        for b in batches:
            out = np.empty(b.num_rows)
            for part, p, x in _by_size(b, d):
                n, m, _ = x.shape
                x = x - p[:, None]  # the query is the origin, so the tail there is its constant
                a = np.zeros((n, m + d + 1, m + d + 1))
                a[:, :m, :m] = phi(np.linalg.norm(x[:, :, None] - x[:, None], axis=3))
                a[:, :m, m], a[:, m, :m] = 1.0, 1.0
                a[:, :m, m + 1 :], a[:, m + 1 :, :m] = x, x.transpose(0, 2, 1)
                y = np.asarray(pc.list_flatten(b.column("v").take(pa.array(part))), float).reshape(n, m)
                c = (np.linalg.pinv(a, rcond=1e-13) @ np.concatenate([y, np.zeros((n, d + 1))], 1)[:, :, None])[:, :, 0]
                out[part] = (phi(np.linalg.norm(x, axis=2)) * c[:, :m]).sum(1) + c[:, m]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out)], names=["id", "value"])

    return rows.mapInArrow(solve, "id long, value double")


def rbf_fd_weights(points: DataFrame, k: int = 15, d: int = 2) -> DataFrame:
    """``id, other, weight``: Laplacian weights of each point on its k nearest points (itself among them).

    Cubic radial functions with a quadratic tail, so the weights are exact for
    quadratics.  Stencils whose points do not determine a quadratic get the
    minimum-norm weights.
    """
    rows = _stencils(points, points, k, d)
    quad = [(i, j) for i in range(d) for j in range(i, d)]

    def solve(batches):
        for b in batches:
            ids, other, weight = [], [], []
            for part, p, x in _by_size(b, d):
                n, m, _ = x.shape
                x = x - p[:, None]
                size = np.maximum(np.abs(x).max((1, 2)), 1e-300)[:, None, None]  # solved at unit size
                x = x / size
                tail = np.concatenate([np.ones((n, m, 1)), x, np.stack([x[:, :, i] * x[:, :, j] for i, j in quad], 2)], 2)
                t = tail.shape[2]
                a = np.zeros((n, m + t, m + t))
                a[:, :m, :m] = np.linalg.norm(x[:, :, None] - x[:, None], axis=3) ** 3
                a[:, :m, m:], a[:, m:, :m] = tail, tail.transpose(0, 2, 1)
                right = np.zeros((n, m + t))
                right[:, :m] = 3 * (d + 1) * np.linalg.norm(x, axis=2)  # the Laplacian of r^3
                for q, (i, j) in enumerate(quad):
                    right[:, m + 1 + d + q] = 2.0 if i == j else 0.0
                w = (np.linalg.pinv(a, rcond=1e-13) @ right[:, :, None])[:, :m, 0] / size[:, 0] ** 2
                take = pa.array(part)
                ids.append(np.repeat(np.asarray(b.column("id").take(take)), m))
                other.append(np.asarray(pc.list_flatten(b.column("other").take(take))))
                weight.append(w.ravel())
            cat = lambda v, t: pa.array(np.concatenate(v) if v else np.empty(0), t)
            yield pa.RecordBatch.from_arrays([cat(ids, pa.int64()), cat(other, pa.int64()), cat(weight, pa.float64())], names=["id", "other", "weight"])

    return rows.mapInArrow(solve, "id long, other long, weight double")


def density_filter(cells: DataFrame, r: float, d: int = 2) -> DataFrame:
    """Row-normalised cone weights (r - dist): ``id, filtered`` from ``cells(id, p, rho)``."""
    return _cone_sums(cells, "rho", r, d).select("id", (F.col("s") / F.col("w")).alias("filtered"))


def sensitivity_filter(cells: DataFrame, r: float, d: int = 2, floor: float = 1e-12) -> DataFrame:
    """``id, filtered``: the transpose of the row-normalised cone weights applied to ``dc * rho``, over ``max(rho, floor)``.

    ``cells(id, p, rho, dc)``.
    """
    total = _cone_sums(cells.withColumn("g", F.lit(1.0)), "g", r, d)
    row = cells.select("id", "p", (F.col("dc") * F.col("rho")).alias("g")).join(total, "id").select("id", "p", (F.col("g") / F.col("w")).alias("g"))
    got = _cone_sums(Scratch(cells.sparkSession, "sensitivity").write(row, "rows"), "g", r, d)  # the weights are symmetric
    return cells.select("id", "rho").join(got, "id").select("id", (F.col("s") / F.greatest("rho", F.lit(floor))).alias("filtered"))


def kernel_correct(query: DataFrame, support: DataFrame, eps: float = 1.0, d: int = 2, tolerance: float = 0.0) -> DataFrame:
    """Residual correction by normalised Gaussian weights over the whole table ``support(p, residual)``.

    With a ``tolerance`` the two sums come from a tree of boxes, each with an error
    of at most the tolerance times the sum of its weights' sizes.  Without one
    they are full sums: the support is counted and met in blocks of
    ``SMALL_ROWS``, each broadcast, and the blocks' sums are added up.
    """
    if tolerance > 0:
        from fieldloom.operators.treesum import Gaussian, tree_sums

        w = support.select("p", F.array(F.col("residual").cast("double"), F.lit(1.0)).alias("w"))
        return tree_sums(query, w, Gaussian(eps, d, 2), d, tolerance).select("id", (F.col("s")[0] / (F.col("s")[1] + 1e-10)).alias("correction"))
    dist2 = sum((F.col("p")[i] - F.col("s.p")[i]) ** 2 for i in range(d))
    w = F.exp(-eps * dist2)
    out = None
    for part in in_blocks(support.select(F.struct("p", "residual").alias("s"))):
        sums = query.select("id", "p").crossJoin(part).groupBy("id").agg(F.sum(w * F.col("s.residual")).alias("a"), F.sum(w).alias("b"))
        out = sums if out is None else out.unionByName(sums)
    return out.groupBy("id").agg((F.sum("a") / (F.sum("b") + 1e-10)).alias("correction"))


def potential_superpose(points: DataFrame, singularities: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Sum of source and vortex potentials ``kind, strength, x, y`` at each point ``id, x, y``; other kinds are uniform flows along x.

    With a ``tolerance`` sources and vortices are summed by a tree of boxes, with
    an error of at most the tolerance times the sum of |strength| / (2 pi);
    without one all of them are met in counted blocks.
    """
    if tolerance > 0:
        from fieldloom.operators.treesum import Logarithm, tree_sums

        q = F.col("strength").cast("double") / (2 * np.pi)
        own = singularities.where("kind in ('source', 'vortex')").select(F.array("x", "y").alias("p"), F.when(F.col("kind") == "source", F.array(q, F.lit(0.0))).otherwise(F.array(F.lit(0.0), q)).alias("w"))
        flow = float(singularities.where("kind not in ('source', 'vortex')").agg(F.sum("strength")).first()[0] or 0.0)
        got = tree_sums(points.select("id", F.array("x", "y").alias("p")), own, Logarithm(), 2, tolerance)
        return points.join(got, "id").select("id", (F.col("s")[0] + flow * F.col("x")).alias("potential"))
    dx, dy = F.col("x") - F.col("s.x"), F.col("y") - F.col("s.y")
    phi = F.when(F.col("s.kind") == "source", F.col("s.strength") / (2 * np.pi) * F.log(F.sqrt(dx * dx + dy * dy) + 1e-10)).when(F.col("s.kind") == "vortex", -F.col("s.strength") / (2 * np.pi) * F.atan2(dy, dx)).otherwise(F.col("s.strength") * F.col("x"))
    out = None
    for part in in_blocks(singularities.select(F.struct("kind", "strength", "x", "y").alias("s"))):
        sums = points.select("id", "x", "y").crossJoin(part).groupBy("id").agg(F.sum(phi).alias("potential"))
        out = sums if out is None else out.unionByName(sums)
    return out.groupBy("id").agg(F.sum("potential").alias("potential"))
