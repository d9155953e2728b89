"""Grids and sample tables made on Spark, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def structured_grid(spark: SparkSession, bounds, resolution) -> tuple[DataFrame, DataFrame]:
    """Points and line / quad / hex cells of a box grid with row-major ids."""
    n = [r + 1 for r in resolution]
    total, ids, rest = reduce(lambda a, b: a * b, n), [], F.col("id")
    for k in reversed(n):
        ids.append(rest % k)
        rest = F.floor(rest / k)
    ids = ids[::-1]
    xyz = [F.lit(lo) + (hi - lo) / r * i for (lo, hi), r, i in zip(bounds, resolution, ids)] + [F.lit(None).cast("double")] * (3 - len(n))
    pts = spark.range(total).select(F.lit(0).cast("long").alias("mesh"), F.col("id").alias("point_id"), *[c.cast("double").alias(k) for c, k in zip(xyz, "xyz")])
    cells, rest, at = reduce(lambda a, b: a * b, resolution), F.col("id"), []
    for k in reversed(resolution):
        at.append(rest % k)
        rest = F.floor(rest / k)
    at = at[::-1]
    node = lambda off: reduce(lambda acc, t: acc * t[0] + (t[1] + t[2]), zip(n, at, off), F.lit(0).cast("long"))
    offs = {1: [(0,), (1,)], 2: [(0, 0), (1, 0), (1, 1), (0, 1)], 3: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]}[len(n)]
    kind = {1: "line", 2: "quad", 3: "hex"}[len(n)]
    return pts, spark.range(cells).select(F.lit(0).cast("long").alias("mesh"), F.col("id").alias("cell_id"), F.lit(kind).alias("cell_type"), F.array(*[node(o) for o in offs]).alias("nodes"))


def _uniform(seed: int, salt: int) -> Column:
    """A draw in (0, 1) that depends on seed and id alone, never on the partition."""
    return (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def parameter_samples(spark: SparkSession, bounds, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"), F.array(*[F.lit(lo) + (hi - lo) * _uniform(seed, i) for i, (lo, hi) in enumerate(bounds)]).alias("p"))


def sample_domain(spark: SparkSession, bounds, contains: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` uniform points of a region inside its box, by rejection; the oversample grows until they suffice.

    The draws are numbered in parts; the parts' counts tell where the ``n``-th
    accepted one lies, so no sort or single task is needed.
    """
    many = 2 * n
    while True:
        size = max(1, -(-many // 1_000))
        pts = spark.range(many).select("id", *[(F.lit(lo) + (hi - lo) * _uniform(seed, i)).alias(c) for i, ((lo, hi), c) in enumerate(zip(bounds, "xyz"))]).where(contains)
        counts = sorted(pts.groupBy(F.floor(F.col("id") / size).alias("k")).agg(F.count("*").alias("c")).collect())  # a thousand rows
        if sum(r.c for r in counts) >= n:
            break
        many *= 2
        if many > 10_000 * n:
            raise ValueError("the region fills almost none of its box")
    held = 0
    for r in counts:
        if held + r.c >= n:
            part = pts.where(F.floor(F.col("id") / size) == r.k).select("id").sort("id").limit(n - held).agg(F.max("id")).first()[0]  # one part
            return pts.where(F.col("id") <= part).withColumnRenamed("id", "sample_id")
        held += r.c
    return pts.limit(0).withColumnRenamed("id", "sample_id")


def halton_points(spark: SparkSession, bounds, n: int) -> DataFrame:
    """Halton sequence in bases 2, 3, 5 from index 1, exact digit sums."""

    def radical(base: int) -> Column:
        digits = 1
        while base**digits <= n:
            digits += 1
        return sum(((F.floor(F.col("id") / base**k) % base) / float(base ** (k + 1)) for k in range(digits)), F.lit(0.0))

    return spark.range(1, n + 1).select(F.col("id").alias("sample_id"), *[(F.lit(lo) + (hi - lo) * radical(b)).alias(c) for (lo, hi), b, c in zip(bounds, (2, 3, 5), "xyz")])


def box_boundary_points(spark: SparkSession, bounds, n_per_face: int) -> DataFrame:
    """``face, point, x, y, z`` on the 2, 4 or 6 faces of a box; corners and edges repeat.

    A face has ``n_per_face`` points in two and its square in three dimensions.
    """
    dim = len(bounds)
    each = n_per_face ** (dim - 1)
    t = lambda k: F.pmod(F.floor(F.col("point") / n_per_face**k), F.lit(n_per_face)) / float(max(n_per_face - 1, 1))
    rows = spark.range(2 * dim * each).select(F.floor(F.col("id") / each).cast("int").alias("face"), (F.col("id") % each).alias("point"))
    axis, end = F.floor(F.col("face") / 2), F.col("face") % 2
    out = []
    for k, (lo, hi) in enumerate(bounds):
        free = F.when(axis < k, t(k - 1) if k else F.lit(0.0)).otherwise(t(min(k, max(dim - 2, 0))))
        out.append((F.lit(float(lo)) + F.when(axis == k, end).otherwise(free) * float(hi - lo)).alias("xyz"[k]))
    return rows.select("face", "point", *out, *[F.lit(None).cast("double").alias(c) for c in "xyz"[dim:]])


def boundary_cells(neighbors: DataFrame, cells: DataFrame, dim: int) -> DataFrame:
    """``cell_id`` of cells that lack a face neighbour."""
    full = neighbors.groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") == 2 * dim)
    return cells.select("cell_id").join(full, "cell_id", "left_anti")


def tensor_grid(spark: SparkSession, nodes_per_dim) -> DataFrame:
    """Tensor product of small one-dimensional nodes and weights: ``p, w``."""
    out = spark.createDataFrame([([], 1.0)], "p array<double>, w double")
    for nodes in nodes_per_dim:
        d = spark.createDataFrame([(float(x), float(w)) for x, w in nodes], "x double, v double")
        out = out.crossJoin(F.broadcast(d)).select(F.concat("p", F.array("x")).alias("p"), (F.col("w") * F.col("v")).alias("w"))
    return out


def cartesian_cells(spark: SparkSession, bounds, resolution) -> tuple[DataFrame, DataFrame]:
    """Cell centres and existing face neighbours (slot 2d lower, 2d + 1 upper)."""
    total, rest, at = reduce(lambda a, b: a * b, resolution), F.col("id"), []
    for k in reversed(resolution):
        at.append(rest % k)
        rest = F.floor(rest / k)
    at = at[::-1]
    steps = [reduce(lambda a, b: a * b, resolution[d + 1 :], 1) for d in range(len(resolution))]
    mid = [(F.lit(lo) + (hi - lo) / r * (i + 0.5)).cast("double").alias(c) for (lo, hi), r, i, c in zip(bounds, resolution, at, "xyz")]
    arms = []
    for d, r in enumerate(resolution):
        arms += [F.struct(F.lit(2 * d).alias("slot"), F.when(at[d] > 0, F.col("id") - steps[d]).alias("nbr_id")), F.struct(F.lit(2 * d + 1).alias("slot"), F.when(at[d] < r - 1, F.col("id") + steps[d]).alias("nbr_id"))]
    ids = spark.range(total)
    return ids.select(F.col("id").alias("cell_id"), *mid), ids.select(F.col("id").alias("cell_id"), F.explode(F.array(*arms)).alias("a")).select("cell_id", "a.*").where("nbr_id is not null")
