"""Aggregation, Laplacians, coarsening and partition measures of mesh and other graphs.

``edges(src, dst, weight)`` and ``nodes(id, f)``; hub nodes are split by the
adaptive skew join where both sides come straight from an exchange.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.dealt import DealtMatrix
from fieldloom.operators.graph_components import connected_components
from fieldloom.sources.scratch import Scratch

_log = logging.getLogger(__name__)


def neighbor_aggregate(nodes: DataFrame, edges: DataFrame, how: str = "mean") -> DataFrame:
    """Mean, sum or maximum of in-neighbour values; 0 where there is none."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    got = edges.join(nodes.select(F.col("id").alias("src"), "f"), "src").groupBy(F.col("dst").alias("id")).agg(f("f").alias("agg"))
    return nodes.select("id").join(got, "id", "left").select("id", F.coalesce("agg", F.lit(0.0)).alias("agg"))


#: Edges of a partition where a caller tells their number.
PART_EDGES = 500_000


def _pairs(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``low, high, weight``: each undirected pair once, weights of repeated ones summed, loops dropped."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), "weight")
    if rows is not None:
        e = e.repartition(1 + rows // PART_EDGES, "low", "high")
    return e.groupBy("low", "high").agg(F.sum("weight").alias("weight"))


def _turned(pairs: DataFrame, value: str = "weight") -> DataFrame:
    turned = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select(F.explode(F.array(turned("low", "high"), turned("high", "low"))).alias("e"), value).select("e.src", "e.dst", value)


def symmetric(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Both directions of every edge, weights of repeated ones summed.

    Each pair is summed once and turned round afterwards, so half the rows are
    shuffled and held.  With ``rows``, about how many edges there are, pairs are
    dealt to a partition for each ``PART_EDGES``: a task's memory stays the same
    however many there are.
    """
    return _turned(_pairs(edges, rows))


def laplacian(edges: DataFrame, normalized: bool = True, rows: int | None = None) -> DataFrame:
    """``row, col, value`` of D - W, or of its symmetric normalisation; ``rows`` as in ``symmetric``.

    Pairs meet the degrees of their ends once and are turned round afterwards.
    """
    p = _pairs(edges, rows)
    deg = _turned(p).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
    diag = deg.select(F.col("id").alias("row"), F.col("id").alias("col"), (F.lit(1.0) if normalized else F.col("d")).alias("value"))
    off = p.select("low", "high", (-F.col("weight")).alias("value"))
    if normalized:
        for k in ("low", "high"):
            d = deg.select(F.col("id").alias(k), F.col("d").alias(f"d_{k}"))
            if rows is not None:  # both sides, or the pairs would be dealt again to the degrees' few partitions
                off, d = off.repartition(1 + rows // PART_EDGES, k), d.repartition(1 + rows // PART_EDGES, k)
            off = off.join(d, k)
        off = off.select("low", "high", (F.col("value") / F.sqrt(F.col("d_low") * F.col("d_high"))).alias("value"))
    return diag.unionByName(_turned(off, "value").withColumnsRenamed({"src": "row", "dst": "col"}))


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """``row, value`` of a sparse matrix times a vector ``row, value``; rows of zeros are absent."""
    v = x.select(F.col("row").alias("col"), F.col("value").alias("v"))
    return matrix.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def largest_eigenvalue(lap: DataFrame, rounds: int = 20) -> float:
    """Largest eigenvalue of a symmetric matrix by power iteration: a product and two sums a round, one number out."""
    tmp = Scratch(lap.sparkSession, "power")
    start = (F.pmod(F.xxhash64("row"), F.lit(2001)) - 1000) / 1000.0
    v, value = tmp.write(lap.select("row").distinct().withColumn("value", start), "v"), 0.0
    for _ in range(rounds):
        w = tmp.write(spmv(lap, v), "w")
        norm = w.agg(F.sqrt(F.sum(F.col("value") ** 2))).first()[0]
        if not norm:
            return 0.0
        tmp.drop(v)
        v, value = tmp.write(w.select("row", (F.col("value") / norm).alias("value")), "v"), norm
        tmp.drop(w)
    return float(value)


def chebyshev_filter(lap: DataFrame, f: DataFrame, theta: list[float], largest: float | None = 2.0) -> DataFrame:
    """Sum of theta_k T_k(2 L / largest - I) f; the matrix is dealt once, each term is a written table of vectors. Ids are integers.

    Without ``largest`` it is estimated by power iteration, plus a tenth, since the
    iteration comes from below.
    """
    tmp = Scratch(lap.sparkSession, "chebyshev")
    if len(theta) > 2 or largest is None:
        lap = tmp.write(lap, "matrix")
    largest = 1.1 * largest_eigenvalue(lap) if largest is None else largest
    if len(theta) < 2:
        return f.select("row", (F.col("value") * theta[0]).alias("value"))
    if len(theta) == 2:
        lf = spmv(lap, f).withColumnRenamed("value", "lf")
        shifted = 2.0 / largest * F.coalesce("lf", F.lit(0.0)) - F.col("value")
        return f.join(lf, "row", "left").select("row", (theta[0] * F.col("value") + theta[1] * shifted).alias("value"))
    dealt = DealtMatrix(lap, tmp)
    tmp.drop(lap)

    def term(k: int) -> Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]:
        def update(vs: list[np.ndarray], lv: np.ndarray) -> list[np.ndarray]:
            """From T_k-1 f, T_k-2 f and the sum so far to the next ones."""
            v = 2.0 / largest * lv - vs[0]
            if k == 1:
                return [v, vs[0], theta[0] * vs[0] + theta[1] * v]
            v = 2 * v - vs[1]
            return [v, vs[0], vs[2] + theta[k] * v]

        return update

    state = dealt.start(f)
    for k in range(1, len(theta)):
        after = tmp.write(dealt.step(state, term(k)), f"t{k}")
        if k > 1:
            tmp.drop(state)
        state = after
    tmp.drop(dealt.packed)
    return dealt.read(state, 2)


def hop_distances(edges: DataFrame, max_hops: int) -> DataFrame:
    """``src, dst, hops`` of pairs within ``max_hops`` directed steps (pairs grow with the degree: keep it small)."""
    tmp = Scratch(edges.sparkSession, "hops")
    e = tmp.write(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    seen = front = e.withColumn("hops", F.lit(1))
    for h in range(2, max_hops + 1):
        nxt = front.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").where("src <> dst").select("src", "dst").distinct()
        front = tmp.write(nxt.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(h)), f"hop{h}")
        seen = seen.unionByName(front)
    return seen


def hop_band_mean(nodes: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """``id, hops, n, mean``: mean value of the nodes at each hop distance from a node; ``nodes(id, f)``."""
    pairs = hop_distances(edges, max_hops)
    return pairs.join(nodes.select(F.col("id").alias("dst"), "f"), "dst").groupBy(F.col("src").alias("id"), "hops").agg(F.count("*").alias("n"), F.avg("f").alias("mean"))


def path_distances(edges: DataFrame, sources: DataFrame, limit: float, max_rounds: int = 200) -> DataFrame:
    """Shortest weighted distance from the nearest source, up to a limit; only the moving frontier is joined."""
    tmp = Scratch(edges.sparkSession, "paths")
    e = tmp.write(symmetric(edges), "edges")
    best = front = tmp.write(sources.select("id", F.lit(0.0).alias("dist")).distinct(), "start")
    for _ in range(max_rounds):
        step = front.withColumnRenamed("id", "src").join(e, "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("new")).where(F.col("new") <= limit)
        step = step.groupBy("id").agg(F.min("new").alias("new"))
        front = tmp.write(step.join(best, "id", "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("id", F.col("new").alias("dist")), "front")
        if front.isEmpty():
            return best
        best = tmp.write(best.unionByName(front).groupBy("id").agg(F.min("dist").alias("dist")), "best")
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def direction_binned_aggregate(nodes: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    """Neighbour sums by direction bin of the edge, divided by the in-degree; ``nodes(id, x, y, f)``."""
    a = nodes.select(F.col("id").alias("src"), F.col("x").alias("xs"), F.col("y").alias("ys"), "f")
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("xt"), F.col("y").alias("yt"))
    rows = edges.select("src", "dst").join(a, "src").join(b, "dst")
    angle = (F.atan2(F.col("yt") - F.col("ys"), F.col("xt") - F.col("xs")) + F.pi()) / (2 * F.pi())
    rows = rows.select("dst", "f", (F.floor(angle * n) % n).alias("bin"))
    deg = rows.groupBy("dst").agg(F.count("*").alias("deg"))
    return rows.groupBy("dst", "bin").agg(F.sum("f").alias("s")).join(deg, "dst").select(F.col("dst").alias("id"), "bin", (F.col("s") / F.col("deg")).alias("agg"))


def softmax_aggregate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Softmax(q k / sqrt d)-weighted mean of v over a node and its in-neighbours.

    ``nodes(id, q, k, v)`` holds scalars, or arrays of d (q, k) and of any length
    (v, then ``agg`` is an array).
    """
    me = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    pairs = edges.select("src", "dst").where("src <> dst").unionByName(me)
    kinds = dict(nodes.dtypes)
    if kinds["q"].startswith("array"):
        score = F.aggregate(F.zip_with("q", "k", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / F.sqrt(F.size("q"))
    else:
        score = F.col("q") * F.col("k")
    rows = pairs.join(nodes.select(F.col("id").alias("dst"), "q"), "dst").join(nodes.select(F.col("id").alias("src"), "k", "v"), "src").withColumn("s", score)
    top = rows.groupBy("dst").agg(F.max("s").alias("top"))
    met, w = rows.join(top, "dst"), F.exp(F.col("s") - F.col("top"))
    if not kinds["v"].startswith("array"):
        return met.groupBy(F.col("dst").alias("id")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("agg"))
    each = met.select("dst", w.alias("w"), F.posexplode("v").alias("pos", "x")).groupBy("dst", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return each.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("a")).select("id", F.col("a.x").alias("agg"))


def contract_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between parts with summed weights; loops dropped. ``labels(id, part)``."""
    side = lambda k: labels.select(F.col("id").alias(k), F.col("part").alias(f"p_{k}"))
    e = edges.join(side("src"), "src").join(side("dst"), "dst").where("p_src <> p_dst")
    return e.groupBy(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def component_pool(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components as clusters: ``part, size`` and mean value; isolated nodes stay alone."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))
    lab = connected_components(nodes.sparkSession, pairs)
    return nodes.join(lab.withColumnRenamed("node", "id"), "id").groupBy(F.col("component").alias("part")).agg(F.count("*").alias("size"), F.avg("f").alias("mean"))


def edge_cut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Undirected edges between parts, and the largest part over the mean part."""
    side = lambda k: labels.select(F.col("id").alias(k), F.col("part").alias(f"p_{k}"))
    cut = edges.where("src < dst").select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").agg(F.count_if(F.col("p_src") != F.col("p_dst")).alias("edge_cut"))
    size = labels.groupBy("part").agg(F.count("*").alias("n")).agg((F.max("n") / F.avg("n")).alias("balance"), F.count("*").alias("parts"))
    return cut.crossJoin(size)


def voxel_pool(nodes: DataFrame, size: float) -> DataFrame:
    """Mean position and value by cube of side ``size``: ``nodes(id, x, y, f)``."""
    v = nodes.withColumn("vx", F.floor(F.col("x") / size)).withColumn("vy", F.floor(F.col("y") / size))
    return v.groupBy("vx", "vy").agg(F.count("*").alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("f").alias("f"))


def voxel_labels(nodes: DataFrame, ratio: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``id, part``: voxels sized so that about ``ratio`` of the nodes' number would tile their box, numbered in order from 0."""
    from fieldloom.operators.order import dense_ids

    box = nodes.agg(F.count("*").alias("n"), *[f(c).alias(f"{m}{c}") for c in dims for m, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box.n:
        return nodes.select("id", F.lit(0).cast("long").alias("part"))
    area = 1.0
    for c in dims:
        area *= max(box[f"hi{c}"] - box[f"lo{c}"], 1e-300)
    size = (area / max(1, int(box.n * ratio))) ** (1 / len(dims))
    v = nodes.select("id", *[F.floor((F.col(c) - box[f"lo{c}"]) / size).alias(f"v{c}") for c in dims])
    keys = [f"v{c}" for c in dims]
    return v.join(dense_ids(v.select(*keys).distinct(), keys, "part"), keys).select("id", "part")


def pool_means(nodes: DataFrame, labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``part, size`` and the mean of each column over the part's nodes; ``labels(id, part)``."""
    return nodes.join(labels, "id").groupBy("part").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns])


def coarse_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs ``src, dst`` of parts that an edge joins, in both directions."""
    e = contract_graph(edges.select("src", "dst", F.lit(1.0).alias("weight")), labels).select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def match_pool(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """A maximal matching ``id, part`` by mutual heaviest free neighbours; part is the smaller id.

    Edges compare by weight (those within a twelfth of each other count as equal),
    then by a hash of the round and the edge, then by ids.  The fresh hashes let
    many edges of about one weight be local maxima at once, so weights that rise
    along a path do not give one pair a round.  Each round's pairs are a table
    and each round is logged; the answer reads these tables together, whatever
    their number.  ``rows`` as in ``symmetric``.
    """
    tmp = Scratch(edges.sparkSession, "match")
    e = tmp.write(symmetric(edges, rows).where("weight > 0"), "edges")
    out, turn = [], 0
    while True:
        lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
        # A symmetric, total order of edges makes the heaviest free edge mutual, so each round adds a pair.
        best = e.groupBy("src").agg(F.max_by("dst", F.struct(F.floor(8 * F.log2("weight")), F.xxhash64(F.lit(turn), lo, hi), -lo, -hi)).alias("to"))
        pairs = tmp.write(best.alias("a").join(best.alias("b"), (F.col("a.to") == F.col("b.src")) & (F.col("b.to") == F.col("a.src"))).select(F.col("a.src").alias("id"), F.least("a.src", "a.to").alias("part")), "pairs")
        out.append(pairs._scratch_path)
        taken = pairs.select("id")
        left = tmp.write(e.join(taken.withColumnRenamed("id", "src"), "src", "left_anti").join(taken.withColumnRenamed("id", "dst"), "dst", "left_anti"), "edges")
        tmp.drop(e)
        e, turn = left, turn + 1
        _log.info("matching round %d done", turn)
        if e.isEmpty():
            return edges.sparkSession.read.schema(pairs.schema).parquet(*out)


def part_interfaces(edges: DataFrame, labels: DataFrame, one_sided: bool = False) -> DataFrame:
    """Nodes of edges that join two parts: ``low, high, id``; with ``one_sided`` only those of the lower part."""
    side = lambda k: labels.select(F.col("id").alias(k), F.col("part").alias(f"p_{k}"))
    e = edges.join(side("src"), "src").join(side("dst"), "dst").where("p_src <> p_dst")
    ends = F.array(F.when(F.col("p_src") < F.col("p_dst"), F.col("src")).otherwise(F.col("dst"))) if one_sided else F.array("src", "dst")
    return e.select(F.least("p_src", "p_dst").alias("low"), F.greatest("p_src", "p_dst").alias("high"), F.explode(ends).alias("id")).distinct()


def overlap_extend(labels: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """Each part grown by layers of neighbours: ``part, id, core``."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    grown = labels.select("part", "id")
    for _ in range(layers):
        step = grown.withColumnRenamed("id", "src").join(both, "src").select("part", F.col("dst").alias("id"))
        grown = grown.unionByName(step).distinct()
    return grown.join(labels.select("part", "id", F.lit(True).alias("core")), ["part", "id"], "left").select("part", "id", F.coalesce("core", F.lit(False)).alias("core"))


def coarse_operator(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Galerkin sums with one normalised constant a part: sum a_ij / sqrt(n_I n_J)."""
    n = labels.groupBy("part").agg(F.count("*").alias("n"))
    lab = labels.join(n, "part")
    side = lambda k: lab.select(F.col("id").alias(k), F.col("part").alias(f"p_{k}"), F.col("n").alias(f"n_{k}"))
    m = matrix.join(side("row"), "row").join(side("col"), "col")
    return m.groupBy(F.col("p_row").alias("row"), F.col("p_col").alias("col")).agg(F.sum(F.col("value") / F.sqrt(F.col("n_row") * F.col("n_col"))).alias("value"))


def corner_nodes(membership: DataFrame) -> DataFrame:
    """Members ``part, id`` of nodes that three or more parts share."""
    many = membership.groupBy("id").agg(F.count_distinct("part").alias("k")).where("k >= 3").select("id")
    return membership.join(many, "id", "left_semi").select("part", "id").distinct()


def _spread(v: Column, dim: int) -> Column:
    """The 16 low bits of ``v`` with ``dim - 1`` zeros between them."""
    masks = {2: ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)), 3: ((16, 0x00FF0000FF), (8, 0x0F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249))}[dim]
    for shift, mask in masks:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton_partition(points: DataFrame, n_parts: int, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``id, code, part``: equal runs along the 16-bit Z-order of ``points(id, x, y)``, ties by id; two or three ``dims``."""
    from fieldloom.operators.order import dense_ids

    box = points.agg(*[f(c).alias(f"{m}{c}") for c in dims for m, f in (("lo", F.min), ("hi", F.max))])
    p = points.crossJoin(F.broadcast(box))  # one row is broadcast
    code = F.lit(0).cast("long")
    for k, c in enumerate(dims):
        at = F.least(F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}") + 1e-10) * 65536), F.lit(65535)).cast("long")
        code = code.bitwiseOR(F.shiftleft(_spread(at, len(dims)), k))
    p = p.select("id", code.alias("code"))
    total = points.count()
    size = max(1, total // n_parts)
    return dense_ids(p, ["code", "id"], "r").select("id", "code", F.least(F.floor(F.col("r") / size), F.lit(n_parts - 1)).alias("part"))


def kdtree_partition(points: DataFrame, n_parts: int, longest: bool = False) -> DataFrame:
    """Recursive exact medians of ``points(id, x, y)``: left <= median; axis by depth, or the block's longest.

    Parts split n // 2 : rest while points always halve, so a number that is not
    a power of two is unbalanced.  One pass a level; medians come from counts
    summed up in order over all partitions, never from one task.
    """
    from fieldloom.operators.order import quantiles

    tmp = Scratch(points.sparkSession, "kdtree")
    now = tmp.write(points.select("id", "x", "y", F.lit(0).alias("part"), F.lit(n_parts).alias("n")), "level")
    depth = 0
    while (1 << depth) < 2 * n_parts and not now.where("n > 1").isEmpty():
        if longest:
            span = now.groupBy("part").agg((F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("use_x"))
            at = now.join(F.broadcast(span), "part")  # n_parts rows at most
        else:
            at = now.withColumn("use_x", F.lit(depth % 2 == 0))
        at = tmp.write(at.select("id", "x", "y", "part", "n", F.when(F.col("use_x"), F.col("x")).otherwise(F.col("y")).alias("v")), "axis")
        mid = quantiles(at, "v", [0.5], ["part"]).select("part", F.col("q0").alias("mid"))
        left, half = F.col("v") <= F.col("mid"), F.floor(F.col("n") / 2).cast("int")
        after = at.join(F.broadcast(mid), "part").select("id", "x", "y", F.when((F.col("n") > 1) & ~left, F.col("part") + half).otherwise(F.col("part")).cast("int").alias("part"), F.when(F.col("n") <= 1, F.col("n")).when(left, half).otherwise(F.col("n") - half).cast("int").alias("n"))  # n_parts rows at most
        old, now = now, tmp.write(after, "level")
        tmp.drop(old, at)
        depth += 1
    return now.select("id", "part")


def best_neighbor(edges: DataFrame) -> DataFrame:
    """Heaviest neighbour of each node, ties by the smaller id."""
    best = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.max(F.struct("weight", -F.col("dst"))).alias("b"))
    return best.select("id", (-F.col("b").getField("col2")).alias("dst"), F.col("b.weight").alias("weight"))
