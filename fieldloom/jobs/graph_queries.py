"""Registered spatial, graph, matrix and partition queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.jobs.tables import MESH, mesh, points, rounded, table
from fieldloom.operators import graph as G
from fieldloom.operators import mesh as M
from fieldloom.operators import spatial as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _vec(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(e[0].cast("double"), e[1].cast("double")).alias("p"), (e[2].cast("double") + 1).alias("value"))


_V = "v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) + 1 AS value FROM embeddings), pr AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, b.value FROM v a, v b)"


@query("spatial_knn", f"WITH {_V} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, other) AS INTEGER) AS rank, other, round(dist, 6) AS dist FROM pr WHERE id <> other QUALIFY rank <= 5")
def knn(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return rounded(S.knn_join(v, v, 5))


@query("spatial_nearest", f"WITH {_V} SELECT id, min_by(other, (dist, other)) AS other, round(min(dist), 6) AS dist FROM pr WHERE id <> other GROUP BY id")
def nearest(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return rounded(S.knn_join(v, v, 1).select("id", "other", "dist"))


@query("spatial_radius", f"WITH {_V} SELECT id, other, round(dist, 6) AS dist FROM pr WHERE dist < 0.05")
def radius(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return rounded(S.radius_join(v, v, 0.05))


@query(
    "spatial_idw",
    f"WITH {_V}, q AS (SELECT a.id + 1000000 AS id, b.value, sqrt((a.x + 0.01 - b.x) ** 2 + (a.y - 0.02 - b.y) ** 2) AS dist, b.id AS other FROM v a, v b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM q) SELECT id, round(sum(value / (dist + 1e-10)) / sum(1 / (dist + 1e-10)), 6) AS value FROM k WHERE r <= 4 GROUP BY id",
)
def idw(spark, sf_dir):
    v = _vec(spark, sf_dir)
    q = v.select((F.col("id") + 1_000_000).alias("id"), F.array(F.col("p")[0] + 0.01, F.col("p")[1] - 0.02).alias("p"))
    return rounded(S.idw_interpolate(v, v, q))


@query("spatial_rbf_interpolate")
def rbf(spark, sf_dir):
    """Thin-plate splines have no SQL; tests hold them against NumPy."""
    v = _vec(spark, sf_dir)
    q = v.select((F.col("id") + 1_000_000).alias("id"), F.array(F.col("p")[0] + 0.01, F.col("p")[1] - 0.02).alias("p"))
    return S.rbf_interpolate(v, v, q)


@query("spatial_density_filter", f"WITH {_V} SELECT id, round(sum((0.08 - dist) * value) / sum(0.08 - dist), 6) AS filtered FROM pr WHERE dist < 0.08 GROUP BY id")
def density(spark, sf_dir):
    return rounded(S.density_filter(_vec(spark, sf_dir).withColumnRenamed("value", "rho"), 0.08))


@query("spatial_potential", f"WITH {_V}, s AS (SELECT n_nationkey AS k, CAST(n_nationkey + 1 AS DOUBLE) AS q, n_nationkey * 0.1 - 1 AS sx, n_regionkey * 0.2 - 0.33 AS sy FROM nation) SELECT id, round(sum(CASE WHEN k % 2 = 0 THEN q / (2 * pi()) * ln(sqrt((x - sx) ** 2 + (y - sy) ** 2) + 1e-10) ELSE -q / (2 * pi()) * atan2(y - sy, x - sx) END), 5) AS potential FROM v, s GROUP BY id")
def potential(spark, sf_dir):
    v = _vec(spark, sf_dir).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    k = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(F.when(k % 2 == 0, "source").otherwise("vortex").alias("kind"), (k + 1).cast("double").alias("strength"), (k * 0.1 - 1).alias("x"), (F.col("n_regionkey") * 0.2 - 0.33).alias("y"))
    return rounded(S.potential_superpose(v, s), 5)


@query("spatial_kernel_correct", f"WITH {_V}, s AS (SELECT n_nationkey * 0.05 - 0.6 AS sx, n_regionkey * 0.1 - 0.2 AS sy, CAST(n_nationkey AS DOUBLE) AS r FROM nation) SELECT id, round(sum(exp(-((x - sx) ** 2 + (y - sy) ** 2)) * r) / (sum(exp(-((x - sx) ** 2 + (y - sy) ** 2))) + 1e-10), 6) AS correction FROM v, s GROUP BY id")
def kernel(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey") * 0.05 - 0.6, F.col("n_regionkey") * 0.1 - 0.2).alias("p"), F.col("n_nationkey").cast("double").alias("residual"))
    return rounded(S.kernel_correct(_vec(spark, sf_dir), s))


_E = "e AS (SELECT l_suppkey AS src, 1000000 + l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), n AS (SELECT id, CAST(id % 97 AS DOUBLE) AS f FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)), sym AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.sum("l_quantity").alias("weight"))


def _lines(spark, sf_dir) -> tuple[DataFrame, int]:
    """The same edges before they are summed, and their number, which the files tell."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"), F.col("l_quantity").alias("weight")), li.count()


def _nodes(e: DataFrame) -> DataFrame:
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return ids.select("id", (F.col("id") % 97).cast("double").alias("f"))


for _how, _f in (("mean", "avg"), ("sum", "sum"), ("max", "max")):

    @query(f"graph_neighbor_{_how}", f"WITH {_E} SELECT n.id, round(coalesce({_f}(m.f), 0), 6) AS agg FROM n LEFT JOIN e ON e.dst = n.id LEFT JOIN n m ON m.id = e.src GROUP BY n.id")
    def neighbor(spark, sf_dir, how=_how):
        e = _edges(spark, sf_dir)
        return rounded(G.neighbor_aggregate(_nodes(e), e, how))


@query("graph_laplacian", f"WITH {_E}, d AS (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY src) SELECT id AS row, id AS col, 1.0 AS value FROM d UNION ALL SELECT s.src, s.dst, round(-s.weight / sqrt(a.d * b.d), 8) FROM sym s JOIN d a ON a.id = s.src JOIN d b ON b.id = s.dst")
def lap(spark, sf_dir):
    e, n = _lines(spark, sf_dir)
    return rounded(G.laplacian(e, rows=n), 8)


@query("matrix_spmv", f"WITH {_E}, d AS (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY src), l AS (SELECT id AS row, id AS col, d AS value FROM d UNION ALL SELECT src, dst, -weight FROM sym) SELECT row, round(sum(value * sqrt(f + 1)), 4) + 0.0 AS value FROM l JOIN n ON n.id = l.col GROUP BY row")
def spmv(spark, sf_dir):
    e = _edges(spark, sf_dir)
    x = _nodes(e).select(F.col("id").alias("row"), F.sqrt(F.col("f") + 1).alias("value"))
    return rounded(G.spmv(G.laplacian(e, normalized=False), x), 4)


@query("graph_chebyshev", f"""WITH {_E}, d AS (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY src), l AS (SELECT src AS row, dst AS col, -weight / sqrt(a.d * b.d) AS value FROM sym JOIN d a ON a.id = src JOIN d b ON b.id = dst),
 t0 AS (SELECT id AS row, f AS v FROM n), t1 AS (SELECT row, sum(value * v) AS v FROM l JOIN (SELECT row AS col, v FROM t0) USING (col) GROUP BY row), lt1 AS (SELECT row, sum(value * v) AS v FROM l JOIN (SELECT row AS col, v FROM t1) USING (col) GROUP BY row)
 SELECT t0.row, round(0.5 * t0.v + 0.3 * t1.v + 0.2 * (2 * lt1.v - t0.v), 6) + 0.0 AS value FROM t0 JOIN t1 USING (row) JOIN lt1 USING (row)""")
def chebyshev(spark, sf_dir):
    e, n = _lines(spark, sf_dir)
    f = _nodes(e).select(F.col("id").alias("row"), F.col("f").alias("value"))
    return rounded(G.chebyshev_filter(G.laplacian(e, rows=n), f, [0.5, 0.3, 0.2], largest=2.0))


@query("graph_contract", f"WITH {_E} SELECT src % 7 AS src, dst % 5 + 10 AS dst, round(sum(weight), 3) AS weight FROM e GROUP BY 1, 2")
def contract(spark, sf_dir):
    e = _edges(spark, sf_dir)
    lab = _nodes(e).select("id", F.when(F.col("id") < 1_000_000, F.col("id") % 7).otherwise(F.col("id") % 5 + 10).alias("part"))
    return rounded(G.contract_graph(e, lab), 3)


@query("graph_components", "WITH r AS (SELECT o_orderkey AS id, sum(CASE WHEN o_orderpriority = p THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey) AS run FROM (SELECT o_orderkey, o_orderpriority, lag(o_orderpriority) OVER (ORDER BY o_orderkey) AS p FROM orders)) SELECT min(id) AS part, count(*) AS size, round(avg(CAST(id % 97 AS DOUBLE)), 6) AS mean FROM r GROUP BY run")
def components(spark, sf_dir):
    """Orders linked to the next one of the same priority: the components are the runs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), "o_orderpriority")
    e = o.join(o.select((F.col("src") - 1).alias("src"), "o_orderpriority"), ["src", "o_orderpriority"]).select("src", (F.col("src") + 1).alias("dst"))
    nodes = o.select(F.col("src").alias("id"), (F.col("src") % 97).cast("double").alias("f"))
    return rounded(G.component_pool(nodes, e))


@query("graph_edge_cut", f"WITH {_E}, p AS (SELECT id, id % 4 AS part FROM n) SELECT count(*) FILTER (a.part <> b.part) AS edge_cut, round((SELECT max(c) / avg(c) FROM (SELECT count(*) AS c FROM p GROUP BY part)), 6) AS balance, (SELECT count(DISTINCT part) FROM p) AS parts FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst")
def cut(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return rounded(G.edge_cut(e, _nodes(e).select("id", (F.col("id") % 4).alias("part"))))


@query("graph_part_interfaces", f"WITH {_E}, p AS (SELECT id, id % 4 AS part FROM n), x AS (SELECT a.part AS pa, b.part AS pb, src, dst FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE a.part <> b.part) SELECT DISTINCT least(pa, pb) AS low, greatest(pa, pb) AS high, unnest([src, dst]) AS id FROM x")
def interfaces(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.part_interfaces(e, _nodes(e).select("id", (F.col("id") % 4).alias("part")))


@query("graph_coarse_operator", f"WITH {_E}, p AS (SELECT id, id % 6 AS part FROM n), k AS (SELECT part, count(*) AS n FROM p GROUP BY part), q AS (SELECT p.*, k.n FROM p JOIN k USING (part)) SELECT a.part AS row, b.part AS col, round(sum(weight / sqrt(a.n * b.n)), 6) AS value FROM e JOIN q a ON a.id = src JOIN q b ON b.id = dst GROUP BY 1, 2")
def coarse(spark, sf_dir):
    e = _edges(spark, sf_dir)
    m = e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))
    return rounded(G.coarse_operator(m, _nodes(e).select("id", (F.col("id") % 6).alias("part"))))


@query("graph_corner_nodes", f"WITH {_E}, m AS (SELECT DISTINCT src % 5 AS part, dst AS id FROM e) SELECT part, id FROM m WHERE id IN (SELECT id FROM m GROUP BY id HAVING count(DISTINCT part) >= 3)")
def corners(spark, sf_dir):
    return G.corner_nodes(_edges(spark, sf_dir).select((F.col("src") % 5).alias("part"), F.col("dst").alias("id")))


@query("graph_softmax", f"WITH {_E}, p AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM n), s AS (SELECT dst, (b.f / 97 - 0.5) * (a.f / 50) AS s, a.f AS v FROM p JOIN n a ON a.id = src JOIN n b ON b.id = dst), t AS (SELECT *, max(s) OVER (PARTITION BY dst) AS top FROM s) SELECT dst AS id, round(sum(exp(s - top) * v) / sum(exp(s - top)), 6) AS agg FROM t GROUP BY dst")
def softmax(spark, sf_dir):
    e = _edges(spark, sf_dir)
    n = _nodes(e).select("id", (F.col("f") / 97 - 0.5).alias("q"), (F.col("f") / 50).alias("k"), F.col("f").alias("v"))
    return rounded(G.softmax_aggregate(n, e))


@query("graph_match_pool")
def match(spark, sf_dir):
    """A maximal matching; tests check that it is one and that it is maximal."""
    e, n = _lines(spark, sf_dir)
    return G.match_pool(e, n)


_ME = f"{MESH}, f AS (SELECT mesh, unnest([[n0, n1], [n1, n2], [n2, n0]]) AS e FROM tri), me AS (SELECT DISTINCT least(e[1], e[2]) AS src, greatest(e[1], e[2]) AS dst FROM f)"


@query("graph_hops", f"{_ME}, d AS (SELECT src, dst FROM me), h2 AS (SELECT DISTINCT a.src, b.dst FROM d a JOIN d b ON b.src = a.dst WHERE a.src <> b.dst) SELECT src, dst, 1 AS hops FROM d UNION ALL SELECT src, dst, 2 FROM h2 ANTI JOIN d USING (src, dst)")
def hops(spark, sf_dir):
    return G.hop_distances(M.mesh_edges(mesh(spark, sf_dir)[1]), 2)


@query("graph_path_distances", f"""{_ME.replace("WITH", "WITH RECURSIVE", 1)}, w AS (SELECT src, dst, 1.0 + (src + dst) % 3 AS weight FROM me), s AS (SELECT * FROM w UNION ALL SELECT dst, src, weight FROM w),
 r(id, dist) AS (SELECT point_id, 0.0::DOUBLE FROM pts WHERE point_id % 100 = 0 UNION SELECT s.dst, r.dist + s.weight FROM r JOIN s ON s.src = r.id WHERE r.dist + s.weight <= 8) SELECT id, min(dist) AS dist FROM r GROUP BY id""")
def paths(spark, sf_dir):
    """Distances from a stated set of sources: the points whose id is divisible by 100."""
    e = M.mesh_edges(mesh(spark, sf_dir)[1]).select("src", "dst", (1.0 + (F.col("src") + F.col("dst")) % 3).alias("weight"))
    return G.path_distances(e, points(spark, sf_dir).where("point_id % 100 = 0").select(F.col("point_id").alias("id")), 8.0)


@query("graph_direction_bins", f"{_ME}, r AS (SELECT dst, a.u, CAST(floor((atan2(b.y - a.y, b.x - a.x) + pi()) / (2 * pi()) * 8) AS BIGINT) % 8 AS bin FROM me JOIN pts a ON a.point_id = src JOIN pts b ON b.point_id = dst) SELECT dst AS id, bin, round(sum(u) / any_value(deg), 6) AS agg FROM r JOIN (SELECT dst, count(*) AS deg FROM r GROUP BY dst) USING (dst) GROUP BY dst, bin")
def bins(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(G.direction_binned_aggregate(pts.select(F.col("point_id").alias("id"), "x", "y", F.col("u").alias("f")), M.mesh_edges(cells)))


_P = "p AS (SELECT (l_orderkey * 8 + l_linenumber) * 128 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def _cloud(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 128 + F.row_number().over(w)).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query("graph_voxel_pool", f"WITH {_P} SELECT CAST(floor(x / 3) AS BIGINT) AS vx, CAST(floor(y / 3) AS BIGINT) AS vy, count(*) AS size, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(sqrt(y)), 5) AS f FROM p GROUP BY 1, 2")
def voxels(spark, sf_dir):
    return rounded(G.voxel_pool(_cloud(spark, sf_dir).withColumn("f", F.sqrt("y")), 3.0), 5)


@query("partition_kdtree", f"""WITH {_P}, a AS (SELECT *, CASE WHEN x <= median(x) OVER () THEN 0 ELSE 1 END AS l1 FROM p), b AS (SELECT *, CASE WHEN y <= median(y) OVER (PARTITION BY l1) THEN 0 ELSE 1 END AS l2 FROM a) SELECT id, CAST(2 * l1 + l2 AS INTEGER) AS part FROM b""")
def kdtree(spark, sf_dir):
    return G.kdtree_partition(_cloud(spark, sf_dir), 4)


_SP = lambda v: f"list_sum([(({v} >> k) & 1) << (2 * k) for k in range(16)])"


@query("partition_morton", f"""WITH {_P}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS n FROM p), g AS (SELECT id, n, least(CAST(floor((x - lx) / (hx - lx + 1e-10) * 65536) AS BIGINT), 65535) AS gx, least(CAST(floor((y - ly) / (hy - ly + 1e-10) * 65536) AS BIGINT), 65535) AS gy FROM p, b),
 c AS (SELECT id, n, CAST({_SP('gx')} + 2 * {_SP('gy')} AS BIGINT) AS code FROM g) SELECT id, code, CAST(least((row_number() OVER (ORDER BY code, id) - 1) // (n // 8), 7) AS BIGINT) AS part FROM c""")
def morton(spark, sf_dir):
    return G.morton_partition(_cloud(spark, sf_dir), 8).withColumn("part", F.col("part").cast("long"))
