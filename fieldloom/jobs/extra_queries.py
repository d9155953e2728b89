"""Registered queries of the remaining operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.jobs.graph_queries import _E, _V, _edges, _lines, _ME, _nodes, _vec
from fieldloom.jobs.mesh_queries import _EDGES
from fieldloom.jobs.tables import MESH, mesh, points, rounded, table
from fieldloom.operators import extra as X
from fieldloom.operators import graph as G
from fieldloom.operators import mesh as M
from fieldloom.operators.regress import library

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("rom_pair_snapshots", "SELECT event_type, step, x, y FROM (SELECT event_type, h AS step, x, lead(x) OVER w AS y, lead(h) OVER w AS n FROM (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS h, round(avg(sqrt(value)), 6) AS x FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY h)) WHERE n = step + 1")
def pairs(spark, sf_dir):
    h = ((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("long")
    s = table(spark, sf_dir, "events").groupBy("event_type", h.alias("step")).agg(F.round(F.avg(F.sqrt("value")), 6).alias("v"))
    return X.pair_snapshots(s, ["event_type"], "step", "v")


@query("spatial_observation_misfit", f"WITH {_V}, q AS (SELECT a.id, a.value * 0.5 AS observed, b.value, sqrt((a.x + 0.01 - b.x) ** 2 + (a.y - 0.02 - b.y) ** 2) AS dist, b.id AS other FROM v a, v b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM q), p AS (SELECT id, any_value(observed) AS o, sum(value / (dist + 1e-10)) / sum(1 / (dist + 1e-10)) AS v FROM k WHERE r <= 4 GROUP BY id) SELECT count(*) AS n, round(0.5 * sum((v - o) ** 2), 5) AS misfit FROM p")
def misfit(spark, sf_dir):
    v = _vec(spark, sf_dir)
    s = v.select("id", F.array(F.col("p")[0] + 0.01, F.col("p")[1] - 0.02).alias("p"), (F.col("value") * 0.5).alias("observed"))
    return rounded(X.match_observations(v, v, s), 5)


@query("matrix_neumann_load", f"{MESH}, {_EDGES}, h AS (SELECT r.mesh, a, b, 2.5 * sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) / 2 AS v FROM rim r JOIN pts p ON p.point_id = a JOIN pts q ON q.point_id = b) SELECT mesh, point_id, round(sum(v), 6) AS load FROM (SELECT mesh, a AS point_id, v FROM h UNION ALL SELECT mesh, b, v FROM h) GROUP BY mesh, point_id")
def neumann(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    e = M.boundary_faces(cells).select("mesh", F.col("face")[0].alias("a"), F.col("face")[1].alias("b"))
    return rounded(X.neumann_load(e, pts, F.lit(2.5)))


_OC = "greatest(0.3, least(0.7, 0.5 * sqrt(s / exp((lo + hi) / 2)))) "


@query(
    "field_oc_update",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, sqrt(o_totalprice) AS s FROM orders),
 b(k, lo, hi) AS (SELECT 0, ln(1e-12::DOUBLE), ln(1e12::DOUBLE) UNION ALL SELECT k + 1, CASE WHEN sum({_OC}) > 0.5 * count(*) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sum({_OC}) > 0.5 * count(*) THEN hi ELSE (lo + hi) / 2 END FROM b, o WHERE k < 60 GROUP BY k, lo, hi)
 SELECT id, round({_OC}, 6) AS rho FROM o, b WHERE k = 60""",
)
def oc(spark, sf_dir):
    """Densities of all order cells at half the volume; the multiplier is searched down to double precision."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.5).alias("rho"), (-F.sqrt("o_totalprice")).alias("dc"), F.lit(1.0).alias("volume"))
    return rounded(X.oc_update(o, 0.5, rounds=10))


@query(
    "graph_heat_diffusion",
    f"""WITH RECURSIVE {_E}, d AS (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY src), l AS (SELECT src AS row, dst AS col, weight / sqrt(a.d * b.d) AS value FROM sym JOIN d a ON a.id = src JOIN d b ON b.id = dst),
 r(k, row, v) AS (SELECT 0, id, f FROM n UNION ALL SELECT k + 1, l.row, sum(l.value * r.v) / (k + 1) FROM r JOIN l ON l.col = r.row WHERE k < 24 GROUP BY k, l.row)
 SELECT row, round(exp(-1.0::DOUBLE) * sum(v), 6) + 0.0 AS value FROM r GROUP BY row""",
)
def heat(spark, sf_dir):
    """Heat kernel of the supplier-part graph; the SQL is the series of the matrix exponential."""
    e, n = _lines(spark, sf_dir)
    return rounded(X.heat_diffuse(G.laplacian(e, rows=n), _nodes(e).select(F.col("id").alias("row"), F.col("f").alias("value")), 1.0))


@query("graph_unpool", f"WITH {_E}, c AS (SELECT id % 6 AS part, avg(f) AS f FROM n GROUP BY 1) SELECT n.id, round(c.f, 6) AS f FROM n JOIN c ON c.part = n.id % 6")
def unpool(spark, sf_dir):
    n = _nodes(_edges(spark, sf_dir)).withColumn("part", F.col("id") % 6)
    return rounded(X.unpool(n.groupBy("part").agg(F.avg("f").alias("f")), n.select("id", "part")))


@query("graph_hierarchy")
def hierarchy(spark, sf_dir):
    """Labels of three levels of matching (a tie-broken search, not SQL; tests check that each level is a matching of the one before)."""
    (e, n), out = _lines(spark, sf_dir), None
    for k, lab in enumerate(X.build_hierarchy(e, 3, rows=n)):
        part = lab.withColumn("level", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@query("graph_kmeans_pool")
def kmeans(spark, sf_dir):
    """Labels by seeded k-means (random starts, not SQL; tests check means, members and edges)."""
    from fieldloom.operators.spatial import knn_join

    v = _vec(spark, sf_dir).withColumnRenamed("value", "f")
    return X.kmeans_pool(v, knn_join(v, v, 4).select(F.col("id").alias("src"), F.col("other").alias("dst")), 8)[0]


@query("graph_local_frames", f"{_ME}, b AS (SELECT src, dst FROM me UNION ALL SELECT dst, src FROM me), m AS (SELECT src AS id, avg(q.x - p.x) AS dx, avg(q.y - p.y) AS dy FROM b JOIN pts p ON p.point_id = src JOIN pts q ON q.point_id = dst GROUP BY src), fr AS (SELECT point_id AS id, sqrt(dx * dx + dy * dy) AS n, dx, dy FROM pts LEFT JOIN m ON m.id = point_id), u AS (SELECT id, CASE WHEN n > 1e-10 THEN dx / n ELSE 1 END AS ux, CASE WHEN n > 1e-10 THEN dy / n ELSE 0 END AS uy FROM fr) SELECT id, round(ux, 5) + 0.0 AS ux, round(uy, 5) + 0.0 AS uy, round(-uy, 5) + 0.0 AS vx, round(ux, 5) + 0.0 AS vy FROM u")
def frames(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    e = M.mesh_edges(cells)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rounded(X.local_frames(pts.select(F.col("point_id").alias("id"), "x", "y"), both), 5)


@query("graph_edge_harmonics", f"{_ME}, e AS (SELECT src, dst, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS r, q.x - p.x AS dx, q.y - p.y AS dy FROM me JOIN pts p ON p.point_id = src JOIN pts q ON q.point_id = dst) SELECT src, dst, round(r, 6) AS r, round(exp(-r), 6) AS radial1, round(exp(-2 * r), 6) AS radial2, round(dx / r, 6) + 0.0 AS c, round(dy / r, 6) + 0.0 AS s, round((dx / r) ** 2 - (dy / r) ** 2, 6) + 0.0 AS c2, round(2 * dx / r * dy / r, 6) + 0.0 AS s2 FROM e")
def harmonics(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(X.edge_harmonics(M.mesh_edges(cells), pts.select(F.col("point_id").alias("id"), "x", "y"), 2))


@query("graph_edge_max", f"WITH {_V}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM pr WHERE id <> other) SELECT k.id, round(max(a.value), 6) AS f, round(max(k.value - a.value), 6) + 0.0 AS rise FROM k JOIN v a ON a.id = k.id WHERE r <= 4 GROUP BY k.id")
def edge_max(spark, sf_dir):
    return rounded(X.edge_max_aggregate(_vec(spark, sf_dir).withColumnRenamed("value", "f"), 4))


@query("regress_fit_by_flag", "SELECT l_returnflag, unnest(['1', 'l_quantity']) AS term, unnest([round(regr_intercept(l_extendedprice, l_quantity), 3), round(regr_slope(l_extendedprice, l_quantity), 3)]) AS coef FROM lineitem GROUP BY l_returnflag")
def fit_by(spark, sf_dir):
    return rounded(X.sindy_fit_by(table(spark, sf_dir, "lineitem"), library(["l_quantity"], 1), "l_extendedprice", "l_returnflag", 0.0), 3)


@query("regress_transfer", "WITH c AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_returnflag, round(sum(l_extendedprice - (a + b * l_quantity)), 0) + 0.0 AS total_residual, round(avg((l_extendedprice - (a + b * l_quantity)) ** 2), 0) AS mean_square FROM lineitem, c GROUP BY l_returnflag")
def transfer(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = F.col("l_extendedprice") - X.fit_transfer(li, "l_quantity", "l_extendedprice")
    return rounded(li.groupBy("l_returnflag").agg(F.sum(r).alias("total_residual"), F.avg(r * r).alias("mean_square")), 0)


@query("regress_ensemble")
def ensemble(spark, sf_dir):
    """Twenty bootstraps of the price model in one pass (hash weights, not SQL; tests check the weights and the spread)."""
    li = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000).withColumn("row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return X.sindy_ensemble(li, library(["l_quantity", "l_discount"], 1), "price", "row", 20, 0.05)


@query("uq_posterior_summary")
def posterior(spark, sf_dir):
    """Chains for each user's mean event value (random walks, not SQL; tests compare mean and deviation with the exact posterior)."""
    e = table(spark, sf_dir, "events").select("user_id", (F.sqrt("value") / 5).alias("v"))
    p = e.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") ** 2).alias("square"))
    return X.posterior_summary(X.mcmc_chains(p, 2, 300), 100)


@query("uq_enki_gain", "SELECT round(covar_samp(t, g) / (var_pop(g) + 0.25), 6) AS gain FROM (SELECT l_quantity AS t, sqrt(l_extendedprice) AS g FROM lineitem)")
def gain(spark, sf_dir):
    return rounded(X.enki_gain(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("theta"), F.sqrt("l_extendedprice").alias("g")), 0.5))


@query("uq_enki_step")
def enki(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).cast("double").alias("theta"), F.sqrt("o_totalprice").alias("g"))
    return X.enki_step(e, 400.0, 0.5)


@query("array_augment", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS head, round(list_reverse(embedding)[1]::DOUBLE, 6) AS reversed_head, round(-embedding[1]::DOUBLE, 6) + 0.0 AS negated_head, round(embedding[len(embedding) - 2]::DOUBLE, 6) AS rolled_head FROM embeddings")
def augment(spark, sf_dir):
    e = F.col("embedding")
    first = lambda c: c[0].cast("double")
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", first(e).alias("head"), first(X.augment(e, "reverse")).alias("reversed_head"), first(X.augment(e, "negate")).alias("negated_head"), first(X.augment(e, "roll", 3)).alias("rolled_head")))


@query("state_material_report", "WITH m AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest(['air', 'aluminum', 'copper', 'rubber', 'steel', 'titanium', 'water']) AS name, unnest([1.2, 2700.0, 8960.0, 1100.0, 7850.0, 4500.0, 1000.0]) AS density) SELECT name, count(*) AS n, round(sum(sqrt(p_retailprice) * density), 1) AS mass FROM part JOIN m ON m.k = p_partkey % 7 GROUP BY name")
def material_report(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("air", "aluminum", "copper", "rubber", "steel", "titanium", "water")])
    p = table(spark, sf_dir, "part").select(F.get(names, (F.col("p_partkey") % 7).cast("int")).alias("name"), F.sqrt("p_retailprice").alias("v"))
    return rounded(p.join(F.broadcast(X.materials(spark)), "name").groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("density")).alias("mass")), 1)  # seven rows are broadcast


@query("field_mean_by_mesh", f"{MESH.split(', cells AS')[0]} SELECT mesh, count(*) AS n, round(avg(u), 5) AS mean FROM pts GROUP BY mesh")
def by_mesh(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("point_id").alias("id"), "mesh", "u")
    g = G.pool_means(p.select("id", "u"), p.select("id", F.col("mesh").alias("part")), ("u",))
    return rounded(g.select(F.col("part").alias("mesh"), F.col("size").alias("n"), F.col("u").alias("mean")), 5)


@query(
    "rom_gram_by_label",
    """WITH s AS (SELECT vec_id AS dof, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT dof, label, k, v - avg(v) OVER (PARTITION BY dof) AS v FROM s)
 SELECT a.label, CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(sum(a.v * b.v), 6) + 0.0 AS s FROM c a JOIN c b ON a.dof = b.dof AND a.k <= b.k GROUP BY a.label, a.k, b.k""",
)
def gram_by_label(spark, sf_dir):
    from fieldloom.operators.rom import gram_by

    return rounded(gram_by(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("xs")), "label"))


@query("rom_pod_by_label")
def pod_by_label(spark, sf_dir):
    """Singular values of each label's snapshots (tests compare with NumPy)."""
    from fieldloom.operators.rom import pod_per_group

    return pod_per_group(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("xs")), "label", 6)


_NODES = [float(0.5 * (1 - math.cos(math.pi * (2 * k + 1) / 10))) for k in range(5)]


@query(
    "uq_collocation",
    f"""WITH q AS (SELECT quantile_cont(l_quantity, {_NODES}) AS a, quantile_cont(l_discount, {_NODES}) AS b FROM lineitem), g AS (SELECT p, unnest(b) AS d FROM (SELECT unnest(a) AS p, b FROM q))
 SELECT round(avg(sqrt(p) * (1 - d)), 6) AS mean, round(stddev_pop(sqrt(p) * (1 - d)), 6) AS std FROM g""",
)
def collocation(spark, sf_dir):
    """A model of quantity and discount on the Chebyshev grid mapped through their quantiles."""
    from fieldloom.operators.uq import collocation_stats

    return rounded(collocation_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], F.sqrt("l_quantity") * (1 - F.col("l_discount"))))


@query(
    "fidelity_selection",
    """WITH o AS (SELECT o_orderkey AS id, sqrt(o_totalprice) / 100 AS x FROM orders), t AS (SELECT x, v, ln(exp(-1.5 * v - 0.2 * x) * (1 + 0.1 * sin(x * 9)) + 1e-12) AS e FROM o, (SELECT unnest([0.0::DOUBLE, 1.0, 2.0]) AS v)),
 c AS (SELECT regr_slope(e, x) AS bx, regr_slope(e, v) AS bv, avg(e) - regr_slope(e, x) * avg(x) - regr_slope(e, v) AS b FROM t),
 p AS (SELECT id, unnest([0, 1, 2]) AS level, unnest([11.0::DOUBLE, 8.0, 0.0]) AS saved, exp(b + bx * x + bv * unnest([0.0::DOUBLE, 1.0, 2.0])) AS predicted FROM o, c)
 SELECT id, CAST(level AS INTEGER) AS level, round(predicted, 6) AS predicted, round(1 - predicted / 0.1, 5) + 0.0 AS confidence, saved FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN predicted <= 0.1 THEN level ELSE 10 - level END) = 1""",
)
def selection(spark, sf_dir):
    """Level chosen for each order by a log-error model of all orders at three levels ; levels and parameters are balanced, so SQL fits them one by one."""
    from fieldloom.operators.uq import fidelity_selector, select_fidelity

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.sqrt("o_totalprice") / 100).alias("x"))
    train = o.select("x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level")).withColumn("error", F.exp(-1.5 * F.col("level") - 0.2 * F.col("x")) * (1 + 0.1 * F.sin(F.col("x") * 9)))
    got = select_fidelity(o, fidelity_selector(train, ["x"], 3), [1.0, 4.0, 12.0], 0.1)
    return got.select("id", "level", F.round("predicted", 6).alias("predicted"), (F.round("confidence", 5) + F.lit(0.0)).alias("confidence"), "saved")
