"""Registered queries on snapshots, fields, matrices, candidates and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.jobs.tables import MESH, mesh, points, rounded, table
from fieldloom.operators import fields as A
from fieldloom.operators import mesh as M
from fieldloom.operators import rom as R
from fieldloom.operators import surrogate as C
from fieldloom.sources.scratch import Scratch

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _snap(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.col("embedding").cast("array<double>").alias("xs"))


@query(
    "rom_gram",
    """WITH s AS (SELECT vec_id AS dof, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT dof, k, v - avg(v) OVER (PARTITION BY dof) AS v FROM s)
 SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(sum(a.v * b.v), 6) + 0.0 AS s FROM c a JOIN c b ON a.dof = b.dof AND a.k <= b.k GROUP BY a.k, b.k""",
)
def gram(spark, sf_dir):
    return rounded(R.gram(_snap(spark, sf_dir)))


@query("rom_pod_modes")
def pod(spark, sf_dir):
    """Eight modes of the embedding snapshots by dof (eigenvectors have no SQL; tests compare with NumPy)."""
    return R.pod_fit(_snap(spark, sf_dir), n_modes=8).modes


@query("rom_pod_error")
def pod_err(spark, sf_dir):
    s = _snap(spark, sf_dir)
    return R.pod_error(s, R.pod_fit(s, n_modes=8))


@query("rom_dmd_prediction")
def dmd(spark, sf_dir):
    """Rank-8 dynamic modes of the embedding snapshots, predicted for three steps of each dof."""
    return R.dmd_predict(R.dmd_fit(_snap(spark, sf_dir), rank=8), [0, 1, 63])


@query("rom_leverage_sample")
def leverage(spark, sf_dir):
    return R.leverage_sample(R.pod_fit(_snap(spark, sf_dir), n_modes=4).modes, 50, seed=3)


@query(
    "field_stats",
    "SELECT l_returnflag, l_linestatus, round(sum(abs(v)), 3) AS l1, round(sqrt(sum(v * v)), 4) AS l2, round(max(abs(v)), 6) AS max_abs, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT l_returnflag, l_linestatus, sqrt(l_extendedprice) - 150 AS v FROM lineitem) GROUP BY 1, 2",
)
def stats(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.sqrt("l_extendedprice") - 150).alias("value"))
    s = A.field_stats(f, ["l_returnflag", "l_linestatus"])
    return s.select("l_returnflag", "l_linestatus", F.round("l1", 3).alias("l1"), F.round("l2", 4).alias("l2"), *[F.round(c, 6).alias(c) for c in ("max_abs", "low", "high")])


@query("field_difference", "SELECT o_orderkey, round(sqrt(o_totalprice) - s, 6) AS value FROM orders JOIN (SELECT l_orderkey, sum(sqrt(l_extendedprice)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def difference(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.sqrt("o_totalprice").alias("value"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.sqrt("l_extendedprice")).alias("value"))
    return rounded(A.field_arith(a, b, "-", ["o_orderkey"]))


_W = MESH.split(", cells AS")[0]


@query("field_regions", _W + " SELECT region, count(*) AS n, round(avg(u), 5) AS mean FROM (SELECT u, CASE WHEN (x - 25) ** 2 + (y - 50) ** 2 <= 400 THEN 'core' WHEN x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 60 THEN 'west' WHEN x >= 20 THEN 'east' END AS region FROM pts) GROUP BY region")
def regions(spark, sf_dir):
    r = [("east", 1, F.col("x") >= 20), ("west", 5, A.in_box([(0, 20), (0, 60)])), ("core", 9, A.in_ball((25, 50), 20))]
    return rounded(A.assign_regions(points(spark, sf_dir), r).groupBy("region").agg(F.count("*").alias("n"), F.avg("u").alias("mean")), 5)


@query("field_method_choice", _W + " SELECT method, count(*) AS n, round(max(peclet), 5) AS top FROM (SELECT u * 0.1 / 20 AS peclet, CASE WHEN u * 0.1 / 20 > 2 THEN 'upwind' ELSE 'central' END AS method FROM pts) GROUP BY method")
def methods(spark, sf_dir):
    p = A.select_method(points(spark, sf_dir), F.col("u"), F.lit(0.1), 20.0)
    return rounded(p.groupBy("method").agg(F.count("*").alias("n"), F.max("peclet").alias("top")), 5)


@query("field_robin", _W + " SELECT mesh, point_id, 10.0 AS alpha, 1.0 AS beta, 250.0 AS g FROM pts WHERE x < 0.5")
def robin(spark, sf_dir):
    return A.robin_values(points(spark, sf_dir), F.col("x") < 0.5, 10.0, 25.0).select("mesh", "point_id", "alpha", "beta", "g")


@query("field_simp", "SELECT l_returnflag, round(sum(greatest(l_discount * 10, 1e-3) ** 3), 5) AS stiffness, round(sum(-3 * (l_discount * 10) ** 2 * sqrt(l_quantity)), 4) AS sensitivity FROM lineitem GROUP BY 1")
def simp(spark, sf_dir):
    rho = F.col("l_discount") * 10
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(A.simp_penalize(rho)).alias("stiffness"), F.sum(A.simp_sensitivity(rho, F.sqrt("l_quantity"))).alias("sensitivity"))
    return g.select("l_returnflag", F.round("stiffness", 5).alias("stiffness"), F.round("sensitivity", 4).alias("sensitivity"))


@query("field_pnorm_stress", "SELECT l_suppkey, round(sum((sqrt(l_extendedprice) / 200) ** 8) ** (1 / 8.0) - 1, 6) AS violation FROM lineitem GROUP BY 1")
def pnorm(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", F.sqrt("l_extendedprice").alias("stress"))
    return rounded(A.pnorm_stress(s, 200.0, ["l_suppkey"]))


@query("field_regularization", "SELECT user_id, round(0.5 * sum(p * p), 4) AS tikhonov, round(sum(sqrt(d * d + 1e-6)), 5) AS tv, round(sum(abs(p)), 5) AS l1 FROM (SELECT user_id, p, p - lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM (SELECT user_id, event_id, sqrt(value) AS p FROM events)) GROUP BY 1")
def regularize(spark, sf_dir):
    r = A.regularization(table(spark, sf_dir, "events").select("user_id", "event_id", F.sqrt("value").alias("p")), "user_id", "event_id")
    return r.select("user_id", F.round("tikhonov", 4).alias("tikhonov"), F.round("tv", 5).alias("tv"), F.round("l1", 5).alias("l1"))


@query("field_conserved", "SELECT event_type, round(stddev_pop(t), 4) AS std, round(avg(abs(t)), 4) AS mean_abs, stddev_pop(t) > 0.01 * avg(abs(t)) AS violated FROM (SELECT event_type, CAST(ts AS DATE) AS d, sum(sqrt(value)) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def conserved(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("d"), F.sqrt("value").alias("v"))
    return rounded(A.conserved_over_time(e, "event_type", "d", "v"), 4)


@query("field_grid_residual", _W + " SELECT point_id, round(r, 5) + 0.0 AS residual FROM (SELECT point_id, -(lag(u) OVER w - 2 * u + lead(u) OVER w) / 0.25 AS r FROM pts WINDOW w AS (PARTITION BY mesh, point_id // 50 ORDER BY x)) WHERE r IS NOT NULL")
def grid_residual(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("line", F.floor(F.col("point_id") / 50))
    return rounded(A.grid_residual(p, 0.5, ["mesh", "line"], "x").select("point_id", "residual"), 5)


_K = """k3 AS (SELECT mesh, volume, [n0, n1, n2] AS n, [x2 - x1, x0 - x2, x1 - x0] AS ex, [y2 - y1, y0 - y2, y1 - y0] AS ey FROM geo), ij AS (SELECT i, j FROM (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2, 3]) AS j)),
 k AS (SELECT mesh, n[i] AS row, n[j] AS col, sum((ex[i] * ex[j] + ey[i] * ey[j]) / (4 * volume)) AS value FROM k3, ij GROUP BY mesh, n[i], n[j])"""


@query("matrix_stiffness", f"{MESH}, {_K} SELECT mesh, row, col, round(value, 6) + 0.0 AS value FROM k")
def stiffness(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(A.stiffness(M.fat_cells(cells, pts)))


@query("matrix_load", MESH + " SELECT mesh, row, round(sum(v), 5) AS value FROM (SELECT mesh, unnest(nodes) AS row, volume / 3 * (u0 + u1 + u2) / 3 AS v FROM geo) GROUP BY mesh, row")
def load(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(A.load_vector(M.fat_cells(cells, pts, ("u",))), 5)


@query("matrix_residual", f"{MESH}, {_K} SELECT row, round(sum(k.value * p.u), 5) + 0.0 AS value FROM k JOIN pts p ON p.point_id = k.col GROUP BY row")
def residual(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(A.stiffness_product(M.fat_cells(cells, pts, ("u",))), 5)


@query(
    "matrix_stencil",
    """WITH n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), a AS (SELECT id AS row, unnest([id + 1, id - 1, id + 50, id - 50]) AS col, unnest([4.0, 4.0 + 2.0, 4.0 + 1.0, 4.0]) AS c, unnest([(id + 1) // 50 = id // 50, id % 50 > 0, true, true]) AS ok FROM n),
 r AS (SELECT row, col, c FROM a WHERE ok AND col IN (SELECT id FROM n)) SELECT row, col, round(-c, 6) AS value FROM r UNION ALL SELECT row, row, round(sum(c), 6) FROM r GROUP BY row""",
)
def stencil(spark, sf_dir):
    """Orders as grid cells; those of status P are the holes of the domain, so that absent neighbours occur."""
    c = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return rounded(A.stencil_matrix(c, 50, 1.0, (1.0, -0.5), 0.5))


@query("candidates_ensemble", "SELECT o_custkey AS id, round(avg(m), 6) AS mean, round(sqrt(avg(s * s) + var_pop(m)), 6) AS std FROM (SELECT o_custkey, sqrt(o_totalprice) AS m, 1.0 + o_orderkey % 5 AS s FROM orders) GROUP BY 1")
def ensemble(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.sqrt("o_totalprice").alias("mean"), (1.0 + F.col("o_orderkey") % 5).alias("std"))
    return rounded(C.ensemble_combine(p))



@query(
    "candidates_expected_improvement",
    """WITH c AS (SELECT o_orderkey AS id, sqrt(o_totalprice) / 100 AS mean, 0.1 + (o_orderkey % 9) * 0.2 AS std FROM orders), z AS (SELECT id, std, (1.5 - mean - 0.01) / std AS z FROM c),
 t AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS pdf, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z), q AS (SELECT *, pdf * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS q FROM t)
 SELECT id, round(std * (z * CASE WHEN z >= 0 THEN 1 - q ELSE q END + pdf), 7) + 0.0 AS score FROM q""",
)
def improvement(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.sqrt("o_totalprice") / 100).alias("mean"), (0.1 + (F.col("o_orderkey") % 9) * 0.2).alias("std"))
    return rounded(c.select("id", C.expected_improvement(F.col("mean"), F.col("std"), 1.5).alias("score")), 7)


@query("candidates_top", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top(spark, sf_dir):
    return rounded(C.top_candidates(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), 25), 2)


@query(
    "candidates_gp",
    """WITH RECURSIVE s AS (SELECT s_suppkey / 10.0::DOUBLE AS a, s_nationkey::DOUBLE AS b, s_acctbal / 1000 AS y, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS i FROM supplier), size AS (SELECT CAST(count(*) AS INTEGER) AS n FROM s),
 m AS (SELECT p.i, q.i AS j, exp(-0.5 * ((p.a - q.a) ** 2 + (p.b - q.b) ** 2)) + CASE WHEN p.i = q.i THEN 1e-6 ELSE 0 END AS v FROM s p, s q),
 g(k, i, j, v) AS (SELECT 0, i, j, v FROM m UNION ALL SELECT 0, p.i, q.i + n, CASE WHEN p.i = q.i THEN 1.0 ELSE 0.0 END::DOUBLE FROM s p, s q, size
  UNION ALL SELECT k + 1, i, j, CASE WHEN i = k + 1 THEN v / corner ELSE v - f * p / corner END FROM (SELECT *, max(v) FILTER (WHERE j = k + 1) OVER (PARTITION BY i) AS f, max(v) FILTER (WHERE i = k + 1) OVER (PARTITION BY j) AS p, max(v) FILTER (WHERE i = k + 1 AND j = k + 1) OVER () AS corner FROM g), size WHERE k < n),
 inv AS (SELECT i, list(v ORDER BY j) AS row FROM g, size WHERE k = n AND j > n GROUP BY i), ys AS (SELECT list(y ORDER BY i) AS y FROM s), alpha AS (SELECT list(list_inner_product(row, y) ORDER BY i) AS w FROM inv, ys),
 c AS (SELECT o_orderkey AS id, (o_custkey % 100) / 10.0::DOUBLE AS a, (o_orderkey % 25)::DOUBLE AS b FROM orders), u AS (SELECT DISTINCT a, b FROM c),
 k AS (SELECT u.a, u.b, list(exp(-0.5 * ((u.a - s.a) ** 2 + (u.b - s.b) ** 2)) ORDER BY i) AS k FROM u, s GROUP BY u.a, u.b),
 q AS (SELECT a, b, sum(k[i] * list_inner_product(k, row)) AS q FROM k, inv GROUP BY a, b)
 SELECT id, round(list_inner_product(k.k, w), 4) + 0.0 AS mean, round(sqrt(greatest(1 - q, 1e-10)), 4) AS std FROM c JOIN k USING (a, b) JOIN q USING (a, b), alpha""",
)
def gp(spark, sf_dir):
    """Gaussian process on supplier balances scored on every order; the SQL inverts the covariance by elimination."""
    s = table(spark, sf_dir, "supplier").select(F.array(F.col("s_suppkey").cast("double") / 10, F.col("s_nationkey").cast("double")).alias("p"), (F.col("s_acctbal") / 1000).alias("y"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array((F.col("o_custkey") % 100).cast("double") / 10, (F.col("o_orderkey") % 25).cast("double")).alias("p"))
    return rounded(C.gp_predict(o, s), 4)


_T = "t AS (SELECT user_id AS task, avg(value) AS a, stddev_pop(value) AS b, min(value) AS c, max(value) AS d FROM events GROUP BY user_id)"


@query("tasks_similar", f"WITH {_T}, p AS (SELECT q.task, t.task AS other, 1 / (1 + sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2 + (q.c - t.c) ** 2 + (q.d - t.d) ** 2)) AS similarity FROM t q, t WHERE q.task % 100 = 0 AND q.task <> t.task) SELECT task, CAST(row_number() OVER (PARTITION BY task ORDER BY similarity DESC, other) AS INTEGER) AS rank, other, round(similarity, 6) AS similarity FROM p QUALIFY rank <= 5")
def similar(spark, sf_dir):
    t = C.task_embedding(table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "value"))
    return rounded(C.similar_tasks(t.where("task % 100 = 0"), t).select("task", "rank", "other", "similarity"))


@query("stream_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(sqrt(var_pop(value) / count(value)), 6) AS standard_error FROM events GROUP BY event_type")
def stream_moments(spark, sf_dir):
    """The events read as a stream to its end; the last complete result is returned."""
    from fieldloom.streaming.incremental import streaming_moments

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    tmp, last = Scratch(spark, "stream"), {}

    def keep(batch: DataFrame, n: int) -> None:
        last["table"] = tmp.write(batch, f"batch{n}")

    q = streaming_moments(stream, "event_type", "value").writeStream.outputMode("complete").option("checkpointLocation", f"{tmp.root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    m = last["table"]
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("standard_error", 6).alias("standard_error"))
