"""Registered queries of grids, points and stored results; their sizes follow the tables. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.jobs.tables import MESH, mesh, rounded, table
from fieldloom.sources import generate as N
from fieldloom.sources import io as IO
from fieldloom.sources.scratch import Scratch

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _side(spark, sf_dir) -> int:
    """Cells along a side: the root of the number of orders."""
    return int(table(spark, sf_dir, "orders").count() ** 0.5)


_N = "n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS k FROM orders)"


@query("source_grid_points", f"WITH {_N} SELECT i AS point_id, round((i // (k + 1)) / k, 8) AS x, round(2.0 * (i % (k + 1)) / k - 1, 8) + 0.0 AS y FROM (SELECT unnest(range((k + 1) * (k + 1))) AS i, k FROM n)")
def grid_points(spark, sf_dir):
    k = _side(spark, sf_dir)
    return rounded(N.structured_grid(spark, [(0, 1), (-1, 1)], [k, k])[0].select("point_id", "x", "y"), 8)


@query("source_grid_cells", f"WITH {_N}, c AS (SELECT i, k, (i // k) * (k + 1) + i % k AS p FROM (SELECT unnest(range(k * k)) AS i, k FROM n)) SELECT i AS cell_id, 'quad' AS cell_type, p AS a, p + k + 1 AS b, p + k + 2 AS c, p + 1 AS d FROM c")
def grid_cells(spark, sf_dir):
    k = _side(spark, sf_dir)
    c = N.structured_grid(spark, [(0, 1), (-1, 1)], [k, k])[1]
    return c.select("cell_id", "cell_type", *[F.col("nodes")[i].alias(n) for i, n in enumerate("abcd")])


@query("source_cell_neighbors", f"WITH {_N}, c AS (SELECT i, k, i // k AS p, i % k AS q FROM (SELECT unnest(range(k * k)) AS i, k FROM n)), s AS (SELECT i AS cell_id, unnest([0, 1, 2, 3]) AS slot, unnest([CASE WHEN p > 0 THEN i - k END, CASE WHEN p < k - 1 THEN i + k END, CASE WHEN q > 0 THEN i - 1 END, CASE WHEN q < k - 1 THEN i + 1 END]) AS nbr_id FROM c) SELECT * FROM s WHERE nbr_id IS NOT NULL")
def neighbors(spark, sf_dir):
    k = _side(spark, sf_dir)
    return N.cartesian_cells(spark, [(0, 1), (0, 1)], [k, k])[1]


@query("source_boundary_cells", f"WITH {_N} SELECT i AS cell_id FROM (SELECT unnest(range(k * k)) AS i, k FROM n) WHERE i // k IN (0, k - 1) OR i % k IN (0, k - 1)")
def boundary_cells(spark, sf_dir):
    k = _side(spark, sf_dir)
    cells, nbr = N.cartesian_cells(spark, [(0, 1), (0, 1)], [k, k])
    return N.boundary_cells(nbr, cells, 2)


@query("source_halton", "WITH i AS (SELECT unnest(range(1, count(*) + 1)) AS i FROM orders) SELECT i AS sample_id, round(list_sum([((i // (2 ** j)::BIGINT) % 2) / 2.0 ** (j + 1) FOR j IN range(24)]), 8) AS x, round(4 * list_sum([((i // (3 ** j)::BIGINT) % 3) / 3.0 ** (j + 1) FOR j IN range(16)]) - 1, 8) + 0.0 AS y FROM i")
def halton(spark, sf_dir):
    return rounded(N.halton_points(spark, [(0, 1), (-1, 3)], table(spark, sf_dir, "orders").count()), 8)


@query(
    "source_box_boundary",
    f"""WITH {_N}, b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_tax) AS y0, max(l_tax) AS y1 FROM lineitem), t AS (SELECT p, p / (k - 1) AS t FROM (SELECT unnest(range(k)) AS p, k FROM n))
 SELECT face, point, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT 0 AS face, p AS point, x0 AS x, y0 + t * (y1 - y0) AS y FROM t, b UNION ALL SELECT 1, p, x1, y0 + t * (y1 - y0) FROM t, b UNION ALL SELECT 2, p, x0 + t * (x1 - x0), y0 FROM t, b UNION ALL SELECT 3, p, x0 + t * (x1 - x0), y1 FROM t, b)""",
)
def box(spark, sf_dir):
    """Points on the sides of the box of all lines' quantities and taxes."""
    b = table(spark, sf_dir, "lineitem").agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_tax"), F.max("l_tax")).first()
    return rounded(N.box_boundary_points(spark, [(b[0], b[1]), (b[2], b[3])], _side(spark, sf_dir)).select("face", "point", "x", "y"))


@query("source_tensor_grid", "WITH a AS (SELECT l_discount AS v, count(*) / (SELECT count(*) FROM lineitem) AS w FROM lineitem GROUP BY 1), b AS (SELECT l_tax AS v, count(*) / (SELECT count(*) FROM lineitem) AS w FROM lineitem GROUP BY 1), c AS (SELECT CAST(l_linenumber AS DOUBLE) AS v, count(*) / (SELECT count(*) FROM lineitem) AS w FROM lineitem GROUP BY 1) SELECT a.v AS p0, b.v AS p1, c.v AS p2, round(a.w * b.w * c.w, 9) AS w FROM a, b, c")
def tensor(spark, sf_dir):
    """Product of the distinct discounts, taxes and line numbers with their shares as weights."""
    li = table(spark, sf_dir, "lineitem")
    n = li.count()
    nodes = [[(float(r[0]), r["count"] / n) for r in li.groupBy(c).count().collect()] for c in ("l_discount", "l_tax", "l_linenumber")]  # some ten rows each
    g = N.tensor_grid(spark, nodes)
    return rounded(g.select(*[F.col("p")[i].alias(f"p{i}") for i in range(3)], "w"), 9)


@query("source_results_round_trip", "SELECT event_type AS run_id, 'level ' || length(event_type) AS label, count(*) AS n, round(sum(sqrt(value)), 4) AS total FROM events GROUP BY event_type")
def round_trip(spark, sf_dir):
    """Runs with metadata and their fields, written, and read back with metadata parsed."""
    e, path = table(spark, sf_dir, "events"), Scratch(spark, "results").root
    meta = F.to_json(F.struct(F.concat(F.lit("level "), F.length("event_type").cast("string")).alias("label"), F.lit(1).alias("version")))
    runs = e.groupBy(F.col("event_type").alias("run_id")).agg(F.max(meta).alias("metadata"))
    fields = e.select(F.col("event_type").alias("run_id"), F.lit("u").alias("field"), F.col("event_id").alias("point_id"), F.lit(0).alias("component"), F.sqrt("value").alias("value"))
    IO.save_results(runs, fields, path)
    got = IO.load_results(spark, path).where("field = 'u'").groupBy("run_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    back = IO.load_results(spark, path, "runs").select("run_id", F.col("metadata")["label"].alias("label"))
    return rounded(back.join(got, "run_id").select("run_id", "label", "n", "total"), 4)


@query("source_mesh_round_trip", "SELECT kind AS cell_type, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'quad' ELSE 'triangle' END AS kind FROM orders) GROUP BY kind")
def mesh_round_trip(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders"), Scratch(spark, "mesh").root
    k = F.col("o_orderkey")
    cells = o.select(F.lit(0).alias("mesh"), k.alias("cell_id"), F.when(k % 3 == 0, "quad").otherwise("triangle").alias("cell_type"), F.array(k, k + 1, k + 2).alias("nodes"))
    IO.save_mesh(o.select(k.alias("point_id")), cells, path)
    return IO.load_mesh(spark, path)[1].groupBy("cell_type").agg(F.count("*").alias("n"), F.sum(F.col("nodes")[0]).alias("total"))


@query("source_mesh_text_round_trip", MESH + " SELECT mesh, count(*) AS n, CAST(sum(n0 + 2 * n1 + 3 * n2) AS BIGINT) AS nodes, round(sum(y0), 3) AS y FROM tri GROUP BY mesh")
def mesh_text_round_trip(spark, sf_dir):
    """The triangles as CSV files, read back and met with their points."""
    (pts, cells), path = mesh(spark, sf_dir), Scratch(spark, "mesh-text").root
    pts.select("mesh", "point_id", "x", "y").write.option("header", True).csv(f"{path}/points")
    cells.withColumn("nodes", F.concat_ws(" ", F.transform("nodes", lambda v: v.cast("string")))).write.option("header", True).csv(f"{path}/cells")
    p, c = IO.read_mesh_text(spark, f"{path}/points", f"{path}/cells")
    n = lambda i: F.col("nodes")[i]
    met = c.select("mesh", n(0).alias("point_id"), (n(0) + 2 * n(1) + 3 * n(2)).alias("w")).join(p, ["mesh", "point_id"])
    return rounded(met.groupBy("mesh").agg(F.count("*").alias("n"), F.sum("w").alias("nodes"), F.sum("y").alias("y")), 3)
