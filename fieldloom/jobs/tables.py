"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, MESH_POINTS = 50, 5_000

#: The same derivations in SQL, as common table expressions.
PTS = f"pts AS (SELECT o_orderkey // {MESH_POINTS} AS mesh, o_orderkey AS point_id, CAST(o_orderkey % {WIDTH} AS DOUBLE) AS x, CAST((o_orderkey % {MESH_POINTS}) // {WIDTH} AS DOUBLE) + 0.1 * CAST(o_orderkey % 7 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, sqrt(o_totalprice) AS u FROM orders)"
CELLS = f"""cells AS (SELECT p.mesh, 2 * p.point_id + k AS cell_id, 'triangle' AS cell_type,
  CASE WHEN k = 0 THEN [p.point_id, p.point_id + 1, p.point_id + {WIDTH} + 1] ELSE [p.point_id, p.point_id + {WIDTH} + 1, p.point_id + {WIDTH}] END AS nodes
  FROM pts p CROSS JOIN (SELECT unnest([0, 1]) AS k) JOIN pts q ON q.point_id = p.point_id + {WIDTH} + 1 AND q.mesh = p.mesh
  WHERE p.point_id % {WIDTH} < {WIDTH} - 1)"""
TRI = """tri AS (SELECT c.mesh, c.cell_id, c.nodes, a.point_id AS n0, b.point_id AS n1, d.point_id AS n2, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, d.x AS x2, d.y AS y2, a.u AS u0, b.u AS u1, d.u AS u2
  FROM cells c JOIN pts a ON a.point_id = c.nodes[1] JOIN pts b ON b.point_id = c.nodes[2] JOIN pts d ON d.point_id = c.nodes[3])"""
GEO = """geo AS (SELECT *, 0.5 * abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) AS volume,
  ((u1 - u0) * (y2 - y0) - (u2 - u0) * (y1 - y0)) / ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) AS gx,
  ((u2 - u0) * (x1 - x0) - (u1 - u0) * (x2 - x0)) / ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) AS gy FROM tri)"""
MESH = f"WITH {PTS}, {CELLS}, {TRI}, {GEO}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points of sheared grids of ``WIDTH`` columns, 5,000 points a mesh, with a field ``u``."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.floor(k / MESH_POINTS).alias("mesh"), k.alias("point_id"), (k % WIDTH).cast("double").alias("x"), (F.floor((k % MESH_POINTS) / WIDTH).cast("double") + 0.1 * (k % 7).cast("double")).alias("y"), F.lit(0.0).alias("z"), F.sqrt("o_totalprice").alias("u")
    )


def triangles(pts: DataFrame) -> DataFrame:
    """Two triangles for each grid square whose four corners exist.

    The far corner is looked up by a window over the mesh, which holds at most
    ``MESH_POINTS`` ids: each id travels once, and cells of a mesh leave together in
    the order of their ids, so that nodes and faces are made distinct where they lie.
    """
    p = F.col("point_id")
    corner = Window.partitionBy("mesh").orderBy("point_id").rangeBetween(WIDTH + 1, WIDTH + 1)
    base = pts.select("mesh", "point_id", F.count("*").over(corner).alias("corners")).where((p % WIDTH < WIDTH - 1) & (F.col("corners") > 0))
    two = F.array(F.array(p, p + 1, p + WIDTH + 1), F.array(p, p + WIDTH + 1, p + WIDTH))
    return base.select("mesh", "point_id", F.posexplode(two).alias("k", "nodes")).select("mesh", (2 * F.col("point_id") + F.col("k")).alias("cell_id"), F.lit("triangle").alias("cell_type"), "nodes")


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pts = points(spark, sf_dir)
    return pts, triangles(pts)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 turned to 0.0), so that the order of summation does not show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
