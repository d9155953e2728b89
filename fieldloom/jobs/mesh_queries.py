"""Registered mesh queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.jobs.tables import CELLS, MESH, PTS, mesh, rounded
from fieldloom.operators import mesh as M

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _fat(spark, sf_dir, about=False):
    pts, cells = mesh(spark, sf_dir)
    return M.fat_cells(cells, pts, ("u",), about)


@query("mesh_cell_coords", MESH + " SELECT mesh, cell_id, CAST(round(x0 + 3 * x1 + 5 * x2, 6) AS DOUBLE) AS sx, CAST(round(y0 + 3 * y1 + 5 * y2, 6) AS DOUBLE) AS sy FROM tri")
def cell_coords(spark, sf_dir):
    f = _fat(spark, sf_dir)
    s = lambda c: F.col(c)[0] + 3 * F.col(c)[1] + 5 * F.col(c)[2]
    return rounded(f.select("mesh", "cell_id", s("xs").alias("sx"), s("ys").alias("sy")))


@query("mesh_cell_volumes", MESH + " SELECT mesh, cell_id, round(volume, 6) AS volume FROM geo")
def cell_volumes(spark, sf_dir):
    return rounded(M.cell_volumes(_fat(spark, sf_dir)).drop("cell_type"))


@query("mesh_cell_centroids", MESH + " SELECT mesh, cell_id, round((x0 + x1 + x2) / 3, 6) AS cx, round((y0 + y1 + y2) / 3, 6) AS cy FROM tri")
def cell_centroids(spark, sf_dir):
    return rounded(M.cell_centroids(_fat(spark, sf_dir)).drop("cz"))


_EDGES = """edges AS (SELECT mesh, cell_id, unnest([[n0, n1], [n1, n2], [n2, n0]]) AS e FROM tri),
 faces AS (SELECT mesh, cell_id, least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b FROM edges),
 rim AS (SELECT mesh, a, b, min(cell_id) AS cell_id FROM faces GROUP BY mesh, a, b HAVING count(*) = 1)"""


@query("mesh_boundary_faces", f"{MESH}, {_EDGES} SELECT mesh, a, b, cell_id FROM rim")
def boundary(spark, sf_dir):
    _, cells = mesh(spark, sf_dir)
    return M.boundary_faces(cells).select("mesh", F.col("face")[0].alias("a"), F.col("face")[1].alias("b"), "cell_id")


@query(
    "mesh_boundary_normals",
    f"""{MESH}, {_EDGES}, o AS (SELECT r.mesh, r.a, r.b, p.x AS xa, p.y AS ya, (q.y - p.y) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS nx, -(q.x - p.x) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS ny,
 (x0 + x1 + x2) / 3 AS cx, (y0 + y1 + y2) / 3 AS cy FROM rim r JOIN pts p ON p.point_id = a JOIN pts q ON q.point_id = b JOIN tri USING (cell_id))
 SELECT mesh, a, b, round(CASE WHEN nx * (cx - xa) + ny * (cy - ya) > 0 THEN -nx ELSE nx END, 6) + 0.0 AS nx, round(CASE WHEN nx * (cx - xa) + ny * (cy - ya) > 0 THEN -ny ELSE ny END, 6) + 0.0 AS ny FROM o""",
)
def normals(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(M.boundary_normals(cells, pts).select("mesh", F.col("face")[0].alias("a"), F.col("face")[1].alias("b"), "nx", "ny"))


@query(
    "mesh_quality",
    f"""{MESH}, e AS (SELECT mesh, volume, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS e0, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS e1, sqrt((x0 - x2) ** 2 + (y0 - y2) ** 2) AS e2 FROM geo)
 SELECT mesh, count(*) AS n_cells, round(min(volume), 6) AS min_volume, round(max(volume), 6) AS max_volume, round(max(volume) / min(volume), 6) AS volume_ratio, round(min(greatest(e0, e1, e2) / least(e0, e1, e2)), 6) AS min_aspect,
 round(max(greatest(e0, e1, e2) / least(e0, e1, e2)), 6) AS max_aspect, round(avg(greatest(e0, e1, e2) / least(e0, e1, e2)), 6) AS mean_aspect FROM e GROUP BY mesh""",
)
def quality(spark, sf_dir):
    return rounded(M.quality_metrics(_fat(spark, sf_dir)))


@query("mesh_element_gradient", MESH + " SELECT mesh, cell_id, round(gx, 5) + 0.0 AS gx, round(gy, 5) + 0.0 AS gy FROM geo")
def gradient(spark, sf_dir):
    return rounded(M.element_gradient(_fat(spark, sf_dir)).select("mesh", "cell_id", "gx", "gy"), 5)


_NODE = """node AS (SELECT mesh, point_id, sum(volume * gx) / sum(volume) AS rx, sum(volume * gy) / sum(volume) AS ry FROM (SELECT mesh, unnest(nodes) AS point_id, volume, gx, gy FROM geo) GROUP BY mesh, point_id)"""
_ERR = """err AS (SELECT g.mesh, g.cell_id, sqrt((any_value(gx) - avg(rx)) ** 2 + (any_value(gy) - avg(ry)) ** 2) AS error FROM (SELECT mesh, cell_id, gx, gy, unnest(nodes) AS point_id FROM geo) g JOIN node USING (mesh, point_id) GROUP BY g.mesh, g.cell_id)"""


@query("mesh_recovered_gradient", f"{MESH}, {_NODE} SELECT mesh, point_id, round(rx, 5) + 0.0 AS gx, round(ry, 5) + 0.0 AS gy FROM node")
def recovered(spark, sf_dir):
    return rounded(M.recover_gradient(M.element_gradient(_fat(spark, sf_dir))).drop("gz"), 5)


@query("mesh_zz_error", f"{MESH}, {_NODE}, {_ERR} SELECT mesh, cell_id, round(error, 5) AS error FROM err")
def zz(spark, sf_dir):
    return rounded(M.zz_error(_fat(spark, sf_dir, about=True)), 5)


@query("mesh_marked_cells", f"{MESH}, {_NODE}, {_ERR} SELECT mesh, cell_id, round(error, 5) AS error FROM err QUALIFY error > 0.5 * max(error) OVER (PARTITION BY mesh)")
def marked(spark, sf_dir):
    """The flagship: which cells have the largest recovered-gradient error?"""
    return rounded(M.mark_cells(M.zz_error(_fat(spark, sf_dir, about=True)), 0.5), 5)


@query("mesh_node_to_cell", MESH + " SELECT mesh, cell_id, round((u0 + u1 + u2) / 3, 6) AS value FROM tri")
def to_cell(spark, sf_dir):
    return rounded(M.node_to_cell(_fat(spark, sf_dir)))


@query("mesh_integral", MESH + " SELECT mesh, round(sum((u0 + u1 + u2) / 3 * volume), 3) AS integral, round(sum(volume), 3) AS volume FROM geo GROUP BY mesh")
def integral(spark, sf_dir):
    return rounded(M.integrate(_fat(spark, sf_dir)), 3)


@query("mesh_edges", f"{MESH}, {_EDGES} SELECT DISTINCT mesh, a AS src, b AS dst FROM faces")
def edges(spark, sf_dir):
    return M.mesh_edges(mesh(spark, sf_dir)[1])


_MIDS = f"{_EDGES}, mids AS (SELECT mesh, a, b, (SELECT max(point_id) FROM pts) + row_number() OVER (ORDER BY mesh, a, b) AS point_id FROM (SELECT DISTINCT mesh, a, b FROM faces))"


@query("mesh_refined_points", f"{MESH}, {_MIDS} SELECT m.mesh, m.point_id, round((p.x + q.x) / 2, 6) AS x, round((p.y + q.y) / 2, 6) AS y FROM mids m JOIN pts p ON p.point_id = a JOIN pts q ON q.point_id = b")
def refined_points(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(M.refine_triangles(cells, pts)[0].drop("z"))


@query(
    "mesh_refined_cells",
    f"""{MESH}, {_MIDS}, m3 AS (SELECT t.mesh, t.cell_id, n0, n1, n2, p.point_id AS m0, q.point_id AS m1, r.point_id AS m2 FROM tri t JOIN mids p ON p.a = least(n0, n1) AND p.b = greatest(n0, n1) JOIN mids q ON q.a = least(n1, n2) AND q.b = greatest(n1, n2) JOIN mids r ON r.a = least(n2, n0) AND r.b = greatest(n2, n0)),
 four AS (SELECT mesh, cell_id, 0 AS part, n0 AS a, m0 AS b, m2 AS c FROM m3 UNION ALL SELECT mesh, cell_id, 1, m0, n1, m1 FROM m3 UNION ALL SELECT mesh, cell_id, 2, m2, m1, n2 FROM m3 UNION ALL SELECT mesh, cell_id, 3, m0, m1, m2 FROM m3) SELECT * FROM four""",
)
def refined_cells(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    c = M.refine_triangles(cells, pts)[1]
    return c.select("mesh", "cell_id", "part", *[F.col("nodes")[i].alias(k) for i, k in enumerate("abc")])


@query(
    "mesh_submesh",
    f"""{MESH}, sub AS (SELECT mesh, point_id, row_number() OVER (ORDER BY mesh, point_id) - 1 AS new_id FROM pts WHERE y < 40)
 SELECT t.mesh, t.cell_id, p.new_id AS a, q.new_id AS b, r.new_id AS c FROM tri t JOIN sub p ON p.point_id = n0 JOIN sub q ON q.point_id = n1 JOIN sub r ON r.point_id = n2""",
)
def submesh(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    c = M.extract_submesh(cells, pts.where("y < 40"))
    return c.select("mesh", "cell_id", *[F.col("nodes")[i].alias(k) for i, k in enumerate("abc")])


@query(
    "mesh_boundary_tags",
    f"""{MESH}, {_EDGES}, bp AS (SELECT DISTINCT mesh, unnest([a, b]) AS point_id FROM rim), box AS (SELECT mesh, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy FROM pts GROUP BY mesh),
 j AS (SELECT p.* FROM pts p JOIN bp USING (mesh, point_id)) SELECT mesh, point_id, tag FROM (SELECT j.mesh, point_id, unnest([CASE WHEN abs(x - lox) < 1e-10 THEN 'left' END, CASE WHEN abs(x - hix) < 1e-10 THEN 'right' END, CASE WHEN abs(y - loy) < 1e-10 THEN 'bottom' END, CASE WHEN abs(y - hiy) < 1e-10 THEN 'top' END]) AS tag FROM j JOIN box ON box.mesh = j.mesh) WHERE tag IS NOT NULL""",
)
def tags(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return M.tag_box(pts, M.boundary_points(cells))
