"""Geometry, boundaries, gradients and error marks from point and cell tables.

Tables: ``points(mesh, point_id, x, y, z)`` and ``cells(mesh, cell_id,
cell_type, nodes)``.  ``fat_cells`` gathers coordinates (and nodal values) into
the cell row once; everything per cell is then column arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldloom.operators.order import dense_ids
from fieldloom.sources.scratch import Scratch

KEY = ["mesh", "cell_id"]


#: Cell ids of a block that one task meets with its points at once.
CELLS = 16_384


def gather(cells: DataFrame, points: DataFrame, values: tuple[str, ...], about: bool = False) -> DataFrame:
    """``cells`` (mesh, cell_id, nodes and more) with an array ``<value>s`` of each value of ``points(mesh, point_id, ...)``, in node order.

    Cells go in blocks of ``CELLS`` ids, each with the distinct points that it
    needs, so a cell travels once and a point once for each block about it, instead
    of a row for every node of every cell.  Absent points leave their places out;
    cells without any point are dropped.  With ``about`` an array ``about`` of that
    name stands beside ``nodes``: how many of all these cells lie about each node, 0
    for an absent point.
    """
    kinds, of = dict(cells.dtypes), dict(points.dtypes)
    blocks = cells.withColumn("__block", F.floor(F.col("cell_id") / CELLS) if kinds["cell_id"] in ("int", "bigint") else F.xxhash64("cell_id"))
    need = blocks.select("mesh", "__block", F.explode(F.col("nodes").cast("array<long>")).alias("point_id"))
    if about:
        need = need.groupBy("mesh", "__block", "point_id").agg(F.count("*").alias("__n"))
        need = need.select("mesh", "__block", "point_id", F.sum("__n").over(Window.partitionBy("mesh", "point_id")).cast("int").alias("about"))
    else:
        need = need.distinct()
    held = (*values, "about") if about else values
    near = need.join(points.select("mesh", F.col("point_id").cast("long").alias("point_id"), *values), ["mesh", "point_id"])
    near = near.select(F.col("mesh").alias("__mesh"), F.col("__block").alias("__of"), "point_id", *held)
    names = cells.columns

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = pa.concat_arrays(left.column("nodes").chunks)
        size = np.asarray(pc.fill_null(pc.list_value_length(nodes), 0), int)
        flat, ids = nodes.flatten().cast("int64"), right.column("point_id").to_numpy()
        order = np.lexsort([*[right.column(v).to_numpy() for v in reversed(values)], ids])
        ids, at = ids[order], np.asarray(flat.fill_null(0))
        low = np.searchsorted(ids, at)
        met = np.where(np.asarray(flat.is_valid()), np.searchsorted(ids, at, "right") - low, 0)
        take = np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())
        each = np.bincount(np.repeat(np.arange(len(size)), size), met, len(size)).astype(int)
        keep = pa.array(each > 0)
        ends, take = pa.array(np.r_[0, np.cumsum(each[each > 0])], "int32"), pa.array(order[take])
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(right.column(v).chunks).take(take)) for v in values]
        out = [*[left.column(c).filter(keep) for c in names], *lists]
        if about:
            some = right.column("about").to_numpy()[order][np.minimum(low, len(ids) - 1)]
            each = np.where(np.asarray(keep), size, 0)
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each[np.asarray(keep)])], "int32"), pa.array(np.where(met > 0, some, 0)[np.repeat(each > 0, size)], "int32")))
        return pa.Table.from_arrays(out, schema.names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right) if len(left) and len(right) else schema.empty_table()

    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], *[f"`{v}s` array<{of[v]}>" for v in values], *(["about array<int>"] if about else [])])
    schema = to_arrow_schema(cells.sparkSession.createDataFrame([], ddl).schema)
    return blocks.groupBy("mesh", "__block").cogroup(near.groupBy("__mesh", "__of")).applyInArrow(run, ddl)


def fat_cells(cells: DataFrame, points: DataFrame, values: tuple[str, ...] = (), about: bool = False) -> DataFrame:
    """One row a cell with arrays ``xs, ys, zs`` (and one for each nodal value) in node order; ``about`` as in ``gather``."""
    cols = ("x", "y", "z", *values)
    held = points.select("mesh", "point_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in "xyz" else F.col(c) for c in cols])
    return gather(cells.select("mesh", "cell_id", "cell_type", "nodes"), held, cols, about)


def _at(name: str, i: int) -> Column:
    return F.get(F.col(name), F.lit(i))


def _edge(i: int, j: int) -> tuple[Column, Column, Column]:
    return tuple(_at(c, j) - _at(c, i) for c in ("xs", "ys", "zs"))


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _norm(a) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])


def _tri(i: int, j: int, k: int) -> Column:
    return 0.5 * _norm(_cross(_edge(i, j), _edge(i, k)))


def _tet(i: int, j: int, k: int, m: int) -> Column:
    n, e = _cross(_edge(i, j), _edge(i, k)), _edge(i, m)
    return F.abs(n[0] * e[0] + n[1] * e[1] + n[2] * e[2]) / 6.0


def volume() -> Column:
    """Length, area or volume by cell type; unknown types are 0."""
    t = F.col("cell_type")
    return (
        F.when(t == "triangle", _tri(0, 1, 2))
        .when(t == "quad", _tri(0, 1, 2) + _tri(0, 2, 3))
        .when(t == "tet", _tet(0, 1, 2, 3))
        .when(t == "line", _norm(_edge(0, 1)))
        .when(t == "hex", _tet(0, 1, 3, 4) + _tet(1, 2, 3, 6) + _tet(1, 4, 5, 6) + _tet(3, 4, 6, 7) + _tet(1, 3, 4, 6))
        .otherwise(F.lit(0.0))
    )


def cell_volumes(fat: DataFrame) -> DataFrame:
    return fat.select(*KEY, "cell_type", volume().alias("volume"))


def cell_centroids(fat: DataFrame) -> DataFrame:
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    return fat.select(*KEY, mean("xs").alias("cx"), mean("ys").alias("cy"), mean("zs").alias("cz"))


#: Local faces by cell type; a face of a plane cell is an edge.
FACES = {
    "triangle": ((0, 1), (1, 2), (2, 0)),
    "quad": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "tet": ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)),
    "hex": ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)),
}


def cell_faces(cells: DataFrame) -> DataFrame:
    """``mesh, cell_id, face`` with sorted node ids, one row for each face of each cell."""
    arrays = F.lit(None).cast("array<array<bigint>>")
    for kind, faces in FACES.items():
        arrays = F.when(F.col("cell_type") == kind, F.array(*[F.array_sort(F.array(*[F.get("nodes", F.lit(i)) for i in f])) for f in faces])).otherwise(arrays)
    return cells.select(*KEY, F.explode(arrays).alias("face"))


def boundary_faces(cells: DataFrame) -> DataFrame:
    """Faces that belong to exactly one cell, with that cell."""
    return cell_faces(cells).groupBy("mesh", "face").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id")).where("n = 1").drop("n")


def boundary_points(cells: DataFrame) -> DataFrame:
    return boundary_faces(cells).select("mesh", F.explode("face").alias("point_id")).distinct()


def boundary_normals(cells: DataFrame, points: DataFrame, oriented: bool = True) -> DataFrame:
    """Unit normal (dy, -dx) of each boundary edge; away from its cell, or by id order.

    The boundary is written once; only its cells are given coordinates.
    """
    rim = Scratch(cells.sparkSession, "rim").write(boundary_faces(cells).where(F.size("face") == 2), "rim")
    b = rim.select("mesh", "face", "cell_id", F.col("face")[0].alias("a"), F.col("face")[1].alias("b"))
    end = lambda k: points.select("mesh", F.col("point_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    b = b.join(end("a"), ["mesh", "a"]).join(end("b"), ["mesh", "b"])
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    n = F.sqrt(dx * dx + dy * dy)
    out = b.select("mesh", "cell_id", "face", "xa", "ya", (dy / n).alias("nx"), (-dx / n).alias("ny"))
    if oriented:
        c = cell_centroids(fat_cells(cells.join(rim.select(*KEY).distinct(), KEY, "left_semi"), points))
        inward = F.col("nx") * (F.col("cx") - F.col("xa")) + F.col("ny") * (F.col("cy") - F.col("ya")) > 0
        out = out.join(c, KEY).select("mesh", "cell_id", "face", F.when(inward, -F.col("nx")).otherwise(F.col("nx")).alias("nx"), F.when(inward, -F.col("ny")).otherwise(F.col("ny")).alias("ny"))
    return out.select("mesh", "cell_id", "face", "nx", "ny")


def quality_metrics(fat: DataFrame) -> DataFrame:
    """Cell count, volume range and ratio, triangle aspect range and mean, by mesh."""
    e = [_norm(_edge(*p)) for p in ((0, 1), (1, 2), (2, 0))]
    aspect = F.when(F.col("cell_type") == "triangle", F.greatest(*e) / F.least(*e))
    rows = fat.select("mesh", volume().alias("v"), aspect.alias("a"))
    return rows.groupBy("mesh").agg(F.count("*").alias("n_cells"), F.min("v").alias("min_volume"), F.max("v").alias("max_volume"), (F.max("v") / F.min("v")).alias("volume_ratio"), F.min("a").alias("min_aspect"), F.max("a").alias("max_aspect"), F.avg("a").alias("mean_aspect"))


def _nodal(lists: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, n): the first numbers of each list, and which of them there are."""
    lists = pa.concat_arrays(lists.chunks)
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), int)
    flat, has = lists.flatten(), np.arange(n) < size[:, None]
    if not len(flat):
        return np.zeros(has.shape), has
    at = np.where(has, (np.cumsum(size) - size)[:, None] + np.arange(n), 0)
    return np.asarray(flat.fill_null(0.0))[at], has & np.asarray(flat.is_valid())[at]


def _sizes(p: np.ndarray, kind: str) -> np.ndarray:
    """``volume`` of cells of one kind with coordinates ``p`` (axis, cell, node)."""
    edge = lambda i, j: p[:, :, j] - p[:, :, i]
    length = lambda e: np.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    tri = lambda i, j, k: 0.5 * length(_cross(edge(i, j), edge(i, k)))

    def tet(i, j, k, m):
        n, e = _cross(edge(i, j), edge(i, k)), edge(i, m)
        return np.abs(n[0] * e[0] + n[1] * e[1] + n[2] * e[2]) / 6.0

    if kind == "line":
        return length(edge(0, 1))
    if kind in ("triangle", "quad"):
        return tri(0, 1, 2) + tri(0, 2, 3) if kind == "quad" else tri(0, 1, 2)
    return tet(0, 1, 2, 3) if kind == "tet" else tet(0, 1, 3, 4) + tet(1, 2, 3, 6) + tet(1, 4, 5, 6) + tet(3, 4, 6, 7) + tet(1, 3, 4, 6)


def gradients(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Volume (cell) and gradient (axis, cell) of rows of ``_corners``, each with what is known of it.

    Known are volumes of all types (0 if unknown) and gradients of triangles and
    tetrahedra whose corners are there; a cell without extent has no gradient.
    """
    kinds = t.column("cell_type")
    p, kp = (np.stack(x) for x in zip(*[_nodal(t.column(c), 8) for c in ("xs", "ys", "zs")]))
    u, ku = _nodal(t.column("us"), 4)
    n = len(u)
    volume, kv, g, kg = np.zeros(n), np.ones(n, bool), np.zeros((3, n)), np.zeros((3, n), bool)
    for kind, corners in (("line", 2), ("triangle", 3), ("quad", 4), ("tet", 4), ("hex", 8)):
        of = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(kinds, kind), False)))
        if not len(of):
            continue
        x, kx, w, kw = p[:, of], kp[:, of, :corners].all(2), u[of], ku[of, : min(corners, 4)].all(1)
        volume[of], kv[of] = _sizes(x, kind), kx.all(0)
        if kind not in ("triangle", "tet"):
            continue
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (x[:, :, i] - x[:, :, 0] for i in (1, 2, 3))
        du, dv, dw = (w[:, i] - w[:, 0] for i in (1, 2, 3))
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "triangle":
                det = ax * by - ay * bx
                g[:2, of] = (du * by - dv * ay) / det, (dv * ax - du * bx) / det
                kg[:2, of], kg[2, of] = kx[0] & kx[1] & kw & (det != 0), True
            else:
                det = ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)
                g[0, of] = (du * (by * cz - bz * cy) + dv * (cy * az - cz * ay) + dw * (ay * bz - az * by)) / det
                g[1, of] = (du * (bz * cx - bx * cz) + dv * (ax * cz - az * cx) + dw * (az * bx - ax * bz)) / det
                g[2, of] = (du * (bx * cy - by * cx) + dv * (ay * cx - ax * cy) + dw * (ax * by - ay * bx)) / det
                kg[:, of] = kx.all(0) & kw & (det != 0)
    return np.where(kv, volume, 0.0), kv, np.where(kg, g, 0.0), kg


AXES = ("gx", "gy", "gz")


def _corners(fat: DataFrame, value: str, *more: Column) -> DataFrame:
    """The columns that ``gradients`` reads."""
    return fat.select(*KEY, "cell_type", "nodes", *[F.col(c).cast("array<double>").alias(n) for c, n in (("xs", "xs"), ("ys", "ys"), ("zs", "zs"), (value, "us"))], *more)


def _schema(df: DataFrame, ddl: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def element_gradient(fat: DataFrame, value: str = "us") -> DataFrame:
    """Constant gradient of a nodal field in each triangle (x, y) or tetrahedron; null in cells without extent."""
    of = dict(fat.dtypes)
    ddl = ", ".join([*[f"{c} {of[c]}" for c in (*KEY, "nodes")], *[f"{c} double" for c in ("volume", *AXES)]])
    schema = _schema(fat, ddl)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            volume, kv, g, kg = gradients(t)
            yield from pa.Table.from_arrays([*[t.column(c) for c in (*KEY, "nodes")], pa.array(volume, mask=~kv), *[pa.array(v, mask=~k) for v, k in zip(g, kg)]], schema=schema).to_batches()

    return _corners(fat, value).mapInArrow(run, ddl)


def recover_gradient(grad: DataFrame) -> DataFrame:
    """Volume-weighted mean of the cell gradients around each node."""
    rows = grad.select("mesh", F.explode("nodes").alias("point_id"), "volume", *[(F.col("volume") * F.col(g)).alias(g) for g in AXES])
    return _means(rows.groupBy("mesh", "point_id").agg(F.sum("volume").alias("w"), *[F.sum(g).alias(g) for g in AXES]))


def _means(sums: DataFrame) -> DataFrame:
    return sums.select("mesh", "point_id", *[F.try_divide(g, "w").alias(g) for g in AXES])


#: Cells whose nodes' sums are made at once.
RUN = 65_536


def _runs(batches):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _settle(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """Errors of a run of cells (``part`` 0), or what the rest needs: open cells with gradients (1) and sums of their nodes (2).

    A node is closed if the run holds all cells ``about`` it, a cell if all its nodes are.
    """
    volume, kv, g, kg = gradients(t)
    nodes, about = (pa.concat_arrays(t.column(c).chunks) for c in ("nodes", "about"))
    size, told = (np.asarray(pc.fill_null(pc.list_value_length(v), 0), int) for v in (nodes, about))
    cell, flat = np.repeat(np.arange(len(size)), size), nodes.flatten()
    all_ = np.zeros(len(flat), int)
    all_[(size == told)[cell]] = np.asarray(about.flatten().fill_null(0))[np.repeat(size == told, told)]
    mesh = pa.concat_arrays(t.column("mesh").chunks)
    code = np.asarray(pc.fill_null(mesh.dictionary_encode().indices, -1), int)[cell]
    ok = np.asarray(flat.is_valid()) & (code >= 0)
    cell_ok, all_ok = cell[ok], all_[ok]
    ids, at = np.unique(np.asarray(flat.fill_null(0))[ok], return_inverse=True)
    keys, first, at = np.unique(code[ok] * max(len(ids), 1) + at, return_index=True, return_inverse=True)
    total = lambda v, of=at, n=len(keys): np.bincount(of, v, n)
    shut = total(all_ok != total(None)[at]) == 0
    open_ = np.bincount(cell, 1.0 * ~ok, len(size)) + np.bincount(cell_ok, 1.0 * ~shut[at], len(size)) > 0
    open_ |= size == 0
    w, kw = total(np.where(kv, volume, 0.0)[cell_ok]), total(kv[cell_ok]) > 0
    square, known, sums = 0.0, ~open_, []
    for v, k in zip(g, kg):
        s, ks = total(np.where(k & kv, v * volume, 0.0)[cell_ok]), total((k & kv)[cell_ok]) > 0
        sums.append(pa.array(s, mask=~ks))
        has = (kw & ks & (w != 0))[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(has, (s / w)[at], 0.0)
            n = np.bincount(cell_ok, has, len(size))
            square = square + (v - np.bincount(cell_ok, r, len(size)) / n) ** 2
        known = known & k & (n > 0)
    some = total(open_[cell_ok]) > 0
    rows = lambda part, mask, **has: pa.Table.from_arrays([pa.array(np.full(mask.sum(), part, "int8")), *[(has[c].filter(pa.array(mask)).cast(schema.field(c).type) if c in has else pa.nulls(mask.sum(), schema.field(c).type)) for c in schema.names[1:]]], schema=schema)
    near = mesh.take(pa.array(cell_ok[first]))
    return pa.concat_tables([
        rows(0, ~open_, mesh=mesh, cell_id=t.column("cell_id"), error=pa.array(np.sqrt(square), mask=~known)),
        rows(1, open_, mesh=mesh, cell_id=t.column("cell_id"), nodes=nodes, **{c: pa.array(v, mask=~k) for c, v, k in zip(AXES, g, kg)}),
        rows(2, some, mesh=near, point_id=pa.array(ids[keys % max(len(ids), 1)]), w=pa.array(w, mask=~kw), **dict(zip(AXES, sums))),
    ])


def zz_error(fat: DataFrame, value: str = "us") -> DataFrame:
    """Norm of the cell gradient minus the mean of the recovered gradient at its nodes.

    Where ``fat`` tells how many of its cells lie ``about`` each node, cells are
    settled in the run that holds all of their nodes' cells.  What is left, on the
    rims of runs, or all cells if nothing is told, is written with them; its nodes'
    sums are added up and come to its cells as coordinates do, in blocks.
    """
    of = dict(fat.dtypes)
    ddl = f"part tinyint, mesh {of['mesh']}, cell_id {of['cell_id']}, nodes array<bigint>, point_id bigint, w double, gx double, gy double, gz double, error double"
    schema = _schema(fat, ddl)
    about = (F.col("about") if "about" in of else F.lit(None)).cast("array<int>").alias("about")
    rows = _corners(fat, value, about).withColumn("nodes", F.col("nodes").cast("array<bigint>"))

    def run(batches):
        for t in _runs(batches):
            yield from _settle(t, schema).to_batches()

    held = Scratch(fat.sparkSession, "gradient").write(rows.mapInArrow(run, ddl), "gradient")
    sums = held.where("part = 2").groupBy("mesh", "point_id").agg(*[F.sum(c).alias(c) for c in ("w", *AXES)])
    node = _means(sums).withColumnsRenamed({g: f"r{g}" for g in AXES})
    met = gather(held.where("part = 1").select(*KEY, "nodes", *AXES), node, tuple(f"r{g}" for g in AXES))
    known = lambda g: F.filter(f"r{g}s", lambda v: v.isNotNull())
    mean = lambda g: F.try_divide(F.aggregate(known(g), F.lit(0.0), lambda a, v: a + v), F.size(known(g)))
    return held.where("part = 0").select(*KEY, "error").unionByName(met.select(*KEY, _norm([F.col(g) - mean(g) for g in AXES]).alias("error")))


def mark_cells(errors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Cells whose error exceeds a share of the largest one of their mesh.

    The errors are written once, since they are read for the largest and for the
    choice.  The largest are one small row a mesh: Spark broadcasts them below
    its limit and splits the hot meshes of a larger join.
    """
    held = Scratch(errors.sparkSession, "errors").write(errors, "errors")
    top = held.groupBy("mesh").agg(F.max("error").alias("top"))
    return held.join(top, "mesh").where(F.col("error") > threshold * F.col("top")).select(*KEY, "error")


def node_to_cell(fat: DataFrame, value: str = "us") -> DataFrame:
    return fat.select(*KEY, (F.aggregate(value, F.lit(0.0), lambda a, v: a + v) / F.size(value)).alias("value"))


def integrate(fat: DataFrame, value: str = "us") -> DataFrame:
    """Integral of the cell means and the total volume, by mesh."""
    mean = F.aggregate(value, F.lit(0.0), lambda a, v: a + v) / F.size(value)
    rows = fat.select("mesh", mean.alias("value"), volume().alias("volume"))
    return rows.groupBy("mesh").agg(F.sum(F.col("value") * F.col("volume")).alias("integral"), F.sum("volume").alias("volume"))


def volume_fraction(fat: DataFrame, density: str, target: float) -> DataFrame:
    """``mesh, excess``: the share of volume that the cells' ``density`` fills minus ``target``."""
    rows = fat.select("mesh", F.col(density).alias("rho"), volume().alias("v"))
    return rows.groupBy("mesh").agg((F.sum(F.col("rho") * F.col("v")) / F.sum("v") - target).alias("excess"))


def volume_fraction_gradient(fat: DataFrame) -> DataFrame:
    """``mesh, cell_id, gradient``: each cell's share of its mesh's volume, the derivative of ``volume_fraction``."""
    rows = fat.select(*KEY, volume().alias("v"))
    return rows.join(rows.groupBy("mesh").agg(F.sum("v").alias("total")), "mesh").select(*KEY, (F.col("v") / F.col("total")).alias("gradient"))


def mesh_edges(cells: DataFrame) -> DataFrame:
    """Distinct undirected edges ``mesh, src < dst`` of plane cells and tetrahedra."""
    pairs = F.lit(None).cast("array<array<bigint>>")
    kinds = {"triangle": FACES["triangle"], "quad": FACES["quad"], "tet": ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)), "line": ((0, 1),)}
    for kind, edges in kinds.items():
        pairs = F.when(F.col("cell_type") == kind, F.array(*[F.array_sort(F.array(F.get("nodes", F.lit(i)), F.get("nodes", F.lit(j)))) for i, j in edges])).otherwise(pairs)
    return cells.select("mesh", F.explode(pairs).alias("e")).select("mesh", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")).distinct()


def refine_triangles(cells: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every triangle in four at its edge midpoints; a shared edge gets one midpoint.

    New points are numbered after the largest old id in the order (mesh, a, b).
    Returns new points and the four cells of each triangle (``part`` 0 to 3).
    """
    tmp = Scratch(cells.sparkSession, "refine")
    edges = mesh_edges(cells.where(F.col("cell_type") == "triangle")).select("mesh", F.col("src").alias("a"), F.col("dst").alias("b"))
    first = points.agg(F.max("point_id")).first()[0]
    mids = tmp.write(dense_ids(edges, ["mesh", "a", "b"], "point_id", (first if first is not None else -1) + 1, tmp), "mids")
    end = lambda k: points.select("mesh", F.col("point_id").alias(k), *[F.col(c).alias(c + k) for c in "xyz"])
    new = mids.join(end("a"), ["mesh", "a"]).join(end("b"), ["mesh", "b"])
    new = new.select("mesh", "point_id", *[((F.col(c + "a") + F.col(c + "b")) / 2).alias(c) for c in "xyz"])
    tri = cells.where(F.col("cell_type") == "triangle")
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.col("nodes")[i], F.col("nodes")[j]).alias("a"), F.greatest(F.col("nodes")[i], F.col("nodes")[j]).alias("b")) for k, (i, j) in enumerate(FACES["triangle"])])
    met = tri.select(*KEY, "nodes", F.explode(sides).alias("s")).select(*KEY, "nodes", "s.*").join(mids, ["mesh", "a", "b"])
    row = met.groupBy(*KEY, "nodes").agg(F.array_sort(F.collect_list(F.struct("k", "point_id"))).alias("m")).select(*KEY, "nodes", F.col("m.point_id").alias("m"))
    n, m = [F.col("nodes")[i] for i in range(3)], [F.col("m")[i] for i in range(3)]
    four = F.array(F.array(n[0], m[0], m[2]), F.array(m[0], n[1], m[1]), F.array(m[2], m[1], n[2]), F.array(m[0], m[1], m[2]))
    return new, row.select(*KEY, F.posexplode(four).alias("part", "nodes"))


def extract_submesh(cells: DataFrame, subset: DataFrame) -> DataFrame:
    """Cells all of whose nodes are in ``subset(mesh, point_id)``, nodes renumbered from 0 in id order."""
    ids = dense_ids(subset.select("mesh", "point_id").distinct(), ["mesh", "point_id"], "new_id")
    rows = cells.select(*KEY, "nodes", F.posexplode("nodes").alias("pos", "point_id")).join(ids, ["mesh", "point_id"])
    kept = rows.groupBy(*KEY, "nodes").agg(F.array_sort(F.collect_list(F.struct("pos", "new_id"))).alias("p")).where(F.size("p") == F.size("nodes"))
    return kept.select(*KEY, F.col("p.new_id").alias("nodes"))


#: Side, coordinate and end of a bounding box.
SIDES = {"left": ("x", "lo"), "right": ("x", "hi"), "bottom": ("y", "lo"), "top": ("y", "hi"), "front": ("z", "lo"), "back": ("z", "hi")}


def tag_box(points: DataFrame, boundary: DataFrame, tol: float = 1e-10, dim: int = 2) -> DataFrame:
    """Boundary points by side of their mesh's bounding box, six sides if ``dim`` is 3; an edge or corner gets several tags."""
    axes = "xyz"[:dim]
    box = points.groupBy("mesh").agg(*[f(c).alias(f"{n}{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))])
    b = points.join(boundary, ["mesh", "point_id"], "left_semi").join(box, "mesh")
    tags = F.filter(F.array(*[F.when(F.abs(F.col(c) - F.col(e + c)) < tol, F.lit(t)) for t, (c, e) in SIDES.items() if c in axes]), lambda t: t.isNotNull())
    return b.select("mesh", "point_id", F.explode(tags).alias("tag"))


def tag_boundary(points: DataFrame, boundary: DataFrame, name: str, where: Column) -> DataFrame:
    """``mesh, point_id, tag``: the boundary points that satisfy a predicate, under a name."""
    return points.join(boundary, ["mesh", "point_id"], "left_semi").where(where).select("mesh", "point_id", F.lit(name).alias("tag"))


def get_boundary(tags: DataFrame, name: str) -> DataFrame:
    """The points of one tag; a tag that no point has is a ``KeyError``."""
    got = tags.where(F.col("tag") == name)
    if got.isEmpty():
        raise KeyError(name)
    return got.select("mesh", "point_id")
