"""Element matrices of all cell types, and norms and residuals of sparse systems.

``matrix(row, col, value)`` and vectors ``row, value``; entries of zero may be
absent on any side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.fields import turned
from fieldloom.operators.graph import spmv

#: Corners of the reference square in the order of a quad's nodes.
_CORNERS = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float)


def _triangles(x: np.ndarray, mass: bool) -> np.ndarray:
    """(n, 3, 3) matrices of plane triangles with corners x (n, 3, 2+)."""
    e = x[:, [2, 0, 1], :2] - x[:, [1, 2, 0], :2]  # the edge opposite each corner
    area = 0.5 * np.abs(e[:, 2, 0] * e[:, 0, 1] - e[:, 2, 1] * e[:, 0, 0])
    if mass:
        return area[:, None, None] / 12 * (np.ones((3, 3)) + np.eye(3))
    return np.einsum("nik,njk->nij", e, e) / (4 * area)[:, None, None]


def _quads(x: np.ndarray, mass: bool) -> np.ndarray:
    """(n, 4, 4) matrices of plane quadrilaterals by the 2 x 2 Gauss rule."""
    out = np.zeros((len(x), 4, 4))
    for g in _CORNERS / np.sqrt(3):
        shape = np.prod(1 + _CORNERS * g, axis=1) / 4
        slope = _CORNERS * (1 + _CORNERS * g)[:, ::-1] / 4  # derivatives on the reference square
        jac = np.einsum("ia,nib->nab", slope, x[:, :, :2])
        det = np.abs(np.linalg.det(jac))
        if mass:
            out += det[:, None, None] * np.outer(shape, shape)
        else:
            grad = np.einsum("nab,ib->nia", np.linalg.inv(jac), slope)
            out += det[:, None, None] * np.einsum("nia,nja->nij", grad, grad)
    return out


def _tets(x: np.ndarray, mass: bool) -> np.ndarray:
    """(n, 4, 4) matrices of tetrahedra; both are exact in closed form."""
    jac = x[:, 1:] - x[:, :1]
    vol = np.abs(np.linalg.det(jac)) / 6
    if mass:
        return vol[:, None, None] / 20 * (np.ones((4, 4)) + np.eye(4))
    grad = np.linalg.inv(jac).transpose(0, 2, 1)
    grad = np.concatenate([-grad.sum(1, keepdims=True), grad], 1)
    return vol[:, None, None] * np.einsum("nia,nja->nij", grad, grad)


_ELEMENTS = {"triangle": (3, _triangles), "quad": (4, _quads), "tet": (4, _tets)}


def assemble_matrix(fat: DataFrame, what: str = "stiffness", coef: Column | None = None) -> DataFrame:
    """``mesh, row, col, value``: stiffness or mass matrix of triangles, quads and tetrahedra of ``fat_cells``.

    Element blocks are computed for a batch of cells at once and summed by row and
    column, first in the batch; ``coef`` is a factor of each cell.  The matrix is
    symmetric: entries with row <= col are summed and then turned.  Other cell
    types give nothing.
    """
    mass = what == "mass"
    src = fat.where(F.col("cell_type").isin(*_ELEMENTS)).select("mesh", "cell_type", F.transform("nodes", lambda v: v.cast("long")).alias("nodes"), F.flatten(F.array("xs", "ys", "zs")).cast("array<double>").alias("p"), (coef if coef is not None else F.lit(1.0)).cast("double").alias("k"))

    def run(batches):
        for b in batches:
            kind = np.asarray(b.column("cell_type").to_pylist(), object)
            for name, (n, element) in _ELEMENTS.items():
                at = np.flatnonzero(kind == name)
                if not len(at):
                    continue
                take = pa.array(at)
                x = np.asarray(b.column("p").take(take).flatten(), float).reshape(len(at), 3, n).transpose(0, 2, 1)
                v = (element(x, mass) * np.asarray(b.column("k"))[at][:, None, None]).ravel()
                nodes = np.asarray(b.column("nodes").take(take).flatten()).reshape(len(at), n)
                row, col, who = np.repeat(nodes, n, axis=1).ravel(), np.tile(nodes, (1, n)).ravel(), np.repeat(at, n * n)
                row, col, who, v = (a[row <= col] for a in (row, col, who, v))
                mesh = np.asarray(pc.fill_null(b.column("mesh").dictionary_encode().indices, -1))[who]
                order = np.lexsort((col, row, mesh))
                first = np.r_[True, (np.diff(mesh[order]) != 0) | (np.diff(row[order]) != 0) | (np.diff(col[order]) != 0)]
                lead = order[first]
                yield pa.RecordBatch.from_arrays(
                    [b.column("mesh").take(pa.array(who[lead])), pa.array(row[lead]), pa.array(col[lead]), pa.array(np.add.reduceat(v[order], np.flatnonzero(first)))], names=["mesh", "row", "col", "v"]
                )

    return turned(src.mapInArrow(run, f"mesh {dict(fat.dtypes)['mesh']}, row long, col long, v double").groupBy("mesh", "row", "col").agg(F.sum("v").alias("value")))


def _residual(matrix: DataFrame, u: DataFrame, b: DataFrame) -> DataFrame:
    """``row, r, b``: A u - b on every row that either side has."""
    au = spmv(matrix, u).withColumnRenamed("value", "au")
    j = au.join(b.select("row", F.col("value").alias("b")), "row", "full")
    return j.select("row", (F.coalesce("au", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("r"), F.coalesce("b", F.lit(0.0)).alias("b"))


def pointwise_residual(matrix: DataFrame, u: DataFrame, b: DataFrame) -> DataFrame:
    """``row, residual``: |A u - b| as an error indicator."""
    return pointwise_of(_residual(matrix, u, b))


def pointwise_of(residual: DataFrame) -> DataFrame:
    """The same of a residual ``row, r, b``."""
    return residual.select("row", F.abs("r").alias("residual"))


def residual_norms(matrix: DataFrame, u: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``residual_norm`` |A u - b| / |b| (null without b) and ``conservation_error``, the sum of |A u - b|."""
    return norms_of(_residual(matrix, u, b))


def norms_of(residual: DataFrame) -> DataFrame:
    """The same of a residual ``row, r, b``."""
    s = residual.agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("r"), F.sqrt(F.sum(F.col("b") ** 2)).alias("b"), F.sum(F.abs("r")).alias("conservation_error"))
    return s.select(F.try_divide("r", "b").alias("residual_norm"), "conservation_error")


def energy_norm(matrix: DataFrame, u: DataFrame) -> DataFrame:
    """One row ``energy_norm``: the root of u' A u."""
    au = spmv(matrix, u).withColumnRenamed("value", "au")
    return u.join(au, "row").agg(F.sqrt(F.greatest(F.sum(F.col("value") * F.col("au")), F.lit(0.0))).alias("energy_norm"))
