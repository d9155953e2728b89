"""Registered queries on models of few snapshots or terms, whose answers SQL gives in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.jobs.design_queries import _answer, _answer_sql, _three
from fieldloom.jobs.graph_queries import _V, _vec
from fieldloom.jobs.tables import rounded, table
from fieldloom.operators import regress as E
from fieldloom.operators import rom as R
from fieldloom.operators import spatial as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], SQL[name] = fn, sql
        return fn

    return add


def _snapshots(spark, sf_dir, lo: int, n: int = 3):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.slice("embedding", lo, n).cast("array<double>").alias("xs"))


@query("rom_basis", _answer_sql(f"SELECT vec_id AS dof, {_three(5)} FROM embeddings", "dof", None))
def basis(spark, sf_dir):
    """Modes of three snapshots: leverage of all vectors and captured energy."""
    e = _snapshots(spark, sf_dir, 5)
    return _answer(R.pod_fit(e, n_modes=2).modes, e, ("dof",), None)


@query(
    "rom_basis_error",
    f"""WITH r AS (SELECT {_three(5)} FROM embeddings), c AS (SELECT x0 - (x0 + x1 + x2) / 3 AS a, x1 - (x0 + x1 + x2) / 3 AS b, x2 - (x0 + x1 + x2) / 3 AS d, x0 * x0 + x1 * x1 + x2 * x2 AS square FROM r),
 g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * d) AS ad, sum(b * d) AS bd, sum(d * d) AS dd, sum(square) AS total FROM c),
 e AS (SELECT *, ((aa + bb + dd) - sqrt((aa + bb + dd) ** 2 - 4 * (aa * bb - ab * ab + aa * dd - ad * ad + bb * dd - bd * bd))) / 2 AS low FROM g),
 v AS (SELECT low, total, ab * bd - ad * (bb - low) AS p, ad * ab - (aa - low) * bd AS q, (aa - low) * (bb - low) - ab * ab AS s FROM e), u AS (SELECT low, total, p / sqrt(p * p + q * q + s * s) AS p, q / sqrt(p * p + q * q + s * s) AS q, s / sqrt(p * p + q * q + s * s) AS s FROM v)
 SELECT round(sqrt(low / total), 7) AS relative_l2, round(top * greatest(abs(p), abs(q), abs(s)), 7) AS max_abs FROM u, (SELECT max(abs(a * p + b * q + d * s)) AS top FROM c, u)""",
)
def basis_error(spark, sf_dir):
    """What one mode of three snapshots leaves of them: the second eigenvector's part."""
    e = _snapshots(spark, sf_dir, 5)
    return rounded(R.pod_error(e, R.pod_fit(e, n_modes=1)), 7)


#: Least squares of the last and of the first of three snapshots on the other two.
_DYNAMICS = f"""WITH x AS (SELECT vec_id AS dof, {_three(1)} FROM embeddings), g AS (SELECT sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x0 * x2) AS g02, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22 FROM x),
 c AS (SELECT (g02 * g11 - g12 * g01) / (g00 * g11 - g01 * g01) AS c1, (g00 * g12 - g01 * g02) / (g00 * g11 - g01 * g01) AS c2, (g01 * g22 - g02 * g12) / (g11 * g22 - g12 * g12) AS p, (g11 * g02 - g12 * g01) / (g11 * g22 - g12 * g12) AS q FROM g)"""


@query(
    "rom_dynamics_of_three",
    f"""{_DYNAMICS} SELECT dof, CAST(s AS INTEGER) AS step, round(CASE s WHEN 0 THEN p * x1 + q * x2 WHEN 1 THEN q * c1 * x1 + (p + q * c2) * x2 ELSE c1 * (p + q * c2) * x1 + (q * c1 + c2 * (p + q * c2)) * x2 END, 6) + 0.0 AS value FROM x, c, (SELECT unnest([0, 1, 2]) AS s)""",
)
def dynamics(spark, sf_dir):
    """Dynamic modes of three snapshots of all vectors, fitted and predicted: the first is projected on the span of the others, which the dynamics map to itself."""
    return rounded(R.dmd_predict(R.dmd_fit(_snapshots(spark, sf_dir, 1)), [0, 1, 2]))


def _spectrum(trace: str, det: str) -> str:
    """Eigenvalues of two by two from trace and determinant: by size, then by imaginary part."""
    root = f"sqrt(abs({trace} * {trace} / 4 - {det}))"
    return f"SELECT {trace} * {trace} / 4 >= {det} AS split, {trace} / 2 AS mid, {root} AS root"


_LAMBDA = """ l AS (SELECT m, CASE WHEN split THEN mid + CASE WHEN (m = 0) = (mid >= 0) THEN root ELSE -root END ELSE mid END AS re, CASE WHEN split THEN 0 WHEN m = 0 THEN -root ELSE root END AS im FROM w, (SELECT unnest([0, 1]) AS m))
 SELECT CAST(m AS INTEGER) AS mode, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(ln(sqrt((re + 1e-10) ** 2 + im * im)), 6) + 0.0 AS growth, round(atan2(im, re + 1e-10) / (2 * pi()), 6) + 0.0 AS frequency, sqrt(re * re + im * im) < 1 AS stable FROM l"""


@query("rom_spectrum_of_three", f"{_DYNAMICS}, w AS ({_spectrum('c2', '(-c1)')} FROM c), {_LAMBDA}")
def spectrum(spark, sf_dir):
    """Eigenvalues of the dynamics of three snapshots, growth and frequency."""
    return rounded(R.koopman_spectrum(spark, R.dmd_fit(_snapshots(spark, sf_dir, 1)).eigenvalues))


@query(
    "rom_lifted_pair_spectrum",
    f"""WITH s AS (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS h, avg(ln(1 + value)) AS a FROM events GROUP BY 1, 2), n AS (SELECT a, lead(a) OVER v AS b, h, lead(h) OVER v AS next FROM s WINDOW v AS (PARTITION BY event_type ORDER BY h)), p AS (SELECT a, a * a AS a2, b, b * b AS b2 FROM n WHERE next = h + 1),
 g AS (SELECT sum(a * a) AS g11, sum(a * a2) AS g12, sum(a2 * a2) AS g22, sum(a * b) AS h11, sum(a2 * b) AS h12, sum(a * b2) AS h21, sum(a2 * b2) AS h22 FROM p), k AS (SELECT (h11 * g22 - h12 * g12) / (g11 * g22 - g12 * g12) AS k11, (h12 * g11 - h11 * g12) / (g11 * g22 - g12 * g12) AS k12, (h21 * g22 - h22 * g12) / (g11 * g22 - g12 * g12) AS k21, (h22 * g11 - h21 * g12) / (g11 * g22 - g12 * g12) AS k22 FROM g),
 d AS (SELECT k11 + k22 AS t, k11 * k22 - k12 * k21 AS det FROM k), w AS ({_spectrum('t', 'det')} FROM d), {_LAMBDA}""",
)
def lifted_pair(spark, sf_dir):
    """Lifted dynamics (a value and its square) of each event type's hourly means, and their spectrum."""
    h = ((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("long")
    s = table(spark, sf_dir, "events").groupBy("event_type", h.alias("step")).agg(F.avg(F.log1p("value")).alias("a"))
    return rounded(R.koopman_spectrum(spark, R.edmd_fit(s, ["a"], "event_type", "step", "polynomial", 2).eigenvalues))


@query(
    "regress_predicted_residuals",
    "WITH c AS (SELECT regr_intercept(l_extendedprice / 1000, l_quantity) AS a, regr_slope(l_extendedprice / 1000, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 5) + 0.0 AS predicted, round(l_extendedprice / 1000 - a - b * l_quantity, 5) + 0.0 AS residual FROM lineitem, c",
)
def residuals(spark, sf_dir):
    """Fitted price model of all line items, applied to each of them."""
    li = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    terms = E.library(["l_quantity"], 1)
    c, _ = E.sindy_fit(li, terms, ["price"], threshold=0.0)
    p = E.predict(terms, c[:, 0])
    return rounded(li.select("l_orderkey", "l_linenumber", p.alias("predicted"), (F.col("price") - p).alias("residual")), 5)


@query(
    "spatial_rbf_three",
    f"""WITH {_V}, q AS (SELECT a.id, a.x + 0.01 AS x, a.y - 0.02 AS y FROM v a), d AS (SELECT q.id, q.x AS qx, q.y AS qy, v.id AS other, v.x - q.x AS x, v.y - q.y AS y, v.value, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((v.x - q.x) ** 2 + (v.y - q.y) ** 2), v.id) AS r FROM q, v),
 t AS (SELECT id, max(x) FILTER (WHERE r = 1) AS x1, max(y) FILTER (WHERE r = 1) AS y1, max(value) FILTER (WHERE r = 1) AS v1, max(x) FILTER (WHERE r = 2) AS x2, max(y) FILTER (WHERE r = 2) AS y2, max(value) FILTER (WHERE r = 2) AS v2, max(x) FILTER (WHERE r = 3) AS x3, max(y) FILTER (WHERE r = 3) AS y3, max(value) FILTER (WHERE r = 3) AS v3 FROM d WHERE r <= 3 GROUP BY id)
 SELECT id, round((v1 * (x2 * y3 - x3 * y2) + v2 * (x3 * y1 - x1 * y3) + v3 * (x1 * y2 - x2 * y1)) / (x2 * y3 - x3 * y2 + x3 * y1 - x1 * y3 + x1 * y2 - x2 * y1), 4) + 0.0 AS value FROM t""",
)
def rbf_three(spark, sf_dir):
    """Splines through the three nearest values of every shifted vector: three points leave the linear tail alone, the plane through them."""
    v = _vec(spark, sf_dir)
    return rounded(S.rbf_interpolate(v, v, v.select("id", F.array(F.col("p")[0] + 0.01, F.col("p")[1] - 0.02).alias("p")), k=3), 4)
