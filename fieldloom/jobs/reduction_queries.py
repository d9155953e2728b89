"""Registered queries on subspaces, uncertain dynamics, equations, samples and partitions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.jobs.graph_queries import _P, _cloud
from fieldloom.jobs.tables import rounded, table
from fieldloom.operators import discovery as V
from fieldloom.operators import graph as G
from fieldloom.operators import regress as E
from fieldloom.operators import rom as R
from fieldloom.operators import spectral as Z
from fieldloom.operators.spatial import kernel_correct, potential_superpose
from fieldloom.sources import generate as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _columns(spark, sf_dir, *at: int):
    """Components of all vectors as the columns c0, c1, ..."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), *[F.col("embedding")[k].cast("double").alias(f"c{i}") for i, k in enumerate(at)])


def _plane(df, a: str, b: str):
    """Orthonormal modes of the plane of two columns."""
    g = df.agg(F.sum(F.col(a) ** 2), F.sum(F.col(a) * F.col(b)), F.sum(F.col(b) ** 2)).first()
    low = float(np.sqrt(g[0]))
    rest = float(np.sqrt(g[2] - g[1] ** 2 / g[0]))
    return df.select("dof", F.array(F.col(a) / low, (F.col(b) - F.col(a) * (g[1] / g[0])) / rest).alias("phi"))


@query(
    "rom_subspace_distance",
    """WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[1]::DOUBLE + embedding[3] AS c, embedding[2]::DOUBLE + 0.5 * embedding[4] AS d FROM embeddings),
 g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(c * c) AS cc, sum(c * d) AS cd, sum(d * d) AS dd, sum(a * c) AS ac, sum(a * d) AS ad, sum(b * c) AS bc, sum(b * d) AS bd FROM e),
 m AS (SELECT ac / sqrt(aa * cc) AS p, (ad - ac * cd / cc) / sqrt(aa * (dd - cd * cd / cc)) AS q, (bc - ab * ac / aa) / sqrt((bb - ab * ab / aa) * cc) AS r, (bd - cd / cc * bc - ab / aa * (ad - cd / cc * ac)) / sqrt((bb - ab * ab / aa) * (dd - cd * cd / cc)) AS s FROM g),
 v AS (SELECT p * p + q * q + r * r + s * s AS t, abs(p * s - q * r) AS det FROM m)
 SELECT round(sqrt(pow(acos((sqrt(t + 2 * det) + sqrt(t - 2 * det)) / 2), 2) + pow(acos((sqrt(t + 2 * det) - sqrt(t - 2 * det)) / 2), 2)), 6) AS distance FROM v""",
)
def subspace_distance(spark, sf_dir):
    """Principal angles between two planes of components of all vectors."""
    c = _columns(spark, sf_dir, 0, 1, 2, 3)
    d = c.select("dof", (F.col("c0") + F.col("c2")).alias("c0"), (F.col("c1") + 0.5 * F.col("c3")).alias("c1"))
    return spark.createDataFrame([(round(R.subspace_distance(_plane(c, "c0", "c1"), _plane(d, "c0", "c1")), 6),)], "distance double")


@query("rom_kernel_dynamics")
def kernel_dynamics(spark, sf_dir):
    """Eigenvalues of kernel dynamic modes of twelve snapshots of all vectors (no SQL; tests compare with NumPy)."""
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.slice("embedding", 1, 12).alias("xs"))
    rows = [(k, m, float(x.real), float(x.imag)) for k, more in (("linear", {}), ("polynomial", {"degree": 2}), ("rbf", {"gamma": 0.01})) for m, x in enumerate(R.kernel_dmd_eigenvalues(s, k, rank=4, **more))]
    return spark.createDataFrame(rows, "kernel string, mode int, re double, im double")


@query("rom_dynamics_uncertain")
def dynamics_uncertain(spark, sf_dir):
    """Mean and deviation of the dynamics of all vectors under noise (drawn; tests compare with plain draws)."""
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.col("embedding").cast("array<double>").alias("xs"))
    return R.dmd_predict_uncertain(R.dmd_fit(s, rank=4), 0.01, [0, 1, 5], 500, seed=7)


@query("rom_dynamics_posterior")
def dynamics_posterior(spark, sf_dir):
    """Deviations of continuous eigenvalues over as many draws as there are events (no SQL; tests draw plainly)."""
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.col("embedding").cast("array<double>").alias("xs"))
    omega = np.log(R.dmd_fit(s, rank=4).eigenvalues + 1e-300)
    return R.dmd_posterior(spark, omega, 0.05, table(spark, sf_dir, "events").count(), seed=3)


@query("rom_interpolation_points")
def interpolation_points(spark, sf_dir):
    """Twelve interpolation dofs of four modes' and eight residual modes' rows (no SQL; tests hold them against pivoted QR)."""
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.col("embedding").cast("array<double>").alias("xs"))
    modes = R.pod_fit(s, n_modes=12).modes
    state, rest = (modes.select("dof", F.slice("phi", a, n).alias("phi")) for a, n in ((1, 4), (5, 8)))
    rows = [(kind, k, int(d)) for kind, got in (("qdeim", R.qdeim_points(state, 4)), ("gnat", R.gnat_points(state, rest, 12))) for k, d in enumerate(got)]
    return spark.createDataFrame(rows, "kind string, place int, dof long")


# Equations.

_HOUR = "(epoch(date_trunc('hour', ts)) - epoch(TIMESTAMP '2024-01-01')) / 3600"


def _hourly(spark, sf_dir):
    """Means of the events of a type and hour: the run, the hour, the mean logarithm and the number."""
    h = (F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run_id"), h.alias("t")).agg(F.avg(F.log1p("value")).alias("x"), F.count("*").cast("double").alias("n"))


@query(
    "regress_constrained",
    f"""WITH h AS (SELECT event_type, {_HOUR} AS t, avg(ln(1 + value)) AS x, count(*)::DOUBLE AS n FROM events GROUP BY ALL), g AS (SELECT sum(x * x) AS xx, sum(x * n) AS xn, sum(n * n) AS nn, sum(x * t) AS xt, sum(n * t) AS nt FROM h), c AS (SELECT (nn * xt - xn * nt) / (xx * nn - xn * xn) AS a, (xx * nt - xn * xt) / (xx * nn - xn * xn) AS b FROM g)
 SELECT round(a, 5) + 0.0 AS free_x, round(b, 5) + 0.0 AS free_n, round(a - (a + b - 1) / 2, 5) + 0.0 AS x, round(b - (a + b - 1) / 2, 5) + 0.0 AS n FROM c""",
)
def constrained(spark, sf_dir):
    """The hour on the hour's mean and number, with coefficients that add up to one."""
    c, _ = E.sindy_fit(_hourly(spark, sf_dir), [("x", F.col("x")), ("n", F.col("n"))], ["t"], 0.0)
    held = E.sindy_constrained(c[:, 0], np.array([[1.0, 1.0]]), np.array([1.0]), 0.0)
    return rounded(spark.createDataFrame([(float(c[0, 0]), float(c[1, 0]), float(held[0]), float(held[1]))], "free_x double, free_n double, x double, n double"), 5)


@query(
    "regress_weak_form",
    f"""WITH h AS (SELECT event_type AS r, {_HOUR} AS t, avg(ln(1 + value)) AS x FROM events GROUP BY ALL), b AS (SELECT min(t) AS lo, max(t) AS hi, 2.0 * (max(t) - min(t)) / 21 AS w FROM h),
 d AS (SELECT *, (coalesce(lead(t) OVER (PARTITION BY r ORDER BY t), t) - coalesce(lag(t) OVER (PARTITION BY r ORDER BY t), t)) / 2 AS dt FROM h), k AS (SELECT k, lo + (hi - lo) * (k + 1) / 20 * 20 / 21 AS c, w, lo, hi FROM b, (SELECT unnest(range(20)) AS k)),
 z AS (SELECT k, x, dt, (t - c) / w AS z, w FROM d JOIN k ON abs(t - c) < w WHERE c - w >= lo AND c + w <= hi), s AS (SELECT k, sum(pow(1 - z * z, 2) * dt) AS p, sum(x * pow(1 - z * z, 2) * dt) AS q, sum(x * 4 * z * (1 - z * z) / w * dt) AS y FROM z GROUP BY k),
 g AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy FROM s) SELECT round((qq * py - pq * qy) / (pp * qq - pq * pq), 5) + 0.0 AS one, round((pp * qy - pq * py) / (pp * qq - pq * pq), 5) + 0.0 AS x FROM g""",
)
def weak_form(spark, sf_dir):
    """x' = a + b x of the hourly means from integrals against bumps, without derivatives."""
    h = _hourly(spark, sf_dir)
    c = E.weak_sindy(h, [("1", F.lit(1.0)), ("x", F.col("x"))], "x", "t", 20, 0.0)
    return rounded(spark.createDataFrame([(float(c[0]), float(c[1]))], "one double, x double"), 5)


@query(
    "regress_pde",
    """WITH u AS (SELECT user_id % 12 AS ix, date_diff('day', TIMESTAMP '2024-01-01', ts) AS it, (user_id % 12)::DOUBLE AS x, date_diff('day', TIMESTAMP '2024-01-01', ts)::DOUBLE AS t, avg(ln(1 + value)) AS u FROM events GROUP BY ALL),
 n AS (SELECT *, lag(u) OVER a AS tp, lead(u) OVER a AS tn, t - lag(t) OVER a AS hp, lead(t) OVER a - t AS hn, lag(u) OVER b AS xp, lead(u) OVER b AS xn, x - lag(x) OVER b AS kp, lead(x) OVER b - x AS kn FROM u WINDOW a AS (PARTITION BY ix ORDER BY t), b AS (PARTITION BY it ORDER BY x)),
 d AS (SELECT u, CASE WHEN hp IS NULL THEN (tn - u) / hn WHEN hn IS NULL THEN (u - tp) / hp ELSE (hp * hp * tn + (hn * hn - hp * hp) * u - hn * hn * tp) / (hp * hn * (hp + hn)) END AS y, CASE WHEN kp IS NULL THEN (xn - u) / kn WHEN kn IS NULL THEN (u - xp) / kp ELSE (kp * kp * xn + (kn * kn - kp * kp) * u - kn * kn * xp) / (kp * kn * (kp + kn)) END AS v FROM n),
 f AS (SELECT u AS p, v AS q, u * v AS r, y FROM d WHERE isfinite(u) AND isfinite(v) AND isfinite(y)), g AS (SELECT avg(p) AS mp, avg(q) AS mq, avg(r) AS mr, avg(y) AS my, covar_pop(p, p) AS pp, covar_pop(p, q) AS pq, covar_pop(p, r) AS pr, covar_pop(q, q) AS qq, covar_pop(q, r) AS qr, covar_pop(r, r) AS rr, covar_pop(p, y) AS py, covar_pop(q, y) AS qy, covar_pop(r, y) AS ry, covar_pop(y, y) AS yy FROM f),
 m AS (SELECT *, pp * (qq * rr - qr * qr) - pq * (pq * rr - qr * pr) + pr * (pq * qr - qq * pr) AS det FROM g),
 c AS (SELECT *, (py * (qq * rr - qr * qr) - pq * (qy * rr - qr * ry) + pr * (qy * qr - qq * ry)) / det AS b1, (pp * (qy * rr - ry * qr) - py * (pq * rr - qr * pr) + pr * (pq * ry - qy * pr)) / det AS b2, (pp * (qq * ry - qr * qy) - pq * (pq * ry - qy * pr) + py * (pq * qr - qq * pr)) / det AS b3 FROM m)
 SELECT round(my - b1 * mp - b2 * mq - b3 * mr, 4) + 0.0 AS one, round(b1, 4) + 0.0 AS u, round(b2, 4) + 0.0 AS u_x, round(b3, 4) + 0.0 AS u_times_u_x, round(yy - b1 * py - b2 * qy - b3 * ry, 4) + 0.0 AS residual FROM c""",
)
def pde(spark, sf_dir):
    """u_t = a + b u + c u_x + d u u_x of the daily means of twelve groups of users."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("ix"), day.alias("it")).agg(F.avg(F.log1p("value")).alias("u"))
    _, found, residual = E.pde_find(e.select("ix", "it", F.col("ix").cast("double").alias("x"), F.col("it").cast("double").alias("t"), "u"), 1, 1, 0.0)
    return rounded(spark.createDataFrame([(*[found.get(k, 0.0) for k in ("1", "u", "u_x", "u*u_x")], residual)], "one double, u double, u_x double, u_times_u_x double, residual double"), 4)


# Samples and partitions.


@query("source_domain_sample")
def domain_sample(spark, sf_dir):
    """As many points as there are customers in the disc about the middle of the box of all mesh points (hash draws have no SQL; tests draw plainly)."""
    c = _cloud(spark, sf_dir)
    b = c.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    mid, radius = ((b[0] + b[1]) / 2, (b[2] + b[3]) / 2), min(b[1] - b[0], b[3] - b[2]) / 2
    inside = (F.col("x") - mid[0]) ** 2 + (F.col("y") - mid[1]) ** 2 <= radius**2
    return S.sample_domain(spark, [(b[0], b[1]), (b[2], b[3])], inside, table(spark, sf_dir, "customer").count(), seed=11)


@query("source_parameter_sample")
def parameter_sample(spark, sf_dir):
    """A parameter point for each supplier in the box of balances and nations (hash draws have no SQL; tests draw plainly)."""
    s = table(spark, sf_dir, "supplier")
    b = s.agg(F.min("s_acctbal"), F.max("s_acctbal"), F.min("s_nationkey"), F.max("s_nationkey"), F.count("*")).first()
    return S.parameter_samples(spark, [(float(b[0]), float(b[1])), (float(b[2]), float(b[3]))], b[4], seed=5)


def _cut(name: str, of: str, by: str) -> str:
    axis = f"CASE WHEN max(x) OVER ({by}) - min(x) OVER ({by}) >= max(y) OVER ({by}) - min(y) OVER ({by}) THEN x ELSE y END"
    return f"{name}v AS (SELECT *, {axis} AS v FROM {of}), {name} AS (SELECT * EXCLUDE (v), CASE WHEN v <= median(v) OVER ({by}) THEN 0 ELSE 1 END AS {name} FROM {name}v)"


@query("partition_longest_axis", f"WITH {_P}, {_cut('l1', 'p', '')}, {_cut('l2', 'l1', 'PARTITION BY l1')} SELECT id, CAST(2 * l1 + l2 AS INTEGER) AS part FROM l2")
def longest_axis(spark, sf_dir):
    """Four parts by medians along each block's longest axis."""
    return G.kdtree_partition(_cloud(spark, sf_dir), 4, longest=True)


def user_graph(spark, sf_dir):
    """Users of consecutive events as neighbours, weighted by how often they are."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("other"))
    pairs = e.join(after, "event_id").where("user_id <> other").select(F.least("user_id", "other").alias("src"), F.greatest("user_id", "other").alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


@query("partition_spectral")
def spectral_parts(spark, sf_dir):
    """Four parts of the users' graph by second modes, level by level (eigenvectors have no SQL; tests compare with NumPy)."""
    return Z.spectral_bisect(user_graph(spark, sf_dir), 4, rounds=2)


_DAY = "date_diff('day', TIMESTAMP '2024-01-01', ts)"
_QUARTER = "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 21600) AS BIGINT)"


@query(
    "regress_coarse_to_fine",
    f"""WITH r AS (SELECT unnest([1, 2, 3]) AS run), c AS (SELECT {_DAY} * 12 + user_id % 12 AS id, {_DAY}::DOUBLE AS x, (user_id % 12)::DOUBLE AS y, run, avg(pow(ln(1 + value), run)) AS value FROM events, r GROUP BY ALL),
 f AS (SELECT {_QUARTER} * 12 + user_id % 12 AS id, {_QUARTER} * 0.25::DOUBLE AS x, (user_id % 12)::DOUBLE AS y, run, avg(pow(ln(1 + value), run)) AS value FROM events, r GROUP BY ALL),
 p AS (SELECT DISTINCT id, x, y FROM c), q AS (SELECT DISTINCT id, x, y FROM f), d AS (SELECT q.id, p.id AS other, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS dist FROM q, p), n AS (SELECT *, 1 / (dist + 1e-10) AS w FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, other) <= 4)
 SELECT n.id, c.run, round(sum(w * c.value) / sum(w), 4) + 0.0 AS prolonged, round(first(f.value), 3) + 0.0 AS corrected FROM n JOIN c ON c.id = n.other JOIN f ON f.id = n.id AND f.run = c.run GROUP BY n.id, c.run""",
)
def coarse_to_fine(spark, sf_dir):
    """Moments of the events by day and group of users on quarters of days; runs that were learned come back as they are."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    quarter = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 21_600_000_000)
    moments = F.array(*[F.struct(F.lit(k).alias("run"), (F.log1p("value") ** k).alias("v")) for k in (1, 2, 3)])

    def level(at, scale):
        g = e.select((at * 12 + F.col("user_id") % 12).cast("long").alias("id"), (at * scale).cast("double").alias("x"), (F.col("user_id") % 12).cast("double").alias("y"), F.explode(moments).alias("m"))
        g = g.groupBy("id", "x", "y", "m.run").agg(F.avg("m.v").alias("value"))
        return g.select("id", F.array("x", "y").alias("p")).distinct(), g.select("id", "run", "value")

    (cp, c), (fp, f) = level(day, 1.0), level(quarter, 0.25)
    out = V.coarse_to_fine(cp, c, fp, f, k=4, ridge=0.0)
    return out.select("id", "run", (F.round("prolonged", 4) + F.lit(0.0)).alias("prolonged"), (F.round("corrected", 3) + F.lit(0.0)).alias("corrected"))


# Sums over all points by a tree of boxes.

_PLANE = "q AS (SELECT p_partkey AS id, p_size / 5.0::DOUBLE AS x, (p_partkey % 101) / 10.0::DOUBLE AS y FROM part), s AS (SELECT c_custkey AS k, (c_custkey % 97) / 9.7::DOUBLE AS sx, c_nationkey / 2.5::DOUBLE + (c_custkey % 7) / 50.0::DOUBLE AS sy, c_acctbal / 1000.0::DOUBLE AS r FROM customer)"


def _plane_tables(spark, sf_dir):
    """Parts as queries and customers as weighted points of the plane."""
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 5.0).alias("x"), ((F.col("p_partkey") % 101) / 10.0).alias("y"))
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(k.alias("k"), ((k % 97) / 9.7).alias("x"), (F.col("c_nationkey") / 2.5 + (k % 7) / 50.0).alias("y"), (F.col("c_acctbal") / 1000.0).alias("r"))
    return q, s


@query("spatial_kernel_tree", f"WITH {_PLANE} SELECT id, round(sum(exp(-2 * ((x - sx) ** 2 + (y - sy) ** 2)) * r) / (sum(exp(-2 * ((x - sx) ** 2 + (y - sy) ** 2))) + 1e-10), 4) + 0.0 AS correction FROM q, s GROUP BY id")
def kernel_tree(spark, sf_dir):
    """Gaussian means of the customers' balances at the parts, by boxes."""
    q, s = _plane_tables(spark, sf_dir)
    return rounded(kernel_correct(q.select("id", F.array("x", "y").alias("p")), s.select(F.array("x", "y").alias("p"), F.col("r").alias("residual")), 2.0, tolerance=1e-10), 4)


@query("spatial_potential_tree", f"WITH {_PLANE} SELECT id, round(sum(CASE WHEN k % 3 = 0 THEN -r / (2 * pi()) * atan2(y - sy - 0.0123, x - sx - 0.0071) ELSE r / (2 * pi()) * ln(sqrt((x - sx - 0.0071) ** 2 + (y - sy - 0.0123) ** 2) + 1e-10) END), 4) + 0.0 AS potential FROM q, s GROUP BY id")
def potential_tree(spark, sf_dir):
    """Sources and vortices at the customers' places, by boxes (shifted, so that no part lies on the cut of an angle)."""
    q, s = _plane_tables(spark, sf_dir)
    s = s.select(F.when(F.col("k") % 3 == 0, "vortex").otherwise("source").alias("kind"), F.col("r").alias("strength"), (F.col("x") + 0.0071).alias("x"), (F.col("y") + 0.0123).alias("y"))
    return rounded(potential_superpose(q, s, tolerance=1e-11), 4)


@query("regress_symbolic", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice / 1e4 * l_discount * 10), 6) AS predicted, 0.0::DOUBLE AS mse FROM lineitem GROUP BY l_returnflag")
def symbolic(spark, sf_dir):
    """The law of the discounts (price times rate), found among price, rate and tax, and applied."""
    a = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1e4).alias("price"), (F.col("l_discount") * 10).alias("rate"), (F.col("l_tax") * 10).alias("tax"))
    a = a.withColumn("saved", F.col("price") * F.col("rate"))
    _, column, mse = V.symbolic_regression(a, ["price", "rate", "tax"], "saved", generations=20, population=200, seed=3)
    return rounded(a.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(column).alias("predicted")).withColumn("mse", F.lit(round(mse, 9))))
