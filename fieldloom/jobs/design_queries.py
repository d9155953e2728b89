"""Registered queries on bases, sampling statistics, fidelity, candidates and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.jobs.graph_queries import _E, _ME, _P, _cloud, _edges, _nodes, _vec
from fieldloom.jobs.model_queries import _snap
from fieldloom.jobs.stat_queries import _MF, _li, _mf
from fieldloom.jobs.tables import PTS, mesh, points, rounded, table
from fieldloom.operators import extra as X
from fieldloom.operators import graph as G
from fieldloom.operators import mesh as M
from fieldloom.operators import rom as R
from fieldloom.operators import spectral as Z
from fieldloom.operators import surrogate as C
from fieldloom.operators import uq as U

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# Bases: projection and reconstruction onto given modes are plain sums.


def _given_modes(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), e[10].cast("double").alias("mean"), F.array(*[e[k].cast("double") for k in (11, 12, 13)]).alias("phi"))


@query("rom_project", "WITH s AS (SELECT vec_id, k AS state, CAST(embedding[k + 1] AS DOUBLE) - CAST(embedding[11] AS DOUBLE) AS v, embedding FROM embeddings, (SELECT unnest(range(10)) AS k)) SELECT CAST(state AS INTEGER) AS state, CAST(m AS INTEGER) AS mode, round(sum(v * CAST(embedding[m + 12] AS DOUBLE)), 6) + 0.0 AS coef FROM s, (SELECT unnest(range(3)) AS m) GROUP BY state, m")
def project(spark, sf_dir):
    """Ten states of all vectors on three given modes."""
    states = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.posexplode(F.slice("embedding", 1, 10)).alias("state", "value")).withColumn("value", F.col("value").cast("double"))
    return rounded(R.pod_project(states, _given_modes(spark, sf_dir)))


@query("rom_reconstruct", "SELECT CAST(s AS INTEGER) AS state, vec_id AS dof, round(CAST(embedding[11] AS DOUBLE) + (s + 1) * CAST(embedding[12] AS DOUBLE) - 0.5 * CAST(embedding[13] AS DOUBLE) + s * 0.25 * CAST(embedding[14] AS DOUBLE), 6) + 0.0 AS value FROM embeddings, (SELECT unnest(range(5)) AS s)")
def reconstruct(spark, sf_dir):
    coefs = [(s, m, c) for s in range(5) for m, c in enumerate((s + 1.0, -0.5, s * 0.25))]
    return rounded(R.pod_reconstruct(spark.createDataFrame(coefs, "state int, mode int, coef double"), _given_modes(spark, sf_dir)))


@query(
    "rom_weighted_gram",
    """WITH s AS (SELECT vec_id AS dof, label % 3 AS part, label + 1 AS w, unnest(range(16)) AS k, unnest(embedding[1:16])::DOUBLE AS v FROM embeddings), c AS (SELECT dof, part, w, k, v - avg(v) OVER (PARTITION BY dof) AS v FROM s)
 SELECT a.part, CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(sum(a.w * a.v * b.v), 6) + 0.0 AS s FROM c a JOIN c b ON a.dof = b.dof AND a.k <= b.k GROUP BY a.part, a.k, b.k""",
)
def weighted_gram(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("part"), (F.col("label") + 1).alias("w"), F.slice("embedding", 1, 16).alias("xs"))
    return rounded(R.gram_by(e, "part", "w"))


def _answer(modes, packed, keys: tuple[str, ...], group: str | None, weight: str | None = None):
    """Each row's leverage in the first two modes, and the energy that each of them captures of the centred snapshots.

    Neither depends on signs; together they fix the span of the modes and the modes' order and length.
    """
    by = [group] if group else []
    mean = F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / F.size("xs")
    x = packed.select(*keys, *[c for c in by if c not in keys], F.col("xs").cast("array<double>").alias("xs"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    j = modes.select(*keys, *[c for c in by if c not in keys], "phi").join(x, [*keys, *[c for c in by if c not in keys]]).withColumn("c", F.transform("xs", lambda v: v - mean))
    energy = lambda m: sum(F.sum(F.col("w") * F.col("c")[k] * F.col("phi")[m]) ** 2 for k in range(3))
    sums = j.groupBy(*by).agg(*[energy(m).alias(f"energy{m + 1}") for m in range(2)])
    rows = j.select(*keys, *[c for c in by if c not in keys], (F.col("phi")[0] ** 2 + F.col("phi")[1] ** 2).alias("leverage"))
    return rounded(rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums)), 5)  # one row is broadcast


def _answer_sql(rows: str, keys: str, group: str | None, weight: str = "1") -> str:
    """The same from the inner products of two centred snapshots, and the roots of the Gram matrix's characteristic polynomial.

    ``rows`` has x0, x1, x2; the three centred snapshots add up to nothing, so two of them span all.
    """
    part = f"PARTITION BY {group}" if group else ""
    return f"""WITH r AS ({rows}), c AS (SELECT *, x0 - (x0 + x1 + x2) / 3 AS a, x1 - (x0 + x1 + x2) / 3 AS b, x2 - (x0 + x1 + x2) / 3 AS d FROM r),
 g AS (SELECT *, sum({weight} * a * a) OVER ({part}) AS aa, sum({weight} * a * b) OVER ({part}) AS ab, sum({weight} * b * b) OVER ({part}) AS bb, sum({weight} * a * d) OVER ({part}) AS ad, sum({weight} * b * d) OVER ({part}) AS bd, sum({weight} * d * d) OVER ({part}) AS dd FROM c),
 e AS (SELECT *, aa + bb + dd AS t, aa * bb - ab * ab + aa * dd - ad * ad + bb * dd - bd * bd AS q FROM g)
 SELECT {keys}, round((bb * a * a - 2 * ab * a * b + aa * b * b) / (aa * bb - ab * ab), 5) + 0.0 AS leverage, round((t + sqrt(t * t - 4 * q)) / 2, 5) + 0.0 AS energy1, round((t - sqrt(t * t - 4 * q)) / 2, 5) + 0.0 AS energy2 FROM e"""


def _three(lo: int) -> str:
    return ", ".join(f"embedding[{lo + k}]::DOUBLE AS x{k}" for k in range(3))


@query("rom_basis_by_label", _answer_sql(f"SELECT label, vec_id AS dof, {_three(1)} FROM embeddings", "label, dof", "label"))
def basis_by_label(spark, sf_dir):
    """Each label's modes of three snapshots: leverage of its vectors and captured energy."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("dof"), F.slice("embedding", 1, 3).alias("xs"))
    return _answer(R.pod_modes_by(e, "label", 2), e, ("dof",), "label")


@query("rom_basis_weighted", _answer_sql(f"SELECT vec_id AS dof, label + 1.0 AS w, {_three(1)} FROM embeddings", "dof", None, "w"))
def basis_weighted(spark, sf_dir):
    """Modes of three snapshots in a weighted inner product."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), (F.col("label") + 1.0).alias("w"), F.slice("embedding", 1, 3).alias("xs"))
    return _answer(R.pod_fit(e, n_modes=2, weight="w").modes, e, ("dof",), None, "w")


@query("rom_basis_randomized", _answer_sql(f"SELECT vec_id AS dof, {_three(1)} FROM embeddings", "dof", None))
def basis_randomized(spark, sf_dir):
    """Modes of three snapshots by the random range finder, whose range holds all of them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.slice("embedding", 1, 3).alias("xs"))
    return _answer(R.pod_randomized(e, 2).modes, e, ("dof",), None)


@query("rom_basis_multifield", _answer_sql(f"SELECT 'low' AS field, vec_id AS dof, {_three(1)} FROM embeddings UNION ALL SELECT 'high', vec_id, {_three(33)} FROM embeddings", "field, dof", None))
def basis_multifield(spark, sf_dir):
    """One basis of two stacked fields of each vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.explode(F.array(F.struct(F.lit("low").alias("field"), F.slice("embedding", 1, 3).alias("xs")), F.struct(F.lit("high").alias("field"), F.slice("embedding", 33, 3).alias("xs")))).alias("f")).select("f.field", "dof", "f.xs")
    return _answer(R.multifield_pod(e, 2), e, ("field", "dof"), None)


@query(
    "rom_basis_interpolated",
    """WITH u AS (SELECT vec_id AS dof, embedding[1] / sqrt(sum(embedding[1]::DOUBLE * embedding[1]) OVER ()) AS a, embedding[2] / sqrt(sum(embedding[2]::DOUBLE * embedding[2]) OVER ()) AS b, embedding[3]::DOUBLE AS ma, embedding[4]::DOUBLE AS mb FROM embeddings),
 d AS (SELECT *, sum(a * b) OVER () AS d, (1 / (0.7::DOUBLE + 1e-10)) / (1 / (0.3::DOUBLE + 1e-10) + 1 / (0.7::DOUBLE + 1e-10)) AS w FROM u)
 SELECT dof, round(pow(cos(w * acos(abs(d))) * a + sin(w * acos(abs(d))) * sign(d) * (b - d * a) / sqrt(1 - d * d), 2), 6) + 0.0 AS square, round((1 - w) * ma + w * mb, 6) + 0.0 AS mean FROM d""",
)
def basis_interpolated(spark, sf_dir):
    """A line between those of two components, on the manifold of subspaces, and the mean that goes with it."""
    e = table(spark, sf_dir, "embeddings")
    own = e.select(F.col("vec_id").alias("dof"), *[F.col("embedding")[k].cast("double").alias(f"c{k}") for k in range(4)])
    size = own.agg(*[F.sqrt(F.sum(F.col(f"c{k}") ** 2)).alias(f"s{k}") for k in range(2)]).first()
    lines = F.array(*[F.struct(F.lit(k).alias("basis"), F.array(F.col(f"c{k}") / float(size[k])).alias("phi"), F.col(f"c{k + 2}").alias("mean")) for k in range(2)])
    got = R.interpolate_basis(own.select("dof", F.explode(lines).alias("l")).select("dof", "l.*"), [0.0, 1.0], 0.3, "grassmann")
    return rounded(got.select("dof", (F.col("phi")[0] ** 2).alias("square"), "mean"))


@query("rom_lifted_spectrum")
def lifted(spark, sf_dir):
    """Spectrum of lifted dynamics of each event type's hourly means (eigenvalues have no SQL; tests use a known system)."""
    h = ((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("long")
    s = table(spark, sf_dir, "events").groupBy("event_type", h.alias("step")).agg(F.avg(F.log1p("value")).alias("a"), F.count("*").cast("double").alias("b"))
    k = R.edmd_fit(s, ["a", "b"], "event_type", "step", "polynomial", 2)
    return R.koopman_spectrum(spark, k.eigenvalues)


@query("rom_multiresolution")
def multiresolution(spark, sf_dir):
    """Sum of three levels of dynamic modes of all vectors (eigenvalues have no SQL; tests compare with NumPy)."""
    return R.mrdmd_fit(_snap(spark, sf_dir), 3, 4).fitted


# Sampling statistics and fidelity.


@query("uq_convergence_end", "SELECT user_id, count(value) AS n, round(avg(sqrt(value)), 6) AS mean, round(sqrt(var_pop(sqrt(value)) / count(value)), 6) AS standard_error, round(sqrt(var_pop(sqrt(value)) / count(value)) / (abs(avg(sqrt(value))) + 1e-10), 6) AS relative_error FROM events GROUP BY user_id")
def convergence_end(spark, sf_dir):
    return rounded(U.mc_final(table(spark, sf_dir, "events").select("user_id", F.sqrt("value").alias("v")), "v", "user_id"))


@query("uq_quantiles", "SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS q0, round(median(l_extendedprice), 4) AS q1, round(quantile_cont(l_extendedprice, 0.99), 4) AS q2 FROM lineitem GROUP BY l_suppkey")
def all_quantiles(spark, sf_dir):
    from fieldloom.operators.order import quantiles

    return rounded(quantiles(_li(spark, sf_dir), "l_extendedprice", [0.1, 0.5, 0.99], ["l_suppkey"]), 4)


_BINS = """r AS (SELECT l_extendedprice AS y, unnest([{'input': 'l_discount', 'bin': floor((l_discount - 0.0) / 0.0105)}, {'input': 'l_quantity', 'bin': floor((l_quantity - 0.5) / 5.05)}]) AS s FROM lineitem), m AS (SELECT s.input AS input, s.bin AS bin, avg(y) AS m FROM r WHERE s.bin BETWEEN 0 AND 9 GROUP BY s.input, s.bin)"""


@query("uq_interaction", f"WITH {_BINS}, f AS (SELECT input, var_pop(m) / ((SELECT var_pop(l_extendedprice) FROM lineitem) + 1e-10) AS f FROM m GROUP BY input) SELECT round(1 - sum(f), 6) AS interaction FROM f")
def interaction(spark, sf_dir):
    return rounded(U.interaction_share(_li(spark, sf_dir), ["l_discount", "l_quantity"], "l_extendedprice", {"l_discount": (0.0, 0.105), "l_quantity": (0.5, 51.0)}))


_PCE = """s AS (SELECT l_quantity / 25.5 - 1 AS p, l_discount * 20 - 1 AS q, sqrt(l_extendedprice) AS f FROM lineitem), t AS (SELECT f, unnest(['0-0', '0-1', '0-2', '1-0', '1-1', '2-0']) AS term, unnest([1.0, q, (3 * q * q - 1) / 2, p, p * q, (3 * p * p - 1) / 2]) AS b FROM s),
 c AS (SELECT term, sum(f * b) / (sum(b * b) + 1e-10) AS coef FROM t GROUP BY term)"""


@query("uq_pce_moments", f"WITH {_PCE} SELECT round(max(coef) FILTER (term = '0-0'), 5) AS mean, round(sum(coef ** 2) FILTER (term <> '0-0'), 4) AS variance, round(sum(coef ** 2 * CASE term WHEN '0-1' THEN 1 / 3.0 WHEN '1-0' THEN 1 / 3.0 WHEN '1-1' THEN 1 / 9.0 ELSE 1 / 5.0 END) FILTER (term <> '0-0'), 4) AS normalized FROM c")
def pce_moments(spark, sf_dir):
    s = _li(spark, sf_dir).select((F.col("l_quantity") / 25.5 - 1).alias("p"), (F.col("l_discount") * 20 - 1).alias("q"), F.sqrt("l_extendedprice").alias("f"), F.lit(1.0).alias("w"))
    c = U.pce_fit(s, ["p", "q"], "w", "f", 2)
    both = U.pce_moments(c).crossJoin(U.pce_moments(c, True).select(F.col("variance").alias("normalized")))  # one row each
    return both.select(F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), F.round("normalized", 4).alias("normalized"))


@query("uq_map_estimate", "WITH p AS (SELECT n_nationkey AS k, sum(-0.5 * ((l_extendedprice - l_quantity * n_nationkey * 80) / 5000) ** 2) - 0.5 * (n_nationkey * 80 / 1000.0) ** 2 AS lp FROM lineitem, nation GROUP BY n_nationkey) SELECT CAST(k AS INTEGER) AS theta_id, k * 80.0 AS theta, round(lp, 3) AS log_posterior FROM p ORDER BY lp DESC, k LIMIT 1")
def map_estimate(spark, sf_dir):
    th = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("theta_id"), (F.col("n_nationkey") * 80.0).alias("theta"))
    data = _li(spark, sf_dir).select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(U.map_estimate(U.log_posterior(th, data, F.col("x") * F.col("theta"), 5000.0, 1000.0)), 3)


@query("uq_enki_exact", "WITH g AS (SELECT covar_samp(t, g) / var_pop(g) AS k FROM (SELECT CAST(o_custkey % 50 AS DOUBLE) AS t, sqrt(o_totalprice) AS g FROM orders)) SELECT o_orderkey AS id, round(o_custkey % 50 + k * (400 - sqrt(o_totalprice)), 6) + 0.0 AS theta FROM orders, g")
def enki_exact(spark, sf_dir):
    """The update without observation noise."""
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).cast("double").alias("theta"), F.sqrt("o_totalprice").alias("g"))
    return rounded(X.enki_step(e, 400.0, 0.0))


_RHO = f"WITH {_MF}, c AS (SELECT corr(h, m) ** 2 AS a, corr(h, l) ** 2 AS b FROM mf)"


def _rho(spark, sf_dir) -> list[float]:
    r = _mf(spark, sf_dir).agg(F.corr("h", "m"), F.corr("h", "l")).first()
    return [1.0, float(r[0]), float(r[1])]


@query(
    "fidelity_allocation",
    f"""{_RHO}, r AS (SELECT sqrt(greatest(1 - a, 1e-10) / 100) * sqrt(100 / (1 - a + 1e-10)) AS x0, sqrt(greatest(a - b, 1e-10) / 10) * sqrt(100 / (1 - a + 1e-10)) AS x1, sqrt(greatest(b, 1e-10)) * sqrt(100 / (1 - a + 1e-10)) AS x2, sqrt(greatest(a - b, 0) * 100 / ((1 - a + 1e-10) * 10)) AS y1, sqrt(greatest(b, 0) * 100 / (1 - a + 1e-10)) AS y2 FROM c),
 n AS (SELECT *, 123456.0 / (100 * x0 + 10 * x1 + x2) AS n, floor(123456.0 / (100 + 10 * y1 + y2)) AS m FROM r)
 SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level, CAST(unnest([greatest(1, floor(x0 * n)), greatest(1, floor(x1 * n)), greatest(1, floor(x2 * n))]) AS BIGINT) AS n, CAST(unnest([greatest(1, m), greatest(1, floor(y1 * m)), greatest(1, floor(y2 * m))]) AS BIGINT) AS nested FROM n""",
)
def allocation(spark, sf_dir):
    rho, costs = _rho(spark, sf_dir), [100.0, 10.0, 1.0]
    a, b = U.optimal_allocation(rho, costs, 123456.0), U.optimal_allocation(rho, costs, 123456.0, nested=True)
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(a, b))], "level int, n long, nested long")


@query("fidelity_mfmc_variance", f"{_RHO}, v AS (SELECT var_samp(h) AS v FROM mf) SELECT round(v / 50 * (1 - a) * (1 - b), 8) AS variance FROM c, v")
def mfmc_variance(spark, sf_dir):
    v = _mf(spark, sf_dir).agg(F.var_samp("h")).first()[0]
    return spark.createDataFrame([(round(U.mfmc_variance(v, _rho(spark, sf_dir), [50, 500, 5000]), 8),)], "variance double")


@query("fidelity_control_estimates", f"WITH {_MF}, a AS (SELECT covar_samp(h, m) / (var_pop(m) + 1e-12) AS k, avg(m) AS m0 FROM mf) SELECT round(h, 5) AS h, round(h - k * (m - m0), 5) + 0.0 AS estimate FROM mf, a")
def control_estimates(spark, sf_dir):
    return rounded(U.control_variate_estimates(_mf(spark, sf_dir), "h", "m").select("h", "estimate"), 5)


# Candidates and tasks.


@query("candidates_committee", "SELECT o_custkey AS id, round(var_pop(sqrt(o_totalprice)), 5) + 0.0 AS score FROM orders GROUP BY 1")
def committee(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.sqrt("o_totalprice").alias("mean"))
    return rounded(C.committee_disagreement(p), 5)


@query("candidates_uncertain", "SELECT id, round(std, 6) AS score FROM (SELECT o_custkey AS id, sqrt(avg(s * s) + var_pop(m)) AS std FROM (SELECT o_custkey, sqrt(o_totalprice) AS m, 1.0 + o_orderkey % 5 AS s FROM orders) GROUP BY 1) ORDER BY std DESC, id LIMIT 20")
def uncertain(spark, sf_dir):
    """The twenty customers whose ensemble is least sure (a top-k report)."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.sqrt("o_totalprice").alias("mean"), (1.0 + F.col("o_orderkey") % 5).alias("std"))
    return rounded(C.top_candidates(C.ensemble_combine(p).select("id", C.max_uncertainty(F.col("std")).alias("score")), 20))


def _greedy_sql(k: int) -> str:
    """``k`` choices one after another, each with its least distance to the earlier ones."""
    steps = ["c0 AS (SELECT o_orderkey AS id, o_custkey / 10.0::DOUBLE AS x, o_totalprice / 1e4 AS y, sqrt(o_totalprice) AS score, NULL::DOUBLE AS near FROM orders)"]
    for i in range(k):
        steps.append(f"b{i} AS MATERIALIZED (SELECT * FROM c{i} ORDER BY CASE WHEN near IS NULL THEN score ELSE score * (1 - exp(-near)) END DESC, id LIMIT 1)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.id, c.x, c.y, c.score, least(coalesce(c.near, 1e300), sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2))) AS near FROM c{i} c, b{i} b WHERE c.id <> b.id)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i} AS rank, id FROM b{i}" for i in range(k))


@query("candidates_diverse_batch", _greedy_sql(10))
def diverse(spark, sf_dir):
    """Ten orders far apart with high totals."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") / 10.0).alias("x"), (F.col("o_totalprice") / 1e4).alias("y"), F.sqrt("o_totalprice").alias("score"))
    return spark.createDataFrame([(k, int(i)) for k, i in enumerate(C.diverse_batch(o, 10, ["x", "y"]))], "rank int, id long")


_EMB = "t AS (SELECT user_id AS task, avg(value) AS a, stddev_pop(value) AS b, min(value) AS c, max(value) AS d FROM events GROUP BY user_id)"


@query("tasks_embedding", f"WITH {_EMB} SELECT task, CAST(task % 7 AS DOUBLE) AS e0, CAST(task % 3 AS DOUBLE) AS e1, 0.0 AS e2, CAST(task % 5 AS DOUBLE) AS e3, round(a, 5) AS e4, round(b, 5) AS e5, round(c, 5) AS e6, round(d, 5) AS e7, 0.0 AS e8 FROM t")
def embedding(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "value")
    t = F.col("task")
    tasks = e.select("task").distinct().select("task", F.create_map(F.lit("b"), (t % 3).cast("double"), F.lit("a"), (t % 7).cast("double")).alias("parameters"), F.array(F.lit(0.0), (t % 5).cast("double")).alias("domain"))
    g = C.task_embedding(e, 9, tasks)
    return rounded(g.select("task", *[F.col("e")[k].alias(f"e{k}") for k in range(9)]), 5)


@query("tasks_ensemble", f"WITH {_EMB}, p AS (SELECT q.task, t.task AS other, 1 / (1 + sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2 + (q.c - t.c) ** 2 + (q.d - t.d) ** 2)) AS s, t.a AS v FROM t q, t WHERE q.task % 100 = 0 AND q.task <> t.task), k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY s DESC, other) AS r FROM p) SELECT task, round(sum(s * v) / sum(s), 6) AS value FROM k WHERE r <= 5 GROUP BY task")
def task_ensemble(spark, sf_dir):
    """Users whose id is divisible by 100 as the stated queries against all users."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "value")
    t = C.task_embedding(e)
    return rounded(C.similarity_ensemble(C.similar_tasks(t.where("task % 100 = 0"), t), e.groupBy(F.col("task").alias("other")).agg(F.avg("value").alias("value"))))


# Graphs.


@query("graph_best_neighbor", f"WITH {_E}, s AS (SELECT src, dst, sum(weight) AS w FROM sym GROUP BY 1, 2) SELECT src AS id, dst, round(w, 4) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) = 1")
def best(spark, sf_dir):
    return rounded(G.best_neighbor(_edges(spark, sf_dir)), 4)


@query("graph_overlap", f"{_ME}, s AS (SELECT src, dst FROM me UNION SELECT dst, src FROM me), l AS (SELECT point_id // 500 AS part, point_id AS id FROM pts WHERE point_id IN (SELECT src FROM s)), a AS (SELECT part, id FROM l UNION SELECT part, dst FROM l JOIN s ON s.src = l.id), b AS (SELECT part, id FROM a UNION SELECT part, dst FROM a JOIN s ON s.src = a.id) SELECT part, id, id // 500 = part AS core FROM b")
def overlap(spark, sf_dir):
    """Parts of 500 points grown by two layers."""
    e = M.mesh_edges(mesh(spark, sf_dir)[1]).select("src", "dst")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.overlap_extend(ids.select(F.floor(F.col("id") / 500).alias("part"), "id"), e, 2)


@query("graph_hop_band_mean", f"{_ME}, h2 AS (SELECT DISTINCT a.src, b.dst FROM me a JOIN me b ON b.src = a.dst WHERE a.src <> b.dst), h AS (SELECT src, dst, 1 AS hops FROM me UNION ALL SELECT src, dst, 2 FROM h2 ANTI JOIN me USING (src, dst)) SELECT src AS id, hops, count(*) AS n, round(avg(u), 5) AS mean FROM h JOIN pts ON point_id = dst GROUP BY src, hops")
def hop_bands(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return rounded(G.hop_band_mean(pts.select(F.col("point_id").alias("id"), F.col("u").alias("f")), M.mesh_edges(cells), 2), 5)


@query("graph_interfaces_one_sided", f"WITH {_E}, p AS (SELECT id, id % 4 AS part FROM n), x AS (SELECT a.part AS pa, b.part AS pb, src, dst FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE a.part <> b.part) SELECT DISTINCT least(pa, pb) AS low, greatest(pa, pb) AS high, CASE WHEN pa < pb THEN src ELSE dst END AS id FROM x")
def one_sided(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.part_interfaces(e, _nodes(e).select("id", (F.col("id") % 4).alias("part")), one_sided=True)


_VOX = f"""{_P}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS n FROM p), s AS (SELECT *, sqrt((hx - lx) * (hy - ly) / greatest(1, floor(n * 0.01))) AS h FROM b), v AS (SELECT id, p.x, p.y, CAST(floor((p.x - lx) / h) AS BIGINT) AS vx, CAST(floor((p.y - ly) / h) AS BIGINT) AS vy FROM p, s), d AS (SELECT vx, vy, row_number() OVER (ORDER BY vx, vy) - 1 AS part FROM (SELECT DISTINCT vx, vy FROM v))"""


@query("graph_voxel_means", f"WITH {_VOX} SELECT part, count(*) AS size, round(avg(x), 5) AS x, round(avg(sqrt(y)), 5) AS root FROM v JOIN d USING (vx, vy) GROUP BY part")
def voxel_means(spark, sf_dir):
    """All lines pooled to about a hundredth of their number of voxels."""
    n = _cloud(spark, sf_dir)
    return rounded(G.pool_means(n.withColumn("root", F.sqrt("y")), G.voxel_labels(n, 0.01), ("x", "root")), 5)


@query("graph_coarse_edges", f"{_ME}, l AS (SELECT point_id AS id, point_id // 130 AS part FROM pts), e AS (SELECT DISTINCT a.part AS a, b.part AS b FROM me JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.part <> b.part) SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e")
def coarse(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    return G.coarse_edges(M.mesh_edges(cells), pts.select(F.col("point_id").alias("id"), F.floor(F.col("point_id") / 130).alias("part")))


_FR = f"{_ME}, bb AS (SELECT src, dst FROM me UNION ALL SELECT dst, src FROM me), m AS (SELECT src AS id, avg(q.x - p.x) AS dx, avg(q.y - p.y) AS dy FROM bb JOIN pts p ON p.point_id = src JOIN pts q ON q.point_id = dst GROUP BY src), fr AS (SELECT point_id AS id, sqrt(dx * dx + dy * dy) AS n, dx, dy FROM pts LEFT JOIN m ON m.id = point_id), u AS (SELECT id, CASE WHEN n > 1e-10 THEN dx / n ELSE 1 END AS ux, CASE WHEN n > 1e-10 THEN dy / n ELSE 0 END AS uy FROM fr)"


@query("graph_edge_transport", f"{_FR} SELECT src, dst, round(a.ux * b.ux + a.uy * b.uy, 5) + 0.0 AS t0, round(-a.ux * b.uy + a.uy * b.ux, 5) + 0.0 AS t1, round(-a.uy * b.ux + a.ux * b.uy, 5) + 0.0 AS t2, round(a.uy * b.uy + a.ux * b.ux, 5) + 0.0 AS t3 FROM me JOIN u a ON a.id = src JOIN u b ON b.id = dst")
def transport(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    e = M.mesh_edges(cells)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    frames = X.plane_frames(X.local_frames(pts.select(F.col("point_id").alias("id"), "x", "y"), both))
    t = X.edge_transport(frames, e)
    return rounded(t.select("src", "dst", *[F.col("t")[k].alias(f"t{k}") for k in range(4)]), 5)


@query("graph_frames_from_normals", f"WITH {PTS}, n AS (SELECT point_id AS id, x - 25 AS a, y - 50 AS b, 20.0 AS c FROM pts), s AS (SELECT id, a / (sqrt(a * a + b * b + c * c) + 1e-8) AS a, b / (sqrt(a * a + b * b + c * c) + 1e-8) AS b, c / (sqrt(a * a + b * b + c * c) + 1e-8) AS c FROM n), t AS (SELECT *, CASE WHEN abs(a) < 0.9 THEN 0 ELSE -c END AS p, CASE WHEN abs(a) < 0.9 THEN c ELSE 0 END AS q, CASE WHEN abs(a) < 0.9 THEN -b ELSE a END AS r FROM s) SELECT id, round(a, 5) + 0.0 AS nx, round(p / (sqrt(p * p + q * q + r * r) + 1e-8), 5) + 0.0 AS tx, round(q / (sqrt(p * p + q * q + r * r) + 1e-8), 5) + 0.0 AS ty, round((b * r - c * q) / (sqrt(p * p + q * q + r * r) + 1e-8), 5) + 0.0 AS ux FROM t")
def frames_normals(spark, sf_dir):
    n = points(spark, sf_dir).select(F.col("point_id").alias("id"), (F.col("x") - 25).alias("nx"), (F.col("y") - 50).alias("ny"), F.lit(20.0).alias("nz"))
    r = F.col("r")
    return rounded(X.frames_from_normals(n).select("id", r[2].alias("nx"), r[0].alias("tx"), r[3].alias("ty"), r[1].alias("ux")), 5)


@query("graph_edge_harmonics_3d", f"{_ME}, e AS (SELECT src, dst, q.x - p.x AS dx, q.y - p.y AS dy, (q.u - p.u) / 100 AS dz FROM me JOIN pts p ON p.point_id = src JOIN pts q ON q.point_id = dst), r AS (SELECT src, dst, sqrt(dx * dx + dy * dy + dz * dz) AS r, dx, dy, dz FROM e) SELECT src, dst, round(exp(-5 * 2 / 9.0 * r), 6) AS radial2, round(exp(-5 * r), 6) AS radial9, round(dz / r, 6) + 0.0 AS sh2, round(dx * dy / (r * r), 6) + 0.0 AS sh4, round(3 * dz * dz / (r * r) - 1, 6) + 0.0 AS sh6, round((dx * dx - dy * dy) / (r * r), 6) + 0.0 AS sh8 FROM r")
def harmonics_3d(spark, sf_dir):
    pts, cells = mesh(spark, sf_dir)
    h = X.edge_harmonics_3d(M.mesh_edges(cells), pts.select(F.col("point_id").alias("id"), "x", "y", (F.col("u") / 100).alias("z")))
    return rounded(h.select("src", "dst", F.col("radial")[2].alias("radial2"), F.col("radial")[9].alias("radial9"), *[F.col("sh")[k].alias(f"sh{k}") for k in (2, 4, 6, 8)]))


@query("graph_softmax_arrays", f"WITH {_E}, p AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM n), s AS (SELECT dst, ((b.f / 97 - 0.5) * (a.f / 50) + (b.f % 5) * (a.f % 3) / 10) / sqrt(2) AS s, a.f AS v, a.f % 11 AS w FROM p JOIN n a ON a.id = src JOIN n b ON b.id = dst), t AS (SELECT *, max(s) OVER (PARTITION BY dst) AS top FROM s) SELECT dst AS id, round(sum(exp(s - top) * v) / sum(exp(s - top)), 5) AS a0, round(sum(exp(s - top) * w) / sum(exp(s - top)), 5) AS a1 FROM t GROUP BY dst")
def softmax_arrays(spark, sf_dir):
    e, f = _edges(spark, sf_dir), F.col("f")
    n = _nodes(e).select("id", F.array(f / 97 - 0.5, f % 5).alias("q"), F.array(f / 50, f % 3 / 10).alias("k"), F.array(f, f % 11).alias("v"))
    a = G.softmax_aggregate(n, e)
    return rounded(a.select("id", F.col("agg")[0].alias("a0"), F.col("agg")[1].alias("a1")), 5)


_SP3 = lambda v: f"list_sum([(({v} >> k) & 1) << (3 * k) FOR k IN range(16)])"


@query("partition_morton_3d", f"""WITH {_P}, p3 AS (SELECT id, x, y, sqrt(x * y) AS z FROM p), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, count(*) AS n FROM p3),
 g AS (SELECT id, n, least(CAST(floor((x - lx) / (hx - lx + 1e-10) * 65536) AS BIGINT), 65535) AS gx, least(CAST(floor((y - ly) / (hy - ly + 1e-10) * 65536) AS BIGINT), 65535) AS gy, least(CAST(floor((z - lz) / (hz - lz + 1e-10) * 65536) AS BIGINT), 65535) AS gz FROM p3, b),
 c AS (SELECT id, n, CAST({_SP3('gx')} + 2 * {_SP3('gy')} + 4 * {_SP3('gz')} AS BIGINT) AS code FROM g) SELECT id, code, CAST(least((row_number() OVER (ORDER BY code, id) - 1) // (n // 8), 7) AS BIGINT) AS part FROM c""")
def morton_3d(spark, sf_dir):
    return G.morton_partition(_cloud(spark, sf_dir).withColumn("z", F.sqrt(F.col("x") * F.col("y"))), 8, ("x", "y", "z")).withColumn("part", F.col("part").cast("long"))


@query("graph_smallest_modes")
def modes(spark, sf_dir):
    """Three smallest modes of the customer-nation graph's suppliers (eigenvectors have no SQL; tests compare with NumPy)."""
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 40 + 1000).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    values, m = Z.smallest_modes(G.laplacian(e), 3, rounds=2, degree=4)
    return Z.heat_signature(values, m, 4)


@query("spatial_rbf_fd_check", "SELECT vec_id AS id, 4.0 AS laplacian FROM embeddings")
def rbf_fd(spark, sf_dir):
    """Weights of every vector's plane point applied to x^2 + y^2 + 3 x - y give its Laplacian, 4."""
    from fieldloom.operators.spatial import rbf_fd_weights

    v = _vec(spark, sf_dir)
    p = F.col("p")
    f = v.select(F.col("id").alias("other"), (p[0] ** 2 + p[1] ** 2 + 3 * p[0] - p[1]).alias("f"))
    return rounded(rbf_fd_weights(v, 15).join(f, "other").groupBy("id").agg(F.sum(F.col("weight") * F.col("f")).alias("laplacian")), 3)
