"""Registered queries on samples, regression, fidelity and physical states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import physics as P
from fieldloom.jobs.tables import rounded, table
from fieldloom.operators import regress as R
from fieldloom.operators import uq as U
from fieldloom.operators.order import next_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _li(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query(
    "uq_monte_carlo",
    "SELECT l_returnflag, round(avg(y), 4) AS y_mean, round(stddev_pop(y), 4) AS y_std, round(quantile_cont(y, 0.025), 4) AS y_low, round(quantile_cont(y, 0.975), 4) AS y_high FROM (SELECT l_returnflag, sqrt(l_extendedprice) * (1 - l_discount) AS y FROM lineitem) GROUP BY l_returnflag",
)
def monte_carlo(spark, sf_dir):
    s = _li(spark, sf_dir).select("l_returnflag", (F.sqrt("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    return rounded(U.monte_carlo(s, ["y"], ["l_returnflag"]), 4)


@query(
    "uq_convergence",
    """SELECT user_id, event_id, count(value) OVER w AS n, round(avg(value) OVER w, 5) AS running_mean, round(var_pop(value) OVER w, 3) AS running_var, round(sqrt(var_pop(value) OVER w / count(value) OVER w), 5) AS standard_error
 FROM (SELECT user_id, event_id, sqrt(value) AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def convergence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.sqrt("value").alias("value"))
    return U.mc_convergence(e, "event_id", "value", "user_id").select("user_id", "event_id", "n", F.round("running_mean", 5).alias("running_mean"), F.round("running_var", 3).alias("running_var"), F.round("standard_error", 5).alias("standard_error"))


@query(
    "uq_variance_decomposition",
    """WITH r AS (SELECT l_extendedprice AS y, unnest([{'input': 'l_discount', 'bin': floor((l_discount - 0.0) / 0.0105)}, {'input': 'l_quantity', 'bin': floor((l_quantity - 0.5) / 5.05)}, {'input': 'l_tax', 'bin': floor((l_tax - 0.0) / 0.0083)}]) AS s FROM lineitem),
 m AS (SELECT s.input AS input, s.bin AS bin, avg(y) AS m FROM r WHERE s.bin BETWEEN 0 AND 9 GROUP BY s.input, s.bin) SELECT input, round(var_pop(m) / ((SELECT var_pop(l_extendedprice) FROM lineitem) + 1e-10), 6) AS fraction FROM m GROUP BY input""",
)
def decomposition(spark, sf_dir):
    bounds = {"l_discount": (0.0, 0.105), "l_quantity": (0.5, 51.0), "l_tax": (0.0, 0.083)}
    return rounded(U.variance_decomposition(_li(spark, sf_dir), list(bounds), "l_extendedprice", bounds))


_SOBOL = """d AS (SELECT l_quantity / 50.0 AS a0, l_discount * 10 AS a1, l_tax * 10 AS a2, lead(l_quantity / 50.0) OVER w AS b0, lead(l_discount * 10) OVER w AS b1, lead(l_tax * 10) OVER w AS b2 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate)),
 f AS (SELECT sin(a0) + 7 * sin(a1) ** 2 + 0.1 * a2 ** 4 * sin(a0) AS fa, sin(b0) + 7 * sin(b1) ** 2 + 0.1 * b2 ** 4 * sin(b0) AS fb, [sin(b0) + 7 * sin(a1) ** 2 + 0.1 * a2 ** 4 * sin(b0), sin(a0) + 7 * sin(b1) ** 2 + 0.1 * a2 ** 4 * sin(a0), sin(a0) + 7 * sin(a1) ** 2 + 0.1 * b2 ** 4 * sin(a0)] AS fab FROM d WHERE b0 IS NOT NULL),
 v AS (SELECT (sum(fa * fa) + sum(fb * fb)) / (2 * count(*)) - ((sum(fa) + sum(fb)) / (2 * count(*))) ** 2 AS var FROM f),
 e AS (SELECT fa, fb, unnest(fab) AS x, unnest([0, 1, 2]) AS param FROM f)"""


@query("uq_sobol", f"WITH {_SOBOL} SELECT CAST(param AS INTEGER) AS param, round(least(greatest(avg(fb * (x - fa)) / any_value(var), 0), 1), 6) AS first_order, round(least(greatest(0.5 * avg((fa - x) ** 2) / any_value(var), 0), 1), 6) AS total_order FROM e, v GROUP BY param")
def sobol(spark, sf_dir):
    """Ishigami-type model; sample B is the next line of the same supplier."""
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    a = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10, F.col("l_tax") * 10)
    design = next_rows(_li(spark, sf_dir).select("l_suppkey", *order, a.alias("a")), "l_suppkey", order, ["a"])
    design = design.select("a", F.col("next_a").alias("b")).where("b is not null")
    return rounded(U.sobol_indices(design, lambda x: F.sin(x[0]) + 7 * F.sin(x[1]) ** 2 + 0.1 * x[2] ** 4 * F.sin(x[0]), 3))


@query(
    "uq_morris",
    """WITH s AS (SELECT user_id AS trajectory, event_id AS step, value, CAST(event_id % 5 AS DOUBLE) AS p, CAST(event_id % 3 AS DOUBLE) AS q, sqrt(value) AS y FROM events),
 d AS (SELECT trajectory, step, y - lag(y) OVER w AS dy, p - lag(p) OVER w AS dp, q - lag(q) OVER w AS dq FROM s WINDOW w AS (PARTITION BY trajectory ORDER BY step)),
 e AS (SELECT trajectory, 'p' AS param, min_by(dy / dp, step) AS e FROM d WHERE abs(dp) > 1e-10 GROUP BY trajectory UNION ALL SELECT trajectory, 'q', min_by(dy / dq, step) FROM d WHERE abs(dq) > 1e-10 GROUP BY trajectory)
 SELECT param, round(avg(abs(e)), 6) AS mu_star, round(CASE WHEN count(e) > 1 THEN stddev_pop(e) ELSE 0 END, 6) AS sigma FROM e GROUP BY param""",
)
def morris(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trajectory"), F.col("event_id").alias("step"), (F.col("event_id") % 5).cast("double").alias("p"), (F.col("event_id") % 3).cast("double").alias("q"), F.sqrt("value").alias("y"))
    return rounded(U.morris_screening(e, ["p", "q"]))


@query(
    "uq_pce",
    """WITH s AS (SELECT l_quantity / 25.5 - 1 AS p, l_discount * 20 - 1 AS q, sqrt(l_extendedprice) AS f FROM lineitem),
 t AS (SELECT f, unnest(['0-0', '0-1', '0-2', '1-0', '1-1', '2-0']) AS term, unnest([1.0, q, (3 * q * q - 1) / 2, p, p * q, (3 * p * p - 1) / 2]) AS b FROM s) SELECT term, round(sum(f * b) / (sum(b * b) + 1e-10), 6) AS coef FROM t GROUP BY term""",
)
def pce(spark, sf_dir):
    s = _li(spark, sf_dir).select((F.col("l_quantity") / 25.5 - 1).alias("p"), (F.col("l_discount") * 20 - 1).alias("q"), F.sqrt("l_extendedprice").alias("f"), F.lit(1.0).alias("w"))
    return rounded(U.pce_fit(s, ["p", "q"], "w", "f", 2))


@query(
    "uq_log_posterior",
    "SELECT CAST(n_nationkey AS INTEGER) AS theta_id, round(CAST(n_nationkey AS DOUBLE) * 80, 6) AS theta, round(sum(-0.5 * ((l_extendedprice - l_quantity * n_nationkey * 80) / 5000) ** 2) - 0.5 * (n_nationkey * 80 / 1000.0) ** 2, 3) AS log_posterior FROM lineitem, nation GROUP BY n_nationkey",
)
def log_posterior(spark, sf_dir):
    th = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("theta_id"), (F.col("n_nationkey") * 80.0).alias("theta"))
    data = _li(spark, sf_dir).select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(U.log_posterior(th, data, F.col("x") * F.col("theta"), 5000.0, 1000.0), 3)


_MF = "mf AS (SELECT l_extendedprice / 1000 AS h, l_quantity * 1.5 AS m, sqrt(l_quantity) * (1 + l_discount) AS l FROM lineitem)"


def _mf(spark, sf_dir):
    return _li(spark, sf_dir).select((F.col("l_extendedprice") / 1000).alias("h"), (F.col("l_quantity") * 1.5).alias("m"), (F.sqrt("l_quantity") * (1 + F.col("l_discount"))).alias("l"))


@query(
    "fidelity_correlation",
    f"WITH {_MF} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation, round(covar_samp({a}, {b}), 6) AS covariance FROM mf" for a, b in (("h", "h"), ("h", "m"), ("h", "l"), ("m", "m"), ("m", "l"), ("l", "l"))),
)
def correlation(spark, sf_dir):
    return rounded(U.fidelity_correlation(_mf(spark, sf_dir), ["h", "m", "l"]))


@query("fidelity_control_variate", f"WITH {_MF} SELECT round(covar_samp(h, m) / (var_pop(m) + 1e-12), 6) AS alpha, round(avg(h), 6) AS mean_hf, round(avg(m), 6) AS mean_lf, round(1 - corr(h, m) ** 2, 6) AS variance_factor FROM mf")
def control(spark, sf_dir):
    return rounded(U.control_variate(_mf(spark, sf_dir), "h", "m"))


@query(
    "fidelity_mfmc",
    """WITH r AS (SELECT o_orderkey AS rank, sqrt(o_totalprice) AS y0, sqrt(o_totalprice) * 0.9 + o_custkey % 7 AS y1, (SELECT count(*) FROM orders) AS n FROM orders)
 SELECT round(avg(y0) FILTER (rank < n // 10) + 0.8 * (avg(y1) FILTER (rank < n // 10) - avg(y1) FILTER (rank < n // 2)), 6) AS estimate FROM r""",
)
def mfmc(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.count()
    y = F.sqrt("o_totalprice")
    both = F.array(F.struct(F.lit(0).alias("level"), y.alias("y")), F.struct(F.lit(1).alias("level"), (y * 0.9 + F.col("o_custkey") % 7).alias("y")))
    mf = o.select(F.col("o_orderkey").alias("rank"), F.explode(both).alias("s")).select("rank", "s.*")
    return rounded(U.mfmc_mean(mf, [n // 10, n // 2], [1.0, 0.8]))


@query(
    "fidelity_cheapest",
    """WITH o AS (SELECT o_orderkey AS sample_id, unnest([0, 1, 2]) AS level, unnest([1.0, 4.0, 10.0]) AS cost, unnest([sqrt(o_totalprice) * 0.9, sqrt(o_totalprice) * (1 - 0.01 * (o_orderkey % 9)), sqrt(o_totalprice)]) AS y FROM orders),
 e AS (SELECT sample_id, level, cost, abs(y - max_by(y, level) OVER p) / (abs(max_by(y, level) OVER p) + 1e-10) AS err FROM o WINDOW p AS (PARTITION BY sample_id))
 SELECT sample_id, CAST(min_by(level, cost) AS INTEGER) AS level, round(min_by(err, cost), 6) AS error FROM e WHERE err <= 0.035 GROUP BY sample_id""",
)
def cheapest(spark, sf_dir):
    y = F.sqrt("o_totalprice")
    lv = [(0, 1.0, y * 0.9), (1, 4.0, y * (1 - 0.01 * (F.col("o_orderkey") % 9))), (2, 10.0, y)]
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(c).alias("cost"), v.alias("y")) for k, c, v in lv])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.explode(rows).alias("r")).select("sample_id", "r.*")
    return rounded(U.cheapest_acceptable(o, 0.035))


@query(
    "fidelity_cost_stats",
    """WITH h AS (SELECT event_type AS level, count(*) AS n FROM events GROUP BY event_type), l AS (SELECT DISTINCT event_type AS level, CAST(length(event_type) AS DOUBLE) AS cost FROM events), r AS (SELECT level, cost, coalesce(n, 0) AS n FROM l LEFT JOIN h USING (level))
 SELECT level, n, round(sum(n * cost) OVER (), 3) AS total_cost, round(sum(n) OVER () * max(cost) OVER (), 3) AS highest_cost, round(sum(n) OVER () * max(cost) OVER () - sum(n * cost) OVER (), 3) AS saved FROM r""",
)
def cost_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    levels = e.select(F.col("event_type").alias("level"), F.length("event_type").cast("double").alias("cost")).distinct()
    return rounded(U.fidelity_cost_stats(e.select(F.col("event_type").alias("level")), levels), 3)


@query(
    "regress_normal_equations",
    """WITH t AS (SELECT l_returnflag, [1.0, l_quantity, l_discount, l_extendedprice / 1000] AS v FROM lineitem), p AS (SELECT l_returnflag, unnest([0,0,0,0,1,1,1,2,2,3]) AS i, unnest([0,1,2,3,1,2,3,2,3,3]) AS j, v FROM t)
 SELECT l_returnflag, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v[i + 1] * v[j + 1]), 2) AS s FROM p GROUP BY l_returnflag, i, j""",
)
def normal_eq(spark, sf_dir):
    cols = [F.lit(1.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice") / 1000]
    return rounded(R.normal_equations(_li(spark, sf_dir), cols, ["l_returnflag"]), 2)


@query(
    "regress_derivative",
    """WITH h AS (SELECT event_type, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS DOUBLE) AS t, avg(sqrt(value)) AS u FROM events GROUP BY 1, 2), d AS (SELECT *, lag(u) OVER w AS up, lead(u) OVER w AS un, t - lag(t) OVER w AS hp, lead(t) OVER w - t AS hn FROM h WINDOW w AS (PARTITION BY event_type ORDER BY t))
 SELECT event_type, t, round(CASE WHEN hp IS NULL THEN (un - u) / hn WHEN hn IS NULL THEN (u - up) / hp ELSE (hp * hp * un + (hn * hn - hp * hp) * u - hn * hn * up) / (hp * hn * (hp + hn)) END, 6) + 0.0 AS u_t FROM d""",
)
def derivative(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy("event_type", ((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("double").alias("t")).agg(F.avg(F.sqrt("value")).alias("u"))
    return rounded(R.derivative(h, "u", "t", ["event_type"], "u_t").drop("u"))


@query(
    "regress_feature_library",
    "SELECT l_returnflag, round(sum(l_quantity), 2) AS f1, round(sum(l_discount), 4) AS f2, round(sum(l_quantity ** 2), 2) AS f3, round(sum(l_discount ** 2), 6) AS f4, round(sum(l_quantity * l_discount), 4) AS f5, round(sum(sin(l_quantity)), 6) + 0.0 AS f6, round(sum(cos(l_quantity)), 6) + 0.0 AS f7 FROM lineitem GROUP BY l_returnflag",
)
def feature_library(spark, sf_dir):
    terms = R.library(["l_quantity", "l_discount"])[1:] + R.fourier_library(["l_quantity"], 1)
    digits = (2, 4, 2, 6, 4, 6, 6)
    return _li(spark, sf_dir).groupBy("l_returnflag").agg(*[(F.round(F.sum(c), d) + F.lit(0.0)).alias(f"f{i}") for i, ((_, c), d) in enumerate(zip(terms, digits), 1)])


@query(
    "regress_linear_fit",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem",
)
def linear_fit(spark, sf_dir):
    c, r2 = R.sindy_fit(_li(spark, sf_dir), R.library(["l_quantity"], 1), ["l_extendedprice"], threshold=0.0)
    return spark.createDataFrame([(round(float(c[1, 0]), 5), round(float(c[0, 0]), 3), round(float(r2[0]), 6))], "slope double, intercept double, r2 double")


@query("regress_sindy_residuals", None)
def sindy(spark, sf_dir):
    """Sparse model of price by quantity, discount and tax, with each line's prediction (no SQL: thresholded refits)."""
    li = _li(spark, sf_dir).withColumn("price", F.col("l_extendedprice") / 1000)
    terms = R.library(["l_quantity", "l_discount", "l_tax"])
    c, _ = R.sindy_fit(li, terms, ["price"], threshold=0.05)
    return li.select("l_orderkey", "l_linenumber", "price", R.predict(terms, c[:, 0]).alias("predicted"))


@query(
    "regress_score_expressions",
    """SELECT name, round(mse, 4) AS mse, round(mse + 0.01 * k, 4) AS score FROM (SELECT unnest(['linear', 'root', 'square']) AS name, unnest([1, 2, 2]) AS k,
 unnest([avg((1.5 * l_quantity - l_extendedprice / 1000) ** 2), avg((7 * sqrt(l_quantity) - l_extendedprice / 1000) ** 2), avg((0.03 * l_quantity ** 2 - l_extendedprice / 1000) ** 2)]) AS mse FROM lineitem)""",
)
def score(spark, sf_dir):
    q = F.col("l_quantity")
    ex = {"linear": (1.5 * q, 1), "root": (7 * F.sqrt(q), 2), "square": (0.03 * q**2, 2)}
    return rounded(R.score_expressions(_li(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000), ex, "y"), 4)


@query(
    "state_report",
    """WITH s AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice / 100 AS sx, l_quantity * 7 AS sy, l_discount * 1000 AS sxy FROM lineitem), v AS (SELECT *, sqrt(sx * sx - sx * sy + sy * sy + 3 * sxy * sxy) AS vm, (sx + sy) / 2 + sqrt(((sx - sy) / 2) ** 2 + sxy * sxy) AS s1 FROM s)
 SELECT l_returnflag, round(min(vm), 5) AS lowest, round(max(vm), 5) AS highest, round(avg(vm), 5) AS mean, round(avg(CASE WHEN vm > 400 THEN 1.0 ELSE 0.0 END), 5) AS over_limit, round(max(s1), 5) AS top_principal FROM v GROUP BY l_returnflag""",
)
def state_report(spark, sf_dir):
    s = _li(spark, sf_dir).select("l_returnflag", (F.col("l_extendedprice") / 100).alias("sx"), (F.col("l_quantity") * 7).alias("sy"), (F.col("l_discount") * 1000).alias("sxy"))
    vm = P.von_mises(F.col("sx"), F.col("sy"), F.col("sxy"))
    s1 = P.principal_stresses(F.col("sx"), F.col("sy"), F.col("sxy"))[0]
    return rounded(s.select("l_returnflag", vm.alias("vm"), s1.alias("s1")).groupBy("l_returnflag").agg(F.min("vm").alias("lowest"), F.max("vm").alias("highest"), F.avg("vm").alias("mean"), F.avg(F.when(F.col("vm") > 400, 1.0).otherwise(0.0)).alias("over_limit"), F.max("s1").alias("top_principal")), 5)


@query(
    "wave_speed_max",
    "WITH s AS (SELECT l_returnflag, 1 + l_discount AS rho, l_quantity / 10 AS mx, l_tax * 10 AS my, l_extendedprice / 100 AS e FROM lineitem), p AS (SELECT *, 0.4 * (e - 0.5 * (mx * mx + my * my) / rho) AS p FROM s) SELECT l_returnflag, round(max(sqrt(mx * mx + my * my) / rho + sqrt(1.4 * p / rho)), 6) AS speed FROM p WHERE p >= 0 GROUP BY l_returnflag",
)
def wave_speed(spark, sf_dir):
    s = _li(spark, sf_dir).select("l_returnflag", (1 + F.col("l_discount")).alias("rho"), (F.col("l_quantity") / 10).alias("mx"), (F.col("l_tax") * 10).alias("my"), (F.col("l_extendedprice") / 100).alias("e"))
    return rounded(s.groupBy("l_returnflag").agg(F.max(P.wave_speed(F.col("rho"), F.col("mx"), F.col("my"), F.col("e"))).alias("speed")))


