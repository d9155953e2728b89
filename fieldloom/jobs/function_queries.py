"""Registered queries of the column functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import physics as P
from fieldloom.jobs.tables import rounded, table
from fieldloom.operators import extra as X

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_PART = "p AS (SELECT p_partkey, sqrt(p_retailprice) AS e, p_size * 0.008::DOUBLE AS nu, p_partkey % 7 * 0.1::DOUBLE AS ex, p_partkey % 5 * 0.2::DOUBLE AS ey, p_partkey % 3 * 0.3::DOUBLE AS ez, p_partkey % 11 * 0.1::DOUBLE AS g1, p_partkey % 4 * 0.1::DOUBLE AS g2, p_partkey % 6 * 0.1::DOUBLE AS g3 FROM part)"


def _part(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.sqrt("p_retailprice").alias("e"), (F.col("p_size") * 0.008).alias("nu"), (k % 7 * 0.1).alias("ex"), (k % 5 * 0.2).alias("ey"), (k % 3 * 0.3).alias("ez"), (k % 11 * 0.1).alias("g1"), (k % 4 * 0.1).alias("g2"), (k % 6 * 0.1).alias("g3"))


@query("physics_moduli", f"WITH {_PART} SELECT p_partkey, round(e * nu / ((1 + nu) * (1 - 2 * nu)), 5) + 0.0 AS lame, round(e / (2 * (1 + nu)), 5) AS shear, round(e / (3 * (1 - 2 * nu)), 5) AS bulk FROM p")
def moduli(spark, sf_dir):
    e, nu = F.col("e"), F.col("nu")
    return rounded(_part(spark, sf_dir).select("p_partkey", P.lame_lambda(e, nu).alias("lame"), P.shear_modulus(e, nu).alias("shear"), P.bulk_modulus(e, nu).alias("bulk")), 5)


@query(
    "physics_hooke",
    f"""WITH {_PART}, f AS (SELECT *, e / (1 - nu * nu) AS a, e / ((1 + nu) * (1 - 2 * nu)) AS b FROM p)
 SELECT p_partkey, round(a * (ex + nu * ey), 5) + 0.0 AS s0, round(a * (nu * ex + ey), 5) + 0.0 AS s1, round(a * (1 - nu) / 2 * g1, 5) + 0.0 AS s2, round(b * ((1 - nu) * ex + nu * ey), 5) + 0.0 AS n0, round(b * (nu * ex + (1 - nu) * ey), 5) + 0.0 AS n1, round(b * (1 - 2 * nu) / 2 * g1, 5) + 0.0 AS n2,
 round(b * ((1 - nu) * ex + nu * (ey + ez)), 5) + 0.0 AS t0, round(b * ((1 - nu) * ey + nu * (ex + ez)), 5) + 0.0 AS t1, round(b * ((1 - nu) * ez + nu * (ex + ey)), 5) + 0.0 AS t2, round(b * (1 - 2 * nu) / 2 * g1, 5) + 0.0 AS t3, round(b * (1 - 2 * nu) / 2 * g2, 5) + 0.0 AS t4, round(b * (1 - 2 * nu) / 2 * g3, 5) + 0.0 AS t5 FROM f""",
)
def hooke(spark, sf_dir):
    c, e, nu = F.col, F.col("e"), F.col("nu")
    laws = {"s": P.hooke_stress([c("ex"), c("ey"), c("g1")], e, nu), "n": P.hooke_stress([c("ex"), c("ey"), c("g1")], e, nu, "plane_strain"), "t": P.hooke_stress([c(x) for x in ("ex", "ey", "ez", "g1", "g2", "g3")], e, nu, "3d")}
    return rounded(_part(spark, sf_dir).select("p_partkey", *[v.alias(f"{k}{i}") for k, law in laws.items() for i, v in enumerate(law)]), 5)


@query("physics_von_mises_6", f"WITH {_PART} SELECT p_partkey, round(sqrt(0.5 * ((ex - ey) ** 2 + (ey - ez) ** 2 + (ez - ex) ** 2) + 3 * (g1 * g1 + g2 * g2 + g3 * g3)), 6) AS stress FROM p")
def von_mises_6(spark, sf_dir):
    c = F.col
    return rounded(_part(spark, sf_dir).select("p_partkey", P.von_mises(c("ex"), c("ey"), c("g1"), c("ez"), c("g2"), c("g3")).alias("stress")))


@query(
    "physics_principal_3d",
    f"""WITH {_PART} SELECT p_partkey, true AS ordered, round(ex + ey + ez, 5) + 0.0 AS first_invariant, round(ex * ey + ey * ez + ez * ex - g1 * g1 - g2 * g2 - g3 * g3, 5) + 0.0 AS second_invariant,
 round(ex * ey * ez + 2 * g1 * g2 * g3 - ex * g2 * g2 - ey * g3 * g3 - ez * g1 * g1, 5) + 0.0 AS third_invariant FROM p""",
)
def principal_3d(spark, sf_dir):
    """The three principal stresses of each part through their invariants, which SQL has from the components."""
    c = F.col
    s = P.principal_stresses_3d(*[c(x) for x in ("ex", "ey", "ez", "g1", "g2", "g3")])
    r = _part(spark, sf_dir).select("p_partkey", *[v.alias(f"s{i}") for i, v in enumerate(s)])
    a, b, d = c("s0"), c("s1"), c("s2")
    return rounded(r.select("p_partkey", ((a >= b - 1e-9) & (b >= d - 1e-9)).alias("ordered"), (a + b + d).alias("first_invariant"), (a * b + b * d + d * a).alias("second_invariant"), (a * b * d).alias("third_invariant")), 5)


@query("physics_principal_2d", f"WITH {_PART} SELECT p_partkey, round((ex + ey) / 2 + sqrt(((ex - ey) / 2) ** 2 + g1 * g1), 6) + 0.0 AS high, round((ex + ey) / 2 - sqrt(((ex - ey) / 2) ** 2 + g1 * g1), 6) + 0.0 AS low, round(0.5 * atan2(2 * g1, ex - ey), 6) + 0.0 AS angle FROM p")
def principal_2d(spark, sf_dir):
    hi, lo, angle = P.principal_stresses(F.col("ex"), F.col("ey"), F.col("g1"))
    return rounded(_part(spark, sf_dir).select("p_partkey", hi.alias("high"), lo.alias("low"), angle.alias("angle")))


@query(
    "physics_thermal",
    """WITH c AS (SELECT c_custkey, 300 + c_acctbal / 100 AS t, 290.0 + c_custkey % 20 AS a, 0.1 + c_nationkey * 0.03 AS em, 1 + c_custkey % 9 AS k FROM customer)
 SELECT c_custkey, round(em * 5.67e-8 * (t ** 4 - a ** 4), 5) + 0.0 AS flux, round(4 * em * 5.67e-8 * ((t + a) / 2) ** 3, 6) AS coefficient, round((t - a) / (k * 0.1), 5) + 0.0 AS contact, round(k / (7.5 * (2 + k)), 7) AS diffusivity FROM c""",
)
def thermal(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", (300 + F.col("c_acctbal") / 100).alias("t"), (290.0 + k % 20).alias("a"), (0.1 + F.col("c_nationkey") * 0.03).alias("em"), (1 + k % 9).alias("k"))
    t, a, em, n = F.col("t"), F.col("a"), F.col("em"), F.col("k")
    return c.select("c_custkey", *[(F.round(v, d) + F.lit(0.0)).alias(name) for name, v, d in (("flux", P.radiative_flux(t, a, em), 5), ("coefficient", P.radiation_coefficient(t, a, em), 6), ("contact", P.contact_flux(t, a, n * 0.1), 5), ("diffusivity", P.thermal_diffusivity(n, F.lit(7.5), 2 + n), 7))])


@query(
    "physics_fluid",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 + l_discount AS rho, l_quantity / 10.123457::DOUBLE AS mx, l_tax * 10.123457::DOUBLE AS my, l_extendedprice / 100 + 500 AS e FROM lineitem), p AS (SELECT *, 0.4 * (e - 0.5 * (mx * mx + my * my) / rho) AS p FROM s)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mx, 6) AS fx0, round(mx * mx / rho + p, 5) AS fx1, round(my * mx / rho, 6) AS fx2, round((e + p) * mx / rho, 4) AS fx3, round(my, 6) AS fy0, round(mx * my / rho, 6) AS fy1, round(my * my / rho + p, 5) AS fy2, round((e + p) * my / rho, 4) AS fy3,
 round(sqrt(1.4 * p / rho), 6) AS sound, round(0.02 / rho, 8) AS viscosity, round(rho * mx * 2.5 / 0.02, 4) AS reynolds, round((p - 100) / (0.5 * 1.2 * 30.0 ** 2), 6) + 0.0 AS pressure_coefficient FROM p""",
)
def fluid(spark, sf_dir):
    c = F.col
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1 + c("l_discount")).alias("rho"), (c("l_quantity") / 10.123457).alias("mx"), (c("l_tax") * 10.123457).alias("my"), (c("l_extendedprice") / 100 + 500).alias("e"))
    rho, mx, my, e = c("rho"), c("mx"), c("my"), c("e")
    p = P.euler_pressure(rho, mx, my, e)
    cols = {f"f{'xy'[d]}{i}": v for d in (0, 1) for i, v in enumerate(P.euler_flux(rho, mx, my, e, d))}
    cols |= {"sound": P.sound_speed(p, rho), "viscosity": P.kinematic_viscosity(F.lit(0.02), rho), "reynolds": P.reynolds_number(rho, mx, F.lit(2.5), F.lit(0.02)), "pressure_coefficient": P.pressure_coefficient(p, 100.0, 1.2, 30.0)}
    digits = {"fx1": 5, "fx3": 4, "fy2": 5, "fy3": 4, "viscosity": 8, "reynolds": 4}
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[(F.round(v, digits.get(k, 6)) + F.lit(0.0)).alias(k) for k, v in cols.items()])


@query("array_conserve_sum", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), y AS (SELECT vec_id, x, [v * 0.5 FOR v IN list_reverse(x)] AS y FROM e) SELECT vec_id, round(y[1] + (list_sum(x) - list_sum(y)) / len(y), 6) + 0.0 AS head, round(y[10] + (list_sum(x) - list_sum(y)) / len(y), 6) + 0.0 AS tenth, round(list_sum(x), 5) + 0.0 AS total FROM y")
def conserve(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    y = P.conserve_sum(x, F.transform(F.reverse(x), lambda v: v * 0.5))
    e = table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y"))
    return e.select("vec_id", *[(F.round(v, d) + F.lit(0.0)).alias(n) for n, v, d in (("head", F.col("y")[0], 6), ("tenth", F.col("y")[9], 6), ("total", F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 5))])


@query("state_materials", "WITH m AS (SELECT * FROM (VALUES ('steel', 0.3::DOUBLE, 7850.0::DOUBLE, 500.0::DOUBLE, NULL::DOUBLE), ('air', NULL, 1.2, 1005.0, 1.8e-5), ('glycerin', NULL, 1260.0, NULL, 1.5)) t(name, poisson, density, heat_capacity, viscosity)), p AS (SELECT ['steel', 'air', 'glycerin'][CAST(p_partkey % 3 + 1 AS BIGINT)] AS name, p_size FROM part) SELECT name, count(*) AS n, round(sum(p_size * density), 4) AS mass, round(any_value(poisson), 4) AS poisson, round(any_value(heat_capacity), 4) AS heat_capacity, round(any_value(viscosity), 8) AS viscosity FROM p JOIN m USING (name) GROUP BY name")
def materials(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("steel", "air", "glycerin")])
    p = table(spark, sf_dir, "part").select(F.get(names, (F.col("p_partkey") % 3).cast("int")).alias("name"), "p_size")
    g = p.join(F.broadcast(X.materials(spark)), "name").groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("p_size") * F.col("density")).alias("mass"), *[F.max(c).alias(c) for c in ("poisson", "heat_capacity", "viscosity")])  # some ten rows are broadcast
    return g.select("name", "n", F.round("mass", 4).alias("mass"), F.round("poisson", 4).alias("poisson"), F.round("heat_capacity", 4).alias("heat_capacity"), F.round("viscosity", 8).alias("viscosity"))
