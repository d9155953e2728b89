"""Operators without SQL against NumPy, analytic answers and invariants."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph as G
from fieldloom.operators import mesh as M
from fieldloom.operators import regress as E
from fieldloom.operators import rom as R
from fieldloom.operators import spatial as S
from fieldloom.operators import surrogate as C
from fieldloom.operators.fields import stiffness
from fieldloom.operators.graph_components import connected_components
from fieldloom.sources import generate as N
from fieldloom.sources import io as IO


def packed(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "dof long, xs array<double>").repartition(3)


def test_gram_and_modes(spark):
    x = np.random.default_rng(0).normal(size=(60, 3)) @ np.random.default_rng(1).normal(size=(3, 7))
    c = x - x.mean(1, keepdims=True)
    assert np.allclose(R.to_matrix(R.gram(packed(spark, x))), c.T @ c)
    pod = R.pod_fit(packed(spark, x))
    assert len(pod.sigma) == 3 and np.allclose(pod.sigma, np.linalg.svd(c, compute_uv=False)[:3])
    err = R.pod_error(packed(spark, x), pod).first()
    assert err.relative_l2 < 1e-8 and R.subspace_distance(pod.modes, pod.modes) < 1e-6
    pts = R.deim_points(pod.modes, 3)
    assert len(set(pts)) == 3
    lev = R.leverage_sample(pod.modes, 10, seed=1).collect()
    assert [r.dof for r in lev] == [r.dof for r in R.leverage_sample(pod.modes.repartition(5), 10, seed=1).collect()]


def test_dmd_recovers_a_linear_system(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(40, 4)))
    b = np.diag([0.95, 0.8, 0.6, 0.4]) + np.diag([0.1, 0.0, 0.05], 1)
    z = [rng.normal(size=4)]
    for _ in range(11):
        z.append(b @ z[-1])
    x = q @ np.array(z).T
    dmd = R.dmd_fit(packed(spark, x), rank=4)
    assert np.allclose(np.sort(dmd.eigenvalues.real), [0.4, 0.6, 0.8, 0.95], atol=1e-5)
    got = {(r.dof, r.step): r.value for r in R.dmd_predict(dmd, [0, 5, 11]).collect()}
    assert all(abs(got[(i, k)] - x[i, k]) < 1e-5 for i in range(40) for k in (0, 5, 11))


def test_sindy_finds_four_terms(spark):
    a, (x, y), rows = np.array([[-0.1, 2.0], [-2.0, -0.1]]), (2.0, 0.0), []
    for k in range(500):
        dx, dy = a @ (x, y)
        rows.append((k, float(x), float(y), float(dx), float(dy)))
        w = np.array([x, y]) + 0.01 * np.array([dx, dy])
        x, y = w
    df = spark.createDataFrame([*rows, (501, None, 1.0, 1.0, 1.0), (502, float("nan"), 1.0, 1.0, 1.0)], "k long, x double, y double, dx double, dy double")
    for how in ("stlsq", "sr3"):
        c, r2 = E.sindy_fit(df, E.library(["x", "y"]), ["dx", "dy"], threshold=0.05, optimizer=how)
        assert np.count_nonzero(c) == 4
        if how == "stlsq":
            assert np.allclose(c[1:3].T, a, atol=1e-8) and np.allclose(r2, 1)
    lasso, _ = E.sindy_fit(df, E.library(["x", "y"], 1), ["dx"], optimizer="lasso", alpha=1e-6)
    assert np.allclose(lasso[1:3, 0], a[0], atol=1e-4)


def test_pde_find_two_modes(spark):
    t, x = np.linspace(0, 0.5, 101), np.linspace(0, np.pi, 101)
    u = np.exp(-t)[:, None] * np.sin(x) + np.exp(-4 * t)[:, None] * np.sin(2 * x)
    grid = spark.createDataFrame([(i, j, float(t[i]), float(x[j]), float(u[i, j])) for i in range(101) for j in range(101)], "it int, ix int, t double, x double, u double")
    d = E.derivative(grid, "u", "t", ["ix"], "u_t")
    for k, (a, b) in enumerate((("u", "u_x"), ("u_x", "u_xx"))):
        d = E.derivative(d, a, "x", ["it"], b)
    inner = d.where("it between 5 and 95 and ix between 5 and 95")
    terms = E.pde_library(["u", "u_x", "u_xx"], order=1)
    c, _ = E.sindy_fit(inner, [t for t in dict(terms).items()][:4], ["u_t"], threshold=0.2)
    assert abs(c[3, 0] - 1) < 0.05 and np.count_nonzero(c) == 1


def test_gaussian_process(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 2))
    y = np.sin(x[:, 0])
    train = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "p array<double>, y double")
    got = C.gp_predict(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, p array<double>"), train).collect()
    assert max(abs(r.mean - y[r.id]) for r in got) < 1e-3 and max(r.std for r in got) < 0.01
    scored = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(5)] + [(9, 0.1, 0.0, 2.0)], "id long, x double, y double, score double")
    assert C.diverse_batch(scored, 2, ["x", "y"])[0] == 9


def test_rbf_is_exact_on_linear_fields(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(size=(80, 2))
    pts = spark.createDataFrame([(i, r.tolist(), float(2 * r[0] - 3 * r[1])) for i, r in enumerate(p)], "id long, p array<double>, value double")
    q = spark.createDataFrame([(100, [0.4, 0.6]), (101, [0.5, 0.1])], "id long, p array<double>")
    got = {r.id: r.value for r in S.rbf_interpolate(pts, pts, q).collect()}
    assert abs(got[100] - (0.8 - 1.8)) < 1e-8 and abs(got[101] - (1.0 - 0.3)) < 1e-8


def test_knn_degenerate_points(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)] + [(9, None)], "id long, p array<double>")
    got = S.knn_join(same, same, 2).collect()
    assert {(r.id, r.rank, r.other) for r in got if r.id == 0} == {(0, 1, 1), (0, 2, 2)} and all(r.id != 9 for r in got)
    empty = same.limit(0)
    assert S.knn_join(empty, empty, 3).count() == 0
    assert S.knn_join(same.limit(1), same.limit(1), 3).count() == 0


def test_knn_query_far_outside(spark):
    b = spark.createDataFrame([(i, [float(i % 3), float(i // 3)]) for i in range(9)], "id long, p array<double>")
    a = spark.createDataFrame([(100, [50.0, 60.0]), (101, [-400.0, 1.0]), (102, [1.1, 1.0]), (103, [float("nan"), 1.0])], "id long, p array<double>")
    got = {(r.id, r["rank"]): r.other for r in S.knn_join(a, b, 3, exclude_self=False).collect()}
    assert [got.get((100, j)) for j in (1, 2, 3)] == [8, 7, 5]
    assert [got.get((101, j)) for j in (1, 2, 3)] == [3, 0, 6]
    assert got.get((102, 1)) == 4


def test_structured_grids(spark):
    for dim, kind in ((1, "line"), (2, "quad"), (3, "hex")):
        pts, cells = N.structured_grid(spark, [(0, 1)] * dim, [4] * dim)
        assert pts.count() == 5**dim and cells.count() == 4**dim and cells.first().cell_type == kind
        fat = M.fat_cells(cells, pts)
        total = fat.select(M.volume().alias("v")).agg(F.sum("v")).first()[0]
        assert abs(total - 1) < 1e-12
    pts, cells = N.structured_grid(spark, [(0, 1), (0, 1)], [4, 4])
    assert M.boundary_faces(cells).count() == 16 and M.boundary_points(cells).count() == 16
    centres, nbr = N.cartesian_cells(spark, [(0, 1), (0, 1)], [3, 3])
    assert centres.count() == 9 and nbr.count() == 24
    assert M.fat_cells(cells.limit(0), pts).count() == 0


def test_stiffness_invariants_and_linear_field(spark):
    pts, quads = N.structured_grid(spark, [(0, 2), (0, 1)], [5, 4])
    pts = pts.withColumn("u", 2 * F.col("x") - 3 * F.col("y"))
    n = F.col("nodes")
    tri = quads.select("mesh", F.posexplode(F.array(F.array(n[0], n[1], n[2]), F.array(n[0], n[2], n[3]))).alias("k", "nodes"), "cell_id").select("mesh", (2 * F.col("cell_id") + F.col("k")).alias("cell_id"), F.lit("triangle").alias("cell_type"), "nodes")
    fat = M.fat_cells(tri, pts, ("u",))
    assert all(abs(r.gx - 2) < 1e-9 and abs(r.gy + 3) < 1e-9 for r in M.element_gradient(fat).collect())
    assert M.zz_error(fat).agg(F.max("error")).first()[0] < 1e-9
    k = {(r.row, r.col): r.value for r in stiffness(fat).collect()}
    assert all(abs(v - k[(j, i)]) < 1e-12 for (i, j), v in k.items())
    assert all(abs(sum(v for (i, _), v in k.items() if i == row)) < 1e-12 for row in range(30))
    new, four = M.refine_triangles(tri, pts)
    assert four.count() == 4 * tri.count() and new.count() == M.mesh_edges(tri).count()


def test_sampling_is_partition_free(spark):
    inside = F.col("x") ** 2 + F.col("y") ** 2 <= 1
    a = [tuple(r) for r in N.sample_domain(spark, [(-1, 1), (-1, 1)], inside, 100, seed=5).collect()]
    assert len(a) == 100 and all(r[1] ** 2 + r[2] ** 2 <= 1 for r in a)
    h = [r.x for r in N.halton_points(spark, [(0, 1)], 8).orderBy("sample_id").collect()]
    assert h == [0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875, 0.0625]
    assert N.tensor_grid(spark, [[(0, 1), (1, 2)], [(5, 3)]]).agg(F.sum("w")).first()[0] == 9


def test_matching_is_maximal(spark):
    rng = np.random.default_rng(6)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2)) if a < b}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double")
    got = G.match_pool(edges).collect()
    part = {}
    for r in got:
        part.setdefault(r.part, []).append(r.id)
    used = {i for p in part.values() for i in p}
    assert len(used) == len(got) and all(len(p) == 2 and tuple(sorted(p)) in e for p in part.values())
    assert all(a in used or b in used for a, b in e)


def test_components_of_paths_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 200)] + [(None, 3), (500, 500)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 300)} == {100} and got[500] == 500
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 17])
def test_partitions_do_not_depend_on_spark(spark, n):
    rng = np.random.default_rng(7)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(size=(200, 2)))], "id long, x double, y double").repartition(n)
    m = {r.id: r.part for r in G.morton_partition(pts, 4).collect()}
    assert sorted(np.bincount(list(m.values()))) == [50] * 4
    k = {r.id: r.part for r in G.kdtree_partition(pts, 4, longest=True).collect()}
    assert sorted(np.bincount(list(k.values()))) == [50] * 4


def test_results_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("a", "ok", 1e-9, 5, 0.1, IO.metadata_json({"k": 1}))], "run_id string, status string, residual double, iterations int, solve_time double, metadata string")
    fields = spark.createDataFrame([("a", "u", i, 0, float(i)) for i in range(5)], "run_id string, field string, point_id long, component int, value double")
    IO.save_results(runs, fields, f"{tmp_path}/r")
    assert IO.load_results(spark, f"{tmp_path}/r").where("field = 'u'").count() == 5
    buf = io.BytesIO()
    np.savez(buf, field_u_values=np.arange(6.0).reshape(3, 2), field_u_points=np.zeros((3, 2)), metadata=np.array([1]))
    (tmp_path / "x.npz").write_bytes(buf.getvalue())
    got = IO.read_npz_results(spark, f"{tmp_path}/*.npz").collect()
    assert len(got) == 6 and {r.run_id for r in got} == {"x"}


def test_streaming_dmd(spark, tmp_path):
    from fieldloom.streaming.incremental import rocksdb, streaming_dmd

    a, x, rows = np.array([[0.9, 0.2], [-0.2, 0.9]]), np.array([1.0, 0.5]), []
    for k in range(60):
        rows.append(("r", k, x.tolist()))
        x = a @ x
    df = spark.createDataFrame([*rows, ("r", 3, [9.0, 9.0])], "run_id string, step long, x array<double>")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    with rocksdb(spark):
        q = streaming_dmd(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    last = seen[-1]
    assert last.late == 1 and np.allclose(sorted(last.im), [-0.2, 0.2], atol=1e-3) and np.allclose(last.re, 0.9, atol=1e-3)


def test_grouped_and_kernel_modes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(i, f"k{i % 2}", 2.0, r.tolist()) for i, r in enumerate(x)], "dof long, key string, w double, xs array<double>").repartition(3)
    got = {(r.key, r.mode): r.sigma for r in R.pod_per_group(df, "key", 3, "w").collect()}
    for k in (0, 1):
        y = x[k::2] - x[k::2].mean(1, keepdims=True)
        assert np.allclose([got[(f"k{k}", m)] for m in range(3)], np.linalg.svd(np.sqrt(2) * y, compute_uv=False)[:3])
    z, b = [rng.normal(size=3)], np.diag([0.9, 0.7, 0.5])
    for _ in range(8):
        z.append(b @ z[-1])
    lam = R.kernel_dmd_eigenvalues(packed(spark, np.array(z).T), rank=3, reg=1e-12)
    assert np.allclose(np.sort(lam.real), [0.5, 0.7, 0.9], atol=1e-3)
    pairs = spark.createDataFrame([(*map(float, p), *map(float, q)) for p, q in zip(z[:-1], z[1:])], "a double, b double, c double, d double, e double, f double")
    k = R.koopman_fit(pairs, [F.col(c) for c in "abc"], [F.col(c) for c in "def"])
    assert np.allclose(k.eigenvalues.real, [0.9, 0.7, 0.5], atol=1e-6) and k.error < 1e-6


def test_weak_form_and_constraints(spark):
    t = np.linspace(0, 5, 2001)
    df = spark.createDataFrame([(float(a), float(np.exp(-0.5 * a))) for a in t], "t double, x double")
    c = E.weak_sindy(df, [("1", F.lit(1.0)), ("x", F.col("x"))], "x", "t", threshold=0.05)
    assert abs(c[1] + 0.5) < 1e-3 and c[0] == 0
    assert np.allclose(E.sindy_constrained(np.array([1.0, 0.8]), np.array([[1.0, -1.0]]), np.array([0.0]), 0.1), [0.9, 0.9])


def test_density_update_heat_hierarchy_and_chains(spark):
    from fieldloom.operators import extra as X
    from fieldloom.operators import uq as U

    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([(i, 0.5, -float(v), 1.0) for i, v in enumerate(rng.uniform(0.1, 5, 300))], "id long, rho double, dc double, volume double")
    new = X.oc_update(cells, 0.5).toPandas()
    assert abs(new.rho.mean() - 0.5) < 0.01 and new.rho.between(0.3 - 1e-9, 0.7 + 1e-9).all()
    e = [(i, i + 1, 1.0) for i in range(19)] + [(0, 19, 1.0)]
    edges = spark.createDataFrame(e, "src long, dst long, weight double")
    a = np.zeros((20, 20))
    for i, j, _ in e:
        a[i, j] = a[j, i] = 0.5
    f = rng.normal(size=20)
    w, v = np.linalg.eigh(np.eye(20) - a)
    got = {r.row: r.value for r in X.heat_diffuse(G.laplacian(edges), spark.createDataFrame([(i, float(x)) for i, x in enumerate(f)], "row long, value double"), 0.7).collect()}
    assert np.allclose([got[i] for i in range(20)], v @ (np.exp(-0.7 * w) * (v.T @ f)), atol=1e-6)
    levels = X.build_hierarchy(edges, 2, least=5)
    assert len(levels) == 2 and levels[0].count() == 20 and 10 <= levels[0].select("part").distinct().count() <= 13  # a maximal matching of a ring
    p = spark.createDataFrame([("a", 50, 50 * 1.5, 50 * 1.5**2 + 50.0)], "key string, n long, total double, square double")
    s = X.posterior_summary(X.mcmc_chains(p, 4, 2000, 2.0), 200).first()
    assert abs(s["mean"] - 1.5) < 0.05 and 0.05 < s["std"] < 0.3
    pred = U.fidelity_selector(spark.createDataFrame([(k, float(np.exp(-2.0 * k + 0.5 * x)), float(x)) for k in range(3) for x in range(5)], "level int, error double, x double"), ["x"], 3)
    rows = U.select_fidelity(spark.createDataFrame([(1, 0.0), (2, 4.0)], "id long, x double"), pred, [1.0, 5.0, 20.0], 0.2).collect()
    assert [(r.level, r.saved) for r in sorted(rows)] == [(1, 15.0), (2, 0.0)]
