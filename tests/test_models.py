"""Operators of orders, systems, bases, spectra, discovery, sampling and streams against NumPy and plain loops."""

import io
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import discovery as V
from fieldloom.operators import extra as X
from fieldloom.operators import fields as A
from fieldloom.operators import graph as G
from fieldloom.operators import matrix as K
from fieldloom.operators import mesh as M
from fieldloom.operators import order as O
from fieldloom.operators import regress as E
from fieldloom.operators import rom as R
from fieldloom.operators import spatial as S
from fieldloom.operators import spectral as Z
from fieldloom.operators import surrogate as C
from fieldloom.operators import uq as U
from fieldloom.sources import generate as N
from fieldloom.sources import io as IO


def packed(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "dof long, xs array<double>").repartition(3)


def dense(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder():
    from fieldloom.sources.scratch import shared_folder

    conf = SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    conf = SimpleNamespace(get=lambda k, d=None: "hdfs:///shared/" if k == "spark.checkpoint.dir" else None)
    assert shared_folder(SimpleNamespace(conf=conf)) == "hdfs:///shared"


def test_quantiles_running_moments_and_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 4, 3000), np.round(rng.normal(size=3000), 2)))] + [(9, 5000 + i, 1.5) for i in range(2000)] + [(None, 9000, 2.0), (7, 9001, None)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(7)
    got = {r.k: r for r in O.quantiles(df, "v", [0.0, 0.025, 0.5, 1.0], ["k"]).collect()}
    by = {}
    for k, _, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        assert np.allclose([got[k][f"q{j}"] for j in range(4)], np.quantile(v, [0.0, 0.025, 0.5, 1.0])) and got[k].n == len(v)
    assert O.quantiles(df.limit(0), "v", [0.5]).count() == 0
    run = dense(O.running_moments(df, "k", "i", "v").collect(), "k", "i")
    for k in {r[0] for r in rows}:
        v = [(i, x) for kk, i, x in rows if kk == k]
        for n, (i, _) in enumerate(sorted(v), 1):
            x = [y for _, y in sorted(v)[:n] if y is not None]
            r = run[(k, i)]
            if n % 97 == 1 or n == len(v):
                assert r.n == len(x) and (not x or (abs(r["mean"] - np.mean(x)) < 1e-9 and abs(r["var"] - np.var(x)) < 1e-9))
    nxt = dense(O.next_rows(df, "k", ["i"], ["v"], back=True).collect(), "k", "i")
    for k in {r[0] for r in rows}:
        v = sorted((i, x) for kk, i, x in rows if kk == k)
        for (i, _), (j, x) in zip(v, v[1:]):
            assert nxt[(k, i)].next_v == x and nxt[(k, j)].prev_v == dict(v)[i]
        assert nxt[(k, v[-1][0])].next_v is None and nxt[(k, v[0][0])].prev_v is None


@pytest.mark.parametrize("d", [2, 3])
def test_knn_matches_brute_force_on_skewed_points(spark, monkeypatch, d):
    """A dense cluster, repeats beyond a block, one far outlier and queries outside the box."""
    monkeypatch.setattr(S, "BLOCK", 40)
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(size=(400, d)) * 1e-3, rng.uniform(-1, 1, (150, d)), np.full((90, d), 0.5), [[1e9] * d]])
    q = np.vstack([p[::7], [[-3e9] * d], rng.uniform(-2, 2, (20, d))])
    frame = lambda x, at: spark.createDataFrame([(at + i, r.tolist()) for i, r in enumerate(x)] + [(at + 90_000, None), (at + 90_001, [float("nan")] * d)], "id long, p array<double>")
    got = {}
    for r in S.knn_join(frame(q, 10_000), frame(p, 0), 5, d, exclude_self=False).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.other
    for i, x in enumerate(q):
        dist = np.sqrt(((p - x) ** 2).sum(1))
        assert [got[10_000 + i][k] for k in range(1, 6)] == np.lexsort((np.arange(len(p)), dist))[:5].tolist()
    assert len(got) == len(q)
    own = S.knn_join(frame(p, 0), frame(p, 0), 3, d).where("id = 640").collect()
    assert len(own) == 3 and all(r.other != 640 for r in own)


def test_knn_with_an_outlier_stays_linear(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.uniform(size=(20_000, 2)), [[1e9, 1e9]]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(p)], "id long, p array<double>").cache()
    start = time.perf_counter()
    assert S.knn_join(df, df, 4).count() == 4 * len(p)
    assert time.perf_counter() - start < 60


def test_blocks_of_a_small_side(spark, monkeypatch):
    small = spark.createDataFrame([([i * 0.1, 0.0], float(i)) for i in range(50)], "p array<double>, residual double")
    query = spark.createDataFrame([(i, [i * 0.3, 0.1]) for i in range(20)], "id long, p array<double>")
    want = {r.id: r.correction for r in S.kernel_correct(query, small).collect()}
    monkeypatch.setattr(S, "in_blocks", lambda t, rows=7: [F.broadcast(x) for x in [t.where(F.pmod(F.xxhash64(*t.columns), F.lit(8)) == k) for k in range(8)]])
    got = {r.id: r.correction for r in S.kernel_correct(query, small).collect()}
    assert all(abs(got[i] - v) < 1e-9 for i, v in want.items()) and len(got) == 20


def test_element_matrices_and_norms(spark):
    pts = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1)])], "mesh long, point_id long, x double, y double, z double")
    cells = spark.createDataFrame([(0, 0, "quad", [0, 1, 2, 3]), (0, 1, "tet", [0, 1, 3, 4])], "mesh long, cell_id long, cell_type string, nodes array<long>")
    fat = M.fat_cells(cells, pts)

    def full(kind, what):
        a = np.zeros((5, 5))
        for r in K.assemble_matrix(fat.where(F.col("cell_type") == kind), what).collect():
            a[r.row, r.col] = r.value
        return a

    k = full("quad", "stiffness")[:4, :4]
    assert np.allclose(k, np.array([[4, -1, -2, -1], [-1, 4, -1, -2], [-2, -1, 4, -1], [-1, -2, -1, 4]]) / 6)
    m = full("quad", "mass")[:4, :4]
    assert np.allclose(m, np.array([[4, 2, 1, 2], [2, 4, 2, 1], [1, 2, 4, 2], [2, 1, 2, 4]]) / 36)
    t = full("tet", "stiffness")[np.ix_([0, 1, 3, 4], [0, 1, 3, 4])]
    assert np.allclose(t, np.array([[3, -1, -1, -1], [-1, 1, 0, 0], [-1, 0, 1, 0], [-1, 0, 0, 1]]) / 6)
    assert np.isclose(full("tet", "mass").sum(), 1 / 6) and np.isclose(full("tet", "mass")[0, 0], 1 / 60)
    assert K.assemble_matrix(fat.limit(0)).count() == 0
    matrix = spark.createDataFrame([(0, 0, 2.0), (0, 1, -1.0), (1, 1, 3.0)], "row long, col long, value double")
    vec = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "row long, value double")
    n = K.residual_norms(matrix, vec([1, 2]), vec([1, 4, 2])).first()
    assert np.isclose(n.residual_norm, np.sqrt(1 + 4 + 4) / np.sqrt(21)) and n.conservation_error == 5
    assert {r.row: r.residual for r in K.pointwise_residual(matrix, vec([1, 2]), vec([1, 4, 2])).collect()} == {0: 1.0, 1: 2.0, 2: 2.0}
    assert np.isclose(K.energy_norm(matrix, vec([1, 2])).first()[0], np.sqrt(12))


def test_laplacian_weights_of_scattered_points(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(size=(150, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(p)], "id long, p array<double>")
    f = (p**2).sum(1) + p[:, 0] * p[:, 1] - p[:, 2] + 1
    out = np.zeros(150)
    for r in S.rbf_fd_weights(df, 25, 3).collect():
        out[r.id] += r.weight * f[r.other]
    assert np.allclose(out, 6, atol=1e-5)


def test_tags_boundaries_and_sources(spark):
    pts, cells = N.structured_grid(spark, [(0, 1), (0, 1)], [5, 5])
    b = M.boundary_points(cells)
    left = M.tag_boundary(pts, b, "left", F.col("x") < 1e-9)
    assert M.get_boundary(left, "left").count() == 6
    with pytest.raises(KeyError):
        M.get_boundary(left, "nowhere")
    faces = N.box_boundary_points(spark, [(0, 1), (2, 4), (-1, 1)], 3).collect()
    assert len(faces) == 54 and {(r.x, r.y, r.z) for r in faces} == {(x, y, z) for x in (0, 0.5, 1) for y in (2, 3, 4) for z in (-1, 0, 1) if x in (0, 1) or y in (2, 4) or z in (-1, 1)}
    assert [r.x for r in N.box_boundary_points(spark, [(2, 5)], 4).collect()] == [2.0, 5.0]
    s = N.parameter_samples(spark, [(0, 1), (5, 6)], 200, seed=3)
    a = np.array([r.p for r in s.collect()])
    assert a.shape == (200, 2) and (a[:, 1] >= 5).all() and abs(a[:, 0].mean() - 0.5) < 0.08 and (a == np.array([r.p for r in N.parameter_samples(spark, [(0, 1), (5, 6)], 200, seed=3).repartition(5).orderBy("sample_id").collect()])).all()
    rows = A.boundary_values(pts, [("dirichlet", F.col("x") < 1e-9, {"value": lambda t: 100 + t}), ("convection", F.col("y") < 1e-9, {"h": 10.0, "ambient": 25.0})], 1.0).collect()
    assert len(rows) == 11 and {(r.kind, r.alpha, r.beta, r.g) for r in rows} == {("dirichlet", 1.0, 0.0, 101.0), ("convection", 10.0, 1.0, 250.0)}


def test_bases_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 9)) + 0.01 * rng.normal(size=(50, 9))
    c, w = x - x.mean(1, keepdims=True), rng.uniform(1, 2, 50)
    df = packed(spark, x).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "dof long, w double"), "dof")
    phi = lambda m: np.array([r.phi for r in sorted(m.collect(), key=lambda r: r.dof)])
    pod = R.pod_fit(df, n_modes=3, weight="w")
    f = phi(pod.modes)
    assert np.allclose(pod.sigma, np.linalg.svd(np.sqrt(w)[:, None] * c, compute_uv=False)[:3]) and np.allclose(f.T @ (w[:, None] * f), np.eye(3), atol=1e-9)
    a = np.diag(w) + np.diag(np.full(49, 0.1), 1) + np.diag(np.full(49, 0.1), -1)
    matrix = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, col long, value double")
    full = R.pod_fit_matrix(df, matrix, 3)
    f = phi(full.modes)
    assert np.allclose(f.T @ a @ f, np.eye(3), atol=1e-9) and np.allclose(full.sigma**2, np.linalg.eigvalsh(c.T @ a @ c)[::-1][:3])
    rand = R.pod_randomized(packed(spark, x), 3, 4)
    exact = R.pod_fit(packed(spark, x), n_modes=3)
    assert np.allclose(rand.sigma, exact.sigma, rtol=1e-8) and R.subspace_distance(rand.modes, exact.modes) < 1e-5
    assert np.allclose(phi(rand.modes) @ rand.temporal, phi(exact.modes) @ exact.temporal, atol=1e-6)
    states = spark.createDataFrame([(s, i, float(x[i, s])) for s in range(9) for i in range(50)], "state long, dof long, value double")
    coefs = R.pod_project(states, exact.modes)
    t = np.zeros((3, 9))
    for r in coefs.collect():
        t[r.mode, r.state] = r.coef
    assert np.allclose(t, exact.temporal, atol=1e-9)
    back = dense(R.pod_reconstruct(coefs, exact.modes).collect(), "state", "dof")
    assert max(abs(back[(s, i)].value - (x.mean(1)[i] + (phi(exact.modes) @ t)[i, s])) for s in range(9) for i in range(50)) < 1e-9
    keyed = df.withColumn("key", F.col("dof") % 2)
    for k in (0, 1):
        got = phi(R.pod_modes_by(keyed, "key", 2).where(F.col("key") == k))
        u = np.linalg.svd(c[k::2], full_matrices=False)[0][:, :2]
        assert np.allclose(np.abs(got.T @ u), np.eye(2), atol=1e-8)
    fields = keyed.select(F.when(F.col("key") == 0, "u").otherwise("v").alias("field"), "dof", "xs")
    both = R.multifield_pod(fields, 3)
    assert both.columns == ["field", "dof", "mean", "phi"] and np.allclose(np.abs(phi(both).T @ phi(exact.modes)), np.eye(3), atol=1e-7)
    assert set(R.qdeim_points(exact.modes, 3)) and len(set(R.qdeim_points(exact.modes, 3))) == 3
    points, u = [], phi(exact.modes)
    rest = u.copy()
    for _ in range(3):
        points.append(int(np.round((rest**2).sum(1), 12).argmax()))
        v = rest[points[-1]] / np.linalg.norm(rest[points[-1]])
        rest = rest - np.outer(rest @ v, v)
    assert R.qdeim_points(exact.modes, 3) == points
    assert np.isclose(R.interpolation_error(exact.modes, points, 3), np.linalg.norm(np.linalg.inv(u[points]), 2))
    assert len(set(R.gnat_points(exact.modes, rand.modes, 4))) == 4


def test_interpolated_bases(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(30, 4)))[0]
    turn = lambda s: np.column_stack([np.cos(s) * q[:, 0] + np.sin(s) * q[:, 1], np.cos(s) * q[:, 2] + np.sin(s) * q[:, 3]])
    params = [0.0, 0.2, 0.4, 0.6]
    bases = spark.createDataFrame([(i, k, b[i].tolist()) for k, s in enumerate(params) for b in [turn(s)] for i in range(30)], "dof long, basis int, phi array<double>")
    ref = lambda s: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(turn(s))], "dof long, phi array<double>")
    for method, tol in (("grassmann", 0.12), ("karcher", 0.12), ("idw", 0.15), ("rbf", 0.02), ("spline", 0.02)):
        got = R.interpolate_basis(bases, params, 0.3, method)
        f = np.array([r.phi for r in sorted(got.collect())])
        assert np.allclose(f.T @ f, np.eye(2), atol=1e-8) and R.subspace_distance(got, ref(0.3)) < tol
        assert R.subspace_distance(R.interpolate_basis(bases, params, 0.2, method), ref(0.2)) < 1e-4


def test_dynamics_levels_posterior_and_lifting(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 3)) @ np.array([[0.9**k, (-0.5) ** k, np.cos(k)] for k in range(16)]).T

    def level(y, rank):
        u, s, vt = np.linalg.svd(y[:, :-1], full_matrices=False)
        k = min(rank, int((s > 1e-7 * s[0]).sum()))
        u, s, vt = u[:, :k], s[:k], vt[:k]
        lam, v = np.linalg.eig(u.T @ y[:, 1:] @ vt.T / s)
        modes = y[:, 1:] @ vt.T / s @ v / lam
        b = np.linalg.lstsq(modes, y[:, 0].astype(complex), rcond=None)[0]
        return (modes * b @ (lam[:, None] ** np.arange(y.shape[1]))).real

    total, rest = np.zeros_like(x), x
    for k in range(2):
        fit = level(rest, 2)
        total += fit[:, np.minimum(np.arange(16) // 2**k, fit.shape[1] - 1)]
        rest = (rest - fit)[:, ::2]
    got = R.mrdmd_fit(packed(spark, x), 2, 2)
    assert np.allclose(np.array([r.xs for r in sorted(got.fitted.collect())]), total, atol=1e-5) and [s for _, s in got.levels] == [1, 2]
    post = {r["mode"]: r for r in R.dmd_posterior(spark, np.array([-0.1 + 2j, 0.3]), 0.05, 4000, seed=1).collect()}
    assert abs(post[0].re_mean + 0.1) < 0.005 and abs(post[0].re_std - 0.05) < 0.004 and abs(post[0].frequency_mean - 2 / (2 * np.pi)) < 0.002
    z, rows = np.array([1.0, 0.6]), []
    for k in range(25):
        rows.append(("r", k, *map(float, z)))
        z = np.array([0.9 * z[0], 0.5 * z[1] + 0.3 * z[0] ** 2])
    df = spark.createDataFrame([*rows, ("r", 40, 1.0, 1.0)], "run string, step long, a double, b double")
    fit = R.koopman_fit(O.next_rows(df, "run", ["step"], ["step", "a", "b"]).where("next_step = step + 1"), [F.col("a"), F.col("b"), F.col("a") ** 2], [F.col("next_a"), F.col("next_b"), F.col("next_a") ** 2])
    assert np.allclose(np.sort(fit.eigenvalues.real), [0.5, 0.81, 0.9], atol=1e-6) and fit.error < 1e-6
    assert np.allclose(fit.operator @ fit.modes, fit.modes * fit.eigenvalues)
    lifted = R.edmd_fit(df, ["a", "b"], "run", "step", "polynomial", 2)
    assert lifted.error < 0.05 and min(abs(lifted.eigenvalues - 0.9)) < 1e-3
    assert [n for n, _ in R.lift(["a", "b"], "polynomial", 2)] == ["a", "b", "a*a", "a*b", "b*b"] and len(R.lift(["a"], "fourier", 3)) == 7 and len(R.lift(["a", "b"], "rbf", centers=[(0, 0), (1, 1)])) == 4
    s = {r["mode"]: r for r in R.koopman_spectrum(spark, np.array([0.9, 1.1j])).collect()}
    assert s[0].stable and not s[1].stable and abs(s[1].frequency - 0.25) < 1e-6 and abs(s[0].growth - np.log(0.9)) < 1e-6


def graph_of(spark, e):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in e], "src long, dst long, weight double")


def test_spectrum_and_bisection(spark):
    rng = np.random.default_rng(7)
    e = [(i, j, 1.0) for i in range(12) for j in range(i) if rng.random() < 0.7] + [(12 + i, 12 + j, 1.0) for i in range(12) for j in range(i) if rng.random() < 0.7] + [(0, 12, 0.5)]
    a = np.zeros((24, 24))
    for i, j, w in e:
        a[i, j] = a[j, i] = w
    d = a.sum(1)
    lap = np.eye(24) - a / np.sqrt(np.outer(d, d))
    values, modes = Z.smallest_modes(G.laplacian(graph_of(spark, e)), 3, rounds=3, degree=6)
    w, v = np.linalg.eigh(lap)
    assert np.allclose(values, w[:3], atol=1e-5)
    got = np.array([[r[f"v{k}"] for k in range(3)] for r in sorted(modes.collect())])
    assert np.allclose(np.abs(got[:, :2].T @ v[:, :2]), np.eye(2), atol=1e-3)
    sig = np.array([r.signature for r in sorted(Z.heat_signature(values, modes, 3).collect())])
    some = values[values > 1e-8]
    t = np.geomspace(4 * np.log(10) / some.max(), 4 * np.log(10) / some.min(), 3)
    assert np.allclose(sig, (got**2) @ np.exp(-np.outer(values, t)), atol=1e-9)
    field = spark.createDataFrame([(i, float(x)) for i, x in enumerate(got[:, 1] * 2 + got[:, 0])], "row long, value double")
    c = Z.spectral_project(field, modes, 3)
    assert np.allclose(c, [1, 2, 0], atol=1e-6)
    assert np.allclose([r.value for r in sorted(Z.spectral_reconstruct(c, modes).collect())], got[:, 1] * 2 + got[:, 0], atol=1e-6)
    part = {r.id: r.part for r in Z.spectral_bisect(graph_of(spark, e)).collect()}
    assert len({part[i] for i in range(12)}) == 1 and len({part[i] for i in range(12, 24)}) == 1 and set(part.values()) == {0, 1}
    assert abs(G.largest_eigenvalue(G.laplacian(graph_of(spark, e)), 8) - w[-1]) < 0.25


def test_matching_on_rising_weights_and_pooled_hierarchy(spark):
    e = graph_of(spark, [(i, i + 1, i + 1.0) for i in range(300)])
    start = time.perf_counter()
    got = G.match_pool(e).collect()
    assert time.perf_counter() - start < 120
    used = {r.id for r in got}
    assert len(used) == len(got) and all(i in used or i + 1 in used for i in range(300))
    nodes = spark.createDataFrame([(i, float(i)) for i in range(301)], "id long, f double")
    (lab, pooled, edges), *_ = X.build_hierarchy(e, 1, nodes=nodes)
    part = {r.id: r.part for r in lab.collect()}
    for r in pooled.collect():
        mine = [i for i, p in part.items() if p == r.id]
        assert r.size == len(mine) and abs(r.f - np.mean(mine)) < 1e-9
    assert {(r.src, r.dst) for r in edges.collect()} == {(part[i], part[i + 1]) for i in range(300) if part[i] != part[i + 1]}


def test_kmeans_frames_and_transport(spark):
    rng = np.random.default_rng(8)
    p = np.vstack([rng.normal(size=(20, 2)) * 0.1, rng.normal(size=(20, 2)) * 0.1 + 5])
    nodes = spark.createDataFrame([(i, r.tolist(), float(i)) for i, r in enumerate(p)], "id long, p array<double>, f double")
    e = graph_of(spark, [(i, (i + 1) % 40, 1.0) for i in range(40)])
    lab, clusters, coarse = X.kmeans_pool(nodes, e, 2)
    part = {r.id: r.part for r in lab.collect()}
    assert len({part[i] for i in range(20)}) == 1 and part[0] != part[20]
    for r in clusters.collect():
        mine = [i for i in part if part[i] == r.part]
        assert r.size == 20 and np.allclose(r.p, p[mine].mean(0)) and np.isclose(r.f, np.mean(mine))
    assert coarse.count() == 2
    q = rng.normal(size=(6, 3))
    n3 = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "id long, x double, y double, z double")
    pairs = [(0, j) for j in range(1, 6)] + [(1, 0), (1, 2)]
    frames = {r.id: np.array(r.r).reshape(3, 3) for r in X.frames_3d(n3, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    d = q[1:] - q[0]
    w, v = np.linalg.eigh(d.T @ d)
    assert np.allclose(np.abs(frames[0].T @ v[:, ::-1]), np.eye(3), atol=1e-9) and np.allclose(frames[1], np.eye(3)) and np.allclose(frames[5], np.eye(3))
    table = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in frames.items()], "id long, r array<double>")
    for r in X.edge_transport(table, spark.createDataFrame(pairs, "src long, dst long"), 3).collect():
        assert np.allclose(np.array(r.t).reshape(3, 3), frames[r.src].T @ frames[r.dst])


def test_equation_search(spark):
    t, x = np.linspace(0, 0.5, 101), np.linspace(0, np.pi, 101)
    u = np.exp(-t)[:, None] * np.sin(x) + np.exp(-4 * t)[:, None] * np.sin(2 * x)
    grid = spark.createDataFrame([("a", i, j, float(t[i]), float(x[j]), float(u[i, j])) for i in range(101) for j in range(101)], "run_id string, it int, ix int, t double, x double, u double")
    text, found, rest = E.pde_find(grid, 2, 1, 0.2, trim=5)
    assert set(found) == {"u_x_x"} and abs(found["u_x_x"] - 1) < 0.05 and text.startswith("u_t = ") and rest < 1e-2
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 200))
    df = spark.createDataFrame([(float(p), float(q), float(p * q + p)) for p, q in zip(a, b)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    name, column, mse = V.symbolic_regression(df, ["a", "b"], "y", generations=6, population=40, seed=1)
    assert mse < 0.5 * np.var(a * b + a) and np.isclose(df.where("a is not null").agg(F.avg((column - F.col("y")) ** 2)).first()[0], mse)
    tt = np.linspace(0, 5, 2001)
    wave = spark.createDataFrame([(float(s), float(np.exp(-0.5 * s))) for s in tt], "t double, x double")
    for kind in ("bump", "gaussian", "sine"):
        c = E.weak_sindy(wave, [("1", F.lit(1.0)), ("x", F.col("x"))], "x", "t", threshold=0.05, test_function=kind)
        assert abs(c[1] + 0.5) < 2e-3 and c[0] == 0
    sums = E.normal_equations(spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 1.0), (None, 3.0, 1.0), ("b", 1.0, float("nan")), ("b", 2.0, 2.0)], "k string, x double, y double"), [F.col("x"), F.col("y")], ["k"])
    assert {(r.k, r.i, r.j): r.s for r in sums.collect()} == {("a", 0, 0): 1.0, ("a", 0, 1): 2.0, ("a", 1, 1): 4.0, (None, 0, 0): 9.0, (None, 0, 1): 3.0, (None, 1, 1): 1.0, ("b", 0, 0): 4.0, ("b", 0, 1): 4.0, ("b", 1, 1): 4.0}


def test_coarse_to_fine(spark):
    xs = np.linspace(0, 1, 9)
    coarse_p = spark.createDataFrame([(i, [float(v), 0.0]) for i, v in enumerate(xs)], "id long, p array<double>")
    fine_x = np.linspace(0, 1, 33)
    fine_p = spark.createDataFrame([(100 + i, [float(v), 0.0]) for i, v in enumerate(fine_x)], "id long, p array<double>")
    f = {k: (lambda v, k=k: np.sin((k + 1) * v)) for k in range(3)}
    coarse = spark.createDataFrame([(i, k, float(f[k](v))) for k in f for i, v in enumerate(xs)], "id long, run int, value double")
    fine = spark.createDataFrame([(100 + i, k, float(f[k](v))) for k in f for i, v in enumerate(fine_x)], "id long, run int, value double")
    got = V.coarse_to_fine(coarse_p, coarse, fine_p, fine, k=2).collect()
    assert len(got) == 99 and max(abs(r.corrected - f[r.run](fine_x[r.id - 100])) for r in got) < 1e-4 < max(abs(r.prolonged - f[r.run](fine_x[r.id - 100])) for r in got)


def test_bootstraps_chains_and_ensembles(spark):
    ids = np.random.default_rng(10).integers(0, 2**63, 20_000).astype(np.uint64)
    w = X.bootstrap_weights(ids, 3)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.02 and abs(np.corrcoef(w, X.bootstrap_weights(ids, 4))[0, 1]) < 0.03
    rng = np.random.default_rng(11)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(v), float(1 + 2 * v + 0.5 * rng.normal())) for i, v in enumerate(x)], "id long, x double, y double")
    terms = [("1", F.lit(1.0)), ("x", F.col("x")), ("x^2", F.col("x") ** 2)]
    g = {r.term: r for r in X.sindy_ensemble(df, terms, "y", "id", 40, 0.3).collect()}
    assert abs(g["x"].consensus - 2) < 0.1 and g["x"].inclusion == 1 and g["x^2"].consensus == 0 and 0.01 < g["x"]["std"] < 0.06
    fits = X.bootstrap_fits(df, terms, "y", "id", 40, 0.3)
    c = fits.toPandas().pivot(index="model", columns="term", values="coef")
    for r in X.ensemble_predict(df.limit(5), terms, fits).collect():
        p = c["1"] + c["x"] * r.x + c["x^2"] * r.x**2
        assert abs(r.predicted - p.mean()) < 1e-9 and abs(r.spread - p.std(ddof=0)) < 1e-7
    p = spark.createDataFrame([("a", 50, 50 * 1.5, 50 * 1.5**2 + 50.0), ("b", 10, 10 * -2.0, 10 * 4.0 + 10.0)], "key string, n long, total double, square double")
    s = {r.key: r for r in X.posterior_summary(X.mcmc_chains(p, 8, 3000, 2.0, adapt=500), 500).collect()}
    for key, n, m in (("a", 50, 1.5), ("b", 10, -2.0)):
        exact, std = n * m / (n + 0.01), 1 / np.sqrt(n + 0.01)
        assert abs(s[key]["mean"] - exact) < 0.1 * std and abs(s[key]["std"] - std) < 0.1 * std and abs(s[key]["map"] - exact) < 0.1 * std
    lines = spark.createDataFrame([("a", 40.0, 0.0, 60.0, 20.0, 90.0)], "key string, n double, sx double, sxx double, sy double, sxy double")
    density = lambda t, q: -0.5 * (q["n"] * t[:, 0] ** 2 + 2 * t[:, 0] * t[:, 1] * q["sx"] + q["sxx"] * t[:, 1] ** 2 - 2 * t[:, 0] * q["sy"] - 2 * t[:, 1] * q["sxy"])
    m = X.metropolis(lines, ["n", "sx", "sxx", "sy", "sxy"], density, lambda q: np.zeros((len(q["n"]), 2)), lambda q: np.full((len(q["n"]), 2), 0.2), 6, 3000, 500)
    m = m.where("step >= 500").agg(*[f(F.col("theta")[i]) for i in (0, 1) for f in (F.avg, F.stddev_pop)]).first()
    assert np.allclose(m, [0.5, 1 / np.sqrt(40), 1.5, 1 / np.sqrt(60)], atol=0.02)
    e = spark.createDataFrame([(i, [float(v), float(v**2)], [float(2 * v), float(v - 1)]) for i, v in enumerate(x)], "id long, theta array<double>, g array<double>")
    th, gg = np.c_[x, x**2], np.c_[2 * x, x - 1]
    cov = np.cov(np.c_[th, gg].T)
    gain = cov[:2, 2:] @ np.linalg.inv(cov[2:, 2:] + 0.04 * np.eye(2))
    new = np.array([r.theta for r in sorted(X.enki_step_vector(e, [1.0, 0.5], 0.2, 2).collect())])
    mean_move = gain @ (np.array([1.0, 0.5]) - gg.mean(0))
    assert np.allclose((new - th).mean(0), mean_move, atol=0.05)
    t = U.morris_trajectories(spark.range(300).select(F.col("id").alias("trajectory")), [(0, 3), (10, 40)], 4, seed=2).collect()
    by = {}
    for r in t:
        by.setdefault(r.trajectory, {})[r.step] = np.array(r.x)
    assert len(t) == 900 and all(((s[1] != s[0]).sum() <= 1) and ((s[2] != s[1]).sum() <= 1) for s in by.values())
    assert {v for s in by.values() for v in np.round([q[1] for q in s.values()], 6)} <= {10.0, 20.0, 30.0, 40.0}
    assert np.mean([(s[2] != s[0]).sum() for s in by.values()]) > 1


def test_process_batches_and_tasks(spark):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    train = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "p array<double>, y double")
    q = rng.normal(size=(1200, 2))
    cand = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "id long, p array<double>")
    kern = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(2))
    k = kern(x, x) + 0.01 * np.eye(40)
    got = {r.id: r for r in C.gp_predict(cand, train, noise=0.01).collect()}
    mean, var = kern(q, x) @ np.linalg.solve(k, y), 1 - np.einsum("ij,ji->i", kern(q, x), np.linalg.solve(k, kern(x, q)))
    assert max(abs(got[i]["mean"] - mean[i]) for i in range(1200)) < 1e-8 and max(abs(got[i]["std"] - np.sqrt(max(var[i], 1e-10))) for i in range(1200)) < 1e-5
    assert np.isclose(C.gp_log_marginal(train, noise=0.01), -0.5 * y @ np.linalg.solve(k, y) - 0.5 * np.linalg.slogdet(k)[1] - 20 * np.log(2 * np.pi))
    assert C.bounded_rows(train, 10, "y").count() <= 10 and C.gp_predict(cand.limit(3), train.limit(0)).count() == 3
    pts = rng.uniform(size=(60, 2))
    score = rng.uniform(1, 2, 60)
    scored = spark.createDataFrame([(i, *map(float, p), float(s)) for i, (p, s) in enumerate(zip(pts, score))], "id long, x double, y double, score double")
    chosen = []
    for _ in range(11):
        near = np.array([min([np.linalg.norm(pts[i] - pts[j]) for j in chosen], default=np.inf) for i in range(60)])
        v = score * (1 - np.exp(-near))
        v[chosen] = -1
        chosen.append(int(v.argmax()))
    assert C.diverse_batch(scored, 11, ["x", "y"], every=4) == chosen
    e = rng.normal(size=(30, 3))
    tasks = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(e)], "task long, e array<double>")
    sim = {(r.task, r["rank"]): r.other for r in C.similar_tasks(tasks.where("task < 4"), tasks, 3).collect()}
    for i in range(4):
        order = np.argsort(np.linalg.norm(e - e[i], axis=1), kind="stable")
        assert [sim[(i, k)] for k in (1, 2, 3)] == order[order != i][:3].tolist()


def test_archives_and_meshes(spark, tmp_path):
    buf = io.BytesIO()
    np.savez(buf, field_u_values=np.arange(3.0), field_u_points=np.arange(6.0).reshape(3, 2), mesh_points=np.zeros((2, 3)), mesh_cells=np.array([[0, 1, 2]]), metadata=np.array('{"solver": "a"}'), other=np.ones(2))
    (tmp_path / "r.npz").write_bytes(buf.getvalue())
    got = IO.read_npz(spark, f"{tmp_path}/*.npz").collect()
    count = {}
    for r in got:
        count[r.kind] = count.get(r.kind, 0) + 1
    assert count == {"value": 3, "point": 6, "mesh_point": 6, "mesh_cell": 3, "metadata": 1}
    assert [r.text for r in got if r.kind == "metadata"] == ['{"solver": "a"}'] and {r.field for r in got if r.kind in ("value", "point")} == {"u"}
    pts, cells = N.structured_grid(spark, [(0, 1), (0, 1)], [2, 2])
    IO.save_mesh(pts, cells, f"{tmp_path}/m")
    p, c = IO.load_mesh(spark, f"file://{tmp_path}/m")
    assert p.count() == 9 and c.where("cell_type = 'quad'").count() == 4
    IO.save_mesh(pts, None, f"{tmp_path}/cloud")
    assert IO.load_mesh(spark, f"file://{tmp_path}/cloud")[1] is None


def test_mesh_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,point_id,y,extra\n0.5,0,1,a\n,1,2.5,b\n1e3, 2 ,,c\n")
    (tmp_path / "c.csv").write_text("cell_id,cell_type,nodes\n7,triangle,0  1 2\n8,point,\n")
    p, c = IO.read_mesh_text(spark, f"file://{tmp_path}/p.csv", f"file://{tmp_path}/c.csv")
    assert sorted(map(tuple, p.collect())) == [(0, 0, 0.5, 1.0, 0.0), (0, 1, 0.0, 2.5, 0.0), (0, 2, 1000.0, 0.0, 0.0)]
    assert sorted(map(tuple, c.collect())) == [(0, 7, "triangle", [0, 1, 2]), (0, 8, "point", [])]
    (tmp_path / "p.json").write_text('{"mesh": 3, "point_id": 0, "x": 0.5}\n{"point_id": 1, "y": 2, "x": null}\n')
    (tmp_path / "c.json").write_text('{"mesh": 3, "nodes": [1, 0], "cell_id": 1, "cell_type": "line"}\n{"cell_id": 2}\n')
    p, c = IO.read_mesh_text(spark, f"file://{tmp_path}/p.json", f"file://{tmp_path}/c.json", "json")
    assert sorted(map(tuple, p.collect())) == [(0, 1, 0.0, 2.0, 0.0), (3, 0, 0.5, 0.0, 0.0)]
    assert sorted(map(tuple, c.select("mesh", "cell_id", "nodes").collect())) == [(0, 2, []), (3, 1, [1, 0])]
    (tmp_path / "bad.csv").write_text("point_id,x\n0,east\n")
    cloud, none = IO.read_mesh_text(spark, f"file://{tmp_path}/bad.csv")
    assert none is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cloud.collect()
    with pytest.raises(ValueError):
        IO.read_mesh_text(spark, "x", kind="msh")


def test_streams(spark, tmp_path):
    from fieldloom.streaming.incremental import AdaptivePod, ObservationLoop, rocksdb, streaming_dmd

    rng = np.random.default_rng(13)
    base = rng.normal(size=(20, 2))
    x = base @ rng.normal(size=(2, 8)) + 1.0
    rows = [(i, k, float(x[i, k])) for k in range(8) for i in range(20)]
    df = spark.createDataFrame(rows, "dof long, step long, value double")
    for part in (0, 4):
        df.where(F.col("step").between(part, part + 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/snap")
    pod = AdaptivePod(spark, 1e-6, 5)
    q = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/snap").writeStream.option("checkpointLocation", f"{tmp_path}/c1").foreachBatch(pod.update).trigger(availableNow=True).start()
    q.awaitTermination()
    mean, modes, count = x[:, 0].copy(), np.zeros((20, 0)), 1
    for k in range(1, 8):
        count += 1
        mean += (x[:, k] - mean) / count
        c = x[:, k] - mean
        rest = c - modes @ (modes.T @ c)
        if np.linalg.norm(rest) > 1e-6 * np.linalg.norm(x[:, k]) and modes.shape[1] < 5:
            modes = np.c_[modes, rest / np.linalg.norm(rest)]
    got = sorted(pod.basis.collect())
    assert pod.modes == modes.shape[1] and np.allclose([r["mean"] for r in got], mean) and np.allclose([r.phi for r in got], modes, atol=1e-7)
    pod.update(df, 1)
    assert pod.modes == modes.shape[1]
    cand = spark.createDataFrame([(i, [i / 10.0]) for i in range(40)], "id long, p array<double>")
    loop = ObservationLoop(cand, k=2, length=0.5)
    see = lambda v: spark.createDataFrame([([float(a)], float(np.sin(a))) for a in v], "p array<double>, y double")
    loop.update(see([0.0, 0.5, 1.0]), 0)
    loop.update(see([1.5, 2.0]), 1)
    loop.update(see([9.0]), 1)
    assert len(loop.chosen) == 2 and len(loop.chosen[0]) == 2 and loop.chosen[1][0] == 39 and loop.seen.count() == 5
    a, z, rows = np.array([[0.9, 0.2], [-0.2, 0.9]]), np.array([1.0, 0.5]), []
    for k in range(60):
        rows.append(("r", k, z.tolist(), 1_700_000_000 + k))
        z = a @ z
    ev = spark.createDataFrame(rows, "run_id string, step long, x array<double>, s long").select("run_id", "step", "x", F.timestamp_seconds("s").alias("ts"))
    ev.coalesce(1).write.parquet(f"{tmp_path}/ev")
    seen = []
    with rocksdb(spark):
        q = streaming_dmd(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), 2, event_time="ts", delay="10 minutes").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(seen, key=lambda r: r.step)
    assert last.step == 59 and np.allclose(last.re, 0.9, atol=1e-3)
