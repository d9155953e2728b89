"""Typed streaming state, block updates, observation logs and archives by ranges, against plain loops."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F


def recursion(xs, rank, lam=0.99):
    """Recursive least squares over the stretches of ``xs``, rows (step, x) in order."""
    a, p, last, x0 = np.eye(rank), 1e3 * np.eye(rank), None, None
    for step, x in xs:
        x = np.asarray(x, float)
        if last is not None and step == last + 1:
            g = p @ x0 / (lam + x0 @ p @ x0)
            a, p = a + np.outer(x - a @ x0, g), (p - np.outer(p @ x0 / (lam + x0 @ p @ x0), x0 @ p)) / lam
        last, x0 = step, x
    return a


def stream_of(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streaming_dmd_orders_rows_and_closes_runs(spark, tmp_path):
    """Shuffled rows, repeats, a gap that the watermark closes, and state that goes."""
    from fieldloom.streaming.incremental import rocksdb, streaming_dmd

    rng, t0 = np.random.default_rng(3), 1_700_000_000
    a = np.array([[0.8, 0.3], [-0.3, 0.8]])
    z = [np.array([1.0, 0.2])]
    for _ in range(39):
        z.append(a @ z[-1] + 0.01 * rng.normal(size=2))
    rows = [("r", k, z[k].tolist(), t0 + k) for k in range(40) if k != 25]  # step 25 never comes
    order = rng.permutation(len(rows))
    batches = [[rows[i] for i in part] for part in np.array_split(order, 3)]
    batches[2] = batches[2] + batches[0][:2]  # repeats are late
    batches += [[("other", 0, [1.0, 1.0], t0 + 1000)], [("other", 1, [0.5, 0.5], t0 + 1001)], [("other", 2, [0.5, 0.5], t0 + 2000)], [("other", 3, [0.5, 0.5], t0 + 2001)]]
    seen = []
    stream = stream_of(spark, f"{tmp_path}/in", batches, "run_id string, step long, x array<double>, s long")
    stream = stream.withColumn("ts", F.timestamp_seconds("s"))
    with rocksdb(spark):
        q = streaming_dmd(stream, 2, event_time="ts", delay="5 minutes").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: seen.extend((n, *r) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    mine = [r for r in seen if r[1] == "r"]
    whole = max((r for r in mine), key=lambda r: r[2])
    assert whole[2] == 39 and whole[3] == 2 and whole[4] == 0
    before = [r for r in mine if r[2] == 24]
    assert before and before[-1][3] + before[-1][4] == 16  # fourteen rows wait behind the gap, and repeats are late or wait
    want = recursion([(k, z[k]) for k in range(40) if k != 25], 2)
    assert np.allclose(np.reshape(whole[7], (2, 2)), want, atol=1e-9)
    assert np.allclose(sorted(whole[6]), sorted(np.linalg.eigvals(want).imag), atol=1e-9)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "model").load()
    assert {r.key[0] for r in state.select("key").collect()} == {"other"}


def test_observation_loop_equals_full_refits(spark):
    from fieldloom.operators.surrogate import gp_predict
    from fieldloom.streaming.incremental import ObservationLoop

    rng = np.random.default_rng(5)
    cand = spark.createDataFrame([(i, rng.uniform(0, 3, 2).tolist()) for i in range(60)], "id long, p array<double>")
    loop = ObservationLoop(cand, k=2, length=0.7, noise=1e-3, score="improvement")
    seen, written = [], []
    for n in range(4):
        rows = [(p.tolist(), float(np.sin(p[0]) + p[1])) for p in rng.uniform(0, 3, (4, 2))] + ([(None, 1.0), ([1.0, 1.0], None)] if n == 1 else [])
        seen += [r for r in rows if None not in r]
        loop.update(spark.createDataFrame(rows, "p array<double>, y double"), n)
        written.append(list(loop.log))
        if len(seen) < 5:
            continue
        got = {r.id: (r.mean, r.std) for r in gp_predict(cand, spark.createDataFrame(seen, "p array<double>, y double"), 0.7, 1e-3).collect()}
        from fieldloom.operators.surrogate import gp_score

        mine = {r.id: (r.mean, r.std) for r in gp_score(cand, loop.process).collect()}
        assert np.allclose([mine[i] for i in range(60)], [got[i] for i in range(60)], atol=1e-7)
    assert all(written[n][: n] == written[n - 1] for n in range(1, 4)) and loop.seen.count() == 18


def test_adaptive_pod_takes_a_fixed_number_of_jobs(spark):
    """A batch of twelve snapshots takes no more jobs than one of three, and gives what single snapshots give."""
    from fieldloom.streaming.incremental import AdaptivePod

    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 12))
    rows = lambda ks: spark.createDataFrame([(i, k, float(x[i, k])) for k in ks for i in range(30)], "dof long, step long, value double")
    pods, jobs = [AdaptivePod(spark, 1e-3, 20) for _ in range(3)], []
    tracker = spark.sparkContext.statusTracker()
    for pod, parts in zip(pods, ([range(12)], [range(3)], [[k] for k in range(12)])):
        spark.sparkContext.setJobGroup(f"pod{len(jobs)}", "")
        for n, ks in enumerate(parts):
            pod.update(rows(ks), n)
        jobs.append(len(tracker.getJobIdsForGroup(f"pod{len(jobs)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] <= jobs[1] + 1
    many, one = sorted(pods[0].basis.collect()), sorted(pods[2].basis.collect())
    assert pods[0].modes == pods[2].modes == 11
    assert np.allclose([r["mean"] for r in many], x.mean(1)) and np.allclose([r.phi for r in many], [r.phi for r in one], atol=1e-8)


def test_archives_are_read_in_ranges(spark, tmp_path):
    from fieldloom.sources import io as IO

    rng = np.random.default_rng(1)
    big, wide, column = rng.normal(size=5_000), rng.normal(size=(700, 3)), np.asfortranarray(rng.normal(size=(40, 2)))
    for name, save in (("a", np.savez), ("b", np.savez_compressed)):
        buf = io.BytesIO()
        save(buf, field_u_values=big, field_v_values=wide, field_w_values=column, mesh_points=wide, metadata=np.array('{"k": 1}'), other=np.ones(3))
        (tmp_path / f"{name}.npz").write_bytes(buf.getvalue())
    (tmp_path / "note.txt").write_text("no archive")
    df = IO.read_npz(spark, str(tmp_path), 4_000)
    assert df.rdd.getNumPartitions() > 20
    rows = df.collect()
    for run in "ab":
        for field, want in (("u", big.reshape(-1, 1)), ("v", wide), ("w", column)):
            got = np.full(want.shape, np.nan)
            for r in rows:
                if r.run_id == run and r.kind == "value" and r.field == field:
                    assert np.isnan(got[r.row, r.component])
                    got[r.row, r.component] = r.value
            assert (got == want).all()
    assert [r.text for r in rows if r.kind == "metadata"] == ['{"k": 1}'] * 2 and not [r for r in rows if r.kind == "other"]
    assert IO.read_npz(spark, f"{tmp_path}/a*.npz").where("kind = 'value' and field = 'u'").count() == 5_000
    whole = IO._whole_archives(spark, f"{tmp_path}/*.npz").collect()
    assert sorted(map(str, whole)) == sorted(map(str, rows))
    buf = io.BytesIO()
    np.savez(buf, field_u_values=np.array([{}], dtype=object))
    (tmp_path / "bad.npz").write_bytes(buf.getvalue())
    with pytest.raises(Exception, match="pickled"):
        IO.read_npz(spark, f"{tmp_path}/bad.npz").collect()


def maps(base, other):
    """Tangent at an orthonormal basis towards another, by singular values."""
    m = other @ np.linalg.inv(base.T @ other) - base
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    return u * np.arctan(s) @ vt


def moved(base, tangent):
    u, s, vt = np.linalg.svd(tangent, full_matrices=False)
    return np.linalg.qr(base @ vt.T * np.cos(s) @ vt + u * np.sin(s) @ vt)[0]


def test_bases_at_vector_parameters(spark):
    """All five methods and their means against NumPy, with two parameters; the spline is held at its ends."""
    from fieldloom.operators import rom as R

    rng = np.random.default_rng(9)
    params = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.2], [0.4, 0.7]]
    start = np.linalg.qr(rng.normal(size=(25, 2)))[0]
    b = [np.linalg.qr(start + 0.15 * rng.normal(size=(25, 2)))[0] for _ in params]
    b = [x * np.sign((x * start).sum(0)) for x in b]
    means = rng.normal(size=(5, 25))
    df = spark.createDataFrame([(i, k, b[k][i].tolist(), float(means[k, i])) for k in range(5) for i in range(25)], "dof long, basis int, phi array<double>, mean double")
    at = np.array([0.5, 0.3])
    d = np.linalg.norm(np.array(params) - at, axis=1)
    w = 1 / (d + 1e-10)
    w /= w.sum()
    near = b[int(d.argmin())]
    mean = b[int(np.argmax(w))]
    for _ in range(100):
        mean = moved(mean, sum(x * maps(mean, y) for x, y in zip(w, b)))
    tps = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0)
    x = np.array(params)
    big = np.zeros((8, 8))
    big[:5, :5], big[:5, 5], big[:5, 6:] = tps(np.linalg.norm(x[:, None] - x, axis=2)), 1, x
    big[5:, :5] = big[:5, 5:].T
    r = np.linalg.solve(big, np.r_[tps(d), 1, at])[:5]
    want = {"idw": (sum(a * y for a, y in zip(w, b)), w), "rbf": (sum(a * y for a, y in zip(r, b)), r), "grassmann": (moved(near, sum(a * maps(near, y) for a, y in zip(w, b))), w), "karcher": (mean, w)}
    for method, (basis, weights) in want.items():
        got = sorted(R.interpolate_basis(df, params, at.tolist(), method).collect())
        f, q = np.array([g.phi for g in got]), np.linalg.qr(basis)[0]
        assert np.allclose(f @ f.T, q @ q.T, atol=1e-7), method
        assert np.allclose([g["mean"] for g in got], weights @ means, atol=1e-9)
    line = df.where("basis < 3").drop("mean")
    ends = [np.array([g.phi for g in sorted(R.interpolate_basis(line, [0.0, 1.0, 2.0], t, "spline").collect())]) for t in (2.0, 9.0)]
    assert np.allclose(ends[0], ends[1]) and np.allclose(ends[0] @ ends[0].T, b[2] @ b[2].T, atol=1e-8)
    with pytest.raises(ValueError):
        R.interpolate_basis(df, params, at.tolist(), "spline")


def test_tournament_points(spark):
    """One partition is pivoted QR; a tournament chooses points about as good, in passes that do not grow with k."""
    from fieldloom.operators import rom as R

    rng = np.random.default_rng(4)
    u = np.linalg.qr(rng.normal(size=(400, 6)) * rng.exponential(size=(400, 1)))[0]
    modes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "dof long, phi array<double>")
    plain, rest = [], u.copy()
    for _ in range(6):
        plain.append(int((rest**2).sum(1).argmax()))
        q = rest[plain[-1]] / np.linalg.norm(rest[plain[-1]])
        rest -= np.outer(rest @ q, q)
    assert R.qdeim_points(modes.coalesce(1), 6) == plain
    spread = modes.repartition(20)
    got = R.qdeim_points(spread, 6)
    assert len(set(got)) == 6 and got[0] == plain[0]
    assert R.interpolation_error(modes, got, 6) < 2 * R.interpolation_error(modes, plain, 6)
    jobs = []
    for k in (2, 6):
        spark.sparkContext.setJobGroup(f"points{k}", "")
        R.qdeim_points(spread, k)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"points{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_uncertain_prediction(spark):
    """Moments of the prediction equal those of plain draws of eigenvalues, amplitudes and modes."""
    from fieldloom.operators import rom as R

    rng = np.random.default_rng(6)
    lam, b = np.array([0.9 * np.exp(0.4j), 0.9 * np.exp(-0.4j)]), np.array([1.0 + 0j, 1.0])
    phi = rng.normal(size=(5, 2)) + 1j * rng.normal(size=(5, 2))
    modes = spark.createDataFrame([(i, 0.0, np.r_[p.real, p.imag].tolist()) for i, p in enumerate(phi)], "dof long, mean double, re_im array<double>")
    got = {(r.dof, r.step): (r["mean"], r["std"]) for r in R.dmd_predict_uncertain(R.Dmd(lam, b, modes), 0.05, [0, 3, 7], 20_000, 1).collect()}
    n = 20_000
    omega = np.log(lam) + 0.05 * (rng.normal(size=(n, 2)) + 1j * rng.normal(size=(n, 2)))
    amp = b + 0.05 * rng.normal(size=(n, 2))
    own = phi + 0.05 * rng.normal(size=(n, 5, 2))
    for t in (0, 3, 7):
        y = np.einsum("nij,nj->ni", own, amp * np.exp(omega * t)).real
        for i in range(5):
            assert abs(got[i, t][0] - y[:, i].mean()) < 5 * y[:, i].std() / n**0.5 * 1.5 and abs(got[i, t][1] / y[:, i].std() - 1) < 0.04


def spark_uniform(seed, i, salt):
    """The hash draw of row ``i``, by the public hash of its fields' bytes."""
    import struct

    import xxhash

    h = 42
    for raw in (struct.pack("<i", seed), struct.pack("<q", i), struct.pack("<i", salt)):
        h = xxhash.xxh64_intdigest(raw, seed=h)
    h -= (h >> 63) << 64
    return (h % (1 << 52) + 0.5) / float(1 << 52)


def test_samples_equal_plain_draws(spark):
    from fieldloom.sources import generate as S

    got = sorted(S.parameter_samples(spark, [(-1.0, 3.0), (10.0, 11.0)], 50, seed=5).collect())
    assert np.allclose([r.p for r in got], [[-1 + 4 * spark_uniform(5, i, 0), 10 + spark_uniform(5, i, 1)] for i in range(50)])
    inside = F.col("x") ** 2 + F.col("y") ** 2 <= 1
    got = sorted(S.sample_domain(spark, [(-1.0, 1.0), (-1.0, 1.0)], inside, 300, seed=11).collect())
    want = [(i, x, y) for i in range(2_000) for x, y in [(2 * spark_uniform(11, i, 0) - 1, 2 * spark_uniform(11, i, 1) - 1)] if x * x + y * y <= 1][:300]
    assert np.allclose([tuple(r) for r in got], want)
    assert S.sample_domain(spark, [(0.0, 1.0), (0.0, 1.0)], F.col("x") < 0.01, 40, seed=1).count() == 40


def test_wrong_bases_turn_their_queries_red(spark, monkeypatch):
    """The registered answer of a basis depends on the basis: a turned one, of the same span or not, differs."""
    from fieldloom.jobs import design_queries as D
    from fieldloom.operators import rom as R

    data = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    right = rows(D.QUERIES["rom_basis_weighted"](spark, data))
    fit = R.pod_fit

    def turned(*args, **more):
        pod = fit(*args, **more)
        p = F.col("phi")
        pod.modes = pod.modes.withColumn("phi", F.array(0.8 * p[0] + 0.6 * p[1], 0.6 * p[0] - 0.8 * p[1]))
        return pod

    monkeypatch.setattr(D.R, "pod_fit", turned)
    wrong = rows(D.QUERIES["rom_basis_weighted"](spark, data))
    assert [r[1] for r in wrong] == [r[1] for r in right] and wrong != right  # the same span, other energies
    monkeypatch.setattr(D.R, "pod_fit", lambda packed, **more: fit(packed.withColumn("xs", F.reverse("xs")).withColumn("w", F.lit(1.0)), **more))
    assert rows(D.QUERIES["rom_basis_weighted"](spark, data)) != right


def test_bisection_by_levels(spark):
    """Four parts of a ring of unequal weights against NumPy, in as many solves as there are levels."""
    from fieldloom.operators import spectral as Z

    rng = np.random.default_rng(12)
    n, groups = 48, np.arange(48) // 12
    e = [(i, j, float(rng.uniform(0.5, 1.5))) for i in range(n) for j in range(i) if groups[i] == groups[j] and rng.random() < 0.8]
    e += [(0, 12, 0.4), (24, 36, 0.3), (13, 25, 0.05)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in e], "src long, dst long, weight double")
    calls = []
    solve = Z.modes_by_part
    Z.modes_by_part = lambda *a, **k: calls.append(1) or solve(*a, **k)
    try:
        got = {r.id: r.part for r in Z.spectral_bisect(df, 4).collect()}
    finally:
        Z.modes_by_part = solve

    def split(nodes):
        at = {v: k for k, v in enumerate(nodes)}
        a = np.zeros((len(nodes),) * 2)
        for i, j, w in e:
            if i in at and j in at:
                a[at[i], at[j]] = a[at[j], at[i]] = w
        d = a.sum(1)
        v = np.linalg.eigh(np.eye(len(a)) - a / np.sqrt(np.outer(d, d)))[1][:, 1]
        high = v > np.median(v)
        return [x for x, h in zip(nodes, high) if h], [x for x, h in zip(nodes, high) if not h]

    want = {frozenset(p) for half in split(list(range(n))) for p in split(half)}
    assert {frozenset(v for v in got if got[v] == p) for p in set(got.values())} == want and set(got.values()) == {0, 1, 2, 3}
    assert len(calls) == 2


def test_modes_by_part_equal_numpy(spark):
    from fieldloom.operators import spectral as Z

    rng, rows, want = np.random.default_rng(3), [], {}
    for p, n in enumerate((20, 14, 3)):
        a = np.triu(rng.uniform(0.2, 1.0, (n, n)) * (rng.random((n, n)) < 0.6), 1)
        a[np.arange(n - 1), np.arange(1, n)] = 1.0
        rows += [(100 * p + i, 100 * p + j, float(a[i, j]), p) for i in range(n) for j in range(n) if a[i, j]]
        a = a + a.T
        d = a.sum(1)
        want[p] = np.linalg.eigh(np.eye(n) - a / np.sqrt(np.outer(d, d)))
    values, modes = Z.modes_by_part(spark.createDataFrame(rows, "src long, dst long, weight double, part int"), 2, rounds=6, degree=8, tol=1e-9)
    got = modes.toPandas()
    for p, (w, v) in want.items():
        assert np.allclose(values[p], w[:2], atol=1e-5)
        own = got[got.part == p].sort_values("row")
        assert abs(own.v1.to_numpy() @ v[:, 1]) > 0.999


@pytest.mark.parametrize("lazy, most", [(2_000, 100_000), (20, 100_000), (20, 40)])
def test_lazy_choices_equal_plain_loops(spark, monkeypatch, lazy, most):
    """Equal choices whatever the bounds prove: at once, after more reads, or by passes in the end; negative scores and ties."""
    from fieldloom.operators import surrogate as C

    monkeypatch.setattr(C, "LAZY", lazy)
    monkeypatch.setattr(C, "LAZY_MAX", most)
    monkeypatch.setattr(C, "max", lambda a, b: a, raising=False)
    rng = np.random.default_rng(7)
    p, score = np.round(rng.uniform(0, 2, (400, 2)), 1), np.round(rng.normal(size=400) + 1, 1)
    df = spark.createDataFrame([(i, float(s), float(x), float(y)) for i, (s, (x, y)) in enumerate(zip(score, p))] + [(999, None, 0.0, 0.0)], "id long, score double, x double, y double")
    chosen, near, free = [], np.full(400, np.inf), np.ones(400, bool)
    for _ in range(25):
        value = np.where(free, score if not chosen else score * (1 - np.exp(-near)), -np.inf)
        best = int(value.argmax())
        chosen.append(best)
        free[best] = False
        near = np.minimum(near, np.sqrt(((p - p[best]) ** 2).sum(1)))
    got = C.diverse_batch(df, 25, ["x", "y"])
    assert got == chosen


def test_lazy_choices_take_a_fixed_number_of_jobs(spark):
    from fieldloom.operators import surrogate as C

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, float(s), float(x)) for i, (s, x) in enumerate(zip(rng.exponential(size=3_000), rng.uniform(size=3_000)))], "id long, score double, x double")
    jobs = []
    for k in (3, 30):
        spark.sparkContext.setJobGroup(f"lazy{k}", "")
        assert len(C.diverse_batch(df, k, ["x"])) == k
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lazy{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs) <= 3


@pytest.mark.parametrize("tolerance", [1e-3, 1e-9])
def test_tree_sums_stay_within_their_bound(spark, monkeypatch, tolerance):
    """Gaussian and logarithmic sums against full sums: the error is within tolerance x weights, and boxes are used."""
    from fieldloom.operators import treesum as T

    monkeypatch.setattr(T, "PER_BOX", 8)
    rng = np.random.default_rng(5)
    x, w = np.vstack([rng.normal(size=(600, 2)), 8 + 0.1 * rng.normal(size=(200, 2)), np.full((50, 2), 3.0)]), rng.normal(size=(850, 2))
    q = np.vstack([rng.uniform(-4, 10, (150, 2)), x[:5] + 1e-3])
    sup = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, w)] + [(None, [1.0, 1.0]), ([float("nan"), 0.0], [1.0, 1.0]), ([0.0, 0.0], None)], "p array<double>, w array<double>")
    ask = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(q)] + [(999, None)], "id long, p array<double>")
    for kernel in (T.Gaussian(0.7, 2, 2), T.Logarithm()):
        want = kernel.direct(q, x, w)
        got = {r.id: r.s for r in T.tree_sums(ask, sup, kernel, 2, tolerance).collect()}
        bound = tolerance * (np.abs(w).sum(0) if kernel.columns == 2 else np.array([np.hypot(*w.T).sum()])) + 1e-8
        assert len(got) == len(q) and (np.abs(np.array([got[i] for i in range(len(q))]) - want) <= bound).all()
        assert {tuple(r.s) for r in T.tree_sums(ask, sup.limit(0), kernel, 2, tolerance).collect()} == {(0.0,) * kernel.columns}


def test_tree_sums_meet_each_place_once(spark):
    """Many copies of a few places: sums are those of all points, but kernels see distinct places only."""
    from fieldloom.operators import treesum as T

    rng = np.random.default_rng(7)
    place, ask = rng.uniform(size=(6, 2)), rng.uniform(size=(4, 2))
    x, w, q = np.repeat(place, 40, axis=0), rng.normal(size=(240, 2)), np.repeat(ask, 30, axis=0)
    sup = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, w)], "p array<double>, w array<double>")
    asks = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(q)], "id long, p array<double>")
    for kind, args in ((T.Gaussian, (0.7, 2, 2)), (T.Logarithm, ())):

        class Few(kind):
            def direct(self, at, points, weights, direct=kind.direct):
                assert len(at) <= 4 and len(points) <= 6
                return direct(self, at, points, weights)

        got = {r.id: r.s for r in T.tree_sums(asks, sup, Few(*args), 2, 1e-12).collect()}
        assert len(got) == 120 and np.allclose([got[i] for i in range(120)], kind(*args).direct(q, x, w), atol=1e-9)


def test_gp_scores_each_place_once(spark, monkeypatch):
    """Copies of three places: every candidate gets its place's score, and the process is asked for three rows."""
    from fieldloom.operators import surrogate as C

    rng = np.random.default_rng(12)
    x, y, place = rng.uniform(0, 2, (20, 2)), rng.normal(size=20), rng.uniform(0, 2, (3, 2))

    gp, kept, write = C.GaussianProcess(x, y, 0.5, 1e-3), {}, C.Scratch.write

    def keep(self, df, name):
        kept[name] = write(self, df, name)
        return kept[name]

    monkeypatch.setattr(C.Scratch, "write", keep)
    cand = spark.createDataFrame([(i, place[i % 3].tolist()) for i in range(300)], "id long, p array<double>").repartition(1)
    got = {r.id: (r.mean, r.std) for r in C.gp_score(cand, gp).collect()}
    k = gp.kernel(place)
    want = np.stack([k @ gp.alpha, np.sqrt(1 - ((k @ gp.inverse.T) ** 2).sum(1))], 1)
    assert kept["places"].count() == 3
    assert len(got) == 300 and np.allclose([got[i] for i in range(300)], want[np.arange(300) % 3], atol=1e-9)


def test_symmetric_sums_each_pair_once(spark, monkeypatch):
    """Pairs are summed before they are turned round, and a filter of many terms writes its matrix once."""
    from fieldloom.operators import graph as G

    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (1, 2, 4.0), (3, 3, 9.0), (2, 5, 0.5)], "src long, dst long, weight double")
    s = G.symmetric(e)
    assert sorted(map(tuple, s.collect())) == [(1, 2, 7.0), (2, 1, 7.0), (2, 5, 0.5), (5, 2, 0.5)]
    assert "Union" not in s._jdf.queryExecution().optimizedPlan().toString()
    names, write = [], G.Scratch.write
    monkeypatch.setattr(G.Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    f = spark.createDataFrame([(1, 1.0), (2, 2.0), (5, -1.0)], "row long, value double")
    got = {r.row: r.value for r in G.chebyshev_filter(G.laplacian(e), f, [0.5, 0.3, 0.2], largest=2.0).collect()}
    assert names == ["matrix", "t1", "t2"]
    w = np.array([[0, 7, 0], [7, 0, 0.5], [0, 0.5, 0]])
    t1 = -w / np.sqrt(np.outer(w.sum(1), w.sum(1)))  # L - I
    x = np.array([1.0, 2.0, -1.0])
    want = 0.5 * x + 0.3 * t1 @ x + 0.2 * (2 * t1 @ t1 @ x - x)
    assert np.allclose([got[1], got[2], got[5]], want)


def test_radius_sums_and_pairs_by_tiles(spark, monkeypatch):
    """A dense cube in many tiles: pairs and cone sums equal plain loops, with nulls, and no plan joins pairs."""
    from fieldloom.operators import spatial as S

    monkeypatch.setattr(S, "BLOCK", 20)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(scale=0.05, size=(90, 2)), rng.uniform(-1, 1, (60, 2))])
    rho, dc = rng.uniform(1, 2, 150), -rng.uniform(1, 2, 150)
    rows = [(i, a.tolist(), None if i == 3 else float(r), float(g)) for i, (a, r, g) in enumerate(zip(x, rho, dc))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, [float("nan"), 0.0], 1.0, 1.0), (902, [float("inf"), 0.0], 1.0, 1.0)], "id long, p array<double>, rho double, dc double")
    dist = np.sqrt((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2)
    pairs = {(r.id, r.other): r.dist for r in S.radius_join(df, df, 0.1).collect()}
    assert pairs == {(i, j): dist[i, j] for i, j in zip(*np.nonzero(dist < 0.1))}
    w = np.maximum(0.1 - dist, 0)
    known = np.where(np.arange(150) == 3, 0.0, rho)
    density = S.density_filter(df, 0.1)
    got = {r.id: r.filtered for r in density.collect()}
    want = w @ known / w.sum(1)
    assert sorted(got) == list(range(150)) and all(np.isclose(got[i], want[i]) for i in got if got[i] is not None)
    assert [i for i in got if got[i] is None] == [i for i in range(150) if not (w[i] > 0)[np.arange(150) != 3].any()]
    plan = density._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan
    clean = df.where("rho is not null")
    keep = np.arange(150) != 3
    back = {r.id: r.filtered for r in S.sensitivity_filter(clean, 0.1).collect()}
    wk = w[np.ix_(keep, keep)]
    want = dict(zip(np.arange(150)[keep].tolist(), wk.T @ (dc * rho)[keep].__truediv__(wk.sum(1)) / rho[keep]))
    assert back.keys() == want.keys() and all(np.isclose(back[i], want[i]) for i in want)


def test_tree_moments_shift():
    from fieldloom.operators import treesum as T

    rng = np.random.default_rng(6)
    x, w, by = rng.normal(size=(20, 2)), rng.normal(size=(20, 2)), np.array([0.3, -0.7])
    for kernel in (T.Gaussian(0.7, 2, 2), T.Logarithm()):
        a = kernel.shift(kernel.moments(x, w).sum(0)[None], by[None])[0]
        assert np.allclose(a, kernel.moments(x + by, w).sum(0))
        v = np.array([[9.0, 7.0]])
        far = kernel.far(v, kernel.moments(0.1 * x, w).sum(0)[None])
        assert (np.abs(far - kernel.direct(v, 0.1 * x, w)) <= kernel.error(v, np.array([0.1 * np.linalg.norm(x, axis=1).max()])) * np.abs(w).sum() + 1e-12).all()


def test_shared_expressions_equal_columns(spark):
    """Each subexpression is computed once, and errors equal those of the trees as columns."""
    from fieldloom.operators import discovery as V
    from fieldloom.operators.regress import score_expressions

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 3)), 2)
    x[:5, 1] = 0.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, y double").repartition(3)
    trees = [V._random(rng, ["a", "b"], 3) for _ in range(60)]
    steps, roots = V.shared_graph(trees)
    assert len(roots) == 60 and len(steps) == len(set(map(str, steps))) < sum(t.size() for t in trees)
    same, at = V.shared_graph([V.Tree("+", [V.Tree("a"), V.Tree("b")]), V.Tree("+", [V.Tree("b"), V.Tree("a")]), V.Tree(1.0)])
    assert at[0] == at[1] and len(same) == 4
    got = V.mean_squared_errors(df, trees, "y")
    want = {r.name: r.mse for r in score_expressions(df, {str(k): (t.column(), t.size()) for k, t in enumerate(trees)}, "y").collect()}
    for k, g in enumerate(got):
        w = want[str(k)]
        assert (not np.isfinite(g) and (w is None or not np.isfinite(w))) or np.isclose(g, w, rtol=1e-9), str(trees[k])


def test_modes_by_part_broadcast_no_vectors(spark, monkeypatch):
    """The matrix is read in buckets, blocks of vectors are merged, and a part of two nodes keeps both modes."""
    from fieldloom.operators import spectral as Z

    monkeypatch.setattr(Z, "BUCKET", 20)
    plans, write = [], Z.Scratch.write
    monkeypatch.setattr(Z.Scratch, "write", lambda self, df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(self, df, name))
    e = [(i, (i + 1) % 30, 1.0, 0) for i in range(30)] + [(100, 101, 1.0, 1)]
    values, modes = Z.modes_by_part(spark.createDataFrame(e, "src long, dst long, weight double, part int"), 2, rounds=3, degree=6, tol=1e-12)
    assert np.allclose(values[1], [0, 2], atol=1e-9) and np.allclose(values[0], [0, 1 - np.cos(2 * np.pi / 30)], atol=1e-3)
    filtered = [p for n, p in plans if n == "filtered"]
    assert filtered and all("SortMergeJoin" in p and p.count("BroadcastExchange") <= 2 for p in filtered)  # the parts' bounds alone
    assert all("Bucketed: true" in p for p in filtered)
    assert not spark.catalog.listTables() or not any(t.name.startswith("fieldloom_") for t in spark.catalog.listTables())


def test_streaming_dmd_holds_one_entry_of_waiting_rows(spark, tmp_path, monkeypatch):
    """Waiting rows come and go by ranges of steps: what one call reads of them is bounded, the recursion is the ordered one."""
    import pandas as pd

    from fieldloom.streaming import incremental as I

    rng = np.random.default_rng(5)
    monkeypatch.setattr(I, "_STEPS", 16)
    monkeypatch.setattr(I, "_GATHER", 40)
    z = rng.normal(size=(400, 2))

    class Held(dict):
        getValue, updateValue, removeKey, clear = dict.__getitem__, dict.__setitem__, dict.__delitem__, dict.clear

    class One:
        value = None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    r, longest, read = I._Recursion(2, 0.99, 0, 10, False), [], I._Recursion._read
    monkeypatch.setattr(I._Recursion, "_read", lambda self, e: longest.append(len(got := read(self, e))) or got)
    r.timed, r.model, r.waiting = True, One(), Held()
    r.handle = type("H", (), {"listTimers": lambda self: [], "deleteTimer": lambda self, t: None, "registerTimer": lambda self, t: None})()
    order, out = np.r_[rng.permutation(np.arange(1, 400)), 0], []
    for part in np.array_split(order, 5):
        batches = [pd.DataFrame({"step": p, "at": p + 1, "x": list(z[p])}) for p in np.array_split(part, 4)]
        out += list(r.handleInputRows(("r",), iter(batches), Times()))
    assert [int(o.step[0]) for o in out][-1] == 399 and out[-1].waiting[0] == 0 and out[-1].late[0] == 0 and not r.waiting
    assert [int(o.waiting[0]) for o in out[:4]] == [80, 160, 240, 320] and max(longest) <= 16
    assert np.allclose(np.reshape(out[-1].operator[0], (2, 2)), recursion([(k, z[k]) for k in range(400)], 2), atol=1e-9)


def test_cells_meet_points_in_blocks(spark, monkeypatch):
    """Absent points leave places out, cells without points go, node rows are never grouped back, products need no matrix."""
    from fieldloom.operators import fields as A
    from fieldloom.operators import mesh as M

    monkeypatch.setattr(M, "CELLS", 2)
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0, None, 5.0), (0, 2, 1.0, 0.0, None, None), (0, 3, 0.0, 1.0, None, 7.0), (1, 1, 9.0, 9.0, None, 1.0)], "mesh long, point_id long, x double, y double, z double, u double")
    cells = spark.createDataFrame([(0, 0, "triangle", [3, 1, 2]), (0, 1, "triangle", [1, 8, 3]), (0, 5, "triangle", [8, 9, None]), (1, 2, "line", [1, 1])], "mesh long, cell_id long, cell_type string, nodes array<long>")
    fat = M.fat_cells(cells, pts, ("u",))
    got = {(r.mesh, r.cell_id): (r.nodes, r.xs, r.ys, r.zs, r.us) for r in fat.collect()}
    assert got == {(0, 0): ([3, 1, 2], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0] * 3, [7.0, 5.0, None]), (0, 1): ([1, 8, 3], [0.0, 0.0], [0.0, 1.0], [0.0] * 2, [5.0, 7.0]), (1, 2): ([1, 1], [9.0] * 2, [9.0] * 2, [0.0] * 2, [1.0] * 2)}
    plan = fat._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    one = M.fat_cells(cells.where("cell_id = 0"), pts.na.fill(2.0, ["u"]), ("u",))
    product = {r.row: r.value for r in A.stiffness_product(one).collect()}
    assert np.allclose([product[k] for k in (1, 2, 3)], [0.5, -1.5, 1.0])
    assert np.isclose(A.stiffness_energy(one).first()[0], np.sqrt(6.5))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Told its edges, a Laplacian has as many partitions as they need, and the same entries."""
    from fieldloom.operators import graph as G

    monkeypatch.setattr(G, "PART_EDGES", 10)
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in rng.integers(0, 12, (95, 2))], "src long, dst long, weight double")
    entries = lambda m: {(r.row, r.col): round(r.value, 9) for r in m.collect()}
    dealt = G.laplacian(e, rows=95)
    assert entries(dealt) == entries(G.laplacian(e))
    assert "hashpartitioning(low" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan


def test_triangles_leave_together_by_mesh(spark):
    """Corners are looked up without a join; faces and needed points are counted where the cells lie."""
    from fieldloom.jobs.tables import triangles
    from fieldloom.operators import mesh as M

    ids = [k for k in range(4900, 5160) if k != 5007] + [-1, 9_999]
    pts = spark.createDataFrame([(k // 5000, k) for k in [*ids, 4901]] + [(None, None)], "mesh long, point_id long")
    tri = triangles(pts)
    has = set(ids)
    base = sorted(k for k in has if k % 50 < 49 and k + 51 in has and k // 5000 == (k + 51) // 5000)
    got = {(r.mesh, r.cell_id): r.nodes for r in tri.where("cell_id <> 9802 and cell_id <> 9803").collect()}
    assert got == {(k // 5000, 2 * k + i): [[k, k + 1, k + 51], [k, k + 51, k + 50]][i] for k in base for i in (0, 1) if k != 4901}
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(tri) == exchanges(M.boundary_faces(tri)) == 1
    need = tri.select("mesh", F.floor(F.col("cell_id") / 16_384).alias("b"), F.explode("nodes").alias("point_id")).distinct()
    assert exchanges(need) == 1


def test_products_are_summed_in_batches(spark):
    """Products of cells that lack a corner or a value, and of a cell without area, against plain loops; no row for every node leaves a batch."""
    from fieldloom.operators import fields as A

    rows = [([1, 2, 3], [0.0, 2.0, 0.0], [0.0, 0.0, 1.0], [1.0, 4.0, 2.0]), ([2, 3, 4], [2.0, 0.0, 2.0], [0.0, 1.0, 3.0], [4.0, None, 5.0]), ([4, 5, 6], [1.0, 2.0], [1.0, 3.0], [5.0, 6.0]), ([7, 8, 9], [0.0, 1.0, 2.0], [0.0, 1.0, 2.0], [0.0, 1.0, 2.0])]
    fat = spark.createDataFrame(rows, "nodes array<long>, xs array<double>, ys array<double>, us array<double>").coalesce(1)
    want = dict.fromkeys(range(1, 7), 0.0)
    energy = 0.0
    for nodes, xs, ys, us in rows[:2]:
        e = [(xs[k] - xs[j], ys[k] - ys[j]) for j, k in ((1, 2), (2, 0), (0, 1))]
        area2 = abs(e[2][0] * -e[1][1] + e[2][1] * e[1][0])
        for i in range(3):
            v = sum((e[i][0] * e[j][0] + e[i][1] * e[j][1]) / (2 * area2) * us[j] for j in range(3) if us[j] is not None)
            want[nodes[i]] += v
            energy += v * us[i] if us[i] is not None else 0.0
    product = A.stiffness_product(fat)
    got = {r.row: r.value for r in product.collect()}
    assert set(got) == set(range(1, 10)) and np.allclose([got[k] for k in want], list(want.values()))
    assert np.isclose(A.stiffness_energy(fat.where("nodes[0] < 7")).first()[0], np.sqrt(energy))
    assert "MapInArrow" in product._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("told", ["in order", "scattered", ""])
def test_errors_of_cells_are_settled_where_they_lie(spark, monkeypatch, told):
    """Few cells travel a second time, and runs, rims and odd cells give the errors of a plain loop."""
    from fieldloom.operators import mesh as M

    rng, side, travel = np.random.default_rng(8), 24, []
    xy = np.array([(i % side, i // side) for i in range(side * side)], float) + rng.uniform(-0.2, 0.2, (side * side, 2))
    u = rng.uniform(size=(2, side * side))
    tri = [(p, p + 1, p + side + 1) if k else (p, p + side + 1, p + side) for p in range(side * (side - 1)) if p % side < side - 1 for k in (0, 1)]
    tri += [(0, 0, 1), (5, 6, 7, 8), (3, 4), (1, 2, None)]
    kinds = ["triangle"] * (len(tri) - 4) + ["triangle", "quad", "line", "triangle"]
    lost, blank = 100, 200  # a point that is absent, and one without a value
    pts = spark.createDataFrame([(m, i, float(x), float(y), 0.0, None if i == blank else float(u[m, i])) for m in (0, 1) for i, (x, y) in enumerate(xy) if i != lost], "mesh int, point_id long, x double, y double, z double, u double")
    cells = spark.createDataFrame([(m, c, k, list(n)) for m in (0, 1) for c, (n, k) in enumerate(zip(tri, kinds))], "mesh int, cell_id long, cell_type string, nodes array<long>")
    plain = M.gather

    def spy(cells, points, values, *more):
        if values[0].startswith("r"):
            travel.append(cells.count())
        return plain(cells, points, values, *more)

    monkeypatch.setattr(M, "gather", spy)
    monkeypatch.setattr(M, "CELLS", 700)
    fat = M.fat_cells(cells, pts, ("u",), about=True) if told else M.fat_cells(cells, pts, ("u",))
    got = {(r.mesh, r.cell_id): r.error for r in M.zz_error(fat.repartition(5) if told == "scattered" else fat).collect()}

    def size_of(n):
        e = lambda i, j: xy[n[j]] - xy[n[i]]
        area = lambda i, j, k: abs(e(i, j)[0] * e(i, k)[1] - e(i, j)[1] * e(i, k)[0]) / 2
        return {2: lambda: np.hypot(*e(0, 1)), 3: lambda: area(0, 1, 2), 4: lambda: area(0, 1, 2) + area(0, 2, 3)}[len(n)]()

    for m in (0, 1):
        grad, sums = {}, {}
        for c, n in enumerate(tri):
            whole = lost not in n and None not in n
            size = size_of(n) if whole else None
            if len(n) == 3 and whole and size and blank not in n:
                grad[c] = np.linalg.solve([xy[n[1]] - xy[n[0]], xy[n[2]] - xy[n[0]]], [u[m, n[1]] - u[m, n[0]], u[m, n[2]] - u[m, n[0]]])
            for p in n:
                w, g = sums.get(p, (0.0, None))
                sums[p] = (w + (size or 0.0), ((0 if g is None else g) + size * grad[c]) if c in grad else g)
        for c, n in enumerate(tri):
            around = [sums[p][1] / sums[p][0] for p in n if p is not None and sums[p][1] is not None]
            want = np.linalg.norm(grad[c] - np.mean(around, 0)) if c in grad and around else None
            assert (got[(m, c)] is None) == (want is None), (c, n)
            assert want is None or abs(got[(m, c)] - want) < 1e-9, (c, n)
    assert len(got) == 2 * len(tri)
    assert travel[0] == len(got) if not told else told == "scattered" or travel[0] < 0.5 * len(got)


@pytest.mark.parametrize("name", ["mesh_zz_error", "mesh_marked_cells"])
def test_queries_of_errors_send_few_cells_twice(spark, monkeypatch, name):
    from fieldloom.jobs.mesh_queries import QUERIES
    from fieldloom.operators import mesh as M

    plain, sent = M.gather, []

    def spy(cells, points, values, *more):
        sent.append(cells.count())
        return plain(cells, points, values, *more)

    monkeypatch.setattr(M, "gather", spy)
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert len(sent) == 2 and sent[1] < 0.1 * sent[0]


def test_gradients_and_volumes_of_all_kinds(spark):
    """Linear fields have their own gradient, volumes are those of the column form."""
    from fieldloom.operators import mesh as M

    rng, corners = np.random.default_rng(9), {"line": 2, "triangle": 3, "quad": 4, "tet": 4, "hex": 8, "prism": 6}
    rows = []
    for c, (kind, n) in enumerate([*corners.items()] * 5):
        x = rng.uniform(size=(n, 3)) * (1, 1, kind not in ("line", "triangle", "quad"))
        rows.append((0, c, kind, list(range(n)), *x.T.tolist(), (x @ (2.0, -3.0, 5.0)).tolist()))
    fat = spark.createDataFrame(rows, "mesh long, cell_id long, cell_type string, nodes array<long>, xs array<double>, ys array<double>, zs array<double>, us array<double>")
    want = {r.cell_id: r.volume for r in M.cell_volumes(fat).collect()}
    for r in M.element_gradient(fat).collect():
        kind = rows[r.cell_id][2]
        assert abs(r.volume - want[r.cell_id]) < 1e-12
        g = {"triangle": (2, -3, 0), "tet": (2, -3, 5)}.get(kind)
        assert (r.gx, r.gy, r.gz) == (None, None, None) if g is None else np.allclose((r.gx, r.gy, r.gz), g, atol=1e-8)
