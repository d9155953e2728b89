"""Processes on all training rows, dealt matrices and radius tiles, against plain loops."""

import numpy as np
import pytest


def plain_process(x, y, q, length, noise):
    """One dense matrix; its factor is inverted by products, since large threaded solves may not return in a forked driver."""
    from fieldloom.operators.process import lower_inverse

    kern = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(2) / length**2)
    k, c = kern(x, x) + noise * np.eye(len(x)), kern(q, x)
    inv = lower_inverse(np.linalg.cholesky(k))
    assert np.allclose(inv @ k @ inv.T, np.eye(len(x)), atol=1e-6)
    v, z = c @ inv.T, inv @ y
    log = -0.5 * z @ z + np.log(np.diag(inv)).sum() - len(y) / 2 * np.log(2 * np.pi)
    return v @ z, np.sqrt(np.maximum(1 - (v * v).sum(1), 1e-10)), log


@pytest.mark.parametrize("axis", [0, 1])
def test_process_takes_every_training_row(spark, axis):
    """Many slabs, gaps, copies and rows that observe nothing: every row counts, as in one dense solve."""
    from fieldloom.operators import surrogate as C
    from fieldloom.operators.process import SlabProcess

    rng = np.random.default_rng(21 + axis)
    length, noise = 0.4, 1e-3
    x = rng.uniform(0, 1, (420, 2)) * (90.0, 3.0)
    x[x[:, 0] > 60, 0] += 500.0
    x = np.vstack([x, x[:30], x[:10]])[:, [axis, 1 - axis]]
    y = np.sin(x.sum(1)) + 0.1 * rng.normal(size=len(x))
    q = np.vstack([rng.uniform(0, 1, (150, 2)) * (90.0, 3.0), [[555.0, 1.0], [300.0, 1.0], [-1.0, 0.0], [590.5, 2.0]]])[:, [axis, 1 - axis]]
    rows = [(r.tolist(), float(v)) for r, v in zip(x, y)]
    train = spark.createDataFrame([*rows, (None, 1.0), ([1.0, None], 2.0), ([1.0, 1.0], None), ([float("nan"), 0.0], 1.0)], "p array<double>, y double")
    cand = spark.createDataFrame([*((i, r.tolist()) for i, r in enumerate(q)), (900, q[0].tolist()), (901, [float("nan"), 0.0])], "id long, p array<double>")
    p = SlabProcess(train, length, noise)
    assert p.axis == axis and p.runs >= 3
    got = {r.id: (r.mean, r.std) for r in C.gp_predict(cand, train, length, noise).collect()}
    mean, std, log = plain_process(x, y, q, length, noise)
    assert len(got) == len(q) + 2 and got[900] == got[0] and np.isnan(got[901]).all() and got[len(q) - 3] == (0.0, 1.0)
    assert np.allclose([got[i] for i in range(len(q))], np.stack([mean, std], 1), atol=1e-8)
    assert np.isclose(C.gp_log_marginal(train, length, noise), log)


def test_process_draws_no_sample(spark, monkeypatch):
    """More training rows than a process of one matrix takes: the fit is no draw of them."""
    from fieldloom.operators import surrogate as C

    n = C.MAX_TRAIN + 1_500
    x = np.stack([np.arange(n) / 10.0, np.arange(n) * 7 % 25], 1)
    y = np.cos(np.arange(n) * 0.7)
    train = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "p array<double>, y double")
    at = np.array([5, 3000, n - 1])
    q = x[at] + 0.3
    got = {r.id: (r.mean, r.std) for r in C.gp_predict(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "id long, p array<double>"), train).collect()}
    for i, k in enumerate(at):
        near = slice(max(0, k - 700), k + 700)  # what lies further off does not reach
        mean, std, _ = plain_process(x[near], y[near], q[i : i + 1], 1.0, 1e-6)
        assert np.allclose(got[i], (mean[0], std[0]), atol=1e-6)


@pytest.mark.parametrize("hubs", ["low", "high"])
def test_dealt_matrix_in_many_buckets(spark, monkeypatch, hubs):
    """Products in nine buckets of several packed rows, hubs on either side, ids that the vector lacks and unknown values."""
    from fieldloom.operators import dealt as D
    from fieldloom.operators import graph as G

    monkeypatch.setattr(D, "ENTRIES", 100)
    monkeypatch.setattr(D, "PIECE", 30)
    rng = np.random.default_rng(17)
    n, few = 90, 6
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, few, 400), rng.integers(few, n, 400))}
    name = (lambda i: i - 3) if hubs == "low" else (lambda i: 1_000 - 7 * i)
    m = np.zeros((n, n))
    for a, b in pairs:
        m[a, b], m[b, a] = rng.normal(size=2)  # not symmetric
    m += np.diag(rng.normal(size=n))
    rows = [(name(i), name(j), float(m[i, j])) for i, j in np.argwhere(m).tolist()]
    x = rng.normal(size=n + 2)
    f = [(name(i), float(v)) for i, v in enumerate(x) if i not in (2, 40, 41)] + [(name(40), None)]  # n and n + 1 are not in the matrix
    lap = spark.createDataFrame(rows, "row long, col long, value double")
    theta = [0.4, -0.3, 0.25, 0.1]
    got = {r.row: r.value for r in G.chebyshev_filter(lap, spark.createDataFrame(f, "row long, value double"), theta, 2.5).collect()}
    full, x = np.zeros((n + 2, n + 2)), x.copy()
    full[:n, :n] = m
    here = np.array([i not in (2, 40, 41) for i in range(n + 2)])
    full, x = full * here * here[:, None], x * here
    t = [x, 2 / 2.5 * full @ x - x]
    for _ in range(2):
        t.append(2 * (2 / 2.5 * full @ t[-1] - t[-1]) - t[-2])
    want = sum(c * v for c, v in zip(theta, t))
    assert set(got) == {name(i) for i in range(n + 2) if i not in (2, 41)} and got.pop(name(40)) is None
    assert all(np.isclose(got[name(i)], want[i]) for i in range(n + 2) if here[i])


def test_products_do_not_shuffle_the_matrix(spark, monkeypatch):
    """The matrix's entries leave no exchange in a product's plan: only packed values and sums travel."""
    from fieldloom.operators import dealt as D
    from fieldloom.operators import graph as G

    monkeypatch.setattr(D, "ENTRIES", 50)
    plans, write = [], G.Scratch.write
    monkeypatch.setattr(G.Scratch, "write", lambda self, df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(self, df, name))
    e = spark.createDataFrame([(i % 7, 100 + i, 1.0 + i % 3) for i in range(120)], "src long, dst long, weight double")
    f = spark.createDataFrame([(i, float(i)) for i in (*range(7), *range(100, 220))], "row long, value double")
    assert G.chebyshev_filter(G.laplacian(e), f, [0.5, 0.3, 0.2, 0.1]).count() == 127
    plan = dict(plans)["t3"].splitlines()
    exchanged = [k for k, line in enumerate(plan) if "Exchange" in line]
    # An exchange's columns are those of the lines below it up to the next scan or function.
    assert exchanged and not any("value#" in plan[k + 1] or "col#" in plan[k + 1] for k in exchanged)
    assert sum("FlatMapCoGroupsInArrow" in line for line in plan) == 2


def test_radius_tiles_are_few_and_whole(spark, monkeypatch):
    """A dense cube is few large tiles, so rows are hardly repeated; small ones give the same pairs and sums."""
    from fieldloom.operators import spatial as S

    rng = np.random.default_rng(23)
    x = np.vstack([rng.uniform(0, 0.09, (6_500, 2)), rng.uniform(-1, 1, (100, 2))])
    df = spark.createDataFrame([(i, p, 1.0 + i % 3) for i, p in enumerate(x.tolist())], "id long, p array<double>, rho double")
    tiles, keys = S._tiles(df.select("id", "p"), df.select("id", "p"), 0.1, 2)
    cubes = {tuple(c) for c in np.floor(x / 0.1).astype(int).tolist()}
    met = sum((c[0] + i, c[1] + j) in cubes for c in np.floor(x / 0.1).astype(int).tolist() for i in (-1, 0, 1) for j in (-1, 0, 1))
    assert tiles.count() == met + len(x)  # each row once for each cube that it meets, and once as a member
    few = df.where("id % 11 = 0")
    pairs = lambda: {(r.id, r.other): r.dist for r in S.radius_join(few, few, 0.02).collect()}
    sums = lambda: {r.id: r.filtered for r in S.density_filter(few, 0.02).collect()}
    want = (pairs(), sums())
    y, ids = x[::11], np.arange(0, len(x), 11)
    dist = np.sqrt((y[:, None, 0] - y[None, :, 0]) ** 2 + (y[:, None, 1] - y[None, :, 1]) ** 2)
    assert want[0] == {(int(ids[i]), int(ids[j])): dist[i, j] for i, j in zip(*np.nonzero(dist < 0.02))}
    monkeypatch.setattr(S, "TILE", 20)
    monkeypatch.setattr(S, "WORK", 1_000)
    monkeypatch.setattr(S, "STEP", 64)
    got = (pairs(), sums())
    assert got[0] == want[0] and got[1].keys() == want[1].keys() and all(np.isclose(got[1][i], want[1][i]) for i in got[1])
