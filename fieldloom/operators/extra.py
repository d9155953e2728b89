"""Pairs of snapshots, observation misfit, optimality updates, frames, hierarchies and grouped models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import graph as G
from fieldloom.operators import regress as E
from fieldloom.operators.mesh import fat_cells, volume
from fieldloom.operators.spatial import idw_interpolate, knn_join
from fieldloom.sources.scratch import Scratch


def pair_snapshots(snapshots: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """Each value with the next step's of the same key; steps must be consecutive."""
    w = Window.partitionBy(*by).orderBy(step)
    out = snapshots.select(*by, step, F.col(value).alias("x"), F.lead(value).over(w).alias("y"), F.lead(step).over(w).alias("__n"))
    return out.where(F.col("__n") == F.col(step) + 1).drop("__n")


def match_observations(points: DataFrame, values: DataFrame, sensors: DataFrame, k: int = 4) -> DataFrame:
    """Half the summed squared residual of interpolated values at ``sensors(id, p, observed)``."""
    pred = idw_interpolate(points, values, sensors.select("id", "p"), k)
    r = F.col("value") - F.col("observed")
    return pred.join(sensors.select("id", "observed"), "id").agg(F.count("*").alias("n"), (0.5 * F.sum(r * r)).alias("misfit"))


def neumann_load(edges: DataFrame, points: DataFrame, flux: Column) -> DataFrame:
    """Flux times edge length, half to each end, summed by node: ``edges(mesh, a, b)``."""
    end = lambda k: points.select("mesh", F.col("point_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    e = edges.join(end("a"), ["mesh", "a"]).join(end("b"), ["mesh", "b"])
    half = flux * F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2) / 2
    return e.select("mesh", F.explode(F.array("a", "b")).alias("point_id"), half.alias("v")).groupBy("mesh", "point_id").agg(F.sum("v").alias("load"))


def face_load(faces: DataFrame, points: DataFrame, flux: Column) -> DataFrame:
    """Flux times the measure of each face ``mesh, face_id, nodes`` (an edge, triangle or quad in space), shared by its nodes and summed."""
    kind = F.element_at(F.create_map(F.lit(2), F.lit("line"), F.lit(3), F.lit("triangle"), F.lit(4), F.lit("quad")), F.size("nodes"))
    fat = fat_cells(faces.select("mesh", F.col("face_id").alias("cell_id"), kind.alias("cell_type"), "nodes"), points)
    share = volume() * flux / F.size("nodes")
    return fat.select("mesh", F.explode("nodes").alias("point_id"), share.alias("v")).groupBy("mesh", "point_id").agg(F.sum("v").alias("load"))


def oc_update(cells: DataFrame, target: float, move: float = 0.2, floor: float = 1e-3, rounds: int = 4, width: int = 32) -> DataFrame:
    """Optimality-criteria densities of ``cells(id, rho, dc, volume)`` at a volume target.

    The multiplier is bracketed by ``width`` candidates at once: a few scans
    instead of forty bisections.
    """
    def new(lam) -> Column:
        x = F.col("rho") * F.sqrt(F.greatest(-F.col("dc"), F.lit(0.0)) / (F.lit(lam) * F.col("volume")))
        return F.greatest(F.lit(floor), F.greatest(F.col("rho") - move, F.least(F.lit(1.0), F.least(F.col("rho") + move, x))))

    total = cells.agg(F.sum("volume")).first()[0] or 0.0
    lo, hi = 1e-12, 1e12
    for _ in range(rounds):
        lams = np.geomspace(lo, hi, width)
        got = cells.agg(*[F.sum(new(float(v)) * F.col("volume")).alias(f"v{i}") for i, v in enumerate(lams)]).first()
        above = [i for i in range(width) if (got[i] or 0.0) > target * total]
        i = max(above) if above else 0
        lo, hi = lams[i], lams[min(i + 1, width - 1)]
    return cells.select("id", new(float(np.sqrt(lo * hi))).alias("rho"))


def heat_diffuse(lap: DataFrame, f: DataFrame, t: float, terms: int = 12, largest: float = 2.0) -> DataFrame:
    """exp(-t L) f by Chebyshev coefficients from the driver; no eigenvectors."""
    k = 4 * terms
    x = np.cos(np.pi * (np.arange(k) + 0.5) / k)
    y = np.exp(-t * largest / 2 * (x + 1))
    theta = [float((2 - (j == 0)) / k * (y * np.cos(j * np.arccos(x))).sum()) for j in range(terms)]
    return G.chebyshev_filter(lap, f, theta, largest)


def unpool(coarse: DataFrame, labels: DataFrame) -> DataFrame:
    """Each fine node takes its part's value: ``id, f`` from ``coarse(part, f)``."""
    return labels.join(coarse, "part").select("id", "f")


def build_hierarchy(edges: DataFrame, levels: int, least: int = 10, nodes: DataFrame | None = None, rows: int | None = None) -> list:
    """Labels ``id, part`` of each level of repeated matching, written level by level.

    With ``nodes(id, f)`` a level is (labels, its pooled nodes ``id, f, size``, its
    edges); the mean of a part weighs all its original nodes alike.  ``rows`` is
    about how many edges there are (``graph.symmetric``).
    """
    tmp, out, now = Scratch(edges.sparkSession, "hierarchy"), [], edges
    values = nodes.select("id", "f", F.lit(1).cast("long").alias("size")) if nodes is not None else None
    for k in range(levels):
        ids = now.select(F.col("src").alias("id")).unionByName(now.select(F.col("dst").alias("id"))).distinct()
        if len(ids.head(least)) < least:
            break
        lab = tmp.write(ids.join(G.match_pool(now, rows if k == 0 else now.count()), "id", "left").select("id", F.coalesce("part", "id").alias("part")), f"labels{k}")
        now = tmp.write(G.contract_graph(now, lab), f"edges{k}")
        if values is None:
            out.append(lab)
        else:
            pooled = values.join(lab, "id").groupBy("part").agg((F.sum(F.col("f") * F.col("size")) / F.sum("size")).alias("f"), F.sum("size").alias("size"))
            values = tmp.write(pooled.withColumnRenamed("part", "id"), f"nodes{k}")
            out.append((lab, values, now))
        if now.isEmpty():
            break
    return out


def kmeans_pool(nodes: DataFrame, edges: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels ``id, part``, clusters ``part, size, p, f`` (mean position and value) and coarse edges of ``nodes(id, p, f)``.

    Seeded k-means of the positions; a cluster's mean position is that of its
    members.
    """
    v = nodes.withColumn("features", array_to_vector("p"))
    lab = Scratch(nodes.sparkSession, "kmeans").write(KMeans(k=k, seed=seed, featuresCol="features", predictionCol="part").fit(v).transform(v).select("id", "part"), "labels")
    j = nodes.join(lab, "id")
    d = len(nodes.select("p").first().p) if not nodes.isEmpty() else 0
    clusters = j.groupBy("part").agg(F.count("*").alias("size"), F.array(*[F.avg(F.col("p")[i]) for i in range(d)]).alias("p"), F.avg("f").alias("f"))
    return lab, clusters, G.coarse_edges(edges, lab)


def local_frames(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Plane frames: the unit mean neighbour direction and its normal; isolated nodes keep the axes."""
    a = nodes.select(F.col("id").alias("src"), F.col("x").alias("xs"), F.col("y").alias("ys"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("xt"), F.col("y").alias("yt"))
    m = edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg(F.col("xt") - F.col("xs")).alias("dx"), F.avg(F.col("yt") - F.col("ys")).alias("dy"))
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    j = nodes.select("id").join(m, "id", "left")
    ok = n > 1e-10
    return j.select("id", F.when(ok, F.col("dx") / n).otherwise(1.0).alias("ux"), F.when(ok, F.col("dy") / n).otherwise(0.0).alias("uy")).select("id", "ux", "uy", (-F.col("uy")).alias("vx"), F.col("ux").alias("vy"))


def frames_3d(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, r``: the nine entries (row by row) of a frame whose columns are the axes of the neighbours' scatter, widest first.

    The six sums of products are grouped; many 3 x 3 problems are then solved at
    once.  Fewer than three neighbours give the unit frame; each axis is turned
    so that its largest entry is positive.
    """
    end = lambda k: nodes.select(F.col("id").alias(k), *[F.col(c).alias(c + k) for c in "xyz"])
    e = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    d = {c: F.col(c + "dst") - F.col(c + "src") for c in "xyz"}
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *[F.sum(d[a] * d[b]).alias(a + b) for a, b in pairs])
    rows = nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.array(*[F.coalesce(a + b, F.lit(0.0)) for a, b in pairs]).alias("s"))

    def solve(batches):
        for b in batches:
            n, s = np.asarray(b.column("n")), np.asarray(b.column("s").flatten(), float).reshape(b.num_rows, 6)
            full = s[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            r = np.linalg.eigh(full)[1][:, :, ::-1]
            top = np.take_along_axis(r, np.abs(r).argmax(1)[:, None], 1)
            r = np.where((n >= 3)[:, None, None], r * np.where(top < 0, -1.0, 1.0), np.eye(3))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(r.reshape(-1, 9)), pa.list_(pa.float64()))], names=["id", "r"])

    return rows.mapInArrow(solve, f"id {dict(nodes.dtypes)['id']}, r array<double>")


def frames_from_normals(nodes: DataFrame) -> DataFrame:
    """``id, r``: frames of two tangents and the unit normal of ``nodes(id, nx, ny, nz)``; no solve is needed."""
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) + 1e-8
    n = [F.col(c) / size for c in ("nx", "ny", "nz")]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    pick = F.abs(n[0]) < 0.9
    t = [F.when(pick, a).otherwise(b) for a, b in zip(cross(n, [F.lit(1.0), F.lit(0.0), F.lit(0.0)]), cross(n, [F.lit(0.0), F.lit(1.0), F.lit(0.0)]))]
    length = F.sqrt(t[0] ** 2 + t[1] ** 2 + t[2] ** 2) + 1e-8
    t = [v / length for v in t]
    u = cross(n, t)
    return nodes.select("id", F.array(t[0], u[0], n[0], t[1], u[1], n[1], t[2], u[2], n[2]).alias("r"))


def plane_frames(frames: DataFrame) -> DataFrame:
    """``id, r`` (four entries, row by row) of the plane frames of ``local_frames``."""
    return frames.select("id", F.array("ux", "vx", "uy", "vy").alias("r"))


def edge_transport(frames: DataFrame, edges: DataFrame, dim: int = 2) -> DataFrame:
    """``src, dst, t``: the target's frame in the source's, R_src' R_dst row by row, of frames ``id, r``."""
    side = lambda k: frames.select(F.col("id").alias(k), F.col("r").alias(f"r_{k}"))
    e = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    t = [sum((F.col("r_src")[m * dim + i] * F.col("r_dst")[m * dim + j] for m in range(1, dim)), F.col("r_src")[i] * F.col("r_dst")[j]) for i in range(dim) for j in range(dim)]
    return e.select("src", "dst", F.array(*t).alias("t"))


def edge_harmonics(edges: DataFrame, nodes: DataFrame, radial: int = 4) -> DataFrame:
    """Length, radial decays exp(-k r) and plane harmonics of each edge's direction."""
    a = nodes.select(F.col("id").alias("src"), F.col("x").alias("xs"), F.col("y").alias("ys"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("xt"), F.col("y").alias("yt"))
    dx, dy = F.col("xt") - F.col("xs"), F.col("yt") - F.col("ys")
    r = F.sqrt(dx * dx + dy * dy)
    e = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", r.alias("r"), (dx / r).alias("c"), (dy / r).alias("s"))
    return e.select("src", "dst", "r", *[F.exp(-k * F.col("r")).alias(f"radial{k}") for k in range(1, radial + 1)], "c", "s", (F.col("c") ** 2 - F.col("s") ** 2).alias("c2"), (2 * F.col("c") * F.col("s")).alias("s2"))


def edge_harmonics_3d(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, radial, sh``: ten decays exp(-s r), s from 0 to 5, and the nine harmonics of degree two at most.

    An edge without length has the constant harmonic alone.
    """
    end = lambda k: nodes.select(F.col("id").alias(k), *[F.col(c).alias(c + k) for c in "xyz"])
    e = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    e = e.select("src", "dst", *[(F.col(c + "dst") - F.col(c + "src")).alias(c) for c in "xyz"]).withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    x, y, z = (F.when(F.col("r") > 1e-8, F.col(c) / F.col("r")).otherwise(0.0) for c in "xyz")
    some = F.when(F.col("r") > 1e-8, 1.0).otherwise(0.0)
    sh = [F.lit(1.0), y, z, x, x * y, y * z, 3 * z * z - some, x * z, x * x - y * y]
    return e.select("src", "dst", F.array(*[F.exp(-5 * k / 9 * F.col("r")) for k in range(10)]).alias("radial"), F.array(*sh).alias("sh"))


def edge_max_aggregate(nodes: DataFrame, k: int) -> DataFrame:
    """Largest difference to the value of one of the k nearest points: ``nodes(id, p, f)``."""
    near = knn_join(nodes, nodes, k)
    j = near.join(nodes.select("id", F.col("f").alias("fi")), "id").join(nodes.select(F.col("id").alias("other"), F.col("f").alias("fj")), "other")
    return j.groupBy("id").agg(F.max("fi").alias("f"), F.max(F.col("fj") - F.col("fi")).alias("rise"))


def sindy_fit_by(df: DataFrame, terms: Sequence[tuple[str, Column]], target: str, key: str, threshold: float = 0.1) -> DataFrame:
    """One sparse model for each key: the sums of a key are one small group, solved where they meet."""
    cols, p, names = [c for _, c in terms] + [F.col(target)], len(terms), [t for t, _ in terms]
    sums = E.normal_equations(df, cols, [key])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((p + 1, p + 1))
        g[pdf.i, pdf.j] = pdf.s
        g = np.triu(g) + np.triu(g, 1).T
        return pd.DataFrame({key: [pdf[key].iloc[0]] * p, "term": names, "coef": E.stlsq(g, p, threshold)[:, 0]})

    return sums.groupBy(key).applyInPandas(solve, f"{key} {dict(sums.dtypes)[key]}, term string, coef double")


def fit_transfer(pairs: DataFrame, low: str, high: str, degree: int = 1) -> Column:
    """Least-squares map from low to high fidelity as a column of the same features."""
    terms = [("1", F.lit(1.0))] + [(f"l^{k}", F.col(low) ** k) for k in range(1, degree + 1)]
    c, _ = E.sindy_fit(pairs, terms, [high], threshold=0.0)
    return E.predict(terms, c[:, 0])


def sindy_ensemble(df: DataFrame, terms: Sequence[tuple[str, Column]], target: str, id_col: str, n_models: int, threshold: float, seed: int = 0) -> DataFrame:
    """``term, mean, std, inclusion, consensus`` of the coefficients over bootstraps, all in one pass.

    Each row's Poisson(1) weight of a model depends on seed, id and model alone;
    weights are drawn inside the Arrow batch, so rows are not multiplied by models.
    ``consensus`` is the mean where at least half of the models hold the term.
    """
    fits = bootstrap_fits(df, terms, target, id_col, n_models, threshold, seed)
    g = fits.groupBy("term").agg(F.avg("coef").alias("mean"), F.stddev_pop("coef").alias("std"), F.avg(F.when(F.col("coef") != 0, 1.0).otherwise(0.0)).alias("inclusion"))
    return g.withColumn("consensus", F.when(F.col("inclusion") >= 0.5, F.col("mean")).otherwise(0.0))


def bootstrap_weights(ids: np.ndarray, model: int) -> np.ndarray:
    """Poisson(1) counts from hashed ids: the number of the distribution's steps that a uniform draw exceeds."""
    x = ids.astype(np.uint64) + np.uint64((2 * model + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    p = np.exp(-1) / np.cumprod([1.0, *range(1, 12)])
    return np.searchsorted(np.cumsum(p), u, "right").astype(float)


def bootstrap_fits(df: DataFrame, terms: Sequence[tuple[str, Column]], target: str, id_col: str, n_models: int, threshold: float, seed: int = 0) -> DataFrame:
    """``model, term, coef`` of every bootstrap."""
    n, names = len(terms), [t for t, _ in terms]
    src = df.select(F.array(*[c.cast("double") for _, c in terms], F.col(target).cast("double")).alias("t"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    iu, ju = np.triu_indices(n + 1)

    def run(batches):
        total = np.zeros((n_models, len(iu)))
        for b in batches:
            if b.num_rows:
                t, h = E.dense(b.column("t"), n + 1), np.asarray(b.column("h")).view(np.uint64)
                ok = np.isfinite(t).all(1)
                t, h = t[ok], h[ok]
                for m in range(n_models):
                    total[m] += ((t * bootstrap_weights(h, m)[:, None]).T @ t)[iu, ju]
        out = {"model": np.repeat(np.arange(n_models), len(iu)), "i": np.tile(iu, n_models), "j": np.tile(ju, n_models)}
        yield pa.RecordBatch.from_pydict({**{k: pa.array(v, pa.int32()) for k, v in out.items()}, "s": pa.array(total.ravel())})

    sums = src.mapInArrow(run, "model int, i int, j int, s double").groupBy("model", "i", "j").agg(F.sum("s").alias("s"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((n + 1, n + 1))
        g[pdf.i, pdf.j] = pdf.s
        g = np.triu(g) + np.triu(g, 1).T
        return pd.DataFrame({"model": [pdf.model.iloc[0]] * n, "term": names, "coef": E.stlsq(g, n, threshold)[:, 0]})

    return sums.groupBy("model").applyInPandas(solve, "model int, term string, coef double")


def ensemble_predict(df: DataFrame, terms: Sequence[tuple[str, Column]], fits: DataFrame) -> DataFrame:
    """The rows with ``predicted`` and ``spread``: mean and deviation over the bootstraps' predictions.

    Both follow from the coefficients' mean and covariance: a few numbers.
    """
    c = fits.toPandas().pivot(index="model", columns="term", values="coef")[[t for t, _ in terms]].to_numpy()  # models x terms
    mean, cov = c.mean(0), np.cov(c.T, bias=True).reshape(len(terms), -1)
    cols = [col for _, col in terms]
    var = F.lit(0.0)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            var = var + float(cov[i, j]) * a * b
    return df.withColumn("predicted", E.predict(terms, mean)).withColumn("spread", F.sqrt(F.greatest(var, F.lit(0.0))))


def _draws(seed: np.ndarray, step: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal draws (n, dims) and one uniform draw of each chain, from its seed and the step alone."""
    x = seed + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    out = []
    for _ in range(2 * dims + 1):
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        x = x ^ (x >> np.uint64(31))
        out.append(((x >> np.uint64(11)) + 0.5) / float(1 << 53))
    u = np.stack(out[:-1], 1)
    return np.sqrt(-2 * np.log(u[:, :dims])) * np.cos(2 * np.pi * u[:, dims:]), out[-1]


def metropolis(problems: DataFrame, columns: Sequence[str], log_density: Callable, start: Callable, width: Callable, n_chains: int, steps: int, adapt: int = 0) -> DataFrame:
    """``key, chain, step, theta, logp, accepted``: Metropolis chains of any model over sufficient statistics.

    A row ``key, columns`` of ``problems`` is one posterior.  ``log_density(theta,
    stats)`` takes (n, d) parameters and a dictionary of n statistics each and
    gives n numbers; ``start(stats)`` gives (n, d) parameters, ``width(stats)``
    their proposal widths.  All chains of a batch step together; a chain's draws
    follow a hash of key and chain.  For the first ``adapt`` steps the width grows or
    falls by a tenth after each hundred, as more or fewer than 0.44 (one
    parameter) or 0.3 of them were accepted.
    """
    rows = problems.select("key", *columns).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(n_chains - 1)))).withColumn("seed", F.xxhash64("key", "chain"))

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), 500):
                pdf = whole.iloc[at : at + 500]
                stats, seed = {c: pdf[c].to_numpy(float) for c in columns}, pdf.seed.to_numpy(np.int64).view(np.uint64)
                x, scale = np.array(start(stats), float), np.array(width(stats), float)
                n, d = x.shape
                lp, acc, recent = log_density(x, stats), np.zeros(n), np.zeros(n)
                theta, kept = np.empty((steps, n, d)), np.empty((2, steps, n))
                for k in range(steps):
                    z, u = _draws(seed, k, d)
                    y = x + scale * z
                    ly = log_density(y, stats)
                    yes = np.log(u) < ly - lp
                    x, lp, acc, recent = np.where(yes[:, None], y, x), np.where(yes, ly, lp), acc + yes, recent + yes
                    theta[k], kept[:, k] = x, (lp, acc / (k + 1))
                    if k < adapt and k % 100 == 99:
                        scale, recent = scale * np.where(recent > (44 if d == 1 else 30), 1.1, 0.9)[:, None], np.zeros(n)
                yield pd.DataFrame({"key": np.tile(pdf.key.to_numpy(), steps), "chain": np.tile(pdf.chain.to_numpy(), steps), "step": np.repeat(np.arange(steps, dtype=np.int32), n), "theta": list(theta.reshape(-1, d)), "logp": kept[0].ravel(), "accepted": kept[1].ravel()})

    return rows.mapInPandas(run, f"key {dict(problems.dtypes)['key']}, chain int, step int, theta array<double>, logp double, accepted double")


def mcmc_chains(problems: DataFrame, n_chains: int, steps: int, width: float = 0.5, adapt: int = 0) -> DataFrame:
    """The same for the mean of each key's data from its sums ``key, n, total, square`` (unit noise, a wide prior); ``theta`` is one number."""
    chains = metropolis(
        problems,
        ["n", "total", "square"],
        lambda m, s: -0.5 * (s["square"] - 2 * m[:, 0] * s["total"] + s["n"] * m[:, 0] ** 2) - 0.005 * m[:, 0] ** 2,
        lambda s: (s["total"] / np.maximum(s["n"], 1))[:, None],
        lambda s: (width / np.sqrt(np.maximum(s["n"], 1)))[:, None],
        n_chains,
        steps,
        adapt,
    )
    return chains.withColumn("theta", F.col("theta")[0])


def posterior_summary(chains: DataFrame, burn: int) -> DataFrame:
    """Mean, deviation, mode and acceptance by key after ``burn`` steps of each chain."""
    return chains.where(F.col("step") >= burn).groupBy("key").agg(F.avg("theta").alias("mean"), F.stddev_pop("theta").alias("std"), F.max_by("theta", "logp").alias("map"), F.avg("accepted").alias("accepted"))


def enki_gain(ensemble: DataFrame, noise: float) -> DataFrame:
    """Kalman gain of scalar parameter and prediction from ensemble covariances (n - 1 across, n for the prediction)."""
    return ensemble.agg((F.covar_samp("theta", "g") / (F.var_pop("g") + noise * noise)).alias("gain"))


def enki_step(ensemble: DataFrame, observed: float, noise: float, seed: int = 0) -> DataFrame:
    """Members moved by the gain towards the observation, perturbed by id-seeded noise."""
    return ensemble.crossJoin(F.broadcast(enki_gain(ensemble, noise))).select("id", (F.col("theta") + F.col("gain") * (observed + noise * _normal(seed, 0) - F.col("g"))).alias("theta"))  # one row is broadcast


def _normal(seed: int, k: int) -> Column:
    """A standard normal draw that depends on seed, id and k alone."""
    u = lambda j: (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(2 * k + j)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))


def enki_step_vector(ensemble: DataFrame, observed: Sequence[float], noise: float, params: int, seed: int = 0) -> DataFrame:
    """The same for arrays ``theta`` (of ``params``) and ``g``: covariances over n - 1 from one pass of sums."""
    q = len(observed)
    cols = [F.lit(1.0), *[F.col("theta")[i] for i in range(params)], *[F.col("g")[j] for j in range(q)]]
    s = E.gram_matrix(E.normal_equations(ensemble, cols), len(cols))
    n, mean = s[0, 0], s[0, 1:] / max(s[0, 0], 1.0)
    cov = (s[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1.0)
    gain = cov[:params, params:] @ np.linalg.inv(cov[params:, params:] + noise**2 * np.eye(q))
    new = []
    for i in range(params):
        move = F.col("theta")[i]
        for j in range(q):
            move = move + float(gain[i, j]) * (float(observed[j]) + noise * _normal(seed, j) - F.col("g")[j])
        new.append(move)
    return ensemble.select("id", F.array(*new).alias("theta"))


#: Young's modulus, Poisson ratio, density (SI; fixed values).
ELASTIC = (("aluminum", 70e9, 0.33, 2700.0), ("steel", 200e9, 0.3, 7850.0), ("titanium", 116e9, 0.34, 4500.0), ("rubber", 0.01e9, 0.49, 1100.0))
#: Conductivity, density, specific heat (SI; fixed values).
THERMAL = (("aluminum", 205.0, 2700.0, 900.0), ("steel", 50.0, 7850.0, 500.0), ("copper", 400.0, 8960.0, 385.0), ("air", 0.026, 1.2, 1005.0), ("water", 0.6, 1000.0, 4186.0))
#: Density, dynamic viscosity (SI; fixed values).
FLUID = (("water", 1000.0, 0.001), ("air", 1.2, 1.8e-5), ("oil", 900.0, 0.1), ("glycerin", 1260.0, 1.5))


def materials(spark: SparkSession) -> DataFrame:
    """All materials in one small table; what a table does not know is null."""
    rows: dict[str, dict] = {}
    for table, names in ((ELASTIC, ("youngs", "poisson", "density")), (THERMAL, ("conductivity", "density", "heat_capacity")), (FLUID, ("density", "viscosity"))):
        for name, *values in table:
            rows.setdefault(name, {}).update(zip(names, values))
    columns = ("youngs", "poisson", "density", "conductivity", "heat_capacity", "viscosity")
    return spark.createDataFrame([(n, *[r.get(c) for c in columns]) for n, r in rows.items()], "name string, " + ", ".join(f"{c} double" for c in columns))


def augment(col: Column, kind: str, shift: int = 1) -> Column:
    """An array reversed, negated or rolled."""
    if kind == "reverse":
        return F.reverse(col)
    if kind == "negate":
        return F.transform(col, lambda v: -v)
    n = F.size(col)
    k = F.pmod(F.lit(shift), F.greatest(n, F.lit(1)))
    return F.when(n == 0, col).otherwise(F.concat(F.slice(col, n - k + 1, k), F.slice(col, F.lit(1), n - k)))
