"""Moments, sensitivity and multi-fidelity statistics over large sample tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.order import quantiles, running_moments
from fieldloom.operators.spatial import in_blocks


def monte_carlo(samples: DataFrame, outputs: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Mean, population deviation and 2.5 / 97.5 percentiles of each output.

    Exact percentiles count equal values and sum the counts up in order over all
    partitions, so no task holds a group's values; ``exact=False`` takes
    ``percentile_approx``.
    """
    aggs = []
    for c in outputs:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
        if not exact:
            aggs += [F.percentile_approx(c, 0.025, 100_000).alias(f"{c}_low"), F.percentile_approx(c, 0.975, 100_000).alias(f"{c}_high")]
    out = samples.groupBy(*by).agg(*aggs)
    for c in outputs if exact else ():
        q = quantiles(samples, c, [0.025, 0.975], by).select(*[F.col(k).alias(f"__{k}") for k in by], F.col("q0").alias(f"{c}_low"), F.col("q1").alias(f"{c}_high"))
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = (out.join(q, same, "left") if by else out.crossJoin(F.broadcast(q))).drop(*[f"__{k}" for k in by])  # without keys one row is broadcast
    return out


def mc_convergence(samples: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """Running mean and variance in sample order within each ``by``, with the standard error; runs of any length."""
    r = running_moments(samples, by, order, value)
    return r.select(by, order, "n", F.col("mean").alias("running_mean"), F.col("var").alias("running_var"), F.sqrt(F.try_divide("var", "n")).alias("standard_error"))


def mc_final(samples: DataFrame, value: str, by: str) -> DataFrame:
    """``by, n, mean, standard_error, relative_error``: what the running figures end with."""
    g = samples.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sqrt(F.try_divide(F.var_pop(value), F.count(value))).alias("standard_error"))
    return g.withColumn("relative_error", F.col("standard_error") / (F.abs("mean") + 1e-10))


def variance_decomposition(samples: DataFrame, inputs: Sequence[str], output: str, bounds: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Share of variance explained by right-open equal-width bins of each input.

    A value at the upper bound falls into no bin; a null input or output is left out.
    """
    rows = samples.select(F.col(output).alias("y"), *inputs).where(F.col("y").isNotNull())
    total = rows.agg(F.var_pop("y").alias("total"))
    spread = F.array(*[F.struct(F.lit(c).alias("input"), F.floor((F.col(c) - lo) / ((hi - lo) / bins)).alias("bin")) for c, (lo, hi) in ((c, bounds[c]) for c in inputs)])
    means = rows.select("y", F.explode(spread).alias("s")).select("y", "s.*").where(F.col("bin").between(0, bins - 1)).groupBy("input", "bin").agg(F.avg("y").alias("m"))
    main = means.groupBy("input").agg(F.var_pop("m").alias("v"))
    return main.crossJoin(F.broadcast(total)).select("input", (F.col("v") / (F.col("total") + 1e-10)).alias("fraction"))  # one row is broadcast


def sobol_indices(design: DataFrame, model: Callable[[list[Column]], Column], d: int) -> DataFrame:
    """First and total order indices from rows ``a, b`` (arrays of two independent samples)."""
    a, b = [F.col("a")[i] for i in range(d)], [F.col("b")[i] for i in range(d)]
    mixed = F.array(*[model([b[j] if j == i else a[j] for j in range(d)]) for i in range(d)])
    rows = design.select(model(a).alias("fa"), model(b).alias("fb"), mixed.alias("fab"))
    n_all = rows.agg(F.count("*").alias("n"), F.sum(F.col("fa") + F.col("fb")).alias("s"), F.sum(F.col("fa") ** 2 + F.col("fb") ** 2).alias("q"))
    var = n_all.select((F.col("q") / (2 * F.col("n")) - (F.col("s") / (2 * F.col("n"))) ** 2).alias("var"))
    per = rows.select("fa", "fb", F.posexplode("fab").alias("param", "f")).groupBy("param").agg(F.avg(F.col("fb") * (F.col("f") - F.col("fa"))).alias("s"), F.avg((F.col("fa") - F.col("f")) ** 2).alias("t"))
    clip = lambda c: F.when(F.col("var") < 1e-10, 0.0).otherwise(F.least(F.greatest(c / F.col("var"), F.lit(0.0)), F.lit(1.0)))
    return per.crossJoin(F.broadcast(var)).select("param", clip(F.col("s")).alias("first_order"), clip(0.5 * F.col("t")).alias("total_order"))  # one row is broadcast


def morris_screening(steps: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean absolute effect and its deviation by parameter from ``trajectory, step, y`` rows.

    The first step of a trajectory that moves a parameter gives its effect.
    """
    w = Window.partitionBy("trajectory").orderBy("step")
    moves = F.array(*[F.struct(F.lit(c).alias("param"), (F.col(c) - F.lag(c).over(w)).alias("d")) for c in params])
    rows = steps.select("trajectory", "step", (F.col("y") - F.lag("y").over(w)).alias("dy"), moves.alias("ms"))
    rows = rows.select("trajectory", "step", "dy", F.explode("ms").alias("m")).select("trajectory", "step", "dy", "m.*").where(F.abs("d") > 1e-10)
    first = rows.groupBy("trajectory", "param").agg(F.min_by(F.col("dy") / F.col("d"), "step").alias("e"))
    return first.groupBy("param").agg(F.avg(F.abs("e")).alias("mu_star"), F.when(F.count("e") > 1, F.stddev_pop("e")).otherwise(0.0).alias("sigma"))


def pce_fit(samples: DataFrame, nodes: Sequence[str], weight: str, value: str, degree: int) -> DataFrame:
    """Coefficients of total-degree Legendre products on weighted nodes in [-1, 1]."""
    polys = {c: [F.lit(1.0), F.col(c)] for c in nodes}
    for c in nodes:
        for n in range(1, degree):
            polys[c].append(((2 * n + 1) * F.col(c) * polys[c][n] - n * polys[c][n - 1]) / (n + 1))
    index = [t for t in np.ndindex(*[degree + 1] * len(nodes)) if sum(t) <= degree]
    terms = []
    for t in index:
        p = F.lit(1.0)
        for c, k in zip(nodes, t):
            p = p * polys[c][k]
        terms.append(F.struct(F.lit("-".join(map(str, t))).alias("term"), p.alias("p")))
    rows = samples.select(weight, value, F.explode(F.array(*terms)).alias("t")).select(F.col(weight).alias("w"), F.col(value).alias("f"), "t.*")
    return rows.groupBy("term").agg((F.sum(F.col("w") * F.col("f") * F.col("p")) / (F.sum(F.col("w") * F.col("p") ** 2) + 1e-10)).alias("coef"))


def interaction_share(samples: DataFrame, inputs: Sequence[str], output: str, bounds: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """One row ``interaction``: what the main effects of ``variance_decomposition`` leave."""
    return variance_decomposition(samples, inputs, output, bounds, bins).agg((1 - F.sum("fraction")).alias("interaction"))


def pce_moments(coefficients: DataFrame, normalized: bool = False) -> DataFrame:
    """``mean, variance`` of an expansion: the first coefficient, and the sum of the other squares.

    ``normalized`` weighs each square by the norm of its Legendre product, which
    gives the variance under the uniform density.
    """
    orders = F.split("term", "-")
    norm = F.aggregate(orders, F.lit(1.0), lambda a, n: a / (2 * n.cast("double") + 1)) if normalized else F.lit(1.0)
    first = F.forall(orders, lambda n: n == "0")
    return coefficients.agg(F.max(F.when(first, F.col("coef"))).alias("mean"), F.sum(F.when(~first, F.col("coef") ** 2 * norm)).alias("variance"))


def morris_trajectories(starts: DataFrame, bounds: Sequence[tuple[float, float]], levels: int = 4, seed: int = 0) -> DataFrame:
    """``trajectory, step, x``: from each ``trajectory`` id a start on the grid and one step in each parameter, in a random order.

    All draws are hashes of seed and trajectory.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "trajectory", F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    d = len(bounds)
    rows = starts.select("trajectory", F.array(*[F.floor(u(i) * levels) for i in range(d)]).alias("l"), F.array_sort(F.array(*[F.struct(u(d + i).alias("u"), F.lit(i).alias("i")) for i in range(d)])).alias("o"), F.array(*[F.when(u(2 * d + i) > 0.5, 1).otherwise(-1) for i in range(d)]).alias("s"))
    rows = rows.select("trajectory", "l", "s", F.col("o.i").alias("o"), F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    at = []
    for i, (lo, hi) in enumerate(bounds):
        moved = F.array_position("o", F.lit(i)) <= F.col("step")
        level = F.col("l")[i] + F.when(moved, F.col("s")[i]).otherwise(0)
        at.append(lo + (hi - lo) / (levels - 1) * F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1)))
    return rows.select("trajectory", "step", F.array(*at).alias("x"))


def log_posterior(thetas: DataFrame, data: DataFrame, model: Column, noise: float, prior_std: float) -> DataFrame:
    """Log posterior of many parameter rows ``theta_id, theta`` against a large table ``x, y``.

    The parameters are counted and met in broadcast blocks, each summed inside
    the partitions of the data.  ``model`` is a column of ``x`` and ``theta``.
    """
    r = (F.col("y") - model) / noise
    out = None
    for part in in_blocks(thetas):
        like = data.crossJoin(part).groupBy("theta_id", "theta").agg(F.sum(-0.5 * r * r).alias("like"))
        out = like if out is None else out.unionByName(like)
    return out.select("theta_id", "theta", (F.col("like") - 0.5 * (F.col("theta") / prior_std) ** 2).alias("log_posterior"))


def map_estimate(posterior: DataFrame) -> DataFrame:
    """The row of the largest log posterior (the smallest id of equals)."""
    return posterior.agg(F.max_by(F.struct("theta_id", "theta", "log_posterior"), F.struct("log_posterior", -F.col("theta_id"))).alias("m")).select("m.*")


def fidelity_correlation(wide: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Correlation and sample covariance of each pair of level columns on shared samples."""
    pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i:]]
    one = wide.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("correlation"), F.covar_samp(a, b).alias("covariance")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")


def optimal_allocation(rho: Sequence[float], costs: Sequence[float], budget: float, nested: bool = False) -> list[int]:
    """Samples for each level (highest first), at least one, from K correlations with the highest level and costs.

    ``nested`` takes one sample ratio for the highest level, as the nested
    estimator ``mfmc_mean`` needs; otherwise its ratio follows from the gain of
    its own correlation over the next.
    """
    r2, costs = np.append(np.asarray(rho, float) ** 2, 0.0), np.asarray(costs, float)
    rest = 1 - r2[1] + 1e-10
    gain = r2[:-1] - r2[1:]
    if nested:
        ratio = np.sqrt(np.maximum(gain, 0.0) * costs[0] / (rest * costs))
        ratio[0] = 1.0
        base = float(int(budget / float(ratio @ costs)))
    else:
        ratio = np.sqrt(np.maximum(gain, 1e-10) / costs) * np.sqrt(costs[0] / rest)
        base = budget / float(ratio @ costs)
    return [max(1, int(x * base)) for x in ratio]


def control_variate(pairs: DataFrame, hf: str, lf: str) -> DataFrame:
    """alpha, corrected mean and variance factor; covariance over n - 1, variance over n as in the source method."""
    alpha = F.covar_samp(hf, lf) / (F.var_pop(lf) + 1e-12)
    return pairs.agg(alpha.alias("alpha"), F.avg(hf).alias("mean_hf"), F.avg(lf).alias("mean_lf"), (1 - F.corr(hf, lf) ** 2).alias("variance_factor"))


def control_variate_estimates(pairs: DataFrame, hf: str, lf: str) -> DataFrame:
    """Each sample's estimate hf - alpha (lf - mean lf)."""
    stats = control_variate(pairs, hf, lf).select("alpha", "mean_lf")
    return pairs.crossJoin(F.broadcast(stats)).withColumn("estimate", F.col(hf) - F.col("alpha") * (F.col(lf) - F.col("mean_lf"))).drop("alpha", "mean_lf")  # one row is broadcast


def mfmc_mean(mf: DataFrame, counts: Sequence[int], weights: Sequence[float]) -> DataFrame:
    """Nested-prefix estimate: mean of level 0 plus weighted (shared - all) means of the others.

    ``mf(rank, level, y)``: level k holds the samples of rank < counts[k].
    """
    total = F.avg(F.when((F.col("level") == 0) & (F.col("rank") < counts[0]), F.col("y")))
    for k in range(1, len(counts)):
        of = F.col("level") == k
        shared = F.avg(F.when(of & (F.col("rank") < min(counts[k - 1], counts[k])), F.col("y")))
        total = total + weights[k] * (shared - F.avg(F.when(of & (F.col("rank") < counts[k]), F.col("y"))))
    return mf.agg(total.alias("estimate"))


def mfmc_variance(variance: float, rho: Sequence[float], counts: Sequence[int]) -> float:
    """Variance of the nested estimate: the highest level's over its count, times 1 - rho squared of each other level."""
    return float(variance / counts[0] * np.prod([1 - r * r for r in rho[1:]]))


def cheapest_acceptable(outputs: DataFrame, tol: float) -> DataFrame:
    """Cheapest level whose output is within ``tol`` of the highest level's, by sample.

    ``outputs(sample_id, level, cost, y)``; the highest level is its own error 0.
    """
    top = F.max_by("y", "level").over(Window.partitionBy("sample_id"))
    err = F.abs(F.col("y") - top) / (F.abs(top) + 1e-10)
    rows = outputs.withColumn("err", err).where(F.col("err") <= tol)
    return rows.groupBy("sample_id").agg(F.min_by("level", F.struct("cost", "level")).alias("level"), F.min_by("err", F.struct("cost", "level")).alias("error"))


def fidelity_cost_stats(history: DataFrame, levels: DataFrame) -> DataFrame:
    """Uses of every level (0 filled), total cost, cost had all been the dearest, and the saving."""
    used = history.groupBy("level").agg(F.count("*").alias("n"))
    rows = levels.join(used, "level", "left").select("level", "cost", F.coalesce("n", F.lit(0)).alias("n"))
    sums = rows.agg(F.sum(F.col("n") * F.col("cost")).alias("total_cost"), (F.sum("n") * F.max("cost")).alias("highest_cost"))
    return rows.crossJoin(F.broadcast(sums)).select("level", "n", "total_cost", "highest_cost", (F.col("highest_cost") - F.col("total_cost")).alias("saved"))  # one row is broadcast


def collocation_grid(samples: DataFrame, inputs: Sequence[str], n: int) -> DataFrame:
    """The tensor grid of ``n`` Chebyshev nodes of each input, mapped through the quantiles of its samples.

    Nodes in (0, 1) are (1 - cos(pi (2 k + 1) / (2 n))) / 2; the quantiles are
    exact and come from the whole table.  ``n ** len(inputs)`` rows.
    """
    nodes = [float(0.5 * (1 - np.cos(np.pi * (2 * k + 1) / (2 * n)))) for k in range(n)]
    out = None
    for c in inputs:
        q = quantiles(samples, c, nodes).select(F.explode(F.array(*[f"q{k}" for k in range(n)])).alias(c))
        out = q if out is None else out.crossJoin(F.broadcast(q))  # n rows are broadcast
    return out


def collocation_stats(samples: DataFrame, inputs: Sequence[str], model: Column, n: int = 5) -> DataFrame:
    """``mean, std`` of ``model``, a column of the inputs, with equal weights on the collocation grid."""
    return collocation_grid(samples, inputs, n).agg(F.avg(model).alias("mean"), F.stddev_pop(model).alias("std"))


def fidelity_selector(train: DataFrame, params: Sequence[str], levels: int) -> list[Column]:
    """Predicted log error of each level as a column, linear in parameters and level.

    ``train(level, error, *params)``; one pass of normal equations.
    """
    from fieldloom.operators.regress import gram_matrix, normal_equations, solve

    cols = [F.lit(1.0), *[F.col(p) for p in params], F.col("level").cast("double"), F.log(F.col("error") + 1e-12)]
    c = solve(gram_matrix(normal_equations(train, cols), len(cols)), len(cols) - 1)[:, 0]
    return [sum((float(k) * F.col(p) for k, p in zip(c[1:], params)), F.lit(float(c[0]))) + float(c[-1]) * v for v in range(levels)]


def select_fidelity(samples: DataFrame, log_errors: Sequence[Column], costs: Sequence[float], tol: float) -> DataFrame:
    """``level``, the cheapest whose predicted error is within ``tol`` (else the highest), with ``predicted``, ``confidence`` and ``saved``.

    Confidence is one minus the predicted error over ``tol`` (negative where no
    level is good enough); ``saved`` is the cost below that of the highest level.
    """
    order = sorted(range(len(costs)), key=lambda v: (costs[v], v))
    top = len(costs) - 1
    level = F.coalesce(*[F.when(F.exp(log_errors[v]) <= tol, F.lit(v)) for v in order], F.lit(top))
    pick = lambda values: F.get(F.array(*values), F.col("level"))
    out = samples.withColumn("level", level).withColumn("predicted", pick([F.exp(e) for e in log_errors]))
    return out.withColumn("confidence", 1 - F.col("predicted") / tol).withColumn("saved", float(costs[top]) - pick([F.lit(float(c)) for c in costs]))
