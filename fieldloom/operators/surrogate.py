"""Scoring and choice of candidate points, task similarity."""

from __future__ import annotations

import copy
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.process import SlabProcess, lower_inverse
from fieldloom.operators.spatial import in_blocks
from fieldloom.sources.scratch import Scratch

MAX_TRAIN = 5_000


def normal_cdf(z: Column) -> Column:
    """Phi by the rational approximation 26.2.17 of Abramowitz and Stegun (error under 7.5e-8; fixed values)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = normal_pdf(z) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / np.sqrt(2 * np.pi)


def expected_improvement(mean: Column, std: Column, best: float | Column, xi: float = 0.01) -> Column:
    """Improvement under the smallest value so far; deviations are at least 1e-9."""
    s = F.greatest(std, F.lit(1e-9))
    z = (best - mean - xi) / s
    return s * (z * normal_cdf(z) + normal_pdf(z))


def max_uncertainty(std: Column) -> Column:
    """The deviation itself is the score."""
    return std


def committee_disagreement(predictions: DataFrame) -> DataFrame:
    """``id, score``: population variance of the members' means ``id, member, mean``."""
    return predictions.groupBy("id").agg(F.var_pop("mean").alias("score"))


def ensemble_combine(predictions: DataFrame) -> DataFrame:
    """Mean of means; variance is the mean variance plus the variance of means. ``id, member, mean, std``."""
    return predictions.groupBy("id").agg(F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") ** 2) + F.var_pop("mean")).alias("std"))


def top_candidates(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


#: Candidates that the driver looks at first, and at most.
LAZY, LAZY_MAX = 2_000, 100_000


def _lazy_choices(scored: DataFrame, k: int, dims: Sequence[str]) -> tuple[list[int], list[dict], bool]:
    """Choices that upper bounds prove, their rows, and whether these are all.

    A value never exceeds its candidate's score, or 0 where that is negative.  The
    candidates of the highest bounds are looked at; a choice among them holds
    while its value exceeds the bound of all others.  Where it does not, four
    times as many are read, ``LAZY_MAX`` at most.
    """
    sound = scored.where("score is not null and not isnan(score)").select("id", "score", *dims, F.greatest("score", F.lit(0.0)).alias("bound"))
    m, chosen, rows = max(LAZY, 16 * k), [], []
    while True:
        top = sound.orderBy(F.desc("bound"), "id").limit(m + 1).toPandas()  # LAZY_MAX rows at most
        rest = float(top.bound.iloc[m]) if len(top) > m else -np.inf
        top = top.iloc[:m].sort_values("id")
        ids, score, x = top.id.to_numpy(), top.score.to_numpy(float), top[list(dims)].to_numpy(float)
        near = np.full(len(top), np.inf)
        for r in rows:
            near = np.minimum(near, np.sqrt(((x - r["x"]) ** 2).sum(1)))
        free = ~np.isin(ids, chosen)
        while len(chosen) < k and free.any():
            value = np.where(free, score * (1 - np.exp(-near)) if chosen else score, -np.inf)
            best = int(value.argmax())  # the first of equal ones has the smallest id
            if not value[best] > rest:
                break
            chosen.append(int(ids[best]))
            rows.append({"id": int(ids[best]), "x": x[best]})
            free[best] = False
            near = np.minimum(near, np.sqrt(((x - x[best]) ** 2).sum(1)))
        if len(chosen) == k or rest == -np.inf:
            return chosen, rows, True
        if m >= LAZY_MAX:
            return chosen, rows, False
        m = min(4 * m, LAZY_MAX)


def diverse_batch(scored: DataFrame, k: int, dims: Sequence[str], every: int = 8) -> list[int]:
    """Greedy choice by score * (1 - exp(-distance to the chosen)), ties by the smaller id.

    The choices are proved by upper bounds on a few thousand candidates, so the
    table is read once or a few times whatever k is.  Only where ``LAZY_MAX``
    candidates do not suffice (very many equal scores) the rest is chosen by one
    pass a choice; the distance to the chosen is then a column that is written
    anew after ``every`` choices, so expressions stay short.  Candidates without a
    score are not chosen.
    """
    scored = scored.where("score is not null and not isnan(score)")
    chosen, known, done = _lazy_choices(scored, k, dims)
    if done:
        return chosen
    tmp = Scratch(scored.sparkSession, "batch")
    start = F.lit(None).cast("double")
    for r in known:
        start = F.least(start, F.sqrt(sum((F.col(c) - float(v)) ** 2 for c, v in zip(dims, r["x"]))))
    left = scored.where(~F.col("id").isin(chosen)) if chosen else scored
    left, fresh = tmp.write(left.select("id", "score", *dims, start.alias("min_dist")), "left"), []
    for _ in range(k - len(chosen)):
        near = F.col("min_dist")
        for r in fresh:
            near = F.least(near, F.sqrt(sum((F.col(c) - float(r[c])) ** 2 for c in dims)))
        rest = left.where(~F.col("id").isin([r.id for r in fresh])) if fresh else left
        value = F.when(near.isNull(), F.col("score")).otherwise(F.col("score") * (1 - F.exp(-near)))
        best = rest.withColumn("v", value).agg(F.max_by(F.struct("id", *dims), F.struct("v", -F.col("id"))).alias("b")).first().b
        if best is None:
            break
        chosen.append(best.id)
        fresh.append(best)
        if len(fresh) == every:
            near = F.col("min_dist")
            for r in fresh:
                near = F.least(near, F.sqrt(sum((F.col(c) - float(r[c])) ** 2 for c in dims)))
            after = tmp.write(left.where(~F.col("id").isin([r.id for r in fresh])).withColumn("min_dist", near), "left")
            tmp.drop(left)
            left, fresh = after, []
    return chosen


class GaussianProcess:
    """Factors of a squared-exponential process on training points; points are added by growing the Cholesky factor."""

    def __init__(self, x: np.ndarray, y: np.ndarray, length: float, noise: float):
        self.length, self.noise = length, noise
        self.x, self.y, self.chol, self.inverse = np.zeros((0, x.shape[1])), np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))
        self.grow(x, y)

    def grow(self, x: np.ndarray, y: np.ndarray) -> None:
        """Add k points to n: new rows of the factor and of its inverse alone, O(n^2 k)."""
        n, k = len(self.x), len(x)
        cross = self.kernel(x)
        low = cross @ self.inverse.T
        self.x, self.y = np.vstack([self.x, x]), np.r_[self.y, y]
        corner = np.linalg.cholesky(self.kernel(x)[:, n:] + self.noise * np.eye(k) - low @ low.T) if k else np.zeros((0, 0))
        flipped = lower_inverse(corner)
        self.chol = np.block([[self.chol, np.zeros((n, k))], [low, corner]])
        self.inverse = np.block([[self.inverse, np.zeros((n, k))], [-flipped @ low @ self.inverse, flipped]])
        self.alpha = self.inverse.T @ (self.inverse @ self.y)

    def scorer(self) -> GaussianProcess:
        """What predictions need: all but the Cholesky factor, so that half as much is broadcast."""
        out = copy.copy(self)
        out.chol = None
        return out

    @property
    def log_marginal(self) -> float:
        n = len(self.x)
        return float(-0.5 * self.y @ self.alpha - np.log(np.diag(self.chol)).sum() - 0.5 * n * np.log(2 * np.pi)) if n else 0.0

    def kernel(self, a: np.ndarray) -> np.ndarray:
        d2 = (a**2).sum(1)[:, None] + (self.x**2).sum(1)[None] - 2 * a @ self.x.T
        return np.exp(-0.5 * np.maximum(d2, 0) / self.length**2)


def bounded_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """All rows, or about ``n`` drawn by a hash of ``keys`` if there are more; never more than ``n``."""
    total = df.count()
    if total <= n:
        return df
    share = F.pmod(F.xxhash64(*keys, F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * max(n - 4 * n**0.5, n / 2) / total)
    return df.where(share).limit(n)


def gp_predict(candidates: DataFrame, train: DataFrame, length: float = 1.0, noise: float = 1e-6) -> DataFrame:
    """``id, mean, std`` of a squared-exponential Gaussian process at every candidate.

    The process takes every training row, in slabs (``process.SlabProcess``).
    Candidates of one place are scored once and come back by a join on the place.
    """
    rows = candidates.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"))
    places = Scratch(candidates.sparkSession, "gp").write(SlabProcess(train, length, noise).score(rows.select("p").distinct()), "places")
    return rows.join(places, "p").select("id", "mean", "std")


def gp_score(candidates: DataFrame, process: GaussianProcess) -> DataFrame:
    """``id, mean, std`` of a fitted process at every candidate, in slices, so a task holds a few hundred kernel rows at a time.

    Candidates of one place are scored once, so the products grow with the distinct
    places; scores come back to the candidates by a join on the place.
    """
    rows = candidates.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"))
    held = candidates.sparkSession.sparkContext.broadcast(process.scorer())

    def run(batches):
        gp = held.value
        for b in batches:
            x = np.asarray(b.column("p").flatten(), float).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
            mean, var = np.zeros(len(x)), np.ones(len(x))
            for at in range(0, len(x) if len(gp.x) else 0, 500):
                c = gp.kernel(x[at : at + 500])
                mean[at : at + 500], var[at : at + 500] = c @ gp.alpha, 1 - ((c @ gp.inverse.T) ** 2).sum(1)
            yield pa.RecordBatch.from_pydict({"p": b.column("p"), "mean": pa.array(mean), "std": pa.array(np.sqrt(np.maximum(var, 1e-10)))})

    places = Scratch(candidates.sparkSession, "gp").write(rows.select("p").distinct().mapInArrow(run, "p array<double>, mean double, std double"), "places")
    return rows.join(places, "p").select("id", "mean", "std")


def gp_log_marginal(train: DataFrame, length: float = 1.0, noise: float = 1e-6) -> float:
    """Log marginal likelihood of the training rows that ``gp_predict`` takes, which are all."""
    return SlabProcess(train, length, noise).log_marginal()


def task_embedding(data: DataFrame, size: int = 8, tasks: DataFrame | None = None) -> DataFrame:
    """Parameters, domain, then mean, deviation, minimum and maximum of each task's values, padded with zeros or cut to ``size``.

    ``tasks(task, parameters map, domain array)`` is optional; parameters stand in
    the order of their names.  A task without values has zeros for them.
    """
    stats = data.groupBy("task").agg(F.array(F.avg("value"), F.stddev_pop("value"), F.min("value"), F.max("value")).alias("s"))
    if tasks is None:
        head, rows = F.array().cast("array<double>"), stats
    else:
        rows = tasks.join(stats, "task", "left").withColumn("s", F.coalesce("s", F.array_repeat(F.lit(0.0), 4)))
        named = F.transform(F.array_sort(F.map_keys("parameters")), lambda k: F.element_at("parameters", k).cast("double"))
        head = F.concat(F.coalesce(named, F.array().cast("array<double>")), F.coalesce(F.col("domain").cast("array<double>"), F.array().cast("array<double>")))
    return rows.select("task", F.slice(F.concat(head, "s", F.array_repeat(F.lit(0.0), size)), 1, size).alias("e"))


def similar_tasks(query: DataFrame, tasks: DataFrame, k: int = 5) -> DataFrame:
    """``task, rank, other, similarity``: 1 / (1 + distance) of a stated query set against all tasks.

    The query set is counted and met in broadcast blocks; chunks of tasks keep the
    k best of a query before these meet.
    """
    d = F.sqrt(F.aggregate(F.zip_with("qe", "e", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    out = None
    for part in in_blocks(query.select("task", F.col("e").alias("qe")), 1_000):
        rows = tasks.select(F.col("task").alias("other"), "e").crossJoin(part).where("task <> other").select("task", "other", (1 / (1 + d)).alias("similarity"))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("other"), F.lit(64)))
        w = Window.partitionBy("task", "chunk").orderBy(F.desc("similarity"), "other")
        best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("task", "other", "similarity")
        out = best if out is None else out.unionByName(best)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)


def similarity_ensemble(neighbors: DataFrame, predictions: DataFrame) -> DataFrame:
    """Similarity-weighted mean of the neighbours' predictions ``other, value``."""
    j = neighbors.join(predictions, "other")
    return j.groupBy("task").agg((F.sum(F.col("similarity") * F.col("value")) / F.sum("similarity")).alias("value"))
