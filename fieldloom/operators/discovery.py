"""Search for expressions, and corrections from coarse to fine fields."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.spatial import knn_join
from fieldloom.sources.scratch import Scratch

#: Operators of an expression tree and their number of arguments.
ARITY = {"+": 2, "-": 2, "*": 2, "/": 2, "pow": 2, "sin": 1, "cos": 1, "exp": 1, "sqrt": 1}


@dataclass
class Tree:
    """A number, a column's name, or an operator with its arguments."""

    head: str | float
    args: list = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(a.size() for a in self.args)

    def nodes(self) -> list:
        return [self] + [n for a in self.args for n in a.nodes()]

    def copy(self) -> Tree:
        return Tree(self.head, [a.copy() for a in self.args])

    def column(self) -> Column:
        """Division by almost nothing is 1, exponents stay within 20, roots and powers take the size, powers are of three at most."""
        if isinstance(self.head, float):
            return F.lit(self.head)
        if self.head not in ARITY:
            return F.col(self.head)
        a = [x.column() for x in self.args]
        return {
            "+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1],
            "/": lambda: F.when(F.abs(a[1]) > 1e-10, F.try_divide(a[0], a[1])).otherwise(1.0),
            "pow": lambda: F.pow(F.abs(a[0]), F.least(F.greatest(a[1], F.lit(-3.0)), F.lit(3.0))),
            "sin": lambda: F.sin(a[0]), "cos": lambda: F.cos(a[0]),
            "exp": lambda: F.exp(F.least(F.greatest(a[0], F.lit(-20.0)), F.lit(20.0))), "sqrt": lambda: F.sqrt(F.abs(a[0])),
        }[self.head]()

    def __str__(self) -> str:
        if isinstance(self.head, float):
            return f"{self.head:.4g}"
        if not self.args:
            return self.head
        a = list(map(str, self.args))
        return f"({a[0]} {self.head} {a[1]})" if len(a) == 2 and self.head != "pow" else f"pow({a[0]}, {a[1]})" if len(a) == 2 else f"{self.head}({a[0]})"


def _random(rng: np.random.Generator, columns: list[str], depth: int) -> Tree:
    if depth == 0 or rng.random() < 0.3:
        return Tree(str(rng.choice(columns))) if rng.random() < 0.7 else Tree(float(np.round(rng.normal() * 2, 3)))
    op = str(rng.choice(list(ARITY)))
    return Tree(op, [_random(rng, columns, depth - 1) for _ in range(ARITY[op])])


def _put(tree: Tree, new: Tree, rng: np.random.Generator) -> Tree:
    """``tree`` with ``new`` in place of a random node."""
    out = tree.copy()
    at = out.nodes()[rng.integers(out.size())]
    at.head, at.args = new.head, new.copy().args
    return out


def shared_graph(trees: list[Tree]) -> tuple[list[tuple[str | float, tuple[int, ...]]], list[int]]:
    """Distinct subexpressions of all trees, arguments first, and the place of each tree's root."""
    places: dict[tuple, int] = {}
    steps: list[tuple[str | float, tuple[int, ...]]] = []

    def place(t: Tree) -> int:
        args = tuple(place(a) for a in t.args)
        if t.head in ("+", "*"):
            args = tuple(sorted(args))  # the same whichever argument comes first
        key = (type(t.head) is float, t.head, args)
        if key not in places:
            places[key] = len(steps)
            steps.append((t.head, args))
        return places[key]

    return steps, [place(t) for t in trees]


def evaluate(steps: list, columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Values of every subexpression, each computed once; the rules are those of ``Tree.column``."""
    n, out = len(next(iter(columns.values()))), []
    with np.errstate(all="ignore"):
        for head, args in steps:
            a = [out[i] for i in args]
            if isinstance(head, float):
                v = np.full(n, head)
            elif head not in ARITY:
                v = columns[head]
            elif head in "+-*":
                v = a[0] + a[1] if head == "+" else a[0] - a[1] if head == "-" else a[0] * a[1]
            elif head == "/":
                v = np.where(np.abs(a[1]) > 1e-10, a[0] / np.where(a[1] == 0, 1.0, a[1]), 1.0)
            elif head == "pow":
                v = np.abs(a[0]) ** np.clip(a[1], -3, 3)
            else:
                v = {"sin": np.sin, "cos": np.cos, "exp": lambda x: np.exp(np.clip(x, -20, 20)), "sqrt": lambda x: np.sqrt(np.abs(x))}[head](a[0])
            out.append(v)
    return out


def mean_squared_errors(rows: DataFrame, trees: list[Tree], target: str) -> list[float]:
    """Mean squared error of each tree over ``rows``, whose columns are doubles.

    The trees go out as one graph of shared subexpressions; a batch computes each
    of them once, and only one number a tree leaves a partition.
    """
    steps, roots = shared_graph(trees)
    names = sorted({h for h, _ in steps if isinstance(h, str) and h not in ARITY} | {target})

    def run(batches):
        total, n = np.zeros(len(roots)), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                b = whole.slice(at, 4_096)
                x = {c: np.asarray(b.column(c)) for c in names}
                values = evaluate(steps, x)
                with np.errstate(all="ignore"):
                    total += [((values[r] - x[target]) ** 2).sum() for r in roots]
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(roots)), -1), pa.int32()), pa.array(np.append(total, float(n)))], names=["k", "s"])

    got = {r.k: r.s for r in rows.select(*names).mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}  # one row a tree
    return [got.get(k, 0.0) / got[-1] if got.get(-1) else math.nan for k in range(len(roots))]


def symbolic_regression(df: DataFrame, columns: list[str], target: str, generations: int = 10, population: int = 40, seed: int = 0, penalty: float = 0.01, largest: int = 15) -> tuple[str, Column, float]:
    """The best expression found, its column and its mean squared error over the whole table.

    The driver keeps a population of small trees; each generation is scored by one
    scan of the written columns through one graph of shared subexpressions, so
    only numbers of the population's size reach the driver.  Better trees are kept; the rest are
    crossed and mutated.  Rows with a null or non-finite number are left out.
    """
    rng = np.random.default_rng(seed)
    ok = F.lit(True)
    for c in (*columns, target):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = Scratch(df.sparkSession, "symbolic").write(df.where(ok).select(*[F.col(c).cast("double").alias(c) for c in (*columns, target)]), "rows")
    trees = [Tree(c) for c in columns] + [_random(rng, columns, 3) for _ in range(population - len(columns))]
    known: dict[str, tuple[float, float]] = {}
    for _ in range(generations):
        fresh = {str(t): t for t in trees if str(t) not in known}
        if fresh:
            for (name, t), mse in zip(fresh.items(), mean_squared_errors(rows, list(fresh.values()), target)):
                known[name] = (mse + penalty * t.size(), mse) if math.isfinite(mse) else (math.inf, math.inf)
        trees = sorted({str(t): t for t in trees}.values(), key=lambda t: (known[str(t)][0], t.size(), str(t)))
        if known[str(trees[0])][1] < 1e-12:
            break
        best, out = trees[: max(2, population // 4)], list(trees[: max(2, population // 4)])
        while len(out) < population:
            a, b = best[rng.integers(len(best))], best[rng.integers(len(best))]
            u = rng.random()
            new = _put(a, b.nodes()[rng.integers(b.size())], rng) if u < 0.5 else _put(a, _random(rng, columns, 2), rng) if u < 0.9 else _random(rng, columns, 3)
            if new.size() <= largest:
                out.append(new)
        trees = out
    scored = [t for t in trees if str(t) in known]
    top = min(scored, key=lambda t: (known[str(t)][0], t.size(), str(t)))
    return str(top), top.column(), known[str(top)][1]


def coarse_to_fine(coarse_points: DataFrame, coarse: DataFrame, fine_points: DataFrame, fine: DataFrame, k: int = 4, d: int = 2, ridge: float = 1e-10) -> DataFrame:
    """``id, run, prolonged, corrected``: coarse fields on fine points, and with the learned linear correction.

    ``coarse(id, run, value)`` and ``fine(id, run, value)`` hold runs known at both
    levels; ``*_points(id, p)``.  The nearest neighbours are found once, as a sparse
    operator that takes all runs together.  The correction is the minimum-norm
    linear map from prolonged fields to what they lack, in dual form: it needs
    only the inner products of the m prolonged runs, an m x m matrix.
    """
    spark = coarse.sparkSession
    tmp = Scratch(spark, "prolong")
    runs = sorted(r.run for r in coarse.select("run").distinct().collect())  # one row a run
    m = len(runs)
    near = knn_join(fine_points, coarse_points, k, d, exclude_self=False)
    weight = 1.0 / (F.col("dist") + 1e-10)
    total = near.groupBy("id").agg(F.sum(weight).alias("total"))
    operator = tmp.write(near.join(total, "id").select("id", "other", (weight / F.col("total")).alias("weight")), "operator")
    # All runs of a point in one array; points that lack a run are left out.
    packed = lambda t: t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", F.col("value").cast("double").alias("value")))).alias("s")).select("id", F.col("s.value").alias("x")).where(F.size("x") == m)
    met = operator.join(packed(coarse).withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.collect_list(F.struct("weight", "x")).alias("s"))  # k entries
    up = met.select("id", F.aggregate("s", F.array_repeat(F.lit(0.0), m), lambda a, e: F.zip_with(a, e["x"], lambda p, q: p + e["weight"] * q)).alias("x"))
    rows = tmp.write(up.join(packed(fine).withColumnRenamed("x", "y"), "id"), "rows")

    def gram(batches):
        total = np.zeros((m, m))
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten(), float).reshape(-1, m)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "r"])

    g = np.zeros((m, m))
    for r in rows.select("x").mapInArrow(gram, "i int, r array<double>").groupBy("i").agg(*[F.sum(F.col("r")[j]).alias(f"r{j}") for j in range(m)]).collect():  # m rows
        g[r.i] = [r[f"r{j}"] for j in range(m)]
    weight = np.linalg.pinv(g + ridge * np.trace(g) / max(m, 1) * np.eye(m), hermitian=True) @ g  # runs in terms of the known ones
    held = spark.sparkContext.broadcast(weight)

    def correct(batches):
        for b in batches:
            x, y = (np.asarray(b.column(c).flatten(), float).reshape(-1, m) for c in ("x", "y"))
            z = x + (y - x) @ held.value
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("id")), m)), pa.array(np.tile(np.arange(m), len(x)), pa.int32()), pa.array(x.ravel()), pa.array(z.ravel())], names=["id", "k", "prolonged", "corrected"])

    out = rows.mapInArrow(correct, f"id {dict(fine.dtypes)['id']}, k int, prolonged double, corrected double")
    return out.select("id", F.get(F.array(*[F.lit(r) for r in runs]), F.col("k")).alias("run"), "prolonged", "corrected")
