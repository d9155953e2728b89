"""Normal equations, sparse regression and equation discovery.

One pass reduces n rows to the k x k sums; the driver solves the small problem;
the answer goes back as a generated column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.order import next_rows


def normal_equations(df: DataFrame, columns: Sequence[Column], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``i, j, s``: sums of products of every pair i <= j of ``columns``, by group.

    Rows with a null or non-finite entry are left out.  Each Arrow batch becomes
    one small Gram matrix; only those are shuffled.
    """
    k = len(columns)
    src = df.select(*by, F.array(*[c.cast("double") for c in columns]).alias("__t"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    fields = ", ".join(f"`{c}` {dict(src.dtypes)[c]}" for c in by)
    iu, ju = np.triu_indices(k)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t, w = dense(b.column("__t"), k), np.asarray(pc.fill_null(b.column("__w"), np.nan))
            rows = np.flatnonzero(np.isfinite(t).all(1) & np.isfinite(w))
            code, first = group_codes([b.column(c) for c in by], b.num_rows)
            rows = rows[np.argsort(code[rows], kind="stable")]
            cut = np.searchsorted(code[rows], np.arange(len(first) + 1))
            sums, seen = [], []
            for g in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                x = t[rows[cut[g] : cut[g + 1]]]
                sums.append(((x * w[rows[cut[g] : cut[g + 1]], None]).T @ x)[iu, ju])
                seen.append(first[g])
            m, take = len(sums), pa.array(np.repeat(np.array(seen, np.int64), len(iu)))
            out = {c: b.column(c).take(take) for c in by}
            out |= {"i": pa.array(np.tile(iu, m), pa.int32()), "j": pa.array(np.tile(ju, m), pa.int32()), "s": pa.array(np.concatenate(sums) if m else np.empty(0))}
            yield pa.RecordBatch.from_pydict(out)

    return src.mapInArrow(run, (fields + ", " if fields else "") + "i int, j int, s double").groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def dense(col: pa.Array, k: int) -> np.ndarray:
    """Rows of ``k`` numbers; null entries are NaN."""
    return np.asarray(pc.fill_null(pc.list_flatten(col), np.nan), np.float64).reshape(-1, k)


def group_codes(columns: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row by its keys (nulls are a key), and a row of each number."""
    code = np.zeros(n, np.int64)
    for c in columns:
        d = pc.dictionary_encode(c, null_encoding="encode")
        code = code * (len(d.dictionary) + 1) + np.asarray(d.indices, np.int64)
        code = np.unique(code, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def gram_matrix(sums: DataFrame, k: int) -> np.ndarray:
    """The k x k matrix of one group's sums, on the driver."""
    g = np.zeros((k, k))
    for r in sums.select("i", "j", "s").collect():  # k * (k + 1) / 2 rows
        g[r.i, r.j] = g[r.j, r.i] = r.s
    return g


def library(columns: Sequence[str], degree: int = 2) -> list[tuple[str, Column]]:
    """Names and columns of 1, x, x squared, cross products and (degree 3) cubes."""
    out: list[tuple[str, Column]] = [("1", F.lit(1.0))] + [(c, F.col(c)) for c in columns]
    if degree >= 2:
        out += [(f"{c}^2", F.col(c) ** 2) for c in columns]
        out += [(f"{a}*{b}", F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if degree >= 3:
        out += [(f"{c}^3", F.col(c) ** 3) for c in columns]
    return out


def fourier_library(columns: Sequence[str], n: int = 2) -> list[tuple[str, Column]]:
    return [(f"{f}({k}*{c})", getattr(F, f)(k * F.col(c))) for c in columns for k in range(1, n + 1) for f in ("sin", "cos")]


def derivative(df: DataFrame, value: str, along: str, by: Sequence[str], name: str) -> DataFrame:
    """Central differences inside, one-sided at the ends; spacing may vary. One line of a key is one window."""
    w = Window.partitionBy(*by).orderBy(along)
    u, x = F.col(value), F.col(along)
    up, un, xp, xn = F.lag(value).over(w), F.lead(value).over(w), F.lag(along).over(w), F.lead(along).over(w)
    hp, hn = x - xp, xn - x
    mid = (hp * hp * un + (hn * hn - hp * hp) * u - hn * hn * up) / (hp * hn * (hp + hn))
    return df.withColumn(name, F.when(xp.isNull(), (un - u) / hn).when(xn.isNull(), (u - up) / hp).otherwise(mid))


def solve(g: np.ndarray, p: int) -> np.ndarray:
    """Minimum-norm least squares of the columns p.. on the first p, from their Gram matrix."""
    d = np.sqrt(np.maximum(np.diag(g)[:p], 1e-300))
    return np.linalg.pinv(g[:p, :p] / np.outer(d, d), rcond=1e-12, hermitian=True) @ (g[:p, p:] / d[:, None]) / d[:, None]


def stlsq(g: np.ndarray, p: int, threshold: float, rounds: int = 20) -> np.ndarray:
    """Sequentially thresholded least squares from the Gram matrix alone."""
    c = solve(g, p)
    for _ in range(rounds):
        before, small = c.copy(), np.abs(c) < threshold
        c = np.where(small, 0.0, c)
        for o in range(c.shape[1]):
            on = np.flatnonzero(~small[:, o])
            if len(on):
                idx = np.append(on, p + o)
                c[on, o] = solve(g[np.ix_(idx, idx)], len(on))[:, 0]
        if np.allclose(c, before):
            break
    return c


def lasso(g: np.ndarray, p: int, alpha: float, rounds: int = 100) -> np.ndarray:
    """Coordinate descent on unscaled sums, so alpha depends on the size of the data."""
    out = np.zeros((p, g.shape[0] - p))
    for o in range(out.shape[1]):
        c = out[:, o]
        for _ in range(rounds):
            for j in range(p):
                r = g[j, p + o] - g[j, :p] @ c + g[j, j] * c[j]
                c[j] = np.sign(r) * max(abs(r) - alpha, 0.0) / g[j, j] if g[j, j] else 0.0
    return out


def sr3(g: np.ndarray, p: int, threshold: float, nu: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Relaxed regression: ridge towards the thresholded copy of itself."""
    w = solve(g, p)
    for _ in range(rounds):
        c = np.linalg.solve(g[:p, :p] + nu * np.eye(p), g[:p, p:] + nu * w)
        w = np.where(np.abs(c) < threshold, 0.0, c)
        if np.linalg.norm(c - w) < 1e-6:
            break
    return w


def r_squared(g: np.ndarray, p: int, c: np.ndarray, ones: int = 0) -> np.ndarray:
    """Per output; column ``ones`` of the library is the constant."""
    yy, n = np.diag(g)[p:], g[ones, ones]
    rss = yy - 2 * (c * g[:p, p:]).sum(0) + np.einsum("io,ij,jo->o", c, g[:p, :p], c)
    tss = yy - g[ones, p:] ** 2 / n
    return 1 - rss / np.where(tss > 0, tss, np.nan)


def sindy_fit(df: DataFrame, terms: Sequence[tuple[str, Column]], targets: Sequence[str], threshold: float = 0.1, optimizer: str = "stlsq", alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Sparse coefficients (terms x targets) and R squared, from one pass."""
    cols = [c for _, c in terms] + [F.col(t) for t in targets]
    g, p = gram_matrix(normal_equations(df, cols), len(cols)), len(terms)
    c = {"stlsq": lambda: stlsq(g, p, threshold), "lasso": lambda: lasso(g, p, alpha), "sr3": lambda: sr3(g, p, threshold)}[optimizer]()
    return c, r_squared(g, p, c)


def predict(terms: Sequence[tuple[str, Column]], coef: np.ndarray) -> Column:
    out = F.lit(0.0)
    for (_, c), k in zip(terms, coef):
        if k:
            out = out + float(k) * c
    return out


def pde_library(derivatives: Sequence[str], order: int = 2, dedupe: bool = True) -> list[tuple[str, Column]]:
    """1, u, u_x, ..., their products and u times each derivative; doubles dropped unless asked for."""
    out = [("1", F.lit(1.0))] + [(d, F.col(d)) for d in derivatives]
    if order >= 2:
        out += [(f"{a}*{b}", F.col(a) * F.col(b)) for a in derivatives for b in derivatives if a <= b]
    if not dedupe or order < 2:
        out += [(f"u*{d}", F.col("u") * F.col(d)) for d in derivatives if d != "u"]
    return out


def score_expressions(df: DataFrame, exprs: dict[str, tuple[Column, int]], target: str, penalty: float = 0.01, batch: int = 200) -> DataFrame:
    """``name, mse, score`` of candidate expressions, up to ``batch`` in one scan."""
    names, parts = list(exprs), []
    for at in range(0, len(names), batch):
        part = names[at : at + batch]
        one = df.agg(*[F.avg((exprs[n][0] - F.col(target)) ** 2).alias(f"e{i}") for i, n in enumerate(part)])
        rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"e{i}").alias("mse"), (F.col(f"e{i}") + penalty * exprs[n][1]).alias("score")) for i, n in enumerate(part)])
        parts.append(one.select(F.explode(rows).alias("r")).select("r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weak_sindy(df: DataFrame, terms: Sequence[tuple[str, Column]], state: str, time: str, n_tests: int = 20, threshold: float = 0.1, test_function: str = "bump") -> np.ndarray:
    """Sparse coefficients from integrals against bump, Gaussian or sine functions, without derivatives of the data.

    The functions overlap and tile the time span; each row meets the few whose
    support holds it.  Integrals are trapezoids in time order of each ``run_id``
    (one run if there is none); neighbours in time are met by rank, so that a run
    of any length is spread over tasks.
    """
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    half = 2.0 * (hi - lo) / (n_tests + 1)
    centres = [lo + (hi - lo) * (k + 1) / (n_tests + 1) for k in range(n_tests)]
    key = "run_id" if "run_id" in df.columns else "__run"
    rows = df if key == "run_id" else df.withColumn(key, F.lit(0))
    rows = next_rows(rows, key, [time], [time], back=True)
    dt = (F.coalesce(f"next_{time}", time) - F.coalesce(f"prev_{time}", time)) / 2
    tests = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(centres)])
    rows = rows.withColumn("__dt", dt).withColumn("__k", F.explode(F.filter(tests, lambda s: F.abs(F.col(time) - s["c"]) < half)))
    z = (F.col(time) - F.col("__k.c")) / half
    bump, slope = bump_test(z, test_function)
    inside = (F.col("__k.c") - half >= lo) & (F.col("__k.c") + half <= hi)
    sums = rows.where(inside).groupBy(F.col("__k.k").alias("k")).agg(*[F.sum(c * bump * F.col("__dt")).alias(f"t{i}") for i, (_, c) in enumerate(terms)], (-F.sum(F.col(state) * slope / half * F.col("__dt"))).alias("y")).toPandas()  # n_tests rows
    a = np.column_stack([sums[[f"t{i}" for i in range(len(terms))]].to_numpy(float), sums.y.to_numpy(float)])
    return stlsq(a.T @ a, len(terms), threshold)[:, 0]


def bump_test(z: Column, kind: str) -> tuple[Column, Column]:
    """A test function on (-1, 1) that ends at 0, and its derivative."""
    if kind == "bump":
        f, d = (1 - z * z) ** 2, -4 * z * (1 - z * z)
    elif kind == "gaussian":  # minus its end value, so that it vanishes there
        end = float(np.exp(-4.5))
        f, d = F.exp(-4.5 * z * z) - end, -9 * z * F.exp(-4.5 * z * z)
    elif kind == "sine":
        f, d = F.cos(z * np.pi / 2) ** 2, -np.pi / 2 * F.sin(z * np.pi)
    else:
        raise ValueError(f"no test function {kind}")
    return f, d


def sindy_constrained(coef: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Coefficients projected onto linear constraints a c = b, then thresholded."""
    c = coef - np.linalg.pinv(a) @ (a @ coef - b)
    return np.where(np.abs(c) < threshold, 0.0, c)


def pde_find(grid: DataFrame, derivative_order: int = 2, polynomial_order: int = 2, threshold: float = 0.1, trim: int = 0, by: str = "run_id") -> tuple[str, dict[str, float], float]:
    """Equation, coefficients by term and mean squared residual of u_t on a grid ``run_id, it, ix, t, x, u``.

    Derivatives are differences along lines of the grid; rows that are not finite
    are left out.  ``trim`` leaves out that many points at each end of both axes,
    where differences are one-sided.
    """
    from fieldloom.operators.fields import finite_rows

    keys = [by] if by in grid.columns else []
    d = derivative(grid, "u", "t", [*keys, "ix"], "u_t")
    names = ["u"]
    for k in range(derivative_order):
        d = derivative(d, names[-1], "x", [*keys, "it"], "u" + "_x" * (k + 1))
        names.append("u" + "_x" * (k + 1))
    if trim:
        ends = d.agg(F.min("it"), F.max("it"), F.min("ix"), F.max("ix")).first()
        d = d.where(F.col("it").between(ends[0] + trim, ends[1] - trim) & F.col("ix").between(ends[2] + trim, ends[3] - trim))
    rows = finite_rows(d, ["u_t", *names])
    terms = pde_library(names, polynomial_order)
    p = len(terms)
    g = gram_matrix(normal_equations(rows, [c for _, c in terms] + [F.col("u_t")]), p + 1)
    c = stlsq(g, p, threshold)[:, 0]
    found = {n: float(v) for (n, _), v in zip(terms, c) if abs(v) > 1e-10}
    rest = g[p, p] - 2 * c @ g[:p, p] + c @ g[:p, :p] @ c
    return "u_t = " + (" + ".join(f"{v:.4f}*{n}" for n, v in found.items()) or "0"), found, float(max(rest, 0.0) / max(g[0, 0], 1.0))
