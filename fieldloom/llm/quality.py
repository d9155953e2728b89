"""Quality scores by a generalised additive model with pairwise interactions.

Whole texts become fourteen numbers in one vectorised pass.  Features are cut at
quantiles; boosting visits the features in turn, fits a shallow tree to the
logistic gradient along one feature's bins and adds a damped copy to that
feature's lookup table.  Then the pairs whose joint grid explains most of the
remaining gradient are boosted in the same way by four-leaf trees on the grid.
A score is a sum of looked-up numbers through the logistic function.

Training takes at most ``max_train`` labelled rows (a documented bound, chosen
by a hash of the id so that it does not depend on partitions); scoring covers
every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import SPACE, Words, annotate, bounded_sample, map_batches, raw_column, small_batches, utf8, window_hashes
from fieldloom.sources.scratch import Scratch

MAX_TRAIN = 20_000
THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "bars", "shouts", "lines", "stops", "short_words", "distinct_words", "repeated_runs", "repeated_lines", "top_word")

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*@^~<>={}[]\\_+", "0123456789", "|", "!", "\n", ".,;:?", "abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_chars.encode())] = _i


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers for each text."""
    w = Words(data, offs, SPACE)
    lo, length = w.of_text, w.end - w.start
    run = window_hashes(w.hash, 5)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for t in range(len(offs) - 1):
        raw, h, size = data[offs[t] : offs[t + 1]], w.hash[lo[t] : lo[t + 1]], length[lo[t] : lo[t + 1]]
        n, chars = len(h), max(1, len(raw))
        kind = np.zeros(9, np.int64)
        for at in range(0, len(raw), 1 << 20):
            kind += np.bincount(_CLASS[raw[at : at + (1 << 20)]], minlength=9)
        row = out[t]
        row[0] = np.log1p(n)
        row[2] = kind[1] / max(1, kind[1] + kind[8])
        row[3:9] = kind[2:8] / chars
        if n:
            _, c = np.unique(h, return_counts=True)
            row[1], row[9], row[10], row[13] = size.mean(), (size <= 3).mean(), len(c) / n, c.max() / n
            r = run[lo[t] : max(lo[t], lo[t + 1] - 4)]
            row[11] = 1 - len(np.unique(r)) / len(r) if len(r) else 0
        lines = raw.tobytes().split(b"\n")
        row[12] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
            for (i, j), g in zip(self.pairs, self.grids):
                z += g[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values along ordered bins: the best split is taken until ``leaves`` are reached."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p in parts:
            a, b = p
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (gains[k], p, a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four-leaf tree on a grid: one cut along each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    q = lambda c: (c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1, -1] - c[-1:, :-1] - c[:-1, -1:] + c[:-1, :-1])
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    gq, hq = q(cg), q(ch)
    gains = sum(_gain(a, b) for a, b in zip(gq, hq))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    v = [_leaf(a[i, j], b[i, j]) for a, b in zip(gq, hq)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[i + 1 :, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, j + 1 :] = v
    return out, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, leaves: int = 3) -> Model:
    """Boost main effects in cycles, then the strongest interactions."""
    if not len(y):
        return Model(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    m = Model(float(np.log(p0 / (1 - p0))), [_cuts(v, 64) for v in x.T], [])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    z = np.full(len(y), m.base)
    grad = lambda: (y - (p := 1 / (1 + np.exp(-z))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for j, b in enumerate(bins):
            g, h = grad()
            step = rate * _tree(np.bincount(b, g, len(m.tables[j])), np.bincount(b, h, len(m.tables[j])), leaves)
            m.tables[j] += step
            z += step[b]
    m.coarse = [_cuts(v, 16) for v in x.T]
    cb = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.coarse)]
    size = [len(e) + 1 for e in m.coarse]
    grid = lambda i, j, v: np.bincount(cb[i] * size[j] + cb[j], v, size[i] * size[j]).reshape(size[i], size[j])
    g, h = grad()
    ranked = sorted(((-_quadrants(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(len(size)) for j in range(i)))
    m.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    m.grids = [np.zeros((size[i], size[j])) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(m.pairs):
            g, h = grad()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[0]
            m.grids[k] += step
            z += step[cb[i], cb[j]]
    return m


def held_out(col: str = "doc_id", mod: int = 4, rest: int = 2) -> Column:
    """Whether the id's checksum sets its row aside from training."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the numbers of each text."""

    def one(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "x": list(measure(*raw_column(batch, "text")))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), one, "doc_id long, x array<double>")


def drawn(labels: DataFrame, max_train: int, column: str = "quality") -> DataFrame:
    """``doc_id, y`` of at most ``max_train`` labelled ids outside the held-out fold."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("double").alias("y"))
    return bounded_sample(y.where(~held_out()), max_train, "doc_id")


def train(feats: DataFrame, y: DataFrame) -> Model:
    """Fit on the rows drawn for training; one row an id reaches the driver (the smallest, if an id repeats)."""
    rows = feats.join(y, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas().sort_values("doc_id", kind="stable")  # max_train rows at most
    return fit(np.array(rows.x.tolist()).reshape(-1, len(FEATURES)), rows.y.to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null and empty texts have the features of an empty text and are scored too;
    each repeated row is scored by itself.  Without usable labels every score is
    one half.
    """
    small_batches(docs.sparkSession)
    feats = Scratch(docs.sparkSession, "quality").write(features(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(train(feats, drawn(labels, max_train)))

    def one(batch: pa.RecordBatch) -> dict:
        x = np.array(batch.column("x").to_pylist()).reshape(-1, len(FEATURES))
        s = model.value.score(x)
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_batches(feats, one, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` predicted to be of label 1, with their columns whatever their names.

    Only the texts drawn for training are measured twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    y = Scratch(spark, "quality").write(drawn(labels, max_train), "drawn")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y.select("doc_id")), "doc_id", "left_semi")  # max_train ids at most are broadcast
    model = spark.sparkContext.broadcast(train(features(chosen), y))
    out = annotate(docs, lambda b: {"score": model.value.score(measure(*raw_column(b, "text")))}, "score double")
    return out.where(F.col("score") >= THRESHOLD).select("row.*")
