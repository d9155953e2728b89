"""Toxicity by a chain of linear classifiers.

Categories are predicted in turn, each by a logistic model over the same
indicative words and word beginnings and over the probabilities of the categories
before it.  The links are trained with out-of-fold predictions, so a later model
sees earlier probabilities as good as they will be on new text.

``categories`` names the 0/1 columns of the label table in the order of the
chain; the last one decides.  The given label table knows one category,
``toxic``.  For it, the earlier links are stand-ins derived from the label and
the mined words: ``insult`` (toxic with an indicative whole word), ``inflected``
(toxic with an indicative word beginning only), ``persistent`` (toxic with three
or more indicative words).

Words are mined from at most ``max_train`` labelled rows (a documented bound,
chosen by hash of the id), of which only the per-word document counts are
shuffled; at most ``MAX_WORDS`` signs that ``LEAST_DOCS`` or more positive
documents hold become features; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.quality import held_out
from fieldloom.llm.text import ALNUM, Words, bounded_sample, map_batches, mix64, parts, raw_column, small_batches, utf8

#: Stand-ins that are derived from a single label.
DERIVED = ("insult", "inflected", "persistent")
MAX_TRAIN, MAX_WORDS, LEAST_DOCS, FOLDS = 20_000, 1024, 3, 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
_BASE = np.uint64(0x100000001B3)


def _signs(w: Words) -> list[np.ndarray]:
    """Hashes of whole words and of their first bytes; 0 where a word is too short."""
    out = [w.hash | np.uint64(1)]
    size = w.end - w.start
    for k in PREFIXES:
        h, ok = np.zeros(len(size), np.uint64), np.flatnonzero(size > k)
        x = np.full(len(ok), k, np.uint64)
        for j in range(k):
            x = x * _BASE + w.folded[w.start[ok] + j]
        h[ok] = mix64(x) & ~np.uint64(1) | np.uint64(2)
        out.append(h)
    return out


def _mine(batch: pa.RecordBatch) -> dict:
    """Distinct signs of each labelled document of the batch, counted by label."""
    w = Words(*raw_column(batch, "text"), ALNUM)
    y = np.asarray(batch.column("toxic"), np.int64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(w.of_text))
    signs = _signs(w)
    h, d = np.concatenate(signs), np.tile(doc, len(signs))
    d, h = d[h > 0], h[h > 0]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.empty(0, bool)
    h, d = h[new], d[new]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    sums = lambda v: np.add.reduceat(v, first) if len(first) else np.empty(0, np.int64)
    return {"sign": h[first].view(np.int64), "pos": sums(y[d]), "neg": sums(1 - y[d])}


def _bag(signs: np.ndarray):
    """Function from a batch to (row, sign index, whole word) of the indicative signs."""
    table = np.zeros(1 << 20, bool)
    u = np.sort(signs.view(np.uint64))
    table[u >> np.uint64(44)] = True

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = Words(*raw_column(batch, "text"), ALNUM)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(w.of_text))
        rows, cols, at = [], [], []
        for h in _signs(w):
            i = np.flatnonzero(table[h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(u, h[i]), max(0, len(u) - 1))
            ok = u[k] == h[i] if len(u) else np.zeros(len(i), bool)
            rows.append(doc[i[ok]]), cols.append(k[ok]), at.append(i[ok])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(at)

    return of


@dataclass
class Link:
    weight: np.ndarray
    prior: np.ndarray  # weights of earlier probabilities
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _apply(link: Link, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    z = np.bincount(rows, link.weight[cols], n) if len(rows) else np.zeros(n)
    return _sigmoid(z + earlier @ link.prior + link.bias)


def _fit(rows, cols, n, width, earlier, y, steps: int = 300, penalty: float = 2e-6, mask=None) -> Link:
    """Logistic regression by accelerated gradient steps over the sparse rows."""
    w = np.zeros(width + earlier.shape[1] + 1)
    v, m = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = _apply(Link(w[:width], w[width:-1], w[-1]), rows, cols, n, earlier)
        e = (p - y) / max(1, n)
        e = e if mask is None else e * mask
        g = np.concatenate([np.bincount(cols, e[rows], width), earlier.T @ e, [e.sum()]]) + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Link(w[:width], w[width:-1], float(w[-1]))


def fit_chain(rows: np.ndarray, cols: np.ndarray, n: int, width: int, targets: np.ndarray) -> list[Link]:
    """One link for each category; earlier probabilities come from other folds."""
    fold, chain, earlier = np.arange(n) % FOLDS, [], np.zeros((n, 0))
    for y in targets.T:
        chain.append(_fit(rows, cols, n, width, earlier, y))
        oof = np.zeros(n)
        for f in range(FOLDS):
            use = fold[rows] != f
            inside = fold != f
            link = _fit(rows[use], cols[use], n, width, earlier * inside[:, None], y * inside, steps=150, mask=inside) if inside.any() else chain[-1]
            oof[~inside] = _apply(link, rows, cols, n, earlier)[~inside]
        earlier = np.column_stack([earlier, oof])
    return chain


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, categories: Sequence[str] = ("toxic",)) -> DataFrame:
    """``doc_id, held_out``, ``p_<category>`` for each category, ``score`` and ``toxic``.

    Rows whose id has checksum 2 modulo 4 are never trained on; null labels count
    as 0 where another category is given.  Null and empty texts have no signs and
    get the chain's floor; each repeated row is scored by itself, and an id that
    repeats trains once (the smallest text).  Without usable labels nothing is toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [*DERIVED, *categories] if len(categories) == 1 else list(categories)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    known = F.coalesce(*[F.col(c).cast("int") for c in categories]).isNotNull()
    y = labels.where(F.col("doc_id").isNotNull() & known).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories)])
    ys = [f"y{k}" for k in range(len(categories))]
    y = bounded_sample(y.where(~held_out()), max_train, "doc_id")
    sample = docs.join(F.broadcast(y), "doc_id")  # at most max_train small rows are broadcast
    any_ = F.greatest(F.lit(0), *ys)
    n1, n0 = (int(v or 0) for v in y.agg(F.sum(any_), F.sum(1 - any_)).first())
    if not n1:
        return docs.select("doc_id", held_out().alias("held_out"), *[F.lit(0.0).alias(f"p_{c}") for c in names], F.lit(0.0).alias("score"), F.lit(False).alias("toxic"))
    mined = map_batches(sample.select(any_.alias("toxic"), "text"), _mine, "sign long, pos long, neg long").groupBy("sign").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_DOCS)
    share = (F.col("pos") + 0.5) / (n1 + 1.0)
    lift = F.log(share * (n0 + 1.0) / (F.col("neg") + 0.5))
    best = mined.withColumn("gain", F.col("pos") * lift).where(lift > 1.5).orderBy(F.desc("gain"), "sign").limit(MAX_WORDS).select("sign").toPandas().sign.to_numpy(np.int64)
    signs = np.sort(best.view(np.uint64)).view(np.int64)
    whole = (signs & 1).astype(bool)

    def matrix(batch: pa.RecordBatch) -> dict:
        r, c, at = _bag(signs)(batch)
        order = np.lexsort((c, r))
        r, c, at = r[order], c[order], at[order]
        cut = np.searchsorted(r, np.arange(batch.num_rows + 1))
        places = [len(np.unique(at[a:b])) for a, b in zip(cut[:-1], cut[1:])]
        return {"doc_id": batch.column("doc_id"), "y": list(np.column_stack([np.asarray(batch.column(c), np.int32) for c in ys])), "cols": [np.unique(c[a:b]) for a, b in zip(cut[:-1], cut[1:])], "hits": places}

    rows_ = map_batches(sample.select("doc_id", *ys, "text"), matrix, "doc_id long, y array<int>, cols array<int>, hits int")
    train = rows_.groupBy("doc_id").agg(F.min(F.struct("cols", "hits", "y")).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")  # max_train rows at most
    n = len(train)
    cols = np.concatenate([np.asarray(x, np.int64) for x in train.cols] + [np.empty(0, np.int64)])
    rows = np.repeat(np.arange(n), [len(x) for x in train.cols])
    targets, hits = np.array(train.y.tolist(), float).reshape(n, len(ys)), train.hits.to_numpy()
    if len(categories) == 1:
        tox = targets[:, 0]
        has_whole = np.bincount(rows, whole[cols].astype(float), n) > 0 if len(rows) else np.zeros(n, bool)
        targets = np.column_stack([tox * has_whole, tox * (~has_whole & (hits > 0)), tox * (hits >= 3), tox])
    model = spark.sparkContext.broadcast((signs, fit_chain(rows, cols, n, len(signs), targets)))

    def score(batches):
        signs, chain = model.value
        bag = _bag(signs)
        for b in (p for whole in batches for p in parts(whole)):
            r, c, _ = bag(b)
            both = np.unique(r * np.int64(len(signs) + 1) + c)
            r, c = both // (len(signs) + 1), both % (len(signs) + 1)
            p = np.zeros((b.num_rows, 0))
            for link in chain:
                p = np.column_stack([p, _apply(link, r, c, b.num_rows, p)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.float64()) for x in p.T]], names=["doc_id", *[f"p_{x}" for x in names]])

    out = docs.mapInArrow(score, "doc_id long, " + ", ".join(f"`p_{c}` double" for c in names))
    last = F.col(f"p_{names[-1]}")
    return out.select("doc_id", held_out().alias("held_out"), *[f"p_{c}" for c in names], last.alias("score"), (last >= THRESHOLD).alias("toxic"))
