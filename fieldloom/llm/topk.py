"""Exact top-k inner products by aggregation of sorted lists without random access.

Each dimension has a list of a block's rows sorted by their value.  A query reads
its lists from the end that its weight favours, all to the same depth.  A row's
upper bound takes the list's frontier for every value not read yet, its lower
bound the list's far end.  A row stays a candidate while its upper bound can
still reach the k-th best score: the k-th of earlier blocks, or the k-th lower
bound of this one.  Reading stops when the rows that can still qualify are few or
the lists end; then the candidates' final scores are resolved and go into the
query's k best.  A partition reads its rows in order of their ids in blocks of
``BLOCK`` (the first ones are shorter, to find good k-th scores early), so a later
row with the same score never displaces an earlier one and many equal rows are
left at once.

Queries go out in blocks of at most ``CELLS`` components, each block read against
all rows where they lie; only k rows for each query and partition are shuffled.
Scores are integers and exact: bounds are sums in double precision where no sum
reaches 2^53, Python integers otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

#: Rows of a block, and of the first one; queries looked at together; components of the queries of one pass.
BLOCK, FIRST, TOGETHER, CELLS = 4_096, 512, 512, 1 << 20
#: Share of the lists that is read at each step, and candidates a query with which reading stops, as a multiple of k.
DEPTHS, FEW = (0.25, 0.5, 0.75, 0.9), 8
#: Integers beyond this are not taken from doubles.
EXACT = 1 << 53


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where a component is null, not finite or beyond 2^53."""
    e = vector.cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v * scale) >= float(EXACT)))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(e, lambda v: F.floor(v * scale)))


class Best:
    """The k best rows so far of each of some queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.exact = q.dtype == object
        self.weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)
        self.score = np.full((len(ids), k), -np.inf if not self.exact else None, self.weights.dtype)
        self.row = np.full((len(ids), k), -1, np.int64)
        self.found = np.zeros(len(ids), np.int64)

    def kth(self, part: slice) -> np.ndarray:
        """Score that a later row must exceed; minus infinity while fewer than k rows are known."""
        return np.where(self.found[part] == self.k, self.score[part, self.k - 1], -np.inf)

    def take(self, at: int, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Merge resolved rows of the queries from ``at`` on; earlier rows win ties."""
        for j in np.unique(query):
            of, own = query == j, at + j
            n = self.found[own]
            s, r = np.concatenate([self.score[own, :n], score[of]]), np.concatenate([self.row[own, :n], row[of]])
            order = np.lexsort((r, -s))[: self.k] if not self.exact else np.array(sorted(range(len(s)), key=lambda i: (-s[i], r[i]))[: self.k])
            self.found[own] = len(order)
            self.score[own, : len(order)], self.row[own, : len(order)] = s[order], r[order]


def read_lists(best: Best, ids: np.ndarray, x: np.ndarray) -> None:
    """Aggregate the sorted lists of one block of rows, whose ids rise, into ``best``."""
    n, k = len(ids), best.k
    lists = np.sort(x, axis=0)  # list j from its least value to its greatest
    far = np.concatenate([lists[0], lists[-1]])
    depths = sorted({min(n, max(k + 1, int(np.ceil(d * n)))) for d in DEPTHS})
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for depth in depths:  # shared by all queries: entries that are read keep their values
        top, low = lists[n - depth], lists[depth - 1]
        upper = np.concatenate([np.maximum(x, top), np.minimum(x, low)], 1)
        lower = np.concatenate([np.where(x >= top, x, far[: x.shape[1]]), np.where(x <= low, x, far[x.shape[1] :])], 1)
        bounds[depth] = upper, lower
    for at in range(0, len(best.ids), TOGETHER):
        part = slice(at, at + TOGETHER)
        w, kth = best.weights[part], best.kth(part)
        own = np.searchsorted(ids, best.ids[part])
        own = np.where((own < n) & (ids[np.minimum(own, n - 1)] == best.ids[part]), own, -1)
        row, query = np.arange(n), np.arange(len(w))
        alive = np.ones((n, len(w)), bool)
        alive[own[own >= 0], np.flatnonzero(own >= 0)] = False
        for depth in depths:
            upper, lower = bounds[depth]
            alive &= upper @ w.T > kth
            if alive.sum() <= FEW * k * len(w):
                break
            if n > k:
                under = np.where(alive, lower @ w.T, -np.inf)
                alive &= upper @ w.T >= np.partition(under, n - k, axis=0)[n - k]
        row, query = np.nonzero(alive)
        for lo in range(0, len(row), 1 << 16):  # resolve what is left of the candidates' lists
            r, j = row[lo : lo + (1 << 16)], query[lo : lo + (1 << 16)]
            s = (x[r] * best.q[at + j]).sum(1)
            fits = s > best.kth(part)[j]
            best.take(at, j[fits], ids[r[fits]], s[fits])


def _searcher(held, k: int, out: str):
    def run(batches):
        asked = {d: (ids, q) for d, (ids, q) in held.value.items()}
        best: dict[int, Best] = {}
        wait: dict[int, list] = {}
        size: dict[int, int] = {}

        def flush(d: int) -> None:
            ids = np.concatenate([i for i, _ in wait[d]])
            x = np.concatenate([v for _, v in wait.pop(d)])
            order = np.argsort(ids, kind="stable")
            ids, x, (qid, q) = ids[order], x[order], asked[d]
            most = max(int(np.abs(x).max()), 1) * max(int(np.abs(q).max()), 1) * d if d else 0
            if most >= EXACT:
                x, q = x.astype(object), q.astype(object)
            if d not in best or best[d].exact != (most >= EXACT):
                old = best.get(d)
                best[d] = Best(qid, q if most >= EXACT else q.astype(np.float64), k)
                if old is not None:  # rows found in the other arithmetic go on
                    for j in range(len(qid)):
                        n = old.found[j]
                        cells = old.score[j, :n] if not old.exact and most < EXACT else np.array([int(v) for v in old.score[j, :n]], object)
                        best[d].take(0, np.full(n, j), old.row[j, :n], cells)
            read_lists(best[d], ids, x if most >= EXACT else x.astype(np.float64))
            size[d] = min(BLOCK, 2 * size[d])

        for b in batches:
            ids, col = np.asarray(b.column("vec_id")), b.column("x")
            length = np.asarray(pc.list_value_length(col))
            for d in np.unique(length).tolist():
                if d not in asked:
                    continue
                at = np.flatnonzero(length == d)
                x = np.asarray(col.take(pa.array(at)).flatten(), np.int64).reshape(len(at), d)
                size.setdefault(d, FIRST)
                for lo in range(0, len(at), BLOCK):
                    lo_at, rest = at[lo : lo + BLOCK], x[lo : lo + BLOCK]
                    while len(lo_at):
                        room = size[d] - sum(len(i) for i, _ in wait.get(d, []))
                        wait.setdefault(d, []).append((ids[lo_at[:room]], rest[:room]))
                        lo_at, rest = lo_at[room:], rest[room:]
                        if sum(len(i) for i, _ in wait[d]) >= size[d]:
                            flush(d)
        for d in list(wait):
            flush(d)
        for got in best.values():
            j, c = np.nonzero(np.arange(k)[None, :] < got.found[:, None])
            score = [int(v) for v in got.score[j, c]]
            if any(abs(v) >= 1 << 63 for v in score):
                raise ArithmeticError("a score does not fit in a long")
            yield pa.RecordBatch.from_arrays([pa.array(got.ids[j], pa.int64()), pa.array(got.row[j, c], pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    ``rows(vec_id, x)`` and ``queries(query_id, x)`` hold distinct ids and integer
    vectors; a row with the query's id is not its candidate.  Vectors of different
    lengths have no product.  Ties go to the smaller ``vec_id``.  A query with
    fewer than k candidates gets them all, one without any gets no row.
    """
    spark, tmp = rows.sparkSession, Scratch(rows.sparkSession, "topk")
    lengths = queries.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    passes = max(1, -(-(lengths.n or 0) * max(lengths.d or 0, 1) // CELLS))
    out = "query_id long, vec_id long, score long"
    found = []
    for p in range(passes):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).select("query_id", "x").toArrow()  # about CELLS components
        ids, col = np.asarray(asked.column("query_id")), asked.column("x").combine_chunks()
        length = np.asarray(pc.list_value_length(col)) if len(ids) else np.empty(0, np.int64)
        block = {}
        for d in np.unique(length).tolist():
            at = np.flatnonzero(length == d)
            block[d] = ids[at], np.asarray(col.take(pa.array(at)).flatten(), np.int64).reshape(len(at), d)
        held = spark.sparkContext.broadcast(block)
        got = rows.select("vec_id", "x").mapInArrow(_searcher(held, k, out), out)
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.append(tmp.write(got.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")._scratch_path)
        held.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*found)


def vector_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """Top-k rows of ``vectors(vec_id, embedding)`` for those whose id is divisible by ``every``.

    Components become floor(scale * x).  Vectors that are null or hold null,
    non-finite or huge (beyond 2^53 / scale) components, and rows without an id,
    take no part.  Rows that repeat an id are that vector (the smallest, if they
    differ) and count once.  Empty vectors have product 0 with each other.  An
    empty table gives an empty one; other columns are not read.
    """
    tmp = Scratch(vectors.sparkSession, "topk")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("x")).where("vec_id is not null and x is not null")
    rows = tmp.write(sound.groupBy("vec_id").agg(F.min("x").alias("x")).sortWithinPartitions("vec_id"), "rows")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x"), k)
