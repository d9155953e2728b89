"""A sparse matrix that is multiplied many times: it is dealt once and stays where it lies.

An entry lies in a bucket by one of its two ends, the one on the side of more
distinct ids, so that ends of few ids (hubs) are repeated in the buckets and
the others lie in one.  A bucket is packed to arrays over its own nodes.  A vector
lies in homes by a hash of the id, together with the buckets that its
nodes occur in; a product sends each bucket the values of its nodes, and
each home the sums.  No product shuffles, sorts or writes the matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

#: Entries of a bucket, of one of fewer than there are cores, and of one packed row: a scan holds a
#: hundred of these at least, whatever their size.
ENTRIES, LEAST, PIECE = 4_000_000, 250_000, 16_384
_STATE = "home long, ids array<long>, known array<boolean>, buckets array<long>, lens array<int>, at array<int>, vs array<array<double>>"


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _list(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _cells(tab: pa.Table, name: str) -> list[np.ndarray]:
    return [np.asarray(v.values) for v in tab.column(name)]


def _state(home: int, ids: np.ndarray, known: np.ndarray, buckets: np.ndarray, lens: np.ndarray, at: np.ndarray, vs: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "home": pa.array([home], pa.int64()), "ids": _list([ids], pa.int64()), "known": _list([known], pa.bool_()), "buckets": _list([buckets], pa.int64()),
        "lens": _list([lens], pa.int32()), "at": _list([at], pa.int32()), "vs": pa.array([vs], pa.list_(pa.list_(pa.float64()))),
    })


class DealtMatrix:
    """``row, col, value`` with integer ids, a written table; vectors are states of ``start`` and ``step``."""

    def __init__(self, matrix: DataFrame, tmp: Scratch):
        low, high = F.least("row", "col"), F.greatest("row", "col")
        n, lows, highs = matrix.agg(F.count("*"), F.approx_count_distinct(low), F.approx_count_distinct(high)).first()
        cores = matrix.sparkSession.sparkContext.defaultParallelism
        self.n = buckets = max(1 + n // ENTRIES, min(cores, 1 + n // LEAST))
        # Which end it is changes how much travels, never a sum.
        anchor = low if lows > highs else high

        def pack(key: tuple, tab: pa.Table) -> pa.Table:
            row, col, value = (np.asarray(tab.column(c)) for c in ("row", "col", "value"))
            ids = np.unique(np.concatenate([row, col]))
            home = _home(ids, buckets)
            order = np.lexsort((ids, home))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids), dtype=np.int32)
            row, col = place[np.searchsorted(ids, row)], place[np.searchsorted(ids, col)]
            by = np.lexsort((col, row))
            row, col, value = row[by], col[by], value[by]
            ids, home = ids[order], home[order]
            at = [slice(a, a + PIECE) for a in range(0, len(row), PIECE)]
            cut = np.flatnonzero(np.diff(home, prepend=-1))
            members = np.split(ids, cut[1:])
            k, m = len(at), len(members)
            return pa.table({
                "bucket": pa.array([key[0].as_py()] * (k + m), pa.int64()),
                "home": pa.array([None] * k + home[cut].tolist(), pa.int64()),
                "ids": _list([None] * k + members, pa.int64()),
                "row": _list([row[s] for s in at] + [None] * m, pa.int32()),
                "col": _list([col[s] for s in at] + [None] * m, pa.int32()),
                "value": _list([value[s] for s in at] + [None] * m, pa.float64()),
            })

        rows = matrix.where("row is not null and col is not null").select(F.pmod(F.xxhash64(anchor), F.lit(buckets)).alias("bucket"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
        packed = rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(pack, "bucket long, home long, ids array<long>, row array<int>, col array<int>, value array<double>")
        self.packed = tmp.bucketed(packed, "dealt", "bucket", buckets, placed=True, group=16 << 20)

    def start(self, f: DataFrame) -> DataFrame:
        """The state of a vector ``row, value``; ids of the matrix that it lacks count as 0."""
        buckets = self.n

        def place(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_home(np.asarray(b.column(0)), buckets)), b.column(0), b.column(1)], names=["home", "id", "value"])

        def meet(key: tuple, routes: pa.Table, own: pa.Table) -> pa.Table:
            ids, known, v = np.asarray(own.column("id")), np.asarray(own.column("value").is_valid()), np.asarray(own.column("value").fill_null(0.0))
            order = np.argsort(ids, kind="stable")
            ids, known, v = ids[order], known[order], v[order]
            routes = routes.sort_by("bucket")
            at = []
            for of in _cells(routes, "ids"):
                i = np.searchsorted(ids, of)
                at.append(np.where(np.r_[ids, 0][i] == of, i, len(ids)) if len(ids) else np.zeros(len(of), np.int64))
                at[-1][i == len(ids)] = len(ids)
            return _state(key[0].as_py(), ids, known, np.asarray(routes.column("bucket")), np.array([len(a) for a in at]), np.concatenate(at) if at else np.zeros(0, np.int64), [v])

        routes = self.packed.where("home is not null").select("home", "bucket", "ids")
        own = f.where("row is not null").select(F.col("row").cast("long").alias("row"), F.col("value").cast("double").alias("value")).mapInArrow(place, "home long, id long, value double")
        return routes.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(meet, _STATE)

    def step(self, state: DataFrame, update: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]) -> DataFrame:
        """The state of ``update(vectors, product)``, the product being that of the matrix and the first vector."""

        def send(batches):
            for b in batches:
                tab = pa.Table.from_batches([b])
                for home, known, to, lens, at, vs in zip(tab.column("home").to_pylist(), *(_cells(tab, c) for c in ("known", "buckets", "lens", "at")), tab.column("vs")):
                    if len(to):
                        x = np.r_[np.where(known, np.asarray(vs.values[0].values), 0.0), 0.0][at]
                        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array([home] * len(to), pa.int64()), _list(np.split(x, np.cumsum(lens)[:-1]), pa.float64())], names=["bucket", "home", "v"])

        def product(key: tuple, part: pa.Table, got: pa.Table) -> pa.Table:
            got = got.sort_by("home")
            v = _cells(got, "v")
            x = np.concatenate(v)
            y = np.zeros(len(x))
            for row, col, value in zip(*(_cells(part, c) for c in ("row", "col", "value"))):
                y += np.bincount(row, weights=value * x[col], minlength=len(x))
            return pa.table({"home": got.column("home"), "bucket": pa.array([key[0].as_py()] * len(v), pa.int64()), "v": _list(np.split(y, np.cumsum([len(a) for a in v])[:-1]), pa.float64())})

        def take(key: tuple, own: pa.Table, sums: pa.Table) -> pa.Table:
            ids, known, to, lens, at = (_cells(own, c)[0] for c in ("ids", "known", "buckets", "lens", "at"))
            vs = [np.asarray(v.values) for v in own.column("vs")[0].values]
            total, cut = np.zeros(len(ids) + 1), dict(zip(to.tolist(), np.split(at, np.cumsum(lens)[:-1])))
            # Buckets come in their order, so sums are the same in every run.
            sums = sums.sort_by("bucket")
            for b, v in zip(sums.column("bucket").to_pylist(), _cells(sums, "v")):
                total[cut[b]] += v  # a node occurs once in a bucket; the last place is for ids that the vector lacks
            return _state(key[0].as_py(), ids, known, to, lens, at, update(vs, total[:-1]))

        sent = state.mapInArrow(send, "bucket long, home long, v array<double>")
        parts = self.packed.where("home is null").select("bucket", "row", "col", "value")
        sums = parts.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(product, "home long, bucket long, v array<double>")
        return state.groupBy("home").cogroup(sums.groupBy("home")).applyInArrow(take, _STATE)

    @staticmethod
    def read(state: DataFrame, k: int) -> DataFrame:
        """``row, value`` of the state's ``k``-th vector; unknown where the first vector was."""

        def rows(batches):
            for b in batches:
                tab = pa.Table.from_batches([b])
                for ids, known, vs in zip(_cells(tab, "ids"), _cells(tab, "known"), tab.column("vs")):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.asarray(vs.values[k].values), pa.float64(), mask=~known.astype(bool))], names=["row", "value"])

        return state.mapInArrow(rows, "row long, value double")
