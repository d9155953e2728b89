"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors form a class whose smallest id goes on.  Only vectors of one length
link, so each length has shards of its own.  Centroids of a bounded sample cut
the space into shards; a vector is a member of its two nearest
shards, so shards overlap.  Each shard (in blocks of at most ``BLOCK``
members) builds a robust-pruned neighbour graph; the adjacency lists that a
vector got in its shards are united.  Every vector is then searched in its
``probes`` nearest shards: greedily from the block's medoid, and from all nodes
found near the threshold the range is expanded along the edges until it grows no
more.  Links found are verified by cosine in double precision.  A link seen in
two shards counts in the smaller one, so only counts and local roots leave a
task, never pairs.  A brute-force audit measures recall at every width: vectors
are drawn in blocks and compared with all rows until ``LINKS`` true links of
``LINKED`` vectors are seen or all are drawn.  While recall is under the target,
more shards are probed; beyond ``MAX_PROBES`` all pairs are compared.  The audit
has no other end, so recall is always a measured number: of a sample where links
are many, of all vectors where they are rare.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.text import bounded_sample
from fieldloom.operators.graph_components import connected_components
from fieldloom.sources.scratch import Scratch

PER_SHARD, BLOCK, MAX_SHARDS, SAMPLE = 400, 2_000, 65_536, 20_000
DEGREE, POOL, BEAM, ALPHA = 24, 48, 24, 1.2
SLACK = 0.06
PROBES, MAX_PROBES, TARGET = 3, 48, 0.99
#: The audit's first and largest block (vectors; components at most), and the true links and linked vectors it must see.
AUDIT, AUDIT_MAX, AUDIT_CELLS, LINKS, LINKED = 512, 8_192, 1 << 20, 1_000, 200
#: Rounds of k-means, shards that the driver trains alone, and vectors a shard beyond that.
ROUNDS, DRIVER_SHARDS, PER_CENTROID = 3, 1_024, 32


def unit(x: np.ndarray) -> np.ndarray:
    if x.size:  # an exact power of two keeps squares of huge and tiny components finite
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(flat)
    return np.asarray(flat.flatten(), np.float64).reshape(n, -1)


def _by_length(col: pa.Array):
    """Each length of ``col`` with its rows and their unit vectors."""
    size = np.asarray(pc.list_value_length(col))
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, unit(_matrix(col if len(at) == len(col) else col.take(pa.array(at))))


def _means(c: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Unit vectors along ``sums``; a centroid without members stays."""
    n = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)


def _slices(n: int, k: int) -> list[slice]:
    """Row ranges whose similarities to ``k`` centroids take bounded memory."""
    step = max(1, 4_000_000 // max(k, 1))
    return [slice(at, at + step) for at in range(0, n, step)]


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit centroids of unit vectors: a few rounds of spherical k-means."""
    c = sample[:k]
    for _ in range(ROUNDS):
        s = np.zeros_like(c)
        for part in _slices(len(sample), k):
            np.add.at(s, (sample[part] @ c.T).argmax(1), sample[part])
        c = _means(c, s)
    return c


def trained(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """The same rounds over the vectors ``e`` of ``rows``, for more centroids than the driver should train."""
    k, d = c.shape
    schema, sc = "shard int, s array<double>", rows.sparkSession.sparkContext
    for _ in range(ROUNDS):
        held = sc.broadcast(c)

        def sums(batches, held=held):
            c, s, seen = held.value, np.zeros((k, d)), np.zeros(k, bool)
            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(_matrix(b.column("e")))
                for part in _slices(len(x), k):
                    near = (x[part] @ c.T).argmax(1)
                    np.add.at(s, near, x[part])
                    seen[near] = True
            at = np.flatnonzero(seen)
            for part in np.array_split(at, max(1, len(at) // 4_000)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(list(s[part]), pa.list_(pa.float64()))], names=["shard", "s"])

        def add(tab):
            shard, at = np.unique(np.asarray(tab.column("shard")), return_inverse=True)
            s = np.zeros((len(shard), d))
            np.add.at(s, at, _matrix(tab.column("s")))
            return pa.table({"shard": pa.array(shard, pa.int32()), "s": pa.array(list(s), pa.list_(pa.float64()))})

        got = rows.select("e").mapInArrow(sums, schema).groupBy(F.pmod("shard", F.lit(256))).applyInArrow(add, schema).toPandas()  # one row a centroid
        s = np.zeros_like(c)
        if len(got):
            s[got.shard.to_numpy()] = np.array(got.s.tolist())
        c = _means(c, s)
        held.unpersist()
    return c


def prune(x: np.ndarray) -> list[np.ndarray]:
    """Out-edges of a block: nearest first, dropping those closer to a chosen one."""
    n = len(x)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    c = min(POOL, n - 1)
    if c <= 0:
        return [np.empty(0, np.int64)] * n
    cand = np.argpartition(-sim, c - 1, axis=1)[:, :c]
    own = np.take_along_axis(sim, cand, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
    alive, chosen = np.ones((n, c), bool), np.zeros((n, c), bool)
    rows = np.arange(n)
    for _ in range(min(DEGREE, c)):
        k = alive.argmax(1)
        some = alive[rows, k]
        if not some.any():
            break
        r = rows[some]
        chosen[r, k[some]], alive[r, k[some]] = True, False
        to = sim[cand[r, k[some]][:, None], cand[r]]
        # Squared distances of unit vectors are 2 - 2 sim; alpha is on distances.
        alive[r] &= ALPHA**2 * (1 - to) > (1 - own[r])
    i, j = np.nonzero(chosen)
    j = cand[i, j]
    key = np.unique(np.concatenate([i * n + j, j * n + i]))  # edges both ways keep the graph reachable
    i, j = key // n, key % n
    cut = np.searchsorted(i, np.arange(n + 1))
    return [j[cut[v] : cut[v + 1]] for v in range(n)]


def _edges(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists as one array and the place where each list begins."""
    flat = np.concatenate([np.asarray(v, np.int64) for v in lists] + [np.empty(0, np.int64)])
    return flat, np.cumsum([0] + [len(v) for v in lists])


def _spread(rows: np.ndarray, nodes: np.ndarray, edges) -> tuple[np.ndarray, np.ndarray]:
    """Each row with every neighbour of its node."""
    flat, cut = edges
    deg = cut[nodes + 1] - cut[nodes]
    at = np.arange(deg.sum()) - np.repeat(np.cumsum(deg) - deg, deg) + np.repeat(cut[nodes], deg)
    return np.repeat(rows, deg), flat[at]


def range_search(q: np.ndarray, x: np.ndarray, lists: list, threshold: float) -> np.ndarray:
    """Matrix of index nodes within the threshold that the graph search reaches from each query.

    ``lists`` holds the neighbours of each index node.
    """
    edges = _edges(lists)
    nq, n = len(q), len(x)
    seen, near = np.zeros((nq, n), bool), np.zeros((nq, n), bool)
    lowest = threshold - SLACK
    xf, qf = x.astype(np.float32), q.astype(np.float32)
    medoid = int((x @ x.mean(0)).argmax())
    ids = np.full((nq, BEAM), -1, np.int64)
    sims = np.full((nq, BEAM), -2.0, np.float32)
    todo = np.zeros((nq, BEAM), bool)
    ids[:, 0], sims[:, 0], todo[:, 0] = medoid, qf @ xf[medoid], True
    seen[:, medoid] = True
    active = np.arange(nq)
    while len(active):
        for part in np.array_split(active, max(1, len(active) // 512)):
            k = np.where(todo[part], sims[part], -3).argmax(1)
            todo[part, k] = False
            r, m = _spread(np.arange(len(part)), ids[part, k], edges)
            ok = ~seen[part[r], m]
            r, m = r[ok], m[ok]
            seen[part[r], m] = True
            v = np.einsum("ij,ij->i", qf[part[r]], xf[m])
            hit = v >= lowest
            near[part[r[hit]], m[hit]] = True
            order = np.lexsort((-v, r))
            r, m, v = r[order], m[order], v[order]
            col = np.arange(len(r)) - np.searchsorted(r, r)
            r, m, v, col = (z[col < BEAM] for z in (r, m, v, col))
            new_s, new_i = np.full((len(part), BEAM), -2.0, np.float32), np.full((len(part), BEAM), -1, np.int64)
            new_s[r, col], new_i[r, col] = v, m
            both_s, both_i = np.concatenate([sims[part], new_s], 1), np.concatenate([ids[part], new_i], 1)
            both_t = np.concatenate([todo[part], new_i >= 0], 1)
            best = np.argpartition(-both_s, BEAM - 1, axis=1)[:, :BEAM]
            sims[part], ids[part], todo[part] = (np.take_along_axis(z, best, 1) for z in (both_s, both_i, both_t))
        active = active[todo[active].any(1)]
    near[np.flatnonzero((qf @ xf[medoid]) >= lowest), medoid] = True
    fq, fn = np.nonzero(near)
    while len(fq):  # expand the range along the edges
        new_q, new_n = [], []
        for at in range(0, len(fq), 20_000):
            a, b = fq[at : at + 20_000], fn[at : at + 20_000]
            r, m = _spread(a, b, edges)
            ok = ~seen[r, m]
            r, m = r[ok], m[ok]
            key = np.unique(r * n + m)
            r, m = key // n, key % n
            seen[r, m] = True
            hit = np.einsum("ij,ij->i", qf[r], xf[m]) >= lowest
            near[r[hit], m[hit]] = True
            new_q.append(r[hit]), new_n.append(m[hit])
        fq, fn = np.concatenate(new_q), np.concatenate(new_n)
    i, j = np.nonzero(near)
    for at in range(0, len(i), 100_000):  # verify in double precision
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        near[a, b] = np.einsum("ij,ij->i", q[a], x[b]) >= threshold
    return near


def _build(key, tab):
    ids = np.asarray(tab.column("rep"))
    nbrs = prune(unit(_matrix(tab.column("e"))))
    return pa.table({"rep": pa.array(ids, pa.int64()), "nbrs": pa.array([ids[x] for x in nbrs], pa.list_(pa.int64()))})


def all_pairs(q: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """The matrix of ``range_search`` by comparison of all pairs."""
    return np.vstack([q[at : at + 1_000] @ x.T >= threshold for at in range(0, len(q), 1_000)])


def _searcher(threshold: float, exact: bool = False):
    def one(key, tab):
        shard = key[0].as_py()
        query = np.asarray(tab.column("query"))
        qi, xi = np.flatnonzero(query == 1), np.flatnonzero(query == 0)
        if not len(qi) or not len(xi):
            return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "part", "links", "root")})
        e, ids, copies = unit(_matrix(tab.column("e"))), np.asarray(tab.column("rep")), np.asarray(tab.column("copies"))
        if exact:
            near = all_pairs(e[qi], e[xi], threshold)
        else:
            place = {int(v): k for k, v in enumerate(ids[xi])}
            lists = [[place[v] for v in (x or ()) if v in place] for x in tab.column("nbrs").take(pa.array(xi)).to_pylist()]
            near = range_search(e[qi], e[xi], lists, threshold)
        near &= ids[qi][:, None] != ids[xi][None, :]
        units, probes = (np.array(tab.column(c).to_pylist(), np.int64) for c in ("units", "probes"))
        twice = np.zeros(near.shape, bool)
        for u in units[xi].T:  # the pair's link counts in the smallest shard where it can be seen
            here = (u < shard) & (u >= 0)
            for p in probes[qi].T:
                twice |= here[None, :] & (p[:, None] == u[None, :])
        part, links = (near & ~twice) @ copies[xi], (near & ~twice).sum(1)
        lab_q, lab_x = ids[qi].copy(), ids[xi].copy()
        i, j = np.nonzero(near)
        while True:
            before = (lab_q.copy(), lab_x.copy())
            np.minimum.at(lab_x, j, lab_q[i])
            np.minimum.at(lab_q, i, lab_x[j])
            if (before[0] == lab_q).all() and (before[1] == lab_x).all():
                break
        moved = lab_x != ids[xi]
        none = np.zeros(moved.sum(), np.int64)
        cols = {"rep": [ids[qi], ids[xi][moved]], "part": [part, none], "links": [links, none], "root": [lab_q, lab_x[moved]]}
        return pa.table({c: pa.array(np.concatenate(v), pa.int64()) for c, v in cols.items()})

    return one


def true_links(asked: dict[int, tuple[np.ndarray, np.ndarray]], batches, threshold: float) -> dict[int, np.ndarray]:
    """Number of rows ``rep, e`` of ``batches`` that link with each of the ``asked`` vectors, by length.

    A length has its unit vectors and their ids in order.
    """
    totals = {d: np.zeros(len(qid), np.int64) for d, (_, qid) in asked.items()}
    single = {d: q.astype(np.float32) for d, (q, _) in asked.items()}
    for b in batches:
        ids = np.asarray(b.column("rep"))
        for d, rows, x in _by_length(b.column("e")):
            if d not in asked:
                continue
            q, qid = asked[d]
            for at in range(0, len(x), 1_000):
                part, own = x[at : at + 1_000], ids[rows[at : at + 1_000]]
                sim = single[d] @ part.astype(np.float32).T
                place = np.minimum(np.searchsorted(qid, own), len(qid) - 1)
                same = np.flatnonzero(qid[place] == own)
                sim[place[same], same] = -2
                totals[d] += (sim >= threshold + 1e-4).sum(1)
                i, j = np.nonzero(np.abs(sim - threshold) < 1e-4)  # too near to tell in single precision
                for k in range(0, len(i), 100_000):
                    a, c = i[k : k + 100_000], j[k : k + 100_000]
                    totals[d] += np.bincount(a[np.einsum("ij,ij->i", q[a], part[c]) >= threshold], minlength=len(qid))
    return totals


def _truth(classes: DataFrame, total: int, threshold: float) -> tuple[pd.DataFrame, int]:
    """``rep, true``: the number of linked classes of each drawn class that has any; and the number of classes drawn.

    Blocks of classes in hash order are compared with all rows until ``LINKS``
    links of ``LINKED`` classes are seen or every class is drawn.  The driver
    holds one block and the linked classes.
    """
    sc, full = classes.sparkSession.sparkContext, 1 << 40
    draw = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(full))
    found, lo, size, drawn, enough = [], 0, AUDIT, 0, False
    while total and lo < full and not enough:
        hi = min(full, lo + max(1, full * size // total))
        asked = classes.where((draw >= lo) & (draw < hi)).select("rep", "e").toPandas().sort_values("rep")  # about AUDIT_MAX rows at most
        lo, drawn = hi, drawn + len(asked)
        if asked.empty:
            continue
        wide = asked.e.map(len)
        size = min(4 * size, AUDIT_MAX, max(64, AUDIT_CELLS // int(wide.max())))
        held = sc.broadcast({int(d): (unit(np.array(g.e.tolist(), np.float64)), g.rep.to_numpy()) for d, g in asked.groupby(wide)})

        def count(batches, held=held):
            for d, n in true_links(held.value, batches, threshold).items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"rep": pa.array(held.value[d][1][at], pa.int64()), "true": pa.array(n[at], pa.int64())})

        found.append(classes.select("rep", "e").mapInArrow(count, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true")).toPandas())
        held.unpersist()
        enough = sum(f.true.sum() for f in found) >= LINKS and sum(map(len, found)) >= LINKED
    return pd.concat(found) if found else pd.DataFrame({"rep": [], "true": []}, dtype="int64"), drawn


def _recall(truth: pd.DataFrame, counts: DataFrame) -> float:
    """Share of the audited links that were found, over all of them or as the mean of the vectors if that is less.

    Only where all vectors were drawn may no link be seen; then none is missed.
    """
    if truth.empty:
        return 1.0
    asked = counts.sparkSession.createDataFrame(truth[["rep"]], "rep long")
    got = counts.join(F.broadcast(asked), "rep").select("rep", "links").toPandas().set_index("rep").links
    found = np.minimum(got.reindex(truth.rep).fillna(0).to_numpy(), truth.true.to_numpy())
    return float(min(found.sum() / truth.true.sum(), (found / truth.true.to_numpy()).mean()))


_log = logging.getLogger(__name__)
MET = "rep long, part long, links long, root long"


def vector_links(vectors: DataFrame, threshold: float = 0.9, audit: list | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    The measured recall of each search, with the vectors drawn and the true links
    seen, is logged and appended to ``audit``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are kept.  Vectors of different lengths do not link.
    Components other than float are read as double.  Rows that repeat an id are
    that vector (the smallest, if they differ) and count once.  A null id links
    with nothing and has a null component.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "vectors")
    given = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    rows = tmp.write(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e")), "rows")
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("e", lambda v: v != 0)
    sound = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    sound = tmp.write(sound.groupBy("vec_id").agg(F.min("e").alias("e")), "sound")
    classes = tmp.write(sound.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "e", "copies"), "classes")
    member = tmp.write(sound.join(classes.select("e", "rep", "copies"), "e").select("vec_id", "rep", "copies"), "member")
    lengths = sorted((r.d, r["count"]) for r in classes.groupBy(F.size("e").alias("d")).count().collect())  # one row a length
    total = sum(n for _, n in lengths)

    def shards(d: int, n: int) -> np.ndarray | None:
        """Centroids of the ``n`` vectors of length ``d``; none if one shard holds them."""
        k = min(-(-MAX_SHARDS * n // total), -(-n // PER_SHARD))
        if k <= 1:
            return None
        own = classes.where(F.size("e") == d).select("rep", "e")
        sample = bounded_sample(own, max(SAMPLE, 2 * k), "rep").select(F.xxhash64("rep").alias("o"), "e").toPandas().sort_values("o")  # bounded by SAMPLE and MAX_SHARDS
        c = unit(np.array(sample.e.tolist(), np.float64))
        k = min(k, len(c))
        if k <= DRIVER_SHARDS:
            return centroids(c, k)
        share = F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(n)) < PER_CENTROID * k
        return trained(tmp.write(own.where(share).select("e"), "train"), c[:k])

    centres, k = {}, 0
    for d, n in lengths:
        c = shards(d, n)
        centres[d] = (k, c)
        k += 1 if c is None else len(c)
    centre = spark.sparkContext.broadcast(centres)

    def place(probes: int) -> DataFrame:
        def assign(batches):
            for b in batches:
                best: list = [None] * b.num_rows
                for d, at, x in _by_length(b.column("e")):
                    first, c = centre.value[d]
                    if c is None:
                        for i in at:
                            best[i] = [first]
                        continue
                    top = min(probes, len(c))
                    for part in _slices(len(x), len(c)):
                        s = x[part] @ c.T
                        near = np.argpartition(-s, top - 1, axis=1)[:, :top]
                        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
                        for i, v in zip(at[part], (near + first).astype(np.int32)):
                            best[i] = v
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("e"), b.column("copies"), pa.array(best, pa.list_(pa.int32()))], names=["rep", "e", "copies", "best"])

        placed = tmp.write(classes.mapInArrow(assign, f"rep long, e array<{kind}>, copies long, best array<int>"), "placed")
        return placed.withColumn("units", F.array(F.get("best", F.lit(0)), F.coalesce(F.get("best", F.lit(1)), F.lit(-1))))

    placed = place(PROBES)
    members = placed.select("rep", "e", "copies", "units", F.explode(F.filter("units", lambda u: u >= 0)).alias("shard"))
    sizes = tmp.write(members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    members = tmp.write(members.join(F.broadcast(sizes), "shard").withColumn("ib", F.pmod(F.xxhash64("rep"), "blocks")), "members")  # MAX_SHARDS rows at most
    graph = tmp.write(members.groupBy("shard", "ib").applyInArrow(_build, "rep long, nbrs array<long>").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "graph")
    index = tmp.write(members.join(graph, "rep"), "index")

    def search(probes: int) -> DataFrame:
        asked = placed.select("rep", "e", "copies", "units", F.slice("best", 1, probes).alias("probes")).withColumn("probes", F.concat("probes", F.array_repeat(F.lit(-2), probes - F.size("probes"))))
        asked = asked.withColumn("shard", F.explode(F.filter("probes", lambda p: p >= 0))).join(F.broadcast(sizes), "shard")
        load = tmp.write(asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("qblocks")), "load")
        asked = asked.join(F.broadcast(load), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("ib"), F.pmod(F.xxhash64("rep"), "qblocks").alias("qb"), F.lit(1).alias("query"), "rep", "e", "copies", "units", "probes", F.lit(None).cast("array<long>").alias("nbrs"))
        held = index.join(F.broadcast(load), "shard").select("shard", "ib", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qblocks") - 1)).alias("qb"), F.lit(0).alias("query"), "rep", "e", "copies", "units", F.array_repeat(F.lit(-2), probes).alias("probes"), "nbrs")
        return asked.unionByName(held).groupBy("shard", "ib", "qb").applyInArrow(_searcher(threshold), MET)

    def compare_all() -> DataFrame:
        cut, first = [], 0
        for d, n in lengths:
            cut.append((d, first, -(-n // BLOCK)))
            first += cut[-1][2]
        table = spark.createDataFrame(cut, "d int, first int, n int")
        laid = classes.join(F.broadcast(table), F.size("e") == F.col("d"))
        own = F.pmod(F.xxhash64("rep"), "n").cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("each")
        rest = ["rep", "e", "copies", F.array(F.col("first") + F.col("own"), F.lit(-1)).alias("units"), F.array(F.lit(-2)).alias("probes"), F.lit(None).cast("array<long>").alias("nbrs")]
        laid = laid.withColumn("own", own).select("*", each)
        asked = laid.select((F.col("first") + F.col("each")).alias("shard"), F.col("own").alias("qb"), F.lit(1).alias("query"), *rest)
        held = laid.select((F.col("first") + F.col("own")).alias("shard"), F.col("each").alias("qb"), F.lit(0).alias("query"), *rest)
        return asked.unionByName(held).groupBy("shard", "qb").applyInArrow(_searcher(threshold, exact=True), MET)

    truth, drawn = _truth(classes, total, threshold)
    probes, met = PROBES, None
    while True:
        exact = probes > MAX_PROBES
        tmp.drop(met)
        met = tmp.write(compare_all() if exact else search(probes), "met")
        counts = tmp.write(met.groupBy("rep").agg(F.sum("part").alias("part"), F.sum("links").alias("links")), "counts")
        recall = _recall(truth, counts)
        measured = {"vectors": drawn, "linked": len(truth), "links": int(truth.true.sum()), "recall": recall, "probes": None if exact else probes}
        _log.info("recall of vector links: %s", measured)
        if audit is not None:
            audit.append(measured)
        if recall >= TARGET:
            break
        if exact:
            raise RuntimeError(f"recall of vector links is {recall:.4f}, under {TARGET}")
        probes = 2 * probes if probes < k and 2 * probes <= MAX_PROBES else MAX_PROBES + 1
        if probes <= MAX_PROBES:
            placed = place(probes)
    comp = connected_components(spark, met.where("root < rep").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(), Scratch(spark, "components"))
    facts = tmp.write(counts.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "part", F.coalesce("component", "rep").alias("component")), "facts")
    known = member.join(facts, "rep").select("vec_id", (F.col("part") + F.col("copies") - 1).alias("n"), F.col("component").alias("c"))
    known = tmp.write(known, "known")
    out = rows.select("vec_id").join(known, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
