"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its shingle count, a 128-bit
   fingerprint of the shingle set, a signature, band hashes and the packed text.
2. Documents of one fingerprint form a class; only its smallest id goes on.
3. Band buckets with two or more classes yield a star around their smallest id.
4. A star pair is judged on signature batches: after each batch the posterior
   of its similarity (uniform prior, matches are binomial) is compared with the
   threshold, and the pair is pruned once the probability of a similarity at or
   above the threshold is under ``miss``.  Survivors are verified on full sets.
5. Verified links are joined into components.  Buckets that still hold several
   components are compared again: members outside the bucket's largest component
   against all others, in blocks, so that no task holds a whole bucket and
   members already connected are never compared.  A block first sees signatures
   alone and names the members of pairs that survive the sequential test; only
   their texts are sent to it, and the survivors are verified on full sets
   inside the block, so only links leave it and nothing is capped.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import map_batches, shingle_set, small_batches, utf8
from fieldloom.operators.graph_components import connected_components
from fieldloom.sources.scratch import Scratch

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
#: A block's members and queries are at most about this many and their packed texts about this many bytes.
BLOCK, BLOCK_BYTES = 256, 16 << 20

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """One byte of the minimum of each of ``HASHES`` permutations over a non-empty set.

    Different minima share a byte once in 256; ``least_matches`` allows for it.
    """
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[None, at : at + 2048] * _MUL + _ADD).min(axis=1), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b + 1) for b in range(BANDS)], np.uint64).view(np.int64)


@lru_cache(8)
def least_matches(threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """``(n, m)``: after ``n`` hashes, fewer than ``m`` matches prune a pair.

    The posterior of the match probability after m matches of n is
    Beta(m+1, n-m+1); its tail above the threshold's match probability is the
    probability of at most m matches of n+1 draws there.
    """
    threshold += (1 - threshold) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return tuple(out)


def _scan(docs: DataFrame, words: int) -> DataFrame:
    pack = None

    def one(batch: pa.RecordBatch) -> dict:
        nonlocal pack
        pack = pack or zstandard.ZstdCompressor(level=1)
        n, fp, sig, bands, blob = [], [], [], [], []
        for raw in batch.column("text").to_pylist():
            s = shingle_set(raw, words)
            n.append(len(s))
            if len(s):
                g = signature(s)
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(g.tobytes())
                bands.append(band_hashes(g))
                blob.append(pack.compress(raw.lower()))
            else:
                for x in (fp, sig, bands, blob):
                    x.append(None)
        return {"doc_id": batch.column("doc_id"), "n": n, "fp": fp, "sig": sig, "bands": bands, "blob": blob}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), one, "doc_id long, n long, fp binary, sig binary, bands array<long>, blob binary")


def _alike(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """``(a, b)`` rows that the sequential test of signatures does not prune."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        limits = least_matches(percent / 100, miss)
        n, m = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        at = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        done, matches = 0, np.zeros(len(at), np.int64)
        for upto, least in limits:  # a batch of hashes at a time, of the pairs still in question
            matches = matches + (x[at, done:upto] == y[at, done:upto]).sum(1)
            stay = matches >= least
            at, matches, done = at[stay], matches[stay], upto
        return batch.select(["a", "b"]).take(pa.array(at))

    return map_batches(pairs.select("a", "b", "n_a", "sig_a", "n_b", "sig_b"), one, "a long, b long")


def _verify(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Keep ``(a, b)`` rows whose full sets reach the threshold."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, sets = zstandard.ZstdDecompressor(), {}
        c = {k: batch.column(k).to_pylist() for k in batch.schema.names}

        def full(i: int, blob: bytes) -> np.ndarray:
            if i not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[i] = shingle_set(unpack.decompress(blob), words)
            return sets[i]

        keep = []
        for k in range(batch.num_rows):
            x, y = full(c["a"][k], c["blob_a"][k]), full(c["b"][k], c["blob_b"][k])
            both = np.intersect1d(x, y, assume_unique=True).size
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.select("a", "b", "blob_a", "blob_b"), one, "a long, b long")


def _with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    side = lambda x: sets.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


class _Block:
    """Members and queries of one block, and its pairs that survive the sequential test."""

    def __init__(self, tab, percent: int, miss: float):
        self.limits, self.percent = least_matches(percent / 100, miss), percent
        self.role, self.band = np.asarray(tab.column("role")), int(np.asarray(tab.column("pos"))[0])
        self.ids, self.comp, self.n, self.other = (np.asarray(tab.column(k)) for k in ("doc_id", "comp", "n", "other"))
        self.sig = np.frombuffer(b"".join(tab.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)

    def pairs(self):
        """Rows of a query and of its candidates, the likeliest first.

        A pair is tried in the first band that both share, by its smaller query.
        """
        ids, comp, n, mi = self.ids, self.comp, self.n, np.flatnonzero(self.role == 1)
        for i in np.flatnonzero(self.role == 2):
            ok = (comp[mi] != comp[i]) & (100 * np.minimum(n[mi], n[i]) >= self.percent * np.maximum(n[mi], n[i])) & ~(self.other[mi] & (ids[mi] < ids[i]))
            cand = mi[ok]
            if not len(cand):
                continue
            eq = self.sig[cand] == self.sig[i]
            if self.band:
                fresh = ~eq[:, : self.band * ROWS].reshape(len(cand), self.band, ROWS).all(2).any(1)
                cand, eq = cand[fresh], eq[fresh]
            done, matches = 0, np.zeros(len(cand), np.int64)
            for m, least in self.limits:
                matches += eq[:, done:m].sum(1)
                stay = matches >= least
                cand, eq, matches, done = cand[stay], eq[stay], matches[stay], m
            if len(cand):
                yield i, cand[np.lexsort((ids[cand], -matches))]


def _block_needs(percent: int, miss: float):
    """The block's documents that are in a surviving pair."""

    def one(key, tab):
        block, need = _Block(tab, percent, miss), set()
        for i, cand in block.pairs():
            need.add(int(block.ids[i]))
            need.update(block.ids[cand].tolist())
        ids = sorted(need)
        return pa.table({**{c: pa.array([k.as_py()] * len(ids), pa.int64()) for c, k in zip(("band", "qb", "mb"), key)}, "doc_id": pa.array(ids, pa.int64())})

    return one


def _block_links(words: int, percent: int, miss: float):
    """Links of one block between components, while they leave its components apart."""

    def one(key, tab):
        block, unpack, sets, root = _Block(tab, percent, miss), zstandard.ZstdDecompressor(), {}, {}
        ids, comp, blobs = block.ids, block.comp, tab.column("blob")
        at = {int(ids[k]): int(k) for k in np.flatnonzero(np.asarray(blobs.is_valid()))}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(unpack.decompress(blobs[at[i]].as_py()), words)
            return sets[i]

        a_out, b_out = [], []
        for i, cand in block.pairs():
            for k in cand:
                x, y = find(int(comp[i])), find(int(comp[k]))
                if x == y:
                    continue
                s, t = full(int(ids[i])), full(int(ids[k]))
                both = np.intersect1d(s, t, assume_unique=True).size
                if 100 * both >= percent * (len(s) + len(t) - both):
                    root[max(x, y)] = min(x, y)
                    a_out.append(int(ids[i])), b_out.append(int(ids[k]))
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return one


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    Documents are linked when their sets of ``words``-word shingles have a
    Jaccard similarity of at least ``percent`` / 100.  Null and blank texts have
    an empty set, component of their own and are kept.  A null ``doc_id`` links
    with nothing and has a null component.  Rows that repeat an id are one
    document; if their texts differ, exact copies of any of them join it and near
    links go by the text of the smallest fingerprint.  Other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "minhash")
    base = tmp.write(_scan(docs, words), "base")
    classes = tmp.write(base.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("fp", "rep"), "classes")
    member = tmp.write(
        base.select("doc_id", "n", "fp", "bands")
        .join(classes, "fp", "left")
        .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.when(F.coalesce("rep", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands")),
        "member",
    )
    rows = member.where("bands is not null").select(F.col("rep").alias("doc_id"), F.posexplode("bands").alias("pos", "band"))
    shared = tmp.write(rows.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("band", "lead"), "shared")
    buckets = tmp.write(rows.join(shared, "band").distinct(), "buckets")
    involved = tmp.write(buckets.select("doc_id").distinct(), "involved")
    sets = base.select("doc_id", "n", "sig", "blob", "fp").join(involved, "doc_id").groupBy("doc_id").agg(F.min(F.struct("fp", "n", "sig", "blob")).alias("s"))
    sets = tmp.write(sets.select("doc_id", "s.n", "s.sig", "s.blob", F.length("s.blob").alias("size")), "sets")
    tmp.drop(base)

    pairs = tmp.write(buckets.where("lead < doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    alike = tmp.write(_alike(_with(pairs, sets, "n", "sig"), percent, miss), "alike")  # signatures travel first, texts of surviving pairs only
    links = tmp.write(_verify(_with(alike, sets, "blob"), words, percent), "links")
    nodes = involved.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    comp = connected_components(spark, links.unionByName(nodes), Scratch(spark, "components"))
    state = buckets.select("doc_id", "pos", "band").join(comp.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "comp"), "doc_id")
    state = tmp.write(state.join(sets.select("doc_id", "size"), "doc_id"), "state")
    sizes = state.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("size"))
    mixed = sizes.groupBy("band").agg(F.max_by(F.struct("comp", "c", "size"), F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.sum("size").alias("bytes"), F.count("*").alias("comps")).where("comps > 1")
    need = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, size / BLOCK_BYTES))
    mixed = tmp.write(mixed.select("band", F.col("top.comp").alias("main"), need(F.col("all"), F.col("bytes")).alias("nm"), need(F.col("all") - F.col("top.c"), F.col("bytes") - F.col("top.size")).alias("nq")), "mixed")
    if not mixed.isEmpty():
        open_ = tmp.write(state.join(mixed, "band"), "open").withColumn("other", F.col("comp") != F.col("main"))
        at = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k))
        spots = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        spot = lambda q, m, role, full: F.struct(q.alias("qb"), m.alias("mb"), F.lit(role).alias("role"), full.alias("full"))
        as_member = F.transform(spots("nq"), lambda q: spot(q, at("nm"), 1, F.lit(True)))
        as_query = F.when(F.col("other"), F.transform(spots("nm"), lambda m: spot(at("nq"), m, 2, m != at("nm")))).otherwise(F.array().cast("array<struct<qb:bigint,mb:bigint,role:int,full:boolean>>"))
        met = open_.join(sets.select("doc_id", "n", "sig"), "doc_id").withColumn("s", F.explode(F.concat(as_member, as_query)))
        met = tmp.write(met.select("band", "pos", "doc_id", "comp", "other", "n", "sig", "s.qb", "s.mb", "s.role", "s.full"), "met")
        block = ["band", "qb", "mb"]
        need = tmp.write(met.groupBy(*block).applyInArrow(_block_needs(percent, miss), "band long, qb long, mb long, doc_id long"), "need")
        met = met.join(need, [*block, "doc_id"], "left_semi").join(sets.select("doc_id", "blob"), "doc_id")
        # A query that is also a member of its own block carries its text once.
        met = met.select(*block, "pos", "doc_id", "comp", "other", "n", "sig", "role", F.when(F.col("full"), F.col("blob")).alias("blob"))
        found = tmp.write(met.groupBy(*block).applyInArrow(_block_links(words, percent, miss), "a long, b long"), "found")
        comp = connected_components(spark, links.unionByName(found).unionByName(nodes), Scratch(spark, "components"))
    out = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    root = F.coalesce("component", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id.

    Rows that repeat an id stay or go together; rows without id stay.
    """
    gone = near_duplicates(docs, words, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
