"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item gives windows of 13 consecutive words (a shorter item is one
window).  A window is a set of word shingles; it lies in a document only if all
its shingles do, so one necessary prefix shingle suffices to find it: its rarest
by count over the whole corpus.  The corpus is read once for those counts and
once for the join: positions whose shingle is some window's prefix give the
window's only possible place (positional bound), which must lie inside the
document (length bound) and is then compared word by word.

The windows of a usual benchmark are the small side.  They go to the executors in
blocks of a fixed size, each another map over the same rows, so nothing is
broadcast beyond the bound and nothing is shuffled.  From more than ``MAP_BLOCKS``
blocks on, the same prefix join is a shuffle on shingle hashes, which reads the
corpus twice however many windows there are: positions that pass a bit table of
fixed size (``TABLE_BITS``) travel with the words around them, and the places found
come back to the documents by a digest of the text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import ALNUM, Words, alnum_words, annotate, map_batches, parts, raw_column, small_batches, utf8, window_hashes
from fieldloom.sources.scratch import Scratch

WINDOW, SHINGLE = 13, 4
#: Windows of one broadcast block.
BLOCK_WINDOWS = 150_000
#: Blocks looked up by maps; a benchmark of more windows is joined by a shuffle.
MAP_BLOCKS = 4
#: Bits of the table in front of the shuffle (32 MB), and of one slice of it.
TABLE_BITS, _SLICE_BITS = 28, 18
_FILTER_BITS = 20


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``(window, items)``; items without id or words give none."""

    def one(batch: pa.RecordBatch) -> dict:
        ids, out = [], []
        for i, raw in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            w = alnum_words(raw)
            for k in range(max(1, len(w) - size + 1) if w else 0):
                ids.append(i)
                out.append(b" ".join(w[k : k + size]))
        return {"item": ids, "window": out}

    rows = map_batches(benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), utf8().alias("text")), one, "item string, window binary")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingles_of(window: bytes) -> tuple[int, np.ndarray]:
    """Width and hashes of a window's shingles, in order of place."""
    w = Words(np.frombuffer(window, np.uint8), np.array([0, len(window)]), ALNUM)
    k = min(SHINGLE, len(w.hash))
    return k, window_hashes(w.hash, k)


class _Lookup:
    """Membership of 64-bit hashes: a bit table in front of a sorted array."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self.keys & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.table[h & np.uint64((1 << _FILTER_BITS) - 1)])
        i = np.searchsorted(self.keys, h[at])
        i[i == len(self.keys)] = 0
        ok = self.keys[i] == h[at]
        return at[ok], i[ok]


def _rarity(docs: DataFrame, looks: dict[int, _Lookup]) -> dict[int, dict[int, int]]:
    """Occurrences of the block's shingles over all documents, by width."""
    handle = docs.sparkSession.sparkContext.broadcast(looks)

    def run(batches):
        total = {k: np.zeros(len(x.keys), np.int64) for k, x in handle.value.items()}
        for b in (p for whole in batches for p in parts(whole)):
            w = Words(*raw_column(b, "text"), ALNUM)
            for k, x in handle.value.items():
                total[k] += np.bincount(x.places(window_hashes(w.hash, k))[1], minlength=len(x.keys))
        for k, t in total.items():
            i = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(i), k), pa.int32()), "i": pa.array(i, pa.int64()), "c": pa.array(t[i], pa.int64())})

    rows = docs.select(utf8().alias("text")).mapInArrow(run, "k int, i long, c long").groupBy("k", "i").agg(F.sum("c").alias("c")).collect()
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows:  # at most one row for each shingle of the block
        out[r.k][r.i] = r.c
    return out


class _Bits:
    """A bit table of the leading bits of 64-bit hashes, made slice by slice on Spark."""

    def __init__(self, hashes: DataFrame):
        def pack(rows: pa.Table) -> pa.Table:
            bits = np.zeros(1 << _SLICE_BITS, bool)
            slot = np.asarray(rows.column("slot"), np.int64)
            bits[slot & ((1 << _SLICE_BITS) - 1)] = True
            return pa.table({"part": pa.array([int(slot[0]) >> _SLICE_BITS], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        slots = hashes.select(F.shiftrightunsigned("h", 64 - TABLE_BITS).alias("slot")).distinct()
        self.bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        for r in slots.groupBy(F.shiftright("slot", _SLICE_BITS)).applyInArrow(pack, "part long, bits binary").toLocalIterator():
            self.bits[r.part << (_SLICE_BITS - 3) : (r.part + 1) << (_SLICE_BITS - 3)] = np.frombuffer(r.bits, np.uint8)

    def places(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - TABLE_BITS)
        return np.flatnonzero(self.bits[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7))).astype(np.uint8) & 1)


def _merge(spans) -> list[list[int]]:
    """Overlapping and touching ``(start, length)`` united, in order."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - out[-1][0])
        else:
            out.append([s, n])
    return out


def _mark_by_shuffle(docs: DataFrame, w: DataFrame, size: int, tmp: Scratch, added: str) -> DataFrame:
    """``mark`` for windows of any number: rarity counts and candidates meet the windows in joins on shingle hashes."""
    spark = docs.sparkSession

    def shingles(batch: pa.RecordBatch) -> dict:
        at, ks, hs, off, words = [], [], [], [], []
        for i, raw in enumerate(batch.column("window").to_pylist()):
            k, h = _shingles_of(raw)
            at += [i] * len(h)
            ks += [k] * len(h)
            hs.append(h.view(np.int64))
            off += range(len(h))
            words += [raw.count(b" ") + 1] * len(h)
        h = np.concatenate(hs) if hs else np.empty(0, np.int64)
        return {"k": ks, "h": h, "off": off, "n": words, **{c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("window", "items")}}

    held = tmp.write(map_batches(w, shingles, "k int, h long, off int, n int, window binary, items array<string>"), "shingles")
    widths = sorted(r.k for r in held.select("k").distinct().collect())  # SHINGLE numbers at most
    texts = docs.select(utf8().alias("text")).where("text is not null")
    first = spark.sparkContext.broadcast(_Bits(held))

    def count(batch: pa.RecordBatch) -> dict:
        words = Words(*raw_column(batch, "text"), ALNUM)
        hs = [(h := window_hashes(words.hash, k))[first.value.places(h)] for k in widths]
        u, c = np.unique(np.concatenate(hs), return_counts=True)
        return {"h": u.view(np.int64), "c": c}

    seen = map_batches(texts, count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rarest = F.min_by(F.struct("k", "h", "off", "n", "items"), F.struct(F.coalesce("c", F.lit(0)), F.col("off"))).alias("p")
    prefix = tmp.write(held.join(seen, "h", "left").groupBy("window").agg(rarest).select(F.col("window").cast("string").alias("window"), "p.*"), "prefix")
    second = spark.sparkContext.broadcast(_Bits(prefix))

    def candidates(batch: pa.RecordBatch) -> dict:
        words = Words(*raw_column(batch, "text"), ALNUM)
        lo = words.of_text
        row, hs, at, before, around = [], [], [], [], []
        for k in widths:
            h = window_hashes(words.hash, k)
            places = second.value.places(h)
            hs.append(h[places].view(np.int64))
            for p, t in zip(places.tolist(), (np.searchsorted(lo, places, "right") - 1).tolist()):
                a, b = max(int(lo[t]), p - size + 1), min(int(lo[t + 1]), p + size)
                row.append(t)
                at.append(p - int(lo[t]))
                before.append(p - a)
                around.append(words.word(a, b))
        return {"h": np.concatenate(hs), "key": batch.column("key").take(pa.array(row, pa.int64())), "at": at, "before": before, "around": around}

    key = F.sha2(utf8(), 256)
    found = map_batches(docs.select(key.alias("key"), utf8().alias("text")).where("text is not null"), candidates, "h long, key string, at long, before int, around binary")
    here = F.array_join(F.slice(F.split(F.col("around").cast("string"), " "), F.col("before") - F.col("off") + 1, F.col("n")), " ")
    hits = found.join(prefix, "h").where("before >= off").where(here == F.col("window")).withColumn("start", F.col("at") - F.col("off"))
    hits = tmp.write(hits.groupBy("key").agg(F.collect_set(F.array("start", F.col("n").cast("long"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "hits")
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row")).withColumn("key", F.sha2(F.col("row.text").cast("binary"), 256)).join(hits, "key", "left")

    def close(batch: pa.RecordBatch) -> dict:
        spans = [_merge(map(tuple, x or [])) for x in batch.column("spans").to_pylist()]
        return {"row": batch.column("row"), "n_words": np.diff(Words(*raw_column(batch, "text"), ALNUM).of_text), "spans": spans, "items": [sorted(x or []) for x in batch.column("items").to_pylist()]}

    from pyspark.sql.types import StructType

    schema = StructType([rows.schema["row"]] + spark.createDataFrame([], added).schema.fields)
    return map_batches(rows.select("row", F.col("row.text").alias("text"), "spans", "items"), close, schema)


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``row``, the columns of ``docs``, with ``spans`` (start word, length; merged), ``items`` and ``n_words``.

    Documents of null or wordless text have no words and no spans; repeated and
    null ids do not matter, since each row is judged by itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "windows")
    w = tmp.write(windows(benchmark, size), "windows")
    total = w.count()
    blocks = max(1, -(-total // BLOCK_WINDOWS))
    added = "n_words long, spans array<array<long>>, items array<string>"
    if total == 0:
        return annotate(docs, lambda b: {"n_words": np.diff(Words(*raw_column(b, "text"), ALNUM).of_text), "spans": [[]] * b.num_rows, "items": [[]] * b.num_rows}, added)
    if blocks > MAP_BLOCKS:
        return _mark_by_shuffle(docs, w, size, tmp, added)
    out = docs
    for block in range(blocks):
        rows = w.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()  # about BLOCK_WINDOWS rows
        shingles = [_shingles_of(bytes(r.window)) for r in rows]
        looks = {k: _Lookup(np.concatenate([h for kk, h in shingles if kk == k])) for k in {k for k, _ in shingles}}
        seen = _rarity(docs, looks)
        prefix: dict[int, dict[int, list]] = {k: defaultdict(list) for k in looks}
        for r, (k, h) in zip(rows, shingles):
            idx = np.searchsorted(looks[k].keys, h)
            best = min(range(len(h)), key=lambda j: (seen[k].get(int(idx[j]), 0), j))
            words = bytes(r.window).count(b" ") + 1
            prefix[k][int(h[best])].append((best, words, bytes(r.window), list(r["items"])))
        index = spark.sparkContext.broadcast({k: (_Lookup(np.fromiter(p, np.uint64, len(p))), dict(p)) for k, p in prefix.items()})

        def one(batch: pa.RecordBatch, index=index, first=block == 0) -> dict:
            words = Words(*raw_column(batch, "text"), ALNUM)
            lo = words.of_text
            spans = [[] for _ in range(batch.num_rows)] if first else [[tuple(s) for s in x] for x in batch.column("spans").to_pylist()]
            items = [set() for _ in range(batch.num_rows)] if first else [set(x) for x in batch.column("items").to_pylist()]
            for k, (look, entries) in index.value.items():
                for p in look.places(h := window_hashes(words.hash, k))[0].tolist():
                    t = int(np.searchsorted(lo, p, "right")) - 1
                    for off, n, text, ids in entries[int(h[p])]:
                        s = p - off
                        if s >= lo[t] and s + n <= lo[t + 1] and words.word(s, s + n) == text:
                            spans[t].append((int(s - lo[t]), n))
                            items[t].update(ids)
            return {"n_words": np.diff(lo), "spans": [_merge(x) for x in spans], "items": [sorted(x) for x in items]}

        out = annotate(out, one, added) if block == 0 else _extend(out, one, added)
    return out


def _extend(marked: DataFrame, fn, added: str) -> DataFrame:
    """A later block's finds joined to what earlier ones found."""
    from pyspark.sql.types import StructType

    schema = StructType([marked.schema["row"]] + marked.sparkSession.createDataFrame([], added).schema.fields)

    def one(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column("row"), **fn(batch.select(["text", "spans", "items"]))}

    return map_batches(marked.select("row", F.col("row.text").alias("text"), "spans", "items"), one, schema)


def _hits():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and the verdict.

    ``contaminated`` holds when at least one word is hit and hit words are at
    least a twentieth of all.  No benchmark or no words: nothing is hit.
    """
    marked = mark(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    return marked.select("row.doc_id", "n_words", _hits().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns whatever their names."""
    return mark(docs, benchmark).where(~((_hits() > 0) & (20 * _hits() >= F.col("n_words")))).select("row.*")
