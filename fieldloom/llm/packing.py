"""Packing token pieces into sequences by a configuration linear program.

Spark tokenises every document and counts pieces by length; the histogram (at
most ``capacity`` numbers) is all the driver sees.  There the covering program
over configurations (multisets of lengths that fit a sequence) is solved by
multiplicative weights: a length's price falls exponentially with the share of
its demand already covered, a knapsack dynamic program finds the most valuable
configurations at these prices, and their multiplicities grow.  The fractional
solution is rounded down within the demand, and what is left is filled largest
first by best fit on the histogram.  Spark then numbers the pieces of each
length and looks up the configuration, instance and offset of each number.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.text import map_batches, small_batches
from fieldloom.sources.scratch import Scratch

CAPACITY, END_ID = 2048, 0
ROUNDS, STEP, DECAY = 40, 1 / 12, 6.0
_CACHE_ENTRIES = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: How the byte-level pre-tokeniser cuts a text (fixed value).
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _same_ids(spec: str):
    """A faster encoder of the same file, where its merges are in the order of its ids; else None.

    The vocabulary spells bytes by a fixed alphabet: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on.
    """
    import tiktoken

    d = json.loads(spec)
    vocab, pre = d["model"].get("vocab", {}), d.get("pre_tokenizer") or {}
    if d["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or d.get("normalizer"):
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spell = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in d["model"]["merges"]]
    if any(vocab.get(t) != 256 + i for i, t in enumerate(merged)):
        return None
    ranks = {bytes(spell[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("same", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, with a bounded cache of the chunks between spaces.

    The byte-level pre-tokeniser never joins a character to a following single
    space, so a text without double spaces may be cut before each space and the
    ids of the chunks joined.  Unknown chunks of a batch are encoded as one text
    and cut where a token starts with a space.  Texts with double spaces are
    encoded whole, by the tokenizer itself.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.cache: dict[str, bytes] = {}
        self.fast = _same_ids(spec)
        self.spaced = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")  # the byte alphabet's space

    def _many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks; a key is the chunk without its leading space."""
        lone = [c for c in new if not c]
        rest = [c for c in new if c]
        for at in range(0, len(rest), 2048):
            part = rest[at : at + 2048]
            text = " " + " ".join(part)
            raw = np.array(self.fast.encode_ordinary(text), "<u4").tobytes() if self.fast and "<|" not in text else self._many([text])[0]
            cut = np.append(np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")]) * 4, len(raw)).tolist()
            if len(cut) == len(part) + 1 and cut[0] == 0:
                self.cache.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])]))
            else:
                lone += part
        if lone:
            self.cache.update(zip(lone, self._many([" " + c for c in lone])))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > _CACHE_ENTRIES:
            self.cache.clear()
        get, out, heads, todo = self.cache.get, [], {}, {}
        for k, t in enumerate(texts):
            if not t:
                out.append(b"")
            elif "  " in t:
                out.append(self._many([t])[0])
            else:
                first, *rest = t.split(" ")
                if first:
                    heads[k] = first
                parts = list(map(get, rest))
                if None in parts:
                    todo[k] = rest
                    out.append(parts)
                else:
                    out.append(b"".join(parts))
        if todo:
            self._learn(list({c for k, rest in todo.items() for c, p in zip(rest, out[k]) if p is None}))
            for k, rest in todo.items():
                out[k] = b"".join(map(self.cache.__getitem__, rest))
        for k, head in zip(heads, self._many(list(heads.values())) if heads else ()):
            out[k] = head + out[k]
        return out


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of each piece of a document's ids with their end."""
    raw = ids + np.uint32(END_ID).astype("<u4").tobytes()
    n = len(raw) // 4
    first = n if n <= capacity else n % capacity or capacity
    out, at = [], 0
    while at < n:
        size = first if at == 0 else capacity
        out.append((at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
        at += size
    return out


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their task and place among its equals in length."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer or default_tokenizer()).read_text("utf-8"))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, seen, chunk = Encoder(spec.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            out = [[] for _ in range(6)]
            ids = b.column("doc_id").to_pylist()
            for doc, enc in zip(ids, encode(b.column("text").to_pylist())):
                for k, (start, size, crc) in enumerate(pieces_of(enc, capacity)):
                    for col, v in zip(out, (doc, k, start, size, crc, int(seen[size]))):
                        col.append(v)
                    seen[size] += 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "place")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(out, types)] + [pa.array(np.full(len(out[0]), chunk), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "chunk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, place long, chunk long")


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity and the length taken last there (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        v = best[w - 1 :: -1][:w] + price[1 : w + 1]  # take length l, leave w - l
        k = int(v.argmax())
        if v[k] > best[w - 1]:
            best[w], last[w] = v[k], k + 1
        else:
            best[w] = best[w - 1]
    return best, last


def _fill(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= out[-1]
        else:
            room -= 1
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, times)``: configurations that hold exactly ``counts[l]`` pieces of each length l."""
    left = counts.astype(np.int64).copy()
    demand = np.maximum(left, 1).astype(float)
    covered = np.zeros(capacity + 1)
    plan: dict[tuple[int, ...], float] = {}
    for _ in range(rounds if left.sum() > 1 else 0):
        share = covered / demand
        price = np.where(left > 0, np.arange(capacity + 1) * np.exp(-DECAY * (share - share[left > 0].min())) + 1e-12, 0.0)
        best, last = _knapsack(price, capacity)
        lengths = np.flatnonzero(left)
        value = price[lengths] + best[capacity - lengths]
        order = np.argsort(-value, kind="stable")
        for a in lengths[order[: max(1, len(order) // 2)]].tolist():
            if covered[a] > share[left > 0].mean() * demand[a] + 2 * STEP * demand[a]:
                continue
            shape = tuple(sorted([a, *_fill(last, capacity - a)], reverse=True))
            kinds, times = np.unique(shape, return_counts=True)
            if (times > left[kinds]).any():
                continue
            x = STEP * float((demand[kinds] / times).min())
            plan[shape] = plan.get(shape, 0.0) + x
            covered[kinds] += x * times
    scale = 1 / max(1.0, float(np.median(covered[left > 0] / demand[left > 0]))) if plan else 1.0
    out: list[tuple[tuple[int, ...], int]] = []

    def use(shape: tuple[int, ...], most: int) -> None:
        kinds, times = np.unique(shape, return_counts=True)
        n = min(most, int((left[kinds] // times).min()))
        if n > 0:
            left[kinds] -= n * times
            out.append((shape, n))

    for shape, x in sorted(plan.items(), key=lambda p: (-sum(p[0]), -len(p[0]), p[0])):
        use(shape, int(x * scale))
    while left.any():  # each pass uses up at least one length
        room, shape = capacity, []
        free = left.copy()
        while room > 0 and len(fit := np.flatnonzero(free[: room + 1])):
            shape.append(int(fit[-1]))
            free[fit[-1]] -= 1
            room -= int(fit[-1])
        use(tuple(shape), int(left.max()))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece of ``docs(doc_id, text)``.

    A document is its ids and one end id; longer ones are cut into pieces of
    ``capacity``, the first of which may be shorter.  Null and empty texts are
    their end id alone.  Repeated rows and ids are packed as often as they
    occur; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "packing")
    pieces = tmp.write(tokenise(docs, tokenizer, capacity), "pieces")
    part = tmp.write(pieces.groupBy("chunk", "length").agg(F.count("*").alias("c")), "part")
    counts = np.zeros(capacity + 1, np.int64)
    for r in part.groupBy("length").agg(F.sum("c").alias("c")).collect():  # at most `capacity` rows
        counts[r.length] = r.c
    full, counts[capacity] = int(counts[capacity]), 0
    keys, bases, offsets, seqs, taken = [], [], [], full, np.zeros(capacity + 1, np.int64)
    for shape, times in solve(counts, capacity):
        at = 0
        for size in shape:
            keys.append((size << 44) + int(taken[size]))
            bases.append(seqs - int(taken[size]))
            offsets.append(at)
            taken[size] += times
            at += size
        seqs += times
    if full:
        keys.append(capacity << 44), bases.append(0), offsets.append(0)
    order = np.argsort(np.array(keys, np.int64))
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, bases, offsets)))

    def place(b: pa.RecordBatch) -> dict:
        k, base, off = table.value
        rank = np.asarray(b.column("rank"))
        i = np.searchsorted(k, (np.asarray(b.column("length")) << 44) + rank, "right") - 1
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        return {**{n: b.column(n) for n in names}, "sequence_id": base[i] + rank, "offset": off[i]}

    before = part.select("chunk", "length", (F.sum("c").over(Window.partitionBy("length").orderBy("chunk")) - F.col("c")).alias("before"))
    # The offsets grow with the input (a row for each task and length), so they are merged, never broadcast.
    ranked = pieces.join(before.hint("merge"), ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
