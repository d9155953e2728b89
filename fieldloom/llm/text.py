"""Tokens, shingles and Arrow plumbing shared by the text operators.

Texts travel to Python as UTF-8 bytes in Arrow batches.  ``bytes.lower`` folds
A-Z alone and ``bytes.split`` cuts at space and \\x09-\\x0D alone, which is
exactly the word rule of the near-duplicate and language-model contracts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; a batch of the longest texts must fit a Python worker.
BATCH_ROWS = 400
#: Bytes of text worked on at once: a batch of more is cut between rows, so working memory follows this or the longest text.
PART_BYTES = 8 << 20

#: Bytes that separate words of ``[0-9a-z\x80-\xff]+`` become spaces, A-Z fold.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(col: str = "text") -> Column:
    """The text as bytes; null stays null."""
    return F.col(col).cast("string").cast("binary")


def space_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return raw.lower().split() if raw else []


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of non-ASCII characters."""
    return raw.translate(_ALNUM).split() if raw else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that combined hashes are spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, np.uint64(n))
    for j in range(n):
        acc = mix64(acc * _M1 + h[j : j + m])
    return acc


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle."""
    h = word_hashes(space_words(raw))
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(h, min(n, len(h))))


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows of ``df``, drawn by a hash of ``keys``; all rows where there are no more.

    The draw does not depend on partitions.  Its share is set a little under
    n / rows, so that about n rows pass the filter wherever they lie, and only
    those meet in the final limit.
    """
    total = df.count()
    if total <= n:
        return df
    u = F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(1 << 40)) / float(1 << 40)
    return df.where(u < max(n - 4 * n**0.5, n / 2) / total).limit(n)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``PART_BYTES`` of strings each, or of one row."""
    if batch.nbytes <= PART_BYTES or batch.num_rows < 2:
        yield batch
        return
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        for a in c.flatten() if pa.types.is_struct(c.type) else [c]:
            if pa.types.is_string(a.type) or pa.types.is_binary(a.type):
                total += np.asarray(pa.compute.fill_null(pa.compute.binary_length(a), 0), np.int64)
    end, lo = np.cumsum(total), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + PART_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``mapInArrow`` over single batches; ``fn`` may return a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    assert isinstance(struct, StructType)
    want = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            out = fn(b)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in want], schema=want)
            yield out

    return df.mapInArrow(run, struct)


#: Bytes between words for the white-space rule; A-Z fold.
_SPACE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
ALNUM, SPACE = _ALNUM, _SPACE
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        t = np.full(max(n, 2 * _SEGMENT), base, np.uint64)
        t[0] = 1
        have = _powers[base] = np.multiply.accumulate(t)
    return have


def raw_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    c = batch.column(batch.schema.get_field_index(name))
    if c.null_count:
        c = pa.compute.fill_null(c, b"" if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else "")
    big = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
    _, offs, data = c.buffers()
    offs = np.frombuffer(offs, np.int64 if big else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


class Words:
    """Words of a batch of texts: hashes, byte spans and the range of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: bytes):
        self.folded = np.frombuffer(data.tobytes().translate(table), np.uint8)
        isw = self.folded != 32
        prev = np.zeros(len(isw), bool)
        prev[1:] = isw[:-1]
        cut = offs[:-1]
        prev[cut[cut < len(isw)]] = False
        self.start = np.flatnonzero(isw & ~prev)
        nxt = np.zeros(len(isw), bool)
        nxt[:-1] = isw[1:]
        cut = offs[1:] - 1
        nxt[cut[cut >= 0]] = False
        self.end = np.flatnonzero(isw & ~nxt) + 1
        self.of_text = np.searchsorted(self.start, offs)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, n, w = np.empty(len(self.start), np.uint64), len(self.start), 0
        inverse = pow(_BASE, -1, 1 << 64)
        while w < n:  # segments end between words, so memory follows the segment or the longest word
            lo = self.start[w]
            v = max(w + 1, int(np.searchsorted(self.end, lo + _SEGMENT)))
            hi = self.end[v - 1]
            p = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.folded[lo:hi].astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, hi - lo)[: hi - lo], out=p[1:])
            s, e = self.start[w:v] - lo, self.end[w:v] - lo
            out[w:v] = mix64((p[e] - p[s]) * _power_table(inverse, hi - lo)[s] + (e - s).astype(np.uint64))
            w = v
        return out

    def word(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` joined by single spaces."""
        return b" ".join([self.folded[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j])])


def annotate(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: str) -> DataFrame:
    """``row``, a struct of all columns of ``df`` with ``text`` as a string, and the columns ``fn`` adds.

    ``fn`` sees batches of ``text`` alone.  Since the row travels as one struct,
    its columns may have any names, also those of the added ones; ``select("row.*")``
    gives them back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    extra = df.sparkSession.createDataFrame([], added).schema
    want, at = to_arrow_schema(extra), df.columns.index("text")
    held = df.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            more = fn(pa.RecordBatch.from_arrays([b.column(0).field(at)], names=["text"]))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(more[f.name], f.type) for f in want], names=["row"] + want.names)

    return held.mapInArrow(run, StructType([held.schema["row"]] + extra.fields))
