"""Text likelihood over all subword segmentations.

The pieces of an existing subword vocabulary, weighted by its own scores,
generate a text piece by piece: each word is its bytes after a space mark, cut
into pieces in any way, and an end follows the last word.  ``vocabulary_score``
uses those weights alone.  ``score`` mixes them, with a share of
``PRIOR_SHARE``, with the piece frequencies of the training documents, estimated
by ``PASSES`` passes of expected counts over all their distinct words (weighted by
their training counts).  Pieces never cross a word, so the probability of a text
is the product of its words' marginals, each a log-space forward recursion over
the word's whole lattice.  Words of up to ``WIDE`` bytes are worked on together;
longer ones alone, by a recursion that holds the last positions that a piece can
reach, linear in time whatever their length.

Work is done once for each distinct word, not for each token.  Words of the
``TOP_WORDS`` highest counts (a fixed bound) are looked up where the text is
read; only the others are shuffled to meet the table of words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.quality import held_out
from fieldloom.llm.text import SPACE, Words, map_batches, mix64, parts, raw_column, small_batches, utf8
from fieldloom.sources.scratch import Scratch

TOP_WORDS = 65_536
#: Share of the vocabulary's own weights in the learned ones.
PRIOR_SHARE = 0.1
PASSES = 2
WIDE = 1024
#: Bytes up to which the probability of any segmentation is far from underflow.
PLAIN = 32
#: Bytes of a longer word whose pieces are looked up at once.
SEGMENT = 1 << 16
_BASE = np.uint64(0x100000001B3)
_AREA = 200_000
_NEG = -1e30
_LN10 = math.log(10)


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and their prior probabilities from the vocabulary's scores.

    The word mark is a space; byte pieces are single bytes, so any text has a
    segmentation.  No unigram file is at hand: the scores of this vocabulary are
    ranks that fall by one from piece to piece, and the matching Zipf law stands
    for their log probabilities.  Pieces of the same bytes are joined.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 0.05 / 50_000 for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", " ").encode()
        weight[piece] = weight.get(piece, 0.0) + 1.0 / (50.0 - sp.get_score(i))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, p / p.sum()


class Lattice:
    """Forward and backward recursions over batches of words; ``other`` are further weights of the same pieces."""

    def __init__(self, pieces: list[bytes], prob: np.ndarray, *other: np.ndarray):
        lengths = np.array([len(p) for p in pieces])
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.logs = keys[self.order], [np.append(np.log(np.maximum(p, 1e-300))[self.order], _NEG) for p in (prob, *other)]
        self.kinds = np.unique(lengths)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.keys >> np.uint64(42)] = True

    @staticmethod
    def _key(piece: bytes) -> int:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = h * _BASE + np.uint64(b + 1)
        return int(mix64(h + np.uint64(len(piece)))[0])

    def _matches(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length, the piece that starts at each place (-1: none)."""
        pre = np.zeros((m.shape[0], m.shape[1] + 1), np.uint64)
        for j in range(m.shape[1]):
            pre[:, j + 1] = pre[:, j] * _BASE + m[:, j]
        out = {}
        for n in self.kinds[self.kinds <= m.shape[1]].tolist():
            power = np.uint64(pow(int(_BASE), n, 1 << 64))
            h = mix64(pre[:, n:] - pre[:, :-n] * power + np.uint64(n))
            at = np.flatnonzero(self.table[h >> np.uint64(42)])
            hit = h.reshape(-1)[at]
            k = np.minimum(np.searchsorted(self.keys, hit), len(self.keys) - 1)
            ok = self.keys[k] == hit
            piece = np.full(h.size, -1, np.int32)
            piece[at[ok]] = k[ok]
            out[n] = piece.reshape(h.shape)
        return out

    def _chunks(self, words: list[bytes]):
        """Index, size and bytes (plus one) of the words of up to ``WIDE`` bytes after their space marks, by size."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        order, at = np.argsort(size, kind="stable"), 0
        order = order[size[order] <= WIDE]
        while at < len(order):
            n = at + 1
            while n < len(order) and (n + 1 - at) * size[order[n]] <= _AREA:
                n += 1
            idx = order[at:n]
            wide = int(size[idx[-1]])
            m = np.frombuffer(b"".join((b" " + words[i]).ljust(wide, b"\0") for i in idx), np.uint8).reshape(len(idx), wide).astype(np.uint64) + np.uint64(1)
            yield idx, size[idx], m
            at = n

    def _pieces(self, raw: bytes, step: int = 1):
        """For each place of a long word in turn (from the last one with step -1) the lengths and the numbers of the pieces that start there."""
        longest = int(self.kinds[-1])
        for lo in range(0, len(raw), SEGMENT)[::step]:
            n = min(SEGMENT, len(raw) - lo)
            m = np.frombuffer(raw[lo : lo + n + longest - 1], np.uint8).reshape(1, -1).astype(np.uint64) + np.uint64(1)
            place, length, piece = [], [], []
            for k, p in self._matches(m).items():
                i = np.flatnonzero(p[0, :n] >= 0)
                place.append(i), length.append(np.full(len(i), k)), piece.append(p[0, i])
            place, length, piece = (np.concatenate(v) for v in (place, length, piece))
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], np.arange(n + 1)).tolist()
            length, piece = length[order].tolist(), piece[order].tolist()
            for i in range(n)[::step]:
                yield length[cut[i] : cut[i + 1]], piece[cut[i] : cut[i + 1]]

    def _long(self, raw: bytes, prob: list[float], keep: bool = False) -> tuple[float, np.ndarray | None]:
        """Log probability of a long word, and with ``keep`` that of each of its beginnings.

        Values of the positions ahead are held in a ring and scaled together where they become small.
        """
        n = int(self.kinds[-1]) + 1
        ring, scale, out = [0.0] * n, 0.0, np.empty(len(raw) + 1) if keep else None
        ring[0] = 1.0
        for i, (lengths, pieces) in enumerate(self._pieces(raw)):
            at = i % n
            v, ring[at] = ring[at], 0.0
            if v < 1e-100:
                ring = [x * 1e100 for x in ring]
                v, scale = v * 1e100, scale - 100 * _LN10
            if keep:
                out[i] = math.log(v) + scale
            for k, p in zip(lengths, pieces):
                ring[(at + k) % n] += v * prob[p]
        end = math.log(ring[len(raw) % n]) + scale
        if keep:
            out[-1] = end
        return end, out

    def _long_expected(self, raw: bytes, prob: list[float], count: float, total: np.ndarray) -> None:
        """Add the expected uses of each piece in a long word."""
        end, forward = self._long(raw, prob, True)
        n = int(self.kinds[-1]) + 1
        ring, scale = [0.0] * n, 0.0  # of the rests behind each place, from the last one on
        ring[len(raw) % n] = 1.0
        for i, (lengths, pieces) in zip(range(len(raw) - 1, -1, -1), self._pieces(raw, -1)):
            terms = [prob[p] * ring[(i + k) % n] for k, p in zip(lengths, pieces)]
            factor = math.exp(min(forward[i] + scale - end, 700.0)) * count
            for p, t in zip(pieces, terms):
                total[p] += factor * t
            v = ring[i % n] = sum(terms)
            if v < 1e-100:
                ring = [x * 1e100 for x in ring]
                scale -= 100 * _LN10

    def _forward(self, match: dict[int, np.ndarray], rows: int, wide: int, log: np.ndarray) -> np.ndarray:
        a = np.full((rows, wide + 1), _NEG)
        a[:, 0] = 0
        some = {n: (p >= 0).any(0) for n, p in match.items()}
        for j in range(1, wide + 1):
            terms = np.stack([a[:, j - n] + log[match[n][:, j - n]] for n, hit in some.items() if n <= j and (hit[j - n] or n == 1)])
            top = terms.max(0)
            a[:, j] = np.maximum(top + np.log(np.exp(terms - top).sum(0)), _NEG)
        return a

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, summed over its segmentations; one row for each set of weights."""
        out = np.zeros((len(self.logs), len(words)))
        for of, size, m in self._chunks(words):
            match = self._matches(m)
            for row, log in zip(out, self.logs):
                a = self._forward(match, *m.shape, log)
                row[of] = a[np.arange(len(of)), size] / _LN10
        long = [i for i, w in enumerate(words) if len(w) >= WIDE]
        for row, log in zip(out, self.logs if long else ()):
            prob = np.exp(log).tolist()
            for i in long:
                row[i] = self._long(b" " + words[i], prob)[0] / _LN10
        return out

    @staticmethod
    def _plain_expected(match: dict[int, np.ndarray], size: np.ndarray, counts: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Add the expected uses of each piece in short words, whose probabilities need no logarithms."""
        rows, wide = len(size), match[1].shape[1]
        some = {n: np.flatnonzero((p >= 0).any(0)).tolist() for n, p in match.items()}
        of = {(n, i): weight[match[n][:, i]] for n, at in some.items() for i in at}
        a, b = np.zeros((wide + 1, rows)), np.zeros((wide + 1, rows))
        a[0], b[size, np.arange(rows)] = 1.0, 1.0
        for n, i in sorted(of, key=lambda x: x[1]):
            a[i + n] += a[i] * of[n, i]
        for n, i in sorted(of, key=lambda x: -x[1]):
            b[i] += b[i + n] * of[n, i]
        scale = counts / a[size, np.arange(rows)]
        for (n, i), w in of.items():
            e = a[i] * w * b[i + n] * scale
            at = np.flatnonzero(e)
            total += np.bincount(match[n][at, i], e[at], len(total))

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (in ``order``) over words with counts."""
        total, log = np.zeros(len(self.keys)), self.logs[0]
        weight = np.append(np.exp(log[:-1]), 0.0)
        for of, size, m in self._chunks(words):
            match = self._matches(m)
            if m.shape[1] <= PLAIN:
                self._plain_expected(match, size, counts[of], weight, total)
                continue
            a = self._forward(match, *m.shape, log)
            rows, wide = m.shape
            b = np.full((rows, wide + 1), _NEG)
            b[np.arange(rows), size] = 0
            for i in range(wide - 1, -1, -1):
                terms = np.stack([b[:, i + n] + log[p[:, i]] for n, p in match.items() if i + n <= wide])
                top = terms.max(0)
                v = top + np.log(np.exp(terms - top).sum(0))
                b[:, i] = np.where(i < size, np.maximum(v, _NEG), b[:, i])
            z = a[np.arange(rows), size]
            for n, p in match.items():
                r, i = np.nonzero(p >= 0)
                k = p[r, i]
                e = np.exp(np.minimum(a[r, i] + log[k] + b[r, i + n] - z[r], 0.0)) * counts[of][r]
                total += np.bincount(k, e, len(total))
        long = [i for i, w in enumerate(words) if len(w) >= WIDE]
        prob = np.exp(log).tolist() if long else []
        for i in long:
            self._long_expected(b" " + words[i], prob, float(counts[i]), total)
        return total


def _word_table(docs: DataFrame) -> DataFrame:
    """``word_id, word, c`` (training occurrences) and ``seen`` (all) of each distinct word."""

    def one(batch: pa.RecordBatch) -> dict:
        w = Words(*raw_column(batch, "text"), SPACE)
        key, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        learn = np.repeat(np.asarray(batch.column("learn")), np.diff(w.of_text))
        return {
            "word_id": key.view(np.int64),
            "word": [w.folded[a:b].tobytes() for a, b in zip(w.start[first], w.end[first])],
            "c": np.bincount(back, learn, len(key)).astype(np.int64),
            "seen": np.bincount(back, minlength=len(key)).astype(np.int64),
        }

    rows = map_batches(docs.select((~held_out("doc_id", 7)).cast("double").alias("learn"), utf8().alias("text")), one, "word_id long, word binary, c long, seen long")
    return rows.groupBy("word_id").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _expected(words: DataFrame, pieces: list[bytes], prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over ``words(word, c)``; one row a piece reaches the driver."""
    lattice = Lattice(pieces, prob)
    held = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        total = np.zeros(len(held.value.keys))
        for b in batches:
            total += held.value.expected(b.column("word").to_pylist(), np.asarray(b.column("c"), float))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "e": pa.array(total[k], pa.float64())})

    out = np.zeros(len(pieces))
    for r in words.select("word", "c").mapInArrow(run, "k long, e double").groupBy("k").agg(F.sum("e").alias("e")).collect():
        out[lattice.order[r.k]] = r.e
    return out


def _most(words: DataFrame, count: str) -> DataFrame:
    """The words of the highest counts, ``TOP_WORDS`` at most.

    The least count is read off a histogram of counts (sixteen bins an octave),
    so no task merges the partitions' candidates.
    """
    bins = words.groupBy(F.floor(F.log2(count) * 16).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()  # some hundred rows
    held, least = 0, None
    for r in sorted(bins, key=lambda r: -r.b):
        held += r.n
        if held > TOP_WORDS:
            break
        least = r.b
    return words.where(F.floor(F.log2(count) * 16) >= least) if least is not None else words.limit(0)


def text_scores(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Scores of every text of ``docs(doc_id, text)``.

    Tokens are words and one end.  A null or empty text is the end alone.  A
    null id belongs to the training part.  Each repeated row is scored by
    itself.  With no training rows at all every token is unknown and the model
    keeps the vocabulary's own weights.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "lattice")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = tmp.write(_word_table(docs), "words")
    ends = docs.where(~held_out("doc_id", 7)).count()
    totals = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, kinds = (totals.n or 0) + ends, totals.v + (ends > 0)

    pieces, prior = vocabulary(model_file)
    learn = words.where("c > 0").select("word", "c", "word_id")
    prob = prior
    for _ in range(PASSES):
        counts = _expected(learn, pieces, prob)
        uses = counts.sum()
        prob = (1 - PRIOR_SHARE) * counts / uses + PRIOR_SHARE * prior if uses else prior
    stop = (ends + 1) / (uses + ends + 2)  # the share of ends among all that a text generates
    model = spark.sparkContext.broadcast(Lattice(pieces, (1 - stop) * prob, (1 - stop) * prior))
    end_model = float(np.log10(stop))
    log_all = float(np.log10(n_train + kinds + 1))
    end_base = float(np.log10(ends + 1)) - log_all

    def weigh(batch: pa.RecordBatch) -> dict:
        c = np.asarray(batch.column("c"))
        log, own = model.value.log10(batch.column("word").to_pylist())
        return {"word_id": batch.column("word_id"), "known": (c > 0).astype(np.int64), "base": np.log10(c + 1.0) - log_all, "log": log, "own": own, "seen": batch.column("seen")}

    table = tmp.write(map_batches(words, weigh, "word_id long, known long, base double, log double, own double, seen long"), "weights")
    facts = ("known", "base", "log", "own")
    top = _most(table, "seen").select("word_id", *facts).toPandas()  # TOP_WORDS rows at most
    top = top.sort_values("word_id")
    held = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("word_id", *facts)))

    def meet(batches):
        keys, *weights = held.value
        row0 = TaskContext.get().partitionId() << 40
        for b in (p for whole in batches for p in parts(whole)):
            w = Words(*raw_column(b, "text"), SPACE)
            at = np.repeat(np.arange(b.num_rows), n := np.diff(w.of_text))
            h = w.hash.view(np.int64)
            i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
            rare, times = _pairs((row0 + at)[~hit], h[~hit])
            m, none = b.num_rows, pa.nulls(len(times), pa.float64())
            out = {
                "row": pa.array(np.concatenate([row0 + np.arange(m), rare[0]]), pa.int64()),
                "word_id": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(rare[1], pa.int64())]),
                "times": pa.array(np.concatenate([n + 1, times]), pa.int64()),
                "doc_id": pa.concat_arrays([b.column("doc_id").cast(pa.int64()), pa.nulls(len(times), pa.int64())]),
            }
            for name, v in zip(facts, weights):
                one = np.bincount(at[hit], v[i[hit]] if len(v) else None, m)
                out[name] = pa.concat_arrays([pa.array(one, pa.float64()), none])
            yield pa.RecordBatch.from_pydict(out)
            row0 += m

    met = tmp.write(docs.mapInArrow(meet, "row long, word_id long, times long, doc_id long, " + ", ".join(f"{c} double" for c in facts)), "met")
    rare = met.where("word_id is not null").select("row", "word_id", "times").join(table.select("word_id", *facts), "word_id")
    rare = rare.groupBy("row").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in facts])
    heads = met.where("word_id is null").select("row", "doc_id", "times", *facts)
    both = heads.unionByName(rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("times"), *facts))
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("times").alias("n_tokens"), *[F.sum(c).alias(c) for c in facts])
    return out.select(
        "doc_id",
        held_out("doc_id", 7).alias("held_out"),
        "n_tokens",
        (F.col("known").cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("log") + end_model).alias("score"),
        (F.col("own") + end_model).alias("vocabulary_score"),
    )


def _pairs(row: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (row, word) pairs and how often each occurs."""
    if not len(row):
        return (row, h), np.empty(0, np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
    return (row[first], h[first]), np.diff(np.append(first, len(row)))
