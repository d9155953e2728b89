"""Grouping of spelling variants: words at edit distance 1, found by pivotal grams.

Words are counted over all texts.  Bigrams are ordered by the number of words
that hold them, rarest first.  The gram prefix of a word is its three first
bigrams in that order, with all that tie with the third.  One edit touches at most
one of two disjoint bigrams, so of two such bigrams (pivots) of a word's prefix one
is left in any near word, at most one place away.  Of two near words, the one
whose prefix ends earlier in the order has its pivots in the other's prefix.  So
pivots, chosen by a dynamic program over the places with the least expected number
of index entries, are looked up in an index of the prefixes' bigrams.

Position limits: an edit that keeps the length moves nothing, one that adds or
removes a code point moves the later bigrams by one; and where the edit is on one
side of a pivot, the text on its other side is the same in both words.  If it is
behind the second pivot or before the first one, that pivot is looked up with the
long text.  If it hits the second pivot or lies between the two, the first is looked
up with the text before it and the word's end (likewise the second with the text
behind it and the word's beginning).  Entries therefore have one key of length,
place, side and text.  Pairs that meet are verified.

A word's form is its most frequent near word, if that is at least twice as
frequent; roots follow forms by pointer doubling.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import mix64, parts, small_batches, utf8
from fieldloom.sources.scratch import Scratch

#: Letters A-Z, a-z and U+00C0 to U+00FF as UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: Entries that a task's counter holds before they are sent on.
HELD = 1 << 19
#: Code points up to which the join itself compares words.
SHORT = 64
#: Grams of a prefix for one edit: gram length times edits, and one.
PREFIX = 3


def _counter(drop: int):
    """Partial counts of the words of a partition's texts, by bytes."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def sent():
            names = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in names], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in (p for whole in batches for p in parts(whole)):
            for doc, text in zip(b.column("doc").to_pylist(), b.column("raw")):
                if not text.is_valid:
                    continue
                seed, own = zlib.crc32(doc + b":"), {}
                for m in _RUN.finditer(text.as_buffer()):
                    w = m[0]
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    w = w.lower()
                    h = zlib.crc32(w, seed)
                    if not h % drop:
                        s = w.decode()
                        k = h % len(s)
                        w = (s[:k] + s[k + 1 :]).encode()
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > HELD:
                    yield sent()
        yield sent()

    return run


def vocabulary(documents: DataFrame, least_length: int = 5, least_count: int = 3, drop: int = 97) -> DataFrame:
    """``word, n``: distinct words of ``documents(doc_id, text)`` and their numbers of occurrences."""
    small_batches(documents.sparkSession)
    read = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("doc"), utf8().alias("raw"))
    counts = read.mapInArrow(_counter(drop), "word string, n long").where(F.char_length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bigrams(batches):
    """Partial numbers of the words that hold each bigram."""
    counts: dict[str, int] = {}
    for b in batches:
        for w in b.column("word").to_pylist():
            for g in {w[i : i + 2] for i in range(len(w) - 1)}:
                counts[g] = counts.get(g, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])


def pivots(place: list[int], weight: list[float]) -> tuple[int, int]:
    """Indices of the two disjoint bigrams of least total weight; ``place`` rises.

    Dynamic program over places: the best pair that ends with a bigram joins it to
    the best single one at least two places before.
    """
    best, pair, chosen, behind = None, None, (0, 0), 0
    for i, p in enumerate(place):
        while place[behind] <= p - 2:
            if best is None or weight[behind] < weight[best]:
                best = behind
            behind += 1
        if best is not None and (pair is None or weight[best] + weight[i] < pair):
            pair, chosen = weight[best] + weight[i], (best, i)
    return chosen


#: Sides of a bigram whose text is in a key: before it, behind it, and these with the word's end or beginning.
BEFORE, BEHIND, BEFORE_END, BEHIND_BEGIN = range(4)


def _texts(w: str, place: list[int]) -> tuple[list[int], list[int]]:
    """Checksums of the texts up to the end and from the beginning of the bigram at each place."""
    before, behind, c, at = [], [], 0, 0
    for i in place:
        c, at = zlib.crc32(w[at : i + 2].encode(), c), i + 2
        before.append(c)
    c, at = 0, len(w)
    for i in reversed(place):
        c, at = zlib.crc32(w[i:at][::-1].encode(), c), i
        behind.append(c)
    return before, behind[::-1]


def entries(w: str, order: dict[str, int], count: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int, int]], int]:
    """Index entries and look-ups of a word as (side, length, place, text, rim), and the end of its prefix."""
    n = len(w)
    rank = [order[w[i : i + 2]] for i in range(n - 1)]
    end = sorted(rank)[PREFIX - 1]
    place = [i for i, r in enumerate(rank) if r <= end]
    before, behind = _texts(w, place)
    first, last = (ord(w[0]) << 8 | ord(w[1])) + 1, (ord(w[-2]) << 8 | ord(w[-1])) + 1
    held = []
    for i, a, b in zip(place, before, behind):
        held += [(BEFORE, n, i, a, 0), (BEHIND, n, i, b, 0), (BEFORE_END, n, i, a, last), (BEHIND_BEGIN, n, i, b, first)]
    # Each further code point that must agree leaves about a quarter of the entries.
    x, y = pivots(place, [count[rank[i]] * (4.0**-i + 4.0 ** (i + 2 - n)) for i in place])
    p, q, asked = place[x], place[y], []
    for more in (-1, 0, 1):
        asked += [(BEFORE, n + more, q, before[y], 0), (BEHIND, n + more, p + more, behind[x], 0)]
        asked.append((BEFORE_END, n + more, p, before[x], last) if n - q >= 4 else (BEFORE, n + more, p, before[x], 0))
        asked.append((BEHIND_BEGIN, n + more, q + more, behind[y], first) if p >= 2 else (BEHIND, n + more, q + more, behind[y], 0))
    return held, asked, end


def _index(ranked):
    """Rows ``id, word, key, ends, asked`` of each word's entries and look-ups; words over ``SHORT`` go without their text."""

    def run(batches):
        order, count = ranked.value
        for b in batches:
            words = b.column("word").to_pylist()
            at, ends, asks, keys = [], [], [], []

            def sent(b=b, words=words):
                take = pa.array(at, pa.int32())
                k = np.array(keys, np.int64).reshape(-1, 5).view(np.uint64)  # a place of -1 is met nowhere
                h = np.zeros(len(k), np.uint64)
                for c in k.T:
                    h = mix64(h * np.uint64(31) + c)
                short = pa.array([w if len(w) <= SHORT else None for w in words], pa.string())
                out = [b.column("id").take(take), short.take(take), pa.array(h.view(np.int64)), pa.array(ends, pa.int32()), pa.array(asks, pa.bool_())]
                for v in (at, ends, asks, keys):
                    v.clear()
                return pa.RecordBatch.from_arrays(out, names=["id", "word", "key", "ends", "asked"])

            for row, w in enumerate(words):
                held, asked, end = entries(w, order, count)
                for rows, ask in ((held, False), (asked, True)):
                    keys += rows
                    at += [row] * len(rows)
                    ends += [end] * len(rows)
                    asks += [ask] * len(rows)
                if len(at) > HELD // 4:
                    yield sent()
            yield sent()

    return run


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point; linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    lo, hi = 0, len(a)
    while lo < hi:  # length of the common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    if len(a) == len(b):
        return lo < len(a) and a[lo + 1 :] == b[lo + 1 :]
    return len(b) == len(a) + 1 and a[lo:] == b[lo + 1 :]


def _verify(batches):
    for b in batches:
        yield b.select(["a", "b"]).filter(pa.array([near(*p) for p in zip(b.column("x").to_pylist(), b.column("y").to_pylist())], pa.bool_()))


def near_words(words: DataFrame, tmp: Scratch) -> DataFrame:
    """``a, b``: ids of all pairs of near words of ``words(id, word)``, both ways."""
    spark = words.sparkSession
    # At most 8,100 bigrams: each code point is one of a to z and U+00C0 to U+00FF.
    held = words.select("word").mapInArrow(_bigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").toPandas()
    ranked = spark.sparkContext.broadcast(({g: i for i, g in enumerate(held.gram)}, held.n.tolist()))
    index = tmp.write(words.select("id", "word").mapInArrow(_index(ranked), "id long, word string, key long, ends int, asked boolean"), "index")
    asked = index.where("asked").select(F.col("id").alias("a"), F.col("word").alias("x"), "key", F.col("ends").alias("a_ends"))
    kept = index.where("not asked").select(F.col("id").alias("b"), F.col("word").alias("y"), "key", F.col("ends").alias("b_ends"))
    # The built-in distance is quadratic in the length, so only pairs of short words are verified by it here.
    thin = F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("a") != F.col("b")).otherwise(F.levenshtein("x", "y", 1) == 1)
    met = asked.join(kept, "key").where((F.col("a_ends") <= F.col("b_ends")) & thin)
    met = tmp.write(met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), (F.col("x").isNull() | F.col("y").isNull()).alias("long")).select("p.*", "long").distinct(), "met")
    text = words.select(F.col("id"), "word")
    long = met.where("long").join(text.select(F.col("id").alias("a"), F.col("word").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("word").alias("y")), "b")
    return met.where("not long").select("a", "b").unionByName(long.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))


def roots(forms: DataFrame, tmp: Scratch) -> DataFrame:
    """``id, root`` of ``forms(id, form)``, which have no cycle: the last form that each word leads to."""
    now = tmp.write(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = tmp.write(now.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        tmp.drop(now)
        now = new
        if not moved:
            return now.select("id", "root")


def variants(documents: DataFrame, least_length: int = 5, least_count: int = 3, drop: int = 97, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``documents(doc_id, text)``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case.
    Where ``drop`` divides the crc32 of ``<doc_id>:<word>`` (a null id is empty),
    the code point at that number modulo the length is left out.  Null and empty
    texts have no words; repeated documents count as often as they occur.  Words
    of less than ``least_length`` (5 at least) code points or ``least_count``
    occurrences are left out.  Ties of the most frequent near word go to the
    first in code-point order.  Other columns are not read; an empty table gives
    an empty one.
    """
    if least_length < 5:
        raise ValueError("words need five code points, so that every prefix holds two disjoint bigrams")
    tmp = Scratch(documents.sparkSession, "variants")
    words = tmp.write(vocabulary(documents, least_length, least_count, drop).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    other = words.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("word").alias("b_word"))
    first = near_words(words, tmp).join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b_word", "b")).alias("first"))
    is_form = -F.col("first.less") >= times * F.col("n")
    told = words.join(first, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(is_form, F.col(f"first.{c}")).alias(new) for c, new in (("b", "form_id"), ("b_word", "form"))], F.when(is_form, -F.col("first.less")).alias("form_n"))
    told = tmp.write(told, "told")
    root = roots(told.where("form is not null").select("id", F.col("form_id").alias("form")), tmp)
    root = root.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return told.join(root, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
