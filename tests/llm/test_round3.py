"""Top-k, spelling variants and whitening against brute force, with edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

VEC = "vec_id long, embedding array<double>, label string, query_id long, x string, score string, rank string"


def vector_table(spark, pairs):
    """Vectors beside columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, v, "l", 7, "x", "s", "r") for i, v in pairs], VEC)


def odd_vectors(d=6, n=300, seed=3):
    rng = np.random.default_rng(seed)
    pairs = [(i, rng.normal(size=d).tolist()) for i in range(n)]
    hot = rng.normal(size=d).tolist()
    pairs += [(i, hot) for i in range(n, n + n // 2)]  # a third of all rows are one vector
    bad = [None, [], [1.0, None] + [0.0] * (d - 2), [math.nan] * d, [math.inf] * d, [1e300] * d, [0.0] * d, [1.0, 2.0], [2.0, 1.0], [-0.001] * d]
    return pairs + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, hot), (5, pairs[5][1])]


def quantised(pairs, scale):
    out = []
    for i, v in pairs:
        if v is not None and all(c is not None and math.isfinite(c) and abs(c * scale) < 2**53 for c in v):
            out.append((i, [math.floor(c * scale) for c in v]))
    return out


def brute_top(pairs, k, every, scale):
    rows = {i: v for i, v in quantised(pairs, scale) if i is not None}
    out = []
    for q in rows:
        if q % every:
            continue
        got = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, every", [(5, 10), (1, 50), (400, 100)])
def test_top_k(spark, k, every):
    from fieldloom.llm.topk import vector_top_k

    pairs = odd_vectors()
    got = vector_top_k(vector_table(spark, pairs).repartition(3), k=k, every=every)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(pairs, k, every, 256)


def test_top_k_of_several_passes_and_huge_components(spark, monkeypatch):
    from fieldloom.llm import topk

    monkeypatch.setattr(topk, "CELLS", 40)
    rng = random.Random(2)
    pairs = [(i, [rng.choice([3.0e6, -2.5e6, 1e-3, 7.0, 3.1e6]) for _ in range(5)]) for i in range(60)]
    got = topk.vector_top_k(vector_table(spark, pairs), k=4, every=3)
    assert sorted(map(tuple, got.collect())) == brute_top(pairs, 4, 3, 256)
    assert topk.vector_top_k(vector_table(spark, []), k=4).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        topk.vector_top_k(vector_table(spark, [(0, [3e13]), (1, [3e13])])).collect()


def test_lists_are_left_early():
    """Where the k-th score is known, skewed lists are not read to their end."""
    from fieldloom.llm import topk

    rng = np.random.default_rng(1)
    x = np.floor(rng.exponential(size=(2_000, 4)) ** 3 * 50)
    best = topk.Best(np.array([-1]), np.array([[1.0, 1.0, 1.0, 1.0]]), 5)
    resolved = []
    take = best.take
    best.take = lambda at, query, row, score: (resolved.append(len(row)), take(at, query, row, score))
    topk.read_lists(best, np.arange(2_000), x)
    want = sorted(range(2_000), key=lambda i: (-x[i].sum(), i))[:5]
    assert best.row[0].tolist() == want and sum(resolved) <= topk.FEW * 5


def brute_words(docs, least_length=5, least_count=3, drop=97):
    counts = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % drop == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs, **more):
    n = brute_words(docs, **more)
    out = {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = close[0] if close and n[close[0]] >= 2 * n[w] else None
        out[w] = (form, len(close))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return sorted((w, f or "", root(w), n[w], c, n[f] if f else -1) for w, (f, c) in out.items())


def variant_docs():
    rng = random.Random(4)
    base = ["banana", "ananas", "aaaaa", "aaaaaa", "aaaaaaa", "Überall", "überall", "straße", "strasse", "abababab", "bababab", "colour", "color", "naïveté", "x÷×ßy", "abcde", "abcdf", "bcdef"]
    docs = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base)
            if rng.random() < 0.4:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k + 1 :]])
            words.append(w)
        docs.append((d, rng.choice([" ", "\n", "-1,"]).join(words)))
    return docs + [(100, None), (101, ""), (None, "banana banana colour"), (102, "a" * 300_000), (102, "a" * 300_000), (103, "a" * 300_000), (104, "a" * 299_999), (5, docs[5][1]), (105, "banana " * 50_000), (106, "ĀbananaĀ 中colour\U0001f600colour")]


def variant_rows(got):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())


@pytest.mark.parametrize("drop, least", [(97, 3), (2, 1)])
def test_spelling_variants(spark, drop, least):
    from fieldloom.llm.variants import variants

    docs = variant_docs()
    table = spark.createDataFrame([(d, t, "w", 1, "f") for d, t in docs], "doc_id long, text string, word string, n long, form string").repartition(3)
    got = variants(table, drop=drop, least_count=least)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    short = [(d, t if t is None or len(t) < 250_000 else t) for d, t in docs]
    assert variant_rows(got) == brute_variants(short, drop=drop, least_count=least)


def test_spelling_variants_of_nothing(spark):
    from fieldloom.llm.variants import variants

    assert variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants(spark.createDataFrame([], "doc_id long, text string"), least_length=4)


def test_pivots_are_the_cheapest_disjoint_pair():
    from fieldloom.llm.variants import pivots

    rng = random.Random(6)
    for _ in range(500):
        place = sorted(rng.sample(range(12), rng.randint(3, 8)))
        weight = [rng.randint(0, 9) for _ in place]
        a, b = pivots(place, weight)
        want = min(weight[i] + weight[j] for i in range(len(place)) for j in range(i) if place[i] - place[j] >= 2)
        assert place[b] - place[a] >= 2 and weight[a] + weight[b] == want


@pytest.mark.parametrize("n, ties", [(1, False), (2, False), (40, False), (40, True), (7, True)])
def test_rank_one_updates(n, ties):
    """Eigenvalues, vectors and orthogonality after an update, with equal values and zeros."""
    from fieldloom.llm.whitening import rank_one

    rng = np.random.default_rng(n)
    for trial in range(20):
        e = np.sort(rng.integers(1, 4, n).astype(float) if ties else rng.exponential(size=n) ** 4)
        u = np.linalg.qr(rng.normal(size=(n, n)))[0]
        v = rng.normal(size=n) * (rng.random(n) < 0.6) if trial % 2 else u[:, trial % n] * 3
        rho = 10.0 ** rng.integers(-6, 4)
        want = u @ np.diag(e) @ u.T + rho * np.outer(v, v)
        e2, u2 = rank_one(e, u, v, rho)
        size = max(np.abs(want).max(), 1e-300)
        assert np.abs(u2 @ np.diag(e2) @ u2.T - want).max() < 1e-13 * n * size
        assert np.abs(u2.T @ u2 - np.eye(n)).max() < 1e-13 * n and (np.diff(e2) >= 0).all()


def test_spectra_combine_like_one_pass():
    from fieldloom.llm.whitening import Spectrum

    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(90, 7)) * 20).astype(np.int64) + 1_000_000
    x[:, 6] = x[:, 5]
    parts = []
    for k in range(3):
        s = Spectrum(7)
        for row in x[k::3]:
            s.add(row, 1)
        parts.append(s)
    s = Spectrum(7).merge(parts[0]).merge(parts[1]).merge(parts[2])
    c = x - x.mean(0)
    assert s.n == 90 and s.total == x.sum(0).tolist()
    assert np.allclose(s.u @ np.diag(s.e) @ s.u.T, c.T @ c, rtol=1e-9, atol=1e-6)


def whitened(pairs, components, scale=64, offset=1_000_000):
    rows = [(i, np.array(v, dtype=object) + offset) for i, v in quantised(pairs, scale) if v]
    out = {}
    for d in {len(v) for _, v in rows}:
        own = [(i, v) for i, v in rows if len(v) == d]
        n, s = len(own), sum(v for _, v in own)
        dev = [(n * v - s) for _, v in own]
        c = np.array([[float(a) / n for a in v] for v in dev])
        e, u = np.linalg.eigh(c.T @ c / n)
        out[d] = (n, own, [sum(int(a) ** 2 for a in v) for v in dev], c, e[::-1], u[:, ::-1])
    return out


def test_whitening(spark):
    from fieldloom.llm.whitening import whiten

    pairs = odd_vectors(d=6, n=200)
    got = whiten(vector_table(spark, pairs).repartition(5), components=4)
    rows = [r for r in got.collect()]
    want = whitened(pairs, 4)
    n, own, dev, c, e, u = want[6]
    mine = [r for r in rows if r.n == n]
    assert len(mine) == 4 * n and {r.identity_error <= 1e-10 for r in mine} == {True}
    assert Counter((r.vec_id, r.deviation) for r in mine if r.component == 1) == Counter((i, x) for (i, _), x in zip(own, dev))
    for k in range(1, 5):
        sign = None
        seen = {r.vec_id: r for r in mine if r.component == k}
        y = c @ u[:, k - 1] / math.sqrt(e[k - 1])
        for (i, _), v in zip(own, y):
            sign = sign or (1 if seen[i].whitened * v > 0 else -1 if abs(v) > 1e-6 else None)
            assert sign is None or abs(seen[i].whitened * sign - v) < 1e-9
        assert abs(seen[own[0][0]].explained - e[k - 1] / e.sum()) < 1e-12
    two = [r for r in rows if r.n == 2]  # two vectors of length 2 have one component
    assert len(two) == 2 and {r.component for r in two} == {1} and abs(abs(two[0].whitened) - 1) < 1e-9
    assert got.where(F.col("vec_id").isNull()).count() == 4


def test_whitening_without_variance(spark):
    from fieldloom.llm.whitening import whiten

    assert whiten(vector_table(spark, [])).count() == 0
    assert whiten(vector_table(spark, [(1, [0.5, 1.0])])).count() == 0
    assert whiten(vector_table(spark, [(i, [0.5, 1.0]) for i in range(50)] + [(99, None), (98, [])])).count() == 0


def test_whitening_of_a_tree_of_spectra(spark, monkeypatch):
    from fieldloom.llm import whitening

    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(5)
    pairs = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    rows = whitening.whiten(vector_table(spark, pairs).repartition(9)).collect()
    _, own, dev, c, e, u = whitened(pairs, 3)[3]
    got = np.array([[r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component)) if r.vec_id == i] for i in range(40)])
    assert np.allclose(np.abs(got), np.abs(c @ u / np.sqrt(e)), atol=1e-9) and {r.deviation for r in rows if r.vec_id == 3} == {dev[3]}
