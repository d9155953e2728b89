"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page are multiplied and normalised:

* the visible text, by a smoothed character-trigram model for each language,
  counted over all documents of known language and tempered, since trigrams of
  one text are not independent;
* the language that the markup declares and the address suffix and language
  segment, each through a table P(signal | language) counted over all pages
  against what their text says;
* the host: its languages counted over its other pages (the page itself is
  left out), smoothed by its domain, that by its suffix, that by all pages.

The languages are those of ``documents.lang``.  Text that a host repeats from
page to page (advertisements, footers) is left out: blocks of text are counted by
host, and one that at least ``REPEATS`` different pages and a tenth of the host's
pages hold is no evidence about any of them.

All tables are grouped aggregations.  Host counts meet the pages again in an
equi-join of two written tables, which splits hosts of very many pages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import map_batches, mix64, parts, raw_column, small_batches, utf8
from fieldloom.sources.scratch import Scratch

BUCKETS = 1 << 15
PULL = 8.0  # pseudo-pages by which a level of the host tree follows the level above
TEMPER = 40.0  # parameter of the model: independent trigrams that a long text is worth; all its trigrams are averaged
REPEATS = 5  # pages of a host that make a block of text its boilerplate
SUFFIXES = 100  # commonest address suffixes with a table entry of their own; the rest share one
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))
_HIDDEN = re.compile(rb"(?i)<(?:(!--)|(script|style|nav|head)(?![a-z0-9]))")
_ENTITY = re.compile(rb"&[a-zA-Z#0-9]{1,10};")
_LANG = re.compile(rb"(?i)[\s\"'/]lang\s*=\s*[\"']?([a-z]{2,3})")


def trigrams(raw: bytes) -> np.ndarray:
    """Bucket of each character trigram of the folded text."""
    b = np.frombuffer(b" " + raw.translate(_FOLD) + b" ", np.uint8)
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint64)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (mix64(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def visible(html: bytes) -> list[bytes]:
    """Blocks of the page's text: what stands between tags, without comments, scripts, styles, head and navigation.

    One scan forward: a closing mark that was not found once is not looked for
    again, so unclosed marks cost no more than closed ones.
    """
    low, kept, at, pos, missing = html.lower(), [], 0, 0, set()
    while m := _HIDDEN.search(html, pos):
        close = b"-->" if m[1] else b"</" + m[2].lower()
        end = -1 if close in missing else low.find(close, m.end())
        if end < 0:
            missing.add(close)
            pos = m.end()
            continue
        if not m[1]:
            end = low.find(b">", end)
        kept.append(html[at : m.start()])
        at = pos = len(html) if end < 0 else end + (3 if m[1] else 1)
    kept.append(html[at:])
    out = []
    for piece in b"<p>".join(kept).split(b"<"):
        tag, close, text = piece.partition(b">")
        text = _ENTITY.sub(b" ", text if close else tag).strip()
        if text:
            out.append(text)
    return out


def declared(html: bytes) -> str:
    """The language of the first html tag, or nothing."""
    at = html.lower().find(b"<html")
    end = html.find(b">", at)
    m = _LANG.search(html, at, len(html) if end < 0 else end) if at >= 0 else None
    return m[1].decode().lower() if m else ""


def languages(docs: DataFrame) -> list[str]:
    """The codes that ``documents`` hold, in alphabetical order."""
    rows = docs.where("lang is not null and trim(lang) <> ''").select(F.lower(F.trim("lang")).alias("lang")).distinct().collect()  # one row a language
    return sorted(r.lang for r in rows)


def profiles(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """Log probabilities of trigram buckets by language, from all documents of known language."""
    known = docs.select(F.lower(F.trim("lang")).alias("lang"), utf8().alias("text")).where(F.col("lang").isin(langs) & F.col("text").isNotNull())

    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in (p for whole in batches for p in parts(whole)):
            data, offs = raw_column(b, "text")
            for t, lang in enumerate(b.column("lang").to_pylist()):
                own = total.setdefault(number[lang], np.zeros(BUCKETS, np.int64))
                for at in range(offs[t], offs[t + 1], 1 << 20):
                    own += np.bincount(trigrams(data[at : min(at + (1 << 20), offs[t + 1])].tobytes()), minlength=BUCKETS)
        for i, own in total.items():
            j = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(j), i), pa.int32()), "j": pa.array(j, pa.int32()), "c": pa.array(own[j], pa.int64())})

    c = np.full((len(langs), BUCKETS), 0.5)
    got = known.mapInArrow(count, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toArrow()  # columns of numbers, languages x buckets at most
    c[np.asarray(got.column("i")), np.asarray(got.column("j"))] += np.asarray(got.column("c"))
    return np.log(c / c.sum(1, keepdims=True))


def _blocks(pages: DataFrame, log: np.ndarray) -> DataFrame:
    """``row, page_id, url, declared, host`` of each page and, for each of its blocks, ``block, n, z`` (trigrams, log likelihoods)."""
    held = pages.sparkSession.sparkContext.broadcast(log)

    def read(batch: pa.RecordBatch) -> dict:
        out, blocks = [], []
        for raw in batch.column("html").to_pylist():
            raw, mine = raw or b"", {}
            for text in visible(raw):
                t = trigrams(text)
                if len(t):
                    k = xxhash.xxh3_64_intdigest(text) >> 1
                    n, z = mine.get(k, (0, 0.0))
                    mine[k] = (n + len(t), z + held.value[:, t].sum(1))
            out.append(declared(raw))
            blocks.append([{"block": k, "n": n, "z": z.tolist()} for k, (n, z) in mine.items()])
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "declared": out, "blocks": blocks}

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    return map_batches(src, read, "page_id long, url string, declared string, blocks array<struct<block:long,n:int,z:array<double>>>")


def _scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda v: v * by)


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, host, declared, text_lang, lang, probability`` and ``p_<code>`` for each language.

    Null or empty markup has no text evidence and leans on the address; a null
    address has no host and takes the prior of all pages; with neither, the
    prior alone decides.  Ties go to the first language in alphabetical order.
    Repeated rows are judged alike.  Without documents of known language every
    page gets a null language.
    """
    spark = pages.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "language")
    langs = languages(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.lit("").alias(c) for c in ("host", "declared")], *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")], F.lit(None).cast("double").alias("probability"))
    d = len(langs)
    each = range(d)
    read = _blocks(pages, profiles(docs, langs))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    read = tmp.write(read.select(F.monotonically_increasing_id().alias("row"), "page_id", "declared", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.lower(F.regexp_extract("url", r"^[^?#]*?//[^/]+/([a-zA-Z]{2,3})(?:[/?#]|$)", 1)), F.lit("")).alias("segment"), "blocks"), "read")

    # Pages of equal blocks count once, so that copies of a page do not turn its text into boilerplate.
    once = tmp.write(read.where("host <> ''").select("host", F.col("blocks.block").alias("of")).groupBy("host", F.xxhash64("of").alias("print")).agg(F.first("of").alias("of")), "once")
    sizes = once.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= REPEATS)
    often = once.select("host", F.explode("of").alias("block")).groupBy("host", "block").agg(F.count("*").alias("c")).where(F.col("c") >= REPEATS)
    fixed = tmp.write(often.join(sizes, "host").where(10 * F.col("c") >= F.col("pages")).select("host", "block", F.lit(True).alias("fixed")), "fixed")
    rows = tmp.write(read.select("row", "host", F.explode("blocks").alias("b")).select("row", "host", "b.*"), "blocks")
    own_text = rows.join(fixed, ["host", "block"], "left").where("fixed is null")
    sums = own_text.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.col("z")[k]).alias(f"z{k}") for k in each])
    z = F.array(*[F.coalesce(f"z{k}", F.lit(0.0)) for k in each])
    text = read.drop("blocks").join(sums, "row", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int")).withColumn("z", z)
    tempered = _scaled(F.col("z"), F.least(F.col("n"), F.lit(TEMPER)) / F.greatest(F.col("n"), F.lit(1)))
    text = text.withColumn("z", tempered).withColumn("z", F.transform("z", lambda v: F.exp(v - F.array_max("z")))).withColumn("t", _scaled(F.col("z"), 1 / _total(F.col("z"))))
    parts_ = F.split("host", r"\.")
    text = text.withColumn("domain", F.array_join(F.slice(parts_, -F.least(F.lit(3), F.size(parts_)), F.least(F.lit(3), F.size(parts_))), ".")).withColumn("suffix", F.element_at(parts_, -1))
    text = tmp.write(text.select("page_id", "declared", "host", "domain", "suffix", "segment", "n", "t"), "text")

    common = [r.suffix for r in text.where("suffix <> ''").groupBy("suffix").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "suffix").limit(SUFFIXES).collect()]
    tables = {}
    for col, known in (("declared", langs), ("segment", langs), ("suffix", common)):
        # A code or suffix without an entry of its own counts as one kind with the others.
        value = F.when(F.col(col).isin(["", *known]), F.col(col)).otherwise("?")
        weigh = [F.sum(F.when(F.col("n") > 0, F.col("t")[k]).otherwise(0.0)).alias(f"w{k}") for k in each]
        seen = {r.v: np.array([r[f"w{k}"] for k in each]) + 1.0 for r in text.groupBy(value.alias("v")).agg(*weigh).collect()}  # languages or SUFFIXES rows, and two
        total = sum(seen.values()) if seen else 1.0
        tables[col] = (value, spark.createDataFrame([(v, [float(x) for x in w / total]) for v, w in seen.items()], f"v_{col} string, l_{col} array<double>"))
    own = text
    for col, (value, table) in tables.items():
        own = own.join(F.broadcast(table), value == F.col(f"v_{col}"), "left")  # languages or SUFFIXES rows, and two, are broadcast
    e = F.col("t")
    for col in tables:
        e = _times(e, F.coalesce(f"l_{col}", F.array_repeat(F.lit(1.0), d)))
    own = own.withColumn("e", e).withColumn("e", _scaled(F.col("e"), 1 / F.greatest(_total(F.col("e")), F.lit(1e-300))))
    own = tmp.write(own.select("page_id", "declared", "n", "t", "host", "domain", "suffix", "e"), "own")

    sums = lambda tag, of, n: [F.array(*[F.sum(F.col(of)[k]) for k in each]).alias(f"{tag}"), n.alias(f"{tag}_n")]
    hosts = tmp.write(own.groupBy("host", "domain", "suffix").agg(*sums("h", "e", F.count("*"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums("d", "h", F.sum("h_n")))
    suffixes = hosts.groupBy("suffix").agg(*sums("s", "h", F.sum("h_n")))
    everything = hosts.agg(*sums("g", "h", F.sum("h_n"))).first()  # one row
    total = float(everything.g_n or 0)
    root = F.array(*[F.lit(((everything.g[k] or 0.0) + 1.0) / (total + d)) for k in each])
    tree = tmp.write(hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").drop("domain", "suffix"), "tree")
    met = own.join(tree, "host")
    p = root
    for tag in ("s", "d", "h"):
        rest = F.zip_with(tag, "e", lambda c, v: F.greatest(c - v, F.lit(0.0)))
        p = F.zip_with(rest, p, lambda c, q: c + PULL * q)
        p = _scaled(p, 1 / (F.col(f"{tag}_n") - 1 + PULL))
    post = _times(F.transform("e", lambda v: F.greatest(v, F.lit(1e-12))), p)
    out = met.select("page_id", "host", "declared", "n", "t", post.alias("x")).withColumn("p", _scaled(F.col("x"), 1 / _total(F.col("x"))))
    best = lambda c: F.get(F.array(*[F.lit(v) for v in langs]), F.array_position(c, F.array_max(c)).cast("int") - 1)
    return out.select("page_id", "host", "declared", F.when(F.col("n") > 0, best(F.col("t"))).alias("text_lang"), best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), *[F.col("p")[k].alias(f"p_{v}") for k, v in enumerate(langs)])
