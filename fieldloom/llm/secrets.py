"""Secret findings with a random forest against false positives, in DataFrame functions alone.

Texts with a candidate are cut at white space.  Candidates are suspicious runs
(sixteen or more token characters with a digit, or all capitals) and, whatever
its length (four characters at least) and characters, the value that is assigned
to a credential word (``password = hunter2``, ``token: x!y``).  Each is a finding
with its place and neighbouring words.  Its features are length, shares of
character kinds, runs of one kind, the mean log probability of its character
transitions, the share of it that words of the corpus cover, path marks around
it, and credential words before it.  Transition probabilities and the dictionary
are counted over the whole corpus.  A random forest learned from labelled
findings gives each finding the probability of being a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.quality import held_out
from fieldloom.llm.text import bounded_sample
from fieldloom.sources.scratch import Scratch

TOKEN = r"[A-Za-z0-9_+/\-]{16,}"
SUSPICIOUS = r"(?:(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}|(?<![A-Za-z0-9_+/\-])[A-Z0-9]{16,})"
#: Words that announce a credential (fixed values).
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|bearer|credential)"
_SIGN = r"[\"']?(?:[:=]|=>|:=)"
#: A credential word, an assignment sign and the value, within one word or over up to three.
ASSIGNED = rf"{CREDENTIAL}[A-Za-z0-9_\-]{{0,24}}\s{{0,3}}{_SIGN}\s{{0,3}}[\"']?[^\s\"']{{4,}}"
_VALUE = r"[\"']?([^\s\"',;]{4,})"
#: Shapes of tokens that providers issue (fixed values).
PROVIDER = r"^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10,})$"
FEATURES = ["length", "digits", "upper", "hexes", "runs", "kinds", "transitions", "coverage", "path", "slashes", "credential_near", "assigned", "quoted", "word_before"]
#: Rows of training at most, and occurrences that make a word part of the dictionary.
MAX_TRAIN, LEAST_COUNT, TREES, DEPTH = 50_000, 3, 24, 6


def findings(docs: DataFrame) -> DataFrame:
    """``doc_id, place, nth, token, word, before, after`` of each candidate.

    ``place`` is the index of the word that holds it, ``nth`` its number there.
    Null and empty texts have none; repeated rows repeat theirs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(SUSPICIOUS) | F.col("text").rlike(ASSIGNED))
    words = texts.select("doc_id", F.split("text", r"\s+").alias("w"))
    w = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    credential = lambda c: c.rlike(rf"{CREDENTIAL}[A-Za-z0-9_\-]{{0,24}}{_SIGN}$")
    inside = lambda i: w(i).rlike(rf"{CREDENTIAL}[A-Za-z0-9_\-]{{0,24}}{_SIGN}{_VALUE}")
    follows = lambda i: w(i).rlike(f"^{_VALUE}") & (credential(w(i - 1)) | (w(i - 1).rlike(f"^{_SIGN}$") & w(i - 2).rlike(rf"{CREDENTIAL}[A-Za-z0-9_\-]{{0,24}}[\"']?$")))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: w(i).rlike(SUSPICIOUS) | inside(i) | follows(i))
    hit = F.transform(at, lambda i: F.struct(i.alias("place"), w(i).alias("word"), F.concat_ws(" ", F.get("w", i - 3), F.get("w", i - 2), F.get("w", i - 1)).alias("before"), w(i + 1).alias("after"), inside(i).alias("inside"), follows(i).alias("follows")))
    rows = words.select("doc_id", F.explode(hit).alias("h")).select("doc_id", "h.*")
    tokens = F.filter(F.regexp_extract_all("word", F.lit(f"({TOKEN})"), 1), lambda t: t.rlike(SUSPICIOUS))
    value = F.when(F.col("inside"), F.regexp_extract("word", rf"{_SIGN}{_VALUE}", 1)).when(F.col("follows"), F.regexp_extract("word", f"^{_VALUE}", 1))
    # An assigned value that is or holds a suspicious run is that run.
    found = F.when(F.size(tokens) > 0, tokens).when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "place", "word", "before", "after", F.posexplode(found).alias("nth", "token"))


def dictionary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Lower-case words of four to twenty letters that stand alone, and their counts, over all texts.

    Letters inside a longer token (a digest, a path) are no word.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^a-z0-9_+/\-]+")).alias("piece"))
    return words.where(F.length("piece").between(4, 20) & F.col("piece").rlike("^[a-z]+$")).groupBy("piece").agg(F.count("*").alias("c")).where(F.col("c") >= least)


def _transitions(words: DataFrame) -> DataFrame:
    """Log probability of the second of two letters or digits, smoothed; 1296 rows at most."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("piece") - 1), lambda i: F.substr("piece", i, F.lit(2)))).alias("two"), "c")
    counts = pairs.groupBy("two").agg(F.sum("c").alias("c"))
    first = counts.groupBy(F.substring("two", 1, 1).alias("one")).agg(F.sum("c").alias("n"))
    return counts.withColumn("one", F.substring("two", 1, 1)).join(F.broadcast(first), "one").select("two", F.log((F.col("c") + 1.0) / (F.col("n") + 36.0)).alias("logp"))


def _share(token: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(token, f"[^{pattern}]", "")) / F.length(token)


def describe(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Findings with their features, one row each."""
    found = scratch.write(found.withColumn("key", F.xxhash64("token")), "findings")
    words = scratch.write(dictionary(docs), "dictionary")
    low = F.lower("token")
    distinct = scratch.write(found.groupBy("key").agg(F.min("token").alias("token")), "tokens")
    two = distinct.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr(low, i, F.lit(2)))).alias("two"))
    moves = two.join(F.broadcast(_transitions(words)), "two", "left").groupBy("key").agg(F.avg(F.coalesce("logp", F.lit(-6.0))).alias("transitions"))
    letters = distinct.select("key", F.explode(F.split(low, r"[^a-z]+")).alias("piece")).where(F.length("piece").between(4, 20))
    covered = letters.join(words.select("piece"), "piece", "left_semi").groupBy("key").agg(F.sum(F.length("piece")).alias("letters"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    facts = scratch.write(
        distinct.join(moves, "key", "left").join(covered, "key", "left").select(
            "key",
            F.length("token").cast("double").alias("length"),
            _share(F.col("token"), "0-9").alias("digits"),
            _share(F.col("token"), "A-Z").alias("upper"),
            _share(F.col("token"), "0-9a-f").alias("hexes"),
            (F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / F.length("token")).alias("runs"),
            F.size(F.array_distinct(F.split(kinds, ""))).cast("double").alias("kinds"),
            F.coalesce("transitions", F.lit(-6.0)).alias("transitions"),
            (F.coalesce("letters", F.lit(0)) / F.length("token")).alias("coverage"),
            _share(F.col("token"), "/+_").alias("slashes"),
        ),
        "facts",
    )
    head = F.expr("substring_index(word, token, 1)")  # what stands before the token in its word
    near = F.concat_ws(" ", "before", head)
    flag = lambda c: c.cast("double")
    return found.join(facts, "key").select(
        *found.columns,
        *[c for c in facts.columns if c != "key"],
        flag(F.col("word").rlike(r"(https?:|www\.|[A-Za-z0-9]/[A-Za-z0-9]|\\|\.(com|org|net|py|js|html)\b)")).alias("path"),
        flag(near.rlike(CREDENTIAL)).alias("credential_near"),
        flag(head.rlike(r"[:=][\"']?$") | ((F.length(head) <= 1) & F.col("before").rlike(r"[:=]$"))).alias("assigned"),
        flag(head.rlike(r"[\"']$") & F.col("word").rlike(r"[\"'][^\"']*$")).alias("quoted"),
        F.coalesce(F.length(F.element_at(F.split("before", " "), -1)).cast("double"), F.lit(0.0)).alias("word_before"),
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Labelled findings for corpora that come without: a provider's shape, or a
    random-looking value assigned to a credential word, is a secret.

    A stand-in: the second rule reads features that the forest has too, so the
    forest learns it back.  Reviewed findings go to ``scan(labelled=...)``.
    """
    random_looking = (F.col("digits") > 0.15) & (F.col("digits") < 1) & (F.col("coverage") < 0.3)
    return found.withColumn("label", (F.col("token").rlike(PROVIDER) | ((F.col("credential_near") == 1) & (F.col("assigned") == 1) & random_looking)).cast("double"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, place, nth, token_sha256, token_length, probability, secret`` of every finding.

    ``labelled(doc_id, place, nth, label)`` holds reviewed findings; without it
    ``rule_labels`` stands in.  Documents whose id has checksum 2 modulo 4 are
    never trained on; at most ``max_train`` findings are.  With one class only,
    its frequency is the probability.  A corpus without findings gives no rows.
    """
    tmp = Scratch(docs.sparkSession, "secrets")
    found = tmp.write(describe(findings(docs), docs, tmp), "described")
    if labelled is None:
        train = rule_labels(found)
    else:
        train = found.join(labelled.select("doc_id", "place", "nth", F.col("label").cast("double").alias("label")), ["doc_id", "place", "nth"])
    train = train.where(~held_out()).select("label", "key", "doc_id", "place", "nth", *FEATURES)
    train = tmp.write(bounded_sample(train, max_train, "doc_id", "place", "nth"), "train")
    n, yes = train.agg(F.count("*"), F.sum("label")).first()
    out = lambda df, p: df.select("doc_id", "place", "nth", F.sha2("token", 256).alias("token_sha256"), F.length("token").alias("token_length"), p.alias("probability")).withColumn("secret", F.col("probability") >= 0.5)
    if not n or yes in (0.0, float(n)):
        return out(found, F.lit(float(yes or 0) / max(1, n)))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(vector.transform(train))
    scored = forest.transform(vector.transform(found))
    return out(scored, F.element_at(vector_to_array("probability"), 2))
