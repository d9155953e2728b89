"""The llm queries over the given tables; ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Models, token ids and pseudonyms are beyond SQL; tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_vector_graph_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9), n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
 r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id""",
    "op4_benchmark_decontamination": f"""WITH cut AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), item AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS t, least(13, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM item WHERE len(w) > 0)),
 pos AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM cut, (SELECT DISTINCT n FROM win))),
 hit AS (SELECT doc_id, k, pos.n, item_id FROM pos JOIN win ON win.t = pos.t AND win.n = pos.n), words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
 SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated FROM cut LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_minhash_near_dedup": f"""WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s, least(4, len(w)) AS size FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM cut WHERE len(w) > 0)), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.size = b.size AND a.doc_id <> b.doc_id GROUP BY 1, 2), p AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.a = doc_id""",
}


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op4_benchmark_decontamination"] = op4_benchmark_decontamination


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


QUERIES["op6_best_fit_packing"] = op6_best_fit_packing


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.pii import pseudonyms, session_key

    return pseudonyms(_table(spark, sf_dir, "documents"), session_key(spark))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES |= {"op2_pii_pseudonyms": op2_pii_pseudonyms, "op3_quality_gam": op3_quality_gam}


def op7_subword_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.lattice import text_scores

    return text_scores(_table(spark, sf_dir, "documents"))


QUERIES["op7_subword_lattice_scores"] = op7_subword_lattice_scores


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.language import identify

    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


QUERIES |= {"op5_toxicity_chain": op5_toxicity_chain, "op8_language_fusion": op8_language_fusion}


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


QUERIES["op9_secret_forest"] = op9_secret_forest


def op1_vector_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.vectors import vector_links

    return vector_links(_table(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES["op1_vector_graph_dedup"] = op1_vector_graph_dedup


def op11_no_random_access_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.topk import vector_top_k

    return vector_top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.variants import variants

    return variants(_table(spark, sf_dir, "documents"))


def op13_vector_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES |= {"op11_no_random_access_top_k": op11_no_random_access_top_k, "op12_spelling_variants": op12_spelling_variants, "op13_vector_whitening": op13_vector_whitening}
#: crc32 of UTF-8 bytes by its table, which follows from the reversed polynomial.
_CRC = "(WITH RECURSIVE t(i, k, c) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM t WHERE k < 8) SELECT list(c ORDER BY i) FROM t WHERE k = 8)"
ORACLE_SQL |= {
    "op11_no_random_access_top_k": """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op12_spelling_variants": f"""WITH RECURSIVE run AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
 hex AS (SELECT w, n, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM run), crc AS MATERIALIZED (SELECT {_CRC} AS t),
 cut AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT FOR i IN range(len(x) // 2)]), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM hex, crc),
 word AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, n FROM cut) GROUP BY word HAVING len(word) >= 5 AND sum(n) >= 3),
 less AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS v FROM (SELECT word, n, unnest(range(len(word))) AS k FROM word)),
 near AS (SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.v = b.v AND a.k = b.k AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.v = b.word),
 best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near GROUP BY a),
 told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM word LEFT JOIN best USING (word)),
 up(word, root) AS (SELECT word, word FROM told UNION ALL SELECT up.word, told.form FROM up JOIN told ON told.word = up.root WHERE told.form IS NOT NULL), last AS (SELECT up.word, up.root FROM up JOIN told ON told.word = up.root WHERE told.form IS NULL)
 SELECT word, form, root, n, n_near, form_n FROM told JOIN last USING (word)""",
}
