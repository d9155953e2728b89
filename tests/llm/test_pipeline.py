"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

import corpus_pipeline

from tests.llm.test_ops import DOC, clashing, corpus, edge_docs, near_truth, words



def tables(tmp_path, spark):
    rng = random.Random(9)
    bench = [(i, " ".join(words(rng, 20))) for i in range(5)]
    docs = corpus(120, seed=11)
    docs += [(200 + i, f"{bench[i][1]} {' '.join(words(rng, 30))}", "en", "s", 1) for i in range(5)]
    docs += [(300 + i, " ".join(x.upper() + "!!%%" for x in words(rng, 60)), "en", "s", 1) for i in range(40)]
    docs += [(400, "mail me at some.body@mail.example.com or 70.23.22.57 " + " ".join(words(rng, 40)), "en", "s", 1)]
    docs += [(r[0] + 5000, *r[1:]) if r[0] is not None else r for r in edge_docs()]
    labels = [(i, int(i < 300 or i >= 400), 0) for i, *_ in docs if i is not None]
    d = str(tmp_path)
    clashing(spark.createDataFrame(docs, DOC)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages(spark, tmp_path):
    d, rows = tables(tmp_path, spark)
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{d}/out{k}"
        stage(spark, docs, d).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and {r["n_words"] for r in docs.collect()} == {"kept"}
    good = {r.doc_id for r in seen["quality"].collect()}
    assert not {300 + i for i in range(40)} & good and len(good) > 110
    kept = [(r.doc_id, r.text) for r in seen["quality"].collect() if r.doc_id is not None]
    _, comp = near_truth(kept, 5)
    want = {i for i, _ in kept if comp[i] == i}
    assert {r.doc_id for r in seen["near_dedup"].collect() if r.doc_id is not None} == want
    clean = {r.doc_id for r in seen["decontamination"].collect() if r.doc_id is not None}
    assert clean == want - {200 + i for i in range(5)}
    private = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert "70.23.22.57" not in private[400] and "some.body@" not in private[400]
    packed = {r.doc_id for r in seen["packing"].collect()}
    assert packed == set(private)
    run = corpus_pipeline.run(spark, d)
    assert run.count() == seen["packing"].count()


def test_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
