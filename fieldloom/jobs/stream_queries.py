"""Registered queries on streams and archives, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.jobs.tables import rounded, table
from fieldloom.sources import io as IO
from fieldloom.sources.scratch import Scratch
from fieldloom.streaming import incremental as I

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _files(tmp: Scratch, df: DataFrame, n: int, by, name: str) -> str:
    """``df`` as files that a stream reads one after another; ``by`` deals its rows to ``n`` of them."""
    path = f"{tmp.root}/{name}"
    for k in range(n):
        df.where(by == k).coalesce(1).write.mode("append").parquet(path)
    return path


def _run(tmp: Scratch, stream: DataFrame, mode: str, path: str, update) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp.root}/{path}").foreachBatch(update).trigger(availableNow=True).start()
    q.awaitTermination()


@query(
    "stream_dmd",
    """WITH RECURSIVE ev AS (SELECT event_id % 16 AS r, event_id // 16 AS k, ln(1 + coalesce(value, 0)) AS x, (user_id % 7) / 7.0::DOUBLE AS y FROM events),
 rec AS (SELECT r, k, x, y, 1::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, 1::DOUBLE AS d, 1000::DOUBLE AS p, 0::DOUBLE AS q, 1000::DOUBLE AS s FROM ev WHERE k = 0
 UNION ALL SELECT r, k, nx, ny, a + (nx - a * x - b * y) * g, b + (nx - a * x - b * y) * h, c + (ny - c * x - d * y) * g, d + (ny - c * x - d * y) * h, (p - g * u) / 0.99, (q - g * v) / 0.99, (s - h * v) / 0.99
  FROM (SELECT rec.*, ev.k AS nk, ev.x AS nx, ev.y AS ny, p * rec.x + q * rec.y AS u, q * rec.x + s * rec.y AS v, (p * rec.x + q * rec.y) / (0.99 + rec.x * (p * rec.x + q * rec.y) + rec.y * (q * rec.x + s * rec.y)) AS g, (q * rec.x + s * rec.y) / (0.99 + rec.x * (p * rec.x + q * rec.y) + rec.y * (q * rec.x + s * rec.y)) AS h FROM rec JOIN ev ON ev.r = rec.r AND ev.k = rec.k + 1) z(r, k0, x, y, a, b, c, d, p, q, s, k, nx, ny, u, v, g, h))
 SELECT r::VARCHAR AS run_id, k AS step, 0::BIGINT AS late, 0::BIGINT AS waiting, round(a, 5) + 0.0 AS a11, round(b, 5) + 0.0 AS a12, round(c, 5) + 0.0 AS a21, round(d, 5) + 0.0 AS a22, round(a + d, 5) + 0.0 AS trace, round(a * d - b * c, 5) + 0.0 AS determinant FROM rec QUALIFY k = max(k) OVER (PARTITION BY r)""",
)
def stream_dmd(spark, sf_dir):
    """Recursion over sixteen runs of the events, which arrive shuffled in four files; equal to the recursion in order.

    Trace and determinant are the sum and the product of the eigenvalues that the stream gives.
    """
    tmp = Scratch(spark, "stream_dmd")
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("run_id"), F.floor(F.col("event_id") / 16).alias("step"), F.array(F.log1p(F.coalesce("value", F.lit(0.0))), (F.col("user_id") % 7) / 7.0).alias("x"), F.col("ts").cast("timestamp").alias("ts"))
    path, seen = _files(tmp, e, 4, F.pmod(F.xxhash64("run_id", "step"), F.lit(4)), "events"), []
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with I.rocksdb(spark):
        _run(tmp, I.streaming_dmd(stream, 2, 0.99, "ts", "400 days"), "update", "checkpoint", lambda b, n: seen.append(tmp.write(b, f"batch{n}")._scratch_path))
    every = spark.read.parquet(*seen)
    last = every.groupBy("run_id").agg(F.max_by(F.struct("late", "waiting", "re", "im", "operator"), "step").alias("m"), F.max("step").alias("step")).select("run_id", "step", "m.*")
    re, im = F.col("re"), F.col("im")
    return rounded(last.select("run_id", "step", "late", "waiting", *[F.col("operator")[k].alias(n) for k, n in enumerate(("a11", "a12", "a21", "a22"))], (re[0] + re[1]).alias("trace"), (re[0] * re[1] - im[0] * im[1]).alias("determinant")), 5)


@query(
    "stream_adaptive_pod",
    """WITH s AS (SELECT vec_id AS dof, embedding[1]::DOUBLE AS s0, embedding[2]::DOUBLE AS s1, embedding[3]::DOUBLE AS s2, embedding[4]::DOUBLE AS s3 FROM embeddings), c AS (SELECT dof, (s0 + s1 + s2 + s3) / 4 AS mean, (s1 - s0) / 2 AS c1, s2 - (s0 + s1 + s2) / 3 AS c2, s3 - (s0 + s1 + s2 + s3) / 4 AS c3 FROM s),
 one AS (SELECT *, c1 / sqrt(sum(c1 * c1) OVER ()) AS f1 FROM c), r2 AS (SELECT *, c2 - f1 * sum(c2 * f1) OVER () AS r FROM one), two AS (SELECT *, r / sqrt(sum(r * r) OVER ()) AS f2 FROM r2), r3 AS (SELECT *, c3 - f1 * sum(c3 * f1) OVER () - f2 * sum(c3 * f2) OVER () AS t FROM two)
 SELECT dof, round(mean, 6) + 0.0 AS mean, round(f1, 6) + 0.0 AS phi1, round(f2, 6) + 0.0 AS phi2, round(t / sqrt(sum(t * t) OVER ()), 6) + 0.0 AS phi3 FROM r3""",
)
def stream_adaptive_pod(spark, sf_dir):
    """A basis that grows over four snapshots of all vectors, two of them a batch."""
    tmp = Scratch(spark, "stream_pod")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dof"), F.posexplode(F.slice("embedding", 1, 4)).alias("step", "value"))
    e = e.select("dof", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    path, pod = _files(tmp, e, 2, F.floor(F.col("step") / 2), "snapshots"), I.AdaptivePod(spark, 1e-4, 8)
    _run(tmp, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path), "append", "checkpoint", pod.update)
    return rounded(pod.basis.select("dof", "mean", *[F.col("phi")[k].alias(f"phi{k + 1}") for k in range(3)]))


def observations(spark, sf_dir):
    """Suppliers as observations of a value in the plane, in four batches, and parts as candidates."""
    see = table(spark, sf_dir, "supplier").select(F.array((F.col("s_suppkey") % 17) / 4.0, F.col("s_nationkey") / 6.0).alias("p"), (F.col("s_acctbal") / 5_000.0).alias("y"), F.pmod(F.col("s_suppkey"), F.lit(4)).alias("batch"))
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 12.0, (F.col("p_partkey") % 101) / 25.0).alias("p"))
    return see, candidates


@query("stream_observation_loop")
def stream_observation_loop(spark, sf_dir):
    """Three parts to look at after each batch of suppliers (a process has no SQL; tests refit it in full after each batch)."""
    tmp = Scratch(spark, "stream_loop")
    see, candidates = observations(spark, sf_dir)
    path = _files(tmp, see, 4, F.col("batch"), "seen")
    loop = I.ObservationLoop(tmp.write(candidates, "candidates"), k=3, length=0.8, noise=1e-2, max_train=512)
    _run(tmp, spark.readStream.schema(see.schema).option("maxFilesPerTrigger", 1).parquet(path), "append", "checkpoint", loop.update)
    rows = [(b, k, int(i)) for b, chosen in enumerate(loop.chosen) for k, i in enumerate(chosen)]
    return spark.createDataFrame(rows, "batch int, rank int, id long")


@query(
    "source_archives",
    "WITH e AS (SELECT event_id // 4000 AS b, row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) - 1 AS point_id, value, user_id FROM events) SELECT 'block' || b AS run_id, 'amount' AS field, point_id, 0 AS component, value FROM e UNION ALL SELECT 'block' || b, 'pair', point_id, c::INT, CASE c WHEN 0 THEN user_id::DOUBLE ELSE value * 2 END FROM e, (SELECT unnest([0, 1]) AS c)",
)
def source_archives(spark, sf_dir):
    """Events written as archives of 4,000 rows, one field stored and compressed in turn, and read in ranges of 16 KB."""
    import io

    import numpy as np
    import pyarrow as pa
    import pyarrow.fs as pafs

    tmp = Scratch(spark, "archives")
    root = tmp.write(spark.range(1), "folder")._scratch_path  # makes the folder

    def write(key, tab):
        order = np.argsort(np.asarray(tab.column("event_id")))
        value, user = (np.asarray(tab.column(c).combine_chunks(), np.float64)[order] for c in ("value", "user_id"))
        buf = io.BytesIO()
        (np.savez if key[0].as_py() % 2 else np.savez_compressed)(buf, field_amount_values=value, field_pair_values=np.c_[user, value * 2])
        fs, at = pafs.FileSystem.from_uri(root)
        with fs.open_output_stream(f"{at}/block{key[0].as_py()}.npz") as f:
            f.write(buf.getvalue())
        return pa.table({"n": [len(order)]})

    table(spark, sf_dir, "events").select("event_id", "value", "user_id", F.floor(F.col("event_id") / 4000).alias("b")).groupBy("b").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return IO.read_npz(spark, root, 16 << 10).where("kind = 'value'").select("run_id", "field", F.col("row").alias("point_id"), "component", "value")
