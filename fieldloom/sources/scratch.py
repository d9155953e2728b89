"""Intermediate tables that outlive a lost executor.

Iterative jobs cut their lineage by writing a table below the folder that the
cluster names in ``spark.checkpoint.dir`` and reading it back.  Unlike a local
checkpoint such a table is visible to every executor, keeps its column layout
(so later reads prune columns) and can be joined on both sides of a splittable
exchange.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` wins.  Only where it is unset and
    driver and executors are one process, as in tests, a local folder is made
    and set for this session; on a cluster that is an error, since executors
    would write to disks of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fieldloom.scratch", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("fieldloom.scratch", at)
    return at.rstrip("/")


_roots: list[str] = []
_tables: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver; results that still read them must be written first."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _roots:
        p = spark._jvm.org.apache.hadoop.fs.Path(_roots.pop())
        p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Tables of one job run; ``drop`` frees those that a later round replaced."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        _roots.append(self.root)
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise ``df`` and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, key: str, n: int, placed: bool = False, group: int = 128 << 20) -> DataFrame:
        """``df`` written in ``n`` buckets of ``key``: joins by the key read it in place and shuffle the other side alone.

        ``placed`` tells that it comes from ``repartition(n, key)`` already.  A scan
        holds a row group, of about ``group`` bytes and 100 rows at least.
        """
        self._n += 1
        path, known = f"{self.root}/{self._n:03d}-{name}", f"fieldloom_{uuid.uuid4().hex}"
        (df if placed else df.repartition(n, key)).write.option("compression", "zstd").option("parquet.block.size", group).option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(known)
        _tables.append(known)
        out = self.spark.table(known)
        out._scratch_path, out._scratch_table = path, known
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for t in tables:
            known = getattr(t, "_scratch_table", None)
            if known:
                self.spark.sql(f"DROP TABLE IF EXISTS {known}")
                _tables.remove(known)
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
