"""Results and meshes as Parquet, meshes as text, and bulk reading of result archives."""

from __future__ import annotations

import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def save_results(runs: DataFrame, fields: DataFrame, path: str, points: DataFrame | None = None, cells: DataFrame | None = None) -> None:
    """``runs`` and, by run and field, ``fields``; overwrites only the partitions it writes."""
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    fields.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "field").parquet(f"{path}/fields")
    for name, df in (("points", points), ("cells", cells)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str, table: str = "fields") -> DataFrame:
    """One of the saved tables; filters on run_id and field prune partitions.

    ``runs`` come with ``metadata`` parsed to a map of texts (null where it is no
    JSON object).
    """
    out = spark.read.parquet(f"{path}/{table}")
    if table == "runs" and "metadata" in out.columns and dict(out.dtypes)["metadata"] == "string":
        out = out.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    return out


def save_mesh(points: DataFrame, cells: DataFrame | None, path: str) -> None:
    """A mesh, or a cloud of points alone."""
    points.write.mode("overwrite").parquet(f"{path}/points")
    if cells is not None:
        cells.write.mode("overwrite").partitionBy("cell_type").parquet(f"{path}/cells")


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Points and cells (filters on cell_type prune partitions), or None for a cloud."""
    points = spark.read.parquet(f"{path}/points")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells")
    held = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return points, spark.read.parquet(f"{path}/cells") if held else None


def read_mesh_text(spark: SparkSession, points: str, cells: str | None = None, kind: str = "csv") -> tuple[DataFrame, DataFrame | None]:
    """A mesh from text files: ``points`` and ``cells`` are paths or globs, ``kind`` is csv (with a header) or json (a row a line).

    Columns are those of the mesh tables, in any order; others are passed over.
    CSV holds node ids as one text with blanks between them, JSON as a list.  A missing ``mesh``
    is mesh 0 and a missing or empty coordinate is 0; a cell without nodes has an
    empty list.  A value that is no number raises when it is read.  Without
    ``cells`` it is a cloud of points.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"kind of mesh text is csv or json, not {kind!r}")

    def rows(path: str, names: tuple[str, ...]) -> DataFrame:
        if kind == "json":
            wanted = ", ".join(f"{c} {'array<bigint>' if c == 'nodes' else 'string'}" for c in names)
            return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
        df = spark.read.option("header", True).csv(path)  # all text: types are not inferred, which would read the files twice
        return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])

    def number(c: str, to: str, missing: float | int | None = None):
        text = F.nullif(F.trim(c), F.lit(""))
        return (text.cast(to) if missing is None else F.coalesce(text.cast(to), F.lit(missing).cast(to))).alias(c)

    p = rows(points, ("mesh", "point_id", "x", "y", "z"))
    p = p.select(number("mesh", "long", 0), number("point_id", "long"), *[number(c, "double", 0.0) for c in "xyz"])
    if cells is None:
        return p, None
    c = rows(cells, ("mesh", "cell_id", "cell_type", "nodes"))
    listed = F.col("nodes") if kind == "json" else F.filter(F.split(F.trim("nodes"), r"\s+"), lambda v: v != "")
    nodes = F.coalesce(listed.cast("array<bigint>"), F.array().cast("array<bigint>"))
    return p, c.select(number("mesh", "long", 0), number("cell_id", "long"), "cell_type", nodes.alias("nodes"))


#: Member of an archive (``field_<name>_values`` and so on) and the kind its rows get.
_MEMBERS = (("field_", "_values", "value"), ("field_", "_points", "point"), ("mesh_points", "", "mesh_point"), ("mesh_cells", "", "mesh_cell"))


_NPZ = "run_id string, kind string, field string, row long, component int, value double, text string"
#: Bytes of an archive's member that one task reads.
NPZ_BYTES = 32 << 20


def _known(member: str) -> tuple[str, str | None] | None:
    """Kind and field of a member; None for one that is passed over."""
    if member == "metadata":
        return "metadata", None
    for head, tail, kind in _MEMBERS:
        if member.startswith(head) and member.endswith(tail) and (tail or member == head):
            return kind, member[len(head) : -len(tail)] if tail else None
    return None


def _npz_rows(run_id: str, kind: str, field: str | None, a: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Rows of a member, or of its rows from ``first`` on."""
    text = None
    if kind == "metadata":
        text = a.tobytes().decode("utf-8", "replace") if a.dtype.kind in "SV" or a.dtype == np.uint8 else str(a) if a.dtype.kind == "U" else None
        row, component, value = [0], [0], pa.array([None], pa.float64())
    else:
        v = np.asarray(a, float)
        v = v.reshape(len(v), -1) if v.ndim else v.reshape(1, 1)
        i, c = np.indices(v.shape)
        row, component, value = i.ravel() + first, c.ravel(), pa.array(v.ravel())
    n = len(row)
    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int64)))
    return pa.RecordBatch.from_arrays([same(run_id), same(kind), same(field), pa.array(row, pa.int64()), pa.array(component, pa.int32()), value, same(text)], names=["run_id", "kind", "field", "row", "component", "value", "text"])


class NpzRange(InputPartition):
    """Rows ``lo`` to ``hi`` of a member of an archive; the whole member where ``hi`` is None."""

    def __init__(self, path: str, member: str, lo: int = 0, hi: int | None = None):
        self.path, self.member, self.lo, self.hi = path, member, lo, hi


def _header(stream) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)


class NpzReader(DataSourceReader):
    def __init__(self, glob: str, size: int):
        self.glob, self.size = glob, size

    def partitions(self) -> list[NpzRange]:
        """Ranges of rows over the members of all archives; only directories and array headers are read here."""
        fs, at = pafs.FileSystem.from_uri(self.glob.split("*")[0].rpartition("/")[0] if "*" in self.glob else self.glob)
        own = fs.get_file_info(at)
        if own.type == pafs.FileType.File:
            found = [own]
        else:
            wanted = self.glob.rpartition("/")[2] if "*" in self.glob else "*.npz"
            found = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, wanted)]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                for name in z.namelist():
                    member = name.removesuffix(".npy")
                    if not _known(member):
                        continue
                    with z.open(name) as stream:
                        shape, fortran, kind = _header(stream)
                    if kind.hasobject:
                        raise ValueError(f"{f.path} holds pickled objects in {member}")
                    each = max(1, int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize)
                    n = max(1, self.size // each)
                    if not shape or fortran or member == "metadata" or shape[0] <= n:
                        out.append(NpzRange(f.path, name))
                    else:
                        out += [NpzRange(f.path, name, lo, min(lo + n, shape[0])) for lo in range(0, shape[0], n)]
        return out

    def read(self, partition: NpzRange) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.glob.split("*")[0])
        run_id, member = partition.path.rpartition("/")[2].removesuffix(".npz"), partition.member.removesuffix(".npy")
        kind, field = _known(member)
        with fs.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as z, z.open(partition.member) as stream:
            if partition.hi is None:
                yield _npz_rows(run_id, kind, field, np.lib.format.read_array(stream, allow_pickle=False))
                return
            shape, _, dtype = _header(stream)
            each = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
            stream.seek(partition.lo * each, io.SEEK_CUR)  # a jump in a stored member; a compressed one is read up to here
            step = max(1, (1 << 20) // each)
            for lo in range(partition.lo, partition.hi, step):
                n = min(step, partition.hi - lo)
                yield _npz_rows(run_id, kind, field, np.frombuffer(stream.read(n * each), dtype).reshape(n, *shape[1:]), lo)


class NpzSource(DataSource):
    """Spark data source ``npz`` over a folder, a file or a pattern of archives; option ``bytes``: size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return _NPZ

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], int(self.options.get("bytes", NPZ_BYTES)))


def read_npz(spark: SparkSession, glob: str, size: int = NPZ_BYTES) -> DataFrame:
    """``run_id, kind, field, row, component, value, text`` of every known member of a folder of archives.

    Kinds are value, point (of a field), mesh_point, mesh_cell (node ids) and
    metadata (JSON in ``text``).  Pickled members are refused; unknown ones are
    passed over.  Members are cut into ranges of rows of about ``size`` bytes, so
    one archive is read by many tasks; a member in column order is one range.
    Stores that only Spark opens are read an archive a task, 2 GB at most each.
    """
    try:
        pafs.FileSystem.from_uri(glob.split("*")[0])
    except (pa.ArrowException, OSError, ValueError):
        return _whole_archives(spark, glob)
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("bytes", size).load(glob)


def _whole_archives(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content")):
                run_id = path.rsplit("/", 1)[-1].removesuffix(".npz")
                with np.load(io.BytesIO(raw.as_buffer()), allow_pickle=False) as z:
                    for key in z.files:
                        if known := _known(key):
                            yield _npz_rows(run_id, *known, z[key])

    return files.mapInArrow(run, _NPZ)


def read_npz_results(spark: SparkSession, glob: str) -> DataFrame:
    """``run_id, field, point_id, component, value`` of the archives' fields."""
    return read_npz(spark, glob).where("kind = 'value'").select("run_id", "field", F.col("row").alias("point_id"), "component", "value")


def metadata_json(metadata: dict) -> str:
    return json.dumps(metadata, sort_keys=True)
