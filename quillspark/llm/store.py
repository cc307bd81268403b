"""Shared storage: lineage cuts, and files that tasks write themselves and a manifest commits.

Everything lives under ``spark.checkpoint.dir``, which all executors and the driver share.
"""

from __future__ import annotations

import contextlib
import posixpath
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row for each file that a task has finished; ``info`` is the writer's own JSON.
FILES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("staged", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("info", T.StringType()),
    ]
)
FILES_ARROW = pa.schema(
    [("name", pa.string()), ("staged", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("info", pa.string())]
)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_quillspark_dir", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="quillspark-")
            spark._quillspark_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: At the end of a query Spark deletes what it has shuffled.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor recomputes nothing before it.

    What the write has shuffled goes with its end, rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


class _Written(threading.local):
    """Folders that ``cut`` has written in this thread and ``drop_since`` has not deleted, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def written() -> int:
    """A mark for ``drop_since``."""
    return len(_WRITTEN.paths)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete what ``cut`` has written since a mark, but for the tables of it in ``keep``; for when nothing reads it any more."""
    kept = {table._quillspark_path for table in keep}
    gone = [path for path in _WRITTEN.paths[mark:] if path not in kept]
    _WRITTEN.paths[mark:] = [path for path in _WRITTEN.paths[mark:] if path in kept]
    for path in gone:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    return pafs.FileSystem.from_uri(uri)


class StagedFile:
    """A file under ``root/_staged/<attempt>/``; another attempt of the same task has another folder."""

    def __init__(self, root: str, attempt: str, name: str):
        self.name, self.staged = name, f"{root}/_staged/{attempt}/{name}"
        fs, path = open_fs(self.staged)
        fs.create_dir(posixpath.dirname(path), recursive=True)
        self._out = fs.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def commit(files: DataFrame, root: str) -> DataFrame:
    """Give the finished files of ``files`` (schema FILES) their last names; return the manifest, in name order.

    The rows are written first, so exactly one attempt of each task counts however often it ran. Renaming is a Spark
    job and may be repeated: a file that already has its last name is left. The manifest is written last, under its
    own temporary name; a folder without it is not committed. What lost attempts staged is then deleted.
    """
    spark = files.sparkSession
    files = cut(files, "staged-files")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, staged in zip(batch.column("name").to_pylist(), batch.column("staged").to_pylist(), strict=True):
                fs, old = open_fs(staged)
                new = open_fs(f"{root}/{name}")[1]
                if fs.get_file_info(new).type == pafs.FileType.NotFound:
                    fs.move(old, new)
            yield batch

    moved = files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(rename, FILES)
    moved.write.mode("overwrite").parquet(f"{root}/_manifest.tmp")
    fs, old = open_fs(f"{root}/_manifest.tmp")
    new = open_fs(f"{root}/manifest")[1]
    fs.move(old, new)
    staged = open_fs(f"{root}/_staged")[1]
    if fs.get_file_info(staged).type == pafs.FileType.Directory:
        fs.delete_dir(staged)
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed files of a folder."""
    return spark.read.schema(FILES).parquet(f"{root}/manifest")


def spread_files(manifest: DataFrame, root: str) -> DataFrame:
    """Files dealt out by name, about one to a task."""
    paths = manifest.select("name", F.concat(F.lit(f"{root}/"), "name").alias("path"), "records", "bytes", "info")
    tasks = max(1, min(paths.count(), 20_000))
    return paths.repartitionByRange(tasks, "name")
