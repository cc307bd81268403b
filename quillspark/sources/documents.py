"""Reading documents and pages, and keeping chunks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X

CHUNK = "id string, text string, source_doc string, section string, position int, has_code boolean"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; under a folder of our own where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quillspark_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark._quillspark_scratch = tempfile.mkdtemp(prefix="quillspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever file system Spark reads it from; a path where nothing is is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def read_documents(spark: SparkSession, paths: str | list[str], pattern: str = "*.md") -> DataFrame:
    """path and content (text) of files: a folder with a pattern, searched deeply, or files by name.

    A source that is missing is an error. Rows have no order; ``path`` gives one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if isinstance(paths, str) and is_folder(spark, paths):
        files = files.option("pathGlobFilter", pattern)
    return files.load(paths).select("path", X.decode_text(F.col("content")).alias("content"))


def spread(rows: DataFrame, *, task_bytes: int = 128 << 20) -> DataFrame:
    """Rows of a small table, which its files may not split, dealt out over all cores; a table of ``task_bytes`` a core or more stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # as the files say; nothing runs
    return rows.repartition(cores) if size < cores * task_bytes else rows


def pages_source(pages: DataFrame) -> DataFrame:
    """path and content of pages (url, html) whose url is one of the web."""
    return pages.where(F.col("url").rlike("^https?://")).select(F.col("url").alias("path"), F.col("html").alias("content"))


def drop_blank_documents(documents: DataFrame) -> DataFrame:
    """Documents whose content is more than white space."""
    return documents.where(~X.is_blank(F.col("content")))


def isolate_failures(documents: DataFrame) -> DataFrame:
    """Add error: why a document can't be chunked, or null. The batch goes on without it."""
    content = F.col("content")
    return documents.withColumn("error", F.when(content.isNull(), "no content").when(X.is_blank(content), "blank content"))


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    chunks.select(*[f.strip().split()[0] for f in CHUNK.split(",")]).write.mode(mode).json(path)


def read_chunks(spark: SparkSession, path: str, *, array_file: bool = False) -> DataFrame:
    """Chunks as written; ``array_file`` reads one JSON array of them a file."""
    return spark.read.schema(CHUNK).option("multiLine", array_file).json(path)


def write_tutorials(tutorials: DataFrame, path: str) -> None:
    """One file a slug (slug, markdown, seq), ended by a newline; of equal slugs the last by seq stays."""
    latest = tutorials.groupBy("slug").agg(F.max_by("markdown", "seq").alias("value"))
    latest.write.mode("overwrite").partitionBy("slug").text(path)
