"""Incremental ingestion: new documents become chunks in a keyed store.

A store has ``buckets`` by hash of id. A bucket is a few runs, ``batch=N/bucket=B``, each with the chunks that some
successive batches brought. A batch writes its own chunks of each bucket that it touches, and with them those of the last
runs that are not twice as large: so runs at least halve from the first to the last, a bucket has as many as the logarithm
of its size, and a chunk is written as often, however many batches there are. Then it writes a manifest, which names each
bucket's runs. A reader takes of each id the version of the last batch, so it finds each once; what only older manifests
name is deleted with the next batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunks as C

STORED = "id string, text string, source_doc string, section string, position int, has_code boolean, seq long"
_COLUMNS = [f.strip().split()[0] for f in STORED.split(",")]
_BUCKETS = 16


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the manifests that are whole, ascending; a few at most."""
    fs, path = _fs(spark, f"{store}/manifest")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_fs(spark, f"{store}/manifest/{n}/_SUCCESS")[1]))


def _manifest(spark: SparkSession, store: str, below: int) -> dict[int, list[int]]:
    """The batches that wrote each bucket's runs, ascending, as of the last batch under ``below``."""
    found = [v for v in _versions(spark, store) if v < below]
    if not found:
        return {}
    named: dict[int, list[int]] = {}
    for r in sorted(spark.read.schema("bucket int, batch long").json(f"{store}/manifest/{found[-1]}").collect()):  # a row a run
        named.setdefault(r.bucket, []).append(r.batch)
    return named


def _folder(store: str, bucket: int, batch: int) -> str:
    return f"{store}/batch={batch}/bucket={bucket}"


def _size(spark: SparkSession, folder: str) -> int:
    fs, path = _fs(spark, folder)
    return fs.getContentSummary(path).getLength()


def _read(spark: SparkSession, store: str, named: dict[int, list[int]]) -> DataFrame:
    """All rows of these runs; an id may be in several of them."""
    paths = [_folder(store, bucket, batch) for bucket, batches in sorted(named.items()) for batch in batches]
    return spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)


def _to_merge(sizes: list[int], new: int) -> int:
    """How many runs, of these sizes, stay as they are when a run of size ``new`` comes; the later ones go with it."""
    kept = len(sizes)
    while kept and sizes[kept - 1] < 2 * new:
        kept -= 1
        new += sizes[kept]
    return kept


def merge_batch(chunks: DataFrame, store: str, batch_id: int, *, buckets: int = _BUCKETS) -> None:
    """Upsert a batch's chunks by id into the buckets they touch; ``buckets`` stays as it was at the store's first batch.

    A batch that runs again starts from the same manifest and writes the same folder anew, so that it counts once.
    """
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    batch = chunks.withColumn("seq", F.lit(batch_id).cast("long")).select(*_COLUMNS)
    named = _manifest(spark, store, batch_id)
    folder = f"{store}/batch={batch_id}"
    batch.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}-new")
    fs, new = _fs(spark, f"{folder}-new")
    touched = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(new) if s.isDirectory()]  # at most ``buckets``
    if touched:
        rows = spark.read.schema(STORED).parquet(*[f"{folder}-new/bucket={b}" for b in touched])
        gone = {}
        for b in touched:
            runs = named.get(b, [])
            kept = _to_merge([_size(spark, _folder(store, b, v)) for v in runs], _size(spark, f"{folder}-new/bucket={b}"))
            named[b], gone[b] = [*runs[:kept], batch_id], runs[kept:]
        merged = C.upsert_chunks(_read(spark, store, gone), rows).withColumn("bucket", bucket)
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    rows = spark.createDataFrame(sorted((b, v) for b, runs in named.items() for v in runs), "bucket int, batch long")
    rows.coalesce(1).write.mode("overwrite").json(f"{store}/manifest/{batch_id}")
    fs.delete(new, True)
    _forget(spark, store, batch_id)


def _forget(spark: SparkSession, store: str, batch_id: int) -> None:
    """Delete what neither the manifest of this batch nor that of the one before names: this one may run again."""
    versions = [v for v in _versions(spark, store) if v <= batch_id]
    runs = lambda v: {(bucket, batch) for bucket, batches in _manifest(spark, store, v + 1).items() for batch in batches}
    live = {item for v in versions[-2:] for item in runs(v)}
    for v in versions[:-2]:
        for bucket, batch in runs(v) - live:
            fs, path = _fs(spark, _folder(store, bucket, batch))
            fs.delete(path, True)
        fs, path = _fs(spark, f"{store}/manifest/{v}")
        fs.delete(path, True)


def stored_chunks(spark: SparkSession, store: str, n_batches: int | None = None) -> DataFrame:
    """The store as it is now, or after the batch before the last: of each id the chunk of the last batch that has it."""
    below = n_batches if n_batches is not None else max(_versions(spark, store), default=-1) + 1
    named = _manifest(spark, store, below)
    one, more = ({b: runs for b, runs in named.items() if (len(runs) > 1) == several} for several in (False, True))
    rows = _read(spark, store, one)
    return rows.unionByName(C.upsert_chunks(rows.limit(0), _read(spark, store, more))) if more else rows


def last_versions(batch: DataFrame) -> DataFrame:
    """path and text of a batch (path, text, changed): of each path the version that changed last, ties by text."""
    last = F.max_by(F.struct("text"), F.struct("changed", "text"))["text"]
    return batch.groupBy("path").agg(last.alias("text"))


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str, *, schema: str = "path string, content string", files_a_batch: int = 100, buckets: int = _BUCKETS):
    """Start a query that chunks documents (Parquet files of path, content) as they come in ``source``.

    Chunking has no state; chunks are upserted by id, so what comes twice changes nothing. Within a batch the file that
    was written last has a path's text.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    docs = docs.where(~X.is_blank(F.col("content"))).select("path", X.clean_text(X.strip_frontmatter(F.col("content"))).alias("text"), F.col("_metadata.file_modification_time").alias("changed"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        merge_batch(C.semantic_chunk(last_versions(batch)), store, batch_id, buckets=buckets)

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
