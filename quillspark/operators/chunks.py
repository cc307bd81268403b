"""Cutting cleaned text into chunks with stable ids, and their keyed store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import helpers
from quillspark.functions import patterns as P
from quillspark.functions import text as X


def splitter(size: int, overlap: int):
    """A column function: array of prose to array of arrays of chunks, by helpers.split_prose; null stays null."""

    @F.pandas_udf("array<array<string>>")
    def split(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lists:
            yield pd.Series([None if x is None else [None if t is None else helpers.split_prose(t, size, overlap) for t in x] for x in batch])

    return split.asNondeterministic()  # so that Spark neither repeats it nor moves it into another expression


def keep_prose(text: Column, shortest: int = P.MIN_PROSE_CHARS) -> Column:
    """Prose worth keeping: not blank, and long enough unless it holds a fence mark."""
    return (text != "") & (text.contains("```") | (F.length(text) >= shortest))


def semantic_chunk(documents: DataFrame, *, chunk_tokens: int = P.CHUNK_TOKENS, overlap_tokens: int = P.OVERLAP_TOKENS) -> DataFrame:
    """Chunks of cleaned documents (path, text): id, text, source_doc, section, position, has_code, n; path stays.

    Code blocks are whole. Prose that fits is a chunk without Python; only longer prose goes there. A document stays one
    row until its chunks are numbered, so nothing is shuffled and every step reads it once.
    """
    rows = chunk_lists(documents, chunk_tokens=chunk_tokens, overlap_tokens=overlap_tokens).select("path", F.posexplode_outer("chunks").alias("n", "c"))
    return numbered(rows.where("c is not null"))  # outer, so that Spark infers no filter that would work all chunks out first


def numbered(rows: DataFrame) -> DataFrame:
    """Chunks of rows (path, n, c), a chunk of a document and its number each."""
    kept = rows.select("path", F.col("c.text").alias("text"), X.doc_name(F.col("path")).alias("source_doc"), F.col("c.section").alias("section"), F.col("c.position").alias("position"), "n", (F.col("c.code") | F.col("c.text").contains("```")).alias("has_code"))
    return kept.select("path", F.concat_ws("_", "source_doc", X.slug(F.col("section")), "n").alias("id"), "text", "source_doc", "section", "position", "has_code", "n")


def chunk_lists(documents: DataFrame, *, chunk_tokens: int = P.CHUNK_TOKENS, overlap_tokens: int = P.OVERLAP_TOKENS) -> DataFrame:
    """Documents (path, text, ...) with chunks, array<struct<position, code, section, text>>; blank text has none."""
    size, overlap = chunk_tokens * P.CHARS_PER_TOKEN, overlap_tokens * P.CHARS_PER_TOKEN
    kept = [c for c in documents.columns if c != "text"]
    text = F.when(~X.is_blank(F.col("text")), F.col("text"))
    segs = F.filter(X.segments(F.col("text")), lambda s: ~X.is_blank(s["content"]))
    named = X.let(segs, lambda x: X.let(X.sections_at(X.headings(F.col("text")), F.transform(x, lambda s: s["start"])), lambda names: F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["content"].alias("content"), F.get(names, i).alias("section")))))
    docs = documents.select(*kept, text.alias("text")).select(*kept, named.alias("_segs"))
    # a splitter never cuts a text of one piece; others need its rules
    long = F.transform("_segs", lambda s: F.when((s["kind"] == "prose") & (F.length(s["content"]) >= size), s["content"]))
    docs = docs.withColumn("_split", splitter(size, overlap)(F.when(F.exists(long, lambda x: x.isNotNull()), long)))

    def pieces(s: Column, i: Column) -> Column:
        code = s["kind"] == "code"
        cut = F.coalesce(F.get("_split", i), F.array(s["content"]))
        chunk = lambda x: F.struct(s["start"].alias("position"), code.alias("code"), s["section"].alias("section"), F.when(code, x).otherwise(X.strip(x)).alias("text"))
        return F.filter(F.transform(cut, chunk), lambda c: c["code"] | keep_prose(c["text"]))

    none = F.array().cast("array<struct<position:int,code:boolean,section:string,text:string>>")
    return docs.select(*kept, F.coalesce(F.flatten(F.transform("_segs", pieces)), none).alias("chunks"))


def upsert_chunks(stored: DataFrame, batch: DataFrame, *, order: str = "seq") -> DataFrame:
    """Rows of both by id: those of the batch win, and of those with one id the last by ``order``."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rank = F.struct("_new", order)
    rest = [c for c in stored.columns if c != "id"]
    latest = both.groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("row"))  # combined before the shuffle
    return latest.select("id", *[F.col(f"row.{c}").alias(c) for c in rest])


def reset_collection(stored: DataFrame) -> DataFrame:
    """The empty collection with the same columns."""
    return stored.limit(0)


def collection_counts(stored: DataFrame, batch: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows before, in the batch, and after."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(stored, "n_before").join(count(batch, "n_upserted")).join(count(after, "n_after"))


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """Ids made more than once, and how often."""
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _in_batches(embed: Callable[[list[str]], list], dimension: int, batch: int, tries: int) -> Callable[[list[str]], list[list[float]]]:
    """Vectors of any number of texts by calls of at most ``batch``, each tried ``tries`` times and checked."""

    def call(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), batch):
            some = texts[at : at + batch]
            for attempt in range(tries):
                try:
                    found = embed(some)
                    break
                except Exception:
                    if attempt == tries - 1:
                        raise
                    time.sleep(2**attempt * 0.1)
            if len(found) != len(some) or any(len(v) != dimension for v in found):
                raise ValueError(f"expected {len(some)} vectors of {dimension} numbers")
            out += [[float(x) for x in v] for v in found]
        return out

    return call


def embed_texts(chunks: DataFrame, embed: Callable[[list[str]], list], dimension: int, *, batch: int = 32, tries: int = 3) -> DataFrame:
    """Add embedding: ``embed`` maps a list of texts (at most ``batch``) to as many vectors; it is tried ``tries`` times.

    Calls are filled across the batches in which rows come, so that a task makes one short call at most.
    """

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = _in_batches(embed, dimension, batch, tries)
        waiting: list[str] = []
        for part in parts:
            waiting += part.tolist()
            full = len(waiting) - len(waiting) % batch
            if full:
                yield pd.Series(call(waiting[:full]))
                waiting = waiting[full:]
        if waiting:
            yield pd.Series(call(waiting))

    return chunks.withColumn("embedding", vectors.asNondeterministic()(X.embedding_text(F.col("source_doc"), F.col("section"), F.col("text"))))


def embed_once(chunks: DataFrame, embed: Callable[[list[str]], list], dimension: int, store: str, *, batch: int = 32, tries: int = 3, a_file: int = 32) -> DataFrame:
    """As ``embed_texts``, through a store of vectors by digest of the text: what is there is never paid for again.

    Equal texts are embedded once. A task writes a file after each ``a_file`` full calls and, when it runs again, skips
    what its files have; a later job skips what all files have. The store is a folder that all executors reach.
    """
    spark = chunks.sparkSession
    text = X.embedding_text(F.col("source_doc"), F.col("section"), F.col("text"))
    keyed = chunks.withColumn("_digest", F.sha2(text, 256))
    kind = "digest string, embedding array<float>"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    wanted = keyed.select("_digest", text.alias("_text")).groupBy("_digest").agg(F.any_value("_text").alias("text"))
    wanted = wanted.join(spark.read.schema(kind).parquet(store).select(F.col("digest").alias("_digest")), "_digest", "left_anti")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = pafs.FileSystem.from_uri(store if "://" in store else "file://" + store.removeprefix("file:"))
        call, mine = _in_batches(embed, dimension, batch, tries), f"task-{TaskContext.get().partitionId()}-"
        known: set[str] = set()
        for info in files.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith(mine):
                known.update(pq.read_table(info.path, filesystem=files, columns=["digest"]).column(0).to_pylist())
        waiting: list[tuple[str, str]] = []

        def flush(rows: list[tuple[str, str]]) -> None:
            table = pa.table({"digest": [d for d, _ in rows], "embedding": pa.array(call([t for _, t in rows]), pa.list_(pa.float32()))})
            name = f"{folder}/{mine}{uuid.uuid4().hex}.parquet"
            hidden = f"{folder}/_{uuid.uuid4().hex}"  # readers see whole files only
            pq.write_table(table, hidden, filesystem=files)
            files.move(hidden, name)

        for part in parts:
            waiting += [(d, t) for d, t in zip(part["_digest"], part["text"], strict=True) if d not in known]
            while len(waiting) >= batch * a_file:
                flush(waiting[: batch * a_file])
                waiting = waiting[batch * a_file :]
        if waiting:
            flush(waiting)
        yield pd.DataFrame({"done": [True]})

    wanted.mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()
    fresh = spark.read.schema(kind).parquet(store).groupBy(F.col("digest").alias("_digest")).agg(F.any_value("embedding").alias("embedding"))
    return keyed.join(fresh, "_digest").drop("_digest")
