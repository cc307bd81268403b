"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

The plan is made over counts: at most ``capacity`` different lengths come to the driver, whatever the number of
documents. A document takes its planned slot by its rank among the documents of its length.

Defined results: null text is empty, so such a document is one piece with the end id alone; rows that repeat a doc_id
are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import store, tokens

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pieces(documents: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids of whole texts, ``end_id`` appended (schema PIECES; ids may be left out)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for first, last, found, begins in tokens.encode_texts(batch.column("text"), tokenizer):
                rows = []
                for k in range(last - first):
                    whole = np.append(found[begins[k] : begins[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, at in enumerate(range(0, len(whole), capacity)):
                        raw = whole[at : at + capacity].tobytes()
                        rows.append((numbers[first + k], piece, at, len(raw) // 4, zlib.crc32(raw), raw if ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.

    Each row (length, first_rank, count, per_sequence, first_sequence, offset) gives ``count`` documents their slots:
    ``per_sequence`` of them, one after another from ``offset``, in each of the sequences from ``first_sequence``.
    Sequences with equal room left are one group, so a step costs no more for a million documents than for one.
    """
    slots = []
    rooms: list[int] = []  # rooms left, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    n_sequences = 0

    def put_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, n_sequences
                n = -(-left // (capacity // length))
                n_sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                put_back(room - each * length, first, full)
                first, n = first + full, n - full
            if n and left and left < each:
                slots.append((length, rank, left, left, first, capacity - room))
                put_back(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put_back(room, first, n)
    return slots


def pack(items: DataFrame, *, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to ``items`` (doc_id, piece, length at least; length from 1 to ``capacity``).

    Ranks within a length are counted in buckets of hashed ids, so that a length that a third of all rows share is not
    one group; bucket counts then shift them. The plan has a few rows for each length and is broadcast: its size is
    bound by ``capacity``, not by the data.
    """
    spark = items.sparkSession
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    buckets = max(256, sum(histogram.values()) // 200_000)
    items = items.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = items.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    in_bucket = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    ranked = items.withColumn("_rank", in_bucket - 1).join(shifts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, _first long, _count long, _each long, _sequence long, _offset long")
    inside = (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    placed = ranked.join(F.broadcast(slots), inside).drop(slots["length"])
    step = F.col("_rank") - F.col("_first")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(step / F.col("_each")))
    placed = placed.withColumn("offset", F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length"))
    return placed.drop("_bucket", "_rank", "_shift", "_first", "_count", "_each", "_sequence", "_offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, n_pieces, ids) of packed pieces with their ids; one holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), ids.alias("ids"))


def pack_documents(documents: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of documents with their place; tokenized once, into a narrow table that histogram and ranks both read."""
    table = store.cut(pieces(documents, tokenizer, capacity=capacity, end_id=end_id, ids=False).drop("ids"), "pieces")
    return pack(table, capacity=capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
