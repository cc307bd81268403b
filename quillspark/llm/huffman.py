"""Token files: ids in canonical length-limited Huffman codes, in blocks that decode on their own.

A file holds documents in ascending doc_id order. It begins with the code lengths; each block after that has its own
document list, bit offsets of every 256th id, a checksum and the code bits, so a reader may begin at any block, and
inside a block at any checkpoint. Decoding looks ids up in one table, for all checkpoints of a block at once.

Defined results: null text is empty, so such a document has the end id alone; rows that repeat a doc_id stand side by
side, ordered by their ids; null doc_id comes first; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import store, tokens

MAGIC = b"QSHUF1\n\0"
CHECKPOINT = 256
BLOCK = 1 << 20


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of the best prefix code with none over ``max_bits`` (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    levels, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[0 : len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, found = 2 * len(weights) - 2, np.zeros(len(weights) + 1, dtype=np.int64)
    for is_item in reversed(levels):
        items = int(is_item[:take].sum())
        found[0] += 1
        found[items] -= 1
        take = 2 * (take - items)
    lengths[used] = np.cumsum(found)[:-1]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for each possible next ``bits`` bits."""
    bits = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    each = np.left_shift(1, bits - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << bits, dtype=np.uint32), np.zeros(1 << bits, dtype=np.int64)
    ids[: each.sum()] = np.repeat(order.astype(np.uint32), each)
    size[: each.sum()] = np.repeat(lengths[order].astype(np.int64), each)
    return ids, size, bits


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids``, most significant first, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    code, word = codes[ids], at >> 6
    shift = 64 - (at & 63) - size
    over = np.flatnonzero(shift < 0)
    part = code << np.maximum(shift, 0).astype(np.uint64)
    part[over] = code[over] >> (-shift[over]).astype(np.uint64)
    if len(ids):
        groups = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[groups]] = np.add.reduceat(part, groups)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return words.byteswap().tobytes()[: -(-total // 8)], at[::CHECKPOINT].astype(np.uint32)


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block: one step decodes the next id after every checkpoint."""
    symbols, sizes, width = table
    data = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.empty((CHECKPOINT, len(checkpoints)), dtype=np.uint32)
    at, mask = checkpoints.astype(np.int64), np.uint32((1 << width) - 1)
    full, rest = divmod(n, CHECKPOINT)
    for k in range(CHECKPOINT):
        if k == rest and full < len(checkpoints):
            at = at[:full]
        next_bits = window[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32) & mask
        out[k, : len(at)] = symbols[next_bits]
        at = at + sizes[next_bits]
    return out.T.reshape(-1)[:n]


def write_file(out, docs: Iterator[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[int, int]:
    """Write documents to ``out``; a document may go on in the next block. Return how many documents and ids."""
    packed = zlib.compress(lengths.tobytes(), 6)
    out.write(MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed)
    n_docs = n_ids = 0
    held: list[tuple[int | None, np.ndarray, bool]] = []
    size = 0

    def flush():
        nonlocal held, size
        ids = np.concatenate([x for _, x, _ in held])
        bits, checkpoints = encode_bits(ids, lengths, codes)
        numbers = np.array([0 if d is None else d for d, _, _ in held], dtype="<i8").tobytes()
        counts = np.array([len(x) for _, x, _ in held], dtype="<u4").tobytes()
        marks = np.array([(d is None) + 2 * more for d, _, more in held], dtype=np.uint8).tobytes()
        body = numbers + counts + marks + checkpoints.astype("<u4").tobytes() + bits
        out.write(struct.pack("<IIIII", len(held), len(ids), len(checkpoints), len(bits), zlib.crc32(body)) + body)
        held, size = [], 0

    for doc_id, ids in docs:
        n_docs, n_ids, more = n_docs + 1, n_ids + len(ids), False
        while size + len(ids) > block:
            part = ids[: block - size]
            held.append((doc_id, part, more))
            flush()
            ids, more = ids[len(part) :], True
        held.append((doc_id, ids, more))
        size += len(ids)
    if held:
        flush()
    return n_docs, n_ids


def read_file(stream) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """Parts of documents in file order: doc_id, ids, and whether the part goes on with the one before."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    n, packed = struct.unpack("<II", stream.read(8))
    lengths = np.frombuffer(zlib.decompress(stream.read(packed)), dtype=np.uint8)
    if len(lengths) != n:
        raise ValueError("the code lengths are damaged")
    table = decode_table(lengths)
    while head := stream.read(20):
        n_docs, n_ids, n_checkpoints, n_bits, crc = struct.unpack("<IIIII", head)
        body = stream.read(13 * n_docs + 4 * n_checkpoints + n_bits)
        if zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        numbers = np.frombuffer(body, dtype="<i8", count=n_docs)
        counts = np.frombuffer(body, dtype="<u4", count=n_docs, offset=8 * n_docs)
        marks = np.frombuffer(body, dtype=np.uint8, count=n_docs, offset=12 * n_docs)
        checkpoints = np.frombuffer(body, dtype="<u4", count=n_checkpoints, offset=13 * n_docs)
        ids = decode_bits(body[13 * n_docs + 4 * n_checkpoints :], checkpoints, n_ids, table)
        ends = np.cumsum(counts, dtype=np.int64)
        for k in range(n_docs):
            yield None if marks[k] & 1 else int(numbers[k]), ids[ends[k] - counts[k] : ends[k]], bool(marks[k] & 2)


def tokenize(documents: DataFrame, tokenizer: str, *, end_id: int, id_bytes: int) -> DataFrame:
    """doc_id and ids (little-endian, ``id_bytes`` each) of whole texts, ``end_id`` appended."""
    kind = {2: np.uint16, 4: np.uint32}[id_bytes]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for first, last, ids, begins in tokens.encode_texts(batch.column("text"), tokenizer):
                rows = last - first
                at = begins + np.arange(rows + 1)
                whole = np.full(len(ids) + rows, end_id, dtype=kind)
                keep = np.ones(len(whole), dtype=bool)
                keep[at[1:] - 1] = False
                if len(ids) and int(ids.max()) >> 8 * id_bytes:
                    raise ValueError(f"an id needs more than {id_bytes} bytes")
                whole[keep] = ids
                column = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((at * id_bytes).astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), column], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(encode, tokens.TOKENS)


def count_ids(table: DataFrame, id_bytes: int) -> np.ndarray:
    """How often each id occurs in all documents; one row for each id and task comes together."""
    kind = {2: np.uint16, 4: np.uint32}[id_bytes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            data = batch.column("ids").buffers()[2]
            _, offsets, data = batch.column("ids").cast(pa.large_binary()).buffers()
            at = np.frombuffer(offsets, dtype=np.int64)[batch.column("ids").offset :][: len(batch) + 1]
            found = np.bincount(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind))
            if len(found) > len(counts):
                counts, found = found, counts
            counts[: len(found)] += found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])

    rows = table.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_token_files(
    documents: DataFrame,
    root: str,
    tokenizer: str,
    *,
    end_id: int = 2,
    id_bytes: int = 4,
    max_bits: int = 16,
    file_ids: int | None = None,
) -> DataFrame:
    """Encode documents (doc_id, text) into token files under ``root``; return the committed manifest.

    Texts are tokenized once, into a table of ids that the global counts and the sort both read. Only ids are shuffled.
    ``file_ids`` is about how many ids go to a file; by default a 5,000th of all, from 8 to 256 million.
    """
    table = store.cut(tokenize(documents, tokenizer, end_id=end_id, id_bytes=id_bytes), "token-ids")
    counts = count_ids(table, id_bytes)
    lengths = code_lengths(counts, max_bits)
    codes = canonical_codes(lengths)
    total = int(counts.sum())
    each = file_ids or min(256_000_000, max(8_000_000, total // 5_000))
    kind = {2: np.uint16, 4: np.uint32}[id_bytes]
    dealt = table.repartitionByRange(max(1, -(-total // each)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def docs():
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    yield doc_id, np.frombuffer(ids.as_buffer(), dtype=kind)

        rows = docs()
        first = next(rows, None)
        done = []
        if first is not None:
            out = store.StagedFile(root, uuid.uuid4().hex, f"part-{part:06d}.tok")

            def all_docs():
                yield first
                yield from rows

            n_docs, n_ids = write_file(out, all_docs(), lengths, codes)
            out.close()
            done.append((out.name, out.staged, n_docs, out.size, json.dumps({"ids": n_ids})))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*done, strict=True)) or [()] * 5, store.FILES_ARROW.types, strict=True)], schema=store.FILES_ARROW)

    return store.commit(dealt.mapInArrow(write, store.FILES), root)


DECODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def read_token_files(spark: SparkSession, root: str, *, ids: bool = True) -> DataFrame:
    """Documents of committed token files (schema DECODED); ids as little-endian unsigned 32-bit integers, or null."""
    files = store.spread_files(store.read_manifest(spark, root), root)
    n_ids = F.get_json_object("info", "$.ids").cast("long")
    before = F.sum(n_ids).over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    starts = store.read_manifest(spark, root).select("name", F.coalesce(before, F.lit(0)).alias("before"))
    files = files.join(F.broadcast(starts), "name")  # one row a file
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                fs, path = store.open_fs(path)
                rows: list[list] = []
                held = 0

                def flush(rows):
                    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for doc_id, part, more in read_file(stream):
                        raw = part.astype("<u4").tobytes()
                        if more:
                            last = rows[-1]
                            last[2], last[3] = last[2] + len(part), zlib.crc32(raw, last[3])
                            last[4] = last[4] + raw if ids else None
                        else:
                            if held > 16 << 20 or len(rows) >= 20_000:
                                yield flush(rows)
                                rows, held = [], 0
                            rows.append([doc_id, start, len(part), zlib.crc32(raw), raw if ids else None])
                        start += len(part)
                        held += len(raw) if ids else 64
                if rows:
                    yield flush(rows)

    return files.select("path", "before").mapInArrow(read, DECODED)
