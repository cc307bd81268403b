"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Records are sorted by page_id over the whole table and cut into shards at page_ids that only depend on the set of
page_ids; a shard is written by one task as one or more ``.warc.gz`` files, rolled by compressed size. Equal tables give
equal bytes, however Spark splits or repeats the work.

Defined results: null html is an empty payload; null page_id sorts first and is carried as a record without its id
header, in the shard that its digest says; a null or odd url is percent-encoded or left out; rows that repeat a page_id and payload are all responses if
that page_id is the smallest with the payload, and else all revisits; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import store

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def encode_url(url: str) -> str:
    """The url with everything outside printable ASCII percent-encoded; reading it back decodes what was encoded."""
    return urllib.parse.quote(url, safe="!#$&'()*+,/:;=?@[]~%")


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    head += [f"{k}: {v}" for k, v in fields if v is not None]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else encode_url(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
        ("X-Url", None if url is None else base64.b64encode(url.encode()).decode() if encode_url(url) != url else None),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To", refers_to)]
        return record("revisit", fields, http)
    return record("response", fields, http + payload)


def _shard_of(keys: np.ndarray):
    """A column function: the number of ``keys`` at or before a page_id; null for null."""

    @F.pandas_udf(T.IntegerType())
    def shard_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(keys, ids.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(found.astype("int32")).where(ids.notna().to_numpy(), None).astype("Int32")

    return shard_of


def _boundaries(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Page_ids between shards of about equal bytes.

    The page_ids of smallest hash cut the table finely; the bytes of each such part are summed up over all rows, and
    shards are cut where the sums come to even shares.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = min(100_000, max(1, -(-total // shard_bytes)))
    if shards == 1:
        return []
    each = 20 if shards <= 2_000 else 4
    few = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(each * shards)
    keys = np.array(sorted(r[0] for r in few.collect()), dtype=np.int64)
    parts = pages.where("page_id is not null").select(_shard_of(keys)("page_id").alias("part"), F.octet_length("html").alias("n"))
    sums = np.zeros(len(keys) + 1)
    for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect():
        sums[r.part] = r.n or 0
    before = np.cumsum(sums)[:-1]  # bytes of page_ids under each key
    share = before[-1] + sums[-1] if len(keys) else 0
    return sorted({int(keys[k]) for k in np.searchsorted(before, share / shards * np.arange(1, shards)) if k < len(keys)})


def write_warc(
    pages: DataFrame,
    root: str,
    *,
    shard_bytes: int = 32 << 20,
    file_bytes: int = 1 << 30,
    min_revisit_bytes: int = 100,
    level: int = 6,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Archive pages (page_id, url, html) under ``root``; return the committed manifest.

    ``shard_bytes`` of html make a shard, the unit of work of a task; ``file_bytes`` is the compressed size at which a
    file is closed. One shuffle carries the html: the narrow revisit marks are sorted in among the pages, so no join does.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    narrow = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= min_revisit_bytes)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = store.cut(firsts.select("digest", "first"), "first-payloads")
    marks = narrow.join(firsts, "digest").where("page_id is null or page_id > first")
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", F.col("first").alias("refers_to"))
    rows = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"))

    keys = np.array(_boundaries(pages, shard_bytes), dtype=np.int64)
    shards = len(keys) + 1

    shard = F.coalesce(_shard_of(keys)("page_id"), F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    dealt = rows.unionByName(marks).withColumn("shard", shard).repartitionById(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.col("html").isNotNull(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, done = uuid.uuid4().hex, []
        out: store.StagedFile | None = None
        shard = seq = n = -1
        mark = None
        span: list[int | None] = []

        def close():
            out.close()
            done.append((out.name, out.staged, n, out.size, json.dumps({"first": span[0], "last": span[1]})))

        for batch in batches:
            for row_shard, page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "refers_to")), strict=True):
                if html is None:
                    mark = (page_id, digest, refers_to)
                    continue
                revisit = mark is not None and mark[:2] == (page_id, digest)
                data = page_record(page_id, url, html, digest, mark[2] if revisit else None, revisit, date)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(data) + member.flush()
                if out is None or row_shard != shard or out.size + len(data) > file_bytes:
                    if out is not None:
                        close()
                    seq = 0 if row_shard != shard else seq + 1
                    shard, n, span = row_shard, 0, [page_id, page_id]
                    out = store.StagedFile(root, attempt, f"shard-{shard:06d}-{seq:05d}.warc.gz")
                    info = f"software: quillspark\r\nformat: WARC File Format 1.1\r\nfilename: {out.name}\r\n".encode()
                    head = [("WARC-Record-ID", record_id(None, out.name)), ("WARC-Date", date), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")]
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(member.compress(record("warcinfo", head, info)) + member.flush())
                out.write(data)
                n, span[1] = n + 1, page_id
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*done, strict=True)) or [()] * 5, store.FILES_ARROW.types, strict=True)], schema=store.FILES_ARROW)

    return store.commit(dealt.mapInArrow(write, store.FILES), root)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a .warc.gz stream; a wrong block digest is an error."""
    held = bytearray()
    member = zlib.decompressobj(31)
    while chunk := stream.read(1 << 20):
        while chunk:
            held += member.decompress(chunk)
            chunk = member.unused_data
            if member.eof:
                head, _, rest = bytes(held).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                block = rest[: int(fields["content-length"])]
                if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
                    raise ValueError(f"block digest of {fields['warc-record-id']} does not match")
                yield fields, block
                held, member = bytearray(), zlib.decompressobj(31)
    if held:
        raise ValueError("the archive ends inside a record")


def read_warc(spark: SparkSession, root: str, *, payloads: bool = True) -> DataFrame:
    """Read committed archives back (schema RECORDS); a revisit has no payload of its own.

    Digest and length of a response are taken anew from its payload and must equal its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, path = store.open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, length = fields["warc-payload-digest"].partition(":")[2], int(fields["x-payload-length"])
                        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its headers")
                        number = lambda k, f=fields: int(f[k]) if k in f else None
                        url = base64.b64decode(fields["x-url"]).decode() if "x-url" in fields else fields.get("warc-target-uri")
                        rows.append((number("x-page-id"), length, digest, kind, number("x-refers-to"), url, payload if payloads and kind == "response" else None))
                        held += len(payload)
                        if held > 16 << 20 or len(rows) >= 20_000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return store.spread_files(store.read_manifest(spark, root), root).select("path").mapInArrow(read, RECORDS)
