"""Exact removal of repeated passages: every byte that lies in a string of ``length`` bytes which starts more than once.

Sorting all suffixes of a corpus at once would move each byte many times. So suffixes are sorted a bucket at a time, and
only those that can repeat:

1. A suffix's bucket is the smallest hash among the 32-byte strings of its first ``length`` bytes, its anchor. Equal
   beginnings have equal anchors. Neighbouring suffixes mostly share one, so a document is some runs of suffixes, one
   for about 85 bytes; a text that repeats itself has longer ones, which are cut at 256 suffixes. Only anchors are shuffled here; a bucket that one run alone falls in can't hold a repeat.
2. What is left of each text is cut into the pieces that its runs cover, and pieces go to their bucket.
3. A task takes its buckets in turn. It ranks the suffixes at the positions of a difference cover modulo 7 to 112 bytes,
   by doubling along the stride. Any two suffixes reach cover positions after an equal shift of at most 6 bytes; so
   their first ``length`` bytes are equal if those few bytes, the ranks there and at the end, and the last few bytes
   are. Sorting by these keys, once for each shift, settles ties of any length at a fixed price and memory.
4. A bucket with more than ``bucket_runs`` runs is salted by piece over several tasks, so that none sorts more than
   about 1 MB at once. Within a task suffixes are sorted as before. Each sends on, as 128-bit fingerprints, one
   suffix of each kind that it has found, and those meet by fingerprint: a kind met twice is repeated too.

Texts that are copies of one another are one text from the start, whose suffixes all repeat.

Defined results: null text is empty; a text shorter than ``length`` keeps everything; matches never cross texts, and
overlap within one; each of several equal rows loses all suffixes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import blocks, store

GRAM = 32
#: A difference cover modulo 7: every residue is a difference of two members (fixed values).
COVER, MODULUS = (0, 1, 3), 7
#: Whether a position is in the cover after a shift, by shift and residue.
COVERED = np.array([[(r + shift) % MODULUS in COVER for r in range(MODULUS)] for shift in range(MODULUS)])
RANKED = 16 * MODULUS
#: Suffixes of a run at most.
LONGEST = 256


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte strings, by doubling."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    step = 1
    while step < GRAM:
        if len(h) <= step:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-step] * blocks.MULTIPLIER + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return blocks.mix(h)


def _extreme(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least (or greatest) value of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        h = pick(h[:-step], h[step:])
        step *= 2
    return pick(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes with one anchor: first suffix and anchor of each, how many runs come before each text, and which
    texts have an anchor at several places within one run."""
    width = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(len(offsets) - 1, bool)
    h = gram_hashes(data)
    least = _extreme(h, width, np.minimum)
    sizes = np.diff(offsets)
    edge = np.zeros(len(least) + 1, dtype=np.int32)  # suffixes of at least ``length`` bytes are inside
    ok = sizes >= length
    np.add.at(edge, offsets[:-1][ok], 1)
    np.add.at(edge, (offsets[1:] - length + 1)[ok], -1)
    inside = np.cumsum(edge[:-1]) > 0
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    begin = offsets[:-1][ok]
    first[begin] = True
    starts = np.flatnonzero(first)
    least[~inside] = 0
    most = _extreme(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    places = np.flatnonzero((most[: len(h)] == h) & (most[: len(h)] > 0))
    several = np.diff(np.searchsorted(places, offsets)) > np.diff(np.searchsorted(starts, offsets))
    # only equal strings make a run longer than ``width``: cut it, so that pieces stay small
    outside = np.append(np.flatnonzero(~inside), len(inside))
    stop = np.minimum(np.append(starts[1:], len(inside)), outside[np.searchsorted(outside, starts)])
    more = -(-(stop - starts) // LONGEST) - 1
    if (more > 0).any():
        extra = np.repeat(starts, more) + LONGEST * (blocks.ragged(np.zeros(len(more), np.int64), more) + 1)
        starts = np.sort(np.concatenate([starts, extra]))
    return starts, least[starts], np.searchsorted(starts, offsets), several


def anchors(documents: DataFrame, length: int) -> DataFrame:
    """Anchors of the runs of each text of at least ``length`` bytes, in order; all twice if one stands in a run twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_buffer(batch.column("text"))
            for first, last in blocks.slices(offsets):
                at = offsets[first : last + 1] - offsets[first]
                _, values, before, several = runs(data[offsets[first] : offsets[last]], at, length)
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(first, last - first), batch.column("doc_id").slice(first, last - first), pa.array(several), lists], names=["h", "doc_id", "several", "anchors"])

    return documents.mapInArrow(find, "h binary, doc_id long, several boolean, anchors array<long>")


PIECES = "anchor long, salt int, hot boolean, h binary, start int, piece binary"


def pieces(candidates: DataFrame, length: int) -> DataFrame:
    """Pieces of candidate texts (h, text, marks: runs that may repeat, with how many tasks share their bucket)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, marks = batch.column("h").to_pylist(), batch.column("marks")
            data, offsets = blocks.text_buffer(batch.column("text"))
            for k in range(len(hs)):
                text = data[offsets[k] : offsets[k + 1]]
                starts, values, _, _ = runs(text, np.array([0, len(text)]), length)
                mark = marks[k].values
                shares = np.zeros(len(starts), dtype=np.int64)
                shares[mark.field("pos").to_numpy()] = mark.field("share").to_numpy()
                ends = np.append(starts[1:], len(text) - length + 1)
                some = np.flatnonzero(shares)
                spread = blocks.mix(starts[some].astype(np.uint64) + np.uint64(int.from_bytes(hs[k][:7], "little")))
                salt = spread % np.maximum(shares[some], 1).astype(np.uint64)
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values[some].view(np.int64)),
                        pa.array(salt.astype(np.int32)),
                        pa.array(shares[some] > 1),
                        pa.array([hs[k]] * len(some), pa.binary()),
                        pa.array(starts[some].astype(np.int32)),
                        pa.array([raw[a : b + length - 1] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["anchor", "salt", "hot", "h", "start", "piece"],
                )

    return candidates.select("h", "text", "marks").mapInArrow(cut, PIECES)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def repeated(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions of all pieces, and for each whether its first ``length`` bytes start elsewhere in them too."""
    sizes = np.diff(begins)
    n = len(data)
    local = np.arange(n, dtype=np.int32) - np.repeat(begins[:-1].astype(np.int32), sizes)
    room = np.repeat(sizes.astype(np.int32), sizes) - local
    word = blocks.eights(data)[:n].byteswap()  # the next 8 bytes, the first on top
    residue = (local % MODULUS).astype(np.int8)
    covered = COVERED[0][residue]
    rank = np.zeros(n, dtype=np.int32)
    at = np.flatnonzero(covered & (room >= MODULUS))
    rank[at] = _ranks(word[at] >> np.uint64(8))
    size = MODULUS
    while size < RANKED:
        at = at[room[at] >= 2 * size]
        rank[at] = _ranks(rank[at].astype(np.int64) << 32 | rank[at + size])
        size *= 2
    suffixes = np.flatnonzero(room >= length)
    found = np.zeros(n, dtype=bool)
    for shift in range(MODULUS):
        own = suffixes[COVERED[shift][residue[suffixes]]]
        steps = (length - shift) // MODULUS
        tail = length - shift - steps * MODULUS
        ranks = [rank[own + shift + k * MODULUS] for k in [*range(0, steps - 16, 16), steps - 16]]
        head = word[own] >> np.uint64(64 - 8 * shift) if shift else np.zeros(len(own), np.uint64)
        last = word[own + length - tail] >> np.uint64(64 - 8 * tail) if tail else np.zeros(len(own), np.uint64)
        key = ranks[0].astype(np.int64) << 32 | ranks[-1]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, dtype=bool)
        order = order[tied]
        keys = [last[order], head[order], *[r[order] for r in ranks[1:-1]], key[order]]
        order = order[np.lexsort(keys)]
        if len(order) > 1:
            same = (key[order][1:] == key[order][:-1]) & (head[order][1:] == head[order][:-1]) & (last[order][1:] == last[order][:-1])
            for r in ranks[1:-1]:
                same &= r[order][1:] == r[order][:-1]
            found[own[order[1:][same]]] = True
            found[own[order[:-1][same]]] = True
    return suffixes, found[suffixes]


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of the ``length`` bytes at each place of ``at``."""
    out = np.zeros((len(at), 2), dtype=np.uint64)
    for k, factor in enumerate((blocks.MULTIPLIER, blocks.MIXER)):
        h, step, place, left = data.astype(np.uint64) + np.uint64(1), 1, at.copy(), length
        total = np.full(len(at), k + 1, dtype=np.uint64)
        while left:
            if left & step:
                total = blocks.mix(total * factor + h[place])
                place = place + step
                left -= step
            if left:
                h = h[:-step] * factor + h[step:] if len(h) > step else h
                h ^= h >> np.uint64(31)
                step *= 2
        out[:, k] = total
    return out


FOUND = T.StructType(
    [
        T.StructField("h", T.BinaryType()),
        T.StructField("begin", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("kinds", T.BinaryType()),
        T.StructField("owners", T.ArrayType(T.BinaryType())),
    ]
)
FOUND_ARROW = pa.schema([("h", pa.binary()), ("begin", pa.int32()), ("end", pa.int32()), ("part", pa.int32()), ("kinds", pa.binary()), ("owners", pa.list_(pa.binary()))])
KIND = np.dtype([("f", "<u8"), ("g", "<u8"), ("owner", "<i4"), ("at", "<i4")])


def _spans(hs: list[bytes], owner: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of FOUND for suffixes (place in text ``owner``) that repeat: neighbours are one span of bytes."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]) if len(order) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1 if len(order) else first
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [pa.array([hs[k] for k in owner[first].tolist()], pa.binary()), pa.array(place[first].astype(np.int32)), pa.array((place[last] + length).astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.binary()))],
        schema=FOUND_ARROW,
    )


def sort_buckets(cut: DataFrame, length: int, parts: int, *, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Spans of repeated suffixes within a task's buckets, and the kinds that salted buckets send on (schema FOUND)."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def work() -> Iterator[pa.RecordBatch]:
            hs = [x[2] for x in held]
            data = np.frombuffer(b"".join(x[4] for x in held), dtype=np.uint8)
            begins = np.concatenate([[0], np.cumsum([len(x[4]) for x in held])])
            starts, hot = np.array([x[3] for x in held], dtype=np.int64), np.array([x[5] for x in held], dtype=bool)
            at, found = repeated(data, begins, length)
            owner = np.searchsorted(begins, at, side="right") - 1
            place = starts[owner] + at - begins[owner]
            yield _spans(hs, owner[found], place[found], length)
            some = hot[owner]
            if some.any():
                at, owner, place, found = at[some], owner[some], place[some], found[some]
                prints = fingerprints(data, at, length)
                kinds = np.zeros(len(at), dtype=KIND)
                kinds["f"], kinds["g"], kinds["owner"], kinds["at"] = prints[:, 0], prints[:, 1], owner, place
                order = np.lexsort((kinds["g"], kinds["f"]))
                kinds = kinds[order]
                one = np.concatenate([[True], (kinds["f"][1:] != kinds["f"][:-1]) | (kinds["g"][1:] != kinds["g"][:-1])])
                kinds = kinds[one]
                part = (kinds["f"] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                kinds, part = kinds[order], part[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own, index = np.unique(kinds["owner"][a:b], return_inverse=True)
                    group = kinds[a:b].copy()
                    group["owner"] = index
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([part[a]], pa.int32()), pa.array([group.tobytes()], pa.binary()), pa.array([[hs[k] for k in own.tolist()]], pa.list_(pa.binary()))],
                        schema=FOUND_ARROW,
                    )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "h", "start", "piece", "hot")), strict=True):
                if size > chunk_bytes and row[:2] != held[-1][:2]:
                    yield from work()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from work()

    return cut.mapInArrow(sort, FOUND)


def match_kinds(kinds: DataFrame, length: int) -> DataFrame:
    """Spans of suffixes whose fingerprints two salted buckets have sent (rows of one part stand together)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple[bytes, list[bytes]]]) -> pa.RecordBatch:
            hs, all_kinds = [], []
            for raw, owners in rows:
                k = np.frombuffer(raw, dtype=KIND).copy()
                k["owner"] += len(hs)
                hs += owners
                all_kinds.append(k)
            k = np.concatenate(all_kinds)
            k = k[np.lexsort((k["g"], k["f"]))]
            same = (k["f"][1:] == k["f"][:-1]) & (k["g"][1:] == k["g"][:-1])
            k = k[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            return _spans(hs, k["owner"].astype(np.int64), k["at"].astype(np.int64), length)

        part, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "kinds", "owners")), strict=True):
                if row[0] != part and rows:
                    yield work(rows)
                    rows = []
                part = row[0]
                rows.append(row[1:])
        if rows:
            yield work(rows)

    return kinds.repartition("part").sortWithinPartitions("part").mapInArrow(match, FOUND)


TRIMMED = "h binary, n_removed long, n_spans long, kept binary"


def trim(candidates: DataFrame) -> DataFrame:
    """Remove the union of ``spans`` from each text (h, text, spans)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, parts, n = text.encode(), 0, [], 0
                merged: list[list[int]] = []
                for begin, end in sorted((s["begin"], s["end"]) for s in spans):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                for begin, end in merged:
                    parts.append(raw[at:begin])
                    n, at = n + end - begin, end
                parts.append(raw[at:])
                removed.append(n)
                n_spans.append(len(merged))
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["h", "n_removed", "n_spans", "kept"])

    return candidates.select("h", "text", "spans").mapInArrow(remove, TRIMMED)


def find_repeats(documents: DataFrame, *, length: int = 200, bucket_runs: int = 1_024, parts: int | None = None) -> DataFrame:
    """What removal leaves of each distinct text that loses anything: h (``text_key``), n_removed, n_spans, kept (bytes).

    ``length`` is at least 118: under it, the ranks of cover positions would reach beyond a string's end.
    """
    if length < RANKED + MODULUS - 1:
        raise ValueError(f"length must be at least {RANKED + MODULUS - 1}")
    spark, mark = documents.sparkSession, store.written()
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("text").cast("string")).where(F.octet_length("text") >= length)
    docs = docs.withColumn("h", text_key(F.col("text")))
    texts = anchors(docs, length).groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("several").alias("several"), F.first("anchors").alias("anchors"))
    texts = store.cut(texts.withColumn("t", F.monotonically_increasing_id()), "text-anchors")  # a short name for each text
    twice = F.when(F.col("several"), F.concat("anchors", "anchors")).otherwise(F.col("anchors"))
    met = texts.select(F.explode(twice).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = store.cut(met.select("anchor", F.ceil(F.col("n") / bucket_runs).cast("int").alias("share")), "met-anchors")
    placed = texts.select("t", F.posexplode("anchors").alias("pos", "anchor")).join(met, "anchor")
    marks = placed.groupBy("t").agg(F.collect_list(F.struct("pos", "share")).alias("marks"))  # as many as a text has runs
    marks = marks.join(texts.select("t", "h", "doc_id"), "t").drop("t")
    candidates = store.cut(docs.join(marks, ["h", "doc_id"]).dropDuplicates(["h"]), "candidate-texts")
    copied = store.cut(texts.where("copies > 1").select("h"), "copied-texts")
    store.drop_since(spark, mark, candidates, copied)
    parts = parts or max(64, spark.sparkContext.defaultParallelism * 4)
    cut = pieces(candidates, length).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = store.cut(sort_buckets(cut, length, parts), "repeats")
    late = match_kinds(found.where("part is not null").select("part", "kinds", "owners"), length)
    spans = found.where("part is null").select("h", "begin", "end").unionByName(late.select("h", "begin", "end"))
    spans = spans.groupBy("h").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    partly = trim(candidates.select("h", "text").join(spans, "h"))
    partly = partly.join(copied, "h", "left_anti")
    whole = copied.select("h", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return partly.unionByName(whole)


def text_key(text: Column) -> Column:
    """128 bits that only equal texts share."""
    return F.unhex(F.md5(text.cast("binary")))


def removed_spans(documents: DataFrame, *, length: int = 200, kept_text: bool = False) -> DataFrame:
    """Per document (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256; with ``kept_text`` also kept (bytes), and all columns."""
    mark = store.written()
    repeats = find_repeats(documents, length=length)
    if not kept_text:
        repeats = repeats.select("h", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    repeats = store.cut(repeats.withColumnsRenamed({c: f"_{c}" for c in repeats.columns}), "removed-spans")
    store.drop_since(documents.sparkSession, mark, repeats)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = documents.withColumn("n_bytes", F.octet_length(raw).cast("long")).withColumn("_own", F.when(F.col("n_bytes") >= length, text_key(raw)))
    docs = docs.withColumn("kept", raw) if kept_text else docs.select("doc_id", "n_bytes", "_own", F.sha2(raw, 256).alias("kept_sha256"))
    out = docs.join(repeats, F.col("_own") == F.col("_h"), "left")
    last = "kept" if kept_text else "kept_sha256"
    out = out.withColumn("n_removed", F.when(F.col("_h").isNull(), F.lit(0)).otherwise(F.coalesce("_n_removed", "n_bytes")).cast("long"))
    out = out.withColumn("n_spans", F.coalesce("_n_spans", F.lit(0)).cast("long")).withColumn(last, F.coalesce(f"_{last}", last))
    return out.drop("_h", "_own", "_n_removed", "_n_spans", f"_{last}")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
