"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

Every distinct shingle is hashed once; the hash's low bits choose a slot and its high bits compete there. Empty slots are
filled by optimal densification: slot ``i`` takes the value of the first full slot in a random sequence that depends on
``i`` alone. ``rows`` slots make a band; documents that agree in a band meet in a bucket.

Documents with equal shingle sets are one class from the start, so buckets hold different sets only. In a bucket the
centre is the document that meets most others in all its buckets, which is the text that near copies were made from
rather than one of the copies. Only edges from the centre are candidates: as many as the bucket has members. Full
shingle sets confirm each edge. With ``stars`` over 1, a bucket whose other members are then still in several components
has another star, around a document of its smallest component, with edges to members of other components only.

What stars leave open is settled exactly. Members of buckets that still hold several components are joined on the
shingles of their prefixes: in an order from rare to common, two sets of similarity ``t`` share one of the first
n - ceil(t * n) + 1. Sizes and positions rule out most pairs; full shingle sets confirm the others.

Two texts with similarity 0.8 miss all 32 bands of 4 rows with probability (1 - 0.8**4)**32 = 5e-8.

Defined results: null text or a text without words has an empty set and stays alone; a text with fewer words than a
shingle has them all as one shingle; each row is returned, and rows that repeat a doc_id and text have equal results;
null doc_id is never linked and stays alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import blocks, graph, store

SIGNATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def shingle_sets(lower: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each text's begin."""
    starts, ends, before = blocks.word_spans(lower, offsets, blocks.NOT_SPACE)
    words = blocks.word_hashes(lower, starts, ends)
    n_words = np.diff(before)
    rows = len(n_words)
    hashes = blocks.shingle_hashes(words, size)
    doc = np.repeat(np.arange(rows), n_words)[: len(hashes)]
    inside = np.arange(len(hashes)) + size <= before[doc + 1] if len(hashes) else np.zeros(0, dtype=bool)
    hashes, doc = hashes[inside], doc[inside]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(words[before[k] : before[k + 1]].tobytes(), digest_size=8).digest(), "little") for k in short], dtype=np.uint64)
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    out, counts = [], np.zeros(rows, dtype=np.int64)
    begins = np.searchsorted(doc, np.arange(rows + 1))
    for k in range(rows):
        own = np.unique(hashes[begins[k] : begins[k + 1]])
        counts[k] = len(own)
        out.append(own)
    flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def sketch(sets: np.ndarray, begins: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` values for each set (a power of two); rows of empty sets are without meaning."""
    rows = len(begins) - 1
    doc = np.repeat(np.arange(rows), np.diff(begins))
    cell = doc * slots + (sets & np.uint64(slots - 1)).astype(np.int64)
    value = sets >> np.uint64(int(slots).bit_length() - 1)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=bool)
    out = np.zeros(rows * slots, dtype=np.uint64)
    full = np.zeros(rows * slots, dtype=bool)
    out[cell[first]], full[cell[first]] = value[first], True
    empty = np.flatnonzero(~full)
    empty = empty[np.diff(begins)[empty // slots] > 0]
    base, slot = empty // slots * slots, (empty % slots).astype(np.uint64)
    attempt = 0
    while len(empty):
        attempt += 1
        h = blocks.mix(slot * blocks.MULTIPLIER + np.full(1, attempt, dtype=np.uint64) * blocks.MIXER)
        from_cell = base + (h & np.uint64(slots - 1)).astype(np.int64)
        hit = full[from_cell]
        out[empty[hit]] = out[from_cell[hit]]
        empty, base, slot = empty[~hit], base[~hit], slot[~hit]
    return out.reshape(rows, slots)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is in it."""
    docs, slots = sketches.shape
    bands = sketches.reshape(docs, slots // rows, rows)
    h = np.arange(slots // rows, dtype=np.uint64)[None, :] * blocks.MIXER + blocks.MULTIPLIER
    h = np.repeat(h, docs, axis=0)
    for k in range(rows):
        h = (h ^ bands[:, :, k]) * blocks.MULTIPLIER
        h ^= h >> np.uint64(30)
    return blocks.mix(h.reshape(-1)).reshape(docs, slots // rows).view(np.int64)


def signatures(documents: DataFrame, *, size: int, bands: int, rows: int) -> DataFrame:
    """Set size, a key that equal sets share, and band keys of each document (null for empty sets)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_buffer(batch.column("text"))
            for first, last in blocks.slices(offsets):
                lower = blocks.ASCII_LOWER[data[offsets[first] : offsets[last]]]
                sets, begins = shingle_sets(lower, offsets[first : last + 1] - offsets[first], size)
                keys = band_keys(sketch(sets, begins, bands * rows), rows)
                counts = np.diff(begins)
                digest = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(counts), pa.array(digest, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "bands"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNATURES)


def _confirm(edges: DataFrame, texts: DataFrame, *, size: int, share: tuple[int, int], group: int = 256) -> DataFrame:
    """The edges (a, b) whose full shingle sets have ``share[1]`` * intersection >= ``share[0]`` * union.

    ``texts`` (doc_id, text) has the documents of all edges. The texts of an edge's ends meet at its centre ``a``. A centre with many edges is dealt to as many tasks as groups of
    ``group`` members need; its own text goes to each.
    """
    large = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    salted = edges.join(store.cut(large, "large-stars"), "a", "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / group)), F.lit(0).cast("long")))
    salted = store.cut(salted.select("a", "salt", "b"), "salted-edges")
    ends = salted.unionByName(salted.select("a", "salt", F.col("a").alias("b")).distinct())
    met = ends.join(texts.hint("merge").withColumnRenamed("doc_id", "b"), "b").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"))
    need, of = share

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            data, offsets = blocks.text_buffer(batch.column("text"))
            left, right = [], []
            for first, last in blocks.slices(offsets):
                lower = blocks.ASCII_LOWER[data[offsets[first] : offsets[last]]]
                sets, begins = shingle_sets(lower, offsets[first : last + 1] - offsets[first], size)
                for k in range(first, last):
                    own = sets[begins[k - first] : begins[k - first + 1]]
                    if a[k] == b[k]:
                        key, centre = (a[k], salt[k]), own.copy()
                    elif (a[k], salt[k]) == key and len(own) and len(centre):
                        both = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum())
                        if of * both >= need * (len(own) + len(centre) - both):
                            left.append(a[k])
                            right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return met.select("a", "salt", "b", "text").mapInArrow(check, "a long, b long")


def _rare_prefixes(docs: DataFrame, *, size: int, share: tuple[int, int], slots: int = 18) -> DataFrame:
    """For each of ``docs`` (doc_id, component, text) the rarest shingles ``g`` that any similar set must share one of.

    Rarity is by counts of 2**slots classes of hashes, which are collected, and by the hash within a class. ``pos`` is
    the place in that order, ``n`` the size of the set.
    """
    need, of = share
    shift = np.uint64(64 - slots)

    def all_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
        for batch in batches:
            data, offsets = blocks.text_buffer(batch.column("text"))
            for first, last in blocks.slices(offsets):
                lower = blocks.ASCII_LOWER[data[offsets[first] : offsets[last]]]
                yield batch, first, last, *shingle_sets(lower, offsets[first : last + 1] - offsets[first], size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << slots, dtype=np.int64)
        for _, _, _, sets, _ in all_sets(batches):
            total += np.bincount((sets >> shift).astype(np.int64), minlength=1 << slots)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    counts = np.zeros(1 << slots, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.slot] = r.n
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, sets, begins in all_sets(batches):
            n = np.diff(begins)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((sets, shared.value[(sets >> shift).astype(np.int64)], doc))
            pos = np.arange(len(sets)) - begins[doc]
            inside = pos < (n + need * -n // of + 1)[doc]  # need * -n // of is -ceil(need * n / of)
            at = pa.array(doc[inside] + first)
            columns = [pa.array(sets[order][inside].view(np.int64)), batch.column("doc_id").take(at), batch.column("component").take(at), pa.array(n[doc[inside]]), pa.array(pos[inside])]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "doc_id", "component", "n", "pos"])

    return docs.select("doc_id", "component", "text").mapInArrow(rarest, "g long, doc_id long, component long, n long, pos long")


def _rest(docs: DataFrame, *, size: int, share: tuple[int, int], group: int = 256) -> DataFrame:
    """All pairs (a, b) of ``docs`` (doc_id, component, text) in different components that may be similar.

    None that is similar is left out. A shingle of many documents is dealt out: each pair of its blocks of about
    ``group`` documents is a key of its own.
    """
    need, of = share
    marks = store.cut(_rare_prefixes(docs, size=size, share=share), "prefixes")
    met = marks.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    met = store.cut(met.select("g", F.ceil(F.col("m") / group).alias("blocks")), "met-prefixes")
    marks = marks.join(met, "g").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    marks = store.cut(marks, "placed-prefixes")
    left = marks.select("g", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "component", "n", "pos")])
    right = marks.select("g", F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "component", "n", "pos")])
    alike = of * F.least("n_a", "n_b") >= need * F.greatest("n_a", "n_b")
    # enough is left of both sets behind the first shingle they share
    enough = (need + of) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need * (F.col("n_a") + F.col("n_b"))
    pairs = left.join(right.hint("merge"), ["g", "i", "j"]).where((F.col("component_a") != F.col("component_b")) & alike & enough)
    return pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def _with_labels(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links (a, b), with those that known components stand for."""
    return links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))


def near_duplicates(
    documents: DataFrame,
    *,
    size: int = 5,
    share: tuple[int, int] = (80, 100),
    bands: int = 32,
    rows: int = 4,
    stars: int = 1,
) -> DataFrame:
    """Per document (doc_id, text): n_shingles, component_id (smallest doc_id of its group) and kept (it is that one).

    ``size`` words make a shingle; documents are linked where share[1] * intersection >= share[0] * union. ``stars`` is
    how many stars a bucket may have, one after another, before the rest is settled exactly.
    """
    need, of = share
    signed = store.cut(signatures(documents, size=size, bands=bands, rows=rows), "signatures")
    whole = signed.where("set_key is not null and doc_id is not null")
    # one document for each set: copies never meet in a bucket
    classes = whole.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = store.cut(classes, "set-classes")
    keys = classes.select("doc_id", "n", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = store.cut(keys.join(store.cut(sizes, "buckets"), "bucket"), "bucket-members")
    meetings = store.cut(members.groupBy("doc_id").agg(F.sum(F.col("size") - 1).alias("meetings")), "meetings")
    members = store.cut(members.join(meetings, "doc_id").select("bucket", "doc_id", "n", "meetings"), "ranked-members")
    # the texts that edges may need, once: all documents are shuffled for them, the same way at every size
    needed = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = store.cut(needed.join(members.select("doc_id").distinct().hint("merge"), "doc_id"), "member-texts")
    tested = labels = None
    for turn in range(stars):
        placed = members.withColumn("component", F.col("doc_id"))
        if turn:
            members = members.join(labels, members["doc_id"] == labels["node"], "left").drop("node")
            placed = store.cut(members.withColumn("component", F.coalesce("component", "doc_id")), "placed-members")
            # buckets that hold several components still; a component is one row in them
            groups = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
            least = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("size", "component"))["component"].alias("smallest"))
            least = store.cut(least.where("groups > 1").select("bucket", "smallest"), "open-buckets")
            placed = placed.join(least, "bucket").withColumn("first", F.col("component") == F.col("smallest")).drop("smallest")
            placed = store.cut(placed, "open-members")
        else:
            placed = placed.withColumn("first", F.lit(True))
        rank = F.struct("meetings", (-F.col("doc_id")).alias("order"), "n", "component")
        centres = placed.where("first").groupBy("bucket").agg(F.max(rank).alias("c"))
        open_members = placed.join(store.cut(centres, "centres"), "bucket").where(F.col("doc_id") != -F.col("c.order"))
        # no set is similar to one that is much larger
        alike = of * F.least("n", "c.n") >= need * F.greatest("n", "c.n")
        edges = open_members.where((F.col("component") != F.col("c.component")) & alike).select((-F.col("c.order")).alias("a"), F.col("doc_id").alias("b")).distinct()
        if tested is not None:
            edges = edges.join(tested, ["a", "b"], "left_anti")
        edges = store.cut(edges, "candidate-edges")
        tested = edges if tested is None else tested.unionByName(edges)
        if edges.isEmpty():
            break
        found = store.cut(_confirm(edges, texts, size=size, share=share), "links")
        labels = store.cut(graph.components(_with_labels(found, labels)), "components")
        members = open_members.select("bucket", "doc_id", "n", "meetings")

    members = members.select("bucket", "doc_id")
    if labels is not None:
        members = members.join(labels, members["doc_id"] == labels["node"], "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    else:
        members = members.withColumn("component", F.col("doc_id"))
    members = store.cut(members, "last-members")
    unsettled = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    unsettled = store.cut(members.join(store.cut(unsettled, "last-buckets"), "bucket").select("doc_id", "component").distinct(), "unsettled")
    if not unsettled.isEmpty():
        edges = _rest(store.cut(texts.join(unsettled.hint("merge"), "doc_id"), "unsettled-texts"), size=size, share=share)
        edges = store.cut(edges.join(tested, ["a", "b"], "left_anti") if tested is not None else edges, "rest-edges")
        if not edges.isEmpty():
            found = store.cut(_confirm(edges, texts, size=size, share=share), "rest-links")
            labels = store.cut(graph.components(_with_labels(found, labels)), "rest-components")

    found = classes.select("set_key", "doc_id")
    if labels is not None:
        found = found.join(labels, found["doc_id"] == labels["node"], "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        found = found.select("set_key", F.col("doc_id").alias("component_id"))
    found = store.cut(found, "set-components")
    result = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
