"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). As a set of word pairs, a
window lies in a document only if all its pairs do, so its prefix is one pair: the rarest in all documents. Documents
look up their pairs among the prefixes; a hit gives the place of the window, position and length bounds drop places
that run over either end of the text, and the words that stand there are then compared with the window's, by hash and
then letter by letter.

Up to ``broadcast_windows`` windows, by a check of the benchmark's length, the index of prefixes goes to the tasks: one
pass over the documents to count pairs and one to search, and no document is shuffled. A larger benchmark stays a
table. Documents then send only pairs that are in a bitmap of the prefixes, each with the words around it, and these are
joined with the windows; pairs with more than a share of all candidates are salted. Both ways give the same rows.

Defined results: null text or a text without words has no words, no hits, and is not contaminated; an item without
words has no windows; repeated item_ids count as one item, repeated windows are found for all their items; an empty
benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import blocks, store

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range, lower-cased bytes, starts, ends, hashes of words, and words before each row."""
    data, offsets = blocks.text_buffer(column)
    for first, last in blocks.slices(offsets):
        lower = blocks.ASCII_LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, before = blocks.word_spans(lower, offsets[first : last + 1] - offsets[first], blocks.ALNUM)
        yield first, last, lower, starts, ends, blocks.word_hashes(lower, starts, ends), before


class Windows:
    """The windows of benchmark items: their words, the hashes of these, and the items of each.

    A window's words are ``words[at : at + size]``; ``letters`` from ``starts`` to ``ends`` spells each word.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[bytes, tuple[int, int, set[str]]] = {}
        letters, spans, hashes, n_words = [], [], [], 0
        for item, text in items:
            for _, _, lower, starts, ends, own, _ in _words(pa.array([text], pa.string())):
                raw = lower.tobytes()
                spelled = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                size = min(window, len(own))
                for k in range(len(own) - size + 1 if size else 0):
                    found.setdefault(b" ".join(spelled[k : k + size]), (n_words + k, size, set()))[2].add(item)
                letters += spelled
                spans.append(ends - starts)
                hashes.append(own)
                n_words += len(own)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.letters = np.frombuffer(b"".join(letters), dtype=np.uint8)
        self.ends = np.cumsum(joined(spans, np.int64))
        self.starts = self.ends - joined(spans, np.int64)
        self.hashes = joined(hashes, np.uint64)
        self.at = np.array([at for at, _, _ in found.values()] or [0], dtype=np.int64)
        self.sizes = np.array([size for _, size, _ in found.values()] or [0], dtype=np.int64)
        self.words = [self.hashes[at : at + size] for at, size, _ in found.values()]
        self.items = [sorted(x) for _, _, x in found.values()]

    def pairs(self) -> np.ndarray:
        """All pairs of all windows of two words or more, and the words of the others."""
        return np.unique(np.concatenate([_prefixes(w) for w in self.words])) if self.words else np.zeros(0, dtype=np.uint64)

    def index(self, counts: dict[int, int]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Sorted prefix hashes, and for each the (window, place in the window) that have it."""
        prefixes: dict[int, list[tuple[int, int]]] = {}
        for n, words in enumerate(self.words):
            own = _prefixes(words).tolist()
            at = min(range(len(own)), key=lambda k: (counts.get(own[k], 0), k))
            if counts.get(own[at], 0):  # a pair that no document has: no document has the window
                prefixes.setdefault(own[at], []).append((n, at))
        keys = np.array(sorted(prefixes), dtype=np.uint64)
        return keys, [prefixes[k] for k in keys.tolist()]


def _prefixes(words: np.ndarray) -> np.ndarray:
    return blocks.shingle_hashes(words, 2) if len(words) > 1 else _single(words)


def _single(words: np.ndarray) -> np.ndarray:
    return blocks.mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _find(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``hashes`` that are in the sorted ``keys``, and where in ``keys``.

    A bitmap of 2**20 buckets, taken from the hash's high bits, lets most hashes by without a search.
    """
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    shift = np.uint64(44)
    there = np.zeros(1 << 20, dtype=bool)
    there[keys >> shift] = True
    maybe = np.flatnonzero(there[hashes >> shift])
    at = np.searchsorted(keys, hashes[maybe])
    same = keys[np.minimum(at, len(keys) - 1)] == hashes[maybe]
    return maybe[same], at[same]


def count_pairs(documents: DataFrame, pairs: np.ndarray) -> dict[int, int]:
    """How often each of the sorted benchmark ``pairs`` occurs in all documents; at most as many rows as pairs come back."""
    shared = documents.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        counts = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for _, _, _, _, _, hashes, _ in _words(batch.column("text")):
                for found in (blocks.shingle_hashes(hashes, 2), _single(hashes)):
                    _, at = _find(keys, found)
                    counts += np.bincount(at, minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], names=["pair", "n"])

    rows = documents.select(F.col("text").cast("string")).mapInArrow(count, "pair long, n long")
    return {r.pair % (1 << 64): r.n for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def _search(documents: DataFrame, windows: Windows, counts: dict[int, int]) -> DataFrame:
    """One pass: per document n_words, the words inside windows and the items found."""
    keys, places = windows.index(counts)
    lists = np.array([len(x) for x in places], dtype=np.int64)
    flat = np.array([x for each in places for x in each], dtype=np.int64).reshape(-1, 2)
    shared = documents.sparkSession.sparkContext.broadcast((keys, lists, np.cumsum(lists) - lists, flat, (windows.at, windows.sizes, windows.hashes, windows.letters, windows.starts, windows.ends), windows.items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lists, firsts, flat, (at_word, sizes, known, letters, spelled, spelled_end), items = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, lower, starts, ends, hashes, before in _words(batch.column("text")):
                depth = np.zeros(len(hashes) + 1, dtype=np.int64)
                met: list[np.ndarray] = []
                for found in (blocks.shingle_hashes(hashes, 2), _single(hashes)):
                    where, at = _find(keys, found)
                    window, place = flat[blocks.ragged(firsts[at], lists[at])].T
                    begin = np.repeat(where, lists[at]) - place
                    doc = np.repeat(np.searchsorted(before, where, side="right") - 1, lists[at])
                    inside = (begin >= before[doc]) & (begin + sizes[window] <= before[doc + 1])
                    begin, window, doc = begin[inside], window[inside], doc[inside]
                    for k in range(int(sizes.max())):
                        more = np.flatnonzero(sizes[window] > k)
                        own, other = begin[more] + k, at_word[window[more]] + k
                        same = np.ones(len(window), dtype=bool)
                        # by hash, length, and then letter by letter
                        same[more] = (hashes[own] == known[other]) & (ends[own] - starts[own] == spelled_end[other] - spelled[other])
                        more = same[more]
                        own, other = own[more], other[more]
                        sure = blocks.same_bytes(lower, starts[own], ends[own], letters, spelled[other])
                        same[np.flatnonzero(same & (sizes[window] > k))] = sure
                        begin, window, doc = begin[same], window[same], doc[same]
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + sizes[window], -1)
                    met.append(np.unique(doc * len(sizes) + window))
                names: list[set[str]] = [set() for _ in range(last - first)]
                for pair in np.concatenate(met).tolist():
                    names[pair // len(sizes)].update(items[pair % len(sizes)])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
                columns = [ids.slice(first, last - first), pa.array(np.diff(before).astype(np.int64)), pa.array(np.diff(covered[before])), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items"])

    return documents.mapInArrow(search, RESULT)


def _item_windows(items: DataFrame, window: int, chunk: int = 4_096) -> DataFrame:
    """A row for each window of each item: its words, joined by spaces, how many they are, and its pairs in order."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for first, last, lower, starts, ends, hashes, before in _words(batch.column("text")):
                raw = lower.tobytes()
                for k in range(last - first):
                    low, high = int(before[k]), int(before[k + 1])
                    size = min(window, high - low)
                    if not size:
                        continue
                    words = [raw[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                    pairs = _prefixes(hashes[low:high]).view(np.int64) if size > 1 else _single(hashes[low:high]).view(np.int64)
                    width = max(size - 1, 1)
                    for at in range(0, len(words) - size + 1, chunk):
                        n = min(chunk, len(words) - size + 1 - at)
                        own = np.lib.stride_tricks.sliding_window_view(pairs[at : at + n - 1 + width], width)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(own.reshape(-1)))
                        text = pa.array([b" ".join(words[j : j + size]).decode() for j in range(at, at + n)], pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([ids[first + k]] * n, pa.string()), text, pa.array([size] * n, pa.int32()), lists], names=["item_id", "words", "size", "pairs"])

    return items.mapInArrow(spell, "item_id string, words string, size int, pairs array<long>")


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**``bits`` bits, as bytes, with that of each pair set; its size does not grow with the table."""
    slot = F.shiftrightunsigned("pair", 64 - bits) + 1
    parts = pairs.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << max(bits - 3, 12), dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[(r.part - 1) << 12 : r.part << 12] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _maybe(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    slot = hashes >> np.uint64(64 - bits)
    return np.flatnonzero((bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)


def _join(documents: DataFrame, items: DataFrame, window: int, *, bits: int = 27, parts: int = 256) -> DataFrame:
    """The search as joins, for a benchmark of any size: 2**``bits`` bits and under ``parts`` hot pairs reach the driver.

    Hits are kept by the digest of a text, so equal texts share theirs.
    """
    context = documents.sparkSession.sparkContext
    docs = documents.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    spelled = store.cut(_item_windows(items, window), "benchmark-windows")
    windows = spelled.groupBy("words").agg(F.first("size").alias("size"), F.first("pairs").alias("pairs"))
    marks = store.cut(windows.select("words", "size", F.posexplode("pairs").alias("place", "pair")), "window-pairs")
    known = context.broadcast(_bitmap(marks.select("pair"), bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, _, hashes, _ in _words(batch.column("text")):
                every = np.concatenate([blocks.shingle_hashes(hashes, 2), _single(hashes)])
                pair, n = np.unique(every[_maybe(known.value, every, bits)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

    counts = store.cut(docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "pair", "size")).alias("p")
    # a pair that no document has: no document has the window
    prefixes = store.cut(marks.join(counts, "pair", "left").groupBy("words").agg(rarest).where("p.n > 0").select("words", "p.*"), "window-prefixes")
    rare = prefixes.groupBy("pair").agg(F.first("n").alias("n"))
    total = rare.agg(F.sum("n").alias("n")).first().n or 1
    salts = F.ceil(F.col("n") * parts / F.lit(total))
    hot = {r.pair % (1 << 64): r.salts for r in rare.where(salts > 1).select("pair", salts.alias("salts")).collect()}
    shared = context.broadcast((_bitmap(prefixes.select("pair"), bits), np.array(sorted(hot), dtype=np.uint64), np.array([hot[k] for k in sorted(hot)], dtype=np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, often, ways = shared.value
        for batch in batches:
            texts = batch.column("key")
            for first, _, lower, starts, ends, hashes, before in _words(batch.column("text")):
                raw = lower.tobytes()
                for found in (blocks.shingle_hashes(hashes, 2), _single(hashes)):
                    where = _maybe(bitmap, found, bits)
                    salt = np.zeros(len(where), dtype=np.int64)
                    some, at = _find(often, found[where])
                    salt[some] = where[some] % ways[at]
                    doc = np.searchsorted(before, where, side="right") - 1
                    low, high = np.maximum(before[doc], where - window + 1), np.minimum(before[doc + 1], where + window)
                    for k in range(0, len(where), 4_096):
                        part = slice(k, k + 4_096)
                        around = [b" ".join([raw[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]).decode() for i, j in zip(low[part].tolist(), high[part].tolist(), strict=True)]
                        columns = [pa.array(found[where[part]].view(np.int64)), pa.array(salt[part]), texts.take(pa.array(doc[part] + first)), pa.array((where - before[doc])[part]), pa.array((where - low)[part]), pa.array(around, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["pair", "salt", "key", "at", "ahead", "around"])

    candidates = docs.select("key", "text").mapInArrow(place, "pair long, salt long, key string, at long, ahead long, around string")
    dealt = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1)))
    words = F.split("around", " ")
    inside = (F.col("ahead") >= F.col("place")) & (F.col("ahead") - F.col("place") + F.col("size") <= F.size(words))
    stands = F.array_join(F.slice(words, (F.col("ahead") - F.col("place") + 1).cast("int"), F.col("size")), " ") == F.col("words")
    hits = candidates.join(dealt, ["pair", "salt"]).where(F.when(inside, stands).otherwise(False))
    hits = store.cut(hits.select("key", (F.col("at") - F.col("place")).alias("begin"), "size", "words").distinct(), "window-hits")
    n_hit = hits.select("key", F.explode(F.expr("sequence(begin, begin + size - 1)")).alias("word")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = hits.select("key", "words").distinct().join(spelled.select("words", "item_id").distinct(), "words")
    names = names.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    def total_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _, _, _, before in _words(batch.column("text")):
                columns = [batch.column(c).slice(first, last - first) for c in ("doc_id", "key")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(before).astype(np.int64))], names=["doc_id", "key", "n_words"])

    rows = docs.mapInArrow(total_words, "doc_id long, key string, n_words long")
    found = rows.join(store.cut(n_hit.join(names, "key"), "contaminated-texts"), "key", "left")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    broadcast_windows: int = 1_000_000,
) -> DataFrame:
    """For each document (doc_id, text): n_words, n_hit (words inside an occurrence of a window), items (sorted ids).

    ``benchmark`` has item_id and text. Up to ``broadcast_windows`` windows are broadcast, 13 hashes each; more are joined.
    """
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    size = items.select(F.sum(F.length("text")).alias("n")).first().n or 0
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if size > 2 * broadcast_windows:  # a word has two characters at least, with its space
        return _join(docs, items, window)
    windows = Windows([(r.item_id, r.text) for r in items.collect()], window)
    return _search(docs, windows, count_pairs(docs, windows.pairs()))


def digest_items(items) -> F.Column:
    """Lower-case hex SHA-256 of sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def contaminated(n_hit, n_words, *, least_share: int = 20):
    """True where at least 1 / ``least_share`` of the words are hit."""
    return (n_hit > 0) & (F.lit(least_share) * n_hit >= n_words)
