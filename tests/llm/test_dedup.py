"""Near duplicates, repeated passages, decontamination, packing: against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontam, graph, minhash, packing, suffix_dedup

DOCS = "doc_id long, text string"


def words(rnd, n):
    return " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 60)) for _ in range(n))


def brute_groups(rows, size):
    sets = {}
    for k, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    group = {k: k for k, _ in rows}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a1, b1 = sorted((find(a), find(b)))
                group[b1] = a1
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rnd = random.Random(size)
    base = [words(rnd, n) for n in (3, 12, 60, 200, 400)]
    rows = []
    for k in range(90):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 5)}"
        rows.append((k, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "one"), (94, "ONE"), (95, words(rnd, 30))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("bands", F.lit("clash"))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size=size).collect()}
    assert found == brute_groups(rows, size)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), size=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(1, 5, 1, True), (1, 5, 1, True), (None, 5, None, True), (2, 0, 2, True)], key=repr)


@pytest.mark.parametrize("stars", [0, 3])
def test_groups_that_stars_leave_open(spark, stars):
    rnd = random.Random(3)
    template, rows = words(rnd, 100).split(" "), []
    for k in range(60):  # two alike each time; all share a template, so that buckets are large
        own = [w if rnd.random() < 0.94 else f"g{k}x{i}" for i, w in enumerate(template)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:40], f"y{k}", *own[41:]]))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), size=2, stars=stars).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_groups(rows, 2)


def test_rest_leaves_no_similar_pair_out(spark):
    rnd = random.Random(3)
    template, rows = words(rnd, 100).split(" "), []
    for k in range(90):
        rows.append((k, " ".join(w if rnd.random() < 0.95 else f"g{rnd.randint(0, 9)}x{i}" for i, w in enumerate(template))))
    sets = {k: set(zip(t.split(" "), t.split(" ")[1:], strict=False)) for k, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame([(k, k, t) for k, t in rows], "doc_id long, component long, text string")
    for group in (7, 256):
        pairs = {(r.a, r.b) for r in minhash._rest(docs, size=2, share=(80, 100), group=group).collect()}
        assert alike and alike <= pairs


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 50)], "a long, b long")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 50: 50, 60: 50}


def brute_spans(rows, length):
    seen = {}
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages():
    rnd = random.Random(3)
    shared = [words(rnd, n) for n in (60, 45, 80, 200)]
    rows = [(k, words(rnd, rnd.randint(0, 60)) + rnd.choice(["", *shared]) + words(rnd, rnd.randint(0, 40)) + rnd.choice(["", "", shared[0][50:]])) for k in range(60)]
    rows += [(60, "ab" * 400), (61, "x" * 199), (62, "x" * 200), (63, "y" * 201), (64, None), (65, ""), (66, shared[3]), (66, shared[3]), (67, "é" * 150 + "ü" + "é" * 99)]
    return rows


def test_removed_spans(spark):
    rows = passages()
    docs = spark.createDataFrame(rows, DOCS).withColumn("anchors", F.lit("clash"))
    found = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.removed_spans(docs).collect()), key=repr)
    assert found == brute_spans(rows, 200)
    assert suffix_dedup.removed_spans(docs.limit(0)).count() == 0


def test_salted_buckets_find_the_same(spark):
    docs = spark.createDataFrame(passages(), DOCS)
    rows = lambda n: sorted((bytes(r.h), r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.find_repeats(docs, bucket_runs=n).select("h", F.coalesce("n_removed", F.lit(-1)).alias("n_removed"), "n_spans", "kept").collect())
    assert rows(2) == rows(4096)


def brute_hits(rows, items, window):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    known = {}
    for item, text in items:
        w = find(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for k, text in rows:
        w, hit, met = find(text), set(), set()
        for n in {len(x) for x in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    met |= known[tuple(w[i : i + n])]
        out.append((k, len(w), len(hit), tuple(sorted(met))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_contamination(spark, block):
    rnd = random.Random(5)
    items = [(k, words(rnd, n)) for k, n in enumerate((5, 13, 14, 30, 60, 1, 2))] + [(7, None), (8, "!?"), (9, "same a b"), (10, "Same, A b")]
    texts = [t for _, t in items if t]
    rows = [(k, words(rnd, rnd.randint(0, 30)) + " " + rnd.choice(texts)[rnd.randint(0, 9) :] + " - " + rnd.choice(texts).upper() + " " + words(rnd, 9)) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "x"), (63, texts[0]), (63, texts[0])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(docs, bench, broadcast_windows=block)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()), key=repr) == brute_hits(rows, items, 13)
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontam.find_contamination(docs, bench.limit(0)).collect())


def test_plan_gives_each_length_its_slots():
    rnd = random.Random(1)
    for _ in range(30):
        capacity = rnd.choice([10, 64])
        histogram = {rnd.randint(1, capacity): rnd.randint(1, 50) for _ in range(rnd.randint(1, 12))}
        given = {}
        used = {}
        for length, first, count, each, sequence, offset in packing.plan(histogram, capacity):
            assert first == given.get(length, 0)
            given[length] = first + count
            for k in range(count):
                used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        assert given == histogram
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(n * c for n, c in histogram.items())
        assert -(-total // capacity) <= len(used) <= 11 / 9 * -(-total // capacity) + 1 + max(histogram.values())


def test_packed_documents(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    rows = [(k, words(random.Random(k), k * 3 % 40)) for k in range(50)] + [(50, None), (51, ""), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash"))
    found = packing.pack_documents(docs, path, capacity=64).collect()
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 64
    assert {r.doc_id for r in found} == {k for k, _ in rows}
    whole = packing.sequences(packing.pack(packing.pieces(docs, path, capacity=64), capacity=64)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in found) and len(whole) == len(places)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_texts_that_repeat_themselves(spark):
    rnd = random.Random(8)
    period = words(rnd, 30)
    rows = [(1, "ab" * 3_000), (2, period * 60), (3, "x" + "ab" * 500 + words(rnd, 50)), (4, period * 3 + words(rnd, 90)), (None, words(rnd, 80)), (None, "ab" * 200)]
    docs = spark.createDataFrame(rows, DOCS)
    for runs in (4, 4_096):
        found = suffix_dedup.find_repeats(docs, bucket_runs=runs).select("h", F.coalesce("n_removed", F.lit(-1)), "n_spans", F.sha2("kept", 256)).collect()
        if runs == 4:
            want = sorted(map(repr, found))
    assert want == sorted(map(repr, found))
    found = suffix_dedup.removed_spans(docs)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found.collect()), key=repr) == brute_spans(rows, 200)
    pieces = suffix_dedup.runs(*suffix_dedup.blocks.text_buffer(__import__("pyarrow").array(["ab" * 500_000])), 200)[0]
    assert max(b - a for a, b in zip(pieces[:-1], pieces[1:], strict=True)) <= suffix_dedup.LONGEST
    with pytest.raises(ValueError):
        suffix_dedup.find_repeats(docs, length=117)


@pytest.mark.parametrize("length", [118, 131, 200])
def test_other_lengths(spark, length):
    rows = passages()[:40]
    found = suffix_dedup.removed_spans(spark.createDataFrame(rows, DOCS), length=length)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found.collect()), key=repr) == brute_spans(rows, length)


def test_words_with_one_hash_are_not_one(spark, monkeypatch):
    monkeypatch.setattr(decontam.blocks, "word_hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    windows = decontam.Windows([("a", "one two six"), ("b", "ten one two"), ("c", "one two six")], 2)
    assert sorted(map(tuple, windows.items)) == [("a", "b", "c"), ("a", "c"), ("b",)]
    data = decontam.blocks.text_buffer(__import__("pyarrow").array(["one two ten"]))[0]
    at = decontam.np.array([0, 4, 8])
    assert decontam.blocks.same_bytes(data, at, at + 3, data, decontam.np.array([0, 4, 4])).tolist() == [True, True, False]


def test_plan_is_best_fit_over_documents():
    rnd = random.Random(12)
    for _ in range(40):
        capacity = rnd.choice([10, 64, 100])
        histogram = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(1, 15))}
        rooms = []  # document by document, longest first: the fullest sequence with room
        for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= length]
            if fits:
                best = min(fits, key=lambda k: rooms[k])
                rooms[best] -= length
            else:
                rooms.append(capacity - length)
        used = {sequence + k // each for _, _, count, each, sequence, _ in packing.plan(histogram, capacity) for k in range(count)}
        assert len(used) == len(rooms)


def test_packed_pieces_are_those_of_the_tokenizer(spark):
    import zlib

    import numpy as np

    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    tokenizer = __import__("tokenizers").Tokenizer.from_file(path)
    rows = [(k, words(random.Random(k), k * 7 % 90)) for k in range(30)] + [(50, None), (51, ""), (52, "long words " * 60_000)]
    want = []
    for k, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(k, n, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    found = packing.pack_documents(spark.createDataFrame(rows, DOCS), path, capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
