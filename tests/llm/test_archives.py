"""WARC archives and token files: exact round trips, and brute force."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import blocks, huffman, store, tokens, warc

PAGES = "page_id long, url string, html string"


def archived(spark, rows, **more):
    root = store.fresh_dir(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES).withColumn("shard", F.lit("clash")), root, **more)
    return root


def test_warc_round_trip(spark):
    same = "x" * 100
    rows = [(3, "http://a/é?x=1%20", same), (1, None, same), (2, "http://b", "short"), (4, "http://c", "short"), (5, "", None), (None, "u\r\nX: y", same), (1, None, same), (6, "h", "é" * 60)]
    found = [tuple(r) for r in warc.read_warc(spark, archived(spark, rows, shard_bytes=150, file_bytes=400)).collect()]
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r[0], []).append(r)
    digest = hashlib.sha256(same.encode()).hexdigest()
    assert by_id[3][0][1:5] == (100, digest, "revisit", 1) and by_id[3][0][5] == "http://a/é?x=1%20" and by_id[3][0][6] is None
    assert [r[3] for r in by_id[1]] == ["response", "response"] and bytes(by_id[1][0][6]) == same.encode()
    assert by_id[None][0][3:5] == ("revisit", 1) and by_id[None][0][5] == "u\r\nX: y"
    assert [by_id[k][0][3] for k in (2, 4)] == ["response", "response"]
    assert by_id[5][0][1] == 0 and by_id[6][0][1] == 120


def test_warc_bytes_do_not_depend_on_partitions(spark):
    rows = [(k, f"http://x/{k}", f"page {k} " * 20) for k in range(200)]
    digests = []
    for n in (1, 7):
        root = store.fresh_dir(spark, "test-warc")
        warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(n), root, shard_bytes=4_000, file_bytes=1_500)
        names = sorted(r.name for r in store.read_manifest(spark, root).collect())
        digests.append([(n, hashlib.sha256(open(f"{root}/{n}", "rb").read()).hexdigest()) for n in names])
    assert digests[0] == digests[1] and len(digests[0]) > 3


def test_warc_of_nothing(spark):
    assert warc.read_warc(spark, archived(spark, [])).count() == 0


def test_warc_finds_damage(spark):
    root = archived(spark, [(1, "u", "x" * 200)])
    name = store.read_manifest(spark, root).first().name
    data = open(f"{root}/{name}", "rb").read()
    with pytest.raises((ValueError, zlib.error)):
        import io

        list(warc.read_records(io.BytesIO(data[:-20])))


@given(st.lists(st.integers(0, 1_000_000), max_size=300), st.integers(9, 16))
def test_code_lengths_make_a_prefix_code(counts, bits):
    counts = np.array(counts, dtype=np.int64)
    lengths = huffman.code_lengths(counts, bits)
    assert ((lengths > 0) == (counts > 0)).all() and (lengths <= bits).all()
    used = lengths[lengths > 0].astype(int)
    assert len(used) < 2 or (2.0**-used).sum() == 1.0


def test_code_lengths_are_best():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1])
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 16) * counts).sum()) == cost


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=700), max_size=12), st.sampled_from([300, 1000]))
def test_file_round_trip(docs, block):
    import io

    docs = [(None if k == 0 else k, np.array(d, dtype=np.uint32)) for k, d in enumerate(docs)]
    counts = np.bincount(np.concatenate([d for _, d in docs] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=1)
    lengths = huffman.code_lengths(counts, 16)
    out = io.BytesIO()
    huffman.write_file(out, iter(docs), lengths, huffman.canonical_codes(lengths), block=block)
    out.seek(0)
    found = []
    for doc_id, ids, more in huffman.read_file(out):
        if more:
            found[-1][1].extend(ids.tolist())
        else:
            found.append((doc_id, ids.tolist()))
    assert found == [(k, d.tolist()) for k, d in docs]


TEXTS = ["a'b 's 'S don't it's, 'stone.'s", "É≮ é Σας \x1c\x85x <|endoftext|>!", "foo.bar,baz!!'s ..'t 12a3b4.5c", "", None, "\n\t ", "The the THE, the. " * 50, "́a .́b İstanbul"]


def test_pieces_give_the_tokenizers_ids():
    import pyarrow as pa

    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    found = [ids[b[k] : b[k + 1]].tolist() for first, last, ids, b in tokens.encode_texts(pa.array(TEXTS), path) for k in range(last - first)]
    whole = tokens.cache_for(path).tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
    assert found == [e.ids for e in whole]


def test_token_files(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    rows = [(k * 7 % 11, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (3, "same"), (3, "same")]
    root = store.fresh_dir(spark, "test-tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    huffman.write_token_files(docs, root, path, end_id=2, id_bytes=2, file_ids=40)
    tokenizer = tokens.cache_for(path).tokenizer
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = huffman.read_token_files(spark, root)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert sum(len(r.ids) for r in found.collect()) == 4 * start
    empty = store.fresh_dir(spark, "test-tokens")
    huffman.write_token_files(docs.limit(0), empty, path)
    assert huffman.read_token_files(spark, empty).count() == 0


def test_pieces_with_one_hash_keep_their_own_ids(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    cache = tokens.PieceCache(public.path("word_bpe_49k.json"))
    morse = "a"
    for _ in range(11):  # a polynomial modulo 2**64 takes such a word and its complement for one
        morse += morse.translate(str.maketrans("ab", "ba"))
    texts = [morse, morse.translate(str.maketrans("ab", "ba")), "some longwords anotherone", "", "longwords differentone"]
    column = pa.array(texts)

    def ids():
        data, offsets = blocks.text_buffer(column)
        flat, begins = cache.encode(data, offsets)
        return [flat[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]

    want = [cache.whole(t).tolist() for t in texts]
    assert ids() == want
    monkeypatch.setattr(blocks, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    cache.clear()
    assert ids() == ids() == want
