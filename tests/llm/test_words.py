"""Merge-type pieces, spelling variants, the filter audit: against the library and brute force."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import filter_audit, pieces, queries, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  ", "▁", "a\u0000b", "\n\t", "x▁y", "é漢\U0001d11e", "<s>a</s><0x0A>"]


def encoded(texts):
    out = []
    for first, last, ids, begins in pieces.encode_texts(pa.array(texts, pa.string()), MODEL):
        out += [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
    return out


def test_pieces_are_the_librarys():
    rnd = random.Random(1)
    model = pieces.model_for(MODEL)
    vocabulary = list(model.ids)
    texts = ODD + ["".join(rnd.choice(" abcdehilnorstu▁\n\tABé漢\u0000.,'-019ж") for _ in range(rnd.randint(1, 60))) for _ in range(2_000)]
    texts += ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12))) for _ in range(2_000)]
    texts += ["a" * 70_001, " " * 30_000, "the" * 10_000, "é" * 9_000, "word and " * 60_000]
    assert encoded(texts) == [model.library.encode(t or "") for t in texts]


def test_backtracking_needs_no_cuts():
    model = pieces.model_for(MODEL)
    text = " Ovarieties of words, unseparable\u0000 and uncuttablyjoined  too " * 200
    ids = [model.ids.get(p) for p in model.split(text)]
    assert [k for k in ids if k is not None] == [k for k in model.library.encode(text[1:]) if k != model.byte_ids[0]]
    assert any(model.split("".join(x)) != [y for p in x for y in model.split(p)] for x in itertools.product([" th", "er", "e", "in"], repeat=3))  # pieces do depend on what follows


def test_piece_rows(spark):
    texts = [*ODD, "One text.  And\nmore", "One text.  And\nmore"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    library = pieces.model_for(MODEL).library
    for end, tail in ((2, [2]), (None, [])):
        rows = pieces.encode_documents(docs, MODEL, end_id=end)
        found = {r.doc_id: r for r in pieces.decode_documents(rows, MODEL).collect()}
        trip = {r.doc_id: r for r in pieces.round_trip(docs, MODEL, end_id=end).collect()}
        for k, text in enumerate(texts):
            ids = library.encode(text or "") + tail
            assert bytes(found[k].ids) == b"".join(x.to_bytes(4, "little") for x in ids) and found[k].text == library.decode(ids)
            assert (trip[k].n_tokens, trip[k].text) == (len(ids), found[k].text)
            assert trip[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode_documents(pieces.encode_documents(empty, MODEL), MODEL).count() == 0
    twice = spark.createDataFrame([(None, "a"), (7, "a"), (7, "a")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in pieces.encode_documents(twice, MODEL).collect()) == ["7", "7", "None"]


def test_op11(spark, tmp_path):
    texts = [*ODD, "One text.  And\nmore", "word " * 300_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = pieces.model_for(MODEL).library
    want = set()
    for k, text in enumerate(texts):
        ids = library.encode(text or "") + [2]
        want.add((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in queries.op11_pieces(spark, str(tmp_path)).collect()} == want


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out = set()
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aàéz÷", "漢字かな交じり文"])
def test_variants(spark, letters):
    rnd = random.Random(len(letters))
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))): rnd.choice([1, 2, 5, 9, 26, 140]) for _ in range(400)}
    chain = {"rootword": 5**4, "rootwrd": 5**3, "rootwr": 5**2, "rootr": 5, "root": 1}
    counts |= chain
    long = "longwords" * 9
    counts |= {long: 900, long[:40] + long[41:]: 9, long[:40] + "x" + long[41:]: 9, long[:30] + "x" + long[31:-1]: 3, "y" + long: 2, long[:-1]: 1}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("m0", F.lit("clash"))
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in spelling.group_variants(rows).select(*columns).collect()} == brute_variants(counts)


def test_variants_of_odd_tables(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    found = spelling.group_variants(spark.createDataFrame([(None, 5), ("x" * 200_000, 5), ("x" * 200_001, 25)], "word string, n long"))
    assert {(len(r.word), r.form and len(r.form), len(r.root), r.n_near) for r in found.collect()} == {(200_000, 200_001, 200_001, 1), (200_001, None, 200_001, 1)}


def test_op12(spark, tmp_path):
    rnd = random.Random(5)
    stems = ["colour", "colours", "favourite", "harbour", "ÉclairÉs", "straßeße", "organise", "ab", "kilometre"]
    edit = lambda w: w if rnd.random() < 0.7 else w[:3] + rnd.choice("xyz") + w[3 + rnd.randint(0, 1) :]
    texts = [" ".join(edit(rnd.choice(stems)).title() if rnd.random() < 0.2 else edit(rnd.choice(stems)) for _ in range(60)) + "Āx9" for _ in range(60)]
    texts += [None, "", "1 2", texts[0], "harbour-" * 60_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts: dict = {}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(upper)
            h = zlib.crc32(f"{k}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = queries.op12_spelling(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in found} == brute_variants(counts) and any(r.form for r in found)


def brute_audit(rows, labels):
    fails = []
    for k, text, source in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = k is not None and any(j is not None and j < k and (s or "") == t for j, s, _ in rows)
        fails.append((source or "", {x for x in f if f[x]}, labels.get(k, (0, 0))))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(f, lab) for p, f, lab in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                here = [(f, lab) for f, lab in own if not f & set(order[:step])]
                gone = [lab for f, lab in here if x in f]
                out[part, "".join(order), step + 1] = [len(here) - len(gone), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == {x} for f, _ in own), sum(q == 1 for q, _ in gone), sum(t == 1 for _, t in gone)]
    for key in list(out):
        part, order, step = key
        out[key].append(sum(out[part, "".join(o), o.index(order[step - 1]) + 1][1] for o in itertools.permutations("ABCDE")))
    return {(*k, *v) for k, v in out.items()}


def test_audit(spark):
    rnd = random.Random(7)
    some = ["word", "Word", "WORD", "other", "new", "x#y", "é漢", "a|b"]
    pool = [" ".join(rnd.choice([*some, f"u{rnd.randint(0, 900)}"]) for _ in range(rnd.choice([3, 150, 210, 400]))) for _ in range(25)]
    long = "abc def " * 9_000
    pool += ["", None, " ", " ", long, long[:-2] + "x ", "x" + long[1:], "a" * 256, "a" * 255 + "b", "a" * 257]
    rows = [(k, rnd.choice(pool), rnd.choice(["web", "news", None, ""])) for k in range(200)] + [(None, pool[0], "web"), (5, pool[0], "web"), (5, pool[0], "web"), (0, "alone", "only")]
    labels = {k: (rnd.randint(0, 1), rnd.randint(0, 1)) for k in range(0, 200, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("class", F.lit("clash")).withColumn("c0", F.lit(1)).withColumn("mask", F.lit(0))
    marks = spark.createDataFrame([(k, q, t) for k, (q, t) in labels.items()] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in filter_audit.audit(docs, marks).collect()} == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0


def test_texts_of_one_class_are_compared(spark, monkeypatch):
    rows = [(k, f"text {k % 3}") for k in range(12)] + [(20, None), (21, ""), (22, "text 10")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: any(j < k and (t or "") == (s or "") for j, s in rows) for k, t in rows}
    found = filter_audit.mark_duplicates(docs, {"n": F.length("text")})
    assert {r.doc_id: r.duplicate for r in found.collect()} == want
    monkeypatch.setattr(filter_audit, "class_columns", lambda text: [F.lit(1).cast("long").alias("c0"), *[F.lit(None).cast("long").alias(f"c{k}") for k in range(1, 8)]])
    assert {r.doc_id: r.duplicate for r in filter_audit.mark_duplicates(docs, {"n": F.length("text")}).collect()} == want  # all in one class
