"""The pipeline's stages on a small table."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages(spark):
    rnd_text = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 500 and 2000").orderBy("doc_id").limit(30)
    docs = rnd_text.unionByName(rnd_text.limit(3).withColumn("doc_id", rnd_text["doc_id"] + 1_000_000))
    n = docs.count()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == list(corpus_pipeline.DOCUMENTS)
        kept = corpus_pipeline.store.cut(kept, "test-stage")
    assert 0 < kept.count() <= n - 3
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_rows_that_repeat_and_null_ids(spark):
    import random

    text = lambda seed: " ".join(f"w{random.Random(seed * 1000 + k).randint(0, 99999)}" for k in range(80))
    bad = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    rows = [(1, text(1)), (1, text(1)), (None, text(2)), (None, text(2)), (None, text(1))]  # rows that repeat
    rows += [(3, text(3)), (4, text(3)), (4, text(4))]  # doc_id 4 is a copy and a text of its own
    rows += [(None, bad), (5, bad + " more"), (5, text(5)), (None, text(6)), (6, None), (6, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    once = corpus_pipeline.store.cut(once, "test-once")
    assert sorted(((r.doc_id, r.text) for r in once.where("n_chars > 0 and not contains(text, 'more')").collect() if r.text != bad), key=repr) == sorted(
        [(1, text(1)), (None, text(2)), (3, text(3)), (4, text(4)), (5, text(5)), (None, text(6))], key=repr
    )
    kept = corpus_pipeline.store.cut(corpus_pipeline.remove_repeats(spark, once, SF), "test-kept")
    assert {text(k) for k in range(1, 7)} <= {r.text for r in kept.collect()}
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=repr) == sorted((x for x in rows if not (x[1] or "").startswith(bad)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    english, french = "the cat and the dog sat on the mat in the house of ", "le chat et le chien sont dans la maison avec une souris de "
    long = " ".join(english + word() if k % 2 else word() + " and " + word() for k in range(130_000))
    assert len(long) > 5_000_000
    rows = [(1, english * 9 + word(), "en", None, None), (2, french * 9 + word(), "fr", "web", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n", None, "s", 2)]
    rows += [(None, None, None, None, None), (None, "the dog and a cat in that old house " + " ".join(word() for _ in range(9)), None, None, 7), (8, long, "en", "s", len(long)), (9, english + word(), "en", "s", 1)]
    rows += [rows[-1], rows[-1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "component", "kept", "lang_pred", "h", "length", "anchors"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = [r.asDict() for r in stage(spark, docs, SF).collect()]
    assert stage(spark, docs.limit(0), SF).count() == 0
    if stage is corpus_pipeline.pack:
        assert {r["doc_id"] for r in found} == {r[0] for r in rows} and all(r["length"] <= 4096 for r in found)
        assert sum(r["start"] == 0 for r in found) == len(rows)
        return
    assert all(tuple(r) == corpus_pipeline.DOCUMENTS for r in found)
    left = sorted((repr((r["doc_id"], r["text"])) for r in found))
    given = sorted(repr((k, t)) for k, t, *_ in rows)
    if stage is corpus_pipeline.identify_language:
        assert left == sorted(repr((k, t)) for k, t, *_ in rows if (t or "").strip())
        assert {r["doc_id"]: r["lang"] for r in found}[8] == "en"
    elif stage is corpus_pipeline.drop_near_duplicates:
        assert left == sorted([*set(given) - {repr((None, None)), repr((3, None))}, repr((None, None)), repr((3, None))])
    elif stage is corpus_pipeline.drop_contaminated:
        assert left == given
    else:
        assert {(3, None), (4, ""), (None, None)} <= {(r["doc_id"], r["text"]) for r in found}
        assert any(r["doc_id"] == 8 for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_leave_only_what_their_result_reads(spark):
    store = corpus_pipeline.store
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared = store.shared_dir(spark)
    tables = lambda: {x.rpartition("-")[0] for x in set(os.listdir(shared)) - before}
    left = [set(), {"near-duplicate-rows", "near-duplicates"}, {"removed-spans"}, {"decontamination-rows", "contaminated"}]
    for (_, stage), names in zip(corpus_pipeline.STAGES[1:-1], left[1:], strict=True):
        before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
        found = stage(spark, docs, SF)
        assert tables() == names
        assert found.count() > 0
    before = set(os.listdir(shared))
    packed = corpus_pipeline.run(spark, SF)
    assert tables() == {"benchmark-decontamination", "pieces"}  # the result reads pieces, which came from the last stage
    assert packed.count() > 0
