"""Operators on small tables: empty ones, nulls, ties, repeated rows, extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.jobs import workloads as W
from quillspark.operators import answers as AN
from quillspark.operators import chunks as C
from quillspark.operators import documents as D
from quillspark.operators import retrieval as R
from quillspark.operators import stats as S
from quillspark.sources import documents as SRC


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"# A\r\nx")
    (tmp_path / "sub" / "b.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.txt").write_text("no")
    found = {r.path.rsplit("/", 1)[-1]: r.content for r in SRC.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.md": "# A\nx", "b.md": "é"}


def test_short_prose_between_fences_is_dropped_without_a_gap(spark):
    docs = spark.createDataFrame([("docs/t/x.md", "```\na\n```\nor:\n```\nb\n```\n")], "path string, text string")
    assert [r.id for r in C.semantic_chunk(docs).orderBy("n").collect()] == ["t-x_intro_0", "t-x_intro_1"]


def test_ingest_of_nothing_and_of_odd_documents(spark):
    empty = spark.createDataFrame([], "path string, content string")
    assert W.ingest(empty).count() == 0
    odd = spark.createDataFrame([("a.md", None), ("b.md", " \n"), ("c.md", "word " * 2000), ("d.html", "<p>" + "long text of a page here " * 3)], "path string, content string")
    ids = [r.id for r in W.ingest(odd).collect()]
    assert len(ids) == len(set(ids)) and {i.split("_")[0] for i in ids} == {"c", "d"}


def test_upsert_twice_is_upsert_once(spark):
    base = spark.createDataFrame([("a", "1", 0), ("b", "2", 0)], "id string, text string, seq long")
    batch = spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", None, 1)], "id string, text string, seq long")
    once = C.upsert_chunks(base, batch)
    assert sorted(once.collect()) == sorted(C.upsert_chunks(once, batch).collect())
    assert {r.id: r.text for r in once.collect()} == {"a": "1", "b": "4", "c": None}


def test_diversity(spark):
    hits = spark.createDataFrame([(1, k, d, x, r) for r, (k, d, x) in enumerate([("a", "p", 0.10), ("b", "p", 0.11), ("c", "p", 0.12), ("d", "q", 0.15)], 1)], "query_id long, id string, source_doc string, distance double, rank int")
    assert [r.id for r in R.diversity_rerank(hits).orderBy("rank").collect()] == ["a", "b", "d", "c"]


def test_knn_with_ties_zero_and_missing_vectors(spark):
    store = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.id, r.distance) for r in R.knn_search(asked, store, 3).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0), (3, 1.0)]
    assert R.knn_search(asked.limit(0), store, 3).count() == 0
    two = R.knn_search(asked.unionByName(asked.withColumn("query_id", F.lit(8).cast("long"))), store, 1, block=1)
    assert sorted((r.query_id, r.id) for r in two.collect()) == [(8, 1), (9, 1)]


def test_knn_needs_no_job_before_its_own(spark, monkeypatch):
    store = spark.createDataFrame([(k, [float(k + 1), 10.0 - k]) for k in range(10)], "id long, embedding array<double>").repartition(3)
    asked = store.withColumnRenamed("id", "query_id")
    with monkeypatch.context() as m:
        for name in ("collect", "count", "toPandas", "first", "take"):
            m.setattr(type(asked), name, None)
        found = {(b, w): R.knn_search(asked, store, 1, block=b, ways=w) for b in (1, 3, 100) for w in (1, 7)}
    for df in found.values():
        assert "SinglePartition" not in df._jdf.queryExecution().toString()
        assert sorted((r.query_id, r.id) for r in df.collect()) == [(k, k) for k in range(10)]


def test_context_without_hits(spark):
    asked = spark.createDataFrame([(1,)], "query_id long")
    hits = spark.createDataFrame([], "query_id long, rank int, source_doc string, section string, text string")
    assert "no relevant" in R.construct_context(asked, hits).first().context


def test_attempts(spark):
    rows = [(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", True), (2, 0, "a", False), (2, 1, "b", False)]
    found = {r.query_id: (r.code, r.valid, r.n_retries) for r in AN.resolve_attempts(spark.createDataFrame(rows, "query_id long, attempt int, code string, valid boolean")).collect()}
    assert found == {1: ("b", True, 1), 2: ("b", False, 1)}


def test_validation_keeps_null_code(spark):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "n int, code string")
    assert {r.n: r.valid for r in AN.validate_syntax(rows).collect()} == {1: False, 2: True, 3: True}


def test_word_band(spark):
    rows = spark.createDataFrame([(n, "w " * n) for n in (799, 800, 1200, 1201)], "n int, markdown string")
    assert [r.band for r in S.tutorial_word_band(rows).orderBy("n").collect()] == ["below", "within", "within", "above"]


def test_includes_from_both_places(spark):
    docs = spark.createDataFrame([("r/docs/a.md", "{* ../docs_src/x.py hl[1] *}"), ("r/docs/en/b.md", "{* ../../../docs_src/x.py *} {* no.py *}"), ("c.md", "plain")], "path string, text string")
    files = spark.createDataFrame([("r/docs_src/x.py", "x\n\n"), ("docs_src/x.py", "y")], "path string, content string")
    found = {r.path: (r.text, r.resolved, r.unresolved) for r in D.resolve_includes(docs, files).collect()}
    assert found["r/docs/a.md"] == ("\n```python\nx\n```\n", 1, 0)
    assert found["r/docs/en/b.md"] == ("\n```python\ny\n```\n {* no.py *}", 1, 1)
    assert found["c.md"] == ("plain", 0, 0)


def test_tutorials_workload(spark):
    store = spark.createDataFrame([(1, "d", "s", "t", [1.0, 0.0])], "id long, source_doc string, section string, text string, embedding array<double>")
    topics = spark.createDataFrame([(7, "My Topic!", [1.0, 0.0])], "query_id long, topic string, embedding array<double>")
    written = spark.createDataFrame([(7, "a b c")], "query_id long, markdown string")
    row = W.tutorials(topics, store, written, template="On {topic}: {context}").first()
    assert row.slug == "my-topic" and row.band == "below" and row.word_count == 3 and row.user_prompt.startswith("On My Topic!: [Source 1: d / s]")


def naive_split(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    separator = next(x for x in separators if x in text)
    finer = separators[separators.index(separator) + 1 :]

    def merge(pieces):
        out, window = [], []
        for p in pieces:
            if window and len(separator.join([*window, p])) > size:
                out.append(separator.join(window).strip())
                while window and (len(separator.join(window)) > overlap or len(separator.join([*window, p])) > size):
                    window = window[1:]
            window.append(p)
        return [x for x in [*out, separator.join(window).strip()] if x]

    out, few = [], []
    for p in [p for p in (text.split(separator) if separator else text) if p]:
        if len(p) < size or not finer:
            few.append(p)
        else:
            out, few = out + merge(few) + naive_split(p, size, overlap, finer), []
    return out + merge(few)


def naive_chunks(path, text):
    import re

    fence, heading = r"(?ms)^```[A-Za-z0-9_+\-]*\s*\n.*?\n```[ \t]*$", r"(?m)^(#{1,6})\s+(.+?)\s*$"
    heads, at, parts, out = [(m.start(), m[2].strip()) for m in re.finditer(heading, text)], 0, [], []
    for m in re.finditer(fence, text):
        parts += [("prose", at, text[at : m.start()]), ("code", m.start(), m[0])]
        at = m.end()
    for kind, start, content in [*parts, ("prose", at, text[at:])]:
        if not content.strip():
            continue
        section = ([t for p, t in heads if p <= start] or ["intro"])[-1]
        pieces = [content] if kind == "code" or len(content) < 2048 else naive_split(content, 2048, 400)
        for piece in pieces:
            piece = piece if kind == "code" else piece.strip()
            if kind == "code" or len(piece) >= 30 or "```" in piece:
                name = re.sub("[^a-z0-9]+", "-", section.lower()).strip("-")[:60].rstrip("-") or "section"
                out.append((path, name, len(out), piece, section, start, kind == "code" or "```" in piece))
    return out


def test_chunks_against_brute_force(spark):
    from quillspark.jobs import queries as Q

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    docs = Q._cleaned(spark, "/root/testdata/sf0.001").select("path", "text")
    odd = ["", None, " \n", "word " * 3_000, "x" * 9_000, "a. " * 2_000 + "\n\n" + "b\n" * 1_500, "```py\nx\n```\n" * 300, "# H\n" + "y " * 2_000 + "\n```\nz\n```\n\n## I\nshort"]
    docs = docs.unionByName(spark.createDataFrame([(f"odd/o{k}.md", t) for k, t in enumerate(odd)], "path string, text string")).cache()
    want = sorted(x for r in docs.collect() if r.text for x in naive_chunks(r.path, r.text))
    found = C.semantic_chunk(docs).collect()
    assert sorted((r.path, r.id.removeprefix(r.source_doc + "_").rpartition("_")[0], r.n, r.text, r.section, r.position, r.has_code) for r in found) == want
    assert all(r.id.endswith(f"_{r.n}") for r in found)


def test_many_fences_take_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("a.md", "text here\n```py\nx = 1\n```\n" * n)], "path string, text string")
        t = time.perf_counter()
        chunks = C.semantic_chunk(df.select("path", X.clean_text(X.F.col("text")).alias("text")))
        assert chunks.count() >= n
        return time.perf_counter() - t

    seconds(100)
    assert seconds(6_400) < 30


def test_read_documents_folder_with_a_dot_and_missing_source(spark, tmp_path):
    folder = tmp_path / "docs.v2"
    folder.mkdir()
    (folder / "a.md").write_text("x")
    (folder / "b.txt").write_text("y")
    assert [r.content for r in SRC.read_documents(spark, str(folder)).collect()] == ["x"]
    assert [r.content for r in SRC.read_documents(spark, [str(folder / "b.txt")]).collect()] == ["y"]
    with pytest.raises(Exception, match="gone"):
        SRC.read_documents(spark, str(tmp_path / "gone"))


def test_knn_ties_and_nulls(spark):
    from quillspark.operators import retrieval as R

    store = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(40)] + [(99, None), (100, [0.0, 0.0])], "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (200, None)], "query_id long, embedding array<double>")
    for block in (1, 4_096):
        found = {}
        for r in R.knn_search(asked, store, 5, exclude_self=True, block=block).orderBy("rank").collect():
            found.setdefault(r.query_id, []).append(r.id)
        assert found == {0: [3, 6, 9, 12, 15], 7: [1, 4, 10, 13, 16]}
    assert R.knn_search(asked.where("query_id < 0"), store, 5).count() == 0


def test_stream_store(spark, tmp_path):
    from quillspark.streaming import ingest as ST

    row = lambda k, text: (k, text, "d", "s", 0, False)
    kind = "id string, text string, source_doc string, section string, position int, has_code boolean"
    store = str(tmp_path / "store")
    texts = lambda n=None: {r.id: (r.text, r.seq) for r in ST.stored_chunks(spark, store, n).collect()}
    assert texts() == texts(0) == {}
    want = {}
    for batch_id, rows in enumerate(([row("a", "1"), row("b", "1")], [], [row("b", "2"), row("c", "2"), row("c", "2")], [row(f"x{k}", "3") for k in range(20)], [row("x3", "4")])):
        before = dict(want)
        want |= {r[0]: (r[1], batch_id) for r in rows}
        for _ in range(2):  # a batch that runs again
            ST.merge_batch(spark.createDataFrame(rows, kind), store, batch_id, buckets=4)
        assert texts() == texts(batch_id + 1) == want
        assert texts(batch_id) == before  # a reader that began before it
    manifests = [p.name for p in (tmp_path / "store" / "manifest").iterdir() if not p.name.startswith(".")]
    assert sorted(manifests) == ["3", "4"]
    assert len(list((tmp_path / "store").glob("batch=*/bucket=*"))) <= 8  # two versions at most, however many batches


def test_progress_is_counted_in_the_pass(spark, tmp_path):
    from quillspark.jobs import workloads as W

    prose = "A sentence that is long enough to be a chunk of its own. "
    rows = [("a.md", "# A\n\n" + prose * 3), ("b.md", None), ("c.md", " \u2003\n"), ("d.html", "<html><![x[ y ]]>"), ("e.md", "short"), ("f.html", "<html><body>" + prose * 60), ("g.md", "")]
    chunks, progress = W.ingest_counted(spark.createDataFrame(rows, "path string, content string"))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("_page_parts") == 1
    chunks.write.parquet(str(tmp_path / "chunks"))
    n = spark.read.parquet(str(tmp_path / "chunks")).count()
    assert n > 2 and progress() == {"n_sources": 7, "n_missing": 1, "n_blank": 2, "n_parse_errors": 1, "n_unchunked": 1, "n_chunks": n}


def test_last_version_of_a_path(spark):
    from quillspark.streaming import ingest as ST

    batch = spark.createDataFrame([("p", "old", 1), ("p", "new", 2), ("q", "a", 1), ("q", "b", 1)], "path string, text string, changed int")
    assert {r.path: r.text for r in ST.last_versions(batch).collect()} == {"p": "new", "q": "b"}


def chunk_rows(spark, texts):
    return spark.createDataFrame([(str(k), t, "d", "s") for k, t in enumerate(texts)], "id string, text string, source_doc string, section string")


def test_calls_are_filled_across_batches(spark, tmp_path):
    log = str(tmp_path)

    def embed(texts):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return [[float(len(t)), 1.0] for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunks = chunk_rows(spark, ["x" * k for k in range(100)]).coalesce(1)
        found = C.embed_texts(chunks, embed, 2, batch=32).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    head = len("[Doc: d] [Section: s]\n\n")
    assert {r.id: r.embedding[0] for r in found} == {str(k): float(head + k) for k in range(100)}
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [4, 32, 32, 32]


def test_vectors_are_paid_for_once(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    log = str(calls)

    def embed(texts):
        import os
        import uuid

        if "boom" in texts[-1] and len(os.listdir(log)) < 40:
            raise RuntimeError("the service is down")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(t.split("\n\n")[1] for t in texts))
        return [[float(len(t))] for t in texts]

    texts = [f"t{k % 30}" for k in range(90)]
    first = C.embed_once(chunk_rows(spark, texts), embed, 1, store, batch=1, a_file=1)
    assert first.count() == 90
    more = [*texts, *[f"u{k}" for k in range(9)], "boom"]
    with pytest.raises(Exception, match="the service is down"):
        C.embed_once(chunk_rows(spark, more), embed, 1, store, batch=1, a_file=1, tries=1)
    for k in range(40):
        (calls / f"extra{k}").write_text("")  # the service is back
    found = C.embed_once(chunk_rows(spark, more), embed, 1, store, batch=1, a_file=1)
    assert found.count() == 100 and found.where("embedding is null").count() == 0
    paid = [t for p in calls.iterdir() for t in p.read_text().split("\n") if t]
    assert sorted(paid) == sorted({*more})  # none twice, though a job failed between


def test_all_distances_in_blocks(spark):
    from quillspark.functions import vectors as V

    rows = [(k, [1.0, float(k % 3), 0.25 * k]) for k in range(20)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [1.0, 2.0]), (54, []), (55, [-1.0, 0.0, 0.0])]
    store = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", v) for k, v in [*rows[:3], *rows[20:]]], "query_id string, embedding array<float>")
    pairs = asked.withColumnRenamed("embedding", "q").crossJoin(store)
    want = pairs.select("query_id", "id", F.round(V.cosine_distance(F.col("q"), F.col("embedding")), 6).alias("distance")).collect()
    for block in (1, 7, 256):
        assert sorted(R.distances(asked, store, block=block).collect(), key=repr) == sorted(want, key=repr)
    assert R.distances(asked.limit(0), store).count() == 0
    meeting = R.distances(asked, store)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in meeting and "aggregate(" not in meeting  # no pair goes through Spark's interpreted functions


def test_a_small_batch_leaves_a_large_bucket_as_it_is(spark, tmp_path):
    from quillspark.streaming import ingest as ST

    kind = "id string, text string, source_doc string, section string, position int, has_code boolean"
    store, want = str(tmp_path / "store"), {}
    for batch_id, ids in enumerate((range(4_000), range(0, 40, 2), range(3_990, 4_020), range(0, 40, 3))):
        rows = [(str(k), f"{batch_id} " + " ".join(str(hash((k, j))) for j in range(10)), "d", "s", 0, False) for k in ids]
        want |= {r[0]: (r[1], batch_id) for r in rows}
        ST.merge_batch(spark.createDataFrame(rows, kind), store, batch_id, buckets=1)
    found = ST.stored_chunks(spark, store).collect()
    assert len(found) == len(want) and {r.id: (r.text, r.seq) for r in found} == want
    size = lambda n: sum(p.stat().st_size for p in (tmp_path / "store" / f"batch={n}").rglob("*.parquet"))
    assert 0 < size(3) * 10 < size(0)  # before, each batch wrote the whole bucket


def test_runs_are_few_and_seldom_written():
    from quillspark.streaming import ingest as ST

    sizes, written = [], 0
    for _ in range(1_000):
        kept = ST._to_merge(sizes, 1)
        sizes = [*sizes[:kept], 1 + sum(sizes[kept:])]
        written += sizes[-1]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert len(sizes) <= 10 and written <= 12 * 1_000
