"""Queries against their SQL on small tables with rows that the driver's smallest tables don't have."""

import duckdb
import pytest

from quillspark.jobs import queries as own


def tables(spark, folder, **rows):
    """Tables of these names, written as the driver's are; each is a list of rows with their columns' types."""
    for name, (data, kind) in rows.items():
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def both(spark, folder, name, *names):
    """Rows of a query, and of its SQL over the same tables."""
    con = duckdb.connect()
    for table in names:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = own.QUERIES[name](spark, folder)
    found = con.execute(f"select {', '.join(df.columns)} from ({own.SQL[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted(found, key=repr)


def page(title):
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{title}</p></body></html>"


PAGES = "page_id long, url string, html string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["html_to_text", "parse_documents", "html_misnested", "html_strip_chrome", "html_sections", "html_title"])
def test_titles_cut_within_a_reference(spark, tmp_path, name):
    pages = [(k, f"https://a.example/{k}", page(t)) for k, t in enumerate(("x &amp; y", "x &amp; y&amp", "x&quot", "x&am", "x&", "&amp;amp &copy;"))]
    folder = tables(spark, tmp_path, pages=(pages, PAGES), documents=([(1, "one text", "en", "web", 8)], DOCUMENTS))
    got, want = both(spark, folder, name, "pages", "documents")
    assert got == want


def test_topics_on_which_nothing_was_written(spark, tmp_path):
    vectors = [(k, [1.0, float(k % 7)], k % 3) for k in range(151)]
    folder = tables(spark, tmp_path, embeddings=(vectors, "vec_id long, embedding array<float>, label int"), benchmark=([(0, "a b"), (1, "c"), (4, "d e f")], "item_id long, text string"))
    got, want = both(spark, folder, "generate_tutorials", "embeddings", "benchmark")
    assert got == want and [r[0] for r in got] == [0, 0, 50]


@pytest.mark.parametrize("name", ["html_sections", "html_title", "html_to_text", "html_strip_chrome", "html_misnested", "html_code_to_fence"])
def test_a_page_that_fails_does_not_pass_for_one_without_parts(spark, tmp_path, name):
    folder = tables(spark, tmp_path, pages=([(1, "https://a.example/1", page("x")), (2, "https://a.example/2", "<![x[ y ]]>" + page("z"))], PAGES))
    with pytest.raises(Exception, match="can't parse page 2: AssertionError"):
        own.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", ["html_title", "html_to_text"])
def test_a_missing_page_has_no_parts(spark, tmp_path, name):
    folder = tables(spark, tmp_path, pages=([(1, "https://a.example/1", page("x")), (2, "https://a.example/2", None)], PAGES))
    got, want = both(spark, folder, name, "pages")
    assert got == want and got[1] == (2, None)


def test_files_of_documents_stay_small_however_many_there_are(spark, tmp_path, monkeypatch):
    from quillspark.sources import documents as SRC

    sizes, read = [], SRC.read_documents

    def seen(*args):
        found = read(*args)
        sizes.extend(r.n for r in found.select(own.F.length("content").alias("n")).collect())
        return found

    monkeypatch.setattr(SRC, "read_documents", seen)
    rows = [(k, f"a\n{k}" + "x" * 1_000, "en", "web", 0) for k in range(1_000)]
    folder = tables(spark, tmp_path, documents=(rows, DOCUMENTS))
    got, want = both(spark, folder, "read_documents", "documents")
    assert got == want and len(got) == 1_000 and max(sizes) < 300_000
