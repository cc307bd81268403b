"""Every registered query outside the llm subpackage against its SQL, on the smallest tables."""

import os

import pytest

from quillspark.jobs import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in own.SQL:
        assert rows
        return
    found = duck.execute(own.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


def test_embed_texts_takes_long_documents(spark, tmp_path):
    texts = ["word " * 20, "one more word " * 400, "", None, "y" * 5_000]
    docs = spark.createDataFrame([(k, "web", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    embedded = sorted(r.id for r in own.QUERIES["embed_texts"](spark, str(tmp_path)).collect())
    assert embedded == sorted(r.id for r in own.QUERIES["semantic_chunk"](spark, str(tmp_path)).collect())
    assert len([i for i in embedded if "-d-1_" in i]) > 3 and len([i for i in embedded if "-d-4_" in i]) > 3
