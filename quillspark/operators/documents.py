"""Parsing documents into text, code blocks, sections and title."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import helpers
from quillspark.functions import patterns as P
from quillspark.functions import text as X

SECTIONS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())]))
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("sections", SECTIONS), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def include_paths(documents: DataFrame) -> DataFrame:
    """Each code include of documents (path, text): path, n (its place), rel, and the two paths where its file may be.

    A relative path is taken from the document's folder; from docs_src on, it is taken from the repository's root.
    """
    found = documents.where(F.col("text").contains("{*")).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(P.CODE_INCLUDE), F.lit(1))).alias("n", "rel"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    literal = F.concat(folder, "rel")

    def resolved(path):  # without . and ..
        parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
        empty = F.array().cast("array<string>")
        walked = F.aggregate(parts, empty, lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
        return F.array_join(walked, "/")

    rooted = F.when(F.col("rel").contains("docs_src/"), F.regexp_extract("rel", r"(docs_src/.*)$", 1))
    return found.select("path", "n", "rel", resolved(literal).alias("literal"), resolved(rooted).alias("rooted"))


def resolve_includes(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Put the files (path, content) that includes name into documents (path, text) as fenced blocks.

    Only documents with an include meet the joins; an include without its file stays. Adds resolved and unresolved.
    """
    wanted = include_paths(documents)
    code = files.select(F.col("path").alias("file"), F.regexp_replace("content", r"\n+\z", "").alias("code"))
    one = wanted.join(code, wanted["literal"] == code["file"], "left").withColumnsRenamed({"file": "file1", "code": "code1"})
    two = one.join(code, one["rooted"] == code["file"], "left").withColumnsRenamed({"file": "file2", "code": "code2"})
    name = F.coalesce("file1", "file2")
    languages = F.create_map(*[F.lit(x) for pair in P.LANGUAGES.items() for x in pair])
    language = F.coalesce(F.element_at(languages, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))), F.lit(""))
    block = F.when(name.isNotNull(), F.concat(F.lit("\n```"), language, F.lit("\n"), F.coalesce("code1", "code2"), F.lit("\n```\n")))
    blocks = two.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks"))
    joined = documents.join(blocks, "path", "left")
    pieces = F.split("text", P.CODE_INCLUDE, -1)
    fill = lambda kept: F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get("blocks", i)["block"], F.get(kept, i), F.lit(""))))
    filled = X.let(F.regexp_extract_all("text", F.lit(P.CODE_INCLUDE), F.lit(0)), fill)
    n_found = F.coalesce(F.size(F.filter("blocks", lambda b: b["block"].isNotNull())), F.lit(0))
    n_all = F.coalesce(F.size("blocks"), F.lit(0))
    out = joined.withColumn("resolved", F.when(F.col("blocks").isNull(), 0).otherwise(n_found)).withColumn("unresolved", F.when(F.col("blocks").isNull(), 0).otherwise(n_all - n_found))
    return out.withColumn("text", F.when(F.col("blocks").isNull(), F.col("text")).otherwise(F.array_join(filled, ""))).drop("blocks")


def parse_markdown(documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """path, text, title, sections, code_blocks, doc_type of Markdown documents (path, content)."""
    text = X.strip_plain_includes(X.strip_frontmatter(F.col("content")))
    docs = documents.withColumn("text", text).drop("content")
    if files is not None:
        docs = resolve_includes(docs, files)
    return _described(docs, "markdown")


def _described(docs: DataFrame, kind: str) -> DataFrame:
    text = F.col("text")
    return docs.select("path", "text", X.document_title(text, F.col("path")).alias("title"), X.sections(text).alias("sections"), X.code_blocks(text).alias("code_blocks"), F.lit(kind).alias("doc_type"))


def parse_text(documents: DataFrame) -> DataFrame:
    """Text documents pass as they are; headings and code blocks are still found."""
    return _described(documents.withColumn("text", F.col("content")), "text")


@F.pandas_udf(PAGE)
def _page_parts(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        rows = []
        for page in batch:
            try:
                if page is None:  # there is nothing to parse, which isn't a page without text
                    rows.append((None, None, None, None))
                    continue
                title, found, text = helpers.parse_page(page)
                rows.append((title, [{"level": n, "title": x} for n, x in found], text, None))
            except Exception as e:  # one bad page is its own row's error
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["title", "sections", "text", "error"])


_page_parts = _page_parts.asNondeterministic()  # so that a filter on its result doesn't make Spark run it twice


def page_parts(pages: DataFrame, name: str) -> DataFrame:
    """``name``, title, sections, text and error of pages (``name``, content); a missing page has no parts and no error."""
    return pages.select(name, _page_parts("content").alias("p")).select(name, "p.title", "p.sections", "p.text", "p.error")


def or_fail(parsed: DataFrame, name: str) -> DataFrame:
    """Parsed pages without their error, for results that have no place for one.

    A page with an error fails the job, which says what page it was and why, instead of passing for a page without parts.
    """
    told = F.raise_error(F.concat(F.lit("can't parse page "), F.coalesce(F.col(name).cast("string"), F.lit("without a name")), F.lit(": "), F.col("error")))
    parts = [c for c in parsed.columns if c not in (name, "error")]
    return parsed.select(name, *[F.when(F.col("error").isNotNull(), told).otherwise(F.col(c)).alias(c) for c in parts])


def parse_html(documents: DataFrame) -> DataFrame:
    """path, text, title, sections, code_blocks, doc_type of pages (path, content), without their chrome.

    A page that can't be parsed has null parts, and says why in error.
    """
    docs = page_parts(documents, "path")
    return docs.select("path", "text", "title", "sections", X.code_blocks(F.col("text")).alias("code_blocks"), F.lit("html").alias("doc_type"), "error")


def parse_documents(documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Each document (path, content) by its format, in one pass; pages alone go through Python.

    A document that can't be parsed keeps its row: its text is null and error says why.
    """
    known = documents.where("content is not null").select("path", "content", X.detect_format(F.col("content"), F.col("path")).alias("doc_type"))
    if files is not None:  # includes are joined into Markdown only
        marked = known.where("doc_type = 'markdown'").withColumn("text", X.strip_plain_includes(X.strip_frontmatter(F.col("content")))).drop("content")
        marked = resolve_includes(marked, files).select("path", F.col("text").alias("content"), "doc_type")
        known = marked.unionByName(known.where("doc_type <> 'markdown'"))
    docs = known.withColumn("p", _page_parts(F.when(F.col("doc_type") == "html", F.col("content"))))
    is_page = F.col("doc_type") == "html"
    plain = F.col("content") if files is not None else F.when(F.col("doc_type") == "markdown", X.strip_plain_includes(X.strip_frontmatter(F.col("content")))).otherwise(F.col("content"))
    docs = docs.select("path", F.when(is_page, F.col("p.text")).otherwise(plain).alias("text"), "p", "doc_type")
    text = F.col("text")
    title = F.when(is_page, F.col("p.title")).otherwise(X.document_title(text, F.col("path")))
    found = F.when(is_page, F.col("p.sections")).otherwise(X.sections(text))
    return docs.select("path", "text", title.alias("title"), found.alias("sections"), X.code_blocks(text).alias("code_blocks"), "doc_type", F.col("p.error").alias("error"))
