"""Answers of models: parse, validate, choose among attempts, score."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import answers as A
from quillspark.functions import helpers
from quillspark.functions import text as X

SYNTAX = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("message", T.StringType())])
FLAGS = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("note", T.StringType())]))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add code, explanation, sources to answers (response); a blank answer has empty ones."""
    blank = X.is_blank(F.col("response"))
    r = F.col("response")
    return (
        responses.withColumn("code", F.when(blank, "").otherwise(A.response_code(r)))
        .withColumn("explanation", F.when(blank, "").otherwise(A.response_explanation(r)))
        .withColumn("sources", F.when(blank, F.array().cast("array<int>")).otherwise(A.response_sources(r)))
    )


#: Results that a task remembers, by digest of the code.
_REMEMBERED = 20_000


def _once(work: Callable[[str | None], object]) -> Callable[[str | None], object]:
    """``work`` that does equal code once while it is remembered; of the results the oldest go first."""
    known: OrderedDict[bytes, object] = OrderedDict()

    def find(code: str | None) -> object:
        key = b"" if code is None else hashlib.sha256(code.encode("utf-8", "surrogatepass")).digest()
        if key in known:
            known.move_to_end(key)
        else:
            known[key] = work(code)
            if len(known) > _REMEMBERED:
                known.popitem(last=False)
        return known[key]

    return find


@F.pandas_udf(SYNTAX)
def _syntax(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    find = _once(helpers.syntax_issue)
    for batch in codes:
        frame = pd.DataFrame([find(c) for c in batch], columns=["valid", "line", "column", "message"])
        yield frame.astype({"line": "Int32", "column": "Int32"})


_syntax = _syntax.asNondeterministic()  # so that a filter on its result doesn't make Spark run it twice


def validate_syntax(snippets: DataFrame) -> DataFrame:
    """Add valid and errors (array<struct<line, column, message>>) to snippets (code).

    Where they stand, without a shuffle: a task parses equal code once, as far as it remembers it.
    """
    issue = F.struct(F.col("_s.line").alias("line"), F.col("_s.column").alias("column"), F.col("_s.message").alias("message"))
    none = F.array().cast("array<struct<line:int,column:int,message:string>>")
    found = snippets.withColumn("_s", _syntax("code"))
    return found.withColumn("valid", F.col("_s.valid")).withColumn("errors", F.when(F.col("_s.valid"), none).otherwise(F.array(issue))).drop("_s")


@F.pandas_udf(FLAGS)
def _flags(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    find = _once(lambda code: [] if code is None else [{"pattern": p, "line": n, "note": t} for p, n, t in helpers.security_flags(code)])
    for batch in codes:
        yield pd.Series([find(c) for c in batch])


_flags = _flags.asNondeterministic()


def security_flags(snippets: DataFrame) -> DataFrame:
    """Add flags to snippets (code), in one pass; only code that names a risky call at all is parsed."""
    maybe = F.col("code").rlike(r"eval|exec|compile|__import__|popen|system|subprocess")
    return snippets.withColumn("flags", _flags(F.when(maybe, F.col("code"))))


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """Of the attempts of a query (query_id, attempt, code, valid) the first valid one, else the last; and how many ran."""
    first = F.min(F.when(F.col("valid"), F.col("attempt")))
    pick = lambda c: F.coalesce(F.min_by(c, F.when(F.col("valid"), F.col("attempt"))), F.max_by(c, "attempt"))
    chosen = attempts.groupBy("query_id").agg(first.alias("_first"), F.max("attempt").alias("_last"), pick("code").alias("code"))
    return chosen.select("query_id", "code", F.col("_first").isNotNull().alias("valid"), F.coalesce("_first", "_last").alias("n_retries"))


def split_lint_issues(issues: DataFrame) -> DataFrame:
    """Add kind to lint issues (code): errors for F and E9, warnings for others."""
    return issues.withColumn("kind", F.when(F.col("code").startswith("F") | F.col("code").startswith("E9"), "error").otherwise("warning"))


def pep8_scores(snippets: DataFrame, issues: DataFrame) -> DataFrame:
    """Add n_errors, n_warnings, line_count and pep8_score to snippets (snippet_id, code)."""
    kinds = split_lint_issues(issues)
    counted = kinds.groupBy("snippet_id").agg(
        F.count_if(F.col("kind") == "error").alias("n_errors"),
        F.count_if(F.col("kind") == "warning").alias("n_warnings"),
        F.count_if(F.col("code").startswith("E") | F.col("code").startswith("W")).alias("_style"),
    )
    joined = snippets.join(counted, "snippet_id", "left").fillna(0, ["n_errors", "n_warnings", "_style"])
    joined = joined.withColumn("line_count", X.line_count(F.col("code")))
    return joined.withColumn("pep8_score", A.pep8_score(F.col("_style"), F.col("line_count"))).drop("_style")


def quality_report(snippets: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a snippet (snippet_id, code, lint_ran): counts of lint issues, flags, score, lines; valid if the linter ran."""
    scored = security_flags(pep8_scores(snippets, issues))
    return scored.withColumn("valid", F.coalesce("lint_ran", F.lit(False))).withColumn("n_flags", F.size("flags"))


def payloads(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Add retrieved, the hits of each answer's query in order (at most k), to answers (query_id, ...): one join."""
    hit = F.struct("rank", F.struct("source_doc", "section", "distance", F.col("id").cast("string").alias("id")).alias("hit"))
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["hit"]).alias("_hits"))
    none = F.array().cast("array<struct<source_doc:string,section:string,distance:double,id:string>>")
    return answers.join(listed, "query_id", "left").withColumn("retrieved", F.coalesce("_hits", none)).drop("_hits")


def payload_json() -> Column:
    """Query, hits and answer of a row of ``payloads`` as JSON."""
    return F.to_json(F.struct("query", "retrieved", "code", "explanation", "sources"))


def result_payload(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and payload: the answer (query_id, query, code, explanation, sources) and its hits as JSON."""
    return payloads(answers, hits).select("query_id", payload_json().alias("payload"))
