"""Columns for model answers: code, sources, explanation, errors, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import strip


def response_codes(response: Column) -> Column:
    """All code blocks of an answer, stripped."""
    return F.transform(F.regexp_extract_all(response, F.lit(P.ANSWER_CODE), F.lit(1)), strip)


def response_code(response: Column) -> Column:
    """The first code block, or empty."""
    return F.coalesce(F.get(response_codes(response), F.lit(0)), F.lit(""))


def response_sources(response: Column) -> Column:
    """Numbers of the first list of sources; other parts are left out."""
    parts = F.split(F.regexp_extract(response, P.ANSWER_SOURCES, 1), r"[,\s]+")
    return F.transform(F.filter(parts, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def response_explanation(response: Column) -> Column:
    """Text after the last code block and before the first list of sources; empty if that comes earlier."""
    pieces = F.split(response, P.ANSWER_CODE, -1)
    after = F.length(response) - F.length(F.element_at(pieces, -1))
    before_sources = F.length(F.get(F.split(response, P.ANSWER_SOURCES, 2), F.lit(0)))
    return F.when(before_sources <= after, "").otherwise(strip(F.substring(response, after + 1, before_sources - after)))


def format_errors(errors: Column) -> Column:
    """One line for each struct<line, column, message>."""

    def one(e: Column) -> Column:
        place = (
            F.when(e["line"].isNotNull() & e["column"].isNotNull(), F.concat(F.lit("line "), e["line"].cast("string"), F.lit(", col "), e["column"].cast("string")))
            .when(e["line"].isNotNull(), F.concat(F.lit("line "), e["line"].cast("string")))
            .otherwise("(no location)")
        )
        return F.concat(F.lit("- "), place, F.lit(": "), F.coalesce(e["message"], F.lit("")))

    return F.when(F.coalesce(F.size(errors), F.lit(0)) <= 0, "(no errors)").otherwise(F.array_join(F.transform(errors, one), "\n"))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places filled in one pass, so that values may hold braces."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def chat_format(system: Column, user: Column) -> Column:
    """System and user text between role markers, open for the assistant."""
    start, end = F.lit("<|im_start|>"), F.lit("<|im_end|>\n")
    return F.concat(start, F.lit("system\n"), system, end, start, F.lit("user\n"), user, end, start, F.lit("assistant\n"))


def clean_rewrite(rewritten: Column, query: Column, *, longest: int = 200) -> Column:
    """First line of a rewritten query without quotes and leading dashes; the query where that is empty or too long."""
    line = strip(F.get(F.split(strip(rewritten), r"\r\n|\r|\n"), F.lit(0)))
    line = strip(F.ltrim(F.btrim(line, F.lit("\"'`")), F.lit("- ")))
    return F.when((F.coalesce(line, F.lit("")) == "") | (F.length(line) > longest), query).otherwise(line)


def query_status(has_hits: Column, has_response: Column, code: Column, valid: Column) -> Column:
    """0 valid (or without code), 1 invalid after all attempts, 2 no hits or no response."""
    none = ~F.coalesce(has_hits, F.lit(False)) | ~F.coalesce(has_response, F.lit(False))
    return F.when(none, 2).when((F.coalesce(code, F.lit("")) == "") | F.coalesce(valid, F.lit(False)), 0).otherwise(1)


def pep8_score(violations: Column, lines: Column) -> Column:
    """100 less the share of lines with style violations, from 0 to 100; 0 without lines."""
    return F.when(lines <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - violations / lines))))
