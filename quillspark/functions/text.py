"""Columns for document text: format, parsing, cleaning, names. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though ``body`` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Sums are made of so many numbers at once, as an array that grows is copied each time.
_RUN = 256


def starts(lengths: Column) -> Column:
    """Where parts of these lengths begin that follow each other; the work grows with their number."""

    def run(all_lengths: Column, k: Column) -> Column:
        first = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(F.slice(all_lengths, k * _RUN + 1, F.lit(_RUN)), first, lambda a, n: F.struct((a["end"] + n).alias("end"), F.concat(a["at"], F.array(a["end"])).alias("at")))

    def joined(runs: Column) -> Column:
        first = F.struct(F.lit(0).alias("end"), F.array().cast("array<array<int>>").alias("at"))
        add = lambda a, r: F.struct((a["end"] + r["end"]).alias("end"), F.concat(a["at"], F.array(F.transform(r["at"], lambda x: x + a["end"]))).alias("at"))
        return F.flatten(F.aggregate(runs, first, add, lambda a: a["at"]))

    def all_runs(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _RUN).cast("int")), lambda k: run(x, k))

    return let(lengths, lambda x: F.when(F.size(x) > 0, joined(all_runs(x))).otherwise(F.array().cast("array<int>")))


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 where valid, else Latin-1; any line end becomes a newline. Null stays null."""
    utf8 = content.cast("string")
    return _replaced(F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1")), "\r", (r"\r\n?", "\n"))


def strip(text: Column) -> Column:
    """Without white space at both ends, in its Unicode meaning."""
    return F.btrim(text, F.lit(P.WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def detect_format(content: Column, hint: Column) -> Column:
    """markdown, html or text: by the hint's extension, else by how the content begins, else by two signs of Markdown."""
    name = F.regexp_extract(F.regexp_replace(F.coalesce(hint, F.lit("")), r"/+$", ""), r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    head = F.lower(F.substring(F.regexp_replace(content, r"(?U)^\s+", ""), 1, 2000))
    signs = sum((content.rlike(sign).cast("int") for sign in P.MARKDOWN_SIGNS), F.lit(0))
    found = F.when(suffix.isin(*P.EXTENSIONS["markdown"]), "markdown").when(suffix.isin(*P.EXTENSIONS["html"]), "html").when(suffix.isin(*P.EXTENSIONS["text"]), "text")
    is_html = head.startswith("<!doctype html") | head.startswith("<html") | head.contains("<body") | head.contains("<div")
    return found.when(is_html, "html").when(signs >= 2, "markdown").otherwise("text")


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, P.FRONTMATTER, "")


def strip_plain_includes(text: Column) -> Column:
    return F.regexp_replace(text, P.PLAIN_INCLUDE, "")


def fenced(text: Column) -> Column:
    """struct<prose, fences>: fenced blocks, whole and in order, and the text around them, one piece more than blocks.

    What follows an opening line that nothing closes is prose, so it may be left at the first such line.
    """
    prose, found = F.split(text, P.FENCE_OR_TAIL, -1), F.regexp_extract_all(text, F.lit(P.FENCE_OR_TAIL), F.lit(0))

    def parts(x: Column) -> Column:
        last = F.try_element_at(x["found"], F.lit(-1))
        open_end = F.concat(F.slice(x["prose"], F.lit(1), F.size(x["found"]) - 1), F.array(F.concat(F.element_at(x["prose"], -2), last)))
        tail = F.struct(open_end.alias("prose"), F.slice(x["found"], F.lit(1), F.size(x["found"]) - 1).alias("fences"))
        whole = F.struct(x["prose"].alias("prose"), x["found"].alias("fences"))
        return F.when(last.rlike(P.FENCE_ALONE), whole).when(F.size(x["found"]) > 0, tail).otherwise(whole)

    none = F.struct(F.array(text).alias("prose"), F.array().cast("array<string>").alias("fences"))
    return F.when(text.contains("```"), let(F.struct(prose.alias("prose"), found.alias("found")), parts)).otherwise(none)


def _prose_starts(prose: Column, between: Column) -> Column:
    """Where each piece of prose begins, in characters, when one of ``between`` follows each but the last."""
    lengths = F.transform(prose, lambda p, i: F.length(p) + F.coalesce(F.length(F.get(between, i)), F.lit(0)))
    return starts(lengths)


def code_blocks(text: Column) -> Column:
    """array<struct<id, language, code, start, end>> of fenced blocks; offsets in characters."""

    def blocks(x: Column, at: Column) -> Column:
        def block(fence: Column, i: Column) -> Column:
            language = F.regexp_extract(fence, P.FENCE_ALONE, 1)
            start = F.get(at, i) + F.length(F.get(x["prose"], i))
            return F.struct(
                i.alias("id"),
                F.when(language == "", "text").otherwise(language).alias("language"),
                F.regexp_extract(fence, P.FENCE_CODE, 1).alias("code"),
                start.alias("start"),
                (start + F.length(fence)).alias("end"),
            )

        return F.transform(x["fences"], block)

    placed = let(fenced(text), lambda x: let(_prose_starts(x["prose"], x["fences"]), lambda at: blocks(x, at)))
    return F.when(text.contains("```"), placed).otherwise(F.array().cast("array<struct<id:int,language:string,code:string,start:int,end:int>>"))


def _title(heading: Column) -> Column:
    return strip(F.ltrim(heading, F.lit("#")))


def sections(text: Column) -> Column:
    """array<struct<level, title>> of headings in order, those inside code too."""
    found = F.regexp_extract_all(text, F.lit(P.HEADING), F.lit(0))
    made = F.transform(found, lambda h: F.struct((F.length(h) - F.length(F.ltrim(h, F.lit("#")))).alias("level"), _title(h).alias("title")))
    return F.when(text.contains("#"), made).otherwise(F.array().cast("array<struct<level:int,title:string>>"))


def file_stem(path: Column) -> Column:
    """Last part of a path without its last extension."""
    name = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def title_case(text: Column) -> Column:
    """Upper case after everything that isn't a letter, lower case after a letter."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def document_title(text: Column, path: Column) -> Column:
    """First level-1 heading, else the file's name in title case, else empty."""
    first = F.get(F.filter(sections(text), lambda s: s["level"] == 1), F.lit(0))["title"]
    return F.coalesce(F.nullif(first, F.lit("")), title_case(F.regexp_replace(file_stem(path), "[-_]", " ")), F.lit(""))


def _replaced(text: Column, mark: str, *steps: tuple[str, str]) -> Column:
    """Patterns replaced in a text that holds a mark; others are left without a look."""

    def replace(t: Column) -> Column:
        out = t
        for pattern, to in steps:
            out = F.regexp_replace(out, pattern, to)
        return F.when(t.contains(mark), out).otherwise(t)

    return let(text, replace)


def _cut_out(text: Column, pattern: str, blanks: str) -> Column:
    """A text without what a pattern matches and the blanks before it."""
    pieces = F.split(text, pattern, -1)
    return let(pieces, lambda x: F.array_join(F.transform(x, lambda p, i: F.when(i < F.size(x) - 1, F.rtrim(p, F.lit(blanks))).otherwise(p)), ""))


def strip_heading_anchors(text: Column) -> Column:
    return let(text, lambda t: F.when(t.contains("{"), _cut_out(t, P.HEADING_ANCHOR, " \t")).otherwise(t))


def strip_attribute_lists(text: Column) -> Column:
    """Attribute lists go; behind the last closing brace none is looked for."""

    def cut(t: Column) -> Column:
        behind = F.substring_index(t, "}", -1)
        return F.when(t.contains("{:") & t.contains("}"), F.concat(_cut_out(F.left(t, F.length(t) - F.length(behind)), P.ATTRIBUTE_LIST, P.WHITE_SPACE), behind)).otherwise(t)

    return let(text, cut)


def strip_includes(text: Column) -> Column:
    return _replaced(text, "}", (P.INCLUDE, ""))


def admonitions_to_bold(text: Column) -> Column:
    return _replaced(text, "!!!", (P.TITLED_ADMONITION, r"**$1**"), (P.BARE_ADMONITION, ""))


def tabs_to_bold(text: Column) -> Column:
    return _replaced(text, "===", (P.TAB, r"**$1**"))


def strip_inline_html(text: Column) -> Column:
    """Inline tags go; behind the last closing mark none is looked for."""

    def cut(t: Column) -> Column:
        behind = F.substring_index(t, ">", -1)
        return F.when(t.contains("<") & t.contains(">"), F.concat(F.regexp_replace(F.left(t, F.length(t) - F.length(behind)), P.INLINE_HTML, ""), behind)).otherwise(t)

    return let(text, cut)


def strip_trailing_blanks(text: Column) -> Column:
    return F.regexp_replace(text, P.TRAILING_BLANKS, "")


def collapse_blank_lines(text: Column) -> Column:
    return _replaced(text, "\n\n\n", (P.BLANK_LINES, "\n\n"))


PROSE_STEPS = (
    strip_heading_anchors,
    strip_attribute_lists,
    strip_includes,
    admonitions_to_bold,
    tabs_to_bold,
    strip_inline_html,
    strip_trailing_blanks,
    collapse_blank_lines,
)


def clean_prose(text: Column) -> Column:
    """All steps for text outside code, in order."""
    for step in PROSE_STEPS:
        text = step(text)
    return text


def clean_text(raw: Column, *, protect_fences: bool = False) -> Column:
    """Clean what stands between fenced blocks; then collapse blank lines everywhere, strip, and end with a newline.

    Cleaning may take the newline before a fence with a directive above it; ``protect_fences`` puts it back.
    """
    def whole(x: Column) -> Column:
        def piece(text: Column, i: Column) -> Column:
            clean = clean_prose(text)
            if protect_fences:
                lost = (i < F.size(x["fences"])) & (clean != "") & ~clean.endswith("\n")
                clean = F.when(lost, F.concat(clean, F.lit("\n"))).otherwise(clean)
            return F.concat(clean, F.coalesce(F.get(x["fences"], i), F.lit("")))

        return F.array_join(F.transform(x["prose"], piece), "")

    cleaned = F.concat(strip(collapse_blank_lines(let(fenced(raw), whole))), F.lit("\n"))
    return F.when(raw == "", raw).otherwise(cleaned)


def segments(text: Column) -> Column:
    """array<struct<start, end, kind, content>>: prose and code in order, empty prose left out; offsets in characters."""

    def parts(x: Column, at: Column) -> Column:
        def segment(content: Column, start: Column, kind: str) -> Column:
            return F.struct(start.alias("start"), (start + F.length(content)).alias("end"), F.lit(kind).alias("kind"), content.alias("content"))

        def both(content: Column, i: Column) -> Column:
            own = segment(content, F.get(at, i), "prose")
            code = segment(F.coalesce(F.get(x["fences"], i), F.lit("")), F.get(at, i) + F.length(content), "code")
            return F.array(own, code)

        return F.filter(F.flatten(F.transform(x["prose"], both)), lambda s: s["content"] != "")

    return let(fenced(text), lambda x: let(_prose_starts(x["prose"], x["fences"]), lambda at: parts(x, at)))


def headings(text: Column) -> Column:
    """array<struct<pos, title>> of headings, positions in characters."""
    both = F.struct(F.split(text, P.HEADING, -1).alias("between"), F.regexp_extract_all(text, F.lit(P.HEADING), F.lit(0)).alias("found"))

    def placed(x: Column, at: Column) -> Column:
        return F.transform(x["found"], lambda h, i: F.struct((F.get(at, i) + F.length(F.get(x["between"], i))).alias("pos"), _title(h).alias("title")))

    found = let(both, lambda x: let(_prose_starts(x["between"], x["found"]), lambda at: placed(x, at)))
    return F.when(text.contains("#"), found).otherwise(F.array().cast("array<struct<pos:int,title:string>>"))


def sections_at(found: Column, positions: Column) -> Column:
    """For each of ascending positions the title of the last of ``headings`` at or before it, else intro.

    Both lists are merged once: a position's place among all, less its place among positions, counts the headings before.
    """
    marks = F.concat(F.transform(found, lambda h: h["pos"] * 2), F.transform(positions, lambda p: p * 2 + 1))
    merged = F.filter(F.transform(F.sort_array(marks), lambda x, i: F.when(x % 2 == 1, i)), lambda i: i.isNotNull())
    before = lambda i, k: i - k - 1
    return let(found, lambda h: F.transform(merged, lambda i, k: F.when(before(i, k) < 0, "intro").otherwise(F.get(h, before(i, k))["title"])))


def slug(text: Column, *, empty: str = "section", length: int = 60) -> Column:
    """Lower-case ASCII words joined by hyphens, cut to ``length``."""
    name = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.substring(name, 1, length), F.lit("-")), F.lit("")), F.lit(empty))


def doc_name(path: Column) -> Column:
    """Parent folder and file stem, joined by a hyphen; folders named docs are left out; doc without a path."""
    stem = F.coalesce(F.nullif(file_stem(path), F.lit("")), F.lit("doc"))
    parent = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]+)/+[^/]*$", 1)
    return F.when(path.isNull(), "doc").when(parent.isin("", ".", "docs"), stem).otherwise(F.concat_ws("-", parent, stem))


def embedding_text(doc: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("[Doc: "), doc, F.lit("] [Section: "), section, F.lit("]\n\n"), text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def line_count(text: Column) -> Column:
    """Lines of a text, by any line end of Unicode; a line end at the end begins no line."""
    n = F.regexp_count(text, F.lit(P.LINE_END))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n + F.when(text.rlike(f"(?:{P.LINE_END})\\z"), 0).otherwise(1))
