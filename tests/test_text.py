"""Hand-worked cases of the text columns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers as A
from quillspark.functions import text as X


def one(spark, column, **values):
    types = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("content", "hint", "expected"),
    [
        ("<html>", "a.MD", "markdown"),
        ("x", "a/b.xhtml", "html"),
        ("x", "a.rst", "text"),
        ("x <div>", None, "html"),
        ("  <!DOCTYPE html>", None, "html"),
        ("# one heading", None, "text"),
        ("# heading\n- item", None, "markdown"),
        ("<html>", "http://x/474.html?x=1", "html"),
        ("", None, "text"),
    ],
)
def test_detect_format(spark, content, hint, expected):
    assert one(spark, X.detect_format(F.col("c"), F.col("h")), c=content, h=hint) == expected


@pytest.mark.parametrize(
    ("path", "expected"),
    [("docs/tutorial/websockets.md", "tutorial-websockets"), ("docs/index.md", "index"), (None, "doc"), ("x.md", "x")],
)
def test_doc_name(spark, path, expected):
    assert one(spark, X.doc_name(F.col("p")), p=path) == expected


@pytest.mark.parametrize(("text", "expected"), [("Step 1: import X!", "step-1-import-x"), ("???", "section"), ("a" * 59 + " b", "a" * 59)])
def test_slug(spark, text, expected):
    assert one(spark, X.slug(F.col("t")), t=text) == expected


def test_title(spark):
    assert one(spark, X.document_title(F.col("t"), F.col("p")), t="## x", p="a/first-steps.md") == "First Steps"
    assert one(spark, X.document_title(F.col("t"), F.col("p")), t="# A\n# B", p="a/x.md") == "A"
    assert one(spark, X.document_title(F.col("t"), F.col("p")), t="x", p=None) == ""
    assert one(spark, X.title_case(F.col("t")), t="don't stop2go") == "Don'T Stop2Go"


def test_code_blocks(spark):
    found = one(spark, X.code_blocks(F.col("t")), t="a\n```\nx\n```\nb\n```py\ny\n\nz\n```")
    assert [(b.id, b.language, b.code) for b in found] == [(0, "text", "x"), (1, "py", "y\n\nz")]
    assert (found[0].start, found[0].end) == (2, 11)
    assert one(spark, X.code_blocks(F.col("t")), t="```\n```") == []


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("## T { #a }", "## T\n"),
        ("!!! tip\n\n\nx", "x\n"),
        ("a\n```\nx\n\n\n\ny\n```", "a\n```\nx\n\ny\n```\n"),
        ('!!! note "N"\n\n```\nx\n```', "**N**```\nx\n```\n"),
        ("", ""),
        ("a  \n\n\n\nb", "a\n\nb\n"),
    ],
)
def test_clean_text(spark, raw, expected):
    assert one(spark, X.clean_text(F.col("t")), t=raw) == expected


def test_clean_text_with_fences_protected(spark):
    assert one(spark, X.clean_text(F.col("t"), protect_fences=True), t='!!! note "N"\n\n```\nx\n```') == "**N**\n```\nx\n```\n"


def test_segments_join_to_the_text(spark):
    text = "intro\n```\na\n```\n```py\nb\n```\nend"
    found = one(spark, X.segments(F.col("t")), t=text)
    assert "".join(s.content for s in found) == text
    assert all(text[s.start : s.end] == s.content for s in found)
    assert [s.kind for s in found] == ["prose", "code", "prose", "code", "prose"]


def test_section(spark):
    text = "a\n# One\nb\n```\n# step\n```\nc"
    positions = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(10), F.lit(24))
    assert one(spark, X.sections_at(X.headings(F.col("t")), positions), t=text) == ["intro", "intro", "One", "One", "step"]
    assert one(spark, X.sections_at(X.headings(F.col("t")), positions), t="none") == ["intro"] * 5


FENCE = re.compile(r"^```([A-Za-z0-9_+\-]*)\s*\n(.*?)\n```[ \t]*$", re.M | re.S)
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
LINES = ["```", "```py", "``` ", "```\xa0", "```py x", "``` x", "", "", " ", "\t\x0b", "\u2003", "a", "  b", "# h", "#", "##\xa0 h  x \t", "####### no", "#x", "# ", "é𝄞"]


def odd_texts():
    rnd = random.Random(11)
    return ["\n".join(rnd.choice(LINES) for _ in range(rnd.randint(0, 14))) for _ in range(1_500)]


def test_fences_and_headings_are_those_of_the_plain_patterns(spark):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    found = rows.select("k", X.code_blocks(F.col("t")).alias("b"), X.segments(F.col("t")).alias("s"), X.sections(F.col("t")).alias("h"), X.headings(F.col("t")).alias("p")).collect()
    for r in found:
        text = texts[r.k]
        want = list(FENCE.finditer(text))
        assert [(b.language, b.code, b.start, b.end) for b in r.b] == [(m[1] or "text", m[2], m.start(), m.end()) for m in want], text
        assert "".join(s.content for s in r.s) == text and all(text[s.start : s.end] == s.content for s in r.s)
        assert [s.content for s in r.s if s.kind == "code"] == [m[0] for m in want]
        heads = list(HEADING.finditer(text))
        assert [(h.level, h.title) for h in r.h] == [(len(m[1]), m[2].strip()) for m in heads], text
        assert [(h.pos, h.title) for h in r.p] == [(m.start(), m[2].strip()) for m in heads]


# The cleaning steps as plain patterns, white space and words in their Unicode meaning.
STEPS = (
    (X.strip_heading_anchors, r"[ \t]*\{\s*#[A-Za-z0-9_\-]+\s*\}[ \t]*$", ""),
    (X.strip_attribute_lists, r"\s*\{:[^}]*\}", ""),
    (X.strip_includes, r"^\{[!*].*?[!*]\}\s*$", ""),
    (X.tabs_to_bold, r'^===\s+"([^"]+)"\s*$', r"**\1**"),
    (X.strip_inline_html, r"(?i)</?(?:font|span|div|small|sub|sup|kbd)\b[^>]*>", ""),
    (X.strip_trailing_blanks, r"[ \t]+$", ""),
    (X.collapse_blank_lines, r"\n{3,}", "\n\n"),
    (X.strip_plain_includes, r"^\{!.*?!\}\s*$", ""),
)


@pytest.mark.parametrize(("step", "pattern", "to"), STEPS)
def test_steps_are_the_plain_patterns(spark, step, pattern, to):
    rnd = random.Random(len(pattern))
    parts = [" ", " ", "\t", "\n", "\n", "\xa0", "\u2003", "\x1c", "\x0b", "\x85", "x", "{ #a }", "{#a}", "{: .c }", "{:", "}", "{! a !}", "{* b *}", "{!", '=== "T"', '===\xa0"T"', "<span a>", "</DIV>", "<kbd", "<p>", ">", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(1_500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert {r.k: r.x for r in rows.select("k", step(F.col("t")).alias("x")).collect()} == {k: re.sub(pattern, to, t, flags=re.M) for k, t in enumerate(texts)}


def test_admonitions_have_unicode_words(spark):
    rnd = random.Random(2)
    parts = ["!!! ", "!!!\xa0", "!!!", "note", "é一9_", "n-t", ' "N é"', '\u2003"N"', ' ""', "\n", " \n", "x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(1_500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    plain = lambda t: re.sub(r'(?m)^!!!\s+\w+(?:\s+"")?\s*$', "", re.sub(r'(?m)^!!!\s+\w+\s+"([^"]+)"\s*$', r"**\1**", t))
    assert {r.k: r.x for r in rows.select("k", X.admonitions_to_bold(F.col("t")).alias("x")).collect()} == {k: plain(t) for k, t in enumerate(texts)}


def seconds(spark, column, text):
    rows = spark.createDataFrame([(text,)], "t string").select(column.alias("x"))
    began = time.perf_counter()
    rows.collect()
    return time.perf_counter() - began


@pytest.mark.parametrize(
    ("column", "text"),
    [
        (X.segments, "```py\nx\n" * 40_000),
        (X.segments, "```\nx\n```\ny\n" * 20_000),
        (X.clean_text, "```py\nx\n" * 40_000),
        (X.clean_text, "{: a " * 40_000),
        (X.clean_text, "<span " * 40_000),
        (X.clean_text, "a" + " " * 400_000 + "b"),
        (X.clean_text, "a" + "\xa0" * 400_000 + "{: .c }"),
        (X.strip_trailing_blanks, ("a" + " " * 40_000 + "b\n") * 10),
        (X.headings, "# h" + " " * 400_000 + "x"),
        (lambda t: X.sections_at(X.headings(t), F.transform(X.headings(t), lambda h: h["pos"])), "# h\n\ntext\n" * 40_000),
    ],
)
def test_work_grows_with_the_text(spark, column, text):
    assert seconds(spark, column(F.col("t")), text) < 6


@pytest.mark.parametrize(("response", "expected"), [("**Sources**: [1, a, 3]", [1, 3]), ("x", []), ("sources: []", []), ("Sources: [2] Sources: [9]", [2])])
def test_sources(spark, response, expected):
    assert one(spark, A.response_sources(F.col("r")), r=response) == expected


def test_explanation_is_after_the_last_block_and_code_is_the_first(spark):
    response = "a\n```python\nx = 1\n```\nb\n```\ny\n```\nwhy\nSources: [1]"
    assert one(spark, A.response_code(F.col("r")), r=response) == "x = 1"
    assert one(spark, A.response_explanation(F.col("r")), r=response) == "why"
    assert one(spark, A.response_explanation(F.col("r")), r="Sources: [1]\n```\nx\n```") == ""


@pytest.mark.parametrize(("raw", "expected"), [('- "FastAPI x`', '"FastAPI x'), ("a" * 201, "q"), ("", "q"), ("'x'\ny", "x")])
def test_rewrite(spark, raw, expected):
    assert one(spark, A.clean_rewrite(F.col("raw"), F.col("q")), raw=raw, q="q") == expected


def test_fill_is_one_pass(spark):
    filled = A.fill("{a} and {b}", a=F.col("a"), b=F.col("b"))
    assert one(spark, filled, a="{b}", b="x") == "{b} and x"


def test_decode(spark):
    rows = spark.createDataFrame([(b"\xe9\r\nx",), ("é\r".encode(),), (None,)], "c binary")
    assert [r.x for r in rows.select(X.decode_text(F.col("c")).alias("x")).collect()] == ["é\nx", "é\n", None]
