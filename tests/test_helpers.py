"""Row helpers."""

from hypothesis import given
from hypothesis import strategies as st

from quillspark.functions import helpers as H


def test_split_shares_the_overlap():
    pieces = H.split_prose("word " * 1000)
    assert all(len(p) <= 2048 for p in pieces)
    assert pieces[0].endswith(pieces[1][:300].rstrip())


@given(st.text(alphabet="ab. \n", max_size=300))
def test_split_keeps_words_and_bounds(text):
    pieces = H.split_prose(text, 20, 5)
    assert all(0 < len(p) <= 20 for p in pieces)
    assert set("".join(pieces)) >= set(text) - set(". \n")


def test_page():
    title, sections, text = H.parse_page("<title>T &amp; U</title><nav>n</nav><h1>A <b>b</b></h1><pre><code class='x language-py'>y = 1</code></pre><p>z<script>s</script>")
    assert title == "T & U"
    assert sections == [(1, "Ab")]
    assert "```py\ny = 1\n```" in text and "n" not in text.split() and "s" not in text.split()


def test_page_keeps_references_that_were_cut():
    title, sections, text = H.parse_page("<title>a &amp; b&amp</title><h1 title='&copy'>&copy;c&quot</h1><p>&ampx; &am &#65; &amp;amp &amp;quot;")
    assert title == "a & b&amp"
    assert sections == [(1, "\u00a9c&quot")]
    assert text.endswith("&ampx; &am A &amp &quot;")


def test_syntax():
    assert H.syntax_issue(" ")[:3] == (False, None, None)
    assert H.syntax_issue("x = 1") == (True, None, None, None)
    assert H.syntax_issue("def f(:")[:2] == (False, 1)


def test_security():
    assert [f[0] for f in H.security_flags("eval(x)\nsubprocess.run(y)\nimport os\na.eval(b)")] == ["eval()", "subprocess.run()"]
    assert H.security_flags("def f(:") == []
