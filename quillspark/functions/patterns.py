"""Patterns and constants of the document format, in Java's regular expressions. All are fixed values.

``(?d)`` makes the newline the only line end. White space and word characters have their Unicode meaning everywhere.
Each pattern works in time linear in the text.
"""

# Classes: white space, white space within a line, and word characters.
_S = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_H = r"[\t\x0B-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_W = r"[\p{L}\p{N}_]"

# A fence from its opening line to its closing line, or from an opening line that nothing closes to the end of the text.
# A closing line follows the first line that isn't blank; else it is that line, if a blank one stands before it.
_OPEN = r"```([A-Za-z0-9_+\-]*)"
_CLOSED = rf"(?>{_S}*\n).*?\n```[ \t]*$|{_H}*\n{_S}*\n```[ \t]*$"
FENCE_OR_TAIL = rf"(?dms)^{_OPEN}(?:{_CLOSED}|{_H}*\n.*\z)"
FENCE_ALONE = rf"(?dms)\A{_OPEN}(?:{_CLOSED})\z"
FENCE_CODE = rf"(?dms)\A```[A-Za-z0-9_+\-]*{_S}*\n(.*?)\n```[ \t]*\z"
HEADING = rf"(?dm)^#{{1,6}}{_S}+.+$"
FRONTMATTER = rf"(?ds)\A---{_S}*\n.*?\n---{_S}*\n"
PLAIN_INCLUDE = rf"(?dm)^\{{!.*?!\}}{_S}*$"
CODE_INCLUDE = rf"\{{\*{_S}+((?:(?!{_S})[\s\S])+?)(?:{_S}+(?:hl|ln)\[[^\]]*\])*{_S}*\*\}}"
# Both go with the white space before them.
HEADING_ANCHOR = rf"(?dm)\{{{_S}*+#[A-Za-z0-9_\-]+{_S}*+\}}[ \t]*+$"
ATTRIBUTE_LIST = r"\{:[^}]*\}"
INCLUDE = rf"(?dm)^\{{[!*].*?[!*]\}}{_S}*$"
TITLED_ADMONITION = rf'(?dm)^!!!{_S}+{_W}+{_S}+"([^"]+)"{_S}*$'
BARE_ADMONITION = rf'(?dm)^!!!{_S}+{_W}+(?:{_S}+"")?{_S}*$'
TAB = rf'(?dm)^==={_S}+"([^"]+)"{_S}*$'
INLINE_HTML = r"(?i)</?(?:font|span|div|small|sub|sup|kbd)\b[^>]*>"
TRAILING_BLANKS = r"(?dm)(?<![ \t])[ \t]++$"
BLANK_LINES = r"\n{3,}"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

MARKDOWN_SIGNS = (
    r"(?dmU)^#{1,6}\s+\w",
    r"```",
    r"(?dmU)^\s*[-*]\s+\w",
    r"\[[^\]]+\]\([^)]+\)",
)
EXTENSIONS = {"markdown": ("md", "markdown", "mdx"), "html": ("html", "htm", "xhtml"), "text": ("txt", "rst")}
LANGUAGES = {
    "py": "python",
    "sh": "bash",
    "js": "javascript",
    "ts": "typescript",
    "html": "html",
    "css": "css",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
}

ANSWER_CODE = r"(?dsi)```\s*(?:python|py)?\s*\n(.*?)\n?```"
ANSWER_SOURCES = r"(?i)\*{0,2}\s*sources\s*\*{0,2}\s*:\s*\*{0,2}\s*\[([^\]]*)\]"

CHUNK_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 512, 100, 4
MIN_PROSE_CHARS = 30
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
NO_HITS = "(no relevant documentation chunks found for this query)"
CONTEXT_SEPARATOR = "\n\n---\n\n"
