"""Registered queries over the driver's tables, each with its SQL where SQL can say it.

Views that both engines read are SQL texts that run unchanged in either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import answers as A
from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.jobs import workloads as W
from quillspark.operators import answers as AN
from quillspark.operators import chunks as C
from quillspark.operators import documents as D
from quillspark.operators import prompts as PR
from quillspark.operators import retrieval as R
from quillspark.operators import stats as S
from quillspark.sources import documents as SRC
from quillspark.streaming import ingest as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives its rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


MD_DOCS = """select doc_id, concat('docs/', source, '/d-', cast(doc_id as string), '.md') as path,
 concat('---', chr(10), 'title: t', cast(doc_id as string), chr(10), '---', chr(10),
 '# Doc ', cast(doc_id as string), ' { #doc-', cast(doc_id as string), ' }', chr(10), chr(10),
 '!!! nöte', chr(160), '"Note ', cast(doc_id % 7 as string), '"', chr(10), chr(10), text, '  ', chr(10), chr(10), chr(10), chr(10),
 '```python', chr(10), '# step', chr(10), 'x = ', cast(doc_id as string), chr(10), '```', chr(10), chr(10),
 '## Tail ', cast(doc_id % 5 as string), chr(10), chr(10), '=== "Tab"', chr(10), chr(10),
 '<span class="k">', substring(text,1,200), '</span>', chr(160), '{: .c }', chr(10), chr(10),
 '```', chr(10), 'ls', chr(10), '```', chr(10)) as raw from documents"""
RESPONSES = """select conv_id * 100 + turn as response_id, turn, concat('Intro.', chr(10),
 case turn % 3 when 0 then '```python' when 1 then '```py' else '```Python' end, chr(10),
 case when turn % 4 = 3 then 'def f(:' else concat('x = ', cast(turn as string)) end, chr(10), '```', chr(10),
 text, chr(10), case turn % 5 when 0 then 'Sources: []' when 1 then concat('Sources: [1, ', cast(turn as string), ']')
 when 2 then '**Sources:** [2 x 3]' when 3 then '' else 'sources: [4,5]' end) as response
from conversations where role = 'assistant'"""
STORE = """select vec_id as id, concat('d', cast(label % 3 as string)) as source_doc, concat('s', cast(label as string)) as section,
 concat('chunk ', cast(vec_id as string)) as text, label, embedding from embeddings"""
ASKED = "select vec_id as query_id, concat('question ', cast(vec_id as string)) as query, label, embedding from embeddings where vec_id % 50 = 0"
# Fences, cleaned piece by piece, in DuckDB's regular expressions.
_FENCE = r"(?ms)^```[A-Za-z0-9_+\-]*\s*\n.*?\n```[ \t]*$"


# White space and word characters in their Unicode meaning.
_S, _W = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"[\p{L}\p{N}_]"
_SQL_STRIP = f"^{_S}+|{_S}+$"
_SQL_STEPS = {
    "strip_heading_anchors": (rf"(?m)[ \t]*\{{{_S}*#[A-Za-z0-9_\-]+{_S}*\}}[ \t]*$", ""),
    "strip_attr_lists": (rf"{_S}*\{{:[^}}]*\}}", ""),
    "strip_includes": (rf"(?m)^\{{[!*].*?[!*]\}}{_S}*$", ""),
    "titled_admonition": (rf'(?m)^!!!{_S}+{_W}+{_S}+"([^"]+)"{_S}*$', r"**\1**"),
    "bare_admonition": (rf'(?m)^!!!{_S}+{_W}+(?:{_S}+"")?{_S}*$', ""),
    "tabs_to_bold": (rf'(?m)^==={_S}+"([^"]+)"{_S}*$', r"**\1**"),
    "strip_inline_html": (r"(?i)</?(?:font|span|div|small|sub|sup|kbd)\b[^>]*>", ""),
    "strip_trailing_ws": (r"(?m)[ \t]+$", ""),
    "collapse_blank_lines": (r"\n{3,}", "\n\n"),
}


def _sql_clean(text: str, *steps: str) -> str:
    for step in steps or _SQL_STEPS:
        pattern, to = _SQL_STEPS[step]
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


SQL_PARSED = rf"with md as ({MD_DOCS}), body as (select doc_id, path, regexp_replace(raw, '(?s)\A---\s*\n.*?\n---\s*\n', '') as text from md)"
SQL_CLEANED = rf"""{SQL_PARSED}, parts as (
 select doc_id, path, regexp_split_to_array(text, '{_FENCE}') as prose, regexp_extract_all(text, '{_FENCE}') as code from body
), cleaned as (
 select doc_id, path, concat(regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(prose) + 1),
   lambda i: concat({_sql_clean('prose[i]')}, coalesce(code[i], ''))), ''), '\n{{3,}}', '{chr(10)}{chr(10)}', 'g'), '{_SQL_STRIP}', '', 'g'), chr(10)) as text from parts
)"""
SQL_SEGMENTS = rf"""{SQL_CLEANED}, cut as (
 select doc_id, path, text, regexp_split_to_array(text, '{_FENCE}') as prose, regexp_extract_all(text, '{_FENCE}') as code from cleaned
), pairs as (
 select doc_id, path, text, unnest(range(1, len(prose) + 1)) as i, unnest(prose) as p, unnest(list_transform(range(1, len(prose) + 1), lambda i: code[i])) as c from cut
), seg as (
 select doc_id, path, text, 2 * i as o, 'prose' as kind, p as content from pairs union all select doc_id, path, text, 2 * i + 1, 'code', c from pairs where c is not null
), segments as (
 select doc_id, path, text, kind, content, row_number() over w - 1 as seg,
  coalesce(sum(length(content)) over (partition by doc_id order by o rows between unbounded preceding and 1 preceding), 0) as start
 from seg where content <> '' window w as (partition by doc_id order by o)
)"""


def _sql_split(source: str) -> str:
    """Views that end in split(g, n, piece): the recursive split of texts (g, t) of a view, in recursive SQL.

    node: a text and the coarsest separator in it; its long pieces are nodes again. run: pieces that fit, between long
    ones, with the places where each ends if all are joined. walk: one step for each chunk of a run, from its first to its
    last piece; the next begins with the pieces of its end that make the overlap.
    """
    size, overlap = 2048, 400
    pick = "case when l <= 1 and contains(t, chr(10) || chr(10)) then 1 when l <= 2 and contains(t, chr(10)) then 2 when l <= 3 and contains(t, '. ') then 3 when l <= 4 and contains(t, ' ') then 4 else 5 end"
    marks = "[chr(10) || chr(10), chr(10), '. ', ' ', '']"
    pieces = "select g, key, k, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as p"
    return f"""node as (
 select g, [0::bigint] as key, 1 as l, t from {source} where t <> ''
 union all
 select g, list_append(key, i), k + 1, p from ({pieces} from (select g, key, k, string_split(t, {marks}[k]) as ps from (select *, {pick} as k from node))) where k < 5 and length(p) >= {size}
), divided as (select g, key, k, string_split(t, {marks}[k]) as ps from (select *, {pick} as k from node)),
piece as (select *, k < 5 and length(p) >= {size} as long from ({pieces} from divided) where p <> ''),
numbered as (select *, count(*) filter (long) over (partition by g, key order by i) as r from piece),
summed as (select *, sum(length(p) + length({marks}[k])) over (partition by g, key, r order by i) as c from numbered where not long),
placed as (select g, list_append(key, min(i)) as key, {marks}[k] as mark, length({marks}[k]) as s, list(p order by i) as ps, list(c::bigint order by i) as c from summed group by g, key, k, r),
walk as (
 select g, key, mark, ps, s, c, 0 as n, 1::bigint as lo, greatest(1, len(list_filter(c, lambda x: x - s <= {size})))::bigint as hi from placed
 union all
 select g, key, mark, ps, s, c, n + 1, lo, greatest(hi + 1, len(list_filter(c, lambda x: x - coalesce(c[lo - 1], 0) - s <= {size})))::bigint from (
  select g, key, mark, ps, s, c, n, hi, coalesce(list_min(list_filter(range(lo + 1, hi + 1), lambda j: c[hi] - coalesce(c[j - 1], 0) - s <= {overlap} and c[hi + 1] - coalesce(c[j - 1], 0) - s <= {size})), hi + 1)::bigint as lo
  from walk where hi < len(ps))
), split as (
 select g, row_number() over (partition by g order by key, n) - 1 as n, piece from (select g, key, n, regexp_replace(list_reduce(ps[lo:hi], lambda x, y: x || mark || y), '{_SQL_STRIP}', '', 'g') as piece from walk) where piece <> ''
)"""


SQL_CHUNKS = f"""{SQL_SEGMENTS.replace("with md as", "with recursive md as", 1)}, full_segments as (select * from segments where regexp_matches(content, '[^ \\n]')),
long_prose as (select doc_id * 1000 + seg as g, content as t from full_segments where kind = 'prose' and length(content) >= 2048), {_sql_split("long_prose")}, cuts as (
 select doc_id, start, seg, 0 as k, kind, case when kind = 'code' then content else regexp_replace(content, '{_SQL_STRIP}', '', 'g') end as text from full_segments where kind = 'code' or length(content) < 2048
 union all select doc_id, start, seg, n, kind, piece from full_segments join split on g = doc_id * 1000 + seg
), heads as (
 select doc_id, case k when 0 then concat('Doc ', cast(doc_id as string)) when 1 then 'step' else concat('Tail ', cast(doc_id % 5 as string)) end as title,
  case k when 0 then 0 when 1 then strpos(text, chr(10) || '# step' || chr(10)) else strpos(text, chr(10) || '## Tail ') end as pos from cleaned, (select unnest([0, 1, 2]) as k)
), named as (select c.*, coalesce((select arg_max(title, pos) from heads h where h.doc_id = c.doc_id and h.pos <= c.start), 'intro') as section,
 row_number() over (partition by doc_id order by start, k) - 1 as n from cuts c where kind = 'code' or text <> '' and (contains(text, '```') or length(text) >= 30)
), chunks as (
 select concat(source, '-d-', cast(doc_id as string), '_', trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-'), '_', cast(n as string)) as id, text, concat(source, '-d-', cast(doc_id as string)) as source_doc,
  section, cast(start as int) as position, kind = 'code' or contains(text, '```') as has_code from named join (select doc_id, source from documents) using (doc_id)
)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """A view over one table, without a name that other queries could meet; documents of a small table are dealt out."""
    sql = sql.replace("{", "{{").replace("}", "}}").replace(f"from {table}", "from {t}")
    rows = _table(spark, sf_dir, table)
    return spark.sql(sql, t=SRC.spread(rows) if table == "documents" else rows)


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MD_DOCS, "documents")


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _md(spark, sf_dir).withColumn("text", X.strip_plain_includes(X.strip_frontmatter(F.col("raw"))))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("doc_id", "path", X.clean_text(F.col("text")).alias("text"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RESPONSES, "conversations")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STORE, "embeddings")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ASKED, "embeddings")


# Sources


@query("select doc_id, text from documents")
def read_documents(spark, sf_dir):
    """Documents written as files and read from the folder: a file's lines are the ids and letters of 256 documents at most,
    as a file that is read is a row, however the table is split."""
    path = SRC.scratch_dir(spark, "read.documents")
    lines = _table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.replace("text", F.lit("\n"), F.lit("\x1f"))).alias("value"))
    lines.write.option("maxRecordsPerFile", 256).text(path)
    found = SRC.read_documents(spark, path, "*.txt").select(F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line"))
    return found.select(F.substring_index("line", " ", 1).cast("long").alias("doc_id"), F.replace(F.expr("substring(line, instr(line, ' ') + 1)"), F.lit("\x1f"), F.lit("\n")).alias("text"))


@query("select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents")
def decode_text(spark, sf_dir):
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.encode("text", "ISO-8859-1"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.decode_text(content).alias("text"))


@query("select url as path, md5(html) as digest from pages where regexp_matches(url, '^https?://')")
def pages_source(spark, sf_dir):
    return SRC.pages_source(_table(spark, sf_dir, "pages")).select("path", F.md5("content").alias("digest"))


@query("select doc_id from documents where doc_id % 10 <> 0 and regexp_matches(text, '\\S')")
def drop_blank_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, " \n\t").otherwise(F.col("text")).alias("content"))
    return SRC.drop_blank_documents(docs).select("doc_id")


@query("select case when page_id % 9 = 0 then 'no content' when page_id % 9 = 1 then 'blank content' end as error, count(*) as n from pages group by 1")
def isolate_failures(spark, sf_dir):
    content = F.when(F.col("page_id") % 9 == 0, None).when(F.col("page_id") % 9 == 1, " ").otherwise(F.col("html"))
    return SRC.isolate_failures(_table(spark, sf_dir, "pages").select(content.alias("content"))).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# Formats and parsing


@query(
    r"""with d as (select page_id, case page_id % 4 when 0 then url else concat('p', cast(page_id as string), case page_id % 4 when 1 then '.MD' when 2 then '.txt' else '' end) end as hint,
 case when page_id % 8 = 7 then concat('# T', chr(10), '- a [b](c)') else html end as c from pages),
h as (select page_id, lower(regexp_extract(regexp_extract(regexp_replace(hint, '/+$', ''), '([^/]*)$', 1), '[^.]\.([^.]+)$', 1)) as ext, c, lower(substring(ltrim(c, ' ' || chr(9) || chr(10) || chr(13)), 1, 2000)) as head from d)
select page_id, case when ext in ('md', 'markdown', 'mdx') then 'markdown' when ext in ('html', 'htm', 'xhtml') then 'html' when ext in ('txt', 'rst') then 'text'
 when starts_with(head, '<!doctype html') or starts_with(head, '<html') or contains(head, '<body') or contains(head, '<div') then 'html'
 when cast(regexp_matches(c, '(?m)^#{1,6}\s+\w') as int) + cast(contains(c, '```') as int) + cast(regexp_matches(c, '(?m)^\s*[-*]\s+\w') as int) + cast(regexp_matches(c, '\[[^\]]+\]\([^)]+\)') as int) >= 2 then 'markdown'
 else 'text' end as format from h"""
)
def detect_format(spark, sf_dir):
    n = F.col("page_id") % 4
    hint = F.when(n == 0, F.col("url")).otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(n == 1, ".MD").when(n == 2, ".txt").otherwise("")))
    content = F.when(F.col("page_id") % 8 == 7, "# T\n- a [b](c)").otherwise(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", X.detect_format(content, hint).alias("format"))


@query(f"{SQL_PARSED} select doc_id, text from body")
def strip_frontmatter(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", X.strip_frontmatter(F.col("raw")).alias("text"))


@query(rf"select doc_id, regexp_replace(concat('a', chr(10), '{{! x.md !}}', chr(160), chr(10), text), '(?m)^\{{!.*?!\}}{_S}*$', '', 'g') as text from documents")
def strip_plain_includes(spark, sf_dir):
    text = F.concat(F.lit("a\n{! x.md !}\u00a0\n"), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.strip_plain_includes(text).alias("text"))


@query(
    rf"""{SQL_PARSED}, cut as (select doc_id, regexp_split_to_array(text, '{_FENCE}') as prose, regexp_extract_all(text, '{_FENCE}') as fences from body
), f as (select doc_id, fences, prose, unnest(range(1, len(fences) + 1)) as k from cut
), placed as (select doc_id, k, fences[k] as whole, list_sum(list_transform(prose[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(fences[1:k - 1], lambda x: length(x))), 0) as start from f)
select doc_id, cast(k - 1 as int) as id, case k when 1 then 'python' else 'text' end as language, regexp_extract(whole, '(?s)^```[^\n]*\n(.*)\n```[ \t]*$', 1) as code, cast(start as int) as start, cast(start + length(whole) as int) as "end" from placed"""
)
def extract_code_blocks(spark, sf_dir):
    return _body(spark, sf_dir).select("doc_id", F.inline(X.code_blocks(F.col("text"))))


@query(
    r"""with d as (select doc_id from documents)
select doc_id, 1 as level, concat('Doc ', cast(doc_id as string), ' { #doc-', cast(doc_id as string), ' }') as title from d union all
select doc_id, 1, 'step' from d union all select doc_id, 2, concat('Tail ', cast(doc_id % 5 as string)) from d"""
)
def extract_sections(spark, sf_dir):
    return _body(spark, sf_dir).select("doc_id", F.inline(X.sections(F.col("text"))))


@query(r"select doc_id, case when doc_id % 2 = 0 then concat('T ', cast(doc_id as string)) else coalesce(nullif(regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1), ''), concat('D ', cast(doc_id as string), ' Page')) end as title from documents")
def document_title(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## x\n# T "), number, F.lit("\n"))).otherwise("## y\n"), F.col("text"))
    path = F.concat(F.lit("docs/d-"), number, F.lit("_page.md"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.document_title(text, path).alias("title"))


@query(f"{SQL_PARSED} select doc_id, text, concat('Doc ', cast(doc_id as string), ' {{ #doc-', cast(doc_id as string), ' }}') as title, cast(3 as int) as n_sections, cast(2 as int) as n_code, 'markdown' as doc_type from body")
def parse_markdown(spark, sf_dir):
    parsed = D.parse_markdown(_md(spark, sf_dir).select("path", F.col("raw").alias("content")))
    number = F.regexp_extract("path", r"d-(\d+)\.md$", 1).cast("long")
    return parsed.select(number.alias("doc_id"), "text", "title", F.size("sections").alias("n_sections"), F.size("code_blocks").alias("n_code"), "doc_type")


def _with_includes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    rel = F.concat(F.when(F.col("doc_id") % 2 == 0, "../../docs_src/f").otherwise("f"), n, F.lit(".py"))
    text = F.concat(F.lit("a\n\n{* "), rel, F.lit(" hl[1:2] ln[3] *}\n\nb {* gone.py *}\n"), F.col("text"))
    return docs.select("doc_id", F.concat(F.lit("repo/docs/en/d"), n, F.lit(".md")).alias("path"), text.alias("text"))


def _include_files(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("repo/docs_src/f"), n, F.lit(".py"))).otherwise(F.concat(F.lit("repo/docs/en/f"), n, F.lit(".py")))
    rows = _table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(path.alias("path"), F.concat(F.lit("x = "), n, F.lit("\n\n")).alias("content"))
    return rows


@query(
    r"""select doc_id, case when doc_id % 5 = 0 then concat('a', chr(10), chr(10), '{* ', case when doc_id % 2 = 0 then '../../docs_src/f' else 'f' end, cast(doc_id as string), '.py hl[1:2] ln[3] *}', chr(10), chr(10), 'b {* gone.py *}', chr(10), text)
 else concat('a', chr(10), chr(10), chr(10), '```python', chr(10), 'x = ', cast(doc_id as string), chr(10), '```', chr(10), chr(10), chr(10), 'b {* gone.py *}', chr(10), text) end as text
from documents"""
)
def resolve_includes(spark, sf_dir):
    return D.resolve_includes(_with_includes(spark, sf_dir), _include_files(spark, sf_dir)).select("doc_id", "text")


@query("select doc_id, case when doc_id % 5 = 0 then 0 else 1 end as resolved, case when doc_id % 5 = 0 then 2 else 1 end as unresolved from documents")
def include_counts(spark, sf_dir):
    return D.resolve_includes(_with_includes(spark, sf_dir), _include_files(spark, sf_dir)).select("doc_id", "resolved", "unresolved")


_SQL_ENTITIES = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query("select page_id, trim(" + _SQL_ENTITIES.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + ") as title from pages")
def html_title(spark, sf_dir):
    return _parsed_pages(spark, sf_dir).select("page_id", "title")


@query("select page_id, 1 as level, trim(" + _SQL_ENTITIES.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + ") as title from pages")
def html_sections(spark, sf_dir):
    return _parsed_pages(spark, sf_dir).select("page_id", F.inline("sections"))


def _sql_page_text(page: str) -> str:
    """The text of a page whose chrome is well nested: what stands between tags, each on lines of its own, without chrome."""
    bare = rf"regexp_replace({page}, '(?s)<(script|style|nav|header|footer|aside|form)\b[^>]*>.*?</(script|style|nav|header|footer|aside|form)>', '<i>', 'g')"
    parts = rf"list_filter(regexp_split_to_array({bare}, '(?s)<!--.*?-->|<[^>]*>'), lambda x: x <> '')"
    return rf"regexp_replace(array_to_string(list_transform({parts}, lambda x: {_SQL_ENTITIES.format('x')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"select page_id, {_sql_page_text('html')} as text from pages")
def html_to_text(spark, sf_dir):
    return _parsed_pages(spark, sf_dir).select("page_id", "text")


_CHROME = "concat('<header>HE</header><form>FO</form><aside>AS</aside>', html)"


@query(f"select page_id, {_sql_page_text(_CHROME)} as text from pages")
def html_strip_chrome(spark, sf_dir):
    return _parsed_pages(spark, sf_dir, _CHROME).select("page_id", "text")


@query("select page_id, 'py' as language, concat('x = ', cast(page_id as string)) as code from pages")
def html_code_to_fence(spark, sf_dir):
    content = F.concat(F.lit("<pre>a</pre><pre><code class='a language-py'>x = "), F.col("page_id").cast("string"), F.lit("</code></pre>"), F.col("html"))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), content.alias("content"))
    return D.or_fail(D.parse_html(pages), "path").select(F.col("path").cast("long").alias("page_id"), F.explode("code_blocks").alias("b")).select("page_id", "b.language", "b.code")


def _parsed_pages(spark, sf_dir, content="html"):
    """Parts of all pages; as these queries have no column for errors, a page that can't be parsed fails them."""
    return D.or_fail(D.page_parts(_table(spark, sf_dir, "pages").withColumn("content", F.expr(content)), "page_id"), "page_id")


@query(
    f"""{SQL_PARSED}, p as (select url, trim({_SQL_ENTITIES.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) as title, {_sql_page_text('html')} as text from pages where regexp_matches(url, '^https?://'))
select path, concat('Doc ', cast(doc_id as string), ' {{ #doc-', cast(doc_id as string), ' }}') as title, 'markdown' as doc_type, 3 as n_sections, 2 as n_code, cast(length(text) as int) as n_chars, md5(text) as digest from body
union all select url, title, 'html', 1, 0, cast(length(text) as int), md5(text) from p"""
)
def parse_documents(spark, sf_dir):
    md = _md(spark, sf_dir).select("path", F.col("raw").alias("content"))
    pages = SRC.pages_source(_table(spark, sf_dir, "pages"))
    return D.parse_documents(md.unionByName(pages)).select("path", "title", "doc_type", F.size("sections").alias("n_sections"), F.size("code_blocks").alias("n_code"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("select page_id, page_id % 9 = 2 as failed from pages")
def failed_pages(spark, sf_dir):
    """Pages that the parser gives up on fail alone."""
    content = F.when(F.col("page_id") % 9 == 2, F.concat(F.lit("<![x[ y ]]>"), F.col("html"))).otherwise(F.col("html"))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), content.alias("content"))
    return D.parse_documents(pages).select(F.col("path").cast("long").alias("page_id"), F.col("error").isNotNull().alias("failed"))


@query(f"select page_id, {_sql_page_text('html')} as text from pages")
def html_misnested(spark, sf_dir):
    """Chrome that isn't closed in order ends with the element around it."""
    content = "concat('<header><nav>a</header><nav><form></nav>', html)"
    return _parsed_pages(spark, sf_dir, content).select("page_id", "text")


# Cleaning


def _register_steps() -> None:
    """Each step over all documents, between marks that it works on, no-break spaces and letters beyond ASCII among them."""
    for name, step, head, tail in (
        ("strip_heading_anchors", X.strip_heading_anchors, "## T { #a-b }\n", "\n# U {\u00a0#c} \n"),
        ("strip_attr_lists", X.strip_attribute_lists, "a\u00a0{: .b #c }\n", "\n\u2003{: x}d"),
        ("strip_includes", X.strip_includes, "{! a.md !}\u00a0\n", "\n{* b.py *}\n"),
        ("tabs_to_bold", X.tabs_to_bold, '===\u00a0"A b"\n\n', '\n=== "C"\n'),
        ("strip_inline_html", X.strip_inline_html, '<span class="k">', "</SPAN><kbd>x</kbd><p>"),
        ("strip_trailing_ws", X.strip_trailing_blanks, "a \t\n", " \n b  \n"),
        ("collapse_blank_lines", X.collapse_blank_lines, "a\n\n\n\n", "\n\n\nb\n\n"),
    ):

        def run(spark, sf_dir, step=step, head=head, tail=tail):
            raw = F.concat(F.lit(head), F.col("text"), F.lit(tail), F.col("doc_id").cast("string"))
            return _table(spark, sf_dir, "documents").select("doc_id", step(raw).alias("text"))

        run.__name__ = name
        query("select doc_id, " + _sql_clean(f"concat('{head}', text, '{tail}', cast(doc_id as string))", name) + " as text from documents")(run)


_register_steps()


@query(f"""with r as (select doc_id, concat('!!!', chr(160), 'nöte "N ', cast(doc_id % 7 as string), '"', chr(10), chr(10), '!!! tip', chr(160), chr(10), chr(10), text) as raw from documents)
select doc_id, {_sql_clean("raw", "titled_admonition", "bare_admonition")} as text from r""")
def admonitions_to_bold(spark, sf_dir):
    raw = F.concat(F.lit('!!!\u00a0nöte "N '), (F.col("doc_id") % 7).cast("string"), F.lit('"\n\n'), F.lit("!!! tip\u00a0\n\n"), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.admonitions_to_bold(raw).alias("text"))


@query(f"{SQL_CLEANED} select doc_id, text from cleaned")
def clean_text(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", "text")


# Chunks


@query(f"{SQL_SEGMENTS} select doc_id, cast(seg as int) as seg, kind, cast(start as int) as start, content from segments")
def segment_text(spark, sf_dir):
    found = _cleaned(spark, sf_dir).select("doc_id", F.posexplode(X.segments(F.col("text"))).alias("seg", "s"))
    return found.select("doc_id", "seg", "s.kind", "s.start", "s.content")


@query(
    rf"""{SQL_SEGMENTS}, heads as (select doc_id, case k when 0 then concat('Doc ', cast(doc_id as string)) when 1 then 'step' else concat('Tail ', cast(doc_id % 5 as string)) end as title,
  case k when 0 then 0 when 1 then strpos(text, chr(10) || '# step' || chr(10)) else strpos(text, chr(10) || '## Tail ') end as pos
  from cleaned, (select unnest([0, 1, 2]) as k))
select s.doc_id, cast(seg as int) as seg, coalesce((select arg_max(title, pos) from heads h where h.doc_id = s.doc_id and h.pos <= s.start), 'intro') as section from segments s"""
)
def section_at(spark, sf_dir):
    found = _cleaned(spark, sf_dir).select("doc_id", X.headings(F.col("text")).alias("h"), F.transform(X.segments(F.col("text")), lambda s: s["start"]).alias("at"))
    return found.select("doc_id", F.posexplode(X.sections_at(F.col("h"), F.col("at"))).alias("seg", "section"))


@query(f"with recursive whole as (select doc_id as g, text as t from documents), {_sql_split('whole')} select g as doc_id, cast(n as int) as n, cast(length(piece) as int) as n_chars, md5(piece) as digest from split")
def split_prose(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.get(C.splitter(2048, 400)(F.array("text")), 0)).alias("n", "piece")).select("doc_id", "n", F.length("piece").alias("n_chars"), F.md5("piece").alias("digest"))


@query(f"""{SQL_SEGMENTS}, t as (select doc_id, cast(seg as int) as seg, regexp_replace(content, '{_SQL_STRIP}', '', 'g') as text from segments where kind = 'prose')
select doc_id, seg, length(text) >= 30 or contains(text, '```') as kept from t where text <> ''""")
def drop_short_prose(spark, sf_dir):
    found = _cleaned(spark, sf_dir).select("doc_id", F.posexplode(X.segments(F.col("text"))).alias("seg", "s")).where("s.kind = 'prose'")
    return found.select("doc_id", "seg", X.strip(F.col("s.content")).alias("text")).where("text <> ''").select("doc_id", "seg", C.keep_prose(F.col("text")).alias("kept"))


@query(r"select distinct url, case when s = '' then 'doc' else case when p in ('', '.', 'docs') then s else p || '-' || s end end as doc_name from (select url, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '(?s)^(.+)\.[^.]+$', '\1') as s, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]+)/+[^/]*$', 1) as p from pages)")
def doc_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("url", X.doc_name(F.col("url")).alias("doc_name")).distinct()


@query(r"select doc_id, coalesce(nullif(rtrim(substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'section') as slug from documents")
def slug(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query(f"{SQL_CHUNKS} select id, text, source_doc, section, position, has_code from chunks")
def chunk_ids(spark, sf_dir):
    return C.semantic_chunk(_cleaned(spark, sf_dir)).select("id", "text", "source_doc", "section", "position", "has_code")


@query(f"{SQL_CHUNKS} select id, source_doc, section, position, has_code, cast(length(text) as int) as n_chars from chunks")
def semantic_chunk(spark, sf_dir):
    return W.ingest(_md(spark, sf_dir).select("path", F.col("raw").alias("content"))).select("id", "source_doc", "section", "position", "has_code", F.length("text").alias("n_chars"))


@query(f"{SQL_CHUNKS} select id, has_code from chunks")
def flag_code(spark, sf_dir):
    return C.semantic_chunk(_cleaned(spark, sf_dir)).select("id", "has_code")


@query(f"{SQL_CHUNKS} select id, concat('[Doc: ', source_doc, '] [Section: ', section, ']', chr(10), chr(10), text) as embedding_text from chunks")
def embedding_text(spark, sf_dir):
    return C.semantic_chunk(_cleaned(spark, sf_dir)).select("id", X.embedding_text(F.col("source_doc"), F.col("section"), F.col("text")).alias("embedding_text"))


@query(f"{SQL_CHUNKS} select id, text, source_doc, section, position, has_code from chunks")
def chunks_round_trip(spark, sf_dir):
    path = SRC.scratch_dir(spark, "chunks")
    SRC.write_chunks(C.semantic_chunk(_cleaned(spark, sf_dir)), path)
    return SRC.read_chunks(spark, path)


def _upsert(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    half = F.lit(docs.count() // 2)
    base = docs.where(F.col("doc_id") < half + 100).select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(0).cast("long").alias("seq"))
    new = docs.where(F.col("doc_id") >= half - 100).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("new "), F.col("text")).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return base, new.select("id", F.concat(F.col("seq").cast("string"), F.lit(" "), F.col("text")).alias("text"), F.col("seq").cast("long"))


@query("select cast(doc_id as string) as id, case when doc_id >= n // 2 - 100 then concat('2 new ', text) else text end as text, cast(case when doc_id >= n // 2 - 100 then 2 else 0 end as bigint) as seq from documents, (select count(*) as n from documents)")
def upsert_chunks(spark, sf_dir):
    return C.upsert_chunks(*_upsert(spark, sf_dir))


@query("select cast(doc_id as string) as id, concat('2 new ', text) as text from documents, (select count(*) as n from documents) where doc_id >= n // 2 - 100")
def reset_collection(spark, sf_dir):
    """A store that is reset before a batch holds the batch alone."""
    base, new = _upsert(spark, sf_dir)
    return C.upsert_chunks(C.reset_collection(base), new).select("id", "text")


@query("select n_before, n_upserted, n_after from (select count(*) filter (doc_id < n // 2 + 100) as n_before, 2 * count(*) filter (doc_id >= n // 2 - 100) as n_upserted, count(*) as n_after from documents, (select count(*) as n from documents))")
def collection_counts(spark, sf_dir):
    base, new = _upsert(spark, sf_dir)
    return C.collection_counts(base, new, C.upsert_chunks(base, new))


@query("select cast(doc_id % 100 as string) as id, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return C.duplicate_ids(_table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).cast("string").alias("id")))


@query(f"{SQL_CHUNKS} select id, text, source_doc, section, position, has_code from chunks")
def ingest_stream(spark, sf_dir):
    """A stream of documents in several files ends in the same store as one batch."""
    source, store, checkpoint = (SRC.scratch_dir(spark, f"stream-{x}") for x in ("source", "store", "checkpoint"))
    docs = _cleaned(spark, sf_dir).select("path", F.col("text").alias("content"))
    docs.write.parquet(source)
    docs.where(F.pmod(F.hash("path"), F.lit(3)) == 0).write.mode("append").parquet(source)  # some come twice
    running = ST.ingest_stream(spark, source, store, checkpoint, files_a_batch=3)
    running.awaitTermination()
    return ST.stored_chunks(spark, store).drop("seq")


# Vectors and retrieval


@query("select vec_id, case when vec_id % 10 = 1 then 'wrong dimension' when vec_id % 10 = 2 then 'missing' else 'valid' end as state from embeddings")
def check_vectors(spark, sf_dir):
    vector = F.when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 10 != 2, F.col("embedding"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", V.vector_state(vector, 64).alias("state"))


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * (vec_id % 5)) as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v)
select vec_id, place, round(cast(cast(case when n = 0 then 0.0 else v[place + 1] / n end as float) as double), 4) as x from (select *, unnest(range(len(v))) as place from n)"""
)
def l2_normalise(spark, sf_dir):
    raw = F.transform("embedding", lambda x: (x.cast("double") * (F.col("vec_id") % 5)).cast("double"))
    found = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.l2_normalise(raw)).alias("place", "x"))
    return found.select("vec_id", F.col("place").cast("long"), F.round(F.col("x").cast("double"), 4).alias("x"))


_SQL_DISTANCE = "round(1 - list_dot_product(cast({0} as double[]), cast({1} as double[])) / (sqrt(list_dot_product(cast({0} as double[]), cast({0} as double[]))) * sqrt(list_dot_product(cast({1} as double[]), cast({1} as double[])))), 6)"
_SQL_HITS = f"""with store as ({STORE}), asked as ({ASKED}), pairs as (
 select query_id, s.id, s.source_doc, s.section, s.text, s.label = a.label as relevant, {_SQL_DISTANCE.format('a.embedding', 's.embedding')} as distance from asked a join store s on s.id <> a.query_id
), near as (select *, row_number() over (partition by query_id order by distance, id) as rank from pairs)"""
_SQL_RETRIEVED = f"""{_SQL_HITS}, penalised as (
 select *, round(distance + greatest(0, row_number() over (partition by query_id, source_doc order by rank) - 2) * 0.05, 6) as adjusted from near where rank <= 10 and distance <= 0.8
), hits as (select * exclude (rank, adjusted), new_rank as rank from (select *, row_number() over (partition by query_id order by adjusted, rank) as new_rank from penalised) where new_rank <= 5)"""


@query(f"{_SQL_HITS} select query_id, id, distance from pairs")
def cosine_distance(spark, sf_dir):
    """Every fiftieth row against all, block against block."""
    return R.distances(_asked(spark, sf_dir), _store(spark, sf_dir)).where(F.col("id") != F.col("query_id"))


@query(f"{_SQL_HITS} select query_id, id, distance, cast(rank as int) as rank from near where rank <= 10")
def knn_search(spark, sf_dir):
    return R.knn_search(_asked(spark, sf_dir), _store(spark, sf_dir), 10, exclude_self=True)


@query(f"{_SQL_HITS} select query_id, id, distance from near where rank <= 10 and distance <= 0.8")
def distance_filter(spark, sf_dir):
    return R.distance_filter(R.knn_search(_asked(spark, sf_dir), _store(spark, sf_dir), 10, exclude_self=True), 0.8).select("query_id", "id", "distance")


@query(f"{_SQL_RETRIEVED} select query_id, id, cast(rank as int) as rank from (select query_id, id, row_number() over (partition by query_id order by adjusted, rank) as rank from penalised)")
def diversity_rerank(spark, sf_dir):
    hits = R.distance_filter(R.knn_search(_asked(spark, sf_dir), _store(spark, sf_dir), 10, exclude_self=True), 0.8).join(_store(spark, sf_dir).select("id", "source_doc"), "id")
    return R.diversity_rerank(hits).select("query_id", "id", "rank")


def _hits(spark, sf_dir):
    return R.retrieve(_asked(spark, sf_dir), _store(spark, sf_dir), k=5, bound=0.8, exclude_self=True)


@query(f"{_SQL_RETRIEVED} select query_id, id, source_doc, section, text, distance, cast(rank as int) as rank from hits")
def retrieve(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "id", "source_doc", "section", "text", "distance", "rank")


_SQL_CONTEXT = """, contexts as (select a.query_id, a.query, coalesce((select string_agg(concat('[Source ', cast(rank as string), ': ', source_doc, ' / ', section, ']', chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) order by rank)
 from hits h where h.query_id = a.query_id), '(no relevant documentation chunks found for this query)') as context from asked a)"""


@query(f"{_SQL_RETRIEVED}{_SQL_CONTEXT} select query_id, context from contexts")
def construct_context(spark, sf_dir):
    return R.construct_context(_asked(spark, sf_dir), _hits(spark, sf_dir))


@query(f"{_SQL_RETRIEVED}{_SQL_CONTEXT} select query_id, context, (select count(*) from hits h where h.query_id = contexts.query_id) as n_hits from contexts")
def retrieve_context(spark, sf_dir):
    contexts, hits = R.retrieve_context(_asked(spark, sf_dir), _store(spark, sf_dir), k=5, bound=0.8, exclude_self=True)
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return contexts.join(counts, "query_id", "left").select("query_id", "context", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"))


@query(
    f"""with store as ({STORE}), asked as ({ASKED}), pairs as (
 select a.query_id, s.id, {_SQL_DISTANCE.format('a.embedding', 's.embedding')} as distance, 0 as w from asked a join store s on s.id <> a.query_id
 union all select a.query_id - 50, s.id, {_SQL_DISTANCE.format('a.embedding', 's.embedding')}, 1 from asked a join store s on s.id <> a.query_id where a.query_id > 0
), near as (select *, row_number() over (partition by query_id, w order by distance, id) as r from pairs), least as (select query_id, id, min(distance) as distance from near where r <= 5 group by 1, 2)
select query_id, id, distance, cast(row_number() over (partition by query_id order by distance, id) as int) as rank from least"""
)
def union_retrieve(spark, sf_dir):
    """The next query stands for the rewritten one."""
    hits = R.knn_search(_asked(spark, sf_dir), _store(spark, sf_dir), 5, exclude_self=True)
    rewritten = hits.where("query_id > 0").withColumn("query_id", F.col("query_id") - 50)
    return R.union_hits(hits, rewritten)


@query(
    f"""{_SQL_RETRIEVED}, relevance as (select query_id, id from pairs where relevant), r as (select query_id, count(*) as n from relevance group by 1),
 f as (select query_id, count(*) as n, min(rank) as first_rank from hits where relevant group by 1)
select r.query_id, round(coalesce(f.n, 0) / 5, 6) as precision, round(coalesce(f.n, 0) / r.n, 6) as recall, round(case when f.n is null then 0.0 else 2 * (f.n / 5) * (f.n / r.n) / (f.n / 5 + f.n / r.n) end, 6) as f1, cast(first_rank as int) as first_rank from r left join f on f.query_id = r.query_id"""
)
def retrieval_metrics(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("query_id", F.col("label").alias("l"))
    relevance = R.meet(asked, _store(spark, sf_dir).select("id", "label"), "id", F.col("l") == F.col("label"))  # labels are few, so each is dealt out
    relevance = relevance.where(F.col("id") != F.col("query_id")).select("query_id", "id")
    return R.retrieval_metrics(_hits(spark, sf_dir), relevance, 5)


_REWRITES = "case conv_id % 4 when 0 then concat('- \"', replace(text, chr(10), ' '), '\"', chr(10), 'x') when 1 then '' when 2 then repeat('a', 201) else concat('  ', chr(96), 'q ', cast(turn as string), chr(96), ' ') end"


@query(
    f"""with r as (select conv_id, turn, text, {_REWRITES} as raw from conversations), l as (select *, split_part(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), chr(10), 1) as line from r),
c as (select *, regexp_replace(ltrim(trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '"''' || chr(96)), '- '), '^\\s+|\\s+$', '', 'g') as clean from l)
select conv_id, turn, case when clean = '' or length(clean) > 200 then text else clean end as query from c"""
)
def clean_rewrite(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("raw", F.expr(_REWRITES))
    return rows.select("conv_id", "turn", A.clean_rewrite(F.col("raw"), F.col("text")).alias("query"))


# Prompts


@query(f"{_SQL_RETRIEVED}{_SQL_CONTEXT} select query_id, concat('Context:', chr(10), context, chr(10), 'Question: ', query) as user_prompt from contexts")
def build_prompts(spark, sf_dir):
    rows = R.construct_context(_asked(spark, sf_dir), _hits(spark, sf_dir)).join(_asked(spark, sf_dir).select("query_id", "query"), "query_id")
    return PR.build_prompts(rows, "Be brief.", "Context:\n{context}\nQuestion: {query}", ("context", "query")).select("query_id", "user_prompt")


@query(f"with r as ({RESPONSES}) select response_id, concat('Fix:', chr(10), 'def f(:', chr(10), '- line 1, col 7: invalid syntax') as user_prompt from r where turn % 4 = 3")
def build_regeneration_prompts(spark, sf_dir):
    rows = AN.validate_syntax(AN.parse_responses(_responses(spark, sf_dir)))
    return PR.build_regeneration_prompts(rows, "Fix:\n{previous_code}\n{errors}").select("response_id", "user_prompt")


@query("select conv_id, turn, concat('<|im_start|>system', chr(10), role, '<|im_end|>', chr(10), '<|im_start|>user', chr(10), text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) as chat from conversations")
def chat_format(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", A.chat_format(F.col("role"), F.col("text")).alias("chat"))


# Answers

_SQL_PARTS = f"""with r as ({RESPONSES}), p as (select *, case when turn % 4 = 3 then 'def f(:' else concat('x = ', cast(turn as string)) end as code,
 case turn % 5 when 0 then [] when 1 then [1, cast(turn as int)] when 2 then [2, 3] when 3 then [] else [4, 5] end as sources from r)"""


@query(f"{_SQL_PARTS} select response_id, code from p")
def response_code(spark, sf_dir):
    return _responses(spark, sf_dir).select("response_id", A.response_code(F.col("response")).alias("code"))


@query(f"{_SQL_PARTS} select response_id, array_to_string(sources, ',') as sources from p")
def response_sources(spark, sf_dir):
    return _responses(spark, sf_dir).select("response_id", F.array_join(A.response_sources(F.col("response")).cast("array<string>"), ",").alias("sources"))


@query("select conv_id * 100 + turn as response_id, trim(text, ' ' || chr(10)) as explanation from conversations where role = 'assistant'")
def response_explanation(spark, sf_dir):
    return _responses(spark, sf_dir).select("response_id", A.response_explanation(F.col("response")).alias("explanation"))


@query(f"{_SQL_PARTS}, t as (select conv_id * 100 + turn as response_id, trim(text, ' ' || chr(10)) as explanation from conversations where role = 'assistant') select p.response_id, code, array_to_string(sources, ',') as sources, explanation from p join t on t.response_id = p.response_id")
def parse_responses(spark, sf_dir):
    return AN.parse_responses(_responses(spark, sf_dir)).select("response_id", "code", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), "explanation")


@query(f"with r as ({RESPONSES}) select response_id, turn % 4 <> 3 as valid, cast(case when turn % 4 = 3 then 1 end as int) as line, cast(case when turn % 4 = 3 then 7 end as int) as col, case when turn % 4 = 3 then 'invalid syntax' end as message from r")
def validate_syntax(spark, sf_dir):
    rows = AN.validate_syntax(AN.parse_responses(_responses(spark, sf_dir)))
    first = F.get("errors", F.lit(0))
    return rows.select("response_id", "valid", first["line"].alias("line"), first["column"].alias("col"), first["message"].alias("message"))


@query("select doc_id, case doc_id % 4 when 0 then '(no errors)' when 1 then concat('- line 3, col 5: m', text) when 2 then '- line 3: m' else concat('- (no location): m', chr(10), '- line 1: n') end as errors from documents")
def format_errors(spark, sf_dir):
    e = lambda line, column, m: F.struct(F.lit(line).cast("int").alias("line"), F.lit(column).cast("int").alias("column"), m.alias("message"))
    n = F.col("doc_id") % 4
    none = F.array().cast("array<struct<line:int,column:int,message:string>>")
    errors = F.when(n == 0, none).when(n == 1, F.array(e(3, 5, F.concat(F.lit("m"), F.col("text"))))).when(n == 2, F.array(e(3, None, F.lit("m")))).otherwise(F.array(e(None, None, F.lit("m")), e(1, None, F.lit("n"))))
    return _table(spark, sf_dir, "documents").select("doc_id", A.format_errors(errors).alias("errors"))


@query(
    f"""{_SQL_PARTS}, a as (select response_id // 100 as query_id, turn as attempt, code, turn % 4 <> 3 as valid from p)
select query_id, max(valid) as valid, coalesce(arg_min(code, attempt) filter (valid), arg_max(code, attempt)) as code, cast(coalesce(min(attempt) filter (valid), max(attempt)) as int) as n_retries from a group by query_id"""
)
def resolve_attempts(spark, sf_dir):
    """The answers of a conversation as the attempts at one question."""
    rows = AN.validate_syntax(AN.parse_responses(_responses(spark, sf_dir)))
    attempts = rows.select(F.expr("response_id div 100").alias("query_id"), F.col("turn").cast("int").alias("attempt"), "code", "valid")
    return AN.resolve_attempts(attempts)


# Code with a whole document as its comments, and lint issues found in its lines.
SNIPPETS = """select doc_id as snippet_id, concat(case doc_id % 8 when 0 then 'eval(x)' when 1 then concat('import subprocess', chr(10), 'subprocess.run(y)', chr(10))
 when 2 then 'import os' when 3 then concat('x = 1', chr(10), chr(10), 'y = 2') when 4 then 'def f(:' when 5 then '' when 6 then concat('os.system(a)', chr(10), 'os.path.join(b)') else 'a.eval(x)' end,
 chr(10), '# ', replace(text, chr(10), concat(chr(10), '# '))) as code from documents"""
_ISSUE = "case when length(s) > 79 then 'E501' when s = '# ' then 'I001' when s like '% ' then 'W291' when s like 'import %' then 'F401' when s = 'def f(:' then 'E999' end"


def _snippets(spark, sf_dir):
    return _view(spark, sf_dir, SNIPPETS, "documents")


def _issues(spark, sf_dir):
    lines = _snippets(spark, sf_dir).select("snippet_id", F.posexplode(F.split("code", "\n")).alias("line", "s"))
    return lines.select("snippet_id", "line", F.expr(_ISSUE).alias("code")).where("code is not null")


_SQL_ISSUES = f"with snippets as ({SNIPPETS}), i as (select snippet_id, unnest(string_split(code, chr(10))) as s from snippets), issues as (select snippet_id, code from (select snippet_id, {_ISSUE} as code from i) where code is not null)"
_SQL_LINES = "len(string_split(code, chr(10)))"
_SQL_SCORES = f"""{_SQL_ISSUES}, k as (select snippet_id, count(*) filter (code in ('F401', 'E999')) as n_errors, count(*) filter (code not in ('F401', 'E999')) as n_warnings, count(*) filter (code[1] in ('E', 'W')) as style from issues group by 1),
s as (select n.snippet_id, coalesce(n_errors, 0) as n_errors, coalesce(n_warnings, 0) as n_warnings, {_SQL_LINES} as line_count, coalesce(style, 0) as style from snippets n left join k on k.snippet_id = n.snippet_id),
scored as (select snippet_id, n_errors, n_warnings, cast(line_count as int) as line_count, greatest(0.0, least(100.0, 100.0 * (1 - style / line_count))) as pep8_score from s)"""


@query("select doc_id as snippet_id, case doc_id % 8 when 0 then 'eval()' when 1 then 'subprocess.run()' else 'os.system()' end as pattern, cast(case when doc_id % 8 = 1 then 2 else 1 end as int) as line from documents where doc_id % 8 in (0, 1, 6)")
def security_flags(spark, sf_dir):
    return AN.security_flags(_snippets(spark, sf_dir)).select("snippet_id", F.inline("flags")).select("snippet_id", "pattern", "line")


@query(f"{_SQL_ISSUES} select snippet_id, code, case when code in ('F401', 'E999') then 'error' else 'warning' end as kind from issues")
def split_lint_issues(spark, sf_dir):
    return AN.split_lint_issues(_issues(spark, sf_dir)).select("snippet_id", "code", "kind")


@query(f"{_SQL_SCORES} select snippet_id, round(pep8_score, 6) as pep8_score from scored")
def pep8_score(spark, sf_dir):
    return AN.pep8_scores(_snippets(spark, sf_dir), _issues(spark, sf_dir)).select("snippet_id", F.round("pep8_score", 6).alias("pep8_score"))


@query(f"select snippet_id, cast({_SQL_LINES} as int) as n_lines from ({SNIPPETS})")
def line_count(spark, sf_dir):
    return _snippets(spark, sf_dir).select("snippet_id", X.line_count(F.col("code")).alias("n_lines"))


@query(f"{_SQL_SCORES} select snippet_id, n_errors, n_warnings, line_count, round(pep8_score, 6) as pep8_score, cast(case when snippet_id % 8 in (0, 1, 6) then 1 else 0 end as int) as n_flags, snippet_id % 3 <> 1 as valid from scored")
def quality_report(spark, sf_dir):
    rows = AN.quality_report(_snippets(spark, sf_dir).withColumn("lint_ran", F.col("snippet_id") % 3 != 1), _issues(spark, sf_dir))
    return rows.select("snippet_id", "n_errors", "n_warnings", "line_count", F.round("pep8_score", 6).alias("pep8_score"), "n_flags", "valid")


@query("select doc_id, cast(case when doc_id % 5 = 0 or doc_id % 7 = 0 then 2 when doc_id % 3 = 0 or doc_id % 2 = 0 then 0 else 1 end as int) as status from documents")
def query_status(spark, sf_dir):
    n = F.col("doc_id")
    status = A.query_status(n % 5 != 0, n % 7 != 0, F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("x"), F.col("text"))), n % 2 == 0)
    return _table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


def _answers_to(spark, sf_dir):
    """Every answer with a question of its own kind: questions are asked again for each answer that they have."""
    asked = _asked(spark, sf_dir)
    rows = _responses(spark, sf_dir).withColumn("asked_id", F.pmod("response_id", F.lit(max(1, asked.count()))) * 50)
    return rows.join(asked.select(F.col("query_id").alias("asked_id"), "query", "embedding"), "asked_id")


_SQL_ANSWERS = f"r as ({RESPONSES}), chosen as (select response_id, turn, response_id % (select count(*) from asked) * 50 as asked_id from r)"


@query(
    f"""{_SQL_RETRIEVED}, {_SQL_ANSWERS} select c.response_id as query_id, a.query, cast((select count(*) from hits h where h.query_id = c.asked_id) as int) as n_hits, coalesce((select string_agg(cast(id as string), ',' order by rank) from hits h where h.query_id = c.asked_id), '') as ids,
 case when turn % 4 = 3 then 'def f(:' else concat('x = ', cast(turn as string)) end as code, cast(case when not exists (select 1 from hits h where h.query_id = c.asked_id) then 2 when turn % 4 = 3 then 1 else 0 end as int) as status from chosen c join asked a on a.query_id = c.asked_id"""
)
def result_payload(spark, sf_dir):
    """The second workload over all answers: retrieval, answers, validation, payload, status; the payload's fields."""
    answers = _answers_to(spark, sf_dir)
    asked = answers.select(F.col("response_id").alias("query_id"), "query", "embedding")
    store = _store(spark, sf_dir)
    one = answers.select(F.col("asked_id").alias("query_id"), "query", "embedding").dropDuplicates(["query_id"])
    hits = R.retrieve(one, store, k=5, bound=0.8, exclude_self=True)
    links = answers.select("response_id", F.col("asked_id").alias("query_id"))
    found = W.answer_found(asked, hits.join(links, "query_id").drop("query_id").withColumnRenamed("response_id", "query_id"), answers.select(F.col("response_id").alias("query_id"), "response"))
    kind = "query string, retrieved array<struct<source_doc:string,section:string,distance:double,id:string>>, code string, explanation string, sources array<int>"
    p = found.select("query_id", "status", F.from_json("payload", kind).alias("p"))
    ids = F.array_join(F.transform("p.retrieved", lambda h: h["id"]), ",")
    return p.select("query_id", "p.query", F.size("p.retrieved").alias("n_hits"), ids.alias("ids"), "p.code", "status")


@query(
    f"""{_SQL_RETRIEVED}, {_SQL_ANSWERS}, cited as (select response_id, asked_id, unnest(case turn % 5 when 0 then [] when 1 then [1, cast(turn as int)] when 2 then [2, 3] when 3 then [] else [4, 5] end) as cited from chosen)
select c.response_id as query_id, cast(cited as int) as cited, h.id, h.id is not null as resolved from cited c join asked a on a.query_id = c.asked_id left join hits h on h.query_id = c.asked_id and h.rank = cited"""
)
def citation_check(spark, sf_dir):
    answers = _answers_to(spark, sf_dir)
    links = answers.select(F.col("response_id"), F.col("asked_id").alias("query_id"))
    hits = _hits(spark, sf_dir).join(links, "query_id").drop("query_id").withColumnRenamed("response_id", "query_id")
    return R.citation_check(AN.parse_responses(answers.select(F.col("response_id").alias("query_id"), "response")), hits)


# Statistics


@query("select count(*) as n_files, cast(sum(length(text)) as bigint) as n_chars, cast(sum(length(text)) // 4 as bigint) as n_tokens from documents")
def corpus_summary(spark, sf_dir):
    return S.corpus_summary(_table(spark, sf_dir, "documents"))


@query(f"""{SQL_CHUNKS} select source_doc, count(*) as n_chunks, count(*) filter (has_code) as n_code, round(avg(length(text)), 6) as avg_chars, cast(min(length(text)) as int) as min_chars, cast(max(length(text)) as int) as max_chars,
 round(100.0 * count(*) filter (has_code) / count(*), 6) as code_percent from chunks group by rollup (source_doc)""")
def chunk_stats(spark, sf_dir):
    return S.chunk_stats(C.semantic_chunk(_cleaned(spark, sf_dir)))


@query("select item_id, cast(w as int) as word_count, case when w < 30 then 'below' when w > 40 then 'above' else 'within' end as band from (select item_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')) as w from benchmark)")
def tutorial_word_band(spark, sf_dir):
    words = X.word_count(F.col("text"))
    return _table(spark, sf_dir, "benchmark").select("item_id", words.alias("word_count"), S.word_band(words, 30, 40).alias("band"))


@query("""select count(*) as n_sources, count(*) filter (k = 0) as n_missing, count(*) filter (k = 1) as n_blank, count(*) filter (k = 2) as n_parse_errors,
 count(*) filter (k = 3) as n_unchunked, true as all_counted from (select doc_id % 9 as k from documents)""")
def ingest_progress(spark, sf_dir):
    """Documents with failures among them, counted while their chunks are written; as many chunks are there as were counted."""
    kind = F.col("doc_id") % 9
    content = F.when(kind == 1, " \n\u00a0").when(kind == 2, F.concat(F.lit("<html><![x[ y ]]>"), F.col("raw"))).when(kind == 3, "too short").when(kind != 0, F.col("raw"))
    path = F.when(kind == 2, F.concat("path", F.lit(".html"))).otherwise(F.col("path"))
    chunks, progress = W.ingest_counted(_md(spark, sf_dir).select(path.alias("path"), content.alias("content")))
    folder = SRC.scratch_dir(spark, "ingested")
    chunks.write.parquet(folder)
    found = progress()
    written = spark.read.schema(chunks.schema).parquet(folder).agg(F.count(F.lit(1)).alias("n"))
    names = ("n_sources", "n_missing", "n_blank", "n_parse_errors", "n_unchunked")
    return written.select(*[F.lit(found[x]).cast("long").alias(x) for x in names], (F.col("n") == found["n_chunks"]).alias("all_counted"))


@query("select concat('b', cast(conv_id % 3 as string)) as backend, count(*) as n_answers, round(avg(case when turn % 4 = 3 then 0.0 else 1.0 end), 6) as validity from conversations where role = 'assistant' group by 1")
def validity_rate(spark, sf_dir):
    rows = AN.validate_syntax(AN.parse_responses(_responses(spark, sf_dir)))
    backend = F.concat(F.lit("b"), (F.floor(F.col("response_id") / 100) % 3).cast("string"))
    return S.validity_rate(rows.select(backend.alias("backend"), "valid"))


@query("select slug, arg_max(text, item_id) as markdown from (select item_id, text, coalesce(nullif(rtrim(substring(trim(regexp_replace(lower(substring(text, 1, 12)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'tutorial') as slug from benchmark) group by slug")
def write_tutorials(spark, sf_dir):
    path = SRC.scratch_dir(spark, "tutorials")
    rows = _table(spark, sf_dir, "benchmark").select(X.slug(F.substring("text", 1, 12), empty="tutorial").alias("slug"), F.col("text").alias("markdown"), F.col("item_id").alias("seq"))
    SRC.write_tutorials(rows, path)
    return spark.read.schema("value string, slug string").text(path, wholetext=True).select("slug", F.regexp_replace("value", r"\n\z", "").alias("markdown"))


@query(
    f"""{_SQL_RETRIEVED}{_SQL_CONTEXT}, t as (select item_id % (select count(*) from asked) * 50 as query_id, text as markdown from benchmark)
select c.query_id, concat('question-', cast(c.query_id as string)) as slug, concat('On question ', cast(c.query_id as string), ': ', context) as user_prompt, cast(len(regexp_extract_all(markdown, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as int) as word_count, 'below' as band from contexts c join t on t.query_id = c.query_id"""
)
def generate_tutorials(spark, sf_dir):
    """The third workload: topics, context, prompt, and what was written on them."""
    topics = _asked(spark, sf_dir).withColumnRenamed("query", "topic")
    place = F.pmod("item_id", F.lit(max(1, topics.count()))) * 50
    written = _table(spark, sf_dir, "benchmark").select(place.alias("query_id"), F.col("text").alias("markdown"))
    rows = W.tutorials(topics, _store(spark, sf_dir), written, template="On {topic}: {context}", k=5, bound=0.8, exclude_self=True)
    return rows.select("query_id", "slug", "user_prompt", "word_count", "band")


_SQL_EMBEDDED = f"{SQL_CHUNKS} select id, 'valid' as state, 1.0::double as norm from chunks"


@query(_SQL_EMBEDDED)
def embed_texts(spark, sf_dir):
    """Chunks of all documents with vectors of a hashing embedder, which stands for a model."""
    return _embedded(C.embed_texts(C.semantic_chunk(_cleaned(spark, sf_dir)), hashing_embedder, 16))


@query(_SQL_EMBEDDED)
def embed_once(spark, sf_dir):
    """The same through a store of vectors, which the second of two runs finds full."""
    chunks, store = C.semantic_chunk(_cleaned(spark, sf_dir)), SRC.scratch_dir(spark, "vectors")
    C.embed_once(chunks, hashing_embedder, 16, store)
    return _embedded(C.embed_once(chunks, no_embedder, 16, store))


def _embedded(chunks):
    return chunks.select("id", V.vector_state(F.col("embedding"), 16).alias("state"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def no_embedder(texts: list[str]) -> list[list[float]]:
    raise ValueError("nothing is left to embed")


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Word counts by hash in 16 numbers, of length 1."""
    import math
    import zlib

    out = []
    for text in texts:
        v = [0.0] * 16
        for word in text.split():
            v[zlib.crc32(word.encode()) % 16] += 1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out
