"""The numbered queries: each reads its whole table and derives the contract's columns from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, filter_audit, htmlcut, huffman, langid, licences, minhash, packing, pieces, quality, spelling, store, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = store.fresh_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), root)
    return warc.read_warc(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP1_SQL = """
with p as (
  select page_id, url, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages
), f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first < p.page_id then f.first end as refers_to, p.url
from p left join f on p.d = f.d and p.n >= 100
"""


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = store.fresh_dir(spark, "token-files")
    huffman.write_token_files(_table(spark, sf_dir, "documents"), root, word_tokenizer(), end_id=2, id_bytes=2)
    return huffman.read_token_files(spark, root, ids=False).drop("ids")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed_spans(_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# Exact quantiles stand for the sketches, which are exact up to 2,048 values.
OP4_SQL = r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), g as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w
), r as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
p as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from r where c > 1) group by doc_id),
m as (
  select w.doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(l) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words
  from w left join p on p.doc_id = w.doc_id
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    word_chars / n_words as a1, n_symbols / n_words as a2, n_dup_lines / n_lines as a3, n_repeat_words / n_words as a4 from m
), s as (
  select lang, source, count(*) as n, list_sort(list(a1)) as l1, list_sort(list(a2)) as l2, list_sort(list(a3)) as l3, list_sort(list(a4)) as l4,
    list_sort(coalesce(list(a2) filter (a2 > 0), [])) as s2, list_sort(coalesce(list(a3) filter (a3 > 0), [])) as s3, list_sort(coalesce(list(a4) filter (a4 > 0), [])) as s4
  from b where not base_failed group by grouping sets ((lang, source), (lang), ())
), f as (
  select lang, source, n, n / (n + 50.0) as w,
    l1[cast(ceil(0.9 * n) as bigint)] + 3.0 * (l1[cast(ceil(0.9 * n) as bigint)] - l1[cast(ceil(0.5 * n) as bigint)]) as h1, l1[cast(ceil(0.1 * n) as bigint)] - 3.0 * (l1[cast(ceil(0.5 * n) as bigint)] - l1[cast(ceil(0.1 * n) as bigint)]) as b1,
    l2[cast(ceil(0.9 * n) as bigint)] + 3.0 * (l2[cast(ceil(0.9 * n) as bigint)] - l2[cast(ceil(0.5 * n) as bigint)]) as h2,
    l3[cast(ceil(0.99 * n) as bigint)] + 1.0 * (l3[cast(ceil(0.99 * n) as bigint)] - l3[cast(ceil(0.5 * n) as bigint)]) as h3,
    l4[cast(ceil(0.99 * n) as bigint)] + 2.0 * (l4[cast(ceil(0.99 * n) as bigint)] - l4[cast(ceil(0.5 * n) as bigint)]) as h4,
    coalesce(s2[cast(ceil(0.1 * len(s2)) as bigint)], 0) as p2, len(s2) / (len(s2) + 50.0) as w2,
    coalesce(s3[cast(ceil(0.1 * len(s3)) as bigint)], 0) as p3, len(s3) / (len(s3) + 50.0) as w3,
    coalesce(s4[cast(ceil(0.1 * len(s4)) as bigint)], 0) as p4, len(s4) / (len(s4) + 50.0) as w4
  from s
), u as (
  select o.lang, o.source, o.w * o.h1 + (1 - o.w) * (x.w * x.h1 + (1 - x.w) * y.h1) as h1, o.w * o.b1 + (1 - o.w) * (x.w * x.b1 + (1 - x.w) * y.b1) as b1,
    greatest(o.w * o.h2 + (1 - o.w) * (x.w * x.h2 + (1 - x.w) * y.h2), 0.2 * (o.w2 * o.p2 + (1 - o.w2) * (x.w2 * x.p2 + (1 - x.w2) * y.p2))) as h2,
    greatest(o.w * o.h3 + (1 - o.w) * (x.w * x.h3 + (1 - x.w) * y.h3), 0.2 * (o.w3 * o.p3 + (1 - o.w3) * (x.w3 * x.p3 + (1 - x.w3) * y.p3))) as h3,
    greatest(o.w * o.h4 + (1 - o.w) * (x.w * x.h4 + (1 - x.w) * y.h4), 0.2 * (o.w4 * o.p4 + (1 - o.w4) * (x.w4 * x.p4 + (1 - x.w4) * y.p4))) as h4
  from f o join f x on x.lang = o.lang and x.source is null join f y on y.lang is null where o.source is not null
)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and a1 between b1 and h1
  and n_symbols <= h2 * n_words + 3.0 * sqrt(h2 * n_words + 1) and n_dup_lines <= h3 * n_lines + 3.0 * sqrt(h3 * n_lines + 1)
  and n_repeat_words <= h4 * n_words + 3.0 * sqrt(h4 * n_words + 1) as kept
from b left join u on u.lang = b.lang and u.source = b.source
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_corpus(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_found"), F.size(sure).cast("long").alias("n_confirmed"), "family")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end_id=1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontam.digest_items(F.col("items")).alias("items_sha256"),
        decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = langid.fold(F.col("doc_id"))
    dictionaries = langid.train(docs.where(fold != 2))
    found = langid.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return htmlcut.extract(pages, htmlcut.train(pages))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(_table(spark, sf_dir, "documents"), piece_model(), end_id=2)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.words(_table(spark, sf_dir, "documents"))
    runs = runs.select("word", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word"))).alias("h"))
    short = spelling.drop_code_point(F.col("word"), (F.col("h") % F.length("word")).cast("int"))
    return spelling.group_variants(spelling.count_words(runs.select(F.when(F.col("h") % 199 == 0, short).otherwise(F.col("word")).alias("word"))))


# The unsigned crc32 is worked out byte by byte from its table; letters beyond ASCII become single bytes, by which DuckDB's levenshtein counts.
OP12_SQL = r"""
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t
), r as (
  select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents) group by 1, 2
), b as (
  select w, n, list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar || ':' || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end))) as b from r
), h as (
  select w, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::bigint) as h from b, t
), x as (
  select case when h % 199 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, n from h
), v as (
  select word, cast(sum(n) as bigint) as n, length(word) as l,
    translate(word, (select string_agg(chr(k::int), '' order by k) from range(192, 256) as q(k)), (select string_agg(chr(k::int), '' order by k) from (select * from range(1, 97) as q(k) where k <> 39) where k < 66)) as a
  from x where length(word) >= 6 group by word having sum(n) >= 5
), near as (
  select p.word, q.word as near, q.n as near_n from v p join v q on q.l between p.l - 1 and p.l + 1 and p.word <> q.word and levenshtein(p.a, q.a) = 1
), best as (
  select word, count(*) as n_near, max(near_n) as near_n, arg_min(near, (-near_n, near)) as near from near group by word
), f as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * v.n then near end as form, case when near_n >= 5 * v.n then near_n end as form_n from v left join best on best.word = v.word
), walk as (
  select word, word as root, form as onward from f
  union all
  select walk.word, f.word, f.form from walk join f on f.word = walk.onward
)
select f.word, f.form, walk.root, f.n, f.n_near, f.form_n from f join walk on walk.word = f.word and walk.onward is null
"""


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first from documents
), m as (
  select d.doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, d.doc_id > first as e, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
  from d left join labels on labels.doc_id = d.doc_id
), k as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n, sum(good::int) as good, sum(toxic::int) as toxic from m group by all
), l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), o as (
  select p.x || q.x || r.x || s.x || u.x as filter_order from l p, l q, l r, l s, l u where len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), st as (
  select filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) as f,
    list_sum(list_concat([0], list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1)))) as p
  from o, (select unnest(range(1, 6)) as step)
), y as (
  select part, filter_order, step::int as step, f, sum(case when k.mask & (f | p::int) = 0 then n else 0 end)::bigint as kept,
    sum(case when k.mask & f > 0 and k.mask & p::int = 0 then n else 0 end)::bigint as removed, sum(case when k.mask & f > 0 and k.mask & p::int > 0 then n else 0 end)::bigint as redundant,
    sum(case when k.mask = f then n else 0 end)::bigint as unique_fails, sum(case when k.mask & f > 0 and k.mask & p::int = 0 then good else 0 end)::bigint as good_lost,
    sum(case when k.mask & f > 0 and k.mask & p::int = 0 then toxic else 0 end)::bigint as toxic_lost
  from k, st group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from y
"""


OP5_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) = 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words
), sh as (select doc_id, unnest(s) as g from sets), n as (select doc_id, len(s) as n from sets),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
), pairs as (select x, y from links union all select y, x from links),
reach as (
  select doc_id as d, doc_id as c from documents
  union
  select pairs.y, reach.c from reach join pairs on pairs.x = reach.d
), best as (select d, min(c) as component_id from reach group by d)
select n.doc_id, cast(n.n as bigint) as n_shingles, best.component_id, n.doc_id = best.component_id as kept
from n join best on best.d = n.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_huffman": op2_huffman, "op3_suffix": op3_suffix, "op4_quality": op4_quality, "op5_minhash": op5_minhash, "op6_licences": op6_licences, "op7_packing": op7_packing, "op8_decontamination": op8_decontamination, "op9_language": op9_language, "op10_html": op10_html, "op11_pieces": op11_pieces, "op12_spelling": op12_spelling, "op13_filters": op13_filters}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_quality": OP4_SQL, "op5_minhash": OP5_SQL, "op12_spelling": OP12_SQL, "op13_filters": OP13_SQL}
