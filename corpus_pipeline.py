"""A training corpus from documents: five stages, each over all that the one before kept.

Defined results, for every stage: columns other than DOCUMENTS are left out, whatever they are called; an empty table
gives an empty one; rows are judged each for itself, also where doc_id is null or stands in several rows; whole texts of
any length are read. Null text and text without words: language ID rejects it, the later stages let it pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid, minhash, packing, queries, store, suffix_dedup

#: What every stage but the last reads and returns; other columns are left out.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language compression tells; lang becomes what it says.

    Null text, text without a letter and ties between languages go; without any labelled row all go.
    """
    docs = docs.select(*DOCUMENTS)
    labelled = docs.where(langid.fold(F.col("doc_id")) != 2)
    found = langid.identify(docs, langid.train(labelled))
    return found.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*DOCUMENTS)


def _rows(docs: DataFrame, name: str) -> DataFrame:
    """Documents with a number of each row's own, written so that it holds: doc_id may be null or repeat."""
    return store.cut(docs.select(*DOCUMENTS, F.monotonically_increasing_id().alias("row")), name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group whose sets of five-word shingles are similar by 0.8 or more.

    That is the row of smallest doc_id, nulls last. Rows without words, which have no shingles, all stay.
    """
    docs = _rows(docs, "near-duplicate-rows")
    mark = store.written()
    groups = minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), size=5)
    groups = store.cut(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "row-components")
    store.drop_since(spark, mark, groups)
    # written first, so that Spark can split a group of very many rows
    several = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    groups = store.cut(groups.join(store.cut(several, "several"), "component"), "rows-in-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text", "lang", "source").alias("content"), "row")
    ranked = store.cut(docs.select("row", rank.alias("rank")).join(groups.hint("merge"), "row"), "ranked-rows")
    kept = ranked.groupBy("component").agg(F.min("rank")["row"].alias("row")).select("row")
    dropped = store.cut(groups.select("row").join(kept, "row", "left_anti"), "near-duplicates")
    store.drop_since(spark, mark, dropped)
    return docs.join(dropped.hint("merge"), "row", "left_anti").select(*DOCUMENTS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes or more that stand elsewhere too; bytes of a character that is cut in two go with it.

    A document that loses everything goes; of several equal rows of 200 bytes or more each does, so near-dedup comes first.
    """
    found = suffix_dedup.removed_spans(docs.select(*DOCUMENTS), length=200, kept_text=True)
    raw = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    found = found.withColumn("text", F.when(F.col("n_removed") > 0, whole).otherwise(F.col("text")))
    found = found.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENTS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words or more stand in 13-word windows of the benchmark.

    With an empty benchmark all stay.
    """
    docs = _rows(docs, "decontamination-rows")
    mark = store.written()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_contamination(docs.select(F.col("row").alias("doc_id"), "text"), benchmark)
    hit = found.where(decontam.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("row"))
    hit = store.cut(hit, "contaminated")
    store.drop_since(spark, mark, hit)
    return docs.join(hit.hint("merge"), "row", "left_anti").select(*DOCUMENTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 4,096 tokens; null text is packed as its end id alone."""
    return packing.pack_documents(docs, queries.word_tokenizer(), capacity=4096, end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Compression, exact suffix removal and byte-pair tokens have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        mark, path = store.written(), store.fresh_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        store.drop_since(spark, mark)  # the stage's own tables
        if before:
            store.delete(spark, before)  # what the stage read
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
