"""Counts of corpora, chunks, ingestion and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as X


def corpus_summary(documents: DataFrame) -> DataFrame:
    """Files, characters, and tokens at four characters each, of documents (text)."""
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")
    return documents.agg(F.count(F.lit(1)).alias("n_files"), chars.alias("n_chars")).withColumn("n_tokens", F.expr(f"n_chars div {P.CHARS_PER_TOKEN}"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, those with code, and their lengths, by source_doc and in all (null source_doc)."""
    n = F.length("text")
    counted = chunks.rollup("source_doc").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if("has_code").alias("n_code"),
        F.round(F.avg(n), 6).alias("avg_chars"),
        F.min(n).alias("min_chars"),
        F.max(n).alias("max_chars"),
    )
    return counted.withColumn("code_percent", F.round(100.0 * F.col("n_code") / F.col("n_chunks"), 6))


def word_band(words: Column, least: int = 800, most: int = 1200) -> Column:
    return F.when(words < least, "below").when(words > most, "above").otherwise("within")


def tutorial_word_band(tutorials: DataFrame) -> DataFrame:
    """Add word_count and band to tutorials (markdown)."""
    words = X.word_count(F.col("markdown"))
    return tutorials.withColumn("word_count", words).withColumn("band", word_band(F.col("word_count")))


def validity_rate(answers: DataFrame) -> DataFrame:
    """Share of valid answers (backend, valid) by backend."""
    return answers.groupBy("backend").agg(F.count(F.lit(1)).alias("n_answers"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("validity"))
