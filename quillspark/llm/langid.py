"""Language identification by compression: the language whose dictionary makes a text smallest.

Texts are lower-cased, and what isn't a letter becomes space. Every language has a raw-content zstandard dictionary of
whole labelled texts. A text is cut into pieces of at most ``piece_bytes``, all of it, and every piece is compressed by
itself with each dictionary; the language with the fewest bytes over all pieces wins, and the margin to the second says
how sure that is. Small pieces lean on the dictionary and not on what came before in the text, so the margin does not
fall with a text's length. Nothing but the text is looked at.

Training sample (the documented bound): per language the labelled texts of smallest id hash among those of up to
``sample_bytes`` bytes, about ``sample_docs`` of them, in that order until they fill ``dictionary_bytes``; only these
come to the driver. A language whose texts are all longer gives ``sample_bytes`` characters from the middle of each.

Defined results: null text and text without a letter is ``und`` with score 0 and is rejected; languages that tie are
taken in order of how many labelled texts they have; without any labelled text everything is ``und``; rows that repeat
have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def normalise(text: str) -> bytes:
    """Lower-case UTF-8 in which runs of ASCII characters other than letters are one space: layout isn't language."""
    return b" ".join(text.lower().encode().translate(_TO_SPACE).split())


def train(
    labelled: DataFrame,
    *,
    sample_docs: int = 256,
    sample_bytes: int = 65_536,
    dictionary_bytes: int = 112_640,
    max_languages: int = 1_000,
) -> list[tuple[str, bytes]]:
    """Dictionaries by language, most frequent language first, from labelled rows (doc_id, text, lang).

    Counts are taken over all rows. Each language sends at most ``dictionary_bytes`` and a text to the driver; a table
    of more than ``max_languages`` languages is an error, none is left out.
    """
    rows = labelled.select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    rows = rows.where(F.octet_length("text") > 0)
    short = F.octet_length("text") <= sample_bytes
    by_lang = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("n"))
    by_lang = by_lang.select("lang", F.expr("short = 0").alias("long_only"), F.expr("if(short > 0, short, n)").alias("n"))
    counts = [(r.lang, r.n, r.long_only) for r in by_lang.orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()]
    if not counts:
        return []
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    bounds = {lang: (1 << 63) - 1 if n <= sample_docs else int(((sample_docs / n) * 2 - 1) * ((1 << 63) - 1)) for lang, n, _ in counts}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    before = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)  # about sample_docs rows
    used = short | F.col("lang").isin([lang for lang, _, long_only in counts if long_only])  # of at most max_languages
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - sample_bytes) / 2).cast("int"))
    cut = F.when(short, F.col("text")).otherwise(F.substring(F.col("text"), middle, F.lit(sample_bytes)))
    sample = rows.where(used & (F.col("h") <= F.element_at(bound, F.col("lang")))).withColumn("text", cut).withColumn("size", F.octet_length("text"))
    sample = sample.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    texts: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang, *_ in counts}
    for r in sample.where(F.col("before") < dictionary_bytes).select("lang", "h", "text").collect():
        texts[r.lang].append((r.h, normalise(r.text)))
    found = []
    for lang, *_ in counts:
        content, size = [], 0
        for _, text in sorted(texts[lang]):
            if size + len(text) > dictionary_bytes and content:
                continue
            content.append(text)
            size += len(text)
        if content:
            found.append((lang, b" ".join(reversed(content))))
    return found


def identify(
    documents: DataFrame,
    dictionaries: list[tuple[str, bytes]],
    *,
    level: int = 12,
    piece_bytes: int = 2_048,
    min_margin: float = 0.005,
) -> DataFrame:
    """Add lang_pred, score (0 to 1), margin and rejected to documents (doc_id, text); other columns stay.

    Margin is the share of bytes that the best language saves over the second; the score is margin times 10, at most 1.
    A text is compressed in equal pieces of at most ``piece_bytes``, whose sizes are added up. ``rejected`` is true for
    ``und`` and where the margin is under ``min_margin``.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)  # at most max_languages * (dictionary_bytes + 4 * sample_bytes) bytes

    @F.pandas_udf("lang_pred string, margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([lang for lang, _ in shared.value], dtype=object)

        compressors = []
        for _, content in shared.value:
            # tables sized for pieces: those for texts of unknown size take a hundred times the memory
            params = zstandard.ZstdCompressionParameters.from_level(level, source_size=piece_bytes, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
            kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kind.precompute_compress(compression_params=params)
            compressors.append(zstandard.ZstdCompressor(dict_data=kind, compression_params=params))
        for texts in batches:
            lang, margin = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for k, text in enumerate(texts):
                if text is None or not len(names) or not _LETTER.search(text):
                    continue
                raw = normalise(text)
                n = -(-len(raw) // piece_bytes)
                pieces = [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]
                sizes = [sum(len(c.compress(piece)) for piece in pieces) for c in compressors]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                lang[k] = names[best]
                rest = sizes[:best] + sizes[best + 1 :]
                margin[k] = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
            yield pd.DataFrame({"lang_pred": lang, "margin": margin})

    # said to be nondeterministic, so that a filter on its result doesn't make Spark run it twice
    found = documents.withColumn("_found", predict.asNondeterministic()(F.col("text").cast("string")))
    found = found.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn("margin", F.col("_found.margin")).drop("_found")
    found = found.withColumn("score", F.least(F.lit(1.0), F.col("margin") * 10))
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
