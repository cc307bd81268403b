"""Filter interaction audit: what each filter of a cascade removes, in every order; and exact duplicates by refinement.

Duplicates: texts are split by length in code points, then by hashes of successive blocks, each 16 times as far as the
one before, and what is alone in its class drops out before the next block counts; the whole texts of what is left are
compared with the class's text of smallest doc_id, those that differ among themselves again. So hashes only save work.

Audit: a document is the set of the filters it fails, as a mask; masks are counted by part first, and all orders are
worked out from those counts, at most two to the number of filters a part.

Defined results: null text is empty; null doc_id is never smaller than another and has no smaller one either; rows of one
doc_id are not duplicates of each other; a null part is the empty string; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import store

#: Blocks end at 256 code points, then at 16 times the last end; the last of them ends beyond the longest text of Spark.
_ENDS = [256 * 16**k for k in range(7)]
_SPACE = " \t\n\x0b\x0c\r"


def class_columns(text: Column) -> list[Column]:
    """Class after length (c0) and after each block (c1, ...), as 64-bit hashes; null where a text has no such block."""
    length = F.length(text)
    found = [F.xxhash64(length).alias("c0")]
    for k, end in enumerate(_ENDS):
        start = _ENDS[k - 1] if k else 0
        found.append(F.when(length > start, F.xxhash64(F.lit(k), F.substring(text, start + 1, min(end - start, 2**31 - 2)))).alias(f"c{k + 1}"))
    return found


def _refined(classes: DataFrame) -> DataFrame:
    """``class`` of texts (c0, c1, ...) that are not alone in it."""
    alive = classes.withColumn("class", F.col("c0"))
    # written first, so that the join has a shuffle on either side and Spark may split a class of very many texts
    several = lambda df: store.cut(df.groupBy("class").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("class"), "classes-of-several")
    alive = store.cut(alive.join(several(alive), "class", "left_semi"), "classes-by-length")
    for k in range(1, len(_ENDS) + 1):
        longer = alive.where(F.col(f"c{k}").isNotNull())
        if longer.isEmpty():
            break
        split = alive.withColumn("class", F.when(F.col(f"c{k}").isNotNull(), F.xxhash64("class", f"c{k}")).otherwise(F.col("class")))
        alive = store.cut(split.join(several(split), "class", "left_semi"), f"classes-by-block-{k}")
    return alive.select("class").distinct()


def final_class() -> Column:
    """The class after all blocks, of the columns of ``class_columns``."""
    found = F.col("c0")
    for k in range(1, len(_ENDS) + 1):
        found = F.when(F.col(f"c{k}").isNotNull(), F.xxhash64(found, F.col(f"c{k}"))).otherwise(found)
    return found


def mark_duplicates(documents: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """doc_id, ``measures`` (columns of documents (doc_id, text, ...)) and duplicate: whether a smaller doc_id has the text.

    Texts are read twice: once for measures and classes, and once for those in a class with others.
    """
    docs = documents.withColumn("text", F.coalesce("text", F.lit("")))
    measured = store.cut(docs.select("doc_id", *[c.alias(f"_{name}") for name, c in measures.items()], *class_columns(F.col("text"))), "measures")
    names = [F.col(f"_{name}").alias(name) for name in measures]
    shared = store.cut(_refined(measured.select(*[f"c{k}" for k in range(len(_ENDS) + 1)])), "shared-classes")
    alone = measured.withColumn("class", final_class()).join(shared, "class", "left_anti").select("doc_id", *names, F.lit(False).alias("duplicate"))
    classed = docs.select("*", *class_columns(F.col("text"))).withColumn("_class", final_class())
    members = classed.join(shared.withColumnRenamed("class", "_class"), "_class", "left_semi")
    members = store.cut(members.select("_class", "doc_id", "text", *[c.alias(f"_{name}") for name, c in measures.items()]), "texts-of-shared-classes")
    out = alone
    while True:  # once, unless hashes of different texts are equal
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
        least = members.groupBy("_class").agg(F.min_by(F.struct(F.col("doc_id").alias("_first"), F.col("text").alias("_text")), order).alias("_least"))
        least = store.cut(least, "first-texts")
        compared = members.join(least.hint("merge"), "_class").withColumn("_same", F.col("text") == F.col("_least._text"))
        compared = store.cut(compared.select(*members.columns, "_same", F.col("_least._first").alias("_first")).withColumn("text", F.when(~F.col("_same"), F.col("text"))), "compared-texts")
        duplicate = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
        out = out.unionByName(compared.where("_same").select("doc_id", *names, duplicate.alias("duplicate")))
        members = compared.where("not _same").drop("_same", "_first")
        if members.isEmpty():
            return out


def text_flags(text: Column) -> dict[str, Column]:
    """The filters of a text alone, true where it fails: few words, words that repeat, capitals, odd symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), 1)
    flags = F.element_at(F.transform(F.array(counts), lambda c: F.struct((c["n"] < 200).alias("A"), (100 * c["distinct"].cast("long") < 50 * c["n"].cast("long")).alias("B"))), 1)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "words": flags,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def interactions(masks: DataFrame, filters: str) -> DataFrame:
    """Every order of ``filters`` (a letter each, few of them) over masks (part, mask, good, toxic), step by step.

    Bit k of the mask says that filter k fails. Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.
    """
    one = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    cells = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2 ** len(filters) each
    orders = F.array(*[F.lit("".join(x)) for x in itertools.permutations(filters)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), letter) - 1)
    before = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("step")), lambda k: F.when(k < F.col("step"), bit(F.substring(F.col("filter_order"), k, F.lit(1)))).otherwise(0)), F.lit(0), lambda a, b: a.bitwiseOR(b))
    steps = steps.select("*", before.alias("before"), bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).alias("bit"))

    def total(what: str, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda s, c: s + c[what])

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    earlier = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    removed = lambda c: fails(c) & ~earlier(c)
    n_orders = len(list(itertools.permutations(filters)))  # of the orders, one in as many begins with this one of a mask's filters as the mask has
    shapley = F.aggregate(F.filter("cells", fails), F.lit(0).cast("long"), lambda s, c: s + c["n"] * (n_orders / F.bit_count(c["mask"])).cast("long"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda c: fails(c) & earlier(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over documents (doc_id, text, source) with labels (doc_id, quality, toxic); part is the source."""
    flags = text_flags(F.col("text"))
    marked = mark_duplicates(documents.select("doc_id", "text", "source"), {"source": F.col("source"), **flags})
    bits = (F.col("words.A"), F.col("words.B"), F.col("C"), F.col("D"), F.col("duplicate"))
    mask = sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))
    known = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    masks = marked.select("doc_id", F.col("source").alias("part"), mask.alias("mask")).join(known, "doc_id", "left")
    return interactions(masks, "ABCDE")
