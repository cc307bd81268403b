"""Quality rules with thresholds that follow the data: fences from quantile sketches per language and source.

Only DataFrame functions are used. Metrics of a text are made once, into a narrow table; mergeable KLL sketches of them
are built per language and source, and merged to languages and to all documents. A fence lies beyond a tail quantile of
a group, by so many times the way from the median to it: both where it lies and how wide it is come from the group. A
group's fences are blended with those of its language, and these with those of all documents, in proportion to counts.
Documents then join their group's fences. Where most shares of a group are zero, their quantiles say nothing; so shares
above zero have sketches and counts of their own, and a fence is at least a part of the way from zero to their lower
tail. A share is of few words or lines in a short text, so what it may be above its fence by chance, three standard
deviations of a count, is added.

Sketches are exact up to ``k`` values. Beyond, their ranks err by about a thousandth, and chance takes part: a document
that stands just at a fence may fall on either side in another run.

Defined results: null or empty text has no words and fails; null language or source is a group of its own; a value at a
fence is inside; a group without documents that pass the base rules has no fences of its own; rows that repeat have
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import store

#: Metric: (count, of how many, tail quantile, times the way from the median to it, a share of a count).
#: Symbols and word lengths mark junk, which may be near a tenth of a group; some lines and words of clean texts repeat,
#: so only the last hundredth says what is far out.
METRICS = {
    "mean_word": ("word_chars", "n_words", 0.9, 3.0, False),
    "symbol_share": ("n_symbols", "n_words", 0.9, 3.0, True),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.99, 1.0, True),
    "repeat_share": ("n_repeat_words", "n_words", 0.99, 2.0, True),
}

#: Of shares above zero: the quantile that is their lower tail, and how much of the way to it a fence is at least.
SOME = (0.1, 0.2)
SHARES = [m for m, (*_, share) in METRICS.items() if share]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though ``body`` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside windows of 3 words that the text has twice or more.

    Windows are sorted by hash, so that equal ones are neighbours; then each window's place counts the words up to the
    next such place, at most 3.
    """

    def places(windows: Column) -> Column:
        def again(x: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(windows, j - 1)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(windows, j + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(windows, again), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.get(at, j + 1) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def all_windows(w: Column) -> Column:
        window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))

    counted = _let(_let(words, all_windows), lambda x: _let(places(x), covered))
    return F.when(F.size(words) >= 3, counted).otherwise(F.lit(0))


def text_metrics(documents: DataFrame) -> DataFrame:
    """Counts of each text (doc_id, text, lang, source), without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = documents.select("doc_id", "lang", "source", counts.alias("w"), line_counts.alias("x"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return found.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "x.n_lines", "x.n_dup_lines", "w.n_repeat_words")


def base_failed(n_words: Column, n_repeat_words: Column, *, min_words: int = 50, max_repeat: int = 50) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat * n_words)


def fences(metrics: DataFrame, *, prior: float = 50.0, k: int = 2048) -> DataFrame:
    """Per language and source of ``metrics`` (with the columns of METRICS): lower and upper bound of each metric.

    ``metrics`` has the documents that pass the base rules; a hot group is a partial aggregate in every task. A group of
    n documents weighs n / (n + ``prior``) against what is above it.
    """
    above = {m: F.when(F.col(m) > 0, F.col(m)) for m in SHARES}
    some = [f(x).alias(f"{name}_{m}") for m, x in above.items() for name, f in (("n", F.count), ("some", lambda x: F.kll_sketch_agg_double(x, k)))]
    sketches = metrics.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, k).alias(m) for m in METRICS], *some)
    sketches = store.cut(sketches, "sketches")
    merged = [F.kll_merge_agg_double(m, k).alias(m) for m in [*METRICS, *(f"some_{m}" for m in SHARES)]]
    merged += [F.sum(f"n_{m}").alias(f"n_{m}") for m in SHARES]

    def bounds(rows: DataFrame, level: str) -> DataFrame:
        found = []
        for m, (_, _, tail, reach, share) in METRICS.items():
            quantile = lambda q, m=m: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
            middle, top = quantile(0.5), quantile(tail)
            found.append((top + reach * (top - middle)).alias(f"{m}_high"))
            if share:
                low = F.when(F.col(f"n_{m}") > 0, F.kll_sketch_get_quantile_double(F.col(f"some_{m}"), F.lit(SOME[0])))
                found += [F.coalesce(low, F.lit(0.0)).alias(f"{m}_some"), F.col(f"n_{m}").alias(f"{m}_n")]
            else:
                bottom = quantile(round(1 - tail, 6))
                found.append((bottom - reach * (middle - bottom)).alias(f"{m}_low"))
        return rows.select(*[c for c in ("lang", "source") if c in rows.columns], F.struct(F.col("n"), *found).alias(level))

    by_lang = sketches.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    by_all = sketches.agg(F.sum("n").alias("n"), *merged).where("n is not null")  # one row
    own, lang, all_ = bounds(sketches, "own"), bounds(by_lang, "wide").withColumnRenamed("lang", "_lang"), bounds(by_all, "all_docs")
    table = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(all_))

    def blend(c: str, n: str) -> Column:
        weight = lambda level: F.col(f"{level}.{n}") / (F.col(f"{level}.{n}") + prior)
        wide = weight("wide") * F.col(f"wide.{c}") + (1 - weight("wide")) * F.col(f"all_docs.{c}")
        return weight("own") * F.col(f"own.{c}") + (1 - weight("own")) * wide

    found = []
    for m in METRICS:
        high = blend(f"{m}_high", "n")
        found.append((F.greatest(high, SOME[1] * blend(f"{m}_some", f"{m}_n")) if m in SHARES else high).alias(f"{m}_high"))
        if m not in SHARES:
            found.append(blend(f"{m}_low", "n").alias(f"{m}_low"))
    return table.select("lang", "source", F.struct(*found).alias("fence"))


def judge(documents: DataFrame, *, prior: float = 50.0, deviations: float = 3.0) -> DataFrame:
    """Counts of each document, base_failed, kept, and broken: the metrics beyond their fence."""
    counted = store.cut(text_metrics(documents), "text-metrics")
    counted = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    passed = counted.where("not base_failed").select("lang", "source", *[(F.col(x) / F.col(n)).alias(m) for m, (x, n, *_) in METRICS.items()])
    table = store.cut(fences(passed, prior=prior), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counted.join(table, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside = []
    for m, (x, n, _, _, share) in METRICS.items():
        high = F.col(f"fence.{m}_high")
        if share:
            out = F.col(x) > high * F.col(n) + deviations * F.sqrt(high * F.col(n) + 1)
        else:
            value = F.col(x) / F.col(n)
            out = (value < F.col(f"fence.{m}_low")) | (value > high)
        outside.append(F.when(out, F.lit(m)))
    broken = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*outside)))
    found = joined.withColumn("broken", broken)
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("_lang", "_source", "fence")
