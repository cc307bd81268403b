"""Spelling variants: words of a corpus, those that differ by one edit, and the commoner form that each follows.

A word's mask has a bit for each letter: whether it stands in the word an odd number of times. One inserted, deleted or
replaced code point flips two bits at most, so of three bands of the mask one is equal at least. Near words are joined on
an equal band, on length (equal, or one more on one side), and on the half of the shorter length that the edit leaves as
it is, at the beginning or at the end: a band alone has few values, and its pairs would grow with the square of the
vocabulary. A pair that meets several times counts at its first band and side only; then the edit itself is verified.

Only the counts of the 90 commonest letters reach the driver, which deal letters to bits; others share those bits.

Defined results: null texts have no words; rows that repeat count again; null words are left out; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import store

#: Runs of Latin letters (fixed value).
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BANDS, _BITS = 3, 30


def words(documents: DataFrame) -> DataFrame:
    """doc_id and word, a row for each run of letters of documents (doc_id, text); only A-Z is lower-cased."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("word"))


def drop_code_point(word: Column, at: Column) -> Column:
    """A word without the code point at a place, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def count_words(rows: DataFrame, *, shortest: int = 6, least: int = 5) -> DataFrame:
    """word and n of words of at least ``shortest`` code points that occur at least ``least`` times."""
    long = rows.where(F.length("word") >= shortest).select("word")
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _masked(counted: DataFrame) -> DataFrame:
    """Add length and the three bands of the mask; letters are dealt to the bands by how common they are."""
    letters = counted.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''")
    ranked = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "letter").limit(_BANDS * _BITS).collect()
    known = F.create_map(*[F.lit(v) for k, r in enumerate(ranked) for v in (r.letter, k)]) if ranked else F.create_map().cast("map<string,int>")
    place = lambda x: F.coalesce(F.try_element_at(known, x), F.pmod(F.ascii(x), F.lit(_BANDS * _BITS)))
    places = F.transform(F.filter(F.split("word", ""), lambda x: x != ""), place)
    found = counted.select("word", "n", F.length("word").alias("length"), places.alias("places"))

    def band(b: int) -> Column:
        own = F.filter("places", lambda p: p % _BANDS == b)
        return F.aggregate(own, F.lit(0), lambda m, p: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(p / _BANDS).cast("int"))))

    return found.select("word", "n", "length", *[band(b).alias(f"m{b}") for b in range(_BANDS)])


def _one_edit(short: str, long: str) -> Column:
    """Whether the words of two sides, equal in length or longer by one, differ by one edit; linear, for long words."""
    differ = F.zip_with(F.split(f"{short}.word", ""), F.split(f"{long}.word", ""), lambda x, y: F.coalesce(x != y, F.lit(True)))
    first = F.array_position(differ, F.lit(True)).cast("int")
    after = lambda side, skip: F.substring(F.col(f"{side}.word"), first + skip, F.col(f"{side}.length"))
    rest = after(short, F.when(F.col(f"{short}.length") == F.col(f"{long}.length"), 1).otherwise(0)) == after(long, F.lit(1))
    return (F.col(f"{short}.word") != F.col(f"{long}.word")) & rest


def near_words(counted: DataFrame) -> DataFrame:
    """word, near, near_n: both ways of every pair of words (word, n) that are one edit apart."""
    masked = store.cut(_masked(counted), "word-masks")

    def entries(longer: int) -> list[Column]:
        """Keys of a word as the shorter, or as the longer of a pair."""
        half = F.expr(f"(length - {longer}) div 2").cast("int")
        sides = (F.substring("word", F.lit(1), half), F.substring(F.col("word"), F.col("length") - half + 1, half))
        key = lambda b, side: F.xxhash64(F.lit(2 * b + side), F.col("length") - longer, F.col(f"m{b}"), sides[side])
        return [F.struct(F.lit(2 * b + side).alias("slot"), key(b, side).alias("key"), F.lit(longer).alias("longer")) for b in range(_BANDS) for side in (0, 1)]

    bands = [f"m{b}" for b in range(_BANDS)]
    dealt = lambda kinds: masked.select("word", "n", "length", *bands, F.explode(F.array(*kinds)).alias("e")).select("word", "n", "length", *bands, "e.slot", "e.key", "e.longer")
    left, right = dealt(entries(0)).drop("longer").alias("l"), dealt(entries(0) + entries(1)).alias("r")
    first = F.expr("case when l.m0 = r.m0 then 0 when l.m1 = r.m1 then 2 when l.m2 = r.m2 then 4 end + case when left(l.word, l.length div 2) = left(r.word, l.length div 2) then 0 else 1 end")
    flips = F.expr("bit_count(l.m0 ^ r.m0) + bit_count(l.m1 ^ r.m1) + bit_count(l.m2 ^ r.m2)")
    once = F.expr("(r.longer = 1 or l.word < r.word)")
    one = F.when(F.col("l.length") <= 64, F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1).otherwise(_one_edit("l", "r"))
    pairs = left.join(right.hint("merge"), (F.col("l.key") == F.col("r.key")) & (F.col("l.slot") == F.col("r.slot")) & once & (flips <= 2) & (first == F.col("l.slot")) & one)
    both = F.array(F.struct(F.col("l.word").alias("word"), F.col("r.word").alias("near"), F.col("r.n").alias("near_n")), F.struct(F.col("r.word").alias("word"), F.col("l.word").alias("near"), F.col("l.n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def follow(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms (word, form) lead to; each round doubles the steps made."""
    found = store.cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = store.cut(found.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def group_variants(counted: DataFrame, *, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), each there once.

    The form is the near word of largest n (ties: the smallest) where that is at least ``times`` the word's own; the
    root is where forms lead in the end, a word without form its own. Forms grow, so they never lead in a ring.
    """
    counted = store.cut(counted.where("word is not null").select("word", "n"), "word-counts")
    best = F.min(F.struct((-F.col("near_n")).alias("rest"), F.col("near").alias("word")))
    near = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = counted.join(near.hint("merge"), "word", "left")
    follows = -F.col("best.rest") >= times * F.col("n")
    chosen = store.cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.rest")).alias("form_n")), "word-forms")
    roots = follow(chosen.where("form is not null").select("word", "form"))
    return chosen.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
