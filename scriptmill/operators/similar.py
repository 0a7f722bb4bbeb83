"""Similar words of two lists: an exact join on the Jaccard similarity of their character n-grams.

Each word's n-grams are ordered by how many words have them, rare ones first. Two sets
of similarity t or more have at least a = ceil(t n) n-grams in common, n being the size of
either, and so k of the first n - a + k of both. With k = 2, words meet on the pairs of
n-grams of these prefixes, which are far rarer than single ones; their sizes differ by no
more than the factor t. Only what meets and fits is compared. Sets
so small that a is 1 meet on single n-grams (k = 1), with others of fitting size. No link is
lost, and frequent n-grams bring nobody together.

Rows: null and empty words have no n-grams and no links; repeated words count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.functions.mapping import to_cyrillic
from scriptmill.operators.scores import SIZE, grams
from scriptmill.sources.shared import MAX_WORDS, discard, small_side, stored


def _least(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den)"""
    return F.floor((n * num + (den - 1)) / den).cast("int")


def _keyed(sets: DataFrame, order: DataFrame, word: str, grams: str, num: int, den: int) -> DataFrame:
    """``sets`` (word, grams) by the pairs, or else single ones, of the n-grams of their prefixes, as key."""
    ranked = sets.select(word, F.explode(grams).alias("gram")).join(order, "gram")
    ranked = ranked.groupBy(word).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("x"))  # a word's own n-grams
    ranked = ranked.select(word, F.col("x.gram").alias(grams), F.size("x").alias("size"))
    common = _least(F.col("size"), num, den)
    first = lambda k: F.slice(F.col(grams), F.lit(1), F.col("size") - common + k)
    after = lambda g, i: F.transform(F.slice(first(2), i + 2, F.col("size")), lambda h: F.concat(g, F.lit(" | "), h))
    pairs = F.when(common >= 2, F.flatten(F.transform(first(2), after))).otherwise(F.array())
    # the largest set that may have but one n-gram in common has den // num
    single = F.when(F.col("size") * num <= den * (den // num), first(1)).otherwise(F.array())
    return ranked.select(word, grams, F.explode(F.concat(pairs, single)).alias("key"))


def similar(left: DataFrame, right: DataFrame, num: int = 7, den: int = 10, size: int = SIZE) -> DataFrame:
    """l, r, shared and total (n-grams in both and in either) of all pairs of a word of ``left`` and one of ``right`` (both: word) with shared / total >= num / den."""
    def sets(words: DataFrame, name: str) -> DataFrame:
        found = words.filter("word <> ''").select(F.col("word").alias(name)).distinct()
        return stored(found.select(name, F.array_distinct(grams(F.col(name), size)).alias(f"{name}_grams")), "grams")

    a, b = sets(left, "l"), sets(right, "r")
    all_grams = a.select(F.explode("l_grams").alias("gram")).union(b.select(F.explode("r_grams")))
    order = stored(all_grams.groupBy("gram").agg(F.count("*").alias("n")), "gram-order")
    x, y = _keyed(a, small_side(order, MAX_WORDS), "l", "l_grams", num, den), _keyed(b, small_side(order, MAX_WORDS), "r", "r_grams", num, den)
    n, m = F.size("l_grams"), F.size("r_grams")
    fits = (m * den >= n * num) & (n * den >= m * num)
    pairs = x.join(y, "key").filter(fits).withColumn("shared", F.size(F.array_intersect("l_grams", "r_grams")))
    pairs = pairs.withColumn("total", n + m - F.col("shared")).filter(F.col("shared") * den >= F.col("total") * num)
    out = stored(pairs.select("l", "r", "shared", "total").distinct(), "similar")
    discard(a, b, order)
    return out


def near_conflicts(en: DataFrame, bg: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """Each English word with its transliteration, n_links (Bulgarian words similar to that, itself included) and the most similar one (of equal ones the smallest)."""
    keyed = en.filter("word <> ''").select("word", F.lower(to_cyrillic(F.col("word"))).alias("cyrillic")).distinct()
    links = similar(keyed.select(F.col("cyrillic").alias("word")), bg, num, den)
    best = F.min(F.struct((-F.col("shared") / F.col("total")).alias("s"), "r"))
    found = links.groupBy(F.col("l").alias("cyrillic")).agg(F.count("*").alias("n_links"), best.alias("x"))
    return keyed.join(found, "cyrillic", "left").select("word", "cyrillic", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("x.r").alias("nearest"))
