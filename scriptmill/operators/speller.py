"""A noisy-channel speller: of the lexicon words near a word, the one most likely to have been meant.

A candidate c of frequency n, d edits from the word, is weighed by n * error**(-d):
how often it is written at all, and how rarely so many slips happen to it. An edit
inserts, deletes or replaces a character, or swaps two neighbours. Words of SHORT
characters or more may have two edits, of LEAST or more one, shorter ones none.

Words and lexicon meet on what is left of them when up to as many characters as
there may be edits are taken out: whatever is one or two edits away shares such a
rest. So neither side is broadcast or walked as a whole (the hints see to that, as the rests of a word list
are some forty times what Spark takes from its files), and only words that share a rest are compared. Keys of two characters taken out are at least SHORT - 2
long.

Rows: null words have no correction; words of the lexicon are left alone; of equal weights the
smallest candidate is taken. Words are taken as they stand; lexicon rows of one word add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.functions.tokens import restore_case
from scriptmill.sources.shared import MAX_WORDS, small_side, stored

LEAST, SHORT, MOST = 3, 6, 2
#: One in so many words has a given slip.
ERROR = 200


def edits_allowed(word: Column) -> Column:
    return F.when(F.length(word) >= SHORT, 2).when(F.length(word) >= LEAST, 1).otherwise(0)


def _without_one(word: Column) -> Column:
    """What is left of a word when each of its characters in turn is taken out."""
    return F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))))


def _rests(words: DataFrame, word: str) -> DataFrame:
    """``words`` by each of their rests, as key."""
    w = F.col(word)
    once = F.array_distinct(_without_one(w))
    twice = F.filter(F.array_distinct(F.flatten(F.transform(once, _without_one))), lambda k: F.length(k) >= SHORT - MOST)
    # a longer word of two edits may meet one that is shorter than SHORT
    rests = F.when(F.length(w) >= SHORT - MOST, F.concat(F.array(w), once, twice)).otherwise(F.concat(F.array(w), once))
    return words.withColumn("key", F.explode(F.array_distinct(rests)))


def _swapped(a: Column, b: Column) -> Column:
    """Whether two neighbours of ``a`` swapped give ``b`` (of the same length)."""
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i), F.substring(a, i + 2, F.lit(1)), F.substring(a, i + 1, F.lit(1)), F.substring(a, i + 3, F.length(a)))
    return F.exists(F.sequence(F.lit(0), F.length(a) - 2), lambda i: swap(i) == b)


def spell(words: DataFrame, lexicon: DataFrame, word: str = "word", error: int = ERROR) -> DataFrame:
    """word, correction and edits of each distinct word outside the lexicon (word, n) that has a correction."""
    known = lexicon.filter("word <> ''").groupBy(F.col("word").alias("c")).agg(F.sum("n").alias("n"))
    asked = words.select(F.col(word).alias("w")).distinct().withColumn("allowed", edits_allowed(F.col("w"))).filter("allowed > 0")
    asked = asked.join(known.select(F.col("c").alias("w")).hint("merge"), "w", "left_anti")
    pairs = _rests(asked, "w").hint("merge").join(_rests(known, "c").hint("merge"), "key").select("w", "c", "n", "allowed").distinct()
    w, c = F.col("w"), F.col("c")
    plain = F.levenshtein(w, c)
    edits = F.when((plain == 2) & (F.length(w) == F.length(c)) & _swapped(c, w), 1).otherwise(plain)
    pairs = pairs.withColumn("edits", edits).filter("edits <= allowed")
    weight = F.col("n") * F.pow(F.lit(float(error)), MOST - F.col("edits")).cast("bigint")
    best = pairs.groupBy("w").agg(F.min(F.struct((-weight).alias("weight"), "c", "edits")).alias("x"))
    return best.select(w.alias("word"), F.col("x.c").alias("correction"), F.col("x.edits").alias("edits"))


def correct_english(words: DataFrame, lexicon: DataFrame, word: str = "word", where: str = "true", error: int = ERROR) -> DataFrame:
    """``words`` with en_fix: null for lexicon words, where nothing is near, and where ``where`` does not hold; the case of the first letter is kept."""
    lower = stored(words.filter(where).select(F.lower(F.col(word)).alias("_l")).distinct(), "unknown-english")
    fixes = small_side(stored(spell(lower, lexicon, "_l", error).select(F.col("word").alias("_l"), "correction"), "english-corrections"), MAX_WORDS)
    return words.join(fixes, F.lower(F.col(word)) == F.col("_l"), "left").withColumn("en_fix", F.when(F.expr(where), restore_case(F.col(word), F.col("correction")))).drop("_l", "correction")
