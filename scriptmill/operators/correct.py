"""Corrections: abbreviations, and the first lexicon word at edit distance one.

Edits rank by kind (substitution, deletion, insertion, transposition), then by
place, then by the letter put in. Instead of making all 61n + 29 edits of a word
and probing each, words and lexicon meet on what is left of them when one
character, or none, is taken out: n + 1 keys a word. The places of the two
missing characters tell the edit, and so its rank. No side is broadcast, however
few bytes its words take as a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.functions.abbreviations import expand_english
from scriptmill.functions.tokens import restore_case

# Fixed value: the letters that an edit may put in, in the order they are tried.
ALPHABET = "абвгдежзийклмнопрстуфхцчшщъьюя"
SUBSTITUTION, DELETION, INSERTION, TRANSPOSITION = range(4)


def _keys(words: DataFrame, word: str, at: str) -> DataFrame:
    """A row for the word itself (place -1) and for each place taken out."""
    w = F.col(word)
    cut = F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda i: F.struct(i.alias("at"), F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w))).alias("key")))
    rows = F.concat(F.array(F.struct(F.lit(-1).alias("at"), w.alias("key"))), cut)
    return words.select(word, F.explode(rows).alias("x")).select(word, F.col("x.at").alias(at), F.col("x.key").alias("key"))


def _letter(word: str, at: Column) -> Column:
    return F.substring(F.col(word), at + 1, F.lit(1))


def edit1(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """word, correction and edit of each distinct word of two letters or more that has one. Words are taken as they stand."""
    asked = words.select(F.col(word).alias("w")).filter(F.length("w") >= 2).distinct()
    known = lexicon.select(F.col("word").alias("c")).filter("c <> ''").distinct()
    pairs = _keys(asked, "w", "i").hint("merge").join(_keys(known, "c", "j").hint("merge"), "key").filter("w <> c")
    i, j = F.col("i"), F.col("j")
    index = F.instr(F.lit(ALPHABET), _letter("c", j)) - 1
    rank = lambda kind, at, letter: F.struct(F.lit(kind).alias("kind"), at.alias("at"), letter.alias("letter"))
    no = F.lit(0)
    swapped = (j == i + 1) & (_letter("w", i) == _letter("c", j)) & (_letter("w", j) == _letter("c", i)) & (i >= 0)
    ranked = pairs.withColumn(
        "rank",
        F.when((i == j) & (i >= 0) & (index >= 0), rank(SUBSTITUTION, i, index))
        .when((j == -1) & (i >= 0), rank(DELETION, i, no))
        .when((i == -1) & (j >= 0) & (index >= 0), rank(INSERTION, j, index))
        .when(swapped, rank(TRANSPOSITION, i, no)),
    ).filter("rank is not null")
    best = ranked.groupBy("w").agg(F.min(F.struct("rank", "c")).alias("x"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("substitution", "deletion", "insertion", "transposition")]), F.col("x.rank.kind") + 1)
    return best.select(F.col("w").alias("word"), F.col("x.c").alias("correction"), kind.alias("edit"))


def correct_bulgarian(words: DataFrame, lexicon: DataFrame, word: str = "cyrillic") -> DataFrame:
    """``words`` with bg_fix: null for lexicon words and where nothing is one edit away; the case of the first letter is kept."""
    lower = words.select(F.lower(F.col(word)).alias("_l")).distinct().join(lexicon.select(F.col("word").alias("_l")).distinct().hint("merge"), "_l", "left_anti")
    fixes = edit1(lower, lexicon, "_l").select(F.col("word").alias("_l"), "correction")
    return words.join(fixes.hint("merge"), F.lower(F.col(word)) == F.col("_l"), "left").withColumn("bg_fix", restore_case(F.col(word), F.col("correction"))).drop("_l", "correction")


def correct_english(word: Column) -> Column:
    """The abbreviation's expansion with the word's case, else null. (There is no spell checker.)"""
    return restore_case(word, expand_english(word))
