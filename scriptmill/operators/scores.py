"""Language scores of words and of phrases, by a trained model of character n-grams.

They stand in for a system's language recogniser. Training counts the n-grams of the words
of each language, a blank on either side, and gives each n-gram a weight by
language: SCALE times the logarithm of its smoothed share, rounded. A word's
likelihoods are sums of weights, so whole numbers that come out the same however the sum is
grouped, and those of a phrase are the sums of its words'. A score is the share of some
languages, each with a factor, in the likelihoods of all (equal priors), to four
places.

Words are scored once each. The model has at most as many rows as there are
n-grams over the keys, and is broadcast after a check of its size.

Rows: null and empty words, and words of no language, are not learnt from; an unseen
n-gram has the weight of a count of 0. A word without n-grams (null or empty) has no
scores. The model of an empty table scores nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptmill.functions.mapping import is_latin_word, to_cyrillic
from scriptmill.operators.lookup import attach, counted
from scriptmill.sources.shared import MAX_WORDS, small_side, stored

SIZE, SCALE, PLACES = 3, 1000, 10_000
#: Languages that a model may tell apart; their names go through the driver.
MAX_LANGUAGES = 200
#: Words before a word that make a phrase with it (fixed value).
RECENT = 8


@dataclass
class Model:
    """By n-gram, a weight for each language (w0, w1, ... in the order of ``langs``), and those of n-grams that were never seen."""

    langs: list[str]
    unseen: list[int]
    table: DataFrame

    def weights(self) -> list[str]:
        return [f"w{k}" for k in range(len(self.langs))]


def grams(word: Column, size: int = SIZE) -> Column:
    """The n-grams of a word with a blank on either side; none of an empty word."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
    return F.when(F.length(word) > 0, F.transform(starts, lambda i: F.substring(padded, i, F.lit(size))))


def fit(counted: DataFrame, size: int = SIZE) -> Model:
    """A model from words with their language and count (lang, word, n)."""
    seen = counted.filter("lang is not null and word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = stored(seen.select("lang", "n", F.explode(grams(F.col("word"), size)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r[0] for r in seen.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return Model([], [], seen.select("gram"))
    counts = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"c{k}") for k, x in enumerate(langs)]
    by_gram = stored(seen.groupBy("gram").agg(F.count("*").alias("_"), *counts), "gram-counts")
    totals = by_gram.agg(F.count("*").alias("kinds"), *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(langs))]).first()
    weight = lambda count, k: F.round(SCALE * F.log((count + F.lit(1.0)) / F.lit(float(totals[f"c{k}"] + totals["kinds"])))).cast("bigint")
    table = by_gram.select("gram", *[weight(F.col(f"c{k}"), k).alias(f"w{k}") for k in range(len(langs))])
    unseen = counted.sparkSession.range(1).select(*[weight(F.lit(0), k).alias(f"w{k}") for k in range(len(langs))]).first()
    return Model(langs, list(unseen), table)


def likelihoods(words: DataFrame, model: Model, word: str = "word", size: int = SIZE) -> DataFrame:
    """Each distinct word (not null or empty) with its likelihood in each language, as w0, w1, ..."""
    rows = words.select(F.col(word).alias("word")).filter("word <> ''").distinct()
    if not model.langs:
        return rows
    rows = rows.select("word", F.explode(grams(F.col("word"), size)).alias("gram")).join(small_side(model.table, MAX_WORDS), "gram", "left")
    return rows.groupBy("word").agg(*[F.sum(F.coalesce(w, F.lit(x))).alias(w) for w, x in zip(model.weights(), model.unseen, strict=True)])


def share(model: Model, factors: Mapping[str, float], column=F.col) -> Column:
    """The score: the share of the languages in ``factors`` in the likelihoods, to four places. ``column`` gives that of a name like w0."""
    if not model.langs:
        return F.lit(None).cast("double")
    own = [column(w) for w in model.weights()]
    most = F.greatest(*own) if len(own) > 1 else own[0]
    parts = [F.exp((x - most) / F.lit(float(SCALE))) for x in own]
    # one after the other, so that the sum has one order
    total = sum(parts[1:], parts[0])
    wanted = [F.lit(float(factors[x])) * p for x, p in zip(model.langs, parts, strict=True) if x in factors]
    if not wanted:
        return F.lit(0.0)
    return F.floor(sum(wanted[1:], wanted[0]) / total * PLACES + 0.5) / F.lit(float(PLACES))


@dataclass
class Recogniser:
    """Two models: of words as typed, and of their transliterations. ``en`` and ``bg``: the languages that count for either score, with factors."""

    latin: Model
    cyrillic: Model
    en: Mapping[str, float]
    bg: Mapping[str, float]


def train(counted: DataFrame, en: Mapping[str, float], bg: Mapping[str, float]) -> Recogniser:
    """From words with language and count (lang, word, n), whose transliterations train the second model."""
    latin = counted.select("lang", F.lower("word").alias("word"), "n")
    cyrillic = counted.select("lang", F.lower(to_cyrillic(F.col("word"))).alias("word"), "n")
    return Recogniser(fit(latin), fit(cyrillic), en, bg)


def _both(words: DataFrame, by: Recogniser) -> DataFrame:
    """Distinct words (word, n_rows) but empty ones, with likelihoods by both models: l0, l1, ... and c0, c1, ..."""
    distinct = words.filter("word <> ''").withColumns({"_l": F.lower("word"), "_c": F.lower(to_cyrillic(F.col("word")))})
    for model, key, letter in ((by.latin, "_l", "l"), (by.cyrillic, "_c", "c")):
        found = likelihoods(distinct, model, key)
        distinct = distinct.join(found.select(F.col("word").alias(key), *[F.col(w).alias(f"{letter}{w[1:]}") for w in model.weights()]).hint("merge"), key, "left")
    return distinct.drop("_l", "_c")


def with_scores(words: DataFrame, by: Recogniser, word: str = "word") -> DataFrame:
    """``words`` with en_score and bg_score (0 to 1) of each word by itself."""
    renamed = lambda letter: lambda w: F.col(f"{letter}{w[1:]}")
    each = _both(counted(words, word), by).select("word", "n_rows", share(by.latin, by.en, renamed("l")).alias("en_score"), share(by.cyrillic, by.bg, renamed("c")).alias("bg_score"))
    return attach(words, stored(each, "scores"), word)


def with_phrase_scores(words: DataFrame, by: Recogniser, session: str = "session", pos: str = "pos", word: str = "word", recent: int = RECENT) -> DataFrame:
    """The typeable words of sessions with en_score and bg_score, and en_phrase and bg_phrase: the same of the word with up to ``recent`` words before it."""
    typed = words.filter(is_latin_word(F.col(word)))
    rows = attach(typed, stored(_both(counted(typed, word), by), "likelihoods"), word)
    frame = W.partitionBy(session).orderBy(pos).rowsBetween(-recent, 0)
    out = [*words.columns]
    for lang, model, factors, letter in (("en", by.latin, by.en, "l"), ("bg", by.cyrillic, by.bg, "c")):
        sums = {f"_{letter}{k}": F.sum(f"{letter}{k}").over(frame) for k in range(len(model.langs))}
        rows = rows.withColumns(sums) if sums else rows
        rows = rows.withColumns({f"{lang}_score": share(model, factors, lambda w, x=letter: F.col(f"{x}{w[1:]}")), f"{lang}_phrase": share(model, factors, lambda w, x=letter: F.col(f"_{x}{w[1:]}"))})
        out += [f"{lang}_score", f"{lang}_phrase"]
    return rows.select(*out)
