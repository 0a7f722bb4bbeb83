"""Lexicon membership, the four classes of words, conflicts and look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scriptmill.functions.mapping import to_cyrillic
from scriptmill.operators import bloom
from scriptmill.sources.shared import MAX_WORDS, stored

#: Steps of a doubling in which numbers of rows are told apart.
STEPS = 4


def counted(rows: DataFrame, word: str = "word", pos: str | None = None) -> DataFrame:
    """The distinct words (null too) with n_rows and, if ``pos`` is given, the last position, as a stored table."""
    last = [F.max(pos).alias("last")] if pos else []
    return stored(rows.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n_rows"), *last), "words")


def attach(rows: DataFrame, answers: DataFrame, word: str = "word", limit: int = MAX_WORDS) -> DataFrame:
    """``rows`` with the columns of ``answers`` (word, n_rows and others; a stored table of one row a word) but n_rows; null where there is none.

    At most ``limit`` words are broadcast: all, or the most frequent ones, which most
    rows have. Only the rows of rarer words are shuffled, to their answers; ``rows`` is read twice then.
    """
    w, found = F.col(word), [c for c in answers.columns if c not in ("word", "n_rows")]
    side = lambda x: x.filter("word is not null").select(F.col("word").alias("_w"), *[F.col(c).alias(f"_a_{c}") for c in found])
    named = [F.col(f"_a_{c}").alias(c) for c in found]
    step = F.floor(F.log2(F.col("n_rows")) * STEPS).alias("step")
    most, least = 0, None
    for k, n in sorted(answers.groupBy(step).count().collect(), reverse=True):  # some 250 rows at most
        most += n
        if most > limit:
            break
        least = k
    else:
        return rows.join(F.broadcast(side(answers)), w == F.col("_w"), "left").select(*rows.columns, *named)
    if least is None:
        hot, cold = answers.limit(0), answers
    else:
        hot, cold = answers.filter(step >= least), answers.filter(step < least)
    near = rows.join(F.broadcast(side(hot)), w == F.col("_w"), "left").filter(F.col("_w").isNotNull() | w.isNull())
    far = rows.filter(w.isNotNull()).join(F.broadcast(side(hot).select("_w")), w == F.col("_w"), "left_anti")
    far = far.join(side(cold).hint("merge"), w == F.col("_w"), "left")
    return near.select(*rows.columns, *named).union(far.select(*rows.columns, *named))


def classify(words: DataFrame, en: DataFrame, bg: DataFrame, word: str = "word", limit: int = MAX_WORDS) -> DataFrame:
    """``words`` with in_en, in_bg and class (both, bg, en, neither).

    Lexicons of at most ``limit`` words are broadcast, and the words are not
    shuffled. Larger ones meet the distinct words (classify_distinct), and the answer goes back to the rows (attach).
    """
    if all(x.limit(limit + 1).count() <= limit for x in (en, bg)):
        return _classify_small(words, en, bg, word)
    each = stored(classify_distinct(counted(words, word), en, bg, limit=limit).drop("class"), "classes")
    out = attach(words, each, word, limit)
    return out.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("in_en", "in_bg")}).withColumn("class", word_class())


def classify_distinct(words: DataFrame, en: DataFrame, bg: DataFrame, word: str = "word", limit: int = MAX_WORDS) -> DataFrame:
    """As classify, of a table of one row a word: of lexicons above ``limit`` only the words that a Bloom filter lets through (operators.bloom) are shuffled."""
    if all(x.limit(limit + 1).count() <= limit for x in (en, bg)):
        return _classify_small(words, en, bg, word)
    for out, lexicon, key in (("in_en", en, F.lower(word)), ("in_bg", bg, F.lower(to_cyrillic(F.col(word))))):
        words = bloom.mark(words, lexicon, key, out, lexicon.count())
    return words.withColumn("class", word_class())


def _classify_small(words: DataFrame, en: DataFrame, bg: DataFrame, word: str) -> DataFrame:
    w, c = F.col(word), F.lower(to_cyrillic(F.col(word)))
    known_en, known_bg = (F.broadcast(x.select(F.col("word").alias(k)).distinct()) for x, k in ((en, "_en"), (bg, "_bg")))
    met = words.join(known_en, F.lower(w) == F.col("_en"), "left").join(known_bg, c == F.col("_bg"), "left")
    found = [F.col("_en").isNotNull().alias("in_en"), F.col("_bg").isNotNull().alias("in_bg")]
    return met.select(*words.columns, *found).withColumn("class", word_class())


def word_class() -> Column:
    return F.when(F.col("in_en") & F.col("in_bg"), "both").when(F.col("in_bg"), "bg").when(F.col("in_en"), "en").otherwise("neither")


def conflicts(en: DataFrame, bg: DataFrame) -> DataFrame:
    """English words whose transliteration is a Bulgarian word."""
    keyed = en.select("word", F.lower(to_cyrillic(F.col("word"))).alias("cyrillic"))
    return keyed.join(bg.select(F.col("word").alias("cyrillic")).distinct(), "cyrillic").select("word", "cyrillic").distinct()


def look_ahead(classed: DataFrame, session: str = "session", pos: str = "pos", word: str = "word") -> DataFrame:
    """Each word in both lexicons with the word after it, which decides the script of both; undecided if that one is no exclusive word."""
    order = W.partitionBy(session).orderBy(pos)
    pairs = classed.withColumn("next_word", F.lead(word).over(order)).withColumn("next_class", F.lead("class").over(order))
    pairs = pairs.filter("class = 'both' and next_word is not null")
    lang = F.when(F.col("next_class") == "bg", "BG").when(F.col("next_class") == "en", "EN").otherwise("??")
    out = lambda c: F.when(lang == "BG", to_cyrillic(F.col(c))).otherwise(F.col(c))
    return pairs.select(session, pos, F.col(word).alias("word1"), F.col("next_word").alias("word2"), lang.alias("lang"), out(word).alias("output1"), out("next_word").alias("output2"))
