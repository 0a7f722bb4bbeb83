"""Lexicons: from word lists in text files, or derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.functions.mapping import to_cyrillic
from scriptmill.functions.tokens import segments

BLANKS = r"\A[\p{Zs}\t]+|[\p{Zs}\t]+\z"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words, one a line. A missing file gives an empty lexicon."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "word string")
    return lines.select(F.lower(F.regexp_replace("value", BLANKS, "")).alias("word")).filter("word <> ''").distinct()


def write_lexicon(words: DataFrame, path: str) -> None:
    words.select("word").write.text(path)


def derive_english(docs: DataFrame) -> DataFrame:
    """Stand-in for an English word list: the tokens of English documents."""
    return english_of(docs.filter("lang = 'en'").select("lang", F.explode(segments(F.col("text"))).alias("word")))


def english_of(words: DataFrame) -> DataFrame:
    """The same from the tokens themselves (lang, word), repeated or not."""
    return words.filter("lang = 'en'").select(F.lower("word").alias("word")).distinct()


def derive_bulgarian(docs: DataFrame) -> DataFrame:
    """Stand-in for a Bulgarian word list: the transliterated tokens of Spanish documents."""
    return bulgarian_of(docs.filter("lang = 'es'").select("lang", F.explode(segments(F.col("text"))).alias("word")))


def bulgarian_of(words: DataFrame) -> DataFrame:
    """The same from the tokens themselves (lang, word), repeated or not."""
    return words.filter("lang = 'es'").select(F.lower(to_cyrillic(F.col("word"))).alias("word")).distinct()
