"""Phonetic transliteration from Latin keys to Bulgarian Cyrillic, one character to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys and the letter that each one types.
LATIN = "abcdefghijklmnopqrstuvwxyz" + "][;'`\\" + "}{:\"~|" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абцдефгхийклмнопярстужвьъз" + "щшжьчю" + "ЩШЖЬЧЮ" + "АБЦДЕФГХИЙКЛМНОПЯРСТУЖВЬЪЗ"
# The keys besides letters that type a letter.
SPECIAL_KEYS = "][;'`\\}{:\"~|"

#: A character class of all keys that type a letter.
KEY_CLASS = r"A-Za-z\]\[;'`\\}{:\"~|"
LATIN_WORD = rf"\A[{KEY_CLASS}]+\z"
TABLE = str.maketrans(LATIN, CYRILLIC)


def to_cyrillic(text: Column) -> Column:
    """Each mapped key becomes its letter; everything else stays."""
    return F.translate(text, LATIN, CYRILLIC)


def is_latin_word(text: Column) -> Column:
    """Not empty, and only ASCII letters and special keys."""
    return F.coalesce(text.rlike(LATIN_WORD), F.lit(False))


def contains_cyrillic(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[Ѐ-ӿ]"), F.lit(False))
