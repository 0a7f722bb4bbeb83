"""Abbreviations and what they stand for, in English and in Bulgarian typed on Latin keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENGLISH = {
    "u": "you", "r": "are", "ur": "your", "pls": "please", "plz": "please", "thx": "thanks", "thnx": "thanks",
    "ty": "thank you", "yw": "you're welcome", "np": "no problem", "idk": "I don't know", "imo": "in my opinion",
    "imho": "in my humble opinion", "btw": "by the way", "fyi": "for your information", "tbh": "to be honest",
    "omg": "oh my god", "brb": "be right back", "gtg": "got to go", "lmk": "let me know", "nvm": "never mind",
    "rn": "right now", "bc": "because", "w": "with", "b4": "before", "2day": "today", "2morrow": "tomorrow",
    "2nite": "tonight", "msg": "message", "ppl": "people", "govt": "government", "dept": "department",
    "info": "information", "pic": "picture", "pics": "pictures", "approx": "approximately", "misc": "miscellaneous",
    "temp": "temporary", "diff": "different", "convo": "conversation", "prob": "probably", "probs": "probably",
    "def": "definitely", "obv": "obviously", "tbf": "to be fair", "smth": "something", "smb": "somebody",
    "sth": "something", "sb": "somebody", "abt": "about", "tho": "though", "thru": "through", "gonna": "going to",
    "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of", "cuz": "because", "coz": "because",
    "dunno": "don't know", "lemme": "let me", "gimme": "give me",
}
# Fixed values.
BULGARIAN = {"mn": "много", "nqm": "нямам", "nqma": "няма", "dr": "добър", "zdr": "здравей", "blgdr": "благодаря", "msl": "мисля", "spk": "споко"}


def _look_up(table: dict[str, str], word: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, F.lower(word))


def expand_english(word: Column) -> Column:
    """The expansion as it stands, in no particular case; null for other words."""
    return _look_up(ENGLISH, word)


def expand_bulgarian(word: Column) -> Column:
    return _look_up(BULGARIAN, word)


def is_english_abbreviation(word: Column) -> Column:
    return F.coalesce(F.lower(word).isin(list(ENGLISH)), F.lit(False))
