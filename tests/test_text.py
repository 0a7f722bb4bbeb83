import pytest
from pyspark.sql import functions as F

from scriptmill.functions import abbreviations, mapping, tokens

# Words as typed and as they must come out.
WORDS = {
    "towa": "това", "kak": "как", "si": "си", "dobre": "добре", "blagodarq": "благодаря", "nared": "наред", "we`e": "вече", "ne]ata": "нещата",
    "proba": "проба", "samo": "само", "pokava": "покажа", "hubaw": "хубав", "mnogo": "много", "zdrawej": "здравей", "ma[ina": "машина",
    "u`ili]e": "училище", "prewkl\\`wam": "превключвам", "~ajnika": "Чайника", "po-skoro": "по-скоро", "nakraq.": "накрая.", "po-dobre": "по-добре",
    "razhod": "разход", "|nikod": "Юникод",
}
# Keys and the letters that they must type.
CHARS = {"a": "а", "b": "б", "w": "в", "v": "ж", "k": "к", "q": "я", "]": "щ", "[": "ш", ";": "ж", "`": "ч", "\\": "ю", "}": "Щ", "{": "Ш", ":": "Ж", '"': "Ь", "~": "Ч", "|": "Ю"}


def column(spark, values, *exprs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, w string")
    return [tuple(r) for r in rows.select("k", *exprs).orderBy("k").drop("k").collect()]


def test_map_has_64_keys():
    assert len(mapping.LATIN) == len(mapping.CYRILLIC) == len(set(mapping.LATIN)) == 64


def test_chars_and_words(spark):
    both = {**CHARS, **WORDS}
    got = column(spark, both, tokens.map_token(F.col("w")))
    assert [x[0] for x in got] == list(both.values())


def test_latin_words(spark):
    cases = {"hello": True, "we`e": True, "": False, "a1": False, "é": False, "ab ": False, "a\n": False, None: False, "é": False}
    assert [x[0] for x in column(spark, cases, mapping.is_latin_word(F.col("w")))] == list(cases.values())


def test_cyrillic(spark):
    cases = {"това": True, "towa": False, None: False, "aя": True}
    assert [x[0] for x in column(spark, cases, mapping.contains_cyrillic(F.col("w")))] == list(cases.values())


def test_addresses(spark):
    cases = {"u@x": True, "a/b": True, "a1": True, "a.b": True, "..a": False, "a..b": True, "a.": False, "word": False, "": False, None: False}
    assert [x[0] for x in column(spark, cases, tokens.is_email_or_url(F.col("w")))] == list(cases.values())


def test_emoticons(spark):
    buffered = [":D", ":P", ":O", ":o", ";D", ";P", "=D", ":-D", ":-P", ":-O", ";-D", "xD", "XD"]
    plain = ["towa", "kak", "hello", "proba", "word", ":d", None]
    assert all(x[0] for x in column(spark, buffered, tokens.is_emoticon(F.col("w"))))
    assert not any(x[0] for x in column(spark, plain, tokens.is_emoticon(F.col("w"))))
    pairs = [(":", ")"), (":", "("), (":", "*"), (":", "|"), (";", ")"), ("=", "("), (":-", "*"), (";-", ")"), (":'", "(")]
    assert all(a and b for a, b in zip((x[0] for x in column(spark, [p for p, _ in pairs], tokens.is_emoticon_prefix(F.col("w")))), (x[0] for x in column(spark, [b for _, b in pairs], tokens.is_emoticon_body(F.col("w")))), strict=True))
    assert len(tokens.EMOTICONS) == 28


def test_trailing(spark):
    cases = {"word.,!": ("word", ".,!"), "...": ("", "..."), "a.b": ("a.b", ""), "": ("", "")}
    assert column(spark, cases, tokens.stem(F.col("w")), tokens.trailing(F.col("w"))) == list(cases.values())


def test_abbreviations(spark):
    assert len(abbreviations.ENGLISH) == 62 and len(abbreviations.BULGARIAN) == 8
    got = column(spark, ["U", "thx", "IDK", "zdr", "word", None], abbreviations.expand_english(F.col("w")), abbreviations.expand_bulgarian(F.col("w")), abbreviations.is_english_abbreviation(F.col("w")))
    assert got == [("you", None, True), ("thanks", None, True), ("I don't know", None, True), (None, "здравей", False), (None, None, False), (None, None, False)]


def test_case_restore(spark):
    got = column(spark, ["Word", "word", "ЖWord", ""], tokens.restore_case(F.col("w"), F.lit("много")))
    assert [x[0] for x in got] == ["Много", "много", "Много", "много"]


def test_terminals(spark):
    cases = {"com.apple.Terminal": True, "com.microsoft.VSCodeInsiders": True, "com.jetbrains.x": True, "org.example": False, None: False}
    assert [x[0] for x in column(spark, cases, tokens.is_terminal_app(F.col("w")))] == list(cases.values())


def test_key_classes(spark):
    cases = {"a": "letter", ";": "special", "@": "joining", "7": "joining", ")": "other", "é": "other"}
    assert [x[0] for x in column(spark, cases, tokens.key_class(F.col("w")))] == list(cases.values())


@pytest.mark.parametrize(("text", "want"), [("towa e, :) u@x.com po-skoro", ["towa", "e", ":", "u@x.com", "po-skoro"]), ("été", ["t"]), (None, []), ("", [])])
def test_segments(spark, text, want):
    assert column(spark, [text], tokens.segments(F.col("w"))) == [(want,)]
