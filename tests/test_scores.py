import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptmill.functions.mapping import TABLE
from scriptmill.operators import fold, scores, speller
from scriptmill.operators.detector import BG, EN, Detector

COUNTED = [("en", "the", 9), ("en", "hello", 3), ("en", "world", 2), ("de", "das", 7), ("de", "welt", 3), ("es", "kafe", 5), ("es", "hola", 4), ("fr", "cafe", 2), (None, "zzz", 9), ("en", "", 4), ("en", None, 2), ("es", "the", 1)]
EN_FACTORS, BG_FACTORS = {"en": 1.0}, {"es": 1.0, "fr": 0.4}


def grams(word):
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(word))]


def trained(rows):
    counts = {}
    for lang, word, n in rows:
        if lang and word:
            for g in grams(word):
                counts.setdefault(lang, Counter())[g] += n
    kinds = len({g for c in counts.values() for g in c})
    return {lang: lambda g, c=c: round(1000 * math.log((c[g] + 1) / (sum(c.values()) + kinds))) for lang, c in counts.items()}


def share(model, words, factors):
    own = {lang: sum(weight(g) for w in words for g in grams(w)) for lang, weight in model.items()}
    most = max(own.values())
    parts = {lang: math.exp((x - most) / 1000) for lang, x in own.items()}
    return math.floor(sum(factors.get(x, 0) * p for x, p in parts.items()) / sum(parts.values()) * 10_000 + 0.5) / 10_000


@pytest.fixture(scope="module")
def recogniser(spark):
    return scores.train(spark.createDataFrame(COUNTED, "lang string, word string, n bigint"), EN_FACTORS, BG_FACTORS)


def models():
    cyrillic = [(lang, w and w.translate(TABLE).lower(), n) for lang, w, n in COUNTED]
    return trained(COUNTED), trained(cyrillic)


def test_word_scores(spark, recogniser):
    words = ["the", "Hello", "kafe", "x", "qqqq", "the", "", None, "welt;", "a" * 500]
    got = scores.with_scores(spark.createDataFrame([(w,) for w in words], "word string"), recogniser).collect()
    latin, cyrillic = models()
    assert len(got) == len(words)
    for r in got:
        if r["word"]:
            assert r["en_score"] == share(latin, [r["word"].lower()], EN_FACTORS)
            assert r["bg_score"] == share(cyrillic, [r["word"].translate(TABLE).lower()], BG_FACTORS)
        else:
            assert r["en_score"] is r["bg_score"] is None
    by = {r["word"]: r for r in got}
    assert by["Hello"]["en_score"] > 0.9 and by["kafe"]["bg_score"] > 0.5 > by["kafe"]["en_score"]


def test_phrase_scores(spark, recogniser):
    r = random.Random(1)
    rows = [(s, p, r.choice(["the", "Hello", "kafe", "hola", "das", "x1"])) for s in "ab" for p in range(25)]
    got = {(x["session"], x["pos"]): x for x in scores.with_phrase_scores(spark.createDataFrame(rows, "session string, pos int, word string"), recogniser).collect()}
    latin, cyrillic = models()
    for s in "ab":
        typed = [(p, w) for x, p, w in rows if x == s and w != "x1"]
        for k, (p, _) in enumerate(typed):
            phrase = [w for _, w in typed[max(0, k - 8) : k + 1]]
            assert got[s, p]["en_phrase"] == share(latin, [w.lower() for w in phrase], EN_FACTORS)
            assert got[s, p]["bg_phrase"] == share(cyrillic, [w.translate(TABLE).lower() for w in phrase], BG_FACTORS)
    assert len(got) == sum(w != "x1" for *_, w in rows)


def test_no_languages(spark):
    nothing = scores.train(spark.createDataFrame([], "lang string, word string, n bigint"), EN_FACTORS, BG_FACTORS)
    assert [tuple(r) for r in scores.with_scores(spark.createDataFrame([("a",)], "word string"), nothing).collect()] == [("a", None, None)]
    with pytest.raises(ValueError, match="languages"):
        scores.fit(spark.range(300).select(F.col("id").cast("string").alias("lang"), F.lit("w").alias("word"), F.lit(1).alias("n")))


def test_scores_decide_first_words():
    step = lambda *x: Detector().step(*x)[1:]
    assert step("a", True, True, None, 0.3, 0.6) == (BG, 0.6) and step("a", True, True, None, 0.6, 0.3) == (EN, 0.6)
    assert step("a", True, True, None, 0.5, 0.6) == (EN, 0.5)  # no margin of 0.1: the default
    assert step("q", False, False, None, 0.2, 0.6) == (BG, 0.6) and step("q", False, False, None, 0.5, 0.1) == (EN, 0.3)


# the speller

LEXICON = {"the": 500, "then": 40, "there": 90, "thereby": 9, "house": 30, "horse": 31, "houses": 8, "mouse": 30, "example": 12, "examples": 11, "ab": 99, "information": 20, "formation": 900}


def distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
    plain = rows[-1][-1]
    swapped = len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))
    return 1 if plain == 2 and swapped else plain


def meant(word, lexicon):
    allowed = 2 if len(word) >= 6 else 1 if len(word) >= 3 else 0
    found = [(-n * 200 ** (2 - d), c, d) for c, n in lexicon.items() if (d := distance(word, c)) <= allowed]
    return min(found)[1:] if found and allowed and word not in lexicon else None


def test_speller_equals_brute_force(spark):
    r = random.Random(4)
    lexicon = LEXICON | {"".join(r.choice("abcd") for _ in range(r.randint(1, 8))): r.randint(1, 300) for _ in range(300)}
    asked = ["teh", "thr", "hte", "hous", "huose", "exampel", "exmaple", "informatoin", "xformation", "a", "ba", "zzzzzzz", "the", ""]
    asked += ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in [*asked, *asked[:5], None]], "word string")
    got = {x["word"]: (x["correction"], x["edits"]) for x in speller.spell(rows, spark.createDataFrame(list(lexicon.items()), "word string, n bigint")).collect()}
    assert got == {w: m for w in asked if (m := meant(w, lexicon))}
    assert got["teh"] == ("the", 1) and got["huose"] == ("house", 1) and got["exampel"] == ("example", 1)


def test_english_corrections_in_the_fold(spark):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, n bigint")
    texts = ["there house Huose", "Huose there", "horse house zzzz"]
    words = spark.createDataFrame([(str(k), p, w) for k, t in enumerate(texts) for p, w in enumerate(t.split())], "session string, pos int, word string")
    words = words.withColumns({"in_en": F.lower("word").isin(list(LEXICON)), "in_bg": F.lit(False), "bg_fix": F.lit(None).cast("string")})
    fixed = speller.correct_english(words, lexicon, where="not in_en and not in_bg")
    got = {(r["session"], r["pos"]): (r["converted"], r["language"], r["confidence"]) for r in fold.detect(fixed).collect()}
    assert got["0", 2] == ("House", EN, 0.8)  # in an English flow
    assert got["1", 0] == ("House", EN, 0.8)  # no flow yet, and no Bulgarian correction
    assert got["2", 2] == ("zzzz", EN, 0.5)
    # with corrections in both languages the flow decides, and without one the scores
    d = Detector()
    assert d.step("huose", False, False, "жюс", 0.1, 0.9, "house") == ("хуосе", BG, 0.9)
    assert Detector(history=((BG, True),)).step("huose", False, False, "жюс", 0.0, 0.0, "house") == ("жюс", BG, 0.7)
    assert Detector(history=((EN, True),)).step("huose", False, False, "жюс", 0.0, 0.0, "house") == ("house", EN, 0.7)
    assert Detector().step("huose", False, False, "жюс", 1.0, 0.0, "house") == ("house", EN, 1.0)
