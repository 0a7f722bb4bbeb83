import pytest
from pyspark.sql import functions as F

from scriptmill.operators import fold, lookup, scores, speller
from scriptmill.sources.shared import MAX_WORDS, stored
from tests.test_bloom import words


@pytest.fixture
def sizes(monkeypatch):
    """Rows of all tables that are broadcast."""
    found, broadcast = [], F.broadcast

    def told(df):
        found.append(df.count())
        return broadcast(df)

    monkeypatch.setattr(F, "broadcast", told)
    return found


def test_rows_get_their_words_answers(spark, sizes):
    """Whatever part of the words is broadcast; null, unknown and repeated words too."""
    text = ["the"] * 40 + ["of"] * 20 + ["rare", "rare2", "", "none"] + [None] * 5
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(text)], "pos int, w string")
    counted = lookup.counted(rows, "w", "pos")
    assert {r["word"]: (r["n_rows"], r["last"]) for r in counted.collect()}[None] == (5, 68)
    answers = stored(counted.filter("word is null or word <> 'none'").select("word", "n_rows", F.upper("word").alias("up"), F.lit(1).alias("w2")), "answers")
    want = sorted((k, w, w.upper() if w not in (None, "none") else None, None if w in (None, "none") else 1) for k, w in enumerate(text))
    for limit in (0, 1, 2, 3, 100):
        sizes.clear()
        out = lookup.attach(rows, answers, "w", limit)
        assert out.columns == ["pos", "w", "up", "w2"]
        assert sorted(map(tuple, out.collect())) == want
        assert max(sizes) <= limit


def test_large_lexicons_and_vocabularies_are_not_broadcast(spark, sizes):
    """The driver holds a bounded number of words, however many the lexicons and the texts have."""
    n = MAX_WORDS + 20_000
    en = stored(words(spark, 0, n), "en")
    bg = stored(words(spark, 5, 10).select(F.translate("word", "abcdef", "абцдеф").alias("word")), "bg")
    rows = stored(words(spark, 10_000, n).union(words(spark, 10_000, 10)), "rows")
    sizes.clear()
    out = fold.features(rows, en, bg)
    assert out.count() == n + 10 and out.filter("in_en").count() == n - 10_000 + 10
    frequent = en.withColumn("n", F.lit(9))
    fixed = speller.correct_english(out.filter("class = 'neither'").limit(50), frequent, where="class = 'neither'")
    assert fixed.count() == 50
    assert sizes and max(sizes) <= MAX_WORDS


def test_scores_of_many_words_are_not_broadcast(spark, sizes):
    n = MAX_WORDS + 20_000
    by = scores.train(spark.createDataFrame([("en", "the", 9), ("es", "hola", 4)], "lang string, word string, n bigint"), {"en": 1.0}, {"es": 1.0})
    rows = stored(words(spark, 0, n), "rows")
    assert scores.with_scores(rows, by).filter("en_score is not null").count() == n
    assert sizes and max(sizes) <= MAX_WORDS
