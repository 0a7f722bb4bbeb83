from scriptmill.operators import correct, fold, lookup, speller
from scriptmill.sources.shared import small_side, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_taken_apart_are_not_broadcast(spark):
    """A word has some forty rests, of which Spark's estimate knows nothing: a list of 850 KB, which it would broadcast, gave 3.7 million rows in the driver."""
    known = stored(spark.createDataFrame([("house", 9), ("mouse", 5)], "word string, n long"), "known")
    asked = stored(spark.createDataFrame([("hause",), ("mousee",)], "word string"), "asked")
    for df in (speller.spell(asked, known), correct.edit1(asked, known), correct.correct_bulgarian(asked, known, "word")):
        assert "Broadcast" not in plan(df)
    assert {(r["word"], r["correction"]) for r in speller.spell(asked, known).collect()} == {("hause", "house"), ("mousee", "mouse")}


def test_above_the_limit_nothing_is_broadcast(spark):
    """Not even if its files are small."""
    few = stored(spark.createDataFrame([(k,) for k in range(5)], "a long"), "few")
    assert "Broadcast" in plan(few.join(small_side(few.select("a"), 5), "a"))
    assert "Broadcast" not in plan(few.join(small_side(few.select("a"), 4), "a"))


def test_rare_words_answers_are_not_broadcast(spark):
    rows = stored(spark.createDataFrame([("a",), ("b",), ("a",)], "word string"), "rows")
    answers = stored(spark.createDataFrame([("a", 2, "x"), ("b", 1, "y")], "word string, n_rows long, y string"), "answers")
    got = lookup.attach(rows, answers, limit=1)
    assert plan(got).count("BroadcastExchange") <= 2  # the frequent words, for rows with one and without
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "x"), ("b", "y")]
    each = fold.word_features(lookup.counted(rows), *[rows.limit(0)] * 2)
    assert each.count() == 2
