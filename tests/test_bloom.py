from pyspark.sql import functions as F

from scriptmill.operators import bloom, lookup
from tests.test_operators import BG_WORDS, EN_WORDS


def words(spark, first, n):
    return spark.range(first, first + n).select(F.md5(F.col("id").cast("string").cast("binary")).alias("word"))


def test_no_member_is_lost_and_few_others_pass(spark):
    lexicon = words(spark, 0, 300_000).cache()
    made = bloom.build(lexicon, 300_000)
    assert made.count() == made.blocks == -(-300_000 * bloom.BITS // bloom.BLOCK)
    maybe = lambda df: bloom.possible(df, made, F.col("word"), "maybe").filter("maybe").count()
    assert maybe(lexicon) == 300_000
    passed = maybe(words(spark, 10**9, 200_000)) / 200_000
    assert 0.001 < passed < 0.015  # (1 - exp(-4 / 12)) ** 4 is 0.0065


def test_mark_is_exact_and_shuffles_possible_members_only(spark):
    lexicon = words(spark, 0, 50_000).cache()
    rows = words(spark, 49_000, 20_000).union(spark.createDataFrame([(None,), ("",)], "word string"))
    out = bloom.mark(rows, lexicon, F.col("word"), "known", 50_000)
    got = out.groupBy("known").count().collect()
    assert {r["known"]: r["count"] for r in got} == {True: 1000, False: 19_002}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the side of the lexicon's join is filtered first
    assert "_maybe" in plan and plan.index("Union") < plan.index("Join LeftOuter")


def test_the_filter_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 2)
    lexicon = words(spark, 0, 50_000)
    assert bloom.build(lexicon, 50_000) is None
    out = bloom.mark(words(spark, 49_990, 20), lexicon, F.col("word"), "known", 50_000)
    assert out.filter("known").count() == 10


def test_classes_with_large_lexicons(spark):
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    en, bg = words(spark, 0, 30_000).union(make(EN_WORDS)).cache(), words(spark, 5, 30_000).union(make(BG_WORDS)).cache()
    rows = make([*EN_WORDS, "towa", "kafe", "Towa", "zz", None, "zz", ""]).union(words(spark, 0, 50))
    small, large = (sorted(map(tuple, lookup.classify(rows, en, bg, limit=n).collect()), key=repr) for n in (10**6, 100))
    assert small == large and {r[3] for r in large} == {"both", "bg", "en", "neither"}
