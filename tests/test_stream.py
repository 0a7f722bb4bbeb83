from scriptmill.operators import fold
from scriptmill.streaming import detect
from tests.test_operators import BG_WORDS, EN_WORDS, SCENARIOS, table


def test_stream_equals_batch(spark, tmp_path):
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    rows = fold.features(table(spark, [s[0] for s in SCENARIOS]), make(EN_WORDS), make(BG_WORDS))
    rows = rows.select("session", "pos", "word", "in_en", "in_bg", "bg_fix").cache()
    # two batches, the later words first
    rows.filter("pos >= 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("pos < 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = detect.run_to_end(detect.detect_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(got.collect()) == sorted(fold.detect(rows).collect())


def test_key_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from scriptmill.operators import replay
    from scriptmill.sources import events

    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    turns = spark.createDataFrame([("a", "towa :) e po-skoro, "), ("b", "i iskam kafe"), ("c", "u@x.com hello u "), ("d", "to")], "s string, text string")
    keys = events.typed(turns, F.col("s")).cache()
    whole = events.ended(keys).cache()
    assert sorted(events.ended(whole).collect()) == sorted(whole.collect())
    whole.filter("seq % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    whole.filter("seq % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_event_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = detect.run_to_end(detect.replay_stream(stream, make(EN_WORDS), make(BG_WORDS)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = replay.replay(keys, make(EN_WORDS), make(BG_WORDS)).collect()
    assert sorted(got.collect()) == sorted(want) == sorted(replay.replay(whole, make(EN_WORDS), make(BG_WORDS)).collect())
    assert "".join(r["emitted"] for r in sorted(want) if r["session_id"] == "d") == "to"


def test_a_large_lexicon_reaches_the_key_stream(spark, tmp_path):
    """Lexicons of over 1 MB, from where Spark makes a broadcast of the processor."""
    from pyspark.sql import functions as F

    from scriptmill.operators import replay
    from scriptmill.sources import events

    many = spark.range(60_000).select(F.sha1(F.col("id").cast("string")).alias("word"))
    en, bg = many.union(spark.createDataFrame([(w,) for w in EN_WORDS], "word string")), spark.createDataFrame([(w,) for w in BG_WORDS], "word string")
    keys = events.ended(events.typed(spark.createDataFrame([("a", "towa e kafe"), ("b", "hello to u ")], "s string, text string"), F.col("s"))).cache()
    keys.write.parquet(str(tmp_path / "in"))
    stream = detect.replay_stream(events.read_event_stream(spark, str(tmp_path / "in")), en, bg)
    got = detect.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(got.collect()) == sorted(replay.replay(keys, en, bg).collect())


def test_scores_in_the_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "zzz", False, False, None, 0.1, 0.9), ("s", 1, "u", False, False, "уу", 0.0, 1.0), ("t", 0, "a", True, True, None, 0.9, 0.1)], "session string, pos int, word string, in_en boolean, in_bg boolean, bg_fix string, en_score double, bg_score double")
    rows.write.parquet(str(tmp_path / "in"))
    got = detect.run_to_end(detect.detect_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(got.collect()) == sorted(fold.detect(rows).collect())
    assert {(r["session"], r["pos"]): r["language"] for r in got.collect()} == {("s", 0): "BG", ("s", 1): "BG", ("t", 0): "EN"}


def test_gaps_are_given_up(spark, tmp_path):
    import time

    rows = spark.createDataFrame([("s", p, w, True, False, None) for p, w in ((0, "the"), (1, "is"), (4, "are"), (5, "you"))], "session string, pos int, word string, in_en boolean, in_bg boolean, bg_fix string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", detect.ROCKSDB)
    stream = detect.detect_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), patience=1)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))
    try:
        until, got = time.time() + 60, []
        while time.time() < until and len(got) < 4:
            time.sleep(1)
            got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert sorted((r["pos"], r["skipped"]) for r in got) == [(0, 0), (1, 0), (4, 2), (5, 0)]
