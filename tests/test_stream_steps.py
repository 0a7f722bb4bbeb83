"""The stream of steps with the lexicons' answers beside the keys, against the batch."""

from scriptmill.operators import replay
from scriptmill.plans import queries
from scriptmill.sources import events
from scriptmill.streaming import detect
from tests.test_replay_lists import CYRILLIC, sessions
from tests.test_replay_sql import ENGLISH


def test_the_stream_of_steps_equals_the_batch(spark, tmp_path):
    """Steps come in two batches, the odd ones first, so that answers wait for their step in the session's state."""
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    en, bg = make([w.lower() for w in ENGLISH] + ["12", "1"]), make(CYRILLIC)
    keys = spark.createDataFrame(sessions(120), events.KEY_EVENTS)
    rows = replay.answered(keys, en, bg).cache()
    assert rows.filter("not last").count()
    rows.filter("at % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("at % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = detect.type_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = detect.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).select("session_id", "seq", "emitted")
    want = replay.replay(keys, en, bg, texts_only=True).select("session_id", "seq", "emitted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_query_sends_no_lexicon_to_the_tasks(spark, tmp_path, monkeypatch):
    """The query ended by an error where a lexicon had more words than may be sent to the tasks."""
    monkeypatch.setattr(replay.lexicon_set, "__defaults__", (2,))
    spark.createDataFrame([(1, "en", "the house is on"), (2, "es", "towa e on tam")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "on the towa :) hause.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = (sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (queries.stream_replay, queries.keystroke_replay))
    assert got == want and len(got) >= 4
