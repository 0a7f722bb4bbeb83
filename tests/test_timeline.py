import random
from datetime import datetime, timedelta

import pytest

from scriptmill.operators import fold, timeline
from scriptmill.operators.detector import BG, EN, Detector
from scriptmill.streaming import detect

START = datetime(2024, 3, 1)
EVENTS, CHANGES = "user_id bigint, ts timestamp, x string", "user_id bigint, since timestamp, preference string"


def made(seed, n, users=4):
    r = random.Random(seed)
    # one user has half of all events; times repeat
    return [(0 if r.random() < 0.5 else r.randrange(users), START + timedelta(seconds=60 * r.randrange(6000)), "abc"[k % 3]) for k in range(n)]


def by_hand(events, gap):
    out = {}
    for u in {e[0] for e in events}:
        start = last = None
        for _, t, x in sorted(e for e in events if e[0] == u):
            if last is None or (t - last).total_seconds() > gap:
                start = t
            last = t
            out.setdefault((u, start), []).append((t, x))
    return out


@pytest.mark.parametrize("block", [600, 7200, 10**7])
@pytest.mark.parametrize("gap", [120, 1800, 100_000])
def test_cut(spark, block, gap):
    events = made(gap, 300)
    rows = spark.createDataFrame([*events, (None, START, "n"), (1, None, "n")], EVENTS)
    got = {}
    for r in timeline.cut(rows, gap, block=block).collect():
        got.setdefault((r["user_id"], r["session_start"]), []).append((r["ts"], r["x"]))
    assert {k: sorted(v) for k, v in got.items()} == by_hand(events, gap)


def test_sessions_of_no_events(spark):
    assert timeline.sessions(spark.createDataFrame([], EVENTS), 60).count() == 0


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    gap, delay = 600, 3600
    events = sorted(made(9, 200), key=lambda e: e[1])
    late = (0, START - timedelta(days=1), "late")
    far = (-1, START + timedelta(days=30), "end")
    schema = spark.createDataFrame([], EVENTS).schema
    for k, some in enumerate([events[:80][::-1], events[80:], [late], [far]]):  # within a batch in any order
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k < 3:
            import time

            time.sleep(1.1)  # files are taken in the order of their times
    stream = timeline.cut_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), gap, delay)
    got = detect.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = timeline.sessions(spark.createDataFrame(events, EVENTS), gap)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block", [600, 10**7])
def test_as_of(spark, block):
    r = random.Random(5)
    events = made(5, 200)
    changes = [(r.choice([0, 0, 1, 2, 9]), START + timedelta(seconds=60 * r.randrange(6000)), r.choice([EN, BG])) for _ in range(60)]
    changes += [(0, changes[0][1], EN), (0, changes[0][1], BG)]
    got = timeline.as_of(spark.createDataFrame([*events, (None, START, "n")], EVENTS), spark.createDataFrame([*changes, (1, START, None), (1, None, EN), (None, START, EN)], CHANGES), "preference", block=block)
    held = lambda u, t: max(((s, p) for k, s, p in changes if k == u and s <= t), default=(None, None))[1]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*e, held(*e[:2]))) for e in events)


def test_preferences_and_sessions_in_the_fold(spark):
    """Two sessions of a user with other defaults; the second begins without history."""
    at = lambda m: START + timedelta(minutes=m)
    typed = [(1, at(0), "a"), (1, at(1), "no"), (1, at(90), "a"), (1, at(91), "qqq")]
    rows = timeline.cut(spark.createDataFrame(typed, "user_id bigint, ts timestamp, word string"), 1800)
    rows = timeline.as_of(rows, spark.createDataFrame([(1, at(-5), EN), (1, at(45), BG)], CHANGES), "preference", at="session_start")
    rows = rows.selectExpr("concat(user_id, ':', session_start) as session", "unix_seconds(ts) - unix_seconds(session_start) as pos", "word", "length(word) < 3 as in_en", "length(word) < 3 as in_bg", "cast(null as string) as bg_fix", "preference")
    for segment in (1, 60, 10**6):
        got = [(r["language"], r["confidence"], r["converted"]) for r in fold.detect(rows, segment=segment).orderBy("session", "pos").collect()]
        assert got == [(EN, 0.5, "a"), (EN, 0.8, "no"), (BG, 0.5, "а"), (BG, 0.7, "яяя")]
    assert Detector(BG).step("a", True, True, None)[1:] == (BG, 0.5)
