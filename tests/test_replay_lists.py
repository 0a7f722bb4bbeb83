"""The key replay with the lexicons' answers beside the keys: nothing is asked that was not listed, and no lexicon goes whole to the tasks."""

import random

import pytest
from pyspark.sql import functions as F

from scriptmill.operators import replay
from scriptmill.operators.replay import Keyboard, looker
from scriptmill.sources import events
from tests.test_replay_sql import BULGARIAN, ENGLISH, PIECES

CYRILLIC = [w.translate(replay.TABLE).lower() for w in BULGARIAN] + ["12", "1"]
KEYS = [*PIECES, "1 ", "12 ", "\x7f", "\x7f\x7f\x7f", "\x1b"]


def sessions(n):
    """Events with erased letters, arrows, commands, gaps, terminals and ends."""
    rng, rows = random.Random(11), []
    for i in range(n):
        seq, app = 0, "com.apple.Terminal" if i % 17 == 0 else None
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.06:
                rows.append((f"s{i}", app, seq, "x", 123, []))
            elif kind < 0.1:
                rows.append((f"s{i}", app, seq, rng.choice(["c", None, ""]), 0, [rng.choice(["command", "shift", "end"])]))
            else:
                for ch in rng.choice(KEYS):
                    rows.append((f"s{i}", app, seq, ch, rng.choice([0, None]), rng.choice([[], None])))
                    seq += 1
                seq -= 1
            seq += rng.choice([1, 1, 1, 1, 3])
    return rows


def plain(rows, look):
    """Each event given to one keyboard a session."""
    out, boards = [], {}
    for s, app, seq, ch, code, mods in rows:
        board = boards.setdefault(s, [Keyboard(look, terminal=app is not None), 0, False])
        out.append((s, seq, *board[0].key(ch, code or 0, mods or ()), board[0].preview()))
        board[1:] = seq, "end" in (mods or ())
    for s, (board, last, done) in boards.items():
        if not done:
            out.append((s, last + 1, *board.key(None, 0, ("end",)), board.preview()))
    return sorted(out)


def test_the_replay_asks_only_what_was_listed(spark):
    rows = sessions(3000)
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    en = [w.lower() for w in ENGLISH] + ["12", "1"]
    want = plain(rows, looker(frozenset(en), frozenset(CYRILLIC)))
    keys = spark.createDataFrame(rows, events.KEY_EVENTS).repartition(3)
    assert sorted(map(tuple, replay.replay(keys, make(en), make(CYRILLIC)).collect())) == want
    assert sorted(map(tuple, replay.replay(keys, make(en), make(CYRILLIC), texts_only=True).collect())) == [r for r in want if r[2]]


def test_a_lexicon_above_the_limit(spark, monkeypatch):
    """The replay ended by an error where a lexicon had more words than may be sent to the tasks."""
    monkeypatch.setattr(replay.lexicon_set, "__defaults__", (3,))
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    en, bg = make(["the", "no", "on", "to"]), make(["на", "но", "он", "то"])
    with pytest.raises(ValueError, match="more than 3"):
        replay.lexicon_set(en)
    turns = spark.createDataFrame([("a", "towa no the")], "id string, text string")
    got = replay.replay(events.typed(turns, F.col("id")), en, bg, texts_only=True)
    assert "".join(r["emitted"] for r in sorted(got.collect(), key=lambda r: r["seq"])) != ""
