"""The SQL of the key replay against the replay itself, on short texts full of held words, emoticons, addresses and hyphens."""

import random

import duckdb
import pyarrow as pa

from scriptmill.functions.mapping import TABLE
from scriptmill.operators.replay import Keyboard, looker
from scriptmill.plans.oracle import ORACLE_SQL
from scriptmill.sources.events import END

ENGLISH = ["on", "to", "tam", "house", "u", "btw", "Ice", "pm"]
BULGARIAN = ["on", "to", "tam", "kotka", "nq", "e", "mn"]
PIECES = [*ENGLISH, *BULGARIAN, "kotkq", "zzz", "To", ":", ":-", ";'", ":D", "xD", ")", "*", "-", "--", ".", "...", "1", "@", "/", "_", "+", ",", "!", "\n", "\r", "\t", "é", " ", " ", " ", " "]


def typed(text, look):
    board, out = Keyboard(look), []
    for seq, ch in enumerate(text):
        out.append((seq, board.key(ch)[0]))
    out.append((len(text), board.key(None, mods=[END])[0]))
    return [(seq, t) for seq, t in out if t]


def test_replay_sql_equals_the_keyboard():
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts += ["to", "to ", "to  ", "to ... kotka", "to\nto kotka", "to on-kotka. ", "to -kotka ", "to a@b to nq", "to :) ", "to :D nq", "to 12", "to _x on", None, ""]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [1, 2], "lang": ["en", "es"], "text": [" ".join(ENGLISH), " ".join(BULGARIAN)]}))
    con.register("conversations", pa.table({"conv_id": list(range(len(texts))), "turn": [0] * len(texts), "role": ["user"] * len(texts), "text": texts}))
    found = con.execute(ORACLE_SQL["keystroke_replay"]).fetchall()
    look = looker({w.lower() for w in ENGLISH}, {w.translate(TABLE).lower() for w in BULGARIAN})
    wanted = {(f"{i}:0:user", seq, out) for i, t in enumerate(texts) for seq, out in typed(t or "", look)}
    assert set(found) == wanted and len(found) == len(wanted)
