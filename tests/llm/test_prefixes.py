import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scriptmill.llm import prefixes
from tests.llm.conftest import CLASHES

TURNS = "conv_id bigint, turn bigint, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def own_turns(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            out.setdefault(c, []).append(((turn is not None, turn or 0, role or "", digest), (role or "", text or "")))
    return {c: [t for _, t in sorted(x)] for c, x in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    out = []

    def subtree(s):
        leaves, saved = 0, (len(nodes[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for k in kids.get(s, []):
            a, b = subtree(k)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = ",".join(map(str, sorted(c for c in nodes[s] if len(convs[c]) == len(s))))
        parent = min(nodes[s[:-1]]) if s else None
        out.append((min(nodes[s]), len(s), parent, len(nodes[s]), len(kids.get(s, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        subtree(())
    return out


def same(df, want):
    assert sorted((tuple(r) for r in df.select(*NODE).collect()), key=repr) == sorted(want, key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        c = r.choice([r.randrange(100), r.randrange(-40, 4000)])
        for turn in range(r.randrange(6)):
            out.append((c, turn, "ua"[turn % 2], r.choice(["one two", "one", "", "a  b\tc", "é ü"])))
    return list({(c, t): (c, t, x, y) for c, t, x, y in out}.values())


EDGES = [
    (0, None, None, None), (0, 0, "user", "hello there"), (0, 1, "assistant", "x"), (1, 5, "user", "one"), (1, 5, "user", "one"), (1, 5, "assistant", "one"), (2, None, "b", "x"), (2, None, "a", "y"),
    (None, 0, "user", "lost"), (3, 0, "", "ab"), (4, 0, "a", "b"), (5, 0, None, "ab"), (25, 0, "user", "no base"), (45, 0, "user", "word " * 100_000), (-3, 0, "user", "below"), (-20, 0, "user", "below"), (-20, 1, "user", "x"),
]


@pytest.mark.parametrize("rows", [EDGES, conversations(1, 60), conversations(2, 400), []])
def test_trie(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    own = own_turns(rows)
    same(prefixes.trie(prefixes.grafted(df)), brute(rebuilt(own)))
    same(prefixes.trie(prefixes.chains(df)), brute(own))


def test_blocks_and_packs(spark, monkeypatch):
    """Conversations over many blocks, light edges below light edges, and more ends at a node than a pack holds."""
    monkeypatch.setattr(prefixes, "BLOCK", 3)
    monkeypatch.setattr(prefixes, "IDS", 4)
    r = random.Random(5)
    rows = []
    for c in range(60):
        shared = r.choice([0, 4, 9, 17, 20])
        rows += [(c, t, "user", f"same {t}" if t < shared else f"{r.choice('ab')} {t}") for t in range(r.choice([shared, 20, 23]))]
    df = spark.createDataFrame([*rows, *[(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(5)]], TURNS)
    own = own_turns([tuple(x) for x in df.collect()])
    same(prefixes.trie(prefixes.chains(df)), brute(own))
    same(prefixes.trie(prefixes.grafted(df)), brute(rebuilt(own)))


def test_one_long_conversation(spark, monkeypatch):
    """A conversation of half of all turns stays in its blocks."""
    monkeypatch.setattr(prefixes, "BLOCK", 50)
    rows = [(7, t, "user", f"t{t}") for t in range(600)] + [(8 + c, t, "user", f"t{t}") for c in range(20) for t in range(30)]
    same(prefixes.trie(prefixes.chains(spark.createDataFrame(rows, TURNS))), brute(own_turns(rows)))


def test_clashing_columns(spark):
    rows = conversations(3, 40)
    df = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("x").alias(c) for c in [*CLASHES, "depth", "block", "place", "digest", "a", "b", "first", "level", "top"] if c not in ("text", "turn")])
    same(prefixes.trie(prefixes.chains(df)), brute(own_turns(rows)))
