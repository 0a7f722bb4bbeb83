import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import spelling
from tests.llm.test_operators import rows

NAMES = ["word", "n", "n_near", "form", "form_n", "root"]


def near(a, b):
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, least_length=6, least_count=5, factor=5):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    found = {}
    for w, n in words.items():
        beside = [(-m, x) for x, m in words.items() if near(w, x)]
        best = min(beside, default=(0, None))
        found[w] = (len(beside), *((best[1], -best[0]) if beside and -best[0] >= factor * n else (None, None)))
    out = []
    for w, n in words.items():
        root = w
        while found[root][1] is not None:
            root = found[root][1]
        out.append((w, n, *found[w], root))
    return out


def count(docs, damage=199):
    out = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % damage == 0 else w] += 1
    return dict(out)


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=40))
def test_automaton(words):
    words = sorted(words)
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words)))
    assert a.number("zz") == -1 and a.size[a.root] == len(words)
    for w in words:
        for exact in range(len(w) + 1):
            # with the first part exact: those that an error in the rest reaches
            reached = {x for x in words if x[:exact] == w[:exact] and near(w[exact:], x[exact:])}
            assert {words[k] for k in a.near(w, exact)} == reached


def test_automaton_is_minimal():
    a = spelling.Automaton(["baking", "boking", "making", "moking"])
    assert len(a.edges) == 7


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=2, max_size=9), st.text("ab", min_size=2, max_size=9), st.integers(1, 3))
def test_each_pair_meets_on_one_path(word, other, depth):
    import itertools

    if near(word, other):
        paths = ["".join(p) for p in itertools.product("FB", repeat=depth)]
        own = [p for p in paths if spelling.first_way(word, other, p)]
        assert len(own) == 1
        asked = {k for k, asks in spelling.keys(word, own[0]).items() if asks}
        assert asked & set(spelling.keys(other, own[0]))


def random_counts(seed, letters="abcé", n=400):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(4, 9))): r.choice([1, 4, 5, 6, 30, 200, 2000]) for _ in range(n)}


@pytest.mark.parametrize(("group", "block"), [(30_000, 30_000), (30_000, 1), (20, 7), (3, 3)])
def test_variants(spark, group, block):
    counts = random_counts(1) | random_counts(2, "ab", 300) | {"": 9, "aaaaaa": 5, "a" * 300: 50, "a" * 301: 5000, "a" * 150 + "b" + "a" * 150: 10}
    got = spelling.variants(table(spark, counts), group=group, block=block)
    assert rows(got, *NAMES) == sorted(brute(counts), key=repr)


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 10, "zzzzzy": 50, "zzzzyz": 50, "zzzzz": 9000, "alone": 7, "lonely": 7}
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(table(spark, counts)).collect()}
    assert got["aaaaaa"][:2] == ("aaaaab", "aaabbb") and got["aaaabb"] == ("aaabbb", "aaabbb", 2)
    assert got["zzzzzz"] == ("zzzzyz", "zzzzyz", 2) and got["lonely"] == (None, "lonely", 0) and "zzzzz" not in got and "alone" not in got


def test_counts(spark, docs, clashing, empty, edge_texts):
    for damage in (199, 3):
        want = sorted(count(edge_texts, damage).items())
        assert sorted(map(tuple, spelling.counted(docs, damage).collect())) == want == sorted(map(tuple, spelling.counted(clashing, damage).collect()))
    assert rows(spelling.variants(spelling.counted(docs, 3)), *NAMES) == sorted(brute(count(edge_texts, 3)), key=repr)
    assert spelling.variants(spelling.counted(empty, 199)).count() == 0
