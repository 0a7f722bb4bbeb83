import random

import pytest

from scriptmill.operators import similar


def sets(word):
    padded = f" {word} "
    return {padded[i : i + 3] for i in range(len(word))}


def make(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


@pytest.mark.parametrize(("num", "den"), [(7, 10), (1, 2), (1, 1), (1, 5)])
def test_equals_all_pairs(spark, num, den):
    r = random.Random(num)
    words = lambda: ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(250)] + ["aaaaaaaa", "aaa", "", None, "abcabcabc"]
    left, right = words(), words()
    got = {(x["l"], x["r"]): (x["shared"], x["total"]) for x in similar.similar(make(spark, left), make(spark, right), num, den).collect()}
    want = {}
    for a in {x for x in left if x}:
        for b in {x for x in right if x}:
            shared, total = len(sets(a) & sets(b)), len(sets(a) | sets(b))
            if shared * den >= total * num:
                want[a, b] = (shared, total)
    assert got == want


def test_near_conflicts(spark):
    got = {r["word"]: (r["cyrillic"], r["n_links"], r["nearest"]) for r in similar.near_conflicts(make(spark, ["razgowor", "kafe", "zzz", "", None]), make(spark, ["разговор", "разговори", "кафе", "как", None])).collect()}
    assert got == {"razgowor": ("разговор", 2, "разговор"), "kafe": ("кафе", 1, "кафе"), "zzz": ("ззз", 0, None)}
    assert similar.near_conflicts(make(spark, []), make(spark, ["кафе"])).count() == 0
