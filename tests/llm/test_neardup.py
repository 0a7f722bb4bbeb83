import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptmill.llm import neardup, simhash
from scriptmill.sources.shared import trim_driver
from tests.llm import brute
from tests.llm.conftest import DOCS


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def sets(text, n=5):
    w = brute.words(brute.lower(text))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def edited(seed, w, places):
    return [f"x{seed}" if i in places else x for i, x in enumerate(w)]


def test_stage_links_by_shingles(spark):
    """Near copies more than four bits apart go, texts below 0.8 stay, equal to all pairs by brute force."""
    texts = []
    for k in range(40):
        w = words(k, 120)
        for j, n in enumerate([0, 1, 2, 3, 4][: 2 + k % 4]):
            texts.append((10 * k + j, " ".join(edited(k * 10 + j, w, {10 + 25 * i + j for i in range(n)}))))
    texts += [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (None, texts[0][1]), (905, texts[5][1]), (905, texts[5][1])]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    found = [(d, sets(t)) for d, t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(found[i][1], found[j][1]):
                root = [root[i] if x == root[j] else x for x in root]
    ids = {}
    for k, (d, _) in enumerate(texts):
        if d is not None:
            ids[root[k]] = min(d, ids.get(root[k], d))
    want = sorted({d for k, (d, _) in enumerate(texts) if d is not None and ids[root[k]] == d})
    fps = [brute.fingerprint(t) for _, t in texts]
    assert any(near(found[i][1], found[j][1]) and (fps[i] ^ fps[j]).bit_count() > 4 for i in range(100) for j in range(i))
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in texts], DOCS)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want
    assert got.filter("doc_id is null").count() == 1


@pytest.mark.parametrize("common", [0, 245])
def test_recall(spark, monkeypatch, common):
    """Planted pairs at 0.8, 0.85 and 0.9, among texts that share a passage of 245 of 300 words (0.69), or none: nearly all are linked, no others, and few shingle sets are compared."""
    texts, start = [], words(1, common)
    for k in range(120):
        own, changed = words(100 + k, 300 - common), (32, 23, 15)[k % 3]
        texts += [(2 * k, " ".join(start + own)), (2 * k + 1, " ".join(start + own[:-changed] + words(900 + k, changed)))]
    found = [sets(t) for _, t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j])}
    assert near == {(2 * k, 2 * k + 1) for k in range(120)}
    compared, compare = [], neardup._compare

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(neardup, "_compare", counted)
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in texts], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert all(c == d or (c, d) in near for d, c in got.items())
    assert sum(got[2 * k + 1] == 2 * k for k in range(120)) >= 118
    assert sum(compared) <= 2 * len(texts)


def test_sketches_of_near_sets():
    """Of sets at 0.8 all have sketches within the bound, at 0.69 hardly any, whatever their size."""
    r = np.random.default_rng(5)
    for n in (16, 40, 100, 400):
        bits = {}
        for least, both in ((0.8, -(-16 * n // 18)), (0.69, int(2 * n * 0.69 / 1.69))):
            drawn = [r.integers(0, 1 << 63, 2 * n - both, np.uint64) for _ in range(50)]
            bits[least] = [int(np.bitwise_count((neardup.wide(x[:n]) ^ neardup.wide(x[n - both :])).view(np.uint64)).sum()) for x in drawn]
        assert max(bits[0.8]) <= neardup.FAR_WIDE
        assert n < 100 or np.mean(np.array(bits[0.69]) <= neardup.FAR_WIDE) < 0.05


def test_lower_similarities_are_errors(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([(1, "a", "en", "s", None)], DOCS), least=0.7)


def test_keys_meet():
    """Of pairs just above 0.8 nearly all share a key."""
    r, hits = np.random.default_rng(3), 0
    for _ in range(200):
        h = np.unique(r.integers(0, 1 << 63, 220, np.uint64))
        a, b = neardup.band_keys([h[20:], h[:-20]])
        hits += bool((a == b).any())
    assert hits >= 199


def test_the_stage_finds_candidates_by_simhash(spark, monkeypatch):
    """Votes of the shingles' bits make the keys and the fingerprints, which are compared before the shingles are."""
    h = np.random.default_rng(4).integers(0, 1 << 63, 600, np.uint64)
    mixed = (h[:, None] * neardup.FACTORS + neardup.SHIFTS).tolist()
    for row in range(0, neardup.GROUPS, 31):
        counts = [0] * 64
        for x in (r[row] for r in mixed):
            x ^= x >> 31
            x = x * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            x ^= x >> 29
            counts = [c + (1 if x >> b & 1 else -1) for b, c in enumerate(counts)]
        assert neardup.votes(h)[row].tolist() == counts
    sims, strongest = neardup.fingerprint(h)
    found = neardup.votes(h)
    assert [int(x) for x in sims] == [sum(1 << b for b in range(64) if found[k][b] > 0) for k in range(2)]
    assert all(abs(found[k][s % 64]) == abs(found[k]).max() and (found[k][s % 64] > 0) == (s >= 64) for k, s in enumerate(strongest.tolist()))
    w = words(1, 200)
    docs = spark.createDataFrame([(1, " ".join(w), "en", "s", None), (2, " ".join(edited(2, w, {9, 99})), "en", "s", None)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()] == [1]
    monkeypatch.setattr(neardup, "FAR", -1)  # no fingerprints are so near
    assert corpus_pipeline.near_dedup_stage(spark, docs, "").count() == 2


def test_keys_at_the_least_similarity():
    r, hits = np.random.default_rng(6), 0
    for _ in range(200):
        h = np.unique(r.integers(0, 1 << 63, 300, np.uint64))
        a, b = neardup.band_keys([h[33:], h[:-33]])  # 234 of 300: below 0.8
        hits += bool((a == b).any())
    assert hits >= 190


def test_keys_shared_by_chance_are_none(spark):
    """A key of two nodes that are too far apart, or too unlike in size, keeps neither: their shingles are not stored."""
    strongest = [bytes([k] * neardup.GROUPS) for k in range(4)]
    far, schema = (1 << 50) - 1, "fp long, sim0 long, sim1 long, size int, strongest binary"
    rows = [(1, 0, 0, 100, strongest[0]), (2, far, 0, 100, strongest[0]), (3, 0, 0, 100, strongest[1]), (4, 0, 0, 79, strongest[1])]
    rows += [(5, 0, 0, 100, strongest[2]), (6, 1, 0, 80, strongest[2]), (7, 0, 0, 9, strongest[3]), (8, far, 0, 9, strongest[3]), (9, far, 0, 9, strongest[3])]
    found = neardup._candidates(spark.createDataFrame(rows, schema), 0.8).collect()
    assert sorted((r["fp"], len(r["keys"])) for r in found) == [(k, neardup.KEYS) for k in (5, 6, 7, 8, 9)]


def test_the_driver_gives_freed_memory_back(spark):
    assert trim_driver(spark)


def test_linked_copies_make_no_points(spark, monkeypatch):
    """What the keys have put in one component is not hashed again: near copies of one text emit no points of their balls, however many they are."""
    made, points = [], simhash.points

    def counted(fps):
        made.append(points(fps).count())
        return points(fps)

    monkeypatch.setattr(simhash, "points", counted)
    w = words(7, 300)
    texts = [(k, " ".join(edited(k, w, {10 + 3 * k} if k else ()))) for k in range(80)]
    got = neardup.near_duplicates(spark.createDataFrame([(d, t, "en", "s", None) for d, t in texts], DOCS))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert made == [0]


def test_points_flip_differing_bits_only(spark):
    """Two fingerprints four bits apart meet at points between them; before, each emitted whole balls around their keys."""
    a, b = 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ (1 << 3 | 1 << 25 | 1 << 50 | 1 << 61)
    fps = spark.createDataFrame([(a,), (b,)], "fp long")
    assert 0 < simhash.points(fps).count() <= 40
    assert {(r["a"], r["b"]) for r in simhash.links(fps).collect()} & {(a, b), (b, a)}
    one = fps.withColumns({"lo": F.lit(1), "hi": F.lit(1)})
    assert simhash.points(one).count() == 0
    assert simhash.points(one.withColumn("hi", F.lit(2))).count() == simhash.points(fps).count()
