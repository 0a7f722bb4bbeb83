import numpy as np

import corpus_pipeline
from scriptmill.llm import neardup
from tests.llm.conftest import DOCS
from tests.llm.test_neardup import sets, words

NODES = "fp long, sim0 long, sim1 long, size int, strongest binary"


def test_ball_hashing_brings_the_first_links(spark, monkeypatch):
    """Nodes of equal first fingerprints, and of those four bits apart, are linked by stars; those five bits apart are not, nor such as have no fingerprint."""
    rows = [(1, 0, 0, 9, b"x"), (2, 0, 0, 9, b"x"), (3, 0b1111, 0, 9, b"x"), (4, 0b1111 << 30 | 1 << 63 >> 1, 0, 9, b"x"), (5, 0, 0, 2, None)]
    got = {(r["a"], r["b"]) for r in neardup._ball_pairs(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {(2, 1), (3, 1)}
    asked, ball_pairs = [], neardup._ball_pairs

    def counted(nodes):
        asked.append(ball_pairs(nodes))
        return asked[-1]

    monkeypatch.setattr(neardup, "_ball_pairs", counted)
    w = words(1, 400)
    docs = spark.createDataFrame([(1, " ".join(w), "en", "s", None), (2, " ".join(w[:-1]), "en", "s", None)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()] == [1]
    assert len(asked) == 1


def test_a_crowd_leaves_no_near_pair_out(spark):
    """Sets around a common part: every pair at 0.8 or more of different components comes, at the bound and of unlike sizes too, and few others."""
    r = np.random.default_rng(2)
    common, found = r.integers(-(1 << 62), 1 << 62, 100), {}
    for k in range(150):
        own = r.integers(-(1 << 62), 1 << 62, 12 + k % 30)
        found[2 * k] = np.unique(np.concatenate([common, own]))
        if k % 3 == 0:
            found[2 * k + 1] = np.unique(np.concatenate([common, own[: len(own) - k % 9], r.integers(-(1 << 62), 1 << 62, k % 20)]))
    found[1000] = common  # with 25 more it is at 0.8 exactly
    root = {f: f if f % 4 else 0 for f in found}  # many are in one component
    near = {(max(a, b), min(a, b)) for a in found for b in found if a < b and root[a] != root[b] and neardup.similarity(found[a], found[b]) >= 0.8}
    unlike = [min(len(found[a]), len(found[b])) / max(len(found[a]), len(found[b])) for a, b in near]
    assert len(near) > 100 and min(unlike) == 0.8
    placed = spark.createDataFrame([(f, root[f], len(s), 7) for f, s in found.items()], "fp long, root long, size int, key long")
    stored = spark.createDataFrame([(f, s.tobytes()) for f, s in found.items()], "fp long, shingles binary")
    got = [(x["a"], x["b"], x["root_a"], x["root_b"]) for x in neardup._crowd(placed, stored, 0.8).collect()]
    assert near <= {(a, b) for a, b, _, _ in got} and len(got) == len({(a, b) for a, b, _, _ in got})
    assert all(root[a] == x and root[b] == y and x != y for a, b, x, y in got)
    lone = placed.withColumn("key", placed["fp"])  # no key has two components
    assert neardup._crowd(lone, stored, 0.8).count() == 0


def test_a_common_passage_lists_few_pairs(spark, monkeypatch):
    """Texts that share 400 of 490 words, and are not near for it: the pairs listed stay a few a text, and those that are near are linked."""
    start, texts = words(1, 400), []
    for k in range(200):
        own = words(1000 + k, 90)
        texts.append((2 * k, " ".join(start + own)))
        if k % 10 == 0:
            texts.append((2 * k + 1, " ".join(start + own[:-20] + words(5000 + k, 20))))
    listed, alike = [], neardup._alike

    def counted(pairs, *rest):
        listed.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(neardup, "_alike", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame([(d, t, "en", "s", None) for d, t in texts], DOCS)).collect()}
    found = {d: sets(t) for d, t in texts}
    assert all(len(found[d] & found[d - 1]) >= 0.8 * len(found[d] | found[d - 1]) for d in found if d % 2)
    assert got == {d: d - d % 2 for d in found}
    assert sum(listed) <= 8 * len(texts)
