import random

import pytest

from scriptmill.llm import simhash
from tests.llm import brute


def _roots(spark, fps):
    """Components by simhash (fingerprints are below 2 ** 63) and by all pairs, and how many points the links took."""
    made, points = [], simhash.points

    def counted(x):
        made.append(points(x).count())
        return points(x)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "points", counted)
        found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert all((x["a"] ^ x["b"]).bit_count() <= simhash.RADIUS for x in found.collect())
    root = {x["node"]: x["root"] for x in simhash.components(found).collect()}
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(root.get(f, f), []).append(k)
    want = brute.components(list(enumerate(fps)))
    return {k: min(g) for g in groups.values() for k in g}, {k: want[k, f] for k, f in enumerate(fps)}, sum(made)


def test_a_crowd_of_near_fingerprints_makes_no_points(spark):
    """However many are within a few bits of one: neighbours in keys link them. Before, each made points, and the plan made them twice."""
    c = random.Random(5).getrandbits(63)
    got, want, made = _roots(spark, [c, *(c ^ 1 << a ^ 1 << b for a in range(20) for b in range(30, 50))])
    assert got == want and set(got.values()) == {0}
    assert made == 0


@pytest.mark.parametrize("block", range(3))
def test_large_keys_in_several_components(spark, block):
    """Fingerprints that agree on two blocks, more than a key's neighbours, in many components: only points bring some links."""
    r = random.Random(block)
    bits = list(simhash.BLOCKS[block])[:21]
    fps = []
    for _ in range(60):
        f = r.getrandbits(21) << bits[0]
        fps += [f, f ^ sum(1 << b for b in r.sample(bits, r.randrange(3, 6)))]
    got, want, made = _roots(spark, list(dict.fromkeys(fps)))
    assert got == want and 20 < len(set(got.values())) < 110
    assert made > 0


def test_small_keys_have_all_links(spark):
    """Pairs of up to NEIGHBOURS + 1 that share a key come without points, those of one known component not at all."""
    fps = [0, 1 << 3, 1 << 25, 1 << 44 | 1 << 45, 1 << 3 | 1 << 26 | 1 << 50, 1 << 10 | 1 << 11 | 1 << 12 | 1 << 13 | 1 << 14]
    rows = spark.createDataFrame([(f, k // 2, k // 2) for k, f in enumerate(fps)], "fp long, lo int, hi int")
    near = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= simhash.RADIUS}
    found = lambda x: {frozenset((r["a"], r["b"])) for r in simhash.neighbours(simhash.keys(x)).collect()}
    assert found(rows.select("fp")) == near
    assert found(rows) == {p for p in near if len({fps.index(f) // 2 for f in p}) > 1}
