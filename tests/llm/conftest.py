import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n, words="the of and tion ing er re onan thest whin éa aß ñco inly bleing for to a is was".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "er", "ing", "tion"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and very long texts, copies, repeats inside and across documents, odd white space and odd characters."""
    shared, base = prose(1, 60), prose(2, 120)
    near = base.split()
    near[50] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t"), (7, "one"), (8, "One two Three"),
        (9, prose(3, 40) + " " + shared + "\n" + prose(4, 30)), (10, shared + "\x0b" + prose(5, 25)), (11, prose(6, 10) + "\x0c" + shared.replace(" ", "  ")),
        (12, "word " * 100), (13, prose(7, 20_000)), (14, "ÀÉ ÎÕ \x1c ab\x85cd     x"), (15, "\x00 \x01 { } [A] Z`z 0:9"),
        (16, (prose(8, 25) + "\n") * 6), (None, base), (None, prose(9, 30)), (17, base), (17, base), (18, "🙂 " * 30), (-5, shared),
    ]


@pytest.fixture(scope="session")
def docs(spark, edge_texts):
    return spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in edge_texts], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


#: Columns named like what the operators make, in plain, dotted or other case.
CLASHES = [
    *["fp", "shard", "slot", "size", "th", "tag", "id", "n_words", "row", "terms", "score", "spans", "media", "node", "rank", "key", "c", "n", "w", "c0", "c1", "a.b", "TEXT.x", "near", "occ", "hit", "items", "kept", "out"],
    *["_score", "_spans", "_base", "_n_layers", "_near", "_hit", "_items", "_n_words", "_keep", "_rows", "_id", "_t", "_y", "ids", "plain", "decoded", "n_tokens", "ids_sha256", "component_id", "up", "anchor", "body", "digest", "uri", "held_out"],
]


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])
