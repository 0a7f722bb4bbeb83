import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import pieces
from scriptmill.llm.registry import PIECES, QUERIES
from tests.llm.test_operators import rows

CONTENT = open(PIECES, "rb").read()
OWN, LIBRARY = pieces.Pieces(CONTENT), pieces._library(CONTENT)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_equals_the_library(texts):
    assert OWN.encode_batch(texts) == LIBRARY.encode(texts)
    assert [OWN.decode(x) for x in LIBRARY.encode(texts)] == LIBRARY.decode(LIBRARY.encode(texts))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=10))
def test_decodes_any_ids(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text("abetheing ▁\n.,é🙂", min_size=1, max_size=60))
def test_heap_equals_rows(text):
    part = pieces.BLANK + text.replace(" ", pieces.BLANK)
    own = [i for s in OWN.merge(part) for i in ([OWN.ids[s]] if s in OWN.ids else OWN.spelt(s))]
    assert own == LIBRARY.encode(text)
    assert pieces.SHORT < 60 and own == [i for p in OWN.parts(text) for i in next(iter(OWN.ids_of([p])))]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "ab ", " ", "é\n"])
def test_long_parts(letters):
    r = random.Random(1)
    text, began = "".join(r.choice(letters) for _ in range(200_000)), time.process_time()
    ids = OWN.encode_batch([text])[0]
    assert time.process_time() - began < 30
    assert ids == LIBRARY.encode(text) and OWN.decode(ids) == LIBRARY.decode(ids)


def test_rows(spark, docs, clashing, empty, edge_texts):
    got = pieces.digests(docs.select("doc_id", "text"), PIECES, check_every=1).collect()
    want = []
    for d, t in edge_texts:
        ids = LIBRARY.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows(pieces.digests(clashing, PIECES), *names) == rows(pieces.digests(docs, PIECES, check_every=None), *names)
    assert pieces.digests(empty, PIECES).count() == 0 == pieces.differences(docs, PIECES).count()
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert all(r["decoded"] == (r["text"] or "").replace(pieces.BLANK, " ") for r in back.collect())


def test_a_difference_is_an_error(spark, docs, monkeypatch):
    class Wrong:
        def encode(self, texts, num_threads):
            return [[5]] * len(texts)

        def decode(self, ids, num_threads):
            return ["x"] * len(ids)

    import pyarrow as pa

    monkeypatch.setattr(pieces, "_library", lambda content: Wrong())
    sent = type("Sent", (), {"value": CONTENT})
    with pytest.raises(ValueError, match="differ"):
        list(pieces._digests(sent, "text", 16)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one"]})]))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="merge type"):
        pieces.Pieces(CONTENT.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01"))


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
