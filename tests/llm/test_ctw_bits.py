import math

from scriptmill.llm import ctw
from tests.llm.conftest import prose


def test_bits_per_byte(spark):
    texts = {1: prose(1, 40), 2: "", 3: None, 4: "é" * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in ctw.score(docs, ctw.fit(docs)).collect():
        n = len((texts[r["doc_id"]] or "").encode()) + 1
        assert math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / n) and r["bits_per_byte"] > 0
