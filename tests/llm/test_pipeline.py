import hashlib

from tests.llm import brute
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES, DOCS, prose
from tests.llm.test_operators import KEY, library, same

import corpus_pipeline
from scriptmill.llm import quality, secrets


CLASHING_STAGES = [x for x in corpus_pipeline.STAGES[:-1] if "near" not in x[0]]  # that one is tested with such columns on its own


def junk(seed):
    return " ".join(w + "%%%" for w in prose(seed, 60).split())


def tables(spark, path):
    bench = prose(900, 30)
    texts = [(k, prose(k, 80 + k)) for k in range(60)] + [(100 + k, junk(k)) for k in range(30)]
    texts += [(200, texts[3][1]), (201, texts[3][1].replace("t", "T")), (202, bench), (203, prose(901, 900) + " " + " ".join(bench.split()[:14])), (204, f"{prose(902, 50)} {KEY} end"), (205, None), (206, "")]
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in texts], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k, _ in texts[:90]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, bench


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts, bench = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    voter = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~quality.held_out()))
    kept = [(d, t) for (d, t), s in zip(texts, voter.scores([(t or "").encode() for _, t in texts]), strict=True) if s >= quality.THRESHOLD]
    assert not any(100 <= d < 130 for d, _ in kept) and {d for d, _ in kept} >= set(range(60)) | {203, 204}
    kept = [(d, t) for d, t in kept if d == brute.near_copies(kept)[d]]
    assert not {200, 201} & {d for d, _ in kept}
    bad = {r[0] for r in brute.contamination(kept, [(1, bench)]) if r[-1]}
    assert bad == {202}
    kept = [(d, t) for d, t in kept if d not in bad]
    tokenizer, want = library(), []
    for d, t in kept:
        for lo, hi in reversed(secrets.merged((s, e) for s, _, e in secrets.all_spans(t or "")[1])):
            t = t[:lo] + "[SECRET]" + t[hi:]
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, "en", "s", len(ids), brute.sha(" ".join(map(str, ids))), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()], want)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
    more = docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    for name, stage in CLASHING_STAGES:
        out = stage(spark, more, str(tmp_path))
        assert out.columns == more.columns, name
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), str(tmp_path)).count() == 0
