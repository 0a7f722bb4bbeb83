"""The queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import bpe, ctw, decontaminate, media, oracle, pieces, prefixes, quality, secrets, sharding, simhash, spelling, substrings, warc
from scriptmill.llm.common import shared_path, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    digest = F.when(F.col("record_type") == "response", warc.sha1_base32(F.col("payload"))).otherwise(F.col("digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("length"))
    return warc.read(spark, path).select("page_id", size.cast("bigint").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 8, grown=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.joined("_base"), 256).alias("base_sha256"), secrets.joined("_spans").alias("spans"), F.col("_n_layers").alias("n_layers"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Voter:
    return quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_model(spark, docs, sf_dir))
    return out.select("doc_id", quality.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    media.write(table(spark, sf_dir, "documents"), path)
    return media.describe(media.read(spark, path))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").cast("bigint").alias("n_words"),
        F.size("_hit").cast("bigint").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score(docs, ctw.fit(docs, ~ctw.held_out()))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.grafted(table(spark, sf_dir, "conversations"), group=20, most=4))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted(table(spark, sf_dir, "documents").select("doc_id", "text"), damage=199)
    return spelling.variants(words, least_length=6, least_count=5, factor=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_sharding, op3_secrets, op4_quality, op5_simhash, op6_bpe, op7_substrings, op8_media, op9_decontaminate, op10_ctw, op11_prefix_trie, op12_sentencepiece, op13_spelling)}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
