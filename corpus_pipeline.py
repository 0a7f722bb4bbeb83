"""A training corpus from the raw documents, in five stages of the operators in scriptmill.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import bpe, decontaminate, quality, secrets, simhash
from scriptmill.llm.common import stored, table
from scriptmill.llm.registry import TOKENIZER, quality_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold go."""
    return quality.keep(docs, quality_model(spark, docs, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return secrets.redact(docs).withColumn("n_chars", n_chars)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    out = bpe.digests(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Votes, fingerprints, decoded layers and merges are beyond SQL: run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
