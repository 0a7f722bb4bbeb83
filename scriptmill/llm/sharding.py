"""Weighted rendezvous hashing of stable keys onto shards, in built-in functions only.

Every key scores each shard by ``-ln(u) / weight``, ``u`` a uniform number made
of the MD5 of key and shard; the least score wins, ties go to the lower shard.
A further shard changes nobody's older scores, so it only takes rows into
itself, and a shard's share is its weight's.

Rows: a null key counts as the key ``null``; equal keys land in the same
shard; a null text has size 1 and checksum 0; repeated rows each get a slot of
their own. Shards that win no row don't appear. Empty tables give no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scriptmill.llm.common import stored

#: Hex digits of the key's digest that deal the rows of a shard into 16**DIGITS runs, each numbered by one task.
DIGITS = 3


def score(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return -F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: an index into ``weights``."""
    return F.array_min(F.array(*[F.struct(score(key, k, w).alias("s"), F.lit(k).alias("shard")) for k, w in enumerate(weights)]))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], grown: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard, slot and, if ``grown`` (the weight of one more shard) is given, grown_shard.

    Slots number the rows of a shard from 0 in the order of the key's MD5,
    the key, checksum and size. Each of the 16**DIGITS runs of digests is
    numbered on its own and shifted by the count of the runs before it; these
    counts are at most 16**DIGITS times the number of shards, which bounds the
    broadcast.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.md5(name.cast("binary")).alias("_digest"),
        rendezvous(name, weights).alias("shard"),
        *([score(name, len(weights), grown).alias("_new"), F.least(*[score(name, k, w) for k, w in enumerate(weights)]).alias("_old")] if grown is not None else []),
    )
    if grown is not None:
        rows = rows.withColumn("grown_shard", F.when(F.col("_new") < F.col("_old"), F.lit(len(weights))).otherwise(F.col("shard"))).drop("_new", "_old")
    rows = stored(rows.withColumn("_run", F.substring("_digest", 1, DIGITS)), "shards")
    before = W.partitionBy("shard").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n")).select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("shard", "_run").orderBy("_digest", "doc_id", "text_crc32", "size")
    return rows.withColumn("_at", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "_run"]).withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_digest", "_run", "_start", "_at")
