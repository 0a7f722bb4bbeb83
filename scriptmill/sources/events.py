"""Key events: their schema, batch and stream readers, and events made from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_EVENTS = "session_id string, bundle_id string, seq bigint, ch string, key_code int, mods array<string>"
#: Stands in mods of the event that marks a field's loss of focus, which emits what is held.
END = "end"


def read_events(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(KEY_EVENTS).format(format).load(path)


def read_event_stream(spark: SparkSession, path: str, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(KEY_EVENTS).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def typed(text: DataFrame, session: Column, body: str = "text", bundle: str = "org.example.notes") -> DataFrame:
    """One key event per character of each row's text, in order."""
    rows = text.select(session.cast("string").alias("session_id"), F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "")).alias("seq", "ch")).filter("ch <> ''")
    return rows.select("session_id", F.lit(bundle).alias("bundle_id"), F.col("seq").cast("bigint").alias("seq"), "ch", F.lit(0).alias("key_code"), F.array().cast("array<string>").alias("mods"))


def is_end(mods: Column) -> Column:
    return F.coalesce(F.array_contains(mods, END), F.lit(False))


def ended(events: DataFrame) -> DataFrame:
    """``events`` with an end event after the last one of each session that has none there."""
    last = F.max_by(F.struct("bundle_id", is_end(F.col("mods")).alias("done")), "seq")
    ends = events.groupBy("session_id").agg(last.alias("last"), (F.max("seq") + 1).alias("seq")).filter("not last.done")
    return events.select("session_id", "bundle_id", "seq", "ch", "key_code", "mods").union(
        ends.select("session_id", "last.bundle_id", "seq", F.lit(None).cast("string"), F.lit(0), F.array(F.lit(END)))
    )
