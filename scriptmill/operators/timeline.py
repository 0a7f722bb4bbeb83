"""Sessions cut by inactivity, and values that hold from some time on, over the timelines of keys.

``cut`` gives every event the start of its session: an event more than ``gap`` after the
one before it (of its key) begins a new one. ``as_of`` gives every event the last
change at or before it. Both work in blocks of time: inside a block by a window, and
across blocks by a window over one row a block, so that a key with any share of
the rows is spread over as many tasks as its timeline has blocks.

``cut_stream`` gives the sessions of a stream of events, by Spark's session windows.
A session comes out once the watermark, which follows the latest event by ``delay``,
has passed its last event by ``gap``. Rows behind the watermark are late and are
dropped, so a stream equals the batch where no row comes more than ``delay`` out of order.

Rows: without a key or a time they are left out; events at the same time are of one
session; of changes at the same time the greatest value holds; before the first change
there is no value (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a timeline that one task works through.
BLOCK = 6 * 3600


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _blocks(rows: DataFrame, key: str, seconds: int, totals: dict[str, Column], across: dict[str, Column]) -> DataFrame:
    """``rows`` (with _us) in blocks (_block), with ``across``: windows over the totals of the key's blocks."""
    rows = rows.withColumn("_block", F.floor(F.col("_us") / (seconds * 1_000_000)))
    each = rows.groupBy(key, "_block").agg(*[v.alias(k) for k, v in totals.items()])
    for name, value in across.items():
        each = each.withColumn(name, value)
    return rows.join(each.select(key, "_block", *across), [key, "_block"])


def cut(events: DataFrame, gap: int, key: str = "user_id", at: str = "ts", block: int = BLOCK) -> DataFrame:
    """``events`` with session_start; ``gap`` in seconds."""
    long = gap * 1_000_000
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_us", _micros(at))
    in_block = W.partitionBy(key, "_block").orderBy("_us")
    order = W.partitionBy(key).orderBy("_block")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(order) > long, F.lit(True))
    # the last start inside a block, if any, needs the gaps inside it: they are marked first
    rows = rows.withColumn("_block", F.floor(F.col("_us") / (block * 1_000_000)))
    rows = rows.withColumn("_own", F.when(F.col("_us") - F.lag("_us").over(in_block) > long, F.col("_us")))
    totals = {"_first": F.min("_us"), "_last": F.max("_us"), "_inner": F.max("_own")}
    before = order.rowsBetween(W.unboundedPreceding, -1)
    across = {
        "_fresh": fresh,
        "_begun": F.coalesce("_inner", F.when(F.col("_fresh"), F.col("_first"))),
        "_start": F.when(F.col("_fresh"), F.col("_first")).otherwise(F.last("_begun", ignorenulls=True).over(before)),
    }
    rows = _blocks(rows, key, block, totals, across)
    start = F.coalesce(F.max("_own").over(in_block.rangeBetween(W.unboundedPreceding, 0)), F.col("_start"))
    return rows.withColumn("session_start", F.timestamp_micros(start)).drop("_us", "_block", "_own", "_fresh", "_begun", "_start")


def sessions(events: DataFrame, gap: int, key: str = "user_id", at: str = "ts", block: int = BLOCK) -> DataFrame:
    """The sessions of the keys: session_start, session_end (its last event) and n_events."""
    return cut(events, gap, key, at, block).groupBy(key, "session_start").agg(F.max(F.col(at).cast("timestamp")).alias("session_end"), F.count("*").alias("n_events"))


def cut_stream(events: DataFrame, gap: int, delay: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """As ``sessions``, on a streaming DataFrame, for append mode; ``delay`` in seconds."""
    rows = events.select(F.col(key), F.col(at).cast("timestamp").alias("_at")).filter(F.col(key).isNotNull() & F.col("_at").isNotNull())
    windows = rows.withWatermark("_at", f"{delay} seconds").groupBy(key, F.session_window("_at", f"{gap} seconds").alias("w"))
    found = windows.agg(F.min("_at").alias("session_start"), F.max("_at").alias("session_end"), F.count("*").alias("n_events"))
    return found.select(key, "session_start", "session_end", "n_events")


def as_of(events: DataFrame, changes: DataFrame, value: str, key: str = "user_id", at: str = "ts", since: str = "since", block: int = BLOCK) -> DataFrame:
    """``events`` with ``value`` of the last of the ``changes`` (key, since, value) of its key at or before it."""
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.struct("*").alias("_row"), _micros(at).alias("_us"), F.lit(None).cast(changes.schema[value].dataType).alias("_value"))
    known = changes.filter(F.col(key).isNotNull() & F.col(since).isNotNull() & F.col(value).isNotNull())
    known = known.select(F.col(key).alias("_key"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), _micros(since).alias("_us"), F.col(value).alias("_value"))
    both = rows.union(known)
    order = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("_value").isNotNull(), F.struct("_us", "_value")))
    both = _blocks(both, "_key", block, {"_latest": latest}, {"_before": F.last("_latest", ignorenulls=True).over(order)})
    here = W.partitionBy("_key", "_block").orderBy("_us").rangeBetween(W.unboundedPreceding, 0)
    now = F.coalesce(latest.over(here), F.col("_before"))
    return both.select("_row", now["_value"].alias("_now")).filter("_row is not null").select("_row.*", F.col("_now").alias(value))
