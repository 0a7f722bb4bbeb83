"""A Bloom filter as a small table, for lexicons that are too large to be broadcast.

A word's hash chooses a block of 32,768 bits and HASHES places in it. The blocks are
bitmaps that Spark's bitmap aggregate sets on the executors, before and after one
shuffle of the blocks, and they are broadcast: BITS bits a word, so
30 MB for 20 million words. A word whose places are not all set is not in the
lexicon. Of other words about one in a hundred has all set by chance, so an exact
join follows, to which only the possible members go.

A filter of more than MAX_BLOCKS blocks (256 MB, some 180 million words) is
not made; all words then meet the lexicon.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.sources.shared import stored

BLOCK, BITS, HASHES = 32_768, 12, 4
MAX_BLOCKS = 65_536


def _block(word: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), word), F.lit(blocks))


def _places(word: Column) -> list[Column]:
    """Places in a block, as 15 bits each of another hash."""
    h = F.xxhash64(F.lit(2), word)
    return [F.shiftright(h, 15 * k).bitwiseAND(F.lit(BLOCK - 1)) for k in range(HASHES)]


def build(words: DataFrame, count: int, word: str = "word") -> DataFrame | None:
    """The filter (block, bits) of ``count`` words; None if it would be too large."""
    blocks = max(1, -(-count * BITS // BLOCK))
    if blocks > MAX_BLOCKS:
        return None
    w = F.col(word)
    rows = words.filter(w.isNotNull()).select(_block(w, blocks).alias("block"), F.explode(F.array(*_places(w))).alias("place"))
    out = stored(rows.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")), "bloom")
    out.blocks = blocks
    return out


def possible(rows: DataFrame, filter: DataFrame, word: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the word may be in the filter."""
    blocks = F.broadcast(filter.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    byte = lambda place: F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda place: F.getbit(byte(place), place.bitwiseAND(F.lit(7)).cast("int")) == 1
    met = rows.join(blocks, _block(word, filter.blocks) == F.col("_block"), "left")
    return met.withColumn(out, F.coalesce(reduce(lambda a, b: a & b, map(is_set, _places(word))), F.lit(False))).drop("_block", "_bits")


def mark(rows: DataFrame, lexicon: DataFrame, word: Column, out: str, count: int) -> DataFrame:
    """``rows`` with ``out``: whether the word is in the lexicon of ``count`` words. Of ``rows`` (few columns, read twice) only possible members are shuffled."""
    known = lexicon.select(F.col("word").alias("_known")).distinct()
    found = F.col("_known").isNotNull().alias(out)
    filter = build(known, count, "_known")
    if filter is None:
        return rows.join(known.hint("merge"), word == F.col("_known"), "left").select(*rows.columns, found)
    asked = stored(possible(rows, filter, word, "_maybe"), "asked")
    members = asked.filter("_maybe").join(known.hint("merge"), word == F.col("_known"), "left").select(*rows.columns, found)
    return members.union(asked.filter("not _maybe").select(*rows.columns, F.lit(False).alias(out)))
