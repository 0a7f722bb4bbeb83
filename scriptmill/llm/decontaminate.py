"""Benchmark decontamination by a broadcast hash set of test n-grams, in built-in functions only.

Both sides are lower-cased (A-Z) and cut into words. A window is ``n``
consecutive words of a benchmark item, or a whole item of fewer words. A
document word inside any occurrence of a window is hit.

The scan needs no shuffle. The windows sit in a hash table, an array with SLOTS
places for each bucket, which goes to the executors as a constant of the plan. A
document is looked at closely only if one of its aligned blocks of ceil(len/2)
words is a block of a window: any occurrence of a window holds such a block, so
none is missed. The blocks compare upper-cased words, which equal words always
share; the close look compares the windows themselves, word for word.

The table's size is checked before it is made. A benchmark of more than MAX_GRAMS
windows becomes a broadcast hash set of the 64-bit hashes of its blocks: a join
in the tasks that scan the texts finds the texts that hold one of them, and only
those are cut into windows, each text once, however often it stands in the
corpus. Their windows meet the benchmark's by hash and word for word. Only where
a side grows beyond its own limit (MAX_BLOCKS, MAX_WINDOWS, MAX_TEXTS rows) is a
join left to a shuffle. The result is the same on each way.

Rows: a null or empty text, or one without words, has no words and is clean; an
item without words has no window; an item with a null id marks words but is
not listed; repeated items count once, repeated documents once each. An empty
benchmark leaves everything clean. Other columns are kept, whatever their names,
but for those called _n_words, _hit and _items in :func:`hits`, which the results
replace.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import Columns, stored

N = 13
#: More windows than this are not put into the plan.
MAX_GRAMS = 50_000
#: Rows of a side that is broadcast: hashes of blocks (8 bytes each), windows with their words, and digests of texts with what was found in them.
MAX_BLOCKS, MAX_WINDOWS, MAX_TEXTS = 4_000_000, 200_000, 100_000
SLOTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"
BREAKS_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column, breaks: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


def words(text: Column) -> Column:
    return split_words(F.translate(text, UPPER, LOWER), BREAKS)


def grams(words_: Column, n: int, step: int = 1) -> Column:
    """``n`` words from each ``step``-th place on: structs of at (from 0) and gram."""
    last = F.floor((F.size(words_) - n) / step).cast("int")
    return F.when(F.size(words_) >= n, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("at"), F.slice(words_, i * step + 1, F.lit(n)).alias("gram")))).otherwise(F.array().cast("array<struct<at:int,gram:array<string>>>"))


def windows_of(bench: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """Distinct windows: len, gram (lower-cased words) and the ids of their items, as strings."""
    items = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    short = items.filter(F.size("w") < n).select("item", F.size("w").alias("len"), F.col("w").alias("gram"))
    full = items.select("item", F.lit(n).alias("len"), F.explode(grams(F.col("w"), n)["gram"]).alias("gram"))
    return short.union(full).groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


class HashTable:
    """Hashes dealt into buckets of SLOTS places; empty places hold 0."""

    def __init__(self, hashes: list[int]) -> None:
        self.buckets = 16
        while not self._deal(hashes):
            self.buckets *= 2

    def _deal(self, hashes: list[int]) -> bool:
        if len(hashes) > 2 * self.buckets:
            return False
        self.places, fill = [], [0] * self.buckets
        for h in hashes:
            b = h % self.buckets
            self.places.append(b * SLOTS + fill[b])
            fill[b] += 1
        return max(fill) <= SLOTS

    def column(self, values: list, empty: str, separator: str = "|") -> Column:
        """A constant array with the value of each hash at its place."""
        flat = [empty] * (self.buckets * SLOTS)
        for at, v in zip(self.places, values, strict=True):
            flat[at] = str(v)
        return F.split(F.lit(separator.join(flat)), re.escape(separator))

    def first(self, hashed: Column) -> Column:
        """The place, from 1, where the bucket of ``hashed`` begins."""
        return F.pmod(hashed, F.lit(self.buckets)).cast("int") * SLOTS + 1


OCCURRENCES = "array<struct<at:int,size:int,items:array<string>>>"
UNIT, RECORD = "\x01", "\x02"


def _may_hold(up: Column, windows: DataFrame, size: int) -> Column:
    """Whether an aligned block of upper-cased words is one of a window's."""
    half = (size + 1) // 2
    blocks = windows.select(F.explode(grams(F.transform("gram", lambda w: F.upper(w)), half)["gram"]).alias("g")).select(F.xxhash64("g").alias("h")).distinct()
    hashes = [r["h"] for r in blocks.collect()]
    table = HashTable(hashes)
    known = table.column(hashes, "0").cast("array<bigint>")
    last = F.floor(F.size(up) / half).cast("int") - 1
    here = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(up, i * half + 1, F.lit(half))))
    here = F.when(F.size(up) >= size, here).otherwise(F.array().cast("array<bigint>"))
    return F.exists(here, lambda h: F.array_contains(F.slice(known, table.first(h), F.lit(SLOTS)), h))


def _occurrences(words_: Column, windows: DataFrame, size: int) -> Column:
    """Windows of ``size`` words that the benchmark has: at, size and the ids of their items."""
    rows = windows.select(F.xxhash64("gram").alias("h"), F.array_join("gram", " ").alias("g"), F.array_join("items", RECORD).alias("items")).collect()
    hashes = [r["h"] for r in rows]
    table = HashTable(hashes)
    known, texts = table.column(hashes, "0").cast("array<bigint>"), table.column([r["g"] for r in rows], "")
    items = table.column([r["items"] for r in rows], "", UNIT)

    def look(x: Column) -> Column:
        found = F.filter(F.sequence(x["first"], x["first"] + (SLOTS - 1)), lambda j: (F.element_at(known, j) == x["h"]) & (F.element_at(texts, j) == x["g"]))
        return F.transform(found, lambda j: F.element_at(items, j))

    hashed = F.transform(grams(words_, size), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["gram"]).alias("h"), F.array_join(x["gram"], " ").alias("g")))
    placed = F.transform(hashed, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), x["g"].alias("g"), table.first(x["h"]).alias("first")))
    met = F.filter(F.transform(placed, lambda x: F.struct(x["at"].alias("at"), look(x).alias("ids"))), lambda x: F.size(x["ids"]) > 0)
    listed = lambda x: F.array_remove(F.split(F.array_join(x["ids"], RECORD), RECORD), "")
    return F.transform(met, lambda x: F.struct(x["at"].alias("at"), F.lit(size).alias("size"), listed(x).alias("items"))).cast(OCCURRENCES)


def hits(docs: DataFrame, bench: DataFrame, n: int = N, text: str = "text", item: str = "item_id", item_text: str = "text", max_grams: int = MAX_GRAMS) -> DataFrame:
    """``docs`` with _n_words, _hit (places of the words hit, sorted, from 0) and _items (sorted ids of items found)."""
    cols = Columns(docs)
    return cols.back(_found(cols, bench, n, text, item, item_text, max_grams), _n_words="n_words", _hit="hit", _items="items")


def _found(cols: Columns, bench: DataFrame, n: int, text: str, item: str = "item_id", item_text: str = "text", max_grams: int = MAX_GRAMS) -> DataFrame:
    """The rows under plain names with n_words, hit and items."""
    names = Columns(bench)
    windows = windows_of(names.rows, n, names[item], names[item_text])
    lengths = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most n rows
    rows = cols.rows.withColumn("text", F.col(cols[text]).cast("string"))
    if sum(lengths.values()) > max_grams:
        return _places(_found_by_blocks(rows, stored(windows, "windows"), sorted(lengths)))
    near, every = F.lit(False), F.array().cast(OCCURRENCES)
    for size in sorted(lengths):
        mine = windows.filter(F.col("len") == size)
        near = near | _may_hold(F.col("up"), mine, size)
        every = F.concat(every, _occurrences(F.col("w"), mine, size))
    out = rows.withColumn("up", split_words(F.upper("text"), BREAKS_UPPER)).withColumn("n_words", F.size("up")).withColumn("near", near).drop("up")
    out = out.withColumn("w", F.when(F.col("near"), words(F.col("text"))).otherwise(F.array().cast("array<string>")))
    return _places(out.withColumn("occ", F.when(F.col("near"), every).otherwise(F.array().cast(OCCURRENCES))))


def _limited(df: DataFrame, limit: int) -> DataFrame:
    """A stored table, to be broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def _each(rows: Column, **made) -> Column:
    """Structs of columns, or of functions of each element."""
    return F.transform(rows, lambda x: F.struct(*[(f(x) if callable(f) and not isinstance(f, Column) else f).alias(k) for k, f in made.items()]))


def _found_by_blocks(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with n_words and occ: the texts that hold a block of a window are looked at closely, each once."""
    upper, blocks, cut = F.transform("gram", lambda w: F.upper(w)), [], []
    for size in sizes:
        half = (size + 1) // 2
        mine = windows.filter(F.col("len") == size).select(F.explode(grams(upper, half)["gram"]).alias("g"))
        blocks.append(mine.select(F.lit(half).alias("half"), F.xxhash64("g").alias("h")))
        aligned = F.when(F.size("up") >= size, grams(F.col("up"), half, half)).otherwise(grams(F.array().cast("array<string>"), half))
        cut.append(_each(aligned, half=F.lit(half), h=lambda x: F.xxhash64(x["gram"])))
    known = blocks[0]
    for more in blocks[1:]:
        known = known.union(more)
    known = _limited(stored(known.distinct(), "blocks"), MAX_BLOCKS)
    rows = rows.withColumn("th", F.sha2(F.coalesce("text", F.lit("")), 256))
    here = rows.select("th", split_words(F.upper("text"), BREAKS_UPPER).alias("up")).select("th", F.explode(F.concat(*cut)).alias("x")).select("th", "x.*")
    near = _limited(stored(here.join(known, ["half", "h"], "left_semi").select("th").distinct(), "near"), MAX_TEXTS)
    texts = stored(rows.join(near, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")), "texts").withColumn("w", words(F.col("text")))
    parts = F.concat(*[_each(grams(F.col("w"), size), len=F.lit(size), at=lambda x: x["at"], gram=lambda x: x["gram"]) for size in sizes])
    asked = texts.select("th", F.explode(parts).alias("x")).select("th", "x.*").withColumn("h", F.xxhash64("gram"))
    met = asked.join(_limited(windows.withColumn("h", F.xxhash64("gram")), MAX_WINDOWS), ["len", "h", "gram"])
    occ = met.groupBy("th").agg(F.collect_list(F.struct("at", F.col("len").alias("size"), "items")).alias("occ"))  # at most the windows of a text
    occ = _limited(stored(occ, "found"), MAX_TEXTS)
    return rows.withColumn("n_words", F.size(words(F.col("text")))).join(occ, "th", "left").withColumn("occ", F.coalesce("occ", F.array().cast(OCCURRENCES)))


def _places(df: DataFrame) -> DataFrame:
    covered = F.flatten(F.transform("occ", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))
    listed = F.flatten(F.transform("occ", lambda x: x["items"]))
    return df.withColumn("hit", F.array_sort(F.array_distinct(covered))).withColumn("items", F.array_sort(F.array_distinct(listed)))


def contaminated(share: int = 20, hit: str = "_hit", n_words: str = "_n_words") -> Column:
    """At least one in ``share`` words is hit."""
    return (F.size(hit) > 0) & (F.size(hit) * F.lit(share) >= F.col(n_words))


def remove_documents(docs: DataFrame, bench: DataFrame, n: int = N, share: int = 20, text: str = "text", **names) -> DataFrame:
    """The rows of ``docs``, unchanged, that aren't contaminated."""
    cols = Columns(docs)
    out = _found(cols, bench, n, text, **names).withColumn("out", contaminated(share, "hit", "n_words"))
    # the generator keeps the optimizer from copying the whole search into the filter
    return cols.back(out.withColumn("out", F.explode(F.array("out"))).filter("not out"))


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = N, text: str = "text", **names) -> DataFrame:
    """The rows of ``docs``; where words are hit, the text is its other words joined by spaces, in their own case."""
    cols = Columns(docs)
    out = _found(cols, bench, n, text, **names)
    kept = F.array_join(F.filter(split_words(F.col("text"), BREAKS_ANY), lambda w, i: ~F.array_contains(F.col("hit"), i)), " ")
    return cols.back(out.withColumn(cols[text], F.when(F.size("hit") > 0, kept).otherwise(F.col(cols[text]))))
