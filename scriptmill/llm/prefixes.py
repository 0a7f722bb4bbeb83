"""The prefix trie of conversations, and what its shared prefixes save, by heavy paths.

A node is a distinct sequence of first turns (role and text), known by the smallest
conversation that begins with it and by its depth, so its text is that
conversation's turn of that number. Every conversation holds the chain of nodes
from the root to its own end.

Sums over subtrees come from a heavy-path decomposition. A node's heavy child is
the one with the most conversations (of equal ones that with the smallest), and
heavy edges join the nodes to paths, each of which ends in a leaf and lies on the
chain of the leaf's smallest conversation. A light child has at most half of its
parent's conversations, so a chain has at most log2(n) light edges. Rounds go
from the paths below most light edges up: a suffix sum along each path, whose total at
the top then belongs to the parent of the top.

Prefixes meet as 128 bits: for each number of turns the XOR of two 64-bit hashes
of (place, SHA-256 of the turn). Each group of equal bits must agree on its last
turn's SHA-256 and on its parent's bits, else the job fails, so equality is that
of the turns' SHA-256.

Nothing is gathered by conversation or node. Running values within a
conversation or path go by blocks of BLOCK turns, whose totals meet first; a node's
attributes go back to its conversations by salts; the ids of the conversations
that end at a node are packed by ranges of IDS numbers, and the packs, in order,
run through one hash as a stream.

Rows: turns without a conv_id belong to no conversation and are left out. Turns are
ordered by turn (null first), equal ones by role, then by the SHA-256 of role and text.
A null role or text is the empty one. Repeated rows are turns of their own.
Turns of any length are hashed whole. An empty table has no trie, not even a root. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptmill.llm.common import Columns, salt, salts_of, stored
from scriptmill.sources.shared import discard

#: Turns of a conversation whose running values one task works out.
BLOCK = 4096
#: Range of conversation ids in a pack.
IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]


def _blocks(rows: DataFrame, key: str, totals: dict[str, Column], across: dict[str, Column]) -> DataFrame:
    """``rows`` (with ``block``) with ``across``: expressions over the totals of the key's blocks, windows by ``key`` in the order of ``block``."""
    each = rows.groupBy(key, "block").agg(*[v.alias(k) for k, v in totals.items()])
    return rows.join(each.select(key, "block", *[v.alias(k) for k, v in across.items()]), [key, "block"])


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: turns as conv_id, block, place (from 1 in the block), digest and n_words; and the blocks as conv_id, block, offset and n."""
    cols = Columns(turns)
    get = lambda name, kind: F.col(cols[name]).cast(kind)
    role, text = (F.coalesce(get(c, "string"), F.lit("")) for c in ("role", "text"))
    rows = cols.rows.select(
        get("conv_id", "bigint").alias("conv_id"),
        get("turn", "bigint").alias("turn"),
        role.alias("role"),
        # the length of the role tells where the text begins
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"),
    ).filter("conv_id is not null")
    # -1 << 63 is below all blocks of turns
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 63)).cast("bigint")))
    order = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    placed = stored(rows.select("conv_id", "block", F.row_number().over(order).cast("bigint").alias("place"), "digest", "n_words"), "turns")
    blocks = placed.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("block")) - F.col("n")
    return placed, stored(blocks.select("conv_id", "block", before.alias("offset"), "n"), "blocks")


def chains(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest and n_words of each turn, and a row of depth 0 for each conversation."""
    placed, blocks = numbered(turns)
    rows = placed.join(blocks, ["conv_id", "block"])
    return _rooted(rows.select("conv_id", (F.col("offset") + F.col("place")).alias("depth"), "digest", "n_words"), blocks.select("conv_id").distinct())


def grafted(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """As ``chains``, of conversations whose heads are another's: c begins with the first h turns of c - c mod ``group``, h = crc32(c) mod ``most``, in place of its own first h."""
    placed, blocks = numbered(turns)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    first = placed.filter((base == F.col("conv_id")) & (F.col("place") < most)).join(blocks, ["conv_id", "block"])
    first = first.select("conv_id", (F.col("offset") + F.col("place")).alias("depth"), "digest", "n_words").filter(F.col("depth") < most)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "n_words"))).alias("head"))  # fewer than most
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    convs = blocks.select("conv_id").distinct().select("conv_id", base.alias("base"), cut.alias("cut")).join(heads, "base", "left")
    convs = stored(convs.select("conv_id", "cut", F.expr("case when head is null then array() else slice(head, 1, cut) end").alias("head")), "heads")
    own = placed.join(blocks.join(convs.select("conv_id", "cut", F.size("head").alias("n_head")), "conv_id"), ["conv_id", "block"])
    own = own.withColumn("at", F.col("offset") + F.col("place")).filter("at > cut").select("conv_id", (F.col("at") - F.col("cut") + F.col("n_head")).alias("depth"), "digest", "n_words")
    return _rooted(own.union(convs.select("conv_id", F.inline("head"))), convs.select("conv_id"))


def _rooted(rows: DataFrame, convs: DataFrame) -> DataFrame:
    return rows.union(convs.select("conv_id", F.lit(0).cast("bigint"), F.lit(b""), F.lit(0).cast("bigint")))


def _prefixes(rows: DataFrame) -> DataFrame:
    """The rows of chains with the bits of their nodes (a, b) and of the parents (pa, pb), and is_end where a conversation ends."""
    hashed = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(0)
    rows = rows.withColumns({"xa": hashed(1), "xb": hashed(2), "block": F.floor(F.col("depth") / BLOCK)})
    order = W.partitionBy("conv_id").orderBy("block")
    before = lambda x: F.coalesce(F.bit_xor(x).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = {"ta": F.bit_xor("xa"), "tb": F.bit_xor("xb"), "top": F.max("depth")}
    rows = _blocks(rows, "conv_id", totals, {"ba": before("ta"), "bb": before("tb"), "last": F.max("top").over(W.partitionBy("conv_id"))})
    here = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumns({k: F.bit_xor(f"x{k}").over(here).bitwiseXOR(F.col(f"b{k}")) for k in "ab"})
    return own.select("conv_id", *NODE, F.col("a").bitwiseXOR(F.col("xa")).alias("pa"), F.col("b").bitwiseXOR(F.col("xb")).alias("pb"), "digest", "n_words", (F.col("depth") == F.col("last")).alias("is_end"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Nodes with first (the smallest conversation), n_convs, saved (tokens of their own), n_children, heavy, and the salts of their conversations."""
    same = lambda *cols: reduce(lambda x, y: x & y, [F.min(c) == F.max(c) for c in cols])
    words = F.when(same("digest", "pa", "pb"), F.max("n_words")).otherwise(F.raise_error(F.lit("two prefixes of conversations have equal hashes")))
    nodes = rows.withColumn("_salt", salt("conv_id")).groupBy(*NODE).agg(
        F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), words.alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask")
    )
    nodes = stored(nodes, "nodes")
    of_parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    families = nodes.filter("depth > 0").select(*of_parent, F.struct(F.col("a").alias("ha"), F.col("b").alias("hb")).alias("child"), F.struct("n_convs", (-F.col("first")).alias("f")).alias("size"))
    families = stored(families.groupBy(*NODE).agg(F.count("*").alias("n_children"), F.max_by("child", "size").alias("child")), "families")
    heavy = families.select((F.col("depth") + 1).alias("depth"), F.col("child.ha").alias("a"), F.col("child.hb").alias("b"), F.lit(True).alias("heavy"))
    nodes = nodes.drop("pa", "pb")
    out = nodes.join(families.select(*NODE, "n_children"), NODE, "left").join(heavy, NODE, "left")
    return out.select(*NODE, "first", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy"), "_mask")


def _paths(rows: DataFrame) -> DataFrame:
    """Each node once, on its heavy path: path, depth, first, parent, top, level (light edges from the root, its own counted) and the node's values."""
    rows = rows.withColumns({"block": F.floor(F.col("depth") / BLOCK), "light": (~F.col("heavy")).cast("bigint")})
    order, whole = W.partitionBy("conv_id").orderBy("block"), W.partitionBy("conv_id")
    after = F.coalesce(F.sum("lights").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    is_leaf = F.col("is_end") & (F.col("n_children") == 0) & (F.col("first") == F.col("conv_id"))
    totals = {"lights": F.sum("light"), "leaf": F.max(is_leaf), "foot": F.max_by("first", "depth")}
    rows = _blocks(rows, "conv_id", totals, {"after": after, "level": F.sum("lights").over(whole), "has_leaf": F.max("leaf").over(whole), "above": F.lag("foot").over(order)}).filter("has_leaf")
    down = W.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    deeper = F.sum("light").over(down.rowsBetween(W.unboundedPreceding, 0)) - F.col("light") + F.col("after")
    rows = rows.withColumns({"deeper": deeper, "parent": F.coalesce(F.lead("first").over(down), "above")}).filter("deeper = 0")
    return rows.select(F.col("conv_id").alias("path"), "depth", "first", "parent", (~F.col("heavy")).alias("top"), "level", "n_convs", "n_children", "saved")


def _summed(rows: DataFrame) -> DataFrame:
    """``rows`` of paths with leaves and tokens summed from each node to the path's end."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    order = W.partitionBy("path").orderBy("block").rowsBetween(1, W.unboundedFollowing)
    later = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    rows = _blocks(rows, "path", {"tl": F.sum("leaves"), "tt": F.sum("tokens")}, {"ll": later("tl"), "lt": later("tt")})
    down = W.partitionBy("path", "block").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"leaves": F.sum("leaves").over(down) + F.col("ll"), "tokens": F.sum("tokens").over(down) + F.col("lt")}).drop("block", "ll", "lt")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs the packs of each node, which come in order, through one hash."""
    node, sha = None, None
    done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])
    for batch in batches:
        out = []
        for first, depth, ids in zip(*[batch[c].to_pylist() for c in ("conv_id", "depth", "ids")], strict=True):
            if (first, depth) != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (first, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if out:
            yield done(out)
    if node is not None:
        yield done([(*node, sha.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of the nodes at which conversations end."""
    packed = rows.filter("is_end").select(F.col("first").alias("conv_id"), "depth", F.col("conv_id").alias("id"), F.floor(F.col("conv_id") / IDS).alias("pack"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")  # at most IDS, as ids are distinct
    packed = packed.groupBy("conv_id", "depth", "pack").agg(ids.alias("ids"))
    packed = packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "pack")
    return packed.select("conv_id", "depth", "ids").mapInArrow(_hash_ends, "conv_id bigint, depth bigint, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of chains (see ``chains``): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    rows = stored(_prefixes(rows), "prefixes")
    nodes = _nodes(rows)
    back = nodes.withColumn("_salt", F.explode(salts_of("_mask"))).drop("_mask")
    rows2 = rows.withColumn("_salt", salt("conv_id")).join(back, [*NODE, "_salt"])
    placed = stored(rows2.select("conv_id", "depth", "is_end", "first", "n_convs", "saved", "n_children", "heavy"), "placed")
    paths = stored(_paths(placed).sortWithinPartitions("level"), "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    summed, light = [], None
    for level in range(deepest, 0, -1):
        own = paths.filter(F.col("level") == level).withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "tokens": F.col("saved")})
        if light is not None:
            own = own.join(light, ["first", "depth"], "left").withColumns({k: F.col(k) + F.coalesce(f"light_{k}", F.lit(0)) for k in ("leaves", "tokens")}).drop("light_leaves", "light_tokens")
        own = stored(_summed(own), f"level-{level}")
        light = own.filter("top and depth > 0").groupBy(F.col("parent").alias("first"), (F.col("depth") - 1).alias("depth"))
        light = light.agg(F.sum("leaves").alias("light_leaves"), F.sum("tokens").alias("light_tokens"))
        summed.append(own)
    ended = stored(ends(placed), "ends")
    discard(rows, placed, paths)
    if not summed:
        return ended.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    out = reduce(DataFrame.unionByName, summed).select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens")
    )
    return out.join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
