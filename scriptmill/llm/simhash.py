"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most RADIUS bits have a common point within half
of that of both, so every fingerprint emits points of its ball of half the
radius, and a shuffle on the points brings such fingerprints together. At a
point, stars to the least fingerprint of each distance carry every link: no
pairs are emitted, however large the group.

A whole ball has 2,081 points. An exact filter keeps most of them from being
emitted. Of three blocks of the 64 bits, the two that differ least differ in at
most half the radius, so the middle point may be chosen within a quarter of it
there: a fingerprint first emits, for each choice of two blocks, the 43 or 44
points of this smaller ball (its keys). Those that share a key are put in order and each is compared with
the NEIGHBOURS before it, which settles all keys of a few, and most of the links of others. Only where more share a
key and are in several components after that are the full points around it emitted: as a middle point lies between two fingerprints, those
that flip bits of the block left out in which some who share the key differ. Where all who share a key
agree on both blocks, only that key itself is followed.

Components of the links come from alternating large-star and small-star rounds,
each written to the shared folder.

Rows: null, empty and word-less texts have fingerprint 0 and link like any
other; texts of fewer words than a shingle have one; ties at a bit give 0;
repeated rows have one component; a row with a null id takes no part in the
smallest id, and a component of such rows only has a null id. Other columns are
not read by :func:`near_duplicates`; :func:`keep_one` keeps them, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scriptmill.llm.common import Columns, group_min, salt, salts_of, slices, stored, utf8
from scriptmill.sources.shared import discard

WORDS, RADIUS, SEED = 4, 4, 42
#: How many of those before it in a key's order a fingerprint is compared with.
NEIGHBOURS = 8
#: For each value of a byte, eight byte lanes that hold its bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(data: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    tokens = data.lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not tokens:
        return []
    flat = b" ".join(tokens)
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [hashed(flat, seed)]
    ends = list(accumulate(map(len, tokens), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [hashed(flat[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list: the bits set in over half of its hashes."""
    counts = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    pieces = (counts[full] + 254) // 255  # a lane holds up to 255
    owner = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begins = np.repeat(first - 255 * owner, pieces) + 255 * np.arange(pieces.sum())
    lanes = np.add.reduceat(LANES[flat.view(np.uint8).reshape(-1, 8)], begins, axis=0)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int32), owner, axis=0)
    bits = (2 * sums > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(text: str, words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = majority([shingle_hashes(utf8(t), words) for t in batch[text].to_pylist()])
            rest = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(found.view(np.int64))], [*rest, "fp"])

    return work


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint("text", words), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


#: The bits of the three blocks.
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def ball(center: Column, bits, radius: int, among: Column) -> Column:
    """All numbers within ``radius`` (0 to 2) flips of those of the given bits that are set in ``among``."""
    one = [1 << b for b in bits]
    masks = [0, *(one if radius else []), *([a | b for i, a in enumerate(one) for b in one[:i]] if radius > 1 else [])]
    return F.transform(F.filter(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: m.bitwiseAND(among) == m), lambda m: m.bitwiseXOR(center))


def _by_block(k: Column, make) -> Column:
    out = F.when(k == 0, make(0))
    for i in range(1, len(BLOCKS)):
        out = out.when(k == i, make(i))
    return out


def _outside(k: int) -> list[int]:
    return [b for i, block in enumerate(BLOCKS) if i != k for b in block]


def keys(fps: DataFrame) -> DataFrame:
    """The keys of each fingerprint that another one shares, as a stored table: key, the block k left out, the bits own of the other two and rest
    of that one, how many n share the key, and the bits of that block in which they differ.

    ``fps`` may have lo and hi, the least and largest of the components that a fingerprint's
    rows are known to be in: a key whose fingerprints are all in one has nothing to link, and is not followed.

    A key goes through the shuffle with what makes a fingerprint of it again, in
    one number: the bits of the block left out (22), the bit flipped plus 1, or 0
    (7), and the block (2).
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp, k, known = F.col("fp"), F.col("k"), [c for c in ("lo", "hi") if c in fps.columns]
    inside = lambda i: fp.bitwiseAND(F.lit(_mask(BLOCKS[i])))
    sides = fps.repartition(parts, "fp").select("fp", *known, F.explode(F.array(*[F.lit(i) for i in range(len(BLOCKS))])).alias("k"))
    left_out = _by_block(k, lambda i: F.shiftrightunsigned(inside(i), BLOCKS[i].start)).cast("int")
    sides = sides.select("k", *known, _by_block(k, lambda i: fp.bitwiseAND(F.lit(_mask(_outside(i))))).alias("own"), left_out.bitwiseOR(F.shiftleft(k, 29)).alias("base"))
    flip = lambda mask, code: F.struct(F.col("own").bitwiseXOR(F.lit(mask)).alias("key"), F.col("base").bitwiseOR(F.lit(code << 22)).alias("code"))
    flips = _by_block(k, lambda i: F.array(flip(0, 0), *[flip(_signed(1 << b), b + 1) for b in _outside(i)]))
    made = sides.select(*known, F.explode(flips).alias("x")).select(*known, "x.key", "x.code")

    bit = F.shiftrightunsigned("code", 22).bitwiseAND(F.lit(127))
    own = F.when(bit == 0, F.col("key")).otherwise(F.col("key").bitwiseXOR(F.expr("shiftleft(1L, (shiftrightunsigned(code, 22) & 127) - 1)")))
    # a key has at most 44 * 2**22 fingerprints, and the window spills
    every = W.partitionBy("key")
    open_ = F.min("lo").over(every) < F.max("hi").over(every) if known else F.lit(True)
    met = made.withColumn("own", own).select("key", "code", "own", F.count("*").over(every).alias("n"), *known, F.min("own").over(every).alias("least"), F.max("own").over(every).alias("most"), open_.alias("open"), F.bit_or("code").over(every).bitwiseXOR(F.bit_and("code").over(every)).alias("differ"))
    met = met.filter(F.col("open") & (F.col("n") > 1) & ((F.col("least") < F.col("most")) | (F.col("least") == F.col("key")))).withColumn("k", F.shiftrightunsigned("code", 29))
    block = lambda c: F.col(c).bitwiseAND(F.lit((1 << 22) - 1)).cast("bigint")
    return stored(met.select("key", "k", "own", "n", *known, *[_by_block(k, lambda i, c=c: F.shiftleft(block(c), BLOCKS[i].start)).alias(x) for c, x in (("code", "rest"), ("differ", "differ"))]), "keys")


def neighbours(shared: DataFrame) -> DataFrame:
    """Links (a, b) of each fingerprint with those of the NEIGHBOURS before it in its keys' order that are at most RADIUS bits away.

    A key of up to NEIGHBOURS + 1 has all its links then. Two that agree on both blocks are linked where these are the key itself.
    ``shared`` is a table of keys; with lo and hi, links within one component are left out.
    """
    fp, known = F.col("own").bitwiseOR(F.col("rest")), [c for c in ("lo", "hi") if c in shared.columns]
    order = W.partitionBy("key").orderBy("rest", "own").rowsBetween(-NEIGHBOURS, -1)
    rows = shared.select("key", "own", fp.alias("fp"), *known, F.collect_list(F.struct(fp.alias("fp"), "own", *known)).over(order).alias("before"))

    def linked(x: Column) -> Column:
        far = F.bit_count(x["fp"].bitwiseXOR(F.col("fp")))
        apart = F.least("lo", x["lo"]) < F.greatest("hi", x["hi"]) if known else F.lit(True)
        return (far > 0) & (far <= RADIUS) & ((x["own"] != F.col("own")) | (F.col("own") == F.col("key"))) & apart

    found = rows.select(F.col("fp").alias("a"), F.transform(F.filter("before", linked), lambda x: x["fp"]).alias("ends"))
    return found.filter(F.size("ends") > 0).select("a", F.explode("ends").alias("b")).distinct()


def points(fps: DataFrame) -> DataFrame:
    """fp and point: those points of each fingerprint's ball that another one may share. ``fps``: fingerprints (see :func:`keys`), or some of their keys."""
    near = fps if "key" in fps.columns else keys(fps)
    k = F.col("k")
    # a middle point lies between two of the key, so only bits in which some of them differ are flipped
    around = lambda r: _by_block(k, lambda i: ball(F.col("rest"), BLOCKS[i], r, F.col("differ")))
    full = near.select("key", F.col("own").bitwiseOR(F.col("rest")).alias("fp"), F.explode(F.when(F.col("own") == F.col("key"), around(2)).otherwise(around(1))).alias("rest"))
    return full.select("fp", F.col("key").bitwiseOR(F.col("rest")).alias("point")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at most RADIUS bits apart.

    ``fps`` may have lo and hi (see :func:`keys`); of links within one component not all are there then.
    Neighbours in keys are linked first, which leaves only large keys whose fingerprints are in several components.
    Their points are made. Fingerprints at a point are told apart by their distance from it, 0 to 2.
    Those at 1 are linked to the one at 0 and to the least at 1; those at 2 to
    the least at 1 and to the least at 2, but only if they are as far from each
    other as the way over the point: nearer ones are linked at a nearer point.
    """
    known = [f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi")) if c in fps.columns]
    each = stored(fps.groupBy("fp").agg(*known) if known else fps.select("fp").distinct(), "fingerprints")
    shared = keys(each)
    large = shared.filter(F.col("n") > NEIGHBOURS + 1)
    # what is known already is not what these links say, and a caller may find them wrong: large keys stay open then
    first = stored(neighbours(shared.filter(F.col("n") <= NEIGHBOURS + 1) if known else shared), "neighbours")
    if not known and not large.isEmpty():
        roots = components(first)
        fp, every = F.col("own").bitwiseOR(F.col("rest")), W.partitionBy("key")
        rows = large.join(roots.hint("merge"), fp == F.col("node"), "left").withColumn("root", F.coalesce("root", fp))
        large = rows.withColumn("open", F.min("root").over(every) < F.max("root").over(every)).filter("open").select(large.columns)
    # read twice
    made = stored(points(large), "points")
    discard(each, shared)
    return first.union(_stars(made)).distinct()


def _stars(made: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints that share points (fp and point), see :func:`links`."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("point")))
    rows = made.withColumn("far", far).withColumn("_salt", salt("fp"))
    least = [F.min(F.when(F.col("far") == d, F.col("fp"))).alias(f"m{d}") for d in range(3)]
    met = rows.groupBy("point").agg(F.count("*").alias("n"), *least, F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask"))
    met = met.filter("n > 1").select("point", "m0", "m1", "m2", F.explode(salts_of("_mask")).alias("_salt"))
    to = lambda d, e: F.when((F.col("far") == d) & (F.bit_count(F.col("fp").bitwiseXOR(F.col(f"m{e}"))) == d + e), F.col(f"m{e}"))
    ends = F.array_compact(F.array(to(1, 0), to(1, 1), to(2, 1), to(2, 2)))
    near = rows.hint("merge").join(met, ["point", "_salt"]).select("fp", ends.alias("ends")).filter(F.size("ends") > 0)
    return near.select(F.col("fp").alias("a"), F.explode("ends").alias("b")).distinct()


def _named(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.stored_path = edges.stored_path
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node of the edges (a, b)."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = group_min(both, "a", "b", "m").withColumn("m", F.least("a", "m"))
        large = least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = group_min(large, "a", "b", "m")
        small = least.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, edges = edges, stored(small.filter("a <> b").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.count_distinct("a")).first()
        if now == state and now[0] == now[2]:
            return _named(edges)
        state = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    fps = stored(fingerprints(docs, doc_id, text, words), "simhash")
    return least_ids(fps, components(links(fps)))


def least_ids(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """``fps`` (doc_id and fp of each row) with component_id, the smallest id of all rows whose fp has the same root."""
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = group_min(named, "root", "rep", "component_id").select(F.col("fp").alias("_fp"), "component_id")
    least = stored(least, "components")
    return fps.join(least.hint("merge"), F.col("fp") == F.col("_fp"), "left").drop("_fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """Of each component the row with the smallest id (of repeated rows, one); rows without an id stay.

    Links are fingerprints RADIUS bits apart, or, if a ``similarity`` is given,
    texts that share so much of their shingles (see :mod:`neardup`).
    """
    if similarity is None:
        return keep_least(docs, near_duplicates(docs, doc_id, text, words), doc_id)
    from scriptmill.llm import neardup

    return keep_least(docs, neardup.near_duplicates(docs, doc_id, text, words, similarity), doc_id)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the component_id that ``found`` has for it."""
    cols = Columns(docs)
    key = cols[doc_id]
    found = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = stored(found.select(F.col("doc_id").alias("kept"), "n"), "keep")
    out = cols.rows.join(found.hint("merge"), F.col(key) == F.col("kept"), "left").filter(F.col("kept").isNotNull() | F.col(key).isNull())
    if found.filter("n > 1").isEmpty():
        return cols.back(out)
    once = out.filter("n > 1").dropDuplicates([key])
    return cols.back(out.filter("n = 1 or n is null").unionByName(once))
