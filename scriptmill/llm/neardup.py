"""The mode of :mod:`simhash` that links by the similarity of word shingles: candidates by SimHash, then an exact check.

Two texts are linked if their sets of shingles have a Jaccard similarity of at
least SIMILARITY. At 0.8, fingerprints differ in some ten of 64 bits, whose ball
is beyond any disk. So a text has GROUPS fingerprints of 64 bits, by independent
hashes of its shingles, and keys are made of the bits whose votes are most
one-sided, as these hardly ever differ between near copies: of each fingerprint
the place and value of the strongest bit. A key is those of BITS fingerprints,
and a text has KEYS of them. Texts that share a key are candidates; if the first
two fingerprints differ in more than FAR of 128 bits, or one has too few shingles
for the other, they are none. Of those left the first WIDE fingerprints are compared, which tell 0.7 from
0.8 where texts share a long passage: at 0.8 they differ in some 620 of 4,096 bits, with a deviation of 23,
so at FAR_WIDE a pair is lost with a chance of some 1 in 100,000. Only pairs that pass have their shingles shuffled and
compared. Of pairs at 0.8 nearly all share a key, of nearer ones more; the README has measured shares.

All bounds hold for similarities from SIMILARITY on; a lower one is an error.

Texts with equal sets are one node. Sets of fewer than LEAST shingles have no
keys, since at SIMILARITY they can be near to equal ones only.

Texts meet by their keys first. No key's pairs are all listed, however large its group: in each of
SINGLE turns a text that is not yet in one component with the members of its keys meets one of them, in the first turn that
of all its keys which meets most others in all its keys, and of copies is likely what they were made from.
Of the keys of two only those whose members may link are kept, and only nodes with a key
or a link by the ball have their shingles stored.

Then :mod:`simhash`'s own method, its meet-in-the-middle ball hashing, brings
together texts whose first fingerprints differ in at most four bits and that are not in one component yet, and its stars carry them to the check.
It does not follow what lies in one component only, so a large group of near copies that the keys have linked emits no points.

What keys leave open is then settled exactly, however many texts share a passage (:func:`_crowd`): all nodes of keys
whose members are still in several components meet on their rarest shingles. Shingles are put in one order, frequent
ones last. Two sets of sizes s and t and a similarity of ``least`` have at least n = least / (1 + least) * (s + t) in common, so the first they
have in common is at most at place s - n + 1 of the one and t - n + 1 of the other. A passage
that makes no pair near stands behind these places in the smaller set, and brings no pairs.

Rows: null, empty and word-less texts have no shingles and are copies of each
other; texts of fewer words than a shingle have one; ids are treated as
:mod:`simhash` does; other columns are not read. A node is known by 64 bits of a
hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scriptmill.llm.common import slices, stored, tidy, utf8
from scriptmill.sources.shared import discard, small_side, trim_driver
from scriptmill.llm.simhash import LANES, components, least_ids, links, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
GROUPS, KEYS, BITS = 96, 384, 4
FAR, LEAST = 44, 4
#: Fingerprints of a node that may have near ones; bits in which they may differ; sets of fewer shingles than SKETCHED are compared without them.
WIDE, FAR_WIDE, SKETCHED = 64, 720, 16
#: What a node is told by before its shingles are: two fingerprints, and how many shingles it has.
SKETCH = ("sim0", "sim1", "size")
#: In so many turns a text meets another one by its keys.
SINGLE = 3
#: Shingles of at most so many of the crowd's sets are not told apart by their number.
RARE = 8
#: Bytes of text whose shingles a task holds at a time.
PIECE = 1 << 20
_R = np.random.default_rng(42)
FACTORS = _R.integers(0, 1 << 63, GROUPS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _R.integers(0, 1 << 63, GROUPS, np.uint64)
#: The fingerprints that a key is made of.
CHOSEN = np.array([_R.choice(GROUPS, BITS, replace=False) for _ in range(KEYS)])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(utf8(text), words), np.uint64))


def node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def votes(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """For each fingerprint and bit, by how many shingles more set it than not."""
    out = np.zeros(groups * 64, np.int64)
    for k in range(0, len(shingles), 255):  # a lane holds up to 255
        x = shingles[k : k + 255, None] * FACTORS[:groups] + SHIFTS[:groups]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        out += LANES[x.view(np.uint8).reshape(len(x), -1)].sum(0).view(np.uint8)
    return 2 * out.reshape(groups, 64) - len(shingles)


def fingerprint(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two fingerprints, and of each the strongest bit: its place, and 64 more if it is set."""
    found = votes(shingles)
    at = np.abs(found).argmax(1)
    strongest = at + 64 * (found[np.arange(GROUPS), at] > 0)
    return np.packbits(found[:2] > 0, axis=1, bitorder="little").view(np.uint64).ravel(), strongest.astype(np.uint8)


def wide(shingles: np.ndarray) -> np.ndarray:
    """The first WIDE fingerprints."""
    return np.packbits(votes(shingles, WIDE) > 0, axis=1, bitorder="little").view(np.int64).ravel()


def keys_of(strongest: np.ndarray) -> np.ndarray:
    """KEYS keys for each row of strongest bits: the key's number, and BITS times seven bits."""
    out = np.tile(np.arange(KEYS, dtype=np.int64), (len(strongest), 1))
    for k in range(BITS):
        out = out << 7 | strongest[:, CHOSEN[:, k]]
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of each set."""
    return keys_of(np.array([fingerprint(s)[1] for s in sets]).reshape(-1, GROUPS))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _fingerprints(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            fps, sizes, sims, strongest = [], [], np.zeros((batch.num_rows, 2), np.uint64), [None] * batch.num_rows
            for i, t in enumerate(batch["text"].to_pylist()):
                shingles = shingle_set(t, words)
                fps.append(node(shingles))
                sizes.append(len(shingles))
                if len(shingles) >= LEAST:
                    sims[i], found = fingerprint(shingles)
                    strongest[i] = found.tobytes()
            cols = [np.array(fps, np.uint64).view(np.int64), *np.ascontiguousarray(sims.T).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, cols), pa.array(sizes, pa.int32()), pa.array(strongest, pa.binary())], ["doc_id", "fp", "sim0", "sim1", "size", "strongest"])

    return work


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "strongest", PIECE):
        found = keys_of(np.array([np.frombuffer(x, np.uint8) for x in batch["strongest"].to_pylist()]).reshape(-1, GROUPS))
        yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(list(found), pa.list_(pa.int64()))], ["fp", "keys"])


def _shingles(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            fps = np.array([node(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    return work


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "shingles"):
        sets = [np.frombuffer(x, np.uint64) for x in batch["shingles"].to_pylist()]
        found = [wide(s) if len(s) >= SKETCHED else None for s in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "wide"])


def _checked(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a"):
            sets = zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True)
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in sets]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(near, pa.bool_())], ["a", "b", "near"])

    return work


def _may_link(a: str, b: str, least: float) -> Column:
    """Whether the fingerprints differ in at most FAR bits, and the sizes are such that the similarity can be ``least``."""
    far = sum(F.bit_count(F.col(f"{a}sim{k}").bitwiseXOR(F.col(f"{b}sim{k}"))) for k in range(2))
    sizes = [F.col(f"{x}size").cast("double") for x in (a, b)]
    return (far <= FAR) & (F.least(*sizes) / F.greatest(*sizes) >= least)


def _near(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) that may link, as a stored table."""
    one = lambda x: nodes.select(F.col("fp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in SKETCH])
    both = small_side(pairs).join(one("a"), "a").hint("merge").join(one("b").hint("merge"), "b")
    return stored(both.filter(_may_link("a_", "b_", least)).select("a", "b"), "near")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sketches differ in at most FAR_WIDE bits, or that have none, as a stored table."""
    one = lambda x: sets.select(F.col("fp").alias(x), F.col("wide").alias(f"wide_{x}"))
    few = small_side(pairs)
    half, other = few.join(one("a"), "a"), one("b").join(few.select("b"), "b", "left_semi")
    bits = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return stored(half.hint("merge").join(other.hint("merge"), "b").filter(F.coalesce(bits <= FAR_WIDE, F.lit(True))).select("a", "b"), "alike")


def _compare(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) with near, as a stored table. Few pairs go to where the sets are, and only the sets of their ends are shuffled; else both are."""
    one = lambda x: sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"set_{x}"))
    few = small_side(pairs)
    half, other = few.join(one("a"), "a"), one("b").join(few.select("b"), "b", "left_semi")
    both = half.hint("merge").join(other.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    return stored(both.mapInArrow(tidy(_checked(least)), "a bigint, b bigint, near boolean"), "compared")


def _ordered(rows: DataFrame, other: str) -> DataFrame:
    """``rows`` (fp and root, and those of ``other``, a struct) as distinct pairs (a, b, root_a, root_b), the larger node first."""
    first = F.col("fp") > F.col(f"{other}.fp")
    ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("fp", f"{other}.fp", "a"), (f"{other}.fp", "fp", "b"), ("root", f"{other}.root", "root_a"), (f"{other}.root", "root", "root_b"))]
    return rows.select(*ends).distinct()


def _ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of ``nodes`` in several components (root; without it each is its own), by the ball hashing of simhash: each with the least one of its first fingerprint, and these by the stars of its links."""
    known = nodes.filter("strongest is not null").select("fp", "sim0", "root" if "root" in nodes.columns else F.col("fp").alias("root"))
    reps = stored(known.groupBy("sim0").agg(F.min(F.struct("fp", "root")).alias("rep"), F.min("root").alias("lo"), F.max("root").alias("hi")), "reps")
    same = known.join(reps.filter("lo < hi").hint("merge"), "sim0").select("fp", "root", F.col("rep").alias("to"))
    stars = links(reps.select(F.col("sim0").alias("fp"), "lo", "hi"))
    one = lambda x: reps.select(F.col("sim0").alias(x), F.col("rep").alias(f"rep_{x}"))
    near = stars.join(one("a").hint("merge"), "a").join(one("b").hint("merge"), "b").select("rep_a.fp", "rep_a.root", F.col("rep_b").alias("to"))
    out = stored(_ordered(same.union(near).filter("root <> to.root"), "to"), "ball")
    discard(reps)
    return out


def _partners(placed: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of each node with one member of one of its keys that is in another component, if they may link."""
    order = F.xxhash64("fp", "key", F.lit(turn)) if turn else -F.col("hub")
    met = placed.withColumn("to", F.min(F.struct(order.alias("order"), "fp", "root", *SKETCH)).over(W.partitionBy("key"))).filter("root <> to.root").filter(_may_link("", "to.", least))
    best = met.groupBy("fp").agg(F.min(F.struct("to", "root")).alias("x"))
    return _ordered(best.select("fp", "x.root", "x.to"), "to")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "shingles", PIECE):
        sets = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        fps, roots, sizes = (batch[c].to_numpy() for c in ("fp", "root", "size"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fps[owner], roots[owner], sizes[owner], np.concatenate(sets))], ["fp", "root", "size", "shingle"])


def _crowd(placed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of nodes in other components that may be near, of all nodes in keys with members of several components, as a stored table.

    No pair at ``least`` is left out. The larger set has its shingles up to the place where it may meet one of ``least`` times its size,
    the smaller one up to that where it may meet one of its own size.
    """
    key = W.partitionBy("key")
    open_ = placed.withColumn("lo", F.min("root").over(key)).withColumn("hi", F.max("root").over(key)).filter("lo < hi")
    nodes = stored(open_.select("fp", "root", "size").distinct(), "crowd")
    each = sets.select("fp", "shingles").join(small_side(nodes), "fp").select("fp", "root", "size", "shingles")
    each = stored(each.mapInArrow(tidy(_spelled), "fp bigint, root bigint, size int, shingle bigint"), "crowd-shingles")
    often = stored(each.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > RARE), "often")
    placed = each.join(small_side(often), "shingle", "left").withColumn("place", F.row_number().over(W.partitionBy("fp").orderBy(F.coalesce("n", F.lit(0)), "shingle")))
    size, share = F.col("size"), least / (1 + least)
    upto = lambda part: size - F.ceil(size * part - 1e-6) + 1
    places = placed.filter(F.col("place") <= upto(least)).select("shingle", "fp", "root", "size", "place", (F.col("place") <= upto(2 * share)).alias("short"))
    # the rows of a shingle's largest component meet those of the others only
    places = stored(places, "places")
    main = places.groupBy("shingle").agg(F.mode("root").alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("short").alias("met"))
    main = stored(main.filter("lo < hi and met").select("shingle", "main"), "main")
    rows = places.join(small_side(main), "shingle").withColumn("inner", F.col("root") == F.col("main"))
    side = [F.struct("fp", "root", "size", "place")]
    long = rows.select("shingle", "inner", *[x.alias("l") for x in side])
    short = rows.filter("short").select("shingle", F.explode(F.when(F.col("inner"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("inner"), *[x.alias("s") for x in side])
    left = lambda x: F.col(f"{x}.size") - F.col(f"{x}.place") + 1
    met = (F.col("s.root") != F.col("l.root")) & (F.struct("s.size", "s.fp") < F.struct("l.size", "l.fp")) & (F.least(left("s"), left("l")) >= share * (F.col("s.size") + F.col("l.size")) - 1e-6)
    pairs = short.hint("merge").join(long.hint("merge"), ["shingle", "inner"]).filter(met)
    out = stored(_ordered(pairs.select("l.fp", "l.root", F.struct("s.fp", "s.root").alias("to")), "to"), "crowd-pairs")
    discard(nodes, each, often, places, main)
    return out


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    """fp, keys (those that other nodes have too), hub (how many members these have) and sketch of the nodes that may have near ones.

    A key of two nodes that cannot link is none: most keys that texts share by
    chance are such, and their number grows with the square of the texts.
    """
    every = nodes.select("fp", "strongest").filter("strongest is not null").mapInArrow(tidy(_keys), "fp bigint, keys array<bigint>").select("fp", F.explode("keys").alias("key"))
    # a row of a key is two numbers, and the window spills
    key = W.partitionBy("key")
    met = every.withColumn("n", F.count("*").over(key)).withColumn("a", F.max("fp").over(key)).withColumn("b", F.min("fp").over(key))
    members = stored(met.filter("n > 1"), "members")
    alike = _near(members.filter("n = 2").select("a", "b").distinct(), nodes, least)
    kept = members.filter("n > 2").union(members.filter("n = 2").join(small_side(alike), ["a", "b"], "left_semi").select(members.columns))
    keys = kept.groupBy("fp").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("hub"))
    out = stored(keys.join(nodes.drop("strongest").hint("merge"), "fp"), "candidates")
    discard(members, alike)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, fp (the node) and component_id of each row."""
    if least < SIMILARITY:
        raise ValueError(f"keys and bounds are made for similarities from {SIMILARITY} on")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = stored(source.mapInArrow(tidy(_fingerprints(words)), f"doc_id {kind}, fp bigint, sim0 bigint, sim1 bigint, size int, strongest binary"), "simhash")
    nodes = stored(rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in (*SKETCH, "strongest")]), "nodes")
    members = _candidates(nodes, least)
    every = source.select("text").mapInArrow(tidy(_shingles(words)), "fp bigint, shingles binary")

    def spelled(asked: DataFrame) -> DataFrame:
        distinct = every.join(small_side(asked), "fp", "left_semi").dropDuplicates(["fp"])
        return stored(distinct.mapInArrow(tidy(_sketches), "fp bigint, shingles binary, wide array<bigint>"), "sets")

    sets = spelled(members.select("fp"))

    def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        alike = _alike(pairs, sets)
        now = _compare(alike, sets, least)
        discard(alike)
        return now

    def joined(roots: DataFrame, pairs: DataFrame, now: DataFrame) -> DataFrame:
        """``roots`` after the components of ``pairs`` that are near are put together."""
        found = stored(pairs.join(now.filter("near"), ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
        discard(now)
        if found.isEmpty():
            return roots
        merged = components(found)
        kept = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        out = stored(kept.union(merged), "roots")
        discard(roots, found, merged)
        return out

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, F.col("fp") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "fp"))

    roots = nodes.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    tested, met = None, []
    for turn in (*range(SINGLE), "ball", "crowd"):
        trim_driver(docs.sparkSession)
        if turn == "ball":
            pairs = _ball_pairs(rooted(nodes))
            ball = _near(pairs.select("a", "b"), nodes, least)
            ends = ball.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
            more = spelled(stored(ends.join(members.select("fp"), "fp", "left_anti"), "asked"))
            all_sets, untested = sets.union(more), ball
        else:
            placed = rooted(members.hint("merge")).select("fp", "hub", *SKETCH, "root", F.explode("keys").alias("key"))
            pairs = stored(_partners(placed, turn, least), "partners") if turn != "crowd" else _crowd(placed, sets, least)
            all_sets, untested = sets, pairs.select("a", "b")
        fresh = stored(untested.join(tested, ["a", "b"], "left_anti") if tested else untested, "pairs")
        roots = joined(roots, pairs, near(fresh, all_sets))
        tested = tested.union(fresh) if tested else fresh
        met.append(fresh)
        discard(pairs)
    discard(ball, more)
    out = stored(least_ids(rows.select("doc_id", "fp"), roots), "near")
    discard(rows, nodes, members, sets, *met)
    trim_driver(docs.sparkSession)
    return out
