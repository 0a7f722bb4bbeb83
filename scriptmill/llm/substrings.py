"""Substring dedup: passages of ``window`` words that stand earlier in the corpus, found by prefix-partitioned suffix trees.

Suffixes start at every word. Only their first ``window`` words matter: two
suffixes meet in an internal node that deep exactly if those words repeat.

1. *Anchors.* Each suffix names its anchor, the gram of ANCHOR words with the
   least hash in its window. Equal windows have equal anchors at equal places, so
   an anchor that stands nowhere else gives no suffix to any tree. A run of
   suffixes with one anchor makes a passage, which is sent as words, once.
2. *Prefixes.* Passages are dealt by their anchor, the prefix of the anchored
   suffix: all suffixes that may share a deep node meet. An anchor whose suffixes
   would make more than GROUP is split by the longest prefix there is, the whole
   window: those groups have one leaf each, and need the earliest suffix only.
3. *Subtrees.* In a group, passages that are equal are one. Its words are numbered
   in their order, and prefix doubling over these numbers sorts all suffixes;
   equal names at depth ``window`` are a deep internal node, whose earliest suffix
   stays and whose others are marked. Runs of marked suffixes are the maximal
   repeats.

Words are compared, not hashes: a hash only chooses anchors and groups, where a
collision brings more suffixes together and changes no result. Two things rest on
SHA-256: whole copies of a text (its first 128 bits) and windows of anchors above
GROUP (all 256).

Earlier means a smaller id, or the same document and an earlier start. Rows: a
null or empty text has no words; documents shorter than a window lose nothing;
of equal texts all but the one with the smallest id lose every word, if they are
a window long; rows that repeat id and text are one document; a null id comes
after all others; an empty table gives an empty one. Other columns are not read,
so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import group_min, salt, salts_of, slices, stored, utf8

WINDOW, ANCHOR = 20, 4
#: Suffixes in a group.
GROUP = 200_000
#: Bytes of text that a task works on at a time.
PIECE = 256 << 10
#: Bytes of passages that a task gathers, and of which it settles the equal ones, before it sends them on.
HELD = 8 << 20
#: Least bytes of a word with its blank, on average, for the number of groups.
WORD_BYTES = 4
LAST = (1 << 63) - 1
U = np.uint64
BYTE, GRAM = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: For each base its powers from 0 on, as many as were asked for.
POWERS: dict[int, np.ndarray] = {}


def raised(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(n + n // 8 + 1024, base, U)
        known[0] = 1
        known = POWERS[int(base)] = np.multiply.accumulate(known)
    return known[:n]


@cache
def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of values[start:end] for each span, by differences of one running sum."""
    total = np.concatenate([[U(0)], np.cumsum(values * raised(base, len(values)), dtype=U)])
    return mix((total[ends] - total[starts]) * raised(inverse(base), len(values) + 1)[starts] + (ends - starts).astype(U))


class Words:
    """The words of several texts: a hash of each, and where each text's words begin."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = SPACE[data]
        inside = np.diff(np.concatenate([[False], ~blank]).astype(np.int8))
        starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, borders)
        self.hashes = spans_hash(data.astype(U) + U(1), starts, ends, BYTE)
        self.counts = np.diff(self.first)

    def grams(self, n: int, base: np.uint64) -> np.ndarray:
        """A hash of the ``n`` words from each word on, over the borders of texts too."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        return spans_hash(self.hashes, at, at + n, base)


def anchors_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start of the first window, number of windows, anchor) of each run of windows with the same anchor."""
    hashes, wide = words.grams(gram, GRAM), window - gram + 1
    out = []
    for k in np.flatnonzero(words.counts >= window):
        a, n = words.first[k], words.counts[k]
        part = hashes[a : a + n - gram + 1]
        least = np.lib.stride_tricks.sliding_window_view(part, wide).argmin(axis=1) + np.arange(n - window + 1)
        begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        out.append((np.full(len(begin), k), begin, np.diff(np.append(begin, len(least))), part[least[begin]]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchors(window: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            # of equal texts at hand the one with the smallest id is enough
            ids, th1, th2 = (batch[c].to_numpy() for c in ("id", "th1", "th2"))
            order = np.lexsort((ids, th2, th1))
            fresh = np.append(True, (th1[order][1:] != th1[order][:-1]) | (th2[order][1:] != th2[order][:-1]))
            lead = np.sort(order[fresh])
            texts = batch["text"].take(pa.array(lead)).to_pylist()
            text, start, n, anchor = anchors_of(Words([utf8(t) for t in texts]), window, gram)
            if not len(text):
                continue
            order = np.lexsort((anchor, text))
            t, a = text[order], anchor[order]
            same = np.append((t[1:] == t[:-1]) & (a[1:] == a[:-1]), False)
            again = same | np.append(False, same[:-1])
            doc = pa.array(lead[t])
            cols = [_signed(a), *(batch[c].take(doc) for c in ("th1", "th2", "id")), pa.array(start[order].astype(np.int32)), pa.array(n[order].astype(np.int32)), pa.array(again.astype(np.int8))]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "th1", "th2", "id", "start", "n", "again"])

    return work


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[tuple[int, int, int], list[bytes], list[dict]]]:
    """(id, t1, t2), the words and the runs of each document."""
    for batch in slices(batches, "text", PIECE):
        for *doc, text, runs in zip(*(batch[c].to_pylist() for c in ("id", "t1", "t2", "text", "runs")), strict=True):
            yield tuple(doc), utf8(text).split(), runs


PASSAGES = "group int, body binary, id bigint, t1 bigint, t2 bigint, start int, n int"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [x for x, _ in fields])


def _settled(held: dict, spread) -> Iterator[tuple]:
    """Of equal passages (or windows) at hand the earliest with its body; the others, which are late, without one, dealt by ``spread``."""
    for (group, body), places in held.items():
        (id_, *_), start, _ = least = min(places, key=lambda x: (x[0][0], x[1]))
        for place in set(places):
            doc, at, n = place
            early = place == least or (doc[0] == id_ and at == start)
            yield (group, body, *doc, at, n) if early else (spread(doc[0]), None, *doc, at, n)


def _passages(window: int, groups: int):
    """A passage for each run, in the group of its anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, spread = 0, lambda id_: hash(id_) % groups
        for doc, words, runs in _cut(batches, window):
            for run in runs:
                start, n = run["start"], run["n"]
                body = b" ".join(words[start : start + n + window - 1])
                held.setdefault((run["group"], body), []).append((doc, start, n))
                size += len(body)
            if size > HELD:
                yield _batch(list(_settled(held, spread)), PASSAGES)
                held, size = {}, 0
        if held:
            yield _batch(list(_settled(held, spread)), PASSAGES)

    return work


LEAVES = "body binary, id bigint, t1 bigint, t2 bigint, start int, n int"


def _leaves(window: int):
    """Single windows, known by SHA-256, for anchors with too many suffixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for doc, words, runs in _cut(batches, window):
            for run in runs:
                for start in range(run["start"], run["start"] + run["n"]):
                    body = hashlib.sha256(b" ".join(words[start : start + window])).digest()
                    held.setdefault((0, body), []).append((doc, start, 1))
                    size += 100
            if size > HELD:
                yield _batch([x[1:] for x in _settled(held, lambda id_: 0)], LEAVES)
                held, size = {}, 0
        if held:
            yield _batch([x[1:] for x in _settled(held, lambda id_: 0)], LEAVES)

    return work


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The rank of each pair among all pairs."""
    return np.unique(first << 32 | second, return_inverse=True)[1]


def suffix_ranks(names: np.ndarray, window: int) -> np.ndarray:
    """The rank of each suffix by its first ``window`` names, by prefix doubling; suffixes that are shorter have none."""
    span, rank = 1, names
    while 2 * span <= window:
        rank = _named(rank[:-span], rank[span:])
        span *= 2
    rest = window - span
    return _named(rank[:-rest], rank[rest:]) if rest else rank


def deep_nodes(rank: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which suffixes are below a deep node (of equal rank) and not its earliest."""
    order = np.lexsort((starts, ids, rank))
    r, i, s = rank[order], ids[order], starts[order]
    lead = np.maximum.accumulate(np.where(np.append(False, r[1:] == r[:-1]), 0, np.arange(len(r))))
    out = np.empty(len(r), bool)
    out[order] = (i != i[lead]) | (s != s[lead])
    return out


def _runs(late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end."""
    step = np.diff(np.concatenate([[0], late.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


MARKED = "id bigint, t1 bigint, t2 bigint, start int, n int"
PLACE = ["id", "t1", "t2", "start", "n"]


def _subtree(window: int):
    def work(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table["body"])).select(PLACE)
        rows = table.filter(pc.is_valid(table["body"])).select(["body", *PLACE]).sort_by([("id", "ascending"), ("start", "ascending")])
        if not len(rows):
            return known
        ids, starts, counts = (rows[c].to_numpy() for c in ("id", "start", "n"))
        first: dict[bytes, int] = {}
        lead = np.array([first.setdefault(b, k) for k, b in enumerate(rows["body"].to_pylist())])
        copy = (ids != ids[lead]) | (starts != starts[lead])  # an equal passage stands earlier
        bodies = rows["body"].filter(pa.array(~copy)).to_pylist()
        own = np.flatnonzero(~copy)
        words = b" ".join(bodies).split()
        number = {w: k for k, w in enumerate(sorted(set(words)))}
        rank = suffix_ranks(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), window)
        n = counts[own].astype(np.int64)
        begin = np.cumsum(n + window - 1) - (n + window - 1)
        passage = np.repeat(np.arange(len(own)), n)
        offset = np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n)
        late = deep_nodes(rank[begin[passage] + offset], ids[own][passage], starts[own][passage] + offset)
        # a False between passages keeps their runs apart
        apart = np.zeros(len(late) + len(own), bool)
        apart[np.arange(len(late)) + passage] = late
        lo, hi = _runs(apart)
        at = lo - np.searchsorted(np.cumsum(n + 1), lo, side="right")
        found = rows.select(PLACE).take(pa.array(own[passage[at]]))
        found = found.set_column(3, "start", pa.array((starts[own][passage[at]] + offset[at]).astype(np.int32))).set_column(4, "n", pa.array((hi - lo).astype(np.int32)))
        return pa.concat_tables([known, rows.select(PLACE).filter(pa.array(copy)), found])

    return work


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, id (the greatest number for null), and th1 and th2, the first 128 bits of the text's SHA-256."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    half = lambda k: F.conv(F.substring(F.sha2("text", 256), k, 16), 16, -10).cast("bigint")
    return rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("th1", half(1)).withColumn("th2", half(17))


ON = ["id", "t1", "t2"]


def marks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, text, is_copy (an equal text has a smaller id) and late (runs, by start and n, of windows that stand earlier; not given for copies)."""
    gram = min(ANCHOR, window)
    rows = rows_of(docs, doc_id, text)
    sized = rows.select("id", F.struct("th1", "th2").alias("th"), F.octet_length("text").alias("size"))
    copies = group_min(sized, "th", "id", "rep").select("id", "th.th1", "th.th2", "size", (F.col("id") > F.col("rep")).alias("is_copy"))
    copies = stored(copies.distinct(), "copies")
    # ids tell documents apart, unless an id has several texts; then their digests help
    unique = copies.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    tell = lambda df: df.withColumns({t: F.lit(0).cast("bigint") if unique else F.col(f"th{t[1]}") for t in ("t1", "t2")})
    total = copies.filter("not is_copy").agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // (WORD_BYTES * group)))

    anchors = tell(rows.select("th1", "th2", "id", "text").mapInArrow(_anchors(window, gram), "anchor bigint, th1 bigint, th2 bigint, id bigint, start int, n int, again tinyint"))
    anchors = anchors.withColumn("_salt", salt("id"))
    ends = [f(t).alias(f"{name}{t}") for t in ("th1", "th2") for f, name in ((F.min, "lo_"), (F.max, "hi_"))]
    shared = anchors.groupBy("anchor").agg(*ends, F.max("again").alias("again"), F.sum("n").alias("total"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask"))
    shared = shared.filter("lo_th1 <> hi_th1 or lo_th2 <> hi_th2 or again = 1")
    shared = shared.select("anchor", (F.col("total") > group).alias("large"), F.explode(salts_of("_mask")).alias("_salt"))
    runs = anchors.select("anchor", "_salt", *ON, "start", "n").join(shared, ["anchor", "_salt"])
    run = F.struct("start", "n", F.pmod("anchor", F.lit(groups)).cast("int").alias("group"))
    mine = runs.groupBy(*ON).agg(F.collect_set(F.when(~F.col("large"), run)).alias("small"), F.collect_set(F.when(F.col("large"), run)).alias("large"))
    mine = stored(tell(copies.filter("not is_copy")).select(*ON).join(mine, ON), "runs")

    # the texts' exchange is one and the same in all joins
    texts = tell(rows).select(*ON, "text")
    of = lambda kind: texts.join(mine.filter(F.size(kind) > 0).select(*ON, F.col(kind).alias("runs")).hint("merge"), ON).select(*ON, "text", "runs")
    late = of("small").mapInArrow(_passages(window, groups), PASSAGES).groupBy("group").applyInArrow(_subtree(window), MARKED)
    if not mine.filter(F.size("large") > 0).isEmpty():
        leaves = stored(of("large").mapInArrow(_leaves(window), LEAVES), "leaves").withColumn("at", F.struct("id", "start"))
        later = group_min(leaves.filter("body is not null"), "body", "at", "first").filter("at <> first")
        late = late.unionByName(later.select(*ON, "start", "n")).unionByName(leaves.filter("body is null").select(*ON, "start", "n"))
    late = late.groupBy(*ON).agg(F.collect_set(F.struct("start", "n")).alias("late"))
    known = tell(copies).select(*ON, "is_copy").join(late, ON, "left")
    return texts.join(known.hint("merge"), ON).select(F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), "text", "is_copy", "late")


def removed(n: int, late, is_copy: bool, window: int) -> np.ndarray:
    """Which of ``n`` words are covered by the windows."""
    out = np.zeros(n + 1, np.int32)
    if is_copy and n >= window:
        out[0] = 1
    elif late:
        start, count = (np.array([x[c] for x in late]) for c in ("start", "n"))
        np.add.at(out, start, 1)
        np.add.at(out, start + count + window - 1, -1)
    return np.cumsum(out[:-1]) > 0


def _kept(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, copy, late in zip(batch["text"].to_pylist(), batch["is_copy"].to_pylist(), batch["late"].to_pylist(), strict=True):
                words = utf8(text).split()
                gone, n = 0, len(words)
                if copy or late:
                    mask = removed(n, late, copy, window)
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                out.append((n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
            n, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return work


def _digested(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _kept(window)(batches):
            shas = [hashlib.sha256(utf8(t)).hexdigest() for t in batch["kept"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return work


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by spaces) of each row."""
    return marks(docs, doc_id, text, window, group).mapInArrow(_kept(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """As :func:`dedup`, with kept_sha256 in place of kept."""
    return marks(docs, doc_id, text, window, group).mapInArrow(_digested(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
