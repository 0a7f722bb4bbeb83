"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision, in each context of up to DEPTH
bytes before it, has a Krichevsky-Trofimov estimate, and the tree weighs the
estimates of all depths by how well they coded the corpus. A text ends with a
byte that no UTF-8 text holds, which also stands before its start.

No context is left out, however rare, so the tree grows with the corpus. It is
never in one place:

1. Tasks count grams of DEPTH + 1 bytes and words; Spark sums them. Grams of rows
   that are only scored take part with count 0.
2. Contexts that end in the same two bytes form a subtree, which depends on the
   rest of the tree by one number for each decision at its root. Subtrees are
   dealt into groups; each is weighted from its leaves up, and what the roots add
   up to for each last byte and decision, at most 256 * 255 rows, makes the top of
   the tree on the driver.
3. With the top's shares each group walks its subtrees down again and gives every
   gram its code length.
4. Texts add up the code lengths of their grams, found in a broadcast table of at
   most TABLE grams; a larger one is dealt into such parts, met one after the
   other, and the sums of a text are added.

The word score: words seen more than tokens / FREQUENT times (at most FREQUENT
of them) are broadcast; all other words meet their counts in a shuffle.

Rows: a null or empty text is its end alone; repeated rows each give a result of
their own; a null id counts as the empty string for the fold; without training
rows every count is 0; an empty table gives an empty one. Texts are lower-cased
(A-Z). Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import slices, stored, utf8

DEPTH, FREQUENT = 5, 1 << 20
#: Grams of a table that is broadcast, and of a group of subtrees.
TABLE, GROUP = 8 << 20, 400_000
#: Bytes of context that are the same in a subtree.
ROOT = 2
EDGE = 255
#: Bytes of text that a task counts, and scores, at a time.
COUNT_PIECE, SCORE_PIECE = 1 << 20, 512 << 10
#: Words, and grams, that a task holds before it sends them on.
HELD, HELD_GRAMS = 400_000, 1_500_000


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def sequence(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each with ``depth`` edges before and one behind, and where each one starts."""
    gap = bytes([EDGE]) * depth
    data = np.frombuffer(b"".join(gap + t + gap[:1] for t in texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + depth + 1 for t in texts)])
    return data, starts


def coded(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The places of bytes to code: all but the edges before texts."""
    mask = np.ones(len(data), bool)
    for k in range(depth):
        mask[starts[:-1] + k] = False
    return np.flatnonzero(mask)


def context(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before each place as one number, the nearest byte lowest."""
    out = np.zeros(len(at), np.int64)
    for k in range(depth, 0, -1):
        out = out << 8 | data[at - k]
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _counts(depth: int):
    names = ["word", "gram", "n"]

    def words_out(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names)

    def grams_out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(counts)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts, docs = [], 0
        for batch in slices(batches, "text", COUNT_PIECE):
            texts = [utf8(t).lower() for t in batch["text"].to_pylist()]
            learned = batch["learned"].to_pylist()
            for counted in (True, False):
                mine = [t for t, x in zip(texts, learned, strict=True) if x is counted]
                if counted:
                    docs += len(mine)
                    words.update(b"\n".join(mine).split())
                data, starts = sequence(mine, depth)
                at = coded(data, starts, depth)
                keys = np.sort(context(data, at, depth) << 8 | data[at])
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else at
                parts.append((keys[first], np.diff(np.append(first, len(keys))) * counted))
            if sum(len(k) for k, _ in parts) > HELD_GRAMS:
                parts = [_merge(parts)]
                if len(parts[0][0]) > HELD_GRAMS // 2:
                    yield grams_out(*parts.pop())
            if len(words) > HELD:
                yield words_out(words)
                words = Counter()
        if sum(len(k) for k, _ in parts):
            yield grams_out(*_merge(parts))
        yield words_out(words)
        yield grams_out(np.array([-1]), np.array([docs]))  # ends, as tokens

    return work


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: by the series from x + 8 on."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Places:
    """Where a key stands in a sorted array, by hash tables: keys that lose their slot go on to the next table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables, left = keys, [], np.arange(len(keys))
        while len(left):
            bits = max(4, int(2 * len(left)).bit_length())
            table = np.zeros(1 << bits, np.int32)
            slots = self._slots(keys[left], bits, len(self.tables))
            table[slots] = left
            self.tables.append((bits, table))
            left = left[table[slots] != left]

    @staticmethod
    def _slots(keys: np.ndarray, bits: int, turn: int) -> np.ndarray:
        factor = np.uint64(pow(0x9E3779B97F4A7C15, 2 * turn + 1, 1 << 64))
        return (keys.view(np.uint64) * factor) >> np.uint64(64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for turn, (bits, table) in enumerate(self.tables):
            asked = keys if not turn else keys[left]
            at = table[self._slots(asked, bits, turn)]
            hit = self.keys[at] == asked
            out[left[hit]] = at[hit]
            if turn + 1 < len(self.tables):
                left = left[~hit]
        return out


class Subtrees:
    """The levels of the tree from ROOT bytes of context down, over given grams; only decisions that the grams have are there."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int) -> None:
        byte, k = (grams & 255)[:, None], np.arange(8)
        self.bits = byte >> (7 - k) & 1
        nodes = (1 << k) + (byte >> (8 - k))  # in heap order
        keys, self.leaf = np.unique((grams >> 8 << 8)[:, None] | nodes, return_inverse=True)
        self.leaf = self.leaf.reshape(len(grams), 8)
        zeros, ones = (np.bincount(self.leaf.ravel(), (counts[:, None] * (self.bits == bit)).ravel(), len(keys)) for bit in (0, 1))
        #: For each depth, from the leaves up: keys, zeros, ones, weighted, share, and the place of each key's parent.
        self.levels, children = [], None
        for d in range(depth, ROOT - 1, -1):
            kt = log_kt(zeros, ones)
            weighted, share = (kt, np.ones_like(kt)) if children is None else weigh(kt, children)
            above, parent = np.unique((keys >> 8 & ((1 << 8 * (d - 1)) - 1)) << 8 | (keys & 255), return_inverse=True)
            self.levels.append((keys, zeros, ones, weighted, share, parent))
            zeros, ones, children = (np.bincount(parent, x, len(above)) for x in (zeros, ones, weighted))
            keys = above
        #: What the roots add up to: keys of ROOT - 1 bytes, zeros, ones and the sums of the weighted probabilities' logs.
        self.top = keys, zeros, ones, children

    def code_lengths(self, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of each gram's last byte, from the shares of the levels above for each key of ``top``."""
        for _, zeros, ones, _, share, parent in reversed(self.levels):
            done, left = walk(done[parent], left[parent], zeros, ones, share)
        p = np.clip(done[self.leaf], 1e-300, 1.0)
        return np.log10(np.where(self.bits == 1, p, 1 - p)).sum(axis=1)


def weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the weighted probability, and the share in it of the node's own estimate."""
    weighted = math.log(0.5) + np.logaddexp(kt, children)
    return weighted, np.exp(math.log(0.5) + kt - weighted)


def walk(done, left, zeros: np.ndarray, ones: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: the probability of a one so far, and the weight that is left."""
    return done + left * share * (ones + 0.5) / (zeros + ones + 1.0), left * (1 - share)


class Top:
    """The levels above the subtrees: for each last byte and decision the probability so far and the weight left."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, zeros, ones, children = keys[order], zeros[order], ones[order], children[order]
        weighted, share = weigh(log_kt(zeros, ones), children)
        node, at = np.unique(self.keys & 255, return_inverse=True)
        z, o, below = (np.bincount(at, x, len(node)) for x in (zeros, ones, weighted))
        root = walk(np.zeros(len(node)), np.ones(len(node)), z, o, weigh(log_kt(z, o), below)[1])
        self.done, self.left = walk(root[0][at], root[1][at], zeros, ones, share)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.done[at], self.left[at]


def _roots(depth: int):
    def work(table: pa.Table) -> pa.Table:
        keys, *sums = Subtrees(table["gram"].to_numpy(), table["n"].to_numpy(), depth).top
        return pa.table([pa.array(keys), *(pa.array(x.astype(np.float64)) for x in sums)], ["key", "zeros", "ones", "children"])

    return work


def _lengths(sent, depth: int):
    def work(table: pa.Table) -> pa.Table:
        grams = table["gram"].to_numpy()
        subtrees = Subtrees(grams, table["n"].to_numpy(), depth)
        return pa.table([pa.array(grams), pa.array(subtrees.code_lengths(*sent.value.of(subtrees.top[0])).astype(np.float32))], ["gram", "log"])

    return work


def code_lengths(grams: DataFrame, depth: int) -> DataFrame:
    """gram and log (log10 of the probability of its last byte after the others) of grams with their counts n, as a stored table."""
    total = grams.count()
    groups = max(1, -(-total // GROUP))
    dealt = grams.withColumn("group", F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * ROOT) - 1))), F.lit(groups)))
    tops = dealt.groupBy("group").applyInArrow(_roots(depth), "key bigint, zeros double, ones double, children double")
    tops = tops.groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("children")).toArrow()  # at most 256 * 255 rows
    top = grams.sparkSession.sparkContext.broadcast(Top(*(c.to_numpy() for c in tops.columns)))
    return stored(dealt.groupBy("group").applyInArrow(_lengths(top, depth), "gram bigint, log float"), "lengths")


class Table:
    """The code lengths of grams; picklable."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, depth: int, part: int, parts: int) -> None:
        self.places, self.logs, self.depth, self.part, self.parts = Places(grams), logs, depth, part, parts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """For each text with its end the sum over its grams in this part."""
        data, starts = sequence(texts, self.depth)
        at = coded(data, starts, self.depth)
        grams = context(data, at, self.depth) << 8 | data[at]
        place = self.places.find(grams)
        found = place >= 0
        if not found.all() and (self.parts == 1 or (part_of(grams[~found], self.parts) == self.part).any()):
            raise ValueError("a text has grams that the model was not asked for: give these rows to fit() too")
        value = np.where(found, self.logs[place], 0.0).astype(np.float64)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        return np.add.reduceat(value, first) if len(texts) else np.empty(0)


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (grams ^ grams >> 13 ^ grams >> 26) % parts


class Model:
    """Words that are broadcast, sums, and the tables of code lengths and of rarer words, which stay in the shared folder."""

    def __init__(self, lengths: DataFrame, depth: int, frequent: dict[bytes, int], rare: DataFrame, tokens: int, distinct: int, end: int) -> None:
        self.lengths, self.depth, self.frequent, self.rare = lengths, depth, frequent, rare
        self.tokens, self.distinct, self.end = tokens, distinct, end

    def tables(self, most: int) -> Iterator:
        """The table, or its parts one by one, as broadcasts."""
        parts = max(1, -(-self.lengths.count() // most))
        for part in range(parts):
            # as part_of does it
            mine = F.pmod(F.col("gram").bitwiseXOR(F.shiftright("gram", 13)).bitwiseXOR(F.shiftright("gram", 26)), F.lit(parts)) == part
            rows = (self.lengths.filter(mine) if parts > 1 else self.lengths).toArrow().sort_by("gram")
            yield self.lengths.sparkSession.sparkContext.broadcast(Table(rows["gram"].to_numpy(), rows["log"].to_numpy(), self.depth, part, parts))


def fit(docs: DataFrame, learned: Column | None = None, text: str = "text", depth: int = DEPTH, frequent: int = FREQUENT) -> Model:
    """Learns from the rows where ``learned`` holds (all by default), and readies code lengths for the texts of all rows."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.lit(True) if learned is None else learned, F.lit(False)).alias("learned"))
    counts = rows.mapInArrow(_counts(depth), "word binary, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    words = counts.filter("word is not null").select("word", F.col("n").alias("c"))
    sums = counts.agg(F.sum(F.expr("if(word is not null, n, 0)")), F.count("word"), F.sum(F.expr("if(gram = -1, n, 0)"))).first()
    in_words, distinct, ends = (x or 0 for x in sums)
    lengths = code_lengths(counts.filter("gram >= 0").select("gram", "n"), depth)
    tokens = in_words + ends
    common = words.filter(F.col("c") > F.lit(tokens / frequent)).toArrow()
    known = dict(zip(common["word"].to_pylist(), common["c"].to_pylist(), strict=True))
    return Model(lengths, depth, known, words.filter(F.col("c") <= F.lit(tokens / frequent)), tokens, distinct + (ends > 0), ends)


WORDS = "n_tokens bigint, known bigint, logs double, n_bytes bigint, rare array<binary>"
SCORED = f"doc_id bigint, held_out boolean, {WORDS}, score double"


def _words(frequent, end_count: int):
    """Counts, sums and rare words of texts."""
    logs = {w: math.log10(c + 1) for w, c in frequent.value.items()}
    end = math.log10(end_count + 1)

    def columns(texts: list[bytes]) -> list[pa.Array]:
        n, known, sums, rare = [], [], [], []
        for t in texts:
            words = t.split()
            found = [logs.get(w) for w in words]
            unseen = [w for w, x in zip(words, found, strict=True) if x is None] if None in found else []
            n.append(len(words) + 1)
            known.append(len(words) - len(unseen) + (end_count > 0))
            sums.append(math.fsum(x for x in found if x is not None) + end)
            rare.append(unseen)
        return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(rare, pa.list_(pa.binary()))]

    return columns


def _scored(sent, frequent, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _words(frequent, end)
        for batch in slices(batches, "text", SCORE_PIECE):
            texts = [utf8(t).lower() for t in batch["text"].to_pylist()]
            cols = [batch["doc_id"], batch["held_out"], *columns(texts), pa.array(sent.value.scores(texts), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORED.split(", ")])

    return work


def _added(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCORE_PIECE):
            found = sent.value.scores([utf8(t).lower() for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.float64())], ["row", "more"])

    return work


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (with the end as a byte) of each row; the rows must be among those that fit() has seen."""
    frequent = docs.sparkSession.sparkContext.broadcast(model.frequent)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    first, *others = model.tables(table)
    if others:
        # the same rows for every part
        source = stored(source.withColumn("row", F.monotonically_increasing_id()), "texts")
        parts = [source.mapInArrow(_added(part), "row bigint, more double") for part in others]
        more = parts[0]
        for part in parts[1:]:
            more = more.unionByName(part)
        more = more.groupBy("row").agg(F.sum("more").alias("more"))
        names = ["doc_id", "held_out", "row"]
        keyed = source.withColumns({"doc_id": F.col("row"), "id": F.col("doc_id")})
        rows = keyed.mapInArrow(_scored(first, frequent, model.end), SCORED).withColumnRenamed("doc_id", "row").drop("held_out")
        rows = rows.join(source.select(*names), "row").join(more, "row").withColumn("score", F.col("score") + F.col("more")).drop("more")
        rows = stored(rows, "scores")
    else:
        rows = stored(source.mapInArrow(_scored(first, frequent, model.end), SCORED).withColumn("row", F.monotonically_increasing_id()), "scores")
    met = rows.select("row", F.explode("rare").alias("word")).join(model.rare, "word")
    met = met.groupBy("row").agg(F.count("*").alias("_n"), F.sum(F.log10(F.col("c") + 1)).alias("_logs"))
    every = math.log10(model.tokens + model.distinct + 1)
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "n_bytes").join(met, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_n", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        "score",
        (F.col("score") * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
