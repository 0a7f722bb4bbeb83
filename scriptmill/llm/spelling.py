"""Spelling variants: words one error apart, grouped under the most frequent form, by forward and backward automata.

An error is one inserted, deleted or replaced code point. With at most one error
a word keeps either its first or its second half, so it meets its near words
among those that begin with the first half, or end with the second. Words go to
groups by their halves, forward (F) and backward (B). A group's words make
a minimal acyclic automaton, in direction B that of the reversed words, whose states
know how many words lie beyond them: the sum along a word's path is its number
in order, under which its count is found. A word's half is walked exactly, and the
rest is completed with one error. What is found backward but has the first half too was
found forward already, and is not counted again.

A group of more than GROUP words is cut further: the part that may hold the error
is halved again, forward and backward, so its words go to smaller groups (FF,
FB, ...), until that part has a single code point. A task holds the automaton of
one block of whole groups at a time. A word sends at most four rows, and
a group returns one row a word: how many near words, and the best of them.

Roots come from pointer doubling along the forms. A form is ``factor`` times as
frequent, so chains are short: log(count) / log(factor) at most.

Rows: a null text has no words, a null doc_id counts as ``null``; repeated rows count
each; texts and words of any length are taken whole; of near words equally
frequent the smallest in code-point order is the form. Empty tables give no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import Columns, slices, stored, tidy
from scriptmill.sources.shared import discard

#: Words of a group; larger ones are cut. Words of an automaton, unless one group has more.
GROUP = BLOCK = 30_000
#: A part of at most so many code points is not halved again.
LEAST_PART = 1
# Fixed value: the runs that count as words, once A to Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"


def _words(ids: str, text: str, damage: int | None):
    run = re.compile(RUN)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts: Counter[str] = Counter()
            for i, t in zip(batch[ids].to_pylist(), batch[text].to_pylist(), strict=True):
                # bytes have A to Z lower-cased only
                found = Counter(run.findall(t.encode("utf-8").lower().decode("utf-8"))) if t else {}
                start = zlib.crc32(f"{i}:".encode())
                for word, n in found.items():
                    if damage and (h := zlib.crc32(word.encode("utf-8"), start)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return work


def counted(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word and n: the lower-cased runs of letters of all texts. With ``damage`` d a run whose crc32 with its doc_id is divisible by d loses a code point first."""
    cols = Columns(docs)
    rows = cols.rows.select(F.coalesce(F.col(cols["doc_id"]).cast("string"), F.lit("null")).alias("id"), F.col(cols["text"]).alias("text"))
    return rows.mapInArrow(tidy(_words("id", "text", damage)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words. ``edges`` of a state: by character, the next state and how many words come before those beyond it."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # the states along the last word, which may still get edges
        open_: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        for before, word in pairwise(["", *words, ""]):
            n = next((k for k, (x, y) in enumerate(zip(before, word, strict=False)) if x != y), min(len(before), len(word)))
            while len(open_) - 1 > n:
                state = self._closed(known, *open_.pop())
                open_[-1][1].append((before[len(open_) - 1], state))
            open_ += [(False, []) for _ in word[n:]]
            if word:
                open_[-1] = (True, open_[-1][1])
        self.root = self._closed(known, *open_.pop())

    def _closed(self, known: dict[tuple, int], final: bool, edges: list[tuple[str, int]]) -> int:
        """The state with these edges, which is made if there is none yet."""
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(self.edges)
            out, size = {}, int(final)
            for c, state in edges:
                out[c] = (state, size)
                size += self.size[state]
            self.edges.append(out)
            self.final.append(final)
            self.size.append(size)
        return known[key]

    def number(self, word: str, start: int = 0, state: int | None = None, number: int = 0) -> int:
        """The number of the word whose rest is word[start:], -1 if it has none."""
        state = self.root if state is None else state
        for c in word[start:] if start else word:
            edge = self.edges[state].get(c)
            if edge is None:
                return -1
            state, number = edge[0], number + edge[1]
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words one error from ``word`` whose error is not within its first ``exact`` code points."""
        state, at = self.root, 0
        for c in word[:exact]:
            edge = self.edges[state].get(c)
            if edge is None:
                return set()
            state, at = edge[0], at + edge[1]
        found, n = set(), len(word)
        for k in range(exact, n + 1):
            rest = word[k] if k < n else None
            for c, (to, skipped) in self.edges[state].items():
                # inserted before k, or in place of k
                found.add(self.number(word, k, to, at + skipped))
                if k < n and c != rest:
                    found.add(self.number(word, k + 1, to, at + skipped))
            if k < n:
                found.add(self.number(word, k + 1, state, at))
                edge = self.edges[state].get(rest)
                if edge is None:
                    break
                state, at = edge[0], at + edge[1]
        found.discard(-1)
        return found


def parts(length: int, path: str) -> tuple[int, int]:
    """How many code points at the front and at the end of a word of this length must be exact."""
    front = back = 0
    for way in path:
        half = (length - front - back) // 2
        if way == "F":
            front += half
        else:
            back = length - front - half
    return front, back


def first_way(word: str, other: str, path: str) -> bool:
    """Whether a near word is found on no path before this one: it goes forward wherever it can."""
    return all((other[: (n := parts(len(word), path[:k] + "F")[0])] == word[:n]) == (way == "F") for k, way in enumerate(path))


def keys(word: str, path: str) -> dict[str, bool]:
    """The groups of a word on a path, as what others of near lengths would ask for, and whether it asks there itself."""
    out: dict[str, bool] = {}
    for length in (len(word) - 1, len(word), len(word) + 1):
        front, back = parts(length, path)
        if front + back <= len(word):
            key = f"{path} {front} {back} {word[:front]} {word[len(word) - back :]}"
            out[key] = out.get(key, False) or length == len(word)
    return out


KEYED = "path string, key string, word string, n bigint, asks boolean"


def _keyed(paths: tuple[str, ...] | None):
    """Rows of words by the groups of these paths, or (None) of the two paths that go on from each row's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch["word"].to_pylist(), batch["n"].to_pylist()
            if paths is None:
                given = [((p + "F", p + "B"), a) for p, a in zip(batch["path"].to_pylist(), batch["asks"].to_pylist(), strict=True)]
            else:
                given = [(paths, True)] * len(words)
            out = [(p, k, w, n, asks and asking) for w, n, (ways, asking) in zip(words, counts, given, strict=True) for p in ways for k, asks in keys(w, p).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "key", "word", "n", "asks"])

    return work


def _answers(backward: bool, rows: list[tuple[str, str, str, int, bool]]) -> Iterator[tuple[str, int, int, str]]:
    """Of each asking row with near words its word, their number, and the count and word of the best."""
    turned = lambda w: w[::-1] if backward else w
    count = {turned(w): n for _, _, w, n, _ in rows}
    words = sorted(count)
    automaton = Automaton(words)
    for path, _, word, _, asks in rows:
        if asks:
            front, back = parts(len(word), path)
            found = [turned(words[k]) for k in automaton.near(turned(word), back if backward else front)]
            near = [(-count[turned(w)], w) for w in found if first_way(word, w, path)]
            if near:
                n, best = min(near)
                yield word, len(near), -n, best


def _search(block: int):
    """Near words, by blocks of whole groups of sorted rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(rows):
            out = list(_answers(rows[0][0].endswith("B"), rows))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("path", "key", "word", "n", "asks")], strict=True):
                if held and (row[0] != held[-1][0] or (len(held) >= block and row[1] != held[-1][1])):
                    yield from answered(held)
                    held = []
                held.append(row)
        if held:
            yield from answered(held)

    return work


def near_words(words: DataFrame, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n and best of the words (a stored table of distinct word and n) that have near ones."""
    rows, done = words.select("word", "n").mapInArrow(_keyed(("F", "B")), KEYED), []
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    while longest > LEAST_PART:
        large = stored(rows.groupBy("key").count().filter(F.col("count") > group).select("key"), "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti").select("path", "key", "word", "n", "asks"))
        # a word asks on in place of a large group in which it asked
        inside = rows.join(large, "key", "left_semi").groupBy("path", "word", "n").agg(F.max("asks").alias("asks"))
        rows = inside.mapInArrow(_keyed(None), KEYED)
        longest = (longest + 1) // 2
    for more in done:
        rows = rows.union(more)
    rows = rows.repartition("key").sortWithinPartitions("path", "key")
    found = rows.mapInArrow(tidy(_search(block)), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form (word, form): the last along the forms."""
    up = stored(forms.select("word", F.col("form").alias("root")), "up")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "up")
        moved = not longer.filter("moved").isEmpty()
        discard(up)
        up = longer.drop("moved")
        if not moved:
            return up


def variants(words: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words (distinct word and n) of at least that length and count; see above."""
    words = stored(words.filter((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    near = near_words(words, group, block)
    holds = F.col("best_n") >= F.lit(factor) * F.col("n")
    out = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")), "variants")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
