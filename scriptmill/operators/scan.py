"""Folds over sessions of any length, spread over many tasks: a prefix scan over segments.

The state of a fold is one of finitely many, so a segment of a session is a function
from the state before it to the state after it. A first pass works out the
functions of the segments of long sessions, each by itself: it follows all
states at once, and as soon as two meet they are followed as one, so that
after some words little more than one is left. A second puts the functions of a
session together in order, which gives every segment its state to begin with. Then each
segment is folded from there. A segment has at most ``segment`` positions; no session
is gathered, and sessions of one segment take the last pass only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from scriptmill.sources.shared import small_side, stored

#: Positions of a session that one task folds.
SEGMENT = 1 << 18


class Machine(Protocol):
    """A fold with finitely many states, which are hashable."""

    columns: tuple[str, ...]
    start: object

    def states(self) -> list: ...
    def symbols(self, batch: pa.RecordBatch) -> list: ...
    def step(self, state, symbol): ...
    def dump(self, state) -> str: ...
    def load(self, text: str): ...


def values(column: pa.Array) -> list:
    """As ``to_pylist``, without its object for each value, where that gives the same."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_boolean(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _changes(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether its value differs from the one before; nulls are equal."""
    if pa.types.is_nested(column.type):
        listed = column.to_pylist()
        return np.array([x != y for x, y in pairwise(listed)], bool)
    out = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        out = out | (gone[1:] != gone[:-1])
    return out


def runs(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, int, int]]:
    """The stretches of equal values: value, first row and the row after the last."""
    if not batch.num_rows:
        return
    changed = np.logical_or.reduce([_changes(batch[c]) for c in columns])
    start = 0
    for end in [*(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]:
        yield tuple(batch[c][start].as_py() for c in columns), start, end
        start = end


class Function:
    """From each of some states to the state after the symbols so far."""

    def __init__(self, machine: Machine, states: list) -> None:
        self.machine, self.live, self.of = machine, states, np.arange(len(states), dtype=np.uint16)

    def follow(self, symbols: list) -> None:
        step, at = self.machine.step, 0
        while len(self.live) > 1 and at < len(symbols):
            moved = [step(state, symbols[at]) for state in self.live]
            place = {state: k for k, state in enumerate(dict.fromkeys(moved))}
            if len(place) < len(moved):
                self.of = np.array([place[s] for s in moved], np.uint16)[self.of]
                moved = list(place)
            self.live, at = moved, at + 1
        if at < len(symbols):
            (state,) = self.live
            for symbol in symbols[at:]:
                state = step(state, symbol)
            self.live = [state]


def _functions(machine: Machine, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, function = None, None

        def row():
            of = b"" if len(function.live) == 1 else function.of.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*last, [machine.dump(s) for s in function.live], of), schema.types, strict=True)], schema.names)

        for batch in batches:
            symbols = machine.symbols(batch)
            for key, start, end in runs(batch, "session", "segment"):
                if function is None or key != last:
                    if function is not None:
                        yield row()
                    last, function = key, Function(machine, [machine.start] if key[1] == 0 else machine.states())
                function.follow(symbols[start:end])
        if function is not None:
            yield row()

    return work


def _entries(machine: Machine, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, session, state = {s: k for k, s in enumerate(machine.states())}, object(), machine.start
        for batch in batches:
            out = []
            for key, segment, exits, of in zip(*[batch[c].to_pylist() for c in ("session", "segment", "exits", "of")], strict=True):
                if key != session:
                    session, state = key, machine.start
                out.append((key, segment, machine.dump(state)))
                state = machine.load(exits[np.frombuffer(of, np.uint16)[place[state]] if of else 0])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema.names)

    return work


def longest(words: DataFrame, pos: str = "pos") -> int:
    """The last position of any session."""
    return words.agg(F.max(pos)).first()[0] or 0


def segmented(rows: DataFrame, machine: Machine, segment: int = SEGMENT, last: int | None = None) -> DataFrame:
    """``rows`` (session, pos from 0, and the machine's columns) with segment and entry, the state before it (null: the start), in order by segment within tasks.

    ``last``: the last position of any session, if it is known (``longest``). Else the rows are stored to find it.
    """
    if last is None or last >= segment:
        rows = stored(rows, "folded")
        last = longest(rows)
    if last < segment:
        return rows.select("*", F.lit(0).cast("bigint").alias("segment"), F.lit(None).cast("string").alias("entry")).repartition("session").sortWithinPartitions("session", "pos")
    rows = rows.withColumn("segment", F.floor(F.col("pos") / segment))
    long = stored(rows.filter("segment > 0").select("session").distinct(), "long-sessions")
    key = rows.schema["session"]
    asked = rows.join(small_side(long), "session", "left_semi").select("session", "pos", "segment", *machine.columns)
    asked = asked.repartition("session", "segment").sortWithinPartitions("session", "segment", "pos")
    own = StructType([key, StructField("segment", LongType())])
    shape = StructType([*own, StructField("exits", ArrayType(StringType())), StructField("of", BinaryType())])
    functions = stored(asked.mapInArrow(_functions(machine, to_arrow_schema(shape)), shape), "segment-functions")
    shape = StructType([*own, StructField("entry", StringType())])
    entries = functions.repartition("session").sortWithinPartitions("session", "segment").mapInArrow(_entries(machine, to_arrow_schema(shape)), shape)
    rows = rows.join(small_side(stored(entries, "entries")), ["session", "segment"], "left")
    return rows.repartition("session", "segment").sortWithinPartitions("session", "segment", "pos")
