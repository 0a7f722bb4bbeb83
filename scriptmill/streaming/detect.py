"""The folds as streams: state per session, events in any order.

Events of a session may come out of order within and between batches. Each waits
in the session's state until all before it are there, and then takes its turn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptmill.functions.tokens import is_terminal_app
from scriptmill.operators.detector import EN, Detector, Features
from scriptmill.operators.fold import ASSISTS, RESULT, assists
from scriptmill.operators.replay import EMITTED, Keyboard, lexicon_set, looker


def _values(column: pd.Series) -> list:
    """The values of a column, None where there is none."""
    out, gone = column.tolist(), column.isna().to_numpy()
    return [None if x else v for v, x in zip(out, gone, strict=True)] if gone.any() else out


class InOrder(StatefulProcessor):
    """Hands over the rows of a key by position, gapless from 0, whatever order they come in.

    With ``patience``, in seconds, a gap that stands so long with rows waiting
    behind it is given up: the first row after it says in ``skipped`` how many
    positions that were. Without, rows wait for it.
    """

    position_column: str
    columns: list[str]
    result: str
    #: Whether only events whose step gives text first have rows.
    texts_only: bool = False

    def __init__(self, default: str = EN, patience: float | None = None) -> None:
        self.default, self.patience = default, patience

    def load(self, text: str | None):
        """A session's state from its dump, or a fresh one."""
        raise NotImplementedError

    def step(self, state, row: list) -> tuple:
        """Changes the state by a row and gives the rest of the output row."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "position bigint, text string")
        self.waiting = handle.getMapState("waiting", "position bigint", "row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list] = {}
        for frame in rows:
            at, *cols = (_values(frame[c]) for c in (self.position_column, *self.columns))
            fresh.update(zip(map(int, at), map(list, zip(*cols, strict=True)), strict=True))
        yield from self._advance(key, fresh, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, {}, timerValues, True)

    def _next(self, position: int, fresh: dict[int, list], held: bool) -> list | None:
        row = fresh.pop(position, None)
        if held and self.waiting.containsKey((position,)):
            row = row or json.loads(self.waiting.getValue((position,))[0])
            self.waiting.removeKey((position,))
        return row

    def _advance(self, key, fresh: dict[int, list], timer_values, give_up: bool) -> Iterator[pd.DataFrame]:
        position, text = self.state.get() if self.state.exists() else (0, None)
        state, out, skipped, start = self.load(text), [], 0, position
        held = self.waiting.exists()  # asked once, as every question goes to the state store and back
        if give_up and held:
            first = min(at for (at,) in self.waiting.keys())
            skipped, position = first - position, first
        while (row := self._next(position, fresh, held)) is not None:
            given = self.step(state, row)
            if not self.texts_only or given[0] or skipped:
                out.append((key[0], position, *given, *([skipped] if self.patience is not None else [])))
            position, skipped = position + 1, 0
        for at, row in fresh.items():
            if at > position:  # one before it has passed already
                self.waiting.updateValue((at,), (json.dumps(row),))
        if position != start:
            self.state.update((position, state.dump()))
        if self.patience is not None:
            self._wind(timer_values, position != start)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in self.result.split(", ")] + ["skipped"] * (self.patience is not None))

    def _wind(self, timer_values, moved: bool) -> None:
        """A timer stands while rows wait; progress sets it anew."""
        timers, held = list(self.handle.listTimers()), any(True for _ in self.waiting.keys())
        if timers and (moved or not held):
            for at in timers:
                self.handle.deleteTimer(at)
            timers = []
        if held and not timers:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + int(self.patience * 1000))

    def close(self) -> None:
        pass


class SessionFold(InOrder):
    position_column, result = "pos", RESULT

    def __init__(self, assisted: bool, default: str = EN, patience: float | None = None) -> None:
        super().__init__(default, patience)
        self.columns = ["word", "in_en", "in_bg", "bg_fix", *(ASSISTS if assisted else ())]

    def load(self, text: str | None) -> Detector:
        return Detector(self.default) if text is None else Detector.load(text)

    def step(self, state: Detector, row: list) -> tuple:
        word, in_en, in_bg, *rest = row
        return word, *state.step(word, bool(in_en), bool(in_bg), *rest), bool(in_en), bool(in_bg)


def _arrived(make, args: tuple) -> Late:
    try:
        return Late(make(*args))
    except PySparkRuntimeError:
        return Late(None)


class Late:
    """A broadcast within a processor. The worker that plans a stream has no broadcasts, and goes without its value."""

    def __init__(self, broadcast) -> None:
        self.broadcast = broadcast

    def __reduce__(self):
        return _arrived, self.broadcast.__reduce__()  # which also counts it as one that the tasks need


class KeyFold(InOrder):
    position_column, columns, result = "seq", ["terminal", "ch", "key_code", "mods"], EMITTED

    def __init__(self, lexicons: Late, default: str = EN, patience: float | None = None, texts_only: bool = False) -> None:
        super().__init__(default, patience)
        self.lexicons, self.texts_only = lexicons, texts_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self.lexicons.broadcast is not None:
            self.look = looker(*self.lexicons.broadcast.value)

    def load(self, text: str | None) -> Keyboard:
        board = Keyboard(self.look, self.default)
        return board if text is None else board.load(text)

    def step(self, state: Keyboard, row: list) -> tuple:
        state.terminal, ch, code, mods = bool(row[0]), *row[1:]
        if not mods and not code and state.takes(ch):
            return "", True, "" if self.texts_only else state.preview()
        return *state.key(ch, int(code or 0), mods.split(",") if mods else ()), state.preview()


class Answered(Keyboard):
    """A keyboard that has the lexicons' answers for its next step."""

    def __init__(self, default: str = EN) -> None:
        self.seen: dict[str, Features] = {}
        super().__init__(self.seen.__getitem__, default)

    def dump(self) -> str:
        return json.dumps([super().dump(), {w: (x.in_en, x.in_bg, x.bg_fix) for w, x in self.seen.items()}])

    def load(self, text: str) -> Answered:
        board, seen = json.loads(text)
        self.seen.update({w: Features(*x) for w, x in seen.items()})
        return super().load(board)


class StepFold(InOrder):
    """Types the steps of operators.replay.answered."""

    position_column, columns = "at", ["terminal", "seq", "keys", "key_code", "mods", "last", "word", "in_en", "in_bg", "bg_fix"]
    result = "session_id string, at bigint, emitted string, seq bigint"
    texts_only = True

    def load(self, text: str | None) -> Answered:
        return Answered(self.default) if text is None else Answered(self.default).load(text)

    def step(self, state: Answered, row: list) -> tuple:
        terminal, seq, keys, code, mods, last, word, *found = row
        if word is not None:
            in_en, in_bg, fix = found
            state.seen[word] = Features(bool(in_en), bool(in_bg), fix)
        if not last:
            return "", seq
        state.terminal = bool(terminal)
        text, _ = state.key(keys, int(code or 0), json.loads(mods or "[]")) if code or mods or not keys else state.type(keys)
        state.seen.clear()
        return text, seq


def _folded(rows: DataFrame, key: str, processor: InOrder) -> DataFrame:
    timed = processor.patience is not None
    result = processor.result + ", skipped bigint" * timed
    return rows.groupBy(key).transformWithStateInPandas(processor, result, "append", "processingTime" if timed else "none")


def detect_stream(featured: DataFrame, session: str = "session", default: str = EN, patience: float | None = None) -> DataFrame:
    """As operators.fold.detect, on a streaming DataFrame, which may have en_score, bg_score and en_fix too; needs the RocksDB state store. Rows without a session, position or word are left out. ``patience``: see InOrder."""
    extra = assists(featured)
    rows = featured.select(F.col(session).cast("string").alias("session"), F.col("pos").cast("bigint").alias("pos"), "word", "in_en", "in_bg", "bg_fix", *extra)
    rows = rows.filter("session is not null and pos is not null and word is not null")
    return _folded(rows, "session", SessionFold(bool(extra), default, patience))


def replay_stream(events: DataFrame, en: DataFrame, bg: DataFrame, default: str = EN, patience: float | None = None, texts_only: bool = False) -> DataFrame:
    """As operators.replay.replay, on a streaming DataFrame of key events, whose words are looked up as they are typed: the lexicons, of at most replay.MAX_LEXICON words, are sent to the tasks; type_stream takes any. What a session holds is emitted by its end event (sources.events.ended). ``patience``: see InOrder; ``texts_only``: see there."""
    lexicons = Late(events.sparkSession.sparkContext.broadcast((lexicon_set(en), lexicon_set(bg))))
    rows = events.select("session_id", "seq", is_terminal_app(F.col("bundle_id")).alias("terminal"), "ch", "key_code", F.array_join("mods", ",").alias("mods"))
    return _folded(rows.filter("session_id is not null and seq is not null"), "session_id", KeyFold(lexicons, default, patience, texts_only))


def type_stream(answered: DataFrame, default: str = EN, patience: float | None = None) -> DataFrame:
    """The texts (session_id, at, emitted, seq) of a streaming DataFrame of the rows of operators.replay.answered, in any order; lexicons of any size have met their words already. ``patience``: see InOrder."""
    return _folded(answered.filter("session_id is not null"), "session_id", StepFold(default, patience))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that its source has now, into Parquet, and reads that."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
