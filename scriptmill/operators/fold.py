"""Language folds over the ordered words of sessions, in two profiles.

``simulate`` is the reduced profile, whose state is the last label, its streak and
six confident labels. ``detect`` is the full one, whose state is six labels, each
confident or not. Both read each session in order as a stream of Arrow batches and
carry the state from row to row, so no session is gathered into one row or one
group. A session longer than a segment is folded by many tasks (operators.scan).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from scriptmill.functions.mapping import to_cyrillic
from scriptmill.operators.correct import correct_bulgarian
from scriptmill.operators.detector import BG, EN, LABELS, Detector, History
from scriptmill.operators.lookup import attach, classify_distinct, counted, word_class
from scriptmill.operators.scan import SEGMENT, runs, segmented, values
from scriptmill.sources.shared import stored

#: Words in a row from which a label holds against a short word (fixed value).
STREAK = 3


class Reduced:
    """The machine of the reduced profile. A state: the last label, its streak (3 stands for more) and the last six confident labels."""

    columns, start = ("in_en", "in_bg", "short"), ("", 0, "")

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def states(self) -> list:
        sure = ["".join(x) for n in range(LABELS + 1) for x in product("EB", repeat=n)]
        return [self.start, *product("EB", range(1, STREAK + 1), sure)]

    def symbols(self, batch: pa.RecordBatch) -> list:
        """1 for an English word, 2 for a Bulgarian one, 4 for a short one, together."""
        return sum(k * pc.fill_null(batch[c], False).to_numpy(zero_copy_only=False).astype(np.int64) for k, c in ((1, "in_en"), (2, "in_bg"), (4, "short"))).tolist()

    def step(self, state: tuple, symbol: int) -> tuple:
        if (state, symbol) not in self.known:
            self.known[state, symbol] = self._step(*state, symbol & 3, symbol >= 4)
        return self.known[state, symbol]

    @staticmethod
    def _step(last: str, streak: int, sure: str, found: int, short: bool) -> tuple:
        only = {1: "E", 2: "B"}.get(found)
        if only:
            label = last if last not in ("", only) and streak >= STREAK and short else only
        else:
            lead = sure.count("B") - sure.count("E") if found else 0
            label = "B" if lead > 0 else "E" if lead < 0 else last or "E"
        return label, min(streak + 1, STREAK) if label == last else 1, (sure + label)[-LABELS:] if label == only else sure

    def dump(self, state: tuple) -> str:
        return json.dumps(state)

    def load(self, text: str) -> tuple:
        return tuple(json.loads(text))


def _simulate(machine: Reduced, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            symbols, labels = machine.symbols(batch), []
            for key, start, end in runs(batch, "session", "segment"):
                if state is None or key != last:
                    entry = batch["entry"][start].as_py()
                    last, state = key, machine.load(entry) if entry else machine.start
                for symbol in symbols[start:end]:
                    state = machine.step(state, symbol)
                    labels.append(state[0])
            yield pa.RecordBatch.from_arrays([batch["session"], batch["pos"], batch["word"], pa.array([x == "B" for x in labels], pa.bool_())], schema.names)

    return work


def simulate(classed: DataFrame, session: str = "session", pos: str = "pos", word: str = "word", segment: int = SEGMENT, last: int | None = None) -> DataFrame:
    """lang and output of each word of the reduced profile; rows need in_en and in_bg, and positions from 0. Long sessions are folded in segments (operators.scan; ``last``: see there)."""
    rows = classed.select(F.col(session).alias("session"), F.col(pos).cast("int").alias("pos"), F.col(word).alias("word"), "in_en", "in_bg", (F.length(word) <= 3).alias("short"))
    machine = Reduced()
    rows = segmented(rows, machine, segment, last)
    shape = StructType([rows.schema["session"], StructField("pos", IntegerType()), StructField("word", StringType()), StructField("is_bg", BooleanType())])
    each = rows.mapInArrow(_simulate(machine, to_arrow_schema(shape)), shape)
    return each.select(F.col("session").alias(session), "pos", "word", F.when(F.col("is_bg"), "BG").otherwise("EN").alias("lang"), F.when(F.col("is_bg"), to_cyrillic(F.col("word"))).otherwise(F.col("word")).alias("output"))


class Full:
    """The machine of the full profile. A state: the last six labels, each confident or not."""

    columns, start = ("word", "in_en", "in_bg", "bg_fix"), ()

    def __init__(self, default: str, assisted: bool, preferred: bool = False) -> None:
        """``preferred``: the column preference has each session's default language, where it is not null."""
        self.default, self.preferred = default, preferred
        self.columns = (*Full.columns, *(ASSISTS if assisted else ()), *(["preference"] if preferred else []))

    def states(self) -> list:
        labels = [(x, sure) for x in (EN, BG) for sure in (True, False)]
        return [x for n in range(LABELS + 1) for x in product(labels, repeat=n)]

    def symbols(self, batch: pa.RecordBatch) -> list:
        return list(zip(*[values(batch[c]) for c in self.columns], strict=True))

    def step(self, state: History, symbol: tuple) -> History:
        detector = self.detector(state, symbol)
        detector.step(*(symbol[:-1] if self.preferred else symbol))
        return detector.history

    def detector(self, state: History, symbol: tuple) -> Detector:
        return Detector(symbol[-1] if self.preferred and symbol[-1] else self.default, state)

    def dump(self, state: History) -> str:
        return json.dumps(state)

    def load(self, text: str) -> History:
        return tuple((label, sure) for label, sure in json.loads(text))


#: Columns that may help the decision, and what stands where there are none.
ASSISTS = {"en_score": 0.0, "bg_score": 0.0, "en_fix": None}


def assists(featured: DataFrame) -> list[Column]:
    """The helping columns, all or none."""
    if not set(ASSISTS) & set(featured.columns):
        return []
    kind = lambda v: "string" if v is None else "double"
    return [F.coalesce(F.col(c) if c in featured.columns else F.lit(None), F.lit(v)).cast(kind(v)).alias(c) for c, v in ASSISTS.items()]


RESULT = "session string, pos bigint, original string, converted string, language string, confidence double, in_en boolean, in_bg boolean"


def _detect(machine: Full):
    kept, names = ["session", "pos", "word"], [x.split()[0] for x in RESULT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, out = machine.symbols(batch), []
            for key, start, end in runs(batch, "session", "segment"):
                if state is None or key != last:
                    entry = batch["entry"][start].as_py()
                    last, state = key, machine.detector(machine.load(entry) if entry else machine.start, rows[start])
                step = state.step
                out += [step(*row) for row in (rows[start:end] if not machine.preferred else [r[:-1] for r in rows[start:end]])]
            converted, label, confidence = zip(*out, strict=True)
            cols = [pa.array(converted, pa.string()), pa.array(label, pa.string()), pa.array(confidence, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *cols, batch["in_en"], batch["in_bg"]], names)

    return work


def features(words: DataFrame, en: DataFrame, bg: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with in_en, in_bg, class and bg_fix, the correction of words in neither lexicon. They are found once for each distinct word."""
    out = attach(words, word_features(counted(words, word), en, bg), word)
    return out.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("in_en", "in_bg")}).withColumn("class", word_class())


def word_features(words: DataFrame, en: DataFrame, bg: DataFrame) -> DataFrame:
    """``words`` (word, and other columns; one row a word) with in_en, in_bg, class and bg_fix, as a stored table."""
    classed = stored(classify_distinct(words, en, bg), "classed")
    unknown = classed.filter("class = 'neither'").select(F.col("word").alias("_u"), to_cyrillic(F.col("word")).alias("cyrillic"))
    fixes = correct_bulgarian(unknown, bg).filter("bg_fix is not null").select("_u", "bg_fix")
    return stored(classed.join(fixes.hint("merge"), F.col("word") == F.col("_u"), "left").drop("_u"), "word-features")


def detect(featured: DataFrame, session: str = "session", pos: str = "pos", word: str = "word", default: str = EN, segment: int = SEGMENT, last: int | None = None) -> DataFrame:
    """original, converted, language and confidence of each word of the full profile, with what the lexicons said. Positions are from 0; long sessions are folded in segments (operators.scan; ``last``: see there). ``featured`` may have en_score and bg_score (operators.scores), en_fix (operators.speller) and preference (the default language of the row's session; null: ``default``). One shuffle, on the session. Rows without a session or a word are left out."""
    rows = featured.select(F.col(session).cast("string").alias("session"), F.col(pos).cast("bigint").alias("pos"), F.col(word).alias("word"), F.coalesce("in_en", F.lit(False)).alias("in_en"), F.coalesce("in_bg", F.lit(False)).alias("in_bg"), "bg_fix", *assists(featured), *(["preference"] if "preference" in featured.columns else []))
    rows = rows.filter("session is not null and word is not null")
    machine = Full(default, bool(assists(featured)), "preference" in featured.columns)
    return segmented(rows, machine, segment, last).mapInArrow(_detect(machine), RESULT)
