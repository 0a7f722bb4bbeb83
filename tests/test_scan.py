import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptmill.operators import fold, scan
from scriptmill.operators.detector import EN, Detector

WORDS = "session string, pos int, word string, in_en boolean, in_bg boolean, bg_fix string, en_score double, bg_score double, en_fix string"


def plain_simulation(rows):
    """The reduced profile by the rules, one word after the other."""
    last, streak, sure, out = "??", 0, [], []
    for word, in_en, in_bg in rows:
        if in_en != in_bg:
            own = "EN" if in_en else "BG"
            label = last if last not in ("??", own) and streak >= 3 and len(word) <= 3 else own
        else:
            lead = sure.count("BG") - sure.count("EN") if in_en else 0
            label = "BG" if lead > 0 else "EN" if lead < 0 else "BG" if last == "BG" else "EN"
        if in_en != in_bg and label == ("EN" if in_en else "BG"):
            sure = [*sure, label][-6:]
        streak = streak + 1 if label == last else 1
        last = label
        out.append(label)
    return out


def sessions(seed, lengths):
    r, out = random.Random(seed), []
    for k, n in enumerate(lengths):
        # some sessions have hardly a word that tells the language
        clear = r.choice([0.01, 0.2, 0.8])
        for p in range(n):
            en, bg = r.choice([(True, False), (False, True)]) if r.random() < clear else r.choice([(True, True), (False, False)])
            fix = r.choice([None, "бб"]) if not en and not bg else None
            out.append((f"s{k}", p, r.choice(["ab", "abc", "abcd", "u", "x1"]), en, bg, fix, r.choice([0.0, 0.5, 0.9, 1.0]), r.choice([0.0, 0.4, 1.0]), r.choice([None, "bb"])))
    return out


@pytest.mark.parametrize("segment", [1, 7, 50, 1000])
def test_folds_in_segments_equal_plain_folds(spark, segment):
    rows = sessions(segment, [0, 1, 7, 8, 50, 333, 1001])
    table = spark.createDataFrame(rows, WORDS).repartition(5)
    got = {}
    for r in fold.simulate(table, segment=segment).collect():
        got[r["session"], r["pos"]] = r["lang"]
    full = {(r["session"], r["pos"]): (r["converted"], r["language"], r["confidence"]) for r in fold.detect(table, segment=segment).collect()}
    for s in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == s]
        assert [got[s, x[1]] for x in own] == plain_simulation([x[2:5] for x in own])
        d = Detector()
        assert [full[s, x[1]] for x in own] == [d.step(*x[2:]) for x in own]
    assert len(got) == len(full) == len(rows)


def test_functions_of_segments():
    r, full = random.Random(3), fold.Full(EN, False)
    for machine, symbols in ((fold.Reduced(), [r.randrange(8) for _ in range(30)]), (full, [("ab", r.random() < 0.5, r.random() < 0.5, None) for _ in range(12)])):
        states = machine.states()
        assert len(set(states)) == len(states) and machine.start in states and all(machine.load(machine.dump(s)) == s for s in states[:200])
        function = scan.Function(machine, states)
        function.follow(symbols[:5])
        function.follow(symbols[5:])
        for k in range(0, len(states), 97):
            state = states[k]
            for x in symbols:
                state = machine.step(state, x)
            assert function.live[function.of[k] if len(function.live) > 1 else 0] == state


def test_one_endless_session_spreads_over_tasks(spark):
    """Over a million words of one session: many tasks, no gathered session, and the plain fold's labels."""
    n = 1_200_000
    rows = spark.range(n).select(F.lit("s").alias("session"), F.col("id").cast("int").alias("pos"), F.lit("word").alias("word"), (F.xxhash64("id") % 7 == 0).alias("in_en"), (F.xxhash64("id") % 5 == 0).alias("in_bg"))
    out = fold.simulate(rows, segment=50_000)
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    parts = out.select(F.spark_partition_id().alias("p"), "lang", "pos").groupBy("p").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lang") == "BG", F.col("pos"))).alias("bg")).collect()
    assert len(parts) >= 3 and sum(x["n"] for x in parts) == n and max(x["n"] for x in parts) < n * 0.7
    machine, state, want = fold.Reduced(), fold.Reduced.start, 0
    for batch in rows.orderBy("pos").withColumn("short", F.lit(False)).toArrow().to_batches():
        for at, symbol in zip(batch["pos"].to_pylist(), machine.symbols(batch), strict=True):
            state = machine.step(state, symbol)
            want += at if state[0] == "B" else 0
    assert sum(x["bg"] for x in parts) == want


def test_runs():
    batch = pa.RecordBatch.from_pydict({"a": ["x", "x", None, None, "y"], "b": [0, 1, 1, 1, 1]})
    assert list(scan.runs(batch, "a", "b")) == [(("x", 0), 0, 1), (("x", 1), 1, 2), ((None, 1), 2, 4), (("y", 1), 4, 5)]
