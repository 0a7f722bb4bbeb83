import time
from datetime import date
from itertools import groupby

import pyarrow as pa
import pytest

from scriptmill.operators.scan import runs, values

COLUMNS = [
    pa.array(["a", "a", None, None, "b", "", "", "a"]),
    pa.array([1, 1, None, 0, 0, None, None, 2], pa.int64()),
    pa.array([0.5, 0.5, None, 2.0, 2.0, 0.0, None, None]),
    pa.array([True, True, None, None, False, False, True, False]),
    pa.array([date(2020, 1, 1)] * 3 + [None] * 5),
    pa.array([[1], [1], None, [], [], [1, 2], None, None], pa.list_(pa.int64())),
    pa.array([None] * 8, pa.string()),
    pa.array([3, 3, 1, 1, 1, 2, 2, 2], pa.int32()),
    pa.array([3.5, 3.5, 1, 1, 1, 2, 2, 2]),
]


@pytest.mark.parametrize("k", range(len(COLUMNS)))
def test_runs_and_values_equal_plain_ones(k):
    """Stretches and values of any type, with nulls and without, in whole batches and slices."""
    batch = pa.RecordBatch.from_arrays([COLUMNS[k], pa.array([0, 0, 0, 0, 0, 0, 1, 1])], ["x", "y"])
    for part in (batch, batch.slice(2, 5), batch.slice(7), batch.slice(3, 0)):
        got, listed = values(part["x"]), part["x"].to_pylist()
        assert got == listed and [type(x) for x in got] == [type(x) for x in listed]
        want, at = [], 0
        for key, rows in groupby(zip(listed, part["y"].to_pylist(), strict=True)):
            n = len(list(rows))
            want.append((key, at, at + n))
            at += n
        assert list(runs(part, "x", "y")) == want


def test_runs_make_no_object_for_each_row():
    """Long stretches take a fraction of the time of listing their rows."""
    n = 200_000
    batch = pa.RecordBatch.from_arrays([pa.array(["session"] * n), pa.array([0] * n)], ["session", "segment"])

    def took(work):
        begun = time.perf_counter()
        work()
        return time.perf_counter() - begun

    plain = min(took(lambda: batch["session"].to_pylist()) for _ in range(3))
    assert min(took(lambda: list(runs(batch, "session", "segment"))) for _ in range(3)) < plain / 2
