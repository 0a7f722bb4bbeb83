import pandas as pd

from scriptmill.operators.replay import looker
from scriptmill.streaming import detect


class State:
    def __init__(self, handle=None, *args):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getValueState(self, *args):
        return State()

    getMapState = getValueState


def rows_of(texts_only):
    fold = detect.KeyFold(detect.Late(None), texts_only=texts_only)
    fold.init(Handle())
    fold.look = looker(frozenset(["no"]), frozenset())
    keys = [("n", None), ("o", None), (" ", None), ("n", None), ("o", None), (None, "end")]
    frame = pd.DataFrame([(k, False, ch, 0, mods) for k, (ch, mods) in enumerate(keys)], columns=["seq", "terminal", "ch", "key_code", "mods"])
    return [tuple(r) for out in fold.handleInputRows(("s",), iter([frame]), None) for r in out.itertuples(index=False)]


def test_a_stream_may_leave_out_rows_without_text():
    every, some = rows_of(False), rows_of(True)
    assert len(every) == 6 and [r[:3] for r in some] == [("s", 2, "no"), ("s", 5, "no")]
    assert some == [r for r in every if r[2]]


def test_values_are_none_where_there_are_none():
    assert detect._values(pd.Series([1.5, None])) == [1.5, None]
    assert detect._values(pd.Series(["a", None, "b"])) == ["a", None, "b"]
    assert detect._values(pd.Series([3, 4])) == [3, 4]
