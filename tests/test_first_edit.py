import random

from pyspark.sql import functions as F

from scriptmill.operators import replay
from scriptmill.operators.correct import ALPHABET
from scriptmill.sources import events


class Counted(frozenset):
    asked = 0

    def __contains__(self, word):
        Counted.asked += 1
        return super().__contains__(word)


def test_the_first_edit_is_found_by_few_questions():
    """Of random words and edited lexicon words the first edit is that of all tries; a tenth of the questions are asked."""
    r = random.Random(1)
    word = lambda letters=ALPHABET: "".join(r.choice(letters) for _ in range(r.randrange(1, 11)))
    known = frozenset([word() for _ in range(3000)] + [word("абв") for _ in range(300)])
    asked = [word() for _ in range(500)] + [word("абв") for _ in range(300)]
    for w in r.sample(sorted(known), 300):
        i = r.randrange(len(w))
        asked += [w[:i] + w[i + 1 :], w[:i] + r.choice(ALPHABET) + w[i:], w[:i] + "x" + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :] if i else w]
    ends = replay.ends_of(known)
    assert [replay.first_edit(w, known, ends) for w in asked] == [replay.first_edit(w, known) for w in asked]
    assert sum(replay.first_edit(w, known) is not None for w in asked) > 800
    long, counted = [w * 2 for w in asked[:500] if len(w) > 3], Counted(known)
    Counted.asked = 0
    replay.looker(frozenset(), counted)
    for w in long:
        replay.first_edit(w, counted, ends)
    few, Counted.asked = Counted.asked, 0
    for w in long:
        replay.first_edit(w, counted)
    assert few < Counted.asked / 10


def test_rows_of_texts_only(spark):
    """The rows that emit text are those of all rows that do, and sessions end as with an end event of their own."""
    en, bg = spark.createDataFrame([("the",), ("no",)], "word string"), spark.createDataFrame([("на",), ("но",)], "word string")
    turns = spark.createDataFrame([("a", "the no no :) x-y na"), ("b", ""), ("c", None), ("d", "no"), ("e", "no. ")], "id string, text string")
    typed = events.typed(turns, F.col("id"))
    more = [("f", None, 5, "n", 0, []), ("f", None, 7, None, 0, ["end"]), ("g", None, 0, "n", 0, ["command"]), ("h", "com.apple.Terminal", 0, "n", 0, None), (None, None, 0, "n", 0, [])]
    rows = typed.union(spark.createDataFrame(more, events.KEY_EVENTS))
    every = [tuple(r) for r in replay.replay(rows, en, bg).collect()]
    with_ends = [tuple(r) for r in replay.replay(events.ended(rows), en, bg).collect()]
    assert sorted(every, key=str) == sorted(with_ends, key=str)
    assert len(every) == events.ended(rows).count()
    some = [tuple(r) for r in replay.replay(rows, en, bg, texts_only=True).collect()]
    assert some and sorted(some, key=str) == sorted((r for r in every if r[2]), key=str)
