import itertools

import pytest
from pyspark.sql import functions as F

from scriptmill.functions.mapping import TABLE
from scriptmill.operators import correct, fold, lookup, replay
from scriptmill.operators.detector import BG, EN, UNSURE, Detector, Features
from scriptmill.sources import events, lexicons

# Members that the expected results below need (the full word lists are not at hand), and those results.
EN_WORDS = "the is are you hello want write ignore when there how have this english message previous what a i no do to go link nice info".split()
BG_WORDS = "това как си добре наред вече нещата написах искам правописни и в с е а на не да до за от по само проба аз кафе нов код пуф кой прави въведох този линк се получава разход но то линк".split()
SCENARIOS = [
    ("hello how are you", "EN EN EN EN", "hello how are you"),
    ("towa e samo proba", "BG BG BG BG", "това е само проба"),
    ("kak si dobre", "BG BG BG", "как си добре"),
    ("az iskam kafe", "BG BG BG", "аз искам кафе"),
    ("napisah now kod want write", "BG BG BG EN EN", "написах нов код want write"),
    ("when there is a puf", "EN EN EN EN EN", "when there is a puf"),
    ("koj prawi pdf", "BG BG BG", "кой прави пдф"),
    ("wywedoh tozi link i ne se polu`awa", "BG BG BG BG BG BG BG", "въведох този линк и не се получава"),
    ("tozi razhod", "BG BG", "този разход"),
    ("we`e ne]ata", "BG BG", "вече нещата"),
]
LOOK_AHEAD = [
    ("no", "ignore", "EN", "no", "ignore"), ("i", "iskam", "BG", "и", "искам"), ("i", "want", "EN", "i", "want"), ("a", "kafe", "BG", "а", "кафе"), ("a", "nice", "EN", "a", "nice"),
    ("to", "towa", "BG", "то", "това"), ("to", "write", "EN", "to", "write"), ("do", "you", "EN", "do", "you"), ("do", "towa", "BG", "до", "това"),
]


@pytest.fixture(scope="module")
def words(spark):
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    return make(EN_WORDS), make(BG_WORDS)


def table(spark, texts):
    return spark.createDataFrame([(str(k), p, w) for k, t in enumerate(texts) for p, w in enumerate(t.split())], "session string, pos int, word string")


def test_simulated_scenarios(spark, words):
    got = fold.simulate(lookup.classify(table(spark, [s[0] for s in SCENARIOS]), *words)).orderBy("session", "pos").collect()
    for k, (_, langs, outputs) in enumerate(SCENARIOS):
        mine = [r for r in got if r["session"] == str(k)]
        assert [r["lang"] for r in mine] == langs.split() and [r["output"] for r in mine] == outputs.split()


def test_look_ahead(spark, words):
    got = lookup.look_ahead(lookup.classify(table(spark, [f"{a} {b}" for a, b, *_ in LOOK_AHEAD]), *words)).orderBy("session").collect()
    assert [tuple(r)[2:] for r in got] == [(a, b, lang, x, y) for a, b, lang, x, y in LOOK_AHEAD]


def test_conflicts(spark, words):
    assert {r["word"] for r in lookup.conflicts(*words).collect()} == {w for w in EN_WORDS if w.translate(TABLE) in BG_WORDS}


def test_classes_keep_null_words(spark, words):
    rows = spark.createDataFrame([(None,), ("to",), ("the",), ("kafe",), ("zz",), ("zz",)], "word string")
    for limit in (1000, 3):  # by broadcast, and by distinct words
        got = sorted((str(r["word"]), r["class"]) for r in lookup.classify(rows, *words, limit=limit).collect())
        assert got == [("None", "neither"), ("kafe", "bg"), ("the", "en"), ("to", "both"), ("zz", "neither"), ("zz", "neither")]


def test_edit1_equals_enumeration(spark):
    letters = "абвя"
    lexicon = {"".join(p) for n in (1, 2, 3) for p in itertools.product(letters, repeat=n) if hash(p) % 5 == 0 or len(set(p)) == 1} | {"правописни", "аб", "ба", "xй"}
    asked = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product(letters[:3], repeat=n)] + ["пръвописни", "правопсини", "правописнии", "правописн", "x"]
    make = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = {r["word"]: r["correction"] for r in correct.edit1(make(asked), make(lexicon)).collect()}
    # an edit that gives the word itself (deletion from or insertion into equal letters cannot) is no correction
    want = {w: c for w in asked if (c := replay.first_edit(w, lexicon - {w}))}
    assert got == want


def test_correct_bulgarian(spark, words):
    rows = spark.createDataFrame([("Пръвописни",), ("кафе",), ("кафф",), ("ж",), (None,)], "cyrillic string")
    got = {r["cyrillic"]: r["bg_fix"] for r in correct.correct_bulgarian(rows, words[1]).collect()}
    assert got == {"Пръвописни": "Правописни", "кафе": None, "кафф": "кафе", "ж": None, None: None}


def test_correct_english(spark):
    rows = spark.createDataFrame([("Thx",), ("ty",), ("word",)], "w string")
    assert [r[0] for r in rows.select(correct.correct_english(F.col("w"))).collect()] == ["Thanks", "thank you", None]


def run(words, default=EN):
    look = replay.looker(frozenset(EN_WORDS), frozenset(BG_WORDS))
    d = Detector(default)
    return [d.process(w, look(w)) for w in words.split()]


def test_decisions():
    assert run("u hello") == [("you", EN, 1.0), ("hello", EN, 1.0)]
    assert run("towa u")[1] == ("you", EN, 0.8)  # an abbreviation alone is a correction while the Bulgarian streak is short
    assert run("towa zdr")[1] == ("здравей", BG, 1.0)
    assert run("towa iskam proba info") [3] == ("information", EN, 1.0)
    assert run("a")[0] == ("a", EN, 0.5) and run("a", BG)[0] == ("а", BG, 0.5)
    assert run("zzzzzz")[0] == ("zzzzzz", EN, 0.3)
    assert run("kaffe")[0] == ("кафе", BG, 0.8)
    assert run("when there hello puf")[3] == ("puf", EN, 0.6)
    assert run("x1")[0] == ("x1", UNSURE, 0.0)
    assert run("hello when qqq")[2] == ("qqq", EN, 0.5)
    assert run("towa iskam qqq")[2] == ("яяя", BG, 0.5)


def test_profiles_differ(spark, words):
    # five ambiguous words count as confident in the full profile only
    text = "hello a i no do to kafe a"
    simulated = fold.simulate(lookup.classify(table(spark, [text]), *words)).orderBy("pos").collect()[-1]
    assert simulated["lang"] == "BG" and run(text)[-1][1] == EN
    text = "hello qqqq wwww puf"
    simulated = fold.simulate(lookup.classify(table(spark, [text]), *words)).orderBy("pos").collect()[-1]
    assert simulated["lang"] == "EN" and run(text)[-1][1] == BG


def test_memory_is_bounded():
    d = Detector()
    for k in range(50):
        d.process("hello", Features(in_en=True))
    assert len(d.history) == 6 and len(d.recent) == 8 and Detector.load(d.dump()) == d


def test_batch_fold_equals_plain_fold(spark, words):
    texts = [s[0] for s in SCENARIOS] + ["kaffe u towa zdr info", "a a a", "hello a i no do to kafe a"]
    got = fold.detect(fold.features(table(spark, texts), *words)).orderBy("session", "pos").collect()
    for k, t in enumerate(texts):
        assert [(r["converted"], r["language"], r["confidence"]) for r in got if r["session"] == str(k)] == run(t)


def press(keys, terminal=False):
    look = replay.looker(frozenset(EN_WORDS), frozenset(BG_WORDS))
    board, out = replay.Keyboard(look, terminal=terminal), ""
    for k in keys:
        ch, code, mods = k if isinstance(k, tuple) else (k, 0, ())
        text, taken = board.key(ch, code, mods)
        out += text + ("" if taken or mods or code or ch in "\x1b\x7f" else ch)
    return out, board


def test_typing():
    assert press("towa e samo ")[0] == "това е само "
    assert press("i iskam ")[0] == " и искам "  # held while its space passes, then decided by the second word
    assert press("i want ")[0] == " i want "
    assert press("towa :D po-dobre ")[0] == "това :D по-добре "
    assert press("towa :) ")[0] == "това :) "
    assert press("u@x.com ")[0] == "u@x.com "
    assert press("towa. ")[0] == "това. "
    assert press("po-dobre, ")[0] == "po-dobre, "  # a comma skips the splitting at hyphens
    assert press("towa\n")[0] == "towa\n"
    assert press(["t", "o", "w", ("x", 123, ())])[0] == "tow"
    assert press("towa\x1b ")[0] == " "
    assert press("towx\x7fa ")[0] == "това "
    assert press("i \x7f\x7f")[1].pending is None
    assert press(["t", "o", "w", "a", ("c", 8, ("command",))])[0] == "това"
    assert press("towa ", terminal=True)[0] == "towa "
    assert press("12 towa ")[0] == "12 това "
    assert press("i ")[1].pending == "i" and press("i ")[0] == " "


def test_replay_table(spark, words):
    turns = spark.createDataFrame([("a", "towa e "), ("b", "i iskam"), ("c", None), ("d", "")], "s string, text string")
    got = replay.replay(events.typed(turns, F.col("s")), *words).filter("emitted <> ''").orderBy("session_id", "seq").collect()
    assert [(r["session_id"], r["emitted"]) for r in got] == [("a", "това"), ("a", "е"), ("b", "и искам")]
    with pytest.raises(ValueError, match="more than 3"):
        replay.lexicon_set(words[0], 3)


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Това\n  как \n\nкак\n\tси \n")
    assert {r["word"] for r in lexicons.read_lexicon(spark, str(tmp_path / "w.txt")).collect()} == {"това", "как", "си"}
    assert lexicons.read_lexicon(spark, str(tmp_path / "missing.txt")).count() == 0
    lexicons.write_lexicon(lexicons.read_lexicon(spark, str(tmp_path / "w.txt")), str(tmp_path / "out"))
    assert lexicons.read_lexicon(spark, str(tmp_path / "out")).count() == 3


def test_correction_after_a_sure_score():
    # the edit search corrects no lexicon word, but a given correction may
    assert Detector().step("a", True, True, "аа", 0.0, 1.0) == ("аа", BG, 1.0)
    assert Detector().step("a", True, True, "аа", 0.0, 0.9) == ("а", BG, 0.9)
    assert Detector().step("a", True, True, None, 0.0, 1.0) == ("а", BG, 1.0)
