import pytest

from scriptmill.llm import secrets
from tests.llm.test_operators import KEY, wrap


@pytest.mark.parametrize("kinds", [["base64"], ["url"], ["unicode"], ["html"], ["gzip"], ["zlib"], ["base64", "base64"], ["gzip", "base64"]])
def test_the_same_piece_twice(spark, kinds):
    piece = f"token: {KEY}"
    for k in kinds:
        piece = wrap(k, piece)
    text = f"a {piece} b\n{piece}\nc"
    spans = secrets.all_spans(text)[1]
    places = [text.index(piece), text.rindex(piece)]
    assert len(set(places)) == 2
    for at in places:
        assert any(k == 1 and at <= s < e <= at + len(piece) for s, k, e in spans)
    (row,) = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["text"].count("[SECRET]") == 2


def test_equal_siblings_inside_a_layer():
    piece = wrap("base64", f"see {KEY}")
    text = wrap("base64", f"{piece} and {piece}")
    assert len([s for s in secrets.all_spans(text)[1] if s[1] == 1]) == 2


@pytest.mark.parametrize("text", [r"\u0070assword: hunter2hunter2", r"password \u003d hunter2hunter2", "token&#58; abcdefghijkl", "password%3D hunter2hunter2", "pass%77ord = hunter2hunter2"])
def test_partly_escaped_assignments(text):
    assert (0, 0, len(text)) in secrets.all_spans(text)[1]


@pytest.mark.parametrize("sign", [r"\u003d", "&#61;", "%3D"])
def test_long_values_after_an_escape(sign):
    text = f"token{sign}{'Ab1.' * 100} tail"
    assert (0, 0, len(text) - 5) in secrets.all_spans(text)[1]


@pytest.mark.parametrize("gap", [100, 1000])
def test_escapes_far_apart(gap):
    text = rf"\u0070assword\u003d{'A' * gap}\u0042 x"
    assert (0, 0, len(text) - 2) in secrets.all_spans(text)[1]


def test_places_in_mixed_layers():
    text = "é \\ud83d\\ude00 %F0%9F%98%80 &#x1F600; " + f"x%20{KEY}%20y"
    s = text.index(KEY)
    assert (s, 1, s + len(KEY)) in secrets.all_spans(text)[1]
    for unwrap in (secrets._unwrap_url, secrets._unwrap_unicode):
        ((plain, lo, hi),) = unwrap(text)
        assert len(plain) == len(lo) == len(hi) and "\U0001f600" in plain and lo == sorted(lo) and hi[-1] == len(text)
