"""The word-by-word decision: a bounded language state, folded over the words of a session.

Pure Python over features that Spark has worked out, used by the batch fold, the
key replay and the streams alike. A session's state is its last six labels, each
confident or not, and eight recent words, so it is small however long a session
is. A decision depends on few values, so decisions are remembered.
"""

from __future__ import annotations

import json
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

from scriptmill.functions.abbreviations import BULGARIAN, ENGLISH
from scriptmill.functions.mapping import LATIN_WORD, TABLE

EN, BG, UNSURE = "EN", "BG", "??"
# How much is remembered, what counts as confident, and how the confidences are set.
LABELS, RECENT, CONFIDENT = 6, 8, 0.9
AMBIGUOUS_MARGIN, UNKNOWN_LEAST, UNKNOWN_MARGIN = 0.1, 0.5, 0.15
LATIN = re.compile(LATIN_WORD.replace(r"\z", r"\Z"))
#: What comes out: the word, its transliteration, an expansion of either language, the expansion in the word's case, or the correction of either.
WORD, SCRIPT, ENGLISH_ABBR, BULGARIAN_ABBR, CASED, FIX, ENGLISH_FIX = range(7)

History = tuple[tuple[str, bool], ...]


@dataclass
class Features:
    """What the lexicons say of a word: members, and the correction in either language if it has one. Scores are a language recogniser's; none by default."""

    in_en: bool = False
    in_bg: bool = False
    bg_fix: str | None = None
    en_score: float = 0.0
    bg_score: float = 0.0
    en_fix: str | None = None


def streak(history: History) -> int:
    """Confident labels equal to the last one, back to the first other label."""
    n = 0
    for label, sure in reversed(history):
        if label != history[-1][0]:
            break
        n += sure
    return n


def dominant(history: History) -> str:
    lead = sum((label == BG) - (label == EN) for label, sure in history if sure)
    return BG if lead > 0 else EN if lead < 0 else UNSURE


def pushed(history: History, label: str, confidence: float) -> History:
    return history if label == UNSURE else (*history, (label, confidence >= CONFIDENT))[-LABELS:]


def _ambiguous(history: History, default: str, en: float, bg: float) -> tuple[str, float]:
    last = history[-1][0] if history else UNSURE
    for label, confidence in ((dominant(history), 0.9), (last, 0.8)):
        if label != UNSURE:
            return label, confidence
    if bg > en + AMBIGUOUS_MARGIN:
        return BG, bg
    if en > bg + AMBIGUOUS_MARGIN:
        return EN, en
    return default, 0.5


def _unknown(history: History, default: str, en: float, bg: float) -> tuple[str, float]:
    if history:
        return history[-1][0], 0.7
    label, best, rest = (BG, bg, en) if bg > en else (EN, en, bg)
    return (label, best) if best > UNKNOWN_LEAST and best > rest + UNKNOWN_MARGIN else (default, 0.3)


def _choose(history: History, en_abbr: bool, bg_abbr: bool, in_en: bool, in_bg: bool, has_fix: bool, short: bool, default: str, en: float, bg: float, has_en_fix: bool) -> tuple[int, str, float]:
    last = history[-1][0] if history else UNSURE
    if en_abbr and last != BG:
        return ENGLISH_ABBR, EN, 1.0
    if bg_abbr and last == BG:
        return BULGARIAN_ABBR, BG, 1.0
    run = streak(history)
    # an abbreviation comes before the speller
    corrected = CASED if en_abbr else ENGLISH_FIX if has_en_fix and not in_en else None
    if in_en and in_bg:
        label, confidence = _ambiguous(history, default, en, bg)
    elif in_en or in_bg:
        mine, other = (EN, BG) if in_en else (BG, EN)
        label, confidence = (other, 0.6) if last == other and run >= 3 and short else (mine, 1.0)
    elif last == EN and run >= 2:
        return (corrected, EN, 0.8) if corrected else (WORD, EN, 0.5)
    elif last == BG and run >= 2:
        return SCRIPT, BG, 0.5
    elif bool(corrected) != has_fix:
        return (corrected, EN, 0.8) if corrected else (FIX, BG, 0.8)
    elif corrected and last != UNSURE:
        return (FIX, BG, 0.7) if last == BG else (corrected, EN, 0.7)
    else:
        label, confidence = _unknown(history, default, en, bg)
    if label == EN and confidence >= 1.0 and corrected:
        return corrected, EN, confidence
    if label == BG and confidence >= 1.0 and has_fix:
        return FIX, BG, confidence
    return (SCRIPT if label == BG else WORD), label, confidence


@lru_cache(maxsize=1 << 18)
def decide(history: History, *given) -> tuple[int, str, float, History]:
    """What comes out, its label and confidence, and the history after it."""
    out, label, confidence = _choose(history, *given)
    return out, label, confidence, pushed(history, label, confidence)


class Detector:
    __slots__ = ("default", "history", "recent")

    def __init__(self, default: str = EN, history: History = (), recent=()) -> None:
        self.default, self.history, self.recent = default, history, deque(recent, RECENT)

    def dump(self) -> str:
        return json.dumps([self.default, self.history, list(self.recent)])

    @classmethod
    def load(cls, text: str) -> Detector:
        default, history, recent = json.loads(text)
        return cls(default, tuple((label, sure) for label, sure in history), recent)

    def __eq__(self, other) -> bool:
        return self.dump() == other.dump()

    __hash__ = None

    @property
    def last(self) -> str:
        return self.history[-1][0] if self.history else UNSURE

    @property
    def is_first(self) -> bool:
        return not self.history

    def process(self, word: str, seen: Features) -> tuple[str, str, float]:
        """(output, label, confidence) of a word, which then counts as history."""
        return self.step(word, seen.in_en, seen.in_bg, seen.bg_fix, seen.en_score, seen.bg_score, seen.en_fix)

    def step(self, word: str, in_en: bool, in_bg: bool, bg_fix: str | None, en_score: float = 0.0, bg_score: float = 0.0, en_fix: str | None = None) -> tuple[str, str, float]:
        if not LATIN.match(word):
            return word, UNSURE, 0.0
        lower = word.lower()
        how, label, confidence, self.history = decide(self.history, lower in ENGLISH, lower in BULGARIAN, in_en, in_bg, bg_fix is not None, len(lower) <= 3, self.default, en_score, bg_score, en_fix is not None)
        self.recent.append(word)
        if how == WORD:
            return word, label, confidence
        if how == SCRIPT:
            return word.translate(TABLE), label, confidence
        return self._other(how, word, lower, bg_fix, en_fix), label, confidence

    @staticmethod
    def _other(how: int, word: str, lower: str, bg_fix: str | None, en_fix: str | None) -> str:
        if how in (FIX, ENGLISH_FIX):
            return bg_fix if how == FIX else en_fix
        if how == BULGARIAN_ABBR:
            return BULGARIAN[lower]
        out = ENGLISH[lower]
        return out[:1].upper() + out[1:] if how == CASED and word[:1].isupper() else out
