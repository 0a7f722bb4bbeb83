"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of symbol pairs.

The vocabulary is a model file of a public tokenizer, named by a parameter. A
blank becomes U+2581, and one stands before the text. At first each character is
a symbol. The agenda holds the pairs of neighbours that make a piece, the best
score first and of equal scores the leftmost. The pair on top becomes one symbol,
its new neighbours join the agenda, and entries whose symbols have changed since
are passed over. What is no piece in the end is spelt in bytes.

No piece goes on with a blank after another character, so a text is cut before
its blanks without any change of result, and the distinct parts of a batch are
merged once. The agendas of short parts are rows of one array, whose tops are taken
together; a longer part has a heap, which takes n log n steps. Parts are
remembered up to a bound, then forgotten.

Of each Arrow batch ``digests`` has every 16th text (``check_every``) encoded and
decoded by the sentencepiece library too, and raises an error where the two differ:
the library takes 470 CPU seconds a GB. ``differences`` asks it about all texts.

Rows: a null or empty text has no ids and decodes to the empty text; repeated rows
each give a result of their own; an empty table gives an empty one; texts of any
length are encoded whole. Other columns are kept, whatever their names, but for
those called like the results, which these replace.

Vocabularies of another type, with a normaliser, or with user-defined or unused
pieces are refused. The driver reads the file once and broadcasts it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from scriptmill.llm.common import Columns, slices, tidy

#: Distinct parts that a task remembers at a time.
REMEMBERED = 400_000
#: Parts of up to so many symbols have their agendas in the rows of an array, so many at a time; longer ones have a heap.
SHORT, TOGETHER = 32, 20_000
NO_PAIR = np.iinfo(np.int32).max
#: From here on symbols are characters that are no piece. Id 0 is never a symbol.
UNLISTED = 1 << 24
BLANK = "▁"
# Kinds of pieces in a model file, its type for merges, and what an unknown id decodes to.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    def __init__(self, content: bytes) -> None:
        listed, trainer, normalizer = [], {}, {}
        for k, v in _fields(content):
            if k == 1:
                piece = dict(_fields(v))
                listed.append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normalizer = dict(_fields(v))
        kinds = {kind for *_, kind in listed}
        if trainer.get(3, 1) != MERGES or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or BYTE not in kinds or listed[0][2] == NORMAL:
            raise ValueError("the model must be of the merge type, with byte pieces, a blank before the text and no other normalising")
        self.ids = {p: i for i, (p, _, kind) in enumerate(listed) if kind == NORMAL}
        #: Less is better here.
        self.scores = {p: -score for p, score, kind in listed if kind == NORMAL}
        self.byte_ids = [0] * 256
        #: What each id stands for: its text, or the byte.
        self.texts: list[str | int] = []
        for i, (p, _, kind) in enumerate(listed):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            self.texts.append(int(p[3:5], 16) if kind == BYTE else "" if kind == CONTROL else UNKNOWN_TEXT if kind == UNKNOWN else p.replace(BLANK, " "))
        self.byte_set = frozenset(self.byte_ids)
        self.controls = frozenset(i for i, (*_, kind) in enumerate(listed) if kind == CONTROL)
        self.blanks = frozenset(i for i, (p, _, kind) in enumerate(listed) if kind == NORMAL and p[0] == BLANK)
        self.names = [str(i) for i in range(len(listed))]
        self._pairs()
        #: Cuts a text before blanks, where no piece goes on, and around the ASCII characters that are in no longer piece.
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.cut = re.compile(f"[{alone}]|{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" if alone and not crossing else "(?s:.+)")
        #: Of each part the number of its ids, the ids joined by commas, and their text.
        self.known: dict[str, tuple[int, str, str]] = {}

    def _pairs(self) -> None:
        """The pairs of symbols that make a piece, as sorted keys. A symbol is a piece, by its id, or a character that is none."""
        number = lambda s: self.ids[s] if s in self.ids else UNLISTED + ord(s) if len(s) == 1 else None
        rows = {(number(p[:k]), number(p[k:])): p for p in self.ids for k in range(1, len(p))}
        rows = {(a << 32 | b): p for (a, b), p in rows.items() if a is not None and b is not None}
        order = {score: k for k, score in enumerate(sorted(set(self.scores.values())))}
        self.pair_keys = np.array(sorted(rows), np.int64)
        self.pair_makes = np.array([self.ids[rows[k]] for k in self.pair_keys.tolist()], np.int64)
        self.pair_order = np.array([order[self.scores[rows[k]]] for k in self.pair_keys.tolist()], np.int32)
        self.symbol_of = np.arange(UNLISTED, UNLISTED + 0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i

    def merge(self, part: str) -> list[str]:
        """The symbols of one part, of any length, when no pair of neighbours is a piece any more."""
        scores, n = self.scores, len(part)
        symbols, left, right = list(part), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(scores[pair], i, 2) for i in range(n - 1) if (pair := part[i : i + 2]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = right[i]
            # a symbol that went into another is empty
            if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (pair := symbols[a] + symbols[b]) in scores:
                    heapq.heappush(agenda, (scores[pair], a, len(pair)))
        return [s for s in symbols if s]

    def merge_equal(self, parts: list[str]) -> np.ndarray:
        """Rows of symbols of parts of one length; 0 ends a row that is shorter. Each row has an agenda, of which the top is taken in every round."""
        n, size = len(parts), len(parts[0])
        symbols = self.symbol_of[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)].reshape(n, size)
        made, score = self._paired(symbols[:, :-1], symbols[:, 1:])
        out, open_ = np.zeros((n, size), np.int64), np.arange(n)
        while len(open_):
            row, width = np.arange(len(open_)), symbols.shape[1]
            top = score.argmin(axis=1) if width > 1 else np.zeros(len(open_), np.int64)
            done = score[row, top] == NO_PAIR if width > 1 else np.ones(len(open_), bool)
            if done.any():
                out[open_[done], :width] = symbols[done]
                open_, symbols, made, score, top = open_[~done], symbols[~done], made[~done], score[~done], top[~done]
                row = np.arange(len(open_))
                if not len(open_):
                    break
            symbols[row, top] = made[row, top]
            keep = np.ones(symbols.shape, bool)
            keep[row, top + 1] = False
            symbols = symbols[keep].reshape(len(row), -1)
            # the entry that was taken goes, and those of its neighbours are new
            keep = np.ones(score.shape, bool)
            keep[row, top] = False
            made, score = made[keep].reshape(len(row), -1), score[keep].reshape(len(row), -1)
            for at in (top - 1, top):
                r = row[(at >= 0) & (at < score.shape[1])]
                k = at[r]
                made[r, k], score[r, k] = self._paired(symbols[r, k], symbols[r, k + 1])
        return out

    def _paired(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair makes, and its place in the order of scores."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return self.pair_makes[at], np.where(self.pair_keys[at] == key, self.pair_order[at], NO_PAIR)

    def ids_of(self, parts: list[str]) -> Iterator[list[int]]:
        """The ids of each part. The agendas of short parts of one length are worked off together."""
        found: dict[str, list[int]] = {}
        by_size = defaultdict(list)
        for part in parts:
            by_size[len(part)].append(part)
        for size, equal in by_size.items():
            for start in range(0, len(equal), TOGETHER) if size <= SHORT else ():
                some = equal[start : start + TOGETHER]
                rows = self.merge_equal(some)
                whole = (rows < UNLISTED).all(axis=1).tolist()
                for part, row, listed, n in zip(some, rows.tolist(), whole, np.count_nonzero(rows, axis=1).tolist(), strict=True):
                    found[part] = row[:n] if listed else [i for x in row[:n] for i in ([x] if x < UNLISTED else self.spelt(chr(x - UNLISTED)))]
            if size > SHORT:
                for part in equal:
                    found[part] = [i for s in self.merge(part) for i in ([self.ids[s]] if s in self.ids else self.spelt(s))]
        return map(found.__getitem__, parts)

    def spelt(self, symbol: str) -> list[int]:
        return [self.byte_ids[b] for b in symbol.encode("utf-8")]

    def parts(self, text: str) -> list[str]:
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def parts_of(self, texts: list[str]) -> list[list[str]]:
        """The parts of each text, which are then known."""
        cut = [self.parts(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh, names = list(set().union(*cut).difference(known)), self.names
        for part, ids in zip(fresh, self.ids_of(fresh), strict=True):
            known[part] = len(ids), ",".join([names[i] for i in ids]), self.plain(ids)
        return cut

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for p in parts for i in self.known[p][1].split(",")] for parts in self.parts_of(texts)]

    def plain(self, ids) -> str:
        """The text of ids within a text. Bytes in a row are read as UTF-8; one that fits nowhere gives U+FFFD."""
        texts = [self.texts[i] for i in ids]
        if self.byte_set.isdisjoint(ids):
            return "".join(texts)
        groups = groupby(texts, lambda x: isinstance(x, int))
        return "".join(utf8_text(bytes(run)) if is_bytes else "".join(run) for is_bytes, run in groups)

    def decode(self, ids) -> str:
        """As the library: the blank that encoding put before the text goes."""
        ids = list(ids)
        first = next((i for i in ids if i not in self.controls), None)
        text = self.plain(ids)
        return text[1:] if first in self.blanks else text


def utf8_text(data: bytes) -> str:
    """``data`` as UTF-8, with U+FFFD for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


def _sent(rows: DataFrame, path: str):
    with open(path, "rb") as f:
        return rows.sparkSession.sparkContext.broadcast(f.read())


def _library(content: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=content)


def _joined(pieces: Pieces, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    """Of each text the number of ids, the ids joined by commas, and the text that they decode to."""
    for parts in pieces.parts_of(texts):
        found = list(map(pieces.known.__getitem__, parts))
        # each text that is not empty begins with a piece that has the blank
        yield sum(map(itemgetter(0), found)), ",".join(map(itemgetter(1), found)), "".join(map(itemgetter(2), found))[1:]


def _by_library(library, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    ids = library.encode(texts, num_threads=1)
    return ((len(x), ",".join(map(str, x)), plain) for x, plain in zip(ids, library.decode(ids, num_threads=1), strict=True))


def _digests(sent, text: str, check_every: int | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sha = Pieces(sent.value), hashlib.sha256
        library = _library(sent.value) if check_every else None
        for batch in slices(batches, text):
            texts, counts, ids, plain = [t or "" for t in batch[text].to_pylist()], [], [], []
            asked = range(0, len(texts), check_every) if check_every else ()
            expected = dict(zip(asked, _by_library(library, [texts[k] for k in asked]), strict=True)) if asked else {}
            for k, own in enumerate(_joined(pieces, texts)):
                if expected.get(k, own) != own:
                    raise ValueError("the ids or the decoded text differ from the sentencepiece library's")
                counts.append(own[0])
                ids.append(sha(own[1].encode()).hexdigest())
                plain.append(sha(own[2].encode()).hexdigest())
            rest = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], [*rest, "n_tokens", "ids_sha256", "decoded_sha256"])

    return work


def digests(docs: DataFrame, path: str, text: str = "text", check_every: int | None = 16) -> DataFrame:
    """The other columns with n_tokens, ids_sha256 and decoded_sha256 of each text. ``check_every``: see above; None checks none."""
    cols = Columns(docs)
    types = cols.with_types(n_tokens=LongType(), ids_sha256=StringType(), decoded_sha256=StringType())
    out = cols.rows.mapInArrow(tidy(_digests(_sent(docs, path), cols[text], check_every)), StructType([f for f in types if f.name != cols[text]]))
    return cols.back(out, (cols[text],), n_tokens="n_tokens", ids_sha256="ids_sha256", decoded_sha256="decoded_sha256")


def _differences(sent, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = Pieces(sent.value), _library(sent.value)
        for batch in slices(batches, text):
            texts = [t or "" for t in batch[text].to_pylist()]
            same = [own == theirs for own, theirs in zip(_joined(pieces, texts), _by_library(library, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], [*batch.schema.names, "same"])

    return work


def differences(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows whose ids or decoded text differ from the sentencepiece library's."""
    cols = Columns(docs)
    found = cols.rows.mapInArrow(tidy(_differences(_sent(docs, path), cols[text])), cols.with_types(same=BooleanType()))
    return cols.back(found.filter("not same"))


def _encode(sent, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in slices(batches, text):
            ids = pieces.encode_batch([t or "" for t in batch[text].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return work


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in ``out``."""
    cols = Columns(docs)
    found = cols.rows.mapInArrow(tidy(_encode(_sent(docs, path), cols[text])), cols.with_types(ids=ArrayType(IntegerType())))
    return cols.back(found, **{out: "ids"})


def _decode(sent, ids: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            plain = [pieces.decode(x or ()) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.string())], [*batch.schema.names, "plain"])

    return work


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in ``out``; null ids give the empty text."""
    cols = Columns(rows)
    found = cols.rows.mapInArrow(tidy(_decode(_sent(rows, path), cols[ids])), cols.with_types(plain=StringType()))
    return cols.back(found, **{out: "plain"})
