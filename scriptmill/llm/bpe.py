"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary is a file of a public tokenizer, named by a parameter: byte-level
BPE with word ends, NFC, white space runs to one space and lower case before it.
The distinct words of a batch become one flat array of symbols. A round looks up
all adjacent pairs in the sorted pair keys by binary search, takes in each word
the pair of lowest rank at every place where it stands, from the left without
overlap, and merges them all; words without a known pair are done. Words of more
than LONG bytes are an array of their own, in which a round takes the lowest rank
of all words (they don't touch each other, so the order within each is the same),
goes to the places kept for that rank, and looks up only the pairs that it changed.
So a word takes its length and a round a rank, not their product. Words are
remembered up to a bound, then forgotten.

Which characters are letters, and how they are normalised, depends on the
version of Unicode. Texts with characters beyond those settled long ago are
normalised and cut by the tokenizers library itself; the merges are the same.

Rows: a null or empty text has no ids and decodes to the empty text; repeated
rows each give a result of their own; an empty table gives an empty one; texts
of any length are encoded whole. Other columns are kept, whatever their names,
but for those called like the results, which these replace.

The driver reads the vocabulary's file once and broadcasts it; a task parses it, and
keeps nothing when it ends.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from tokenizers import Tokenizer

from scriptmill.llm.common import Columns, slices, tidy

#: Distinct words that a task remembers at a time.
REMEMBERED = 150_000
#: Bytes above which a word's places are kept by rank.
LONG = 1024
END = "</w>"
#: Characters outside the ranges in which all versions of Unicode in use agree.
UNSETTLED = regex.compile(r"[^\x00-\u052F\u2010-\u2027\u2030-\u205E\u20A0-\u20B5\u2190-\u23F3\u2500-\u26FF]")


def _settled_word() -> re.Pattern:
    """How the tokenizer cuts words (fixed value: endings, runs of letters, single numbers, runs of other signs), for the settled characters."""
    sets = {k: "".join(re.escape(chr(c)) for c in range(0x530) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{sets['L']}]+|[{sets['N']}]|[^\t-\r \x85\xa0{sets['L']}{sets['N']}]+")


SETTLED_WORD = _settled_word()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, content: str | None = None) -> None:
        """``content``: that of the file, if it has been read already."""
        if content is None:
            with open(path, encoding="utf-8") as f:
                content = f.read()
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        added = sorted(spec["added_tokens"], key=lambda x: x["id"])
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in added}
        self.special = {x["content"]: x["id"] for x in added}
        self.cut = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
        self.library = Tokenizer.from_str(content)
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + END] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        # of equal pairs the last rule holds, as in a map filled in order
        last = np.append(keys[order][1:] != keys[order][:-1], True)
        self.keys, self.ranks, self.made = keys[order][last], order[last].astype(np.int64), made[order][last]
        self.by_rank = np.full(len(order), -1, np.int64)
        self.by_rank[self.ranks] = np.arange(len(self.ranks))
        self.names = [str(i) for i in range(max(self.tokens) + 1)]
        #: Of each word its ids, their number, and ids and tokens joined by spaces.
        self.known: dict[str, tuple[array, int, str, str]] = {}

    def normalize(self, text: str) -> str:
        """NFC and lower case; white space needs no care, since no word has any."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8") for w in words]
        long = [k for k, x in enumerate(raw) if len(x) > LONG]
        out = self._merge_flat([x for x in raw if len(x) <= LONG])
        for k, ids in zip(long, self._merge_long([raw[k] for k in long]) if long else [], strict=True):
            out.insert(k, ids)
        return out

    def _merge_long(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by rounds over the places of one rank; a word is followed by a place without a symbol (-1)."""
        ends = np.cumsum([len(x) + 1 for x in raw])
        symbols = np.full(ends[-1], -1, np.int64)
        for x, end in zip(raw, ends, strict=True):
            data = np.frombuffer(x, np.uint8)
            symbols[end - 1 - len(x) : end - 1] = self.inner[data]
            symbols[end - 2] = self.last[data[-1]]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[-1] = len(symbols) - 1
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        waiting: list[int] = []

        def look_up(at: np.ndarray) -> None:
            pair = symbols[at] << 32 | symbols[after[at]]
            k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            fits = self.keys[k] == pair
            at, rank = at[fits], self.ranks[k[fits]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)] if len(rank) else [0]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                r = int(rank[lo])
                if r not in places:
                    heapq.heappush(waiting, r)
                places[r].append(at[lo:hi])

        look_up(np.arange(len(symbols)))
        while waiting:
            r = heapq.heappop(waiting)
            k = self.by_rank[r]
            left, right = self.keys[k] >> 32, self.keys[k] & 0xFFFFFFFF
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at):
                # of places in a row every other one counts from the left
                n = np.arange(len(at))
                head = np.maximum.accumulate(np.where(np.append(True, at[1:] != after[at[:-1]]), n, 0))
                at = at[(n - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = self.made[k], -1
            after[at] = after[gone]
            before[after[at]] = at
            look_up(np.unique(np.concatenate([before[at], at])))
        found = [symbols[end - 1 - len(x) : end - 1] for x, end in zip(raw, ends, strict=True)]
        return [x[x >= 0] for x in found]

    def _merge_flat(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by rounds over all words."""
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), sizes)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(raw)
        none = np.iinfo(np.int64).max
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            fits = (word[:-1] == word[1:]) & (self.keys[at] == pair)
            rank = np.append(np.where(fits, self.ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(word)))
            done = best == none
            if done.any():
                for s, n in zip(starts[done], lengths[done], strict=True):
                    out[word[s]] = symbols[s : s + n]
                open_ = np.repeat(~done, lengths)
                symbols, word, rank, at = symbols[open_], word[open_], rank[open_], np.append(at, 0)[open_]
                best, lengths = best[~done], lengths[~done]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            take = rank == np.repeat(best, lengths)
            # of places in a row (a pair of equal symbols) every other one counts from the left
            run = np.flatnonzero(take)
            fresh = np.append(True, run[1:] != run[:-1] + 1)
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            run = run[(np.arange(len(run)) - head) % 2 == 0]
            symbols[run] = self.made[at[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        for w, ids in zip(fresh, self.merge(fresh) if fresh else [], strict=True):
            self.known[w] = self.entry(ids.tolist())

    def entry(self, ids: list[int]) -> tuple[array, int, str, str]:
        names = self.names
        return array("i", ids), len(ids), " ".join([names[i] for i in ids]), self.decode(ids)

    def plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return SETTLED_WORD.findall(text.lower())
        if not UNSETTLED.search(text):
            normal = self.normalize(text)
            if not UNSETTLED.search(normal):  # composing or lower-casing may leave the ranges
                return SETTLED_WORD.findall(normal)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in w).decode("utf-8") for w, _ in cut]

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain_words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.plain_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain_words(text[at:])

    def words_of(self, texts: list[str]) -> list[list[str]]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for s, i in self.special.items():
            self.known[s] = self.entry([i])
        self.learn(set().union(*cut))
        return cut

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[i for w in words for i in self.known[w][0]] for words in self.words_of(texts)]

    def decode(self, ids) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder does; unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def _sent(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _digests(sent, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = Bpe("", sent.value), hashlib.sha256
        for batch in slices(batches, text):
            counts, ids, plain = [], [], []
            for words in bpe.words_of([t or "" for t in batch[text].to_pylist()]):
                found = list(map(bpe.known.__getitem__, words))
                counts.append(sum(map(itemgetter(1), found)))
                ids.append(sha(" ".join(map(itemgetter(2), found)).encode()).hexdigest())
                plain.append(sha(" ".join(map(itemgetter(3), found)).encode()).hexdigest())
            rest = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(counts, pa.int64()), pa.array(ids), pa.array(plain)], [*rest, "n_tokens", "ids_sha256", "decoded_sha256"])

    return work


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The other columns with n_tokens, ids_sha256 and decoded_sha256 of each text."""
    cols = Columns(docs)
    types = cols.with_types(n_tokens=LongType(), ids_sha256=StringType(), decoded_sha256=StringType())
    out = cols.rows.mapInArrow(tidy(_digests(_sent(docs, path), cols[text])), StructType([f for f in types if f.name != cols[text]]))
    return cols.back(out, (cols[text],), n_tokens="n_tokens", ids_sha256="ids_sha256", decoded_sha256="decoded_sha256")


def _encode(sent, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe("", sent.value)
        for batch in slices(batches, text):
            ids = bpe.encode_batch([t or "" for t in batch[text].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return work


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in ``out``."""
    cols = Columns(docs)
    found = cols.rows.mapInArrow(tidy(_encode(_sent(docs, path), cols[text])), cols.with_types(ids=ArrayType(IntegerType())))
    return cols.back(found, **{out: "ids"})


def _decode(sent, ids: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe("", sent.value)
        for batch in batches:
            plain = [bpe.decode(x or ()) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.string())], [*batch.schema.names, "plain"])

    return work


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in ``out``; null ids give the empty text."""
    cols = Columns(rows)
    found = cols.rows.mapInArrow(tidy(_decode(_sent(rows, path), cols[ids])), cols.with_types(plain=StringType()))
    return cols.back(found, **{out: "plain"})
