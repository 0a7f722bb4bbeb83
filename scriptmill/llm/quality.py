"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are its pairs of neighbouring bytes, by classes of bytes, with
square-root weights, and a few marks of repetition: words equal to the one
before, words and lines seen before. A bounded sample of labelled rows gives
the latent space (singular vectors of their term matrix) and the labelled
vectors; both are broadcast, and their sizes follow from the parameters alone.
Every document's vector is multiplied with all labelled ones in blocks, and its
``neighbours`` most similar vote with their similarity.

The sample is the ``max_labelled`` labelled ids of least hash, at most
MAX_LABELLED; everything else covers all rows.

Rows: a null or empty text is scored like any other, by its (empty) terms;
labels that repeat an id are averaged, null labels and ids are left out; of texts
that repeat a labelled id the least one, by its bytes, is learned from; without
labels every score is 0.5; repeated rows each get a score; an empty table gives
an empty one. Columns other than the text never enter a score; they are kept,
whatever their names, but for one called _score, which the score replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scriptmill.llm.common import Columns, slices, tidy, utf8

MAX_LABELLED, LATENT, NEIGHBOURS = 4000, 64, 15
THRESHOLD = 0.3


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters in either case, digits, each ASCII sign and space, lead and trail bytes."""
    out = np.zeros(256, np.int64)
    signs = {c: k for k, c in enumerate(sorted({*range(128)} - {*range(48, 58), *range(65, 91), *range(97, 123), *range(0, 32), 127} | {9, 10, 13}))}
    for b in range(256):
        low = b + 32 if 65 <= b < 91 else b
        if 97 <= low < 123:
            out[b] = low - 97
        elif 48 <= b < 58:
            out[b] = 26
        elif b in signs:
            out[b] = 30 + signs[b]
        else:
            out[b] = 27 if b < 128 else 28 if b < 0xC0 else 29
    return out, 30 + len(signs)


CLASS, N_CLASSES = _classes()
MARKS = 6
DIMS = N_CLASSES * N_CLASSES + MARKS


def terms(texts: list[bytes]) -> np.ndarray:
    """A row of square-root weighted terms for each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    kinds = CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    pairs = N_CLASSES * N_CLASSES
    same = owner[:-1] == owner[1:]
    codes = (owner[:-1] * pairs + kinds[:-1] * N_CLASSES + kinds[1:])[same]
    counts = np.bincount(codes, minlength=len(texts) * pairs).reshape(len(texts), pairs)
    out = np.zeros((len(texts), DIMS), np.float32)
    out[:, :pairs] = np.sqrt(counts / np.maximum(1, sizes - 1)[:, None])
    for k, t in enumerate(texts):
        words, lines = t.lower().split(), [x for x in t.split(b"\n") if x]
        n = max(1, len(words))
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        seen = 1 - len(set(words)) / n if words else 0.0
        lines_seen = 1 - len(set(lines)) / len(lines) if lines else 0.0
        out[k, pairs:] = again**0.5, max(0.0, seen - 0.6), lines_seen**0.5, float(not t), 0.02 * np.log1p(len(t)), 0.05
    return out


#: Bytes of text whose term rows, some 20 KB a text, a task holds at a time.
PIECE = 1 << 20


def _term_rows(text: str, keep: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PIECE):
            found = terms([utf8(t) for t in batch[text].to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array([x.tobytes() for x in found], pa.binary())], [*keep, "terms"])

    return work


def singular_vectors(rows: np.ndarray, latent: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    axes = np.random.default_rng(0).standard_normal((rows.shape[1], latent + 16)).astype(np.float32)
    for _ in range(rounds):
        axes, _ = np.linalg.qr(rows.T @ (rows @ axes))
    _, _, right = np.linalg.svd(rows @ axes, full_matrices=False)
    return np.ascontiguousarray((axes @ right.T)[:, :latent]).astype(np.float32)


class Voter:
    """Labelled vectors in the latent space; picklable."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> None:
        self.labels, self.neighbours = labels.astype(np.float32), min(neighbours, len(labels))
        if len(labels):
            self.axes = singular_vectors(rows, latent)
            self.vectors = self.place(rows)

    def place(self, rows: np.ndarray) -> np.ndarray:
        out = rows @ self.axes
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def scores(self, texts: list[bytes], block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = []
        for k in range(0, len(texts), block):
            near = self.place(terms(texts[k : k + block])) @ self.vectors.T
            if self.neighbours < near.shape[1]:
                best = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
            else:
                best = np.broadcast_to(np.arange(near.shape[1]), near.shape)
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(np.float64) ** 8
            out.append((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1))
        return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Voter:
    """Learns from labelled rows; at most ``max_labelled`` term rows reach the driver."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).filter("_id is not null and _y is not null")
    known = known.groupBy("_id").agg(F.avg("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(min(max_labelled, MAX_LABELLED))
    cols = Columns(docs)
    rows = cols.rows.select(F.col(cols[doc_id]).alias("_id"), F.col(cols[text]).cast("string").alias("_t")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min(F.coalesce("_t", F.lit(""))).alias("_t"))
    rows = rows.mapInArrow(_term_rows("_t", ["_id", "_y"]), "_id bigint, _y double, terms binary").toArrow().sort_by("_id")
    matrix = np.frombuffer(b"".join(rows["terms"].to_pylist()), np.float32).reshape(-1, DIMS)
    return Voter(matrix, rows["_y"].to_numpy(), latent, neighbours)


def _score(voter, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PIECE):
            found = voter.value.scores([utf8(t) for t in batch[text].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return work


def score(docs: DataFrame, voter: Voter, text: str = "text") -> DataFrame:
    """``docs`` with _score, from 0 to 1: higher, label 1 likelier."""
    cols = Columns(docs)
    return cols.back(_scored(cols, voter, text), _score="score")


def keep(docs: DataFrame, voter: Voter, least: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is ``least`` or more."""
    cols = Columns(docs)
    return cols.back(_scored(cols, voter, text).filter(F.col("score") >= least))


def _scored(cols: Columns, voter: Voter, text: str) -> DataFrame:
    sent = cols.rows.sparkSession.sparkContext.broadcast(voter)
    return cols.rows.mapInArrow(tidy(_score(sent, cols[text])), cols.with_types(score=DoubleType()))


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
