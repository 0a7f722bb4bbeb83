"""Media columns: a custom Spark data source over folders of archives.

A media member is a lossless image: the payload (the text's UTF-8 bytes, with
bytes 0 appended up to a positive multiple of 64) as 8-bit grey samples, 64 a
row, in PNG. Members are stored in zip archives of bounded size. Each write commits by
one more list of its finished archives with their sizes, a file ``_archives-*.json`` of its
own, so what failed tasks left is never read, writes add up (one after the other or at once),
a write that fails before its list is there leaves the folder as it was, and
ranges are planned without opening an archive. Mode ``overwrite`` drops the older lists
once its own is there.

Reading plans byte ranges over the archives: a task takes the members that
start in its range, streams them through Arrow in batches of bounded size, and
retries each member on its own, by its offset, with a fresh handle.

Rows: a null or empty text is 64 bytes 0 with n_bytes 0; equal texts give equal
members; a null id stays null and repeated ids stay apart; an empty table gives
no archive and no rows. Other columns are not stored. Archives need a path that
pyarrow or the operating system can open.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scriptmill.llm.common import local_path, open_uri, slices, utf8

FORMAT = "scriptmill_media"
WIDTH, LEVEL = 64, 3
RANGE, BATCH = 8 << 20, 4 << 20
#: A writing task starts a new archive beyond so many bytes, so that the directory that each range reads stays small.
ARCHIVE = 128 << 20
RETRIES = 3
MANIFEST = "_archives-"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "doc_id bigint, archive string, at bigint, media binary"
MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes) -> bytes:
    rows = max(1, -(-len(data) // WIDTH))
    grid = np.zeros((rows, WIDTH + 1), np.uint8)
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    grid[:, 1:] = flat.reshape(rows, WIDTH)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"bytes\0%d" % len(data))
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(grid.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the number of bytes before padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, rows, n, body = 8, 0, 0, 0, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", data)
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            n = int(data[6:])
        elif kind == b"IDAT":
            body.append(data)
        at += size + 12
    grid = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if grid[:, 0].any():
        raise ValueError("rows are filtered")
    return grid[:, 1:].tobytes(), n


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    spread = max(0.0, float(counts @ (values * values)) / len(x) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).sum()) / max(1, len(x) - 1)
    return f"mean={mean:.4f};std={spread:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};step={step:.4f}"


def _create(uri: str):
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def manifests(path: str) -> list[str]:
    """The lists of the committed writes in a folder, as URIs."""
    if (folder := local_path(path)) is not None:
        names = os.listdir(folder) if os.path.isdir(folder) else []
    else:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
    return sorted(f"{path}/{x}" for x in names if x.startswith(MANIFEST) and x.endswith(".json"))


def _remove(uri: str) -> None:
    if (path := local_path(uri)) is not None:
        os.unlink(path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.delete_file(path)


class _Committed(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int]]) -> None:
        self.archives = archives


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, limit: int, overwrite: bool = False) -> None:
        self.path, self.limit, self.overwrite = path, limit, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Committed:
        done, rows = [], self._members(iterator)
        for first in rows:
            name = f"part-{uuid.uuid4().hex}.zip"
            with _create(f"{self.path}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    self._fill(archive, first, rows)
                done.append((name, out.tell()))
        return _Committed(done)

    @staticmethod
    def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches, "text"):
            yield from zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)

    def _fill(self, archive: zipfile.ZipFile, member: tuple | None, rows: Iterator[tuple]) -> None:
        """``member`` and those after it, until the archive is full."""
        size = 0
        while member is not None:
            key, text = member
            data = encode_png(utf8(text))
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # repeated ids
                archive.writestr(zipfile.ZipInfo(f"{'null' if key is None else key}.png"), data)
            size += len(data)
            member = next(rows, None) if size < self.limit else None

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        before, own = manifests(self.path) if self.overwrite else [], f"{self.path}/{MANIFEST}{uuid.uuid4().hex}.json"
        data = json.dumps(sorted(x for m in messages if m for x in m.archives)).encode()
        # a local file takes its name when it is whole; other stores show a file when it is closed
        path = local_path(own)
        with _create(f"{own}.part" if path else own) as f:
            f.write(data)
        if path:
            os.replace(f"{path}.part", path)
        for old in before:
            _remove(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name, _ in (x for m in messages if m for x in m.archives):
            _remove(f"{self.path}/{name}")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int) -> None:
        self.archive, self.start, self.stop = archive, start, stop


def read_member(archive: str, info: zipfile.ZipInfo, retries: int = RETRIES) -> bytes:
    """A stored member by its offset, checked; each try opens the archive anew."""
    for k in range(retries):
        try:
            with open_uri(archive) as f:
                return _member(f, info)
        except (OSError, ValueError):
            if k == retries - 1:
                raise
            time.sleep(0.1 * 2**k)
    raise AssertionError


def _member(f, info: zipfile.ZipInfo) -> bytes:
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {info.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(info.header_offset + 30 + name + extra)
    data = f.read(info.file_size)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError(f"the member at {info.header_offset} is damaged")
    return data


class MediaReader(DataSourceReader):
    def __init__(self, path: str, span: int) -> None:
        self.path, self.span = path, span

    def partitions(self) -> list[_Range]:
        lists = manifests(self.path)
        if not lists:
            raise ValueError(f"nothing was written to {self.path}")
        archives = []
        for uri in lists:
            with open_uri(uri) as f:
                archives += json.loads(f.read())
        out = [_Range(f"{self.path}/{name}", k, min(size, k + self.span)) for name, size in archives for k in range(0, size, self.span)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        with open_uri(partition.archive) as f:
            members = [x for x in zipfile.ZipFile(f).infolist() if partition.start <= x.header_offset < partition.stop]
            rows, size = [], 0
            for info in sorted(members, key=lambda x: x.header_offset):
                try:
                    data = _member(f, info)
                except (OSError, ValueError):
                    data = read_member(partition.archive, info)
                key = info.filename.removesuffix(".png")
                rows.append((None if key == "null" else int(key), partition.archive, info.header_offset, data))
                size += len(data)
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "archive", "at", "media"])


class MediaSource(DataSource):
    """Options: path, span (bytes of an archive that a reading task takes) and limit (bytes of members beyond which a new archive is begun)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("span", RANGE)))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"], int(self.options.get("limit", ARCHIVE)), overwrite)


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = ARCHIVE, mode: str = "append") -> None:
    """Stores every text as a member of the archives in the folder ``path``, besides those that are there or (``overwrite``) in their place."""
    docs.sparkSession.dataSource.register(MediaSource)
    docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).write.format(FORMAT).mode(mode).option("limit", str(limit)).save(path)


def read(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    """doc_id, archive, at (offset) and media of all members."""
    spark.dataSource.register(MediaSource)
    return spark.read.format(FORMAT).option("span", str(span)).load(path)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MEDIA.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "bigint" else pa.string() for x in MEDIA.split(", ")]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        rows = []
        for key, media in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
            payload, n = decode_png(media)
            rows.append((key, n, len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), feature_of(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def describe(members: DataFrame) -> DataFrame:
    """Digests and features of the payloads, read back from the stored members."""
    return members.select("doc_id", "media").mapInArrow(_describe, MEDIA)
