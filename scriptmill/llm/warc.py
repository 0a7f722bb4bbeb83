"""WARC archives: a writer that stores equal payloads once, and a reader that trusts only the chain of records.

Writing. Each row is one record. Rows with equal payloads share one stored copy:
the row with the smallest id is a ``response``, rows with larger ids are
``revisit`` records that name it. Only ids and digests are shuffled to find
that out. Records go out through Spark's text writer, whose line separator is
the end of a WARC record, so parts are committed like any Spark output.

Reading. Tasks scan byte ranges for the record magic and emit, for each
candidate, the offset where its successor must start. In each file, pointer
jumping from offset 0 then keeps the candidates that the chain reaches; magic
bytes inside a payload are never reached. Only offsets meet there; headers come
back to what is kept. Payloads are read afterwards, of kept records only. A chain
must end where its file ends: else reading fails and names the place, or, on
request, gives the records before it. ``broken`` lists such files.

Rows: a null payload is empty and a null URL is empty; of rows that repeat the
smallest id all are responses; a row with a null id is a revisit of the
smallest id, or a response if its payload has no other; an empty table gives
no archive and no records; CR, LF and other controls in a URL are
percent-encoded. Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm.common import group_min, open_uri, stored

CRLF = "\r\n"
END = CRLF + CRLF
MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
#: Up to so many revisits (about 60 bytes each) are broadcast to the writer; more are joined by a shuffle.
MAX_BROADCAST = 200_000
RANGE = 8 << 20
#: Payloads of so many bytes, or one that is longer, go out in a batch.
BATCH = 4 << 20
HEADERS = "page_id bigint, record_type string, refers_to bigint, uri string, length bigint, digest string"
CANDIDATES = "file string, at bigint, next bigint, body bigint, size bigint, " + HEADERS
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def revisits(rows: DataFrame) -> DataFrame:
    """Of rows (page_id, digest, length): those that another, smaller id holds already, with refers_to."""
    first = group_min(rows, "digest", "page_id", "refers_to")
    return first.filter(F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row into the folder ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("uri"), body.alias("body"))
    rows = rows.withColumn("digest", sha1_base32(F.col("body"))).withColumn("length", F.octet_length("body"))
    later = stored(revisits(rows.select("page_id", "digest")), "revisits")
    small = later.count() <= MAX_BROADCAST
    right = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), "refers_to")
    rows = rows.join(F.broadcast(right) if small else right, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").drop("_id", "_d")
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    stored_body = F.when(again, F.lit("")).otherwise(F.col("body").cast("string"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html" + CRLF + "Content-Length: "), F.col("length").cast("string"), F.lit(END))
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws(" ", identity, F.col("digest")).cast("binary")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.regexp_replace("uri", "%", "%25"), r"\r", "%0D"), r"\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-Id", identity),
        line("X-Payload-Length", F.col("length").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(stored_body)).cast("string")),
        F.lit(CRLF),
        http,
        stored_body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _header(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def candidates_in(data, start: int, stop: int, size: int) -> Iterator[tuple]:
    """(at, next, body, size, headers...) of each record magic in bytes [start, stop) of a file."""
    data.seek(max(0, start - 4))
    raw = data.read(stop - max(0, start - 4) + 16)
    shift = max(0, start - 4)
    for m in MAGIC.finditer(raw):
        at = shift + m.start()
        if (m.start() == 0 and shift) or not start <= at < stop:
            continue
        head = raw.find(END.encode(), m.end())
        if head >= 0:
            text = raw[m.start() : head]
        else:  # the header crosses the range's end
            data.seek(at)
            text, step = b"", 1 << 16
            while END.encode() not in text and (more := data.read(step)):
                text += more
                if len(text) > 1 << 24:
                    break
            if END.encode() not in text:
                continue
            text = text[: text.index(END.encode())]
        h = _header(text)
        length = _number(h.get("content-length"))
        if length is None or length < 0:
            continue
        body = at + len(text) + 4
        following = body + length + 4
        if following > size:
            continue
        uri = h.get("warc-target-uri", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        yield at, following, body, length, _number(h.get("x-page-id")), h.get("warc-type"), _number(h.get("x-refers-to-page-id")), uri, _number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha1:")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATES.split(",")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in CANDIDATES.split(",")]
    for batch in batches:
        for r in batch.to_pylist():
            with open_uri(r["file"]) as data:
                rows = [(r["file"], *x) for x in candidates_in(data, r["start"], r["stop"], r["size"])]
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def reached(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates (sorted by ``at``) the chain from offset 0 reaches, by pointer jumping in log2(n) rounds."""
    n = len(at)
    jump = np.searchsorted(at, following)
    lost = (jump >= n) | (at[np.minimum(jump, n - 1)] != following)
    jump = np.append(np.where(lost, n, jump), n)
    kept = np.zeros(n + 1, bool)
    kept[0] = n > 0 and at[0] == 0
    for _ in range(max(1, n.bit_length())):
        kept[jump[kept]] = True
        jump = jump[jump]
    return kept[:n]


LINKS = "file string, at bigint, whole boolean"


def _chain(strict: bool):
    """Of one file's candidates (at, next) and its end (at its size): the offsets that the chain reaches, and whether that is the whole file."""

    def work(links: pa.Table) -> pa.Table:
        links = links.sort_by("at")
        at = links["at"].to_numpy()
        kept = reached(at, links["next"].to_numpy())
        whole = bool(kept[-1])
        if strict and not whole:
            after = f"after the record at {at[kept][-1]}" if kept.any() else "at 0"
            raise ValueError(f"{links['file'][0]}: the chain of records breaks {after}; the file has {at[-1]} bytes")
        kept[-1] = False
        out = links.filter(pa.array(kept)).select(["file", "at"])
        if not whole and not kept.any():  # so that a file without any record is known too
            out = pa.table({"file": links["file"][:1], "at": pa.array([-1], pa.int64())})
        return out.append_column("whole", pa.array([whole] * out.num_rows, pa.bool_()))

    return work


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, data, names = None, None, [x.split()[0] for x in HEADERS.split(",")]
    for batch in batches:
        rows, out, start, held = batch.to_pylist(), [], 0, 0
        for k, r in enumerate(rows):
            if r["file"] != name:
                if data:
                    data.close()
                name, data = r["file"], open_uri(r["file"])
            data.seek(r["body"])
            block = data.read(r["size"])
            payload = block[block.index(END.encode()) + 4 :] if block.startswith(b"HTTP/") else block
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if r["record_type"] == "response" and r["digest"] and found != r["digest"]:
                raise ValueError(f"{name} at {r['at']}: the payload's digest is {found}, its header says {r['digest']}")
            out.append(payload if r["record_type"] == "response" else None)
            held += len(payload)
            if held >= BATCH or k == len(rows) - 1:
                part = pa.Table.from_batches([batch.slice(start, len(out))]).select(names)
                yield from part.append_column("payload", pa.array(out, pa.binary())).combine_chunks().to_batches()
                out, start, held = [], k + 1, 0
    if data:
        data.close()


def _candidates(spark: SparkSession, path: str, span: int) -> tuple[DataFrame, DataFrame]:
    """All candidates, stored, and the links of each file: (file, at, next) of its candidates and of its end."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0")
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / span).cast("bigint")))
    ranges = files.select("file", "size", starts.alias("k")).select("file", "size", (F.col("k") * span).alias("start"), F.least("size", (F.col("k") + 1) * span).alias("stop"))
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "start")
    found = stored(ranges.mapInArrow(_scan, CANDIDATES), "candidates")
    ends = files.select("file", F.col("size").alias("at"), (F.col("size") + 1).alias("next"))
    return found, found.select("file", "at", "next").union(ends)


def read(spark: SparkSession, path: str, span: int = RANGE, strict: bool = True) -> DataFrame:
    """The records of all archives in the folder ``path``: page_id, record_type, refers_to, uri, length, digest, payload (null for revisits).

    Files are cut into ranges of ``span`` bytes. The links of one file, 16 bytes
    a candidate, meet in one task, bounded by the archive's size. A damaged file
    (a cut record, a header without end or length, no record at all) is an
    error; with ``strict`` off the records before the damage are read.
    """
    found, links = _candidates(spark, path, span)
    kept = links.groupBy("file").applyInArrow(_chain(strict), LINKS).select(F.col("file").alias("_file"), F.col("at").alias("_at"))
    rows = found.join(kept, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))).drop("_file", "_at")
    return rows.mapInArrow(_payloads, HEADERS + ", payload binary")


def broken(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    """file and at, the offset of the last record reached (-1: none), of each archive whose chain ends before the file."""
    _, links = _candidates(spark, path, span)
    return links.groupBy("file").applyInArrow(_chain(False), LINKS).filter("not whole").groupBy("file").agg(F.max("at").alias("at"))
