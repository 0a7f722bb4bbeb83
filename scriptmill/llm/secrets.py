"""Secret scans by a recursive decoding worklist.

A text is layer 0. Each layer is scanned for three kinds of secrets and for
encoded pieces: percent-encoding, Unicode escapes (backslash-u, backslash-x and
numeric character references), base64 in one run or over line breaks, and gzip,
zlib, bzip2, xz or Zstandard streams inside base64. The whole layer with its
percent-encoding decoded, the whole layer with its escapes decoded, and what each
base64 piece stands for (as UTF-8, or else byte by byte) go onto the worklist as
layers of their own, until nothing new comes up. A decoded layer keeps the place
in the original text of each of its code points, and secrets found in it are
reported at those places. A layer that was seen before at the same places ends
its branch; the same text at another place is a layer of its own. Decoding makes
a layer shorter, except for decompression, whose code points all have one place:
so cycles come back to a layer at the same places, and stop. What base64 stands for is made
piece by piece, when all that came of the piece before is done with, so the worklist holds
no long text's pieces together; places take eight bytes a code point, and of a layer that
was looked at a digest stays.

Escapes are decoded segment by segment: between segments stand signs that no
secret, escape or base64 piece can hold in any layer, so the layers of all
segments have together the secrets of the whole layers. Nothing bounds how deep
escapes are nested. A segment with one sign that begins an escape is a chain:
its layers differ where the escape was, and only what begins there is looked at
again, so the work of a chain stays in proportion to it. A segment of several
such signs takes its length for each of its layers.

Rows: a null or empty text has no spans; repeated rows each give a result of
their own; an empty table gives an empty one. A stream that inflates beyond
WINDOW characters is scanned whole, in windows that overlap by OVERLAP: only a
single match, or a piece wrapped again, that is longer than OVERLAP may be cut
there. Other columns are not read by :func:`scan`, and both functions keep them,
whatever their names; _base, _spans and _n_layers of :func:`scan` replace columns
called the same.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scriptmill.llm.common import Columns, slices, tidy

WINDOW, OVERLAP = 8 << 20, 64 << 10
ZSTANDARD = b"\x28\xb5\x2f\xfd"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: A run of either alphabet, its pieces of the common one, and runs over line breaks.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_PART = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+\r?\n[\x20\t]*+)++[A-Za-z0-9+/_-]++={0,2}")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the secrets in plain sight."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Same:
    """Places of code points that all have the same one."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __getitem__(self, k):
        return [self.place] if isinstance(k, slice) else self.place


def _opener(data: bytes):
    """Makes a decompressor for the stream that data begins with, if it is one."""
    if data[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return lambda: zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\0":
        return lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)
    if data[:4] == ZSTANDARD:
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    return None


def _inflate(data: bytes) -> Iterator[bytes]:
    """What the streams (one or more in a row) hold, in blocks of at most WINDOW bytes; up to where one is damaged."""
    while data and (make := _opener(data)):
        stream, rest = make(), data
        try:
            if isinstance(stream, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                while not stream.eof and (rest or not stream.needs_input):
                    block, rest = stream.decompress(rest, WINDOW), b""
                    yield block
            elif data[:4] == ZSTANDARD:  # has no bound for its output: 4 bytes may stand for 128 KB
                for k in range(0, len(rest), 64):
                    yield stream.decompress(rest[k : k + 64])
                    if stream.eof:
                        rest = stream.unused_data + rest[k + 64 :]
                        break
            else:
                while rest and not stream.eof:
                    yield stream.decompress(rest, WINDOW)
                    rest = stream.unconsumed_tail
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            return
        data = rest if data[:4] == ZSTANDARD and stream.eof else stream.unused_data


def _text(blocks: Iterator[bytes]) -> Iterator[str]:
    """The bytes as texts of some WINDOW code points, which overlap: UTF-8 as long as it is that, then byte by byte."""
    reader, held = codecs.getincrementaldecoder("utf-8")(), ""

    def plain(block: bytes, final: bool = False) -> str:
        nonlocal reader
        before = reader.getstate()[0] if reader else b""
        try:
            return reader.decode(block, final) if reader else block.decode("latin-1")
        except UnicodeDecodeError:
            reader = None
            return (before + block).decode("latin-1")

    for block in blocks:
        held += plain(block)
        if len(held) >= WINDOW:
            yield held
            held = held[-OVERLAP:]
    held += plain(b"", True) if reader else ""
    if held:
        yield held


def _unescape(piece: str) -> int:
    body = piece.strip("\\&#;")
    return int(body.strip("ux{}X"), 16) if body[0] in "uxX" else int(body)


def _utf8(data: bytes) -> Iterator[tuple[str, int]]:
    """The code points and how many bytes each takes; U+FFFD for each byte that fits nowhere."""
    for c in data.decode("utf-8", "surrogateescape"):
        yield ("\ufffd", 1) if 0xDC80 <= ord(c) <= 0xDCFF else (c, len(c.encode()))


def _layer(text: str, pieces: Iterator[tuple[int, int, list[tuple[int, int, int]]]]) -> Iterator[tuple[str, list[int], list[int]]]:
    """The whole text with its pieces (start, end, code points with start and end) decoded, if it has any."""
    out, starts, ends, at = [], [], [], 0
    for lo, hi, decoded in pieces:
        out.append(text[at:lo])
        starts += range(at, lo)
        ends += range(at + 1, lo + 1)
        for code, s, e in decoded:
            if out[-1] and 0xDC00 <= code <= 0xDFFF and 0xD800 <= ord(out[-1][-1]) <= 0xDBFF:
                out[-1] = out[-1][:-1] + chr(0x10000 + (ord(out[-1][-1]) - 0xD800 << 10) + code - 0xDC00)
                ends[-1] = e
            else:
                out.append(chr(code)), starts.append(s), ends.append(e)
        at = hi
    if at:
        out.append(text[at:])
        starts += range(at, len(text))
        ends += range(at + 1, len(text) + 1)
        yield "".join(out), starts, ends


def _unwrap_unicode(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """The text with all its escapes decoded, with the start and end in ``text`` of each code point."""

    def pieces():
        for m in UNICODE.finditer(text):
            code = _unescape(m[0])
            yield m.start(), m.end(), [(code if code <= 0x10FFFF else 0xFFFD, m.start(), m.end())]

    return _layer(text, pieces())


def _unwrap_url(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """The text with all its percent-encoding decoded."""

    def pieces():
        for p in URL.finditer(text):
            decoded, i = [], p.start()
            for c, wide in _utf8(bytes.fromhex(p[0].replace("%", ""))):
                decoded.append((ord(c), i, i + 3 * wide))
                i += 3 * wide
            yield p.start(), p.end(), decoded

    return _layer(text, pieces())


def _decoded(token: str) -> tuple[bytes, bool] | None:
    """The bytes of a base64 token, and whether they begin a compressed stream."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None
    return data, _opener(data) is not None


def _unwrap_base64(text: str) -> Iterator[tuple[str, array | Same, array | Same]]:
    """Whole runs, or else what stands between their signs, and runs over line breaks."""
    block = 0
    for m in BASE64.finditer(text):
        yield from _opened(text, range(m.start(), m.end()))
        if any(c in m[0] for c in "+/_-"):
            for p in BASE64_PART.finditer(text, m.start(), m.end()):
                yield from _opened(text, range(p.start(), p.end()))
        if m.start() >= block and (lines := WRAPPED.match(text, m.start())):
            block = lines.end()
            yield from _opened(text, array("i", [lines.start() + k for k, c in enumerate(lines[0]) if c not in " \t\r\n"]))


def _opened(text: str, at) -> Iterator[tuple[str, array | Same, array | Same]]:
    """What the token of the characters at these places stands for."""
    found = _decoded("".join([text[i] for i in at]) if isinstance(at, array) else text[at[0] : at[-1] + 1])
    if found is None:
        return
    data, packed = found
    if packed:
        for plain in _text(_inflate(data)):
            yield plain, Same(at[0]), Same(at[-1] + 1)
    try:
        plain, sizes = data.decode(), None
    except UnicodeDecodeError:
        plain, sizes = data.decode("latin-1"), 1
    starts, ends, i = array("i"), array("i"), 0
    for c in plain:
        j = i + (sizes or len(c.encode()))
        starts.append(at[i * 8 // 6])
        ends.append(at[min(-(-j * 8 // 6), len(at)) - 1] + 1)
        i = j
    if plain:
        yield plain, starts, ends


def _through(places, at, shift: int = 0):
    """The places in the text of places in a layer."""
    if isinstance(at, Same):
        return Same(at.place if places is None else places[at.place - shift])
    if places is None or isinstance(places, Same):
        return at if places is None else places
    return array("i", [places[i - shift] for i in at])


#: Signs that begin an escape; runs of all signs that escapes are made of; what may stand between segments.
STARTERS = re.compile(r"[%\\&]")
ESCAPES = re.compile(rf"{URL.pattern}|{UNICODE.pattern}")
ESCAPE_RUN = re.compile(r"[%\\&#;{}uxX0-9A-Fa-f]+")
HARD = re.compile("[^A-Za-z0-9+/_.=:\"'\\x20\\t\\r\\n%\\\\{}&#;\ud800-\udfff-]")
BREAK = re.compile(rf"{HARD.pattern}|[\x20\t\r\n]+")
RUN = re.compile(r"[A-Za-z0-9+/_-]*")
PART = re.compile(r"[A-Za-z0-9]*")
HEX_RUN = re.compile(r"[0-9a-f]*")
KEYWORD = re.compile(r"(?=password|passwd|secret|token|api_?key)", re.ASCII | re.IGNORECASE)


def _divides(layer: str, lo: int, hi: int, active: list[tuple[int, int]]) -> bool:
    """Whether no match of any layer goes over this break; ``active`` are the runs with escapes, in order."""
    k = bisect_left(active, (lo, lo))
    left, right = active[k - 1][1] if k else -1, k < len(active) and active[k][0] == hi
    if layer[lo] not in " \t\r\n":
        return True
    if any(c in "\t\r\n" for c in layer[lo:hi]):  # only a wrapped piece goes over line breaks, and its lines have 16 signs
        long = RUN.match(layer[max(lo - 16, 0) : lo][::-1]).end() > 15
        return not right and not RUN.match(layer, hi)[0] or left < lo - 16 and not long
    return left < lo and not right and layer[lo - 1 : lo] not in (":", "=") and layer[hi : hi + 1] not in (":", "=")


def _segments(layer: str) -> list[tuple[int, int]]:
    """The parts of the layer with escapes that are independent of each other in all layers made of it."""
    if not ("%" in layer and URL.search(layer) or ("\\" in layer or "&#" in layer) and UNICODE.search(layer)):
        return []
    active, last = [], 0
    for m in ESCAPES.finditer(layer):
        if m.start() >= last:
            lo = m.start()
            while lo > last and ESCAPE_RUN.match(layer[lo - 1]):
                lo -= 1
            last = ESCAPE_RUN.match(layer, lo).end()
            active.append((lo, last))
    cuts = (m.span() for m in BREAK.finditer(layer) if _divides(layer, *m.span(), active))
    out, k, at = [], 0, 0
    for lo, hi in chain(cuts, [(len(layer), len(layer))]):
        if k < len(active) and active[k][0] < lo:
            out.append((at, lo))
            while k < len(active) and active[k][0] < lo:
                k += 1
        at = hi
    return out


class Chain:
    """The layers of a segment with one sign that begins an escape, as long as what it makes is such a sign.

    Before the sign nothing changes, and behind it only the first signs go from
    layer to layer. So of each layer only what begins behind the sign is new.
    """

    def __init__(self, text: str, at: int) -> None:
        self.text, self.at, self.n = text, at, 0
        self.spans: list[tuple[int, int, int]] = []
        self.made: list[tuple[str, array | Same, array | Same]] = []
        self.keywords = [m.start() for m in KEYWORD.finditer(text, at)]
        self.known: set[int] = set()
        self.aligned: set[tuple[int, int]] = set()
        self.ends: dict[re.Pattern, int] = {}
        self._assigned(at + 1), self._tokens(at + 1)
        head, behind = text[at], at + 1
        while m := ESCAPES.match(head + text[behind : behind + 12]):
            behind += len(m[0]) - 1
            ((head, _, _),) = [*_unwrap_url(m[0]), *_unwrap_unicode(m[0])]
            if not STARTERS.match(head):
                places = array("i", [*range(at), at, *range(behind, len(text))])
                ends = array("i", [*range(1, at + 1), behind, *range(behind + 1, len(text) + 1)])
                self.made.append((text[:at] + head + text[behind:], places, ends))
                return
            self.n += 1
            if (end := self._end(HEX_RUN, behind)) - behind >= 16:
                self.spans.append((behind, 2, end))
            found = text.find("AKIA", behind)
            if found >= 0 and (m := ACCESS.match(text, found)) and m.end() - found >= 18:
                self.spans.append((found, 1, m.end()))
            self._assigned(behind), self._tokens(behind)

    def _end(self, kind: re.Pattern, at: int) -> int:
        if self.ends.get(kind, -1) < at:
            self.ends[kind] = kind.match(self.text, at).end()
        return self.ends[kind]

    def _assigned(self, at: int) -> None:
        """Assignments from here to the first that was met before, behind which all are the same."""
        for k in range(bisect_left(self.keywords, at), len(self.keywords)):
            start = self.keywords[k]
            if start < at:
                continue
            if start in self.known:
                return
            if m := ASSIGN.match(self.text, start):
                self.known.add(start)
                at = m.end()
                if m.end(2) - m.start(2) >= 12:
                    self.spans.append((start, 0, at))

    def _tokens(self, at: int) -> None:
        """The layers of the base64 piece that begins here."""
        ends = {self._end(RUN, at), self._end(PART, at)}
        for end in ends:
            if end - at >= 16:
                self._token(at, end + min(2, len(self.text[end : end + 2]) - len(self.text[end : end + 2].lstrip("="))))

    def _token(self, at: int, end: int) -> None:
        """What the token stands for, or only its beginning, if it is the end of one that was met before."""
        size = 64 if (end, at % 4) in self.aligned and not _decoded(self.text[at : at + 16])[1] else end - at
        self.aligned.add((end, at % 4))
        while size < end - at:
            begin = _decoded(self.text[at : at + size])[0].decode("latin-1")
            if m := HARD.search(begin, 0, len(begin) - 3):
                if m.start():
                    starts = array("i", [at + i * 8 // 6 for i in range(m.start())])
                    self.made.append((begin[: m.start()], starts, array("i", [at + -(-(i + 1) * 8 // 6) for i in range(m.start())])))
                return
            size *= 4
        self.made += _opened(self.text, range(at, end))


def _unescaped(layer: str) -> Iterator[tuple[int, list[tuple[int, int, int]], list]]:
    """Of each segment: how many layers were done with, their spans, and the layers to go on with, at places of ``layer``."""
    for lo, hi in _segments(layer):
        part = layer[lo:hi]
        signs = [m.start() for m in STARTERS.finditer(part)]
        if len(signs) == 1 and "\n" not in part:
            deep = Chain(part, signs[0])
            n, spans, made = deep.n, deep.spans, deep.made
        else:
            n, spans, made = 0, [], [*_unwrap_url(part), *_unwrap_unicode(part)]
        moved = lambda at: Same(at.place + lo) if isinstance(at, Same) else array("i", [x + lo for x in at])  # noqa: B023, E731
        yield n, [(s + lo, k, e + lo) for s, k, e in spans], [(plain, moved(x), moved(y)) for plain, x, y in made]


def _digest(plain: str, lo, hi) -> bytes:
    out = hashlib.sha256(plain.encode("utf-8", "surrogatepass") + b"\xff")
    for x in (lo, hi):
        out.update(repr(x.place).encode() if isinstance(x, Same) else x)
    return out.digest()


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """The spans of layer 0, those of all layers, and the number of layers (of decoded segments, and what base64 stands for)."""
    base, every, n, seen = base_spans(text), set(), 0, set()

    def inside(layer: str, starts, ends) -> Iterator[tuple]:
        for plain, lo, hi in _unwrap_base64(layer):
            yield plain, _through(starts, lo), _through(ends, hi, 1)

    work: list[tuple | Iterator[tuple]] = [(text, None, None)]
    while work:
        found = work.pop() if isinstance(work[-1], tuple) else next(work[-1], None)
        if found is None:
            work.pop()
            continue
        layer, starts, ends = found
        if starts is not None and (key := _digest(*found)) in seen:
            continue
        if starts is not None:
            seen.add(key)
        n += 1
        place = lambda spans: spans if starts is None else [(min(starts[s:e]), k, max(ends[s:e])) for s, k, e in spans]  # noqa: B023, E731
        every.update(place(base if starts is None else base_spans(layer)))
        for done, spans, made in _unescaped(layer):
            n += done
            every.update(place(spans))
            work += [(plain, _through(starts, lo), _through(ends, hi, 1)) for plain, lo, hi in made]
        work.append(inside(*found))
    return base, sorted(every), n


def digest_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shape = lambda x: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x]
        for batch in slices(batches, text):
            found = [all_spans(t or "") for t in batch[text].to_pylist()]
            cols = [pa.array([shape(x[0]) for x in found], kind), pa.array([shape(x[1]) for x in found], kind), pa.array([x[2] for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "base", "spans", "n_layers"])

    return work


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _base and _spans (kind, start, end in code points of the text, end exclusive) and _n_layers."""
    cols = Columns(docs)
    out = cols.rows.mapInArrow(tidy(_scan(cols[text])), cols.with_types(base=SPANS, spans=SPANS, n_layers=IntegerType()))
    return cols.back(out, _base="base", _spans="spans", _n_layers="n_layers")


def _redact(text: str, mark: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for t in batch[text].to_pylist():
                for lo, hi in reversed(merged((s, e) for s, _, e in all_spans(t or "")[1])):
                    t = t[:lo] + mark + t[hi:]
                out.append(t)
            yield batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(out, batch.schema.field(text).type))

    return work


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of a secret, in whatever layer it was found, replaced by ``mark``."""
    cols = Columns(docs)
    return cols.back(cols.rows.mapInArrow(tidy(_redact(cols[text], mark)), cols.rows.schema))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans: str):
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
