"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def warc(rows):
    """rows: (page_id, payload bytes)."""
    first = defaultdict(list)
    for page, body in rows:
        first[body].append(page)
    out = []
    for page, body in rows:
        ids = [x for x in first[body] if x is not None]
        least = min(ids) if ids else None
        again = least is not None and (page is None or page > least)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", least if again else None))
    return out


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def components(ids_and_fps, radius=4):
    fps = sorted({f for _, f in ids_and_fps})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in ids_and_fps:
        r = find(f)
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return {(d, f): least[find(f)] for d, f in ids_and_fps}


def removed(docs, window=20):
    """docs: (doc_id, text) -> per row (doc_id, n_words, n_removed, kept sha256)."""
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            g, at = tuple(w[i : i + window]), (key(d), i)
            first[g] = min(first.get(g, at), at)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (key(d), i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination(docs, bench, n=13):
    windows = defaultdict(set)
    for item, t in bench:
        w = words(lower(t), BENCH_WORD)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, items = words(lower(t), BENCH_WORD), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found is not None:
                    hit.update(range(i, i + size))
                    items |= found
        listed = sorted(str(x) for x in items if x is not None)
        out.append((d, len(w), len(hit), len(listed), sha(",".join(listed)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def unigram(docs):
    import math

    counts, train = defaultdict(int), [t for d, t in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    for t in train:
        for w in [*words(lower(t)), None]:
            counts[w] += 1
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        ws = [*words(lower(t)), None]
        out.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def every_span(text, depth=12):
    """Spans of all layers, by unwrapping lists of (character, start, end) again and again; one base64 run at a time."""
    found, seen = set(), set()
    escape = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")

    def visit(cells, left):
        plain = "".join(c for c, _, _ in cells)
        if tuple(cells) in seen or not left:
            return
        seen.add(tuple(cells))
        for s, k, e in base_spans(plain):
            found.add((min(x[1] for x in cells[s:e]), k, max(x[2] for x in cells[s:e])))
        out, at = [], 0
        for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", plain):
            out += cells[at : m.start()]
            i = m.start()
            for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
                j = i + 3 * len(c.encode("utf-8", "surrogateescape"))
                c = "\ufffd" if "\udc80" <= c <= "\udcff" else c
                out.append((c, cells[i][1], cells[j - 1][2]))
                i = j
            at = m.end()
        visit(out + cells[at:], left - 1)
        out, at = [], 0
        for m in escape.finditer(plain):
            code = int(m[4]) if m[4] else int(next(x for x in m.groups() if x), 16)
            out += [*cells[at : m.start()], (chr(min(code, 0x10FFFF)), cells[m.start()][1], cells[m.end() - 1][2])]
            at = m.end()
        visit(out + cells[at:], left - 1)
        for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", plain):
            try:
                data = base64.b64decode(m[0].rstrip("=") + "=" * (-len(m[0].rstrip("=")) % 4))
                inner = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else None
            except (ValueError, zlib.error):
                continue
            data = data if inner is None else inner
            try:
                body, sizes = data.decode(), None
            except UnicodeDecodeError:
                body, sizes = data.decode("latin-1"), 1
            part, i = [], 0
            for c in body:
                j = i + (sizes or len(c.encode()))
                a, b = (m.start() + i * 4 // 3, m.start() + -(-j * 4 // 3)) if inner is None else (m.start(), m.end())
                part.append((c, cells[a][1], cells[b - 1][2]))
                i = j
            visit(part, left - 1)

    visit([(c, i, i + 1) for i, c in enumerate(text)], depth)
    return sorted(found)


def context_tree(learned, texts, depth):
    """log10 of each text's probability by context-tree weighting, straight from the definition (255 stands before and behind a text)."""
    import math

    def samples(text):
        data = [255] * depth + list(lower(text).encode()) + [255]
        return [(tuple(data[i - 1 : i - depth - 1 : -1] if i > depth else data[i - 1 :: -1][:depth]), data[i]) for i in range(depth, len(data))]

    def log_pw(counts, ctx=()):
        """counts: (context, nearest first) -> [zeros, ones] of one decision."""
        z, o = counts.get(ctx, (0, 0))
        kt = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
        if len(ctx) == depth:
            return kt
        below = sum(log_pw(counts, c) for c in counts if len(c) == len(ctx) + 1 and c[:-1] == ctx)
        return math.log(0.5) + max(kt, below) + math.log1p(math.exp(-abs(kt - below)))

    known = [x for t in learned for x in samples(t)]

    def counted(prefix, more=()):
        out = {}
        for history, byte in [*known, *more]:
            bits = f"{byte:08b}"
            if bits.startswith(prefix):
                for d in range(depth + 1):
                    z, o = out.get(history[:d], (0, 0))
                    out[history[:d]] = (z + (bits[len(prefix)] == "0"), o + (bits[len(prefix)] == "1"))
        return out

    out = []
    for t in texts:
        total = 0.0
        for history, byte in samples(t):
            for k in range(8):
                prefix = f"{byte:08b}"[:k]
                total += log_pw(counted(prefix, [(history, byte)])) - log_pw(counted(prefix))
        out.append(total / math.log(10))
    return out


def near_copies(docs, n=5, least=0.8):
    """The smallest id of each id's group of texts that share so much of their word shingles, over all pairs."""
    sets = []
    for d, t in docs:
        w = words(lower(t))
        sets.append((d, {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    root = {d: d for d, _ in sets}
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if len(a & b) >= least * len(a | b):
                low, high = sorted((root[d], root[e]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root
