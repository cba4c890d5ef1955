"""Secret scans with a worklist of decoded layers.

A text is scanned; encoded segments (URL escapes, Unicode escapes, base64, compressed
data) go to a worklist, are unwrapped and scanned in turn until no new layer appears.
Layers seen before (same content at the same place) are not taken up again, which ends
cycles. A secret in an inner layer is reported with its span in the original text: that
of its own letters where all layers are escapes, else that of the innermost base64 or
compressed segment that holds it.

Results for special cases: null and empty texts have no spans; equal rows have equal
results; a null doc_id is passed on; further columns are ignored; an empty table gives an
empty result; long texts are read whole and inflated layers too, as long as one fits in
memory. Every pass over a layer takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.common import over_texts, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter one can't hide a longer
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# what can be unwrapped; base64 of 12 bytes or more, the length of the shortest secret
RUN = re.compile(r"[^\s\"'<>]+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
HEADS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x20\x5e\x7d\x9c\xbb\xda\xf9]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){6,}+[\t\n\r\x20-\x7e]?|(?:\x00[\t\n\r\x20-\x7e]){6,}+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
#: Where the letters of a layer stand in the original: one span for all, or starts and ends.
Place = tuple[int, int] | tuple[list[int], list[int]]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    lower, out = text.lower(), []
    if any(w in lower for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _expanded(raw: memoryview) -> tuple[bytes, int]:
    """The data that compressed bytes begin with, all its members, and where they end."""
    head, out, at = bytes(raw[:2]), [], 0
    while at < len(raw) and bytes(raw[at : at + 2]) == head:
        tool = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZ": bz2.BZ2Decompressor, b"\xfd7": lzma.LZMADecompressor}.get(head, lambda: zlib.decompressobj(15))()
        try:
            out.append(tool.decompress(raw[at:]))
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        at = len(raw) - len(tool.unused_data)
    return b"".join(out), at


def _inflated(raw: bytes) -> list[bytes]:
    """Compressed data that starts anywhere in bytes, or the bytes as raw deflated data."""
    out, done, view = [], 0, memoryview(raw)
    for m in HEADS.finditer(raw):
        if m.start() >= done:
            data, size = _expanded(view[m.start() :])
            if data:
                out.append(data)
                done = m.start() + size
    if not out:
        tool = zlib.decompressobj(-15)
        try:
            data = tool.decompress(raw)
        except zlib.error:
            return []
        if tool.eof and not tool.unused_data and data:
            out.append(data)
    return out


def readings(raw: bytes) -> list[str]:
    """Texts that bytes hold: themselves, and what is compressed in them, to any depth.
    Bytes that aren't UTF-8 are read as Latin-1; ASCII letters with a NUL at every second
    place, as UTF-16 has them, are read without."""
    out, work, seen = [], [raw], set()
    while work:
        data = work.pop()
        digest = hashlib.blake2b(data, digest_size=12).digest()
        if digest in seen:
            continue
        seen.add(digest)
        try:
            out.append(data.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "latin-1", "replace"))
            work += _inflated(data)
        if b"\0" in data:
            out += [m[0].replace(b"\0", b"").decode("ascii") for m in WIDE.finditer(data)]
    return out


def _unpacked(body: str) -> list[str]:
    """What base64 in a run of its letters holds. A path or a word with a hyphen may run
    straight into it, so the run is read from each of the first four letters: one of them
    is in step with the data wherever it starts; what comes before reads as noise."""
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    out: list[str] = []
    for first in range(4):
        part = body[first:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        if first and len(part) < 16:
            break
        try:
            out += readings(base64.b64decode(part + "=" * (-len(part) % 4), validate=True))
        except (binascii.Error, ValueError):
            continue
    return out


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, joined lines) of wrapped base64: lines of one width, with and without
    the line before them, which may start after other words, and a shorter last one."""
    out = []
    for m in LINES.finditer(text):
        lines = [(x.start(), x.end(), x[0]) for x in LINE.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and len(lines[j][2]) == len(lines[i][2]):
                j += 1
            short = j < len(lines) and len(lines[j][2]) < len(lines[i][2])
            for a in {max(0, i - 1), i}:
                for b in {j, j + short}:
                    if b - a > 1:
                        out.append((lines[a][0], lines[b - 1][1], "".join(x[2] for x in lines[a:b])))
            i = j
    return out


def _from_percent(run: str) -> tuple[str, list[int], list[int], bytes]:
    """The run without URL escapes, where each letter starts and ends, and its bytes."""
    raw, starts, ends, at = bytearray(), [], [], 0
    for m in (*PERCENT.finditer(run), None):
        upto = m.start() if m else len(run)
        for k in range(at, upto):
            part = run[k].encode("utf-8", "surrogatepass")
            raw += part
            starts += [k] * len(part)
            ends += [k + 1] * len(part)
        if m:
            raw.append(int(m[1], 16))
            starts.append(m.start())
            ends.append(m.end())
            at = m.end()
    text = raw.decode("utf-8", "surrogateescape")
    sizes = [1 if "\ud800" <= c <= "\udfff" else len(c.encode()) for c in text]
    firsts = list(accumulate(sizes, initial=0))[:-1]
    return text, [starts[k] for k in firsts], [ends[k + n - 1] for k, n in zip(firsts, sizes, strict=True)], bytes(raw)


def _from_escapes(run: str) -> tuple[str, list[int], list[int]]:
    out, starts, ends, at = [], [], [], 0
    for m in (*ESCAPE.finditer(run), None):
        upto = m.start() if m else len(run)
        out += run[at:upto]
        starts += range(at, upto)
        ends += range(at + 1, upto + 1)
        if m:
            c = chr(int(m[1] or m[2], 16))
            if out and "\ud800" <= out[-1] < "\udc00" <= c <= "\udfff":  # two halves of a letter
                out[-1] = (out[-1] + c).encode("utf-16", "surrogatepass").decode("utf-16")
                ends[-1] = m.end()
            else:
                out.append(c)
                starts.append(m.start())
                ends.append(m.end())
            at = m.end()
    return "".join(out), starts, ends


def layers(text: str) -> list[tuple[Place, str]]:
    """(place, content) of every encoded segment, each unwrapped once."""
    out: list[tuple[Place, str]] = []
    percent, escape = "%" in text, "\\u" in text or "\\x" in text
    for m in RUN.finditer(text) if percent or escape else ():
        run, at, end = m[0], m.start(), m.end()
        if percent and PERCENT.search(run):
            inner, starts, ends, raw = _from_percent(run)
            out.append((([at + k for k in starts], [at + k for k in ends]), inner))
            out += [((at, end), x) for data in _inflated(raw) for x in readings(data)]
        if escape and ESCAPE.search(run):
            inner, starts, ends = _from_escapes(run)
            out.append((([at + k for k in starts], [at + k for k in ends]), inner))
            if max(inner) < "\u0100":
                out += [((at, end), x) for data in _inflated(inner.encode("latin-1")) for x in readings(data)]
    for m in BASE64.finditer(text):
        out += [((m.start(), m.end()), x) for x in _unpacked(m[0])]
    if "\n" in text:
        for start, end, body in blocks(text):
            if len(body) >= 16:
                out += [((start, end), x) for x in _unpacked(body)]
    return out


def _within(place: Place, start: int, end: int) -> tuple[int, int]:
    """The span in the original of a span of a layer."""
    first, last = place
    return (first[start], last[end - 1]) if isinstance(first, list) else (first, last)


def all_spans(text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], int]:
    """Base spans and those of inner layers, and the number of layers unwrapped."""
    spans, work = set(base), [x for x in layers(text) if x[1]]
    seen: set[tuple[int, int, bytes]] = set()
    done = 0
    while work:
        place, inner = work.pop()
        key = (*_within(place, 0, len(inner)), hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=12).digest())
        if key in seen:
            continue
        seen.add(key)
        done += 1
        spans.update((*_within(place, a, b), kind) for a, b, kind in base_spans(inner))
        for (first, last), deeper in layers(inner):
            if not deeper:
                continue
            if isinstance(first, list) and isinstance(place[0], list):
                first, last = [place[0][k] for k in first], [place[1][k - 1] for k in last]
            elif isinstance(first, list):
                first, last = place
            else:
                first, last = _within(place, first, last)
            work.append(((first, last), deeper))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])), done


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base spans by kind, their digest, all spans, layers."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]
            for text in texts_of(batch):
                base = base_spans(text)
                spans, done = all_spans(text, base)
                for k, kind in enumerate(KINDS):
                    cols[k].append(sum(s[2] == kind for s in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(spans))
                cols[5].append(done)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])

        return work

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
    return over_texts(docs.select("doc_id", "text"), make, schema)
