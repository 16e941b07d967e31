"""Secret scans with a recursive decoding worklist.

Each text is scanned, then its URL, Unicode-escape, base64 and compressed parts
are unwrapped into new layers, which are scanned and unwrapped in turn until no
new layer appears.  A layer that repeats one of its ancestors is not followed
(cycle detection).  Every layer maps its spans back to the original text.

Compressed data unpack as a stream, whose windows overlap and end outside of
encoded runs: nothing is cut off, and memory follows the window and the longest
encoded run, not the size of what is unpacked.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import map_rows, read_table

#: Kinds in the order of the contract.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|equals|colon);)+")
_UNIT = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uxU]([0-9A-Fa-f]+)|(&[^;]+;)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

Span = tuple[str, int, int]
Place = Callable[[int, int], tuple[int, int]]


def scan(text: str) -> list[Span]:
    """Secrets of one layer: ``(kind, start, end)`` in code points, end exclusive."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _inline(text: str, pattern: re.Pattern, units: Callable[[str], list[tuple[str, int]] | None]) -> tuple[str, Place] | None:
    """Replace each run of ``pattern`` by its characters; ``units`` gives them with the source length of each."""
    parts: list[str] = []
    at: list[int] = []  # start of each segment in the new text
    segments: list[tuple[int, list[int] | None]] = []  # its source start, for decoded runs the source offsets of its characters
    done = size = 0
    for m in pattern.finditer(text):
        got = units(m.group())
        if not got:
            continue
        if m.start() > done:
            parts.append(text[done : m.start()])
            at.append(size)
            segments.append((done, None))
            size += m.start() - done
        offsets, off = [], 0
        for c, n in got:
            offsets += [off] * len(c)
            off += n
            parts.append(c)
        at.append(size)
        segments.append((m.start(), [*offsets, off]))
        size += len(offsets)
        done = m.end()
    if not segments:
        return None
    parts.append(text[done:])
    at.append(size)
    segments.append((done, None))

    def place(start: int, end: int) -> tuple[int, int]:
        def edge(i: int, last: bool) -> int:
            k = bisect.bisect_right(at, i) - 1
            source, offsets = segments[k]
            if offsets is None:
                return source + i - at[k] + last
            i -= at[k]
            if last:  # the end of the unit that made this character
                following = i + 1
                while offsets[following] == offsets[i]:
                    following += 1
                return source + offsets[following]
            return source + offsets[i]

        return edge(start, False), edge(end - 1, True)

    return "".join(parts), place


def _url_units(run: str) -> list[tuple[str, int]] | None:
    try:
        decoded = bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape")
    except ValueError:
        return None
    return [(c, 3 * len(c.encode(errors="surrogateescape"))) for c in decoded]


def _escape_units(run: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    high, high_n = 0, 0
    for m in _UNIT.finditer(run):
        if m[3]:
            c = html.unescape(m[3])
        else:
            code = int(m[1] or m[2], 16)
            if 0xD800 <= code < 0xDC00:
                high, high_n = code, len(m.group())
                continue
            if 0xDC00 <= code < 0xE000 and high:
                code = 0x10000 + (high - 0xD800 << 10) + code - 0xDC00
            c = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        out.append((c, len(m.group()) + high_n))
        high = high_n = 0
    return out


#: Bytes that go into and come out of a decompressor at once, and those of a window.
_IN, _OUT, WINDOW, OVERLAP = 1 << 16, 1 << 20, 1 << 24, 1 << 16


class _Feed:
    """Pieces of bytes, read in any portions."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.taken = iter(pieces), b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, None)) is not None:
            self.held += more
        return self.held[:n]

    def read(self, n: int = _IN) -> bytes:
        self.peek(1)
        got, self.held = self.held[:n], self.held[n:]
        self.taken += len(got)
        return got

    def back(self, data: bytes) -> None:
        self.held = data + self.held
        self.taken -= len(data)


def _decompressor(head: bytes):
    """A decompressor for gzip, zlib, bzip2, xz or zstd data that start like ``head``; None for others."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor()
    return None


def _member(one, feed: _Feed) -> Iterator[bytes]:
    """What one member of ``feed`` unpacks to, as far as it is whole."""
    if hasattr(one, "stream_reader"):
        import zstandard

        try:
            with one.stream_reader(feed, read_size=_IN, read_across_frames=True) as reader:
                while got := reader.read(_OUT):
                    yield got
        except zstandard.ZstdError:
            pass
        return
    while not one.eof:
        data = b""
        if getattr(one, "needs_input", True) and not (data := getattr(one, "unconsumed_tail", b"") or feed.read()):
            break
        try:
            got = one.decompress(data, _OUT)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        if got:
            yield got
    if one.eof:
        feed.back(one.unused_data)
    elif hasattr(one, "flush"):
        yield one.flush()


def _members(feed: _Feed, raw: bool = False) -> Iterator[bytes]:
    """What all members at the start of ``feed`` unpack to; ``raw`` for deflate data without a header."""
    if raw:
        yield from _member(zlib.decompressobj(-15), feed)
    while (one := _decompressor(feed.peek(6))) is not None:
        yield from _member(one, feed)


def _unpacked(data: bytes, raw: bool = False) -> tuple[_Feed, _Feed]:
    """The data as they are fed, and what they unpack to through all compressed layers that lie directly in each other."""
    source = inner = _Feed(data[k : k + _IN] for k in range(0, len(data), _IN))
    heads = set()
    while raw or (_decompressor(inner.peek(6)) is not None and inner.peek(4096) not in heads):  # a head that returns is a cycle
        heads.add(inner.peek(4096))
        inner, raw = _Feed(_members(inner, raw)), False
    return source, inner


#: A byte that is part of no encoded run, nor of the gap between its lines.
_APART = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f!\"$'()*,.:<>?@\[\]^`|~\x7f]|(?<=[^\s]) |\n(?=\n)|\x20{512}")


def _last_apart(data: bytes) -> int:
    """Where the last such byte of ``data`` ends, 0 if there is none."""
    back = 1 << 12
    while True:
        start = max(0, len(data) - back)
        ends = [m.end() for m in _APART.finditer(data, start)]
        if ends or not start:
            return ends[-1] if ends else 0
        back *= 16


def _windows(feed: _Feed, size: int = WINDOW) -> Iterator[bytes]:
    """All of ``feed`` in windows of about ``size`` bytes; an encoded run lies in one window, the ``OVERLAP`` bytes before a window's start are also in the one before it."""
    held, need = b"", size
    while True:
        parts, n = [held], len(held)
        while n < need and (more := feed.read(_OUT)):
            parts.append(more)
            n += len(more)
        held = b"".join(parts)
        if n < need:
            if held:
                yield held
            return
        end = _last_apart(held)
        start = _last_apart(held[: max(0, end - OVERLAP)])
        if start:
            yield held[:end]
            held, need = held[start:], size
        else:
            need = 2 * n  # all one run so far


#: Fewer printable characters in a row hold neither a secret nor an encoded one.
_HOLDS = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12}|(?:\x00[\t\n\r\x20-\x7e]){12}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
#: How compressed data starts in base64: gzip, bzip2, xz, zstd, zlib.
_MAGIC = re.compile(r"H4sI|Qlpo|/Td6WFo|KLUv/|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")


def _bytes_of(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run + "=" * (-len(run) % 4))


def _readings(data: bytes) -> Iterator[tuple[str, Callable[[int], int]]]:
    """Texts that ``data`` may be, each with the map of its places to bytes: UTF-8 with odd bytes, UTF-16 of either order."""
    if _HOLDS.search(data):
        text = data.decode(errors="surrogateescape")
        yield text, _byte_places(text, len(data), 0, False)
    for order in sorted({("be" if m.group()[0] == 0 else "le", m.start() % 2) for m in _WIDE.finditer(data)}):
        name, odd = order
        text = data[odd : len(data) - (len(data) - odd) % 2].decode(f"utf-16-{name}", errors="replace")
        yield text, _byte_places(text, len(data), odd, True)


def _byte_places(text: str, size: int, first: int, wide: bool) -> Callable[[int], int]:
    """Byte place of each character place of a text that takes ``size`` bytes and starts at byte ``first``."""
    if not wide and len(text) == size:
        return lambda x: x
    places: list[np.ndarray] = []

    def at(x: int) -> int:
        if not places:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            if wide:
                sizes = 2 + 2 * (code > 0xFFFF)
            else:
                sizes = np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
            places.append(np.concatenate([[first], first + np.cumsum(sizes)]))
        return int(places[0][x])

    return at


def _base64_layers(text: str) -> Iterator[tuple[str, Place]]:
    """Layers of each run, and of runs that go on over line ends, at all four alignments; compressed data wherever it starts."""
    for m in itertools.chain(_BASE64.finditer(text), _WRAPPED.finditer(text)):
        gaps = list(_BREAK.finditer(m.group()))
        at: range | np.ndarray = range(*m.span())  # source place of each character of the run
        if gaps:
            keep = np.ones(len(m.group()), bool)
            for gap in gaps:
                keep[gap.start() : gap.end()] = False
            at = m.start() + np.flatnonzero(keep)
        run = _BREAK.sub("", m.group()).rstrip("=").translate({45: 43, 95: 47})

        def unpacked(k: int, raw: bool, at=at, run=run, m=m) -> Iterator[tuple[str, Place]]:
            data = _bytes_of(run[k:])
            source, inner = _unpacked(data, raw)
            if raw and not _HOLDS.search(inner.peek(256)):
                return
            first = list(itertools.islice(_windows(inner), 2))
            if len(first) > 1:  # the first pass only finds where the data end
                for _ in _windows(inner):
                    pass
            last = k - (-source.taken * 4 // 3)
            span = int(at[k]), m.end() if last >= len(run) - 1 or not source.taken else int(at[last - 1]) + 1
            for window in first if len(first) < 2 else _windows(_unpacked(data, raw)[1]):
                for layer, _ in _readings(window):
                    yield layer, lambda a, b, span=span: span

        for k in range(4):
            for layer, byte in _readings(_bytes_of(run[k:])):

                def place(a: int, b: int, layer: str = layer, byte=byte, at=at, k: int = k, e: int = m.end()) -> tuple[int, int]:
                    return int(at[k + byte(a) * 4 // 3]), e if b == len(layer) else int(at[k - (-byte(b) * 4 // 3) - 1]) + 1

                yield layer, place
            if len(run) >= 24:
                yield from unpacked(k, True)
        for start in _MAGIC.finditer(run):
            yield from unpacked(start.start(), False)


def layers(text: str) -> Iterator[tuple[str, Place]]:
    """The layers directly below ``text``, each with the map of its spans to spans of ``text``."""
    if "%" in text and (got := _inline(text, _URL, _url_units)):
        yield got
    if ("\\" in text or "&" in text) and (got := _inline(text, _ESCAPE, _escape_units)):
        yield got
    yield from _base64_layers(text)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of ``text`` and all spans, those of decoded layers included, both in contract order.

    The worklist goes depth first, so one window of each nested layer is held at a time.
    """

    def mark(layer: str) -> bytes:
        return hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    base = scan(text)
    spans = set(base)
    work: list[tuple[Iterator[tuple[str, Place]], Place, bytes]] = [(layers(text), lambda a, b: (a, b), b"")]
    seen: set[tuple[bytes, int, int]] = set()
    while work:
        below, where, own = work[-1]
        if (got := next(below, None)) is None:
            work.pop()
            continue
        inner, place = got
        if not inner or len(inner) == len(text) and inner == text:
            continue
        origin = where(*place(0, len(inner)))
        digest = mark(inner)
        if any(digest == above for *_, above in work) or (digest, *origin) in seen:
            continue
        seen.add((digest, *origin))
        to_text = lambda a, b, place=place, where=where: where(*place(a, b))
        spans.update((kind, *to_text(a, b)) for kind, a, b in scan(inner))
        work.append((layers(inner), to_text, digest))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_assign, n_access, n_hex, base_sha256, spans``.

    Counts and digest are of the text's own (base) spans; ``spans`` has also those
    of decoded layers, mapped to the text.  A null text counts as empty (no spans,
    empty string); null ids and repeated rows are kept; other columns are not read.
    """

    def make():
        def work(cols):
            counts: list[list] = [[], [], []]
            digest, spans = [], []
            for text in cols[1]:
                base, every = find(text or "")
                for n, kind in zip(counts, KINDS):
                    n.append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            return [cols[0], *counts, digest, spans]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every found span, decoded layers' included, replaced by ``mark``; touching spans become one mark."""
    spans = sorted((a, b) for _, a, b in find(text)[1])
    parts, done, last = [], 0, -1
    for a, b in spans:
        if a > last:
            parts += [text[done:a], mark]
        last = max(last, b)
        done = max(done, b)
    return "".join(parts) + text[done:]


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs`` with the secrets of ``text_col`` replaced by ``mark``.

    ``size_col``, where there is such a column, is set to the new length.  A null
    text stays null, and so does its ``size_col``; repeated rows and all other
    columns, whatever their names, stay as they are.
    """
    names = docs.columns
    t = names.index(text_col)
    n = names.index(size_col) if size_col in names else None

    def make():
        def work(cols):
            texts = [None if x is None else redact(x, mark) for x in cols[t]]
            out = list(cols)
            out[t] = texts
            if n is not None:
                out[n] = [old if new is None or new == was else len(new) for old, new, was in zip(cols[n], texts, cols[t])]
            return out

        return work

    return map_rows(docs, names, docs.schema, make, sized=t)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
