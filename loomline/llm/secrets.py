"""Secrets in texts, also under nested URL, Unicode, base64 and compressed layers.

Each text is the first item of a worklist.  Scanning an item adds its spans;
decoding it adds new items; an item seen before ends there, so cycles end too.
Every layer keeps where in the original text each of its characters comes from.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines; a line break may be indented.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*")
#: How gzip and zlib data begin.
_COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_URL_SAFE = str.maketrans("-_", "+/")
#: Inflated data are scanned in windows of so many bytes, each of which begins with the
#: last bytes of the one before.  What stands in a window is found whole; a compressed
#: layer inside inflated data is inflated from its first window on.
WINDOW, OVERLAP = 4 << 20, 1 << 16
MASK = "[SECRET]"

Span = tuple[int, int, int]  # start, kind, end: in the order of results


def scan(text: str) -> list[Span]:
    """The base spans of one layer, leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and, for each of its characters, the span of the original it comes from.

    ``lo`` and ``hi`` are arrays, or numbers where all characters come from one span.
    """

    def __init__(self, text: str, lo: np.ndarray | int | None = None, hi: np.ndarray | int | None = None) -> None:
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[start:end].min()), int(self.hi[start:end].max())

    def origins(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.lo is None:
            at_ = np.arange(start, end)
            return at_, at_ + 1
        if isinstance(self.lo, int):
            return np.full(end - start, self.lo), np.full(end - start, self.hi)
        return self.lo[start:end], self.hi[start:end]

    def rewritten(self, runs: re.Pattern, decode) -> Layer | None:
        """This layer with all runs decoded in place; a decoded character comes from its whole run."""
        if isinstance(self.lo, int):
            to = runs.sub(lambda m: m[0] if (x := decode(m[0])) is None else x, self.text)
            return None if to == self.text else Layer(to, self.lo, self.hi)
        parts, lo, hi, last = [], [], [], 0
        for m in runs.finditer(self.text):
            if (to := decode(m[0])) is None:
                continue
            a, b = self.origins(last, m.start())
            x, y = self.span(m.start(), m.end())
            parts += [self.text[last : m.start()], to]
            lo += [a, np.full(len(to), x)]
            hi += [b, np.full(len(to), y)]
            last = m.end()
        if not parts:
            return None
        a, b = self.origins(last, len(self.text))
        return Layer("".join([*parts, self.text[last:]]), np.concatenate([*lo, a]), np.concatenate([*hi, b]))


def _unescaped(run: str) -> str | None:
    points = [int(x, 16) for x in re.findall(r"\\[ux]([0-9A-Fa-f]{2,4})", run)]
    return "".join(map(chr, points)).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip or zlib data inflate to, in pieces of :data:`WINDOW` at most and never held whole.

    All members of gzip data count, each with what follows it until the next; broken
    or truncated data give what comes before the break.  Nothing if they inflate to nothing.
    """
    unzip, kind = None, 31
    for piece in pieces:
        while piece:
            if unzip is None:
                if not _COMPRESSED.match(piece):
                    return
                kind = 31 if piece[:1] == b"\x1f" else 15
                unzip = zlib.decompressobj(kind)
            try:
                out = unzip.decompress(piece, WINDOW)
                while out:
                    yield out
                    out = unzip.decompress(unzip.unconsumed_tail, WINDOW) if not unzip.eof else b""
            except zlib.error:
                return
            piece, unzip = (unzip.unused_data, None) if unzip.eof else (b"", unzip)


def _innermost(pieces: Iterator[bytes], depth: int = 0) -> Iterator[bytes]:
    """``pieces``, inflated as often as they are compressed data from their first byte on."""
    pieces = iter(pieces)
    first = next(pieces, b"")
    if depth < 100 and _COMPRESSED.match(first):
        inner = _innermost(_inflated(chain([first], pieces)), depth + 1)
        if got := next(inner, b""):
            yield got
            yield from inner
        else:
            yield first
        return
    if first:
        yield first
        yield from pieces


def _inflated_layers(data: bytes, lo: int, hi: int) -> Iterator[Layer]:
    """The text in compressed data as layers of overlapping windows, all of them from ``lo:hi``."""
    held = b""
    for piece in _innermost(_inflated(iter([data]))):
        held += piece
        while len(held) >= WINDOW + OVERLAP:
            yield Layer(held[: WINDOW + OVERLAP].decode(errors="replace"), lo, hi)
            held = held[WINDOW:]
    if held:
        yield Layer(held.decode(errors="replace"), lo, hi)


def _unbased(run: str) -> str | None:
    """The text of a base64 run that is text from its first byte to its last; null if it is not."""
    body = run.rstrip("=").translate(_URL_SAFE)
    if len(body) % 4 == 1:
        return None
    try:
        text = base64.b64decode(body + "=" * (-len(body) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _shifted(layer: Layer, start: int, end: int, clean: bool) -> Iterator[Layer]:
    """Base64 that begins anywhere in ``start:end``, lines joined, bytes that are no text replaced.

    A decoded character comes from the characters that hold its bytes, an inflated
    one from all from where its data begin.  ``clean``: the run as a whole is told already.
    """
    places = np.array([i for i in range(start, end) if layer.text[i] not in " \t\r\n"])
    a, b = layer.origins(start, end)
    lo, hi = a[places - start], b[places - start]
    body = "".join(layer.text[i] for i in places).translate(_URL_SAFE)
    for first in range(1 if clean else 0, 4):  # a clean run is no compressed data
        own = body[first:]
        own = own[:-1] if len(own) % 4 == 1 else own
        if len(own) < 8:
            continue
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        text = data.decode(errors="surrogateescape")
        code = np.array([ord(c) for c in text])
        size = np.where((code < 0x80) | ((code >= 0xDC80) & (code <= 0xDCFF)), 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        to = np.cumsum(size)
        left, right = first + 8 * (to - size) // 6, first + (8 * to - 1) // 6
        yield Layer(re.sub("[\udc80-\udcff]", "\ufffd", text), lo[left], hi[right])
        for m in _COMPRESSED.finditer(data):
            yield from _inflated_layers(data[m.start() :], int(lo[first + 8 * m.start() // 6]), int(hi[-1]))


def _raw(layer: Layer, runs: re.Pattern) -> Iterator[Layer]:
    """Compressed data in runs of escaped bytes."""
    for m in runs.finditer(layer.text):
        parts = re.findall(r"[%\\][ux]?[0-9A-Fa-f]+", m[0])
        data = bytes(min(int(p.lstrip("%\\ux"), 16), 255) for p in parts)
        for c in _COMPRESSED.finditer(data):
            yield from _inflated_layers(data[c.start() :], *layer.span(m.start(), m.end()))


def decoded(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (x := layer.rewritten(_PERCENT, lambda r: bytes.fromhex(r.replace("%", "")).decode(errors="replace"))):
        yield x
        yield from _raw(layer, _PERCENT)
    if "\\" in text and (x := layer.rewritten(_ESCAPED, _unescaped)):
        yield x
        yield from _raw(layer, _ESCAPED)
    clean = set()
    for m in _BASE64.finditer(text):
        if to := _unbased(m[0]):
            clean.add((m.start(), m.end() - m[0].count("=")))
            a, b = layer.span(m.start(), m.end())
            yield Layer(to, np.full(len(to), a), np.full(len(to), b))
    for m in _WRAPPED.finditer(text):
        yield from _shifted(layer, m.start(), m.end(), m.span() in clean)


def _mark(layer: Layer) -> tuple:
    """What tells a layer from others, without its text."""
    digest = hashlib.blake2b(layer.text.encode(errors="surrogatepass"), digest_size=16).digest()
    return digest, *layer.span(0, len(layer.text))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans of ``text``, and all spans: base ones and those of decoded layers."""
    text = text or ""
    base = scan(text)
    every = set(base)
    seen = {_mark(Layer(text))}
    todo = [decoded(Layer(text))]
    while todo:  # the deepest layers first, so that few are held at once
        if (layer := next(todo[-1], None)) is None:
            todo.pop()
        elif layer.text and (key := _mark(layer)) not in seen:
            seen.add(key)
            for start, kind, end in scan(layer.text):
                a, b = layer.span(start, end)
                every.add((a, kind, b))
            todo.append(decoded(layer))
    return base, sorted(every)


def redact(text: str | None, spans: list[Span], mask: str = MASK) -> str | None:
    """``text`` with every span masked; overlapping spans take one mask."""
    if not spans or text is None:
        return text
    out, last = [], 0
    for start, _, end in spans:
        if start >= last:
            out += [text[last:start], mask]
        last = max(last, end)
    return "".join([*out, text[last:]])


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in at.blocks(batches, "text"):
        found = [find(t) for t in block.column("text").to_pylist()]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
        digests = [hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found]
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_told(every) for _, every in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs(doc_id, text, ...)``; one map pass, no shuffle.

    Returns ``doc_id``, counts of the base kinds, ``base_sha256`` of the base spans
    and ``spans``: all spans as ``kind:start:end`` in code points of the original,
    by start, kind, end.  Null and empty texts have none (the digest of an empty
    string).  Rows that repeat or lack an id give their own rows; other columns are
    ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_find, _FOUND)


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked, also those under encodings; all
    other columns stay, but ``n_chars``, where there is one, follows the text."""
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in at.blocks(batches, "text"):
            names = block.schema.names
            old = block.column("text").to_pylist()
            new = [redact(t, find(t)[1], mask) for t in old]
            out = block.set_column(names.index("text"), "text", pa.array(new, block.schema.field("text").type))
            if counted:
                kept = block.column("n_chars").to_pylist()
                sizes = [n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)]
                out = out.set_column(names.index("n_chars"), "n_chars", pa.array(sizes, block.schema.field("n_chars").type))
            yield out

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
