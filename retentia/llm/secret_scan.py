"""Secrets in whole texts, also below layers of encoding.

A worklist starts with the text. Each layer is scanned for secrets, then unwrapped: percent and
Unicode escapes are replaced in place, base64 runs are decoded at every alignment, also across line ends,
and compressed streams that start anywhere in them are unpacked. Secrets are ASCII, so decoded bytes are
read as single-byte characters, whatever their encoding. New layers join the list until nothing new
appears; a layer that was seen at the same place is not visited again, so cycles end. Escapes within escapes
are peeled layer by layer four times, then to the end in one pass, so long chains cost no more than
their length; what lies between there holds only pieces of escapes that the end does not. Every decoded
character remembers the span it came from, so a secret of any layer is reported by its place in the
original text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from retentia.llm.batches import on_workers, pieces_of

# The kinds of secrets in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

# An ASCII character each, so that spans are exact; other bytes are decoded together.
PERCENT = re.compile(r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
# An escape at the end of a text; hex escapes of characters without a number of digits stop at the bracket or semicolon.
ENDING = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)$")
ESCAPE_ENDS = frozenset("0123456789abcdefABCDEF};")
#: Layers of escapes within escapes that are peeled one by one; deeper ones are peeled to the end in one pass.
SINGLE_LAYERS = 4
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE_END = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{LINE_END}[A-Za-z0-9+/_-]+)*={{0,2}}")
LINE_ENDS = re.compile(LINE_END)
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"
STANDARD = str.maketrans("-_", "+/")
# How gzip, zlib, bzip2 and xz streams begin in base64.
PACKED = re.compile(r"(?=H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|/Td6WFoA)")
#: What a layer must have to hold a secret or a further layer.
WORTH = re.compile(rb"AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|passw|secret|token|api_?key", re.IGNORECASE)
#: Bytes of an unpacked layer that are scanned at once; a larger one is scanned in windows.
LARGEST_LAYER = 16 << 20
#: Bytes that windows share at least; one that ends in a base64 run shares the whole run, up to twice the largest layer.
OVERLAP = 1 << 20
#: Bytes that leave a stream at once.
PIECE = 1 << 18


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    depth: int


class Layer(NamedTuple):
    """A text with the original span of each character; ``starts`` is None for the original itself, an int for a text decoded from one span.

    ``peels`` counts the layers of escapes that were replaced one after the other to get here.
    """

    text: str
    starts: list[int] | int | None
    ends: list[int] | int | None
    depth: int
    peels: int = 0

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[a], self.ends[b - 1]


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets that stand in a text as they are: (kind, start, end), leftmost first within a kind."""
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def percent_text(found: str) -> str:
    return bytes.fromhex(found.replace("%", "")).decode(errors="replace")


def escape_text(found: str) -> str | None:
    if found[0] == "&":
        return html.unescape(found)
    code = int(found[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def replaced(layer: Layer, pattern: re.Pattern, meaning) -> Layer | None:
    """The layer with every escape that has a meaning replaced by it."""
    out, starts, ends, at = [], [], [], 0

    def keep(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        if layer.starts is None:
            starts.extend(range(a, b))
            ends.extend(range(a + 1, b + 1))
        elif not isinstance(layer.starts, int):
            starts.extend(layer.starts[a:b])
            ends.extend(layer.ends[a:b])

    changed = False
    for m in pattern.finditer(layer.text):
        text = meaning(m.group())
        if text is None:
            continue
        changed = True
        keep(at, m.start())
        a, b = layer.span(m.start(), m.end())
        out.append(text)
        starts.extend([a] * len(text))
        ends.extend([b] * len(text))
        at = m.end()
    if not changed:
        return None
    keep(at, len(layer.text))
    whole = isinstance(layer.starts, int)
    return Layer("".join(out), layer.starts if whole else starts, layer.ends if whole else ends, layer.depth + 1, layer.peels + 1)


def escape_ending(out: list[str]) -> tuple[int, str] | None:
    """Length and meaning of an escape that ends at the end of ``out``."""
    tail = "".join(out[-10:])
    m = ENDING.search(tail)
    if not m:
        return None
    text = m.group()
    meaning = chr(int(text[1:], 16)) if text[0] == "%" else escape_text(text)
    return (len(text), meaning) if meaning is not None and len(meaning) == 1 else None


def peeled(layer: Layer) -> Layer | None:
    """The layer with all escapes replaced, also those that appear by replacing others, in one pass with a stack."""
    out, starts, ends = [], [], []
    changed = False
    for i, c in enumerate(layer.text):
        a, b = layer.span(i, i + 1)
        while True:
            out.append(c)
            starts.append(a)
            ends.append(b)
            found = escape_ending(out) if c in ESCAPE_ENDS else None
            if found is None:
                break
            n, c = found
            a, b = starts[-n], ends[-1]
            del out[-n:], starts[-n:], ends[-n:]
            changed = True
    if not changed:
        return None
    whole = isinstance(layer.starts, int)
    return Layer("".join(out), layer.starts if whole else starts, layer.ends if whole else ends, layer.depth + 1)


def opened(head: bytes):
    """A decompressor for what starts so; None if it is no gzip, zlib, bzip2 or xz stream."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and int.from_bytes(head[:2]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


def unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Contents of a stream and of the members behind it, piece by piece, as far as they can be read."""
    left, stream = b"", None
    while True:
        while len(left) < 6 and (more := next(pieces, None)) is not None:
            left = (left + more).lstrip(b"\0") if stream else left + more
        stream = opened(left)
        if stream is None:
            return
        while not stream.eof:
            try:
                out = stream.decompress(left, PIECE)
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                return
            if out:
                yield out
            left = getattr(stream, "unconsumed_tail", b"")
            hungry = stream.needs_input if hasattr(stream, "needs_input") else not left and len(out) < PIECE
            if hungry and not stream.eof:
                left = next(pieces, None)
                if left is None:
                    return
        left = stream.unused_data.lstrip(b"\0")


def windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes in windows that overlap; all at once if they are few."""
    held, fresh = bytearray(), 0
    for piece in pieces:
        held += piece
        fresh += len(piece)
        if fresh > LARGEST_LAYER:
            yield bytes(held)
            run = len(held) - len(held.rstrip(RUN_BYTES))
            keep = max(OVERLAP, run) if run <= 2 * LARGEST_LAYER else OVERLAP
            del held[: max(0, len(held) - keep)]
            fresh = 0
    if fresh:
        yield bytes(held)


def decoded_pieces(core: str, at: int) -> Iterator[bytes]:
    """The bytes of a base64 run without padding, from one of its characters on."""
    for a in range(at, len(core), 1 << 16):
        piece = core[a : a + (1 << 16)]
        piece = piece[:-1] if len(piece) % 4 == 1 else piece
        yield base64.b64decode(piece + "=" * (-len(piece) % 4))


def views(data: bytes) -> Iterator[str]:
    """Single-byte views that may hold something: the bytes as they are, and without the zeros of UTF-16 and UTF-32."""
    for view in (data, data.replace(b"\0", b"")) if b"\0" in data else (data,):
        if WORTH.search(view):
            yield view.decode("latin-1")


def packed_views(core: str, at: int) -> Iterator[str]:
    """Views of a compressed stream that starts at a character of a run, and of the streams it holds in turn until one was seen before.

    Deeper streams are unpacked again from the start, so that none is held whole.
    """
    depth, seen = 1, set()
    while True:
        pieces = decoded_pieces(core, at)
        for _ in range(depth):
            pieces = unpacked(pieces)
        digest, head = hashlib.blake2b(digest_size=16), b""
        for window in windows(pieces):
            head = head or window[:6]
            digest.update(window)
            yield from views(window)
        if digest.digest() in seen or opened(head) is None:
            return
        seen.add(digest.digest())
        depth += 1


def below_run(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """Layers in a run that may go on over line ends: whole, each of its lines, and compressed streams inside."""
    pieces, places, at, length = [], [], 0, 0
    for end in [*LINE_ENDS.finditer(m.group()), None]:
        piece = m.group()[at : end.start() if end else None].rstrip("=")
        places.append((length, m.start() + at))
        pieces.append(piece)
        length += len(piece)
        at = end.end() if end else at
    core = "".join(pieces).translate(STANDARD)

    def place(i: int) -> int:
        first, start = places[bisect_right(places, i, key=lambda x: x[0]) - 1]
        return start + i - first

    for x in PACKED.finditer(core):
        a, b = layer.span(place(x.start()), m.end())
        for text in packed_views(core, x.start()):
            yield Layer(text, a, b, layer.depth + 1)
    for line in BASE64.finditer(layer.text, m.start(), m.end()):
        own = line.group().rstrip("=").translate(STANDARD)
        for k in range(4):
            a, b = layer.span(line.start() + k, line.end())
            for text in views(b"".join(decoded_pieces(own, k))):
                yield Layer(text, a, b, layer.depth + 1)
    if len(pieces) > 1:
        for k in range(4):
            data = b"".join(decoded_pieces(core, k))
            for text in views(data):
                if isinstance(layer.starts, int) or len(text) < len(data):
                    a, b = layer.span(m.start() + k, m.end())
                    yield Layer(text, a, b, layer.depth + 1)
                    continue
                groups = [layer.span(place(i), place(min(i + 4, len(core)) - 1) + 1) for i in range(k, len(core), 4)]
                of_char = [groups[i // 3] for i in range(len(data))]
                yield Layer(text, [a for a, _ in of_char], [b for _, b in of_char], layer.depth + 1)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly below one."""
    if layer.peels >= SINGLE_LAYERS:
        if ("%" in layer.text or "\\" in layer.text or "&#" in layer.text) and (below := peeled(layer)):
            yield below
    else:
        if "%" in layer.text and (below := replaced(layer, PERCENT, percent_text)):
            yield below
        if ("\\" in layer.text or "&#" in layer.text) and (below := replaced(layer, UNICODE, escape_text)):
            yield below
    for m in WRAPPED.finditer(layer.text):
        yield from below_run(layer, m)


def secrets_of(text: str) -> list[Span]:
    """All secrets of a text, by start, kind and end; depth 0 for those that stand in it as they are."""
    found = {(s, e, k): 0 for k, s, e in scan(text)}
    seen: dict[tuple, int] = {}
    work = [unwrapped(Layer(text, None, None, 0))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        place = layer.span(0, len(layer.text)) if layer.text else (0, 0)
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), place)
        if seen.get(mark, layer.depth + 1) <= layer.depth:
            continue
        seen[mark] = layer.depth
        for kind, a, b in scan(layer.text):
            key = (*layer.span(a, b), kind)
            found[key] = min(found.get(key, layer.depth), layer.depth)
        work.append(unwrapped(layer))
    spans = [Span(s, e, k, d) for (s, e, k), d in found.items()]
    return sorted(spans, key=lambda x: (x.start, KINDS.index(x.kind), x.end, x.depth))


def redacted(text: str, spans: list[Span], mark: str = "<secret>") -> str:
    """The text with each stretch covered by secrets replaced."""
    out, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans array<struct<kind, start, end, depth>>`` in code points, end exclusive.

    A missing or empty text has no spans. Repeated ids each keep a row; an empty table gives no rows. Texts are scanned whole. No shuffle.
    """
    on_workers(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            spans = [[s._asdict() for s in secrets_of(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, shape)], [id_column, "spans"])

    given = docs.select(f"`{id_column}`", docs[f"`{text}`"].alias("text"))
    return given.mapInArrow(run, f"`{id_column}` {kind}, spans array<struct<kind: string, start: int, end: int, depth: int>>")


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with the secrets in ``text`` replaced by ``mark``; other columns, null texts and clean texts stay as they are."""
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = [t and redacted(t, secrets_of(t), mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
