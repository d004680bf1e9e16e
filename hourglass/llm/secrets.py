"""Secrets under nested encodings: a worklist unwraps layers until nothing new appears, and every layer is scanned.

A layer is a text together with the place in the document that each of its characters came from. Escapes (percent, Unicode,
hexadecimal and HTML ones) make one new layer of the whole text; runs of base64 and compressed data make layers of their own.
What a layer reveals is reported at the characters of the document that encode it.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import sliced

KINDS = ("assign", "access", "hex")
# The patterns of the kinds and the least sizes that a match has to have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

#: The shortest secret is ``token=`` with 8 characters: fewer readable characters, or fewer base64 letters, hold none.
READABLE = re.compile(rb"[\x20-\x7e]{14,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{19,}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]++)++")
ESCAPE = re.compile(
    r"(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});|&(?:quot|apos|amp|lt|gt);"
)
STANDARD = str.maketrans("-_", "+/")
PIECE, BLOCK, OVERLAP = 1 << 20, 8_000_000, 65_536  # unpacked data are read in blocks of so many bytes, which share so many with the next
BUDGET = 256_000_000  # characters of all layers below one document


class Layer(NamedTuple):
    """A text, or bytes that may be compressed, and for each of its characters where its code begins and ends in the document
    (None: it is the document itself)."""

    data: str | bytes
    begin: object
    end: object

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (int(self.begin[a]), int(self.end[b - 1]))

    def outer(self, begin, end):
        """Places in the document of places in this layer."""
        return (begin, end) if self.begin is None else (self.begin[begin], self.end[end - 1])


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the secrets that a text shows openly, leftmost and apart from each other by kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield m.start(), 0, m.end()
    for rank, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield m.start(), rank, m.end()


def _escaped_units(code: str) -> list[tuple[int, str]] | None:
    """(size of the code, character) of the characters that one run of escapes stands for; None where it stands for no text."""
    if code[0] == "%" or code[1] == "x":
        each = 3 if code[0] == "%" else 4
        data = bytes.fromhex(code.replace("%", "").replace("\\x", ""))
        try:
            return [(each * len(c.encode()), c) for c in data.decode()]
        except UnicodeDecodeError:
            return None
    if code[0] == "&":
        made = html.unescape(code)
    elif code[1] == "U" or code[2] == "{":
        point = int(code[2:].strip("{}"), 16)
        made = chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else ""
    else:
        pairs = re.findall(r"\\u([dD][89abAB]..)\\u([dD][c-fC-F]..)|\\u(....)", code)
        points = [(12, 0x10000 + (int(a, 16) - 0xD800 << 10) + int(b, 16) - 0xDC00) if a else (6, int(c, 16)) for a, b, c in pairs]
        return None if any(0xD800 <= p < 0xE000 for _, p in points) else [(size, chr(p)) for size, p in points]
    return [(len(code), made)] if len(made) == 1 and not 0xD800 <= ord(made) < 0xE000 else None


def unescaped(layer: Layer, codes: list[re.Match]) -> Layer | None:
    """The whole layer with its escapes replaced, or None where none stands for text."""
    import numpy as np

    out, begin, width, at = [], [], [], 0
    for m in codes:
        units = _escaped_units(m[0])
        if units is None:
            continue
        sizes = np.array([size for size, _ in units])
        out += [layer.data[at : m.start()], *[c for _, c in units]]
        begin += [np.arange(at, m.start()), m.start() + np.cumsum(sizes) - sizes]
        width += [np.ones(m.start() - at, "int64"), sizes]
        at = m.end()
    if not out:
        return None
    begin = np.concatenate([*begin, np.arange(at, len(layer.data))])
    end = begin + np.concatenate([*width, np.ones(len(layer.data) - at, "int64")])
    return Layer("".join([*out, layer.data[at:]]), *layer.outer(begin, end))


def as_text(layer: Layer) -> Layer:
    """A layer of bytes as text: UTF-8 where it is that, else one character a byte."""
    import numpy as np

    data = layer.data
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return Layer(data.decode("latin-1"), layer.begin, layer.end)
    if len(text) == len(data):
        return Layer(text, layer.begin, layer.end)
    head = np.flatnonzero((np.frombuffer(data, "uint8") & 0xC0) != 0x80)
    return Layer(text, layer.begin[head], layer.end[np.append(head[1:], len(data)) - 1])


def packer(data: bytes) -> str | None:
    """The kind of compression whose signature the data begin with."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    if data[:3] == b"BZh":
        return "bz2"
    if data[:6] == b"\xfd7zXZ\x00" or data[:3] == b"]\x00\x00":
        return "lzma"
    return "zstd" if data[:4] == b"\x28\xb5\x2f\xfd" else None


def _pieces(data: bytes, kind: str) -> Iterator[bytes]:
    """What data unpack to, a piece of bounded size at a time."""
    if kind == "zstd":
        import zstandard

        reader = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data)
        while piece := reader.read(PIECE):
            yield piece
        return
    if kind == "zlib":
        opener = zlib.decompressobj(47)
        for at in range(0, len(data), 1024):
            todo = data[at : at + 1024]
            while todo and not opener.eof:
                yield opener.decompress(todo, PIECE)
                todo = opener.unconsumed_tail
        return
    opener = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(memlimit=1 << 28)
    yield opener.decompress(data, PIECE)
    while not opener.eof and not opener.needs_input:
        yield opener.decompress(b"", PIECE)


def unpacked(data: bytes) -> Iterator[bytes]:
    """Blocks of what compressed data hold, as far as they are whole; nothing where they are not compressed."""
    import zstandard

    held, fresh = b"", 0
    try:
        for piece in _pieces(data, kind) if (kind := packer(data)) else ():
            held, fresh = held + piece, fresh + len(piece)
            if fresh >= BLOCK:
                yield held
                held, fresh = held[-OVERLAP:], 0
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError):
        pass  # damaged or only alike by its first bytes
    if fresh:
        yield held


def _promising(data: bytes) -> bool:
    return packer(data) is not None or READABLE.search(data) is not None


def _of_bytes(layer: Layer) -> Iterator[Layer]:
    """The text that bytes spell, and what they unpack to, which lies at the place of the whole."""
    import numpy as np

    if READABLE.search(layer.data):
        yield as_text(layer)
    for block in unpacked(layer.data):
        if _promising(block):
            yield Layer(block, np.full(len(block), layer.begin[0]), np.full(len(block), layer.end[-1]))


def _of_base64(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """What a run of base64 letters decodes to, from each of its first four letters on: others may stand before the code."""
    import numpy as np

    places, code = np.arange(m.start(), m.end()), m[0].translate(STANDARD)
    if "\n" in code:
        places = places[[c not in "\r\n" for c in code]]
        code = code.replace("\r", "").replace("\n", "")
    for skip in range(4):
        part = code[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        if _promising(data):
            byte = np.arange(len(data))
            yield Layer(data, *layer.outer(places[skip + byte * 8 // 6], places[skip + (byte * 8 + 7) // 6] + 1))


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """All layers directly below one layer."""
    import numpy as np

    if isinstance(layer.data, bytes):
        yield from _of_bytes(layer)
        return
    codes = list(ESCAPE.finditer(layer.data))
    if codes and (made := unescaped(layer, codes)) is not None:
        yield made
    for m in codes:
        each = 3 if m[0][0] == "%" else 4
        if (each == 3 or m[0][:2] == "\\x") and len(m[0]) >= each * 14 and _escaped_units(m[0]) is None:
            data = bytes.fromhex(m[0].replace("%", "").replace("\\x", ""))
            if _promising(data):
                begin = m.start() + each * np.arange(len(data))
                yield Layer(data, *layer.outer(begin, begin + each))
    for pattern in (RUN, WRAPPED):
        for m in pattern.finditer(layer.data):
            yield from _of_base64(layer, m)


def search(text: str, budget: int = BUDGET) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """(open secrets, all secrets, layers below the text, whether all of them were unwrapped) of one text.

    Secrets are (start, rank, end). The worklist holds layers that are still to unwrap; what was seen before at the same place is
    not unwrapped again, so codes that yield themselves come to an end.
    """
    open_ = sorted(matches(text))
    found, seen, todo, spent = set(open_), set(), deque([Layer(text, None, None)]), 0
    while todo:
        for inner in inner_layers(todo.popleft()):
            if not inner.data:
                continue
            plain = inner.data if isinstance(inner.data, bytes) else inner.data.encode(errors="surrogatepass")
            name = type(inner.data), hashlib.blake2b(plain, digest_size=16).digest(), inner.place(0, len(inner.data))
            if name in seen:
                continue
            spent += len(inner.data)
            if spent > budget:
                return open_, sorted(found), len(seen), False
            seen.add(name)
            if isinstance(inner.data, str):
                for start, rank, end in matches(inner.data):
                    a, b = inner.place(start, end)
                    found.add((a, rank, b))
            todo.append(inner)
    return open_, sorted(found), len(seen), True


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


RESULTS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_spans": "string", "spans": "string", "n_layers": "long", "complete": "boolean"}


def find(docs: DataFrame, budget: int = BUDGET, text: str = "text") -> DataFrame:
    """The input's rows with counts of open secrets by kind, their spans, all spans, the layers below the text and whether all were seen.

    Spans are kind:start:end in code points, by start, then kind, then end. A narrow map: no shuffle, each row where it was read.
    NULL text counts as empty; equal rows give equal results; input columns named like results are replaced, all others kept; no
    rows give no rows. Texts are read whole. Layers of one document may hold ``budget`` characters together; a document whose
    layers hold more (data that unpack to a multiple of themselves) keeps what was found and has ``complete`` false. Unpacked data
    are read in blocks of 8 MB that overlap by 64 KB: a secret longer than that may be cut in them.
    """
    import pyarrow as pa

    carried = [c for c in docs.columns if c not in RESULTS]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carried], *[f"{k} {v}" for k, v in RESULTS.items()]])
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                rows = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    open_, every, layers, complete = search(t, budget)
                    counts = [sum(rank == k for _, rank, _ in open_) for k in range(len(KINDS))]
                    rows.append((*counts, spelled(open_), spelled(every), layers, complete))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*carried, *RESULTS])

    return source.mapInArrow(run, schema)
