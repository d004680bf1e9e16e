"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Every byte maps to one printable character, every ranked byte string to the piece of its mapped characters with score minus
its rank, and the normaliser is the identity. The merge loop of a sentencepiece BPE model then takes the same pair at every
step as a rank-ordered byte merge. Decoding maps ids back to byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import ChunkTokens, byte_letters, sliced


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank; ranks must run from 0 without a gap and hold all single bytes."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    tokens = [ranks[i] for i in range(len(ranks))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("the rank file lacks single bytes")
    return tokens


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model: piece i is token i; the obligatory unknown piece comes after all tokens."""
    letters = byte_letters()
    out = b"".join(_field(1, _field(1, "".join(letters[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -rank)) for rank, t in enumerate(tokens))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", -len(tokens)) + _flag(3, 2))
    out += _field(2, _flag(3, 2))  # model type: BPE
    return out + _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))  # no prefix, no trimming, no escapes


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.table = {b: letter for b, letter in enumerate(byte_letters())}
        self.chunks = ChunkTokens(self._encode_chunks, lead=True)

    def pretokens(self, text: str) -> list[str]:
        """Matches of the pattern, with characters newer than Python's Unicode tables classed as the tiktoken library does."""
        if text.isascii() or not (new := {c for c in set(text) if unicodedata.category(c) == "Cn"}):
            return self.pattern.findall(text)
        stand = text.translate({ord(c): tiktoken_class(c) for c in new})
        return [text[m.start() : m.end()] for m in self.pattern.finditer(stand)]

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        split = [self.pretokens(c) for c in chunks]
        flat = [t.encode().decode("latin-1").translate(self.table) for ts in split for t in ts]
        coded = iter(self.model.encode(flat, num_threads=1) if flat else [])
        return [[i for _ in ts for i in next(coded)] for ts in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.chunks(texts)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of ids, in pieces of at most a million ids."""
        import numpy as np

        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), 1_000_000):
            yield b"".join(map(self.tokens.__getitem__, every[at : at + 1_000_000].tolist()))


@lru_cache(maxsize=None)
def tiktoken_class(char: str) -> str:
    """A long-established character of the class (letter, number, other) in which the tiktoken library's patterns see ``char``."""
    import tiktoken

    for lead, stand in (("a", "ª"), ("1", "²")):
        joined = (lead + char).encode()
        ranks = {bytes([b]): b for b in range(256)} | {joined[:n]: 254 + n for n in range(2, len(joined) + 1)}
        coder = tiktoken.Encoding("class", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
        if coder.encode_ordinary(lead + char)[0] > 255:
            return stand
    return "�"


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The input's rows with n_tokens, ids_sha256 and decoded_sha256 (and the ids themselves as ``ids`` when ``keep_ids``).

    A narrow map: no shuffle, each row where it was read. NULL text counts as empty (0 tokens); input columns of the same
    names as results are replaced; rows repeat as often as they came.
    """
    import pyarrow as pa

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {})
    kept = docs.drop(*added)
    if text not in kept.columns:
        raise ValueError(f"no text column {text}")
    carried = [c for c in kept.columns if c != text]
    source = kept.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != text], *[f"{k} {v}" for k, v in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = _coder(rank_file, pattern)
        for batch in batches:
            for part in sliced(batch):
                coded = coder.encode(part.column(part.schema.get_field_index(text)).to_pylist())
                plain = []
                for ids in coded:
                    digest = hashlib.sha256()
                    for piece in coder.decode(ids):
                        digest.update(piece)
                    plain.append(digest.hexdigest())
                columns = [part.column(i) for i, n in enumerate(part.schema.names) if n != text]
                columns += [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array(plain)]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(c, "<u4").astype("int32") for c in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *added])

    return source.mapInArrow(run, schema)
