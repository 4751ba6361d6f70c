"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file's vocabulary is written out as a sentencepiece BPE model: each token's
bytes become a string of 256 stand-in characters, its score is its negated rank, and the
normaliser is the identity. Merging by highest score is then merging by lowest rank. Each
pre-token is encoded by itself; decoding maps ids back to bytes.

Null texts are empty texts and give no ids; equal rows give equal ids; an empty table gives
an empty table. Texts of any length are encoded whole. Worker memory is bounded: the
cache of pre-tokens starts over at CACHE entries.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

CACHE = 400_000
#: Pre-tokens longer than this are encoded but not kept in the cache.
CACHED_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is one, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto whose piece i is the token of rank i; the unknown piece comes last."""
    characters = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(characters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))  # 1: normal
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))  # 2: unknown
    n = len(by_rank)
    out += _field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1))  # model type 2: BPE
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        #: A pre-token that is itself a token is that token, whatever its merges give.
        self.whole = {t.decode(): r for t, r in ranks.items() if _is_text(t)}
        self.cache: dict[str, bytes] = {}

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of pre-tokens that the cache lacks."""
        merged = self.model.encode([p.encode().decode("latin-1").translate(self.table) for p in pieces], num_threads=1)
        return [struct.pack("<I", self.whole[p]) if p in self.whole else np.array(ids, "<u4").tobytes() for p, ids in zip(pieces, merged, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        split = [self.split(t) for t in texts]
        new = list({p for parts in split for p in parts if p not in cache})
        cache.update(zip(new, self.encode_new(new), strict=True))
        out = [b"".join(map(cache.__getitem__, parts)) for parts in split]
        for p in new:
            if len(p) > CACHED_CHARS:
                del cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids: the packed little-endian unsigned 32-bit ids of each text, in one pass without a shuffle."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(ranks_path, pattern).encode(rows.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(src, run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded and data: the bytes its ids stand for."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        of = codec(ranks_path, pattern).decode
        data = [of(ids) for ids in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return arrow_map(encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")), run, "doc_id long, ids binary, data binary")
