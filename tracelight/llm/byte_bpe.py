"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every token of the vocabulary becomes a piece in which each byte is one printable character, scored by its
negative rank; normalisation is the identity. Pre-tokens are encoded one by one, and ids are decoded by the
inverse mapping of pieces to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, text_or_empty

#: Pre-tokens of up to so many characters are remembered by a worker, so many at most; then it starts anew.
CACHED_LENGTH, CACHED = 48, 100_000
_LOADED: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _field(number: int, wire: int, value: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(value)) if wire == 2 else b"") + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE: piece id = place in rank order, and one unknown piece at the end."""
    chars = byte_characters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token)
        out += _field(1, 2, _field(1, 2, piece.encode()) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(1)))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    size = len(ranks) + 1
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(size)) + _field(40, 0, _varint(size - 1))
    # bos, eos and pad do not exist: -1 as a 64-bit varint
    none = _varint((1 << 64) - 1)
    trainer += b"".join(_field(n, 0, none) for n in (41, 42, 43)) + _field(24, 0, _varint(0))
    normal = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normal))


class Codec(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        ranks = read_ranks(path)
        order = sorted(ranks, key=ranks.__getitem__)
        self.rank = [ranks[t] for t in order]
        self.whole = {t: struct.pack("<I", r) for t, r in ranks.items()}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        ids = self.whole.get(raw)  # a pre-token that is a token needs no merges
        if ids is None:
            found = self.model.encode(raw.decode("latin-1").translate(self.chars))
            ids = struct.pack(f"<{len(found)}I", *map(self.rank.__getitem__, found))
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def load(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and the ``outputs`` asked for, for each row.

    ``ids`` array<int>: the token ids; ``decoded`` binary: the bytes they stand for, which are the text's own.
    A null text counts as empty (0 tokens, digests of nothing). Null ids and repeated rows stay, other columns
    are not read, an empty table gives an empty result. No shuffle; a worker holds one batch of texts.
    """

    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = load(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = [codec.encode(t) for t in b.column(1).to_pylist()]
                back = [codec.decode(x) for x in ids]
                made = {"ids": lambda ids=ids: pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": lambda back=back: pa.array(back, pa.binary())}
                cols = [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    *(made[k]() for k in outputs),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *outputs])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    more = "".join({"ids": ", ids array<int>", "decoded": ", decoded binary"}[k] for k in outputs)
    out = rows.mapInArrow(coded, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)
