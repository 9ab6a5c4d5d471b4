"""Problem 8: ids of a public byte-level BPE vocabulary, by a sentencepiece model made from it."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pattern that cuts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else the next free code point from 256."""
    letters, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(free))
            free += 1
    return letters


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model (protocol buffer) whose piece i is token i with its bytes as letters.

    The score is the negative rank, so that the pair of the least rank merges first; the normaliser is
    the identity, adds no prefix and keeps all white space. The unknown piece comes last and is never
    produced, since every byte has a piece.
    """
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        text = "".join(letters[b] for b in token).encode()
        out += _message(1, _message(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _message(2, trainer) + _message(3, normaliser))


class Encoder:
    """Encodes whole texts: pre-tokens, memoised, each by the sentencepiece model."""

    def __init__(self, model: bytes, memo: int = 200_000):
        import regex
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._find = regex.compile(PATTERN).findall
        self._letters = byte_letters()
        self._bytes = {c: b for b, c in enumerate(self._letters)}
        self._one = lru_cache(memo)(self._encode)

    def _encode(self, pre_token: str) -> tuple[int, ...]:
        return tuple(self._processor.encode("".join(self._letters[b] for b in pre_token.encode())))

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        for pre_token in self._find(text or ""):
            out += self._one(pre_token) if len(pre_token) < 64 else self._encode(pre_token)
        return out

    def text(self, ids: list[int]) -> str:
        """The inverse of `ids`."""
        return bytes(self._bytes[c] for i in ids for c in self._processor.id_to_piece(int(i))).decode(errors="replace")


_ENCODERS: dict[int, Encoder] = {}


def _worker_encoder(model) -> Encoder:
    """One encoder per Python worker and broadcast."""
    if model.value[0] not in _ENCODERS:
        _ENCODERS[model.value[0]] = Encoder(model.value[1])
    return _ENCODERS[model.value[0]]


def _broadcast(df: DataFrame, folder: str, vocabulary: str):
    """The serialised model, about 1 MB whatever the corpus: made on the driver, so workers need no files."""
    proto = serialise(read_ranks(f"{folder}/{vocabulary}.tiktoken"))
    return df.sparkSession.sparkContext.broadcast((hash(proto), proto))


def token_ids(df: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> Column:
    """The ids of a text column, array<int>. NULL and empty texts give an empty list.

    Strings of special tokens are ordinary text. Whole texts are encoded whatever their length. Rows
    keep their partitions: there is no shuffle.
    """
    model = _broadcast(df, folder, vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _worker_encoder(model)
        for batch in batches:
            yield pd.Series([encoder.ids(t) for t in batch], dtype=object)

    return encode(F.col(text))


def token_count(df: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> Column:
    """The number of ids of a text column; 0 for NULL and empty texts."""
    model = _broadcast(df, folder, vocabulary)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _worker_encoder(model)
        for batch in batches:
            yield pd.Series([len(encoder.ids(t)) for t in batch], dtype="int64")

    return count(F.col(text))


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids of every document; repeated rows are kept as they come (doc_id is unique)."""
    return documents.select("doc_id", token_ids(documents, "text", folder, vocabulary).alias("ids"))
