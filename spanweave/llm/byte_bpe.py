"""Byte-level BPE as a sentencepiece model (operator 3).

A rank file becomes a sentencepiece BPE model, written field by field in the
protocol buffer's wire format: each piece is the token's bytes mapped to
printable characters, its score the negative rank, its normaliser the identity.
Pre-tokens are encoded one by one; decoding maps ids back to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows get equal results; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .units import UnitEncoder


def byte_characters() -> list[str]:
    """The printable character for each byte: its own if visible, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: ids are the ranks, the unknown piece comes after them."""
    chars = byte_characters()
    # Field numbers and kinds as the public model format has them.
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        chars = byte_characters()
        self.split = regex.compile(pattern).findall
        self.to_chars = dict(enumerate(chars))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        back = {c: b for b, c in enumerate(chars)}
        pieces = self.model.id_to_piece(list(range(len(tokens))))
        self.bytes_of = [bytes(back[c] for c in p) for p in pieces]
        self.names = [str(i) for i in range(len(tokens))]
        self.encode = UnitEncoder(self._one, self._many, self._pieces)

    def _pieces(self, pre_tokens: list[str]) -> list[bytes]:
        to_chars = self.to_chars
        mapped = [p.encode().decode("latin-1").translate(to_chars) for p in pre_tokens]
        return [array("I", x).tobytes() for x in self.model.encode(mapped, num_threads=1)] if mapped else []

    def _one(self, text: str) -> bytes:
        return b"".join(self._pieces(self.split(text)))

    def _many(self, units: list[str]) -> list[bytes]:
        """The units as one text; a pre-token that begins with a space starts a unit."""
        pre = self.split("".join(units))
        out: list[bytes] = []
        for p, ids in zip(pre, self._pieces(pre), strict=True):
            if p[0] == " ":
                out.append(ids)
            else:
                out[-1] += ids
        return out

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[int, bytes, ByteBpe]]:
    bpe = _loaded(path, pattern)
    for batch in batches:
        texts = (text.as_py() for text in batch.column(1))
        for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode.each(texts), strict=True):
            yield doc, ids, bpe


def encode_documents(docs: DataFrame, ranks: str, pattern: str, as_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (the bytes that the ids stand for).

    ids: little-endian unsigned 32-bit, or with ``as_text`` decimal, joined by
    one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes | str, bytes]] = []
        size = 0
        for doc, ids, bpe in _rows(batches, ranks, pattern):
            numbers = np.frombuffer(ids, dtype="<u4").tolist()
            held.append((doc, len(numbers), bpe.decimal(numbers) if as_text else ids, bpe.decode(numbers)))
            size += len(ids)
            if size >= 8_000_000:
                yield _batch(held, as_text)
                held, size = [], 0
        if held:
            yield _batch(held, as_text)

    schema = f"doc_id long, n_tokens long, ids {'string' if as_text else 'binary'}, decoded binary"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], as_text: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_documents(table(spark, sf_dir, "documents"), ranks, pattern, as_text=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
