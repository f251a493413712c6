"""Byte-level BPE through a sentencepiece model serialised from a rank file."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared, vocabulary
from .pretokens import BYTE_CHARS, Encoder, byte_mapped, flat


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece 1 + i the i-th lowest rank, scored by minus its rank.

    Bytes are mapped to printable characters, so that every byte string is a piece. Normalisation is the
    identity: no dummy prefix, no white space removed or escaped. No training takes part.
    """
    pieces = [_field(1, b"\x01unknown") + _field(2, 0.0) + _field(3, 2)]
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(BYTE_CHARS[b] for b in raw).encode()) + _field(2, float(-rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(45, b"\x01unknown")
    for control in (41, 42, 43):  # no begin, end or padding piece
        trainer += _varint(control << 3) + _varint((1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Ids of texts, and back.

    A pre-token that is in the vocabulary is its own id; the model merges the others, lowest rank first.
    """

    def __init__(self, data: bytes, pattern: str):
        import sentencepiece

        self.ranks = vocabulary.ranks(data)
        self.by_piece = [0, *sorted(self.ranks.values())]
        inverse = {rank: raw for raw, rank in self.ranks.items()}
        self.raw = pa.array([inverse.get(i) for i in range(self.by_piece[-1] + 1)], pa.binary())
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(piece_model(self.ranks))
        self.encode = Encoder(pattern, self._pieces)

    def _pieces(self, pieces: list[str]) -> pa.ListArray:
        whole = [self.ranks.get(p.encode()) for p in pieces]
        split = iter(self.model.EncodeAsIds([byte_mapped(p) for p, w in zip(pieces, whole) if w is None], num_threads=1))
        by_piece = self.by_piece
        return flat([[w] if w is not None else [by_piece[i] for i in next(split)] for w in whole])

    def decode(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids: each id's by the inverse of the vocabulary, one after the other."""
        pieces = self.raw.take(lists.flatten())
        ends = pieces.buffers()[1]
        ends = np.frombuffer(ends, np.int32, len(pieces) + 1) if ends else np.zeros(1, np.int32)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[at].tobytes()), pieces.buffers()[2]])


def byte_bpe(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, `ids` (array of int) of the whole text, and `decoded` (binary) from them.

    rank_path: a file of base64 byte strings and ranks, read by the driver; it must hold all 256 single bytes.
    pattern: matches are encoded separately. A null text counts as empty: no ids, no bytes. Repeated rows and
    null ids stay as rows; other columns of df aren't read. An empty table gives an empty table. No shuffle.
    """
    data: Broadcast = vocabulary.load(df.sparkSession, rank_path)

    def make(texts: pa.Array) -> list[pa.Array]:
        codec = vocabulary.once("codec " + pattern, data, lambda raw: Codec(raw, pattern))
        ids = codec.encode(texts)
        return [ids, codec.decode(ids)]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return shared.text_map(df, text_col, [id_col], fields, make, arrow_texts=True)
