"""Byte-level BPE by a sentencepiece model that is written from the vocabulary itself.

The 256 bytes are mapped to printable characters, each rank becomes a piece of such
characters with the negative rank as its score, and the normaliser leaves text as
it is. Sentencepiece then merges the pair with the highest score, leftmost first,
which is the merge of the lowest rank. A pre-token that is itself in the vocabulary
is that token. Decoding maps the pieces back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .pretokens import Memo
from .store import only, small_batches, trimmed

PORTION = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, the next one from U+0100 otherwise."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space and the rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: pieces by rank, then the unknown piece that the format asks for."""
    normal, unknown, bpe = 1, 2, 2
    chars = byte_characters()
    pieces = b"".join(
        _block(1, _block(1, "".join(chars[b] for b in token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    )
    last = len(ranks)
    pieces += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, last + 1) + _number(40, last) + b"".join(_number(f, -1) for f in (41, 42, 43))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _block(2, trainer) + _block(3, identity)


class ByteBPE:
    """Encodes and decodes with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks = ranks
        self.by_piece = np.array(sorted(ranks.values()), np.uint32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.table = dict(enumerate(byte_characters()))
        tokens = {rank: token for token, rank in ranks.items()}
        size = max(tokens) + 1
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.memo = Memo(self.encode_pretokens)

    def encode_pretokens(self, tokens: list[bytes]) -> list[list[int]]:
        out: list = [self.ranks.get(t) for t in tokens]
        rest = [i for i, x in enumerate(out) if x is None]
        merged = self.model.encode([tokens[i].decode("latin-1").translate(self.table) for i in rest], num_threads=1)
        for i, ids in zip(rest, merged, strict=True):
            out[i] = self.by_piece[ids].tolist()
        return [x if isinstance(x, list) else [x] for x in out]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, joined."""
        length = self.length[ids]
        shift = self.start[ids] - (np.cumsum(length) - length)
        return self.bytes[np.repeat(shift, length) + np.arange(length.sum())]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(read_ranks(path))


def _encoded(bpe: ByteBPE, batch: pa.RecordBatch, column: int):
    """Of portions of a batch: the rows, their ids and how many each has."""
    data, offsets = K.flat(batch.column(column))
    for i, j in K.portions(offsets, PORTION):
        ids, count = bpe.memo(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, ids, count


def byte_bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, token_ids)``, the ids as an array of int; null and empty texts have no ids.

    ``path`` names a rank file that every executor has. Ids are passed through as they are, nulls
    and repeated ones too, one row for each row. Whole texts are encoded, however long.
    """

    @trimmed
    def run(batches):
        bpe = load(path)
        for batch in batches:
            for i, j, ids, count in _encoded(bpe, batch, 1):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["id", "token_ids"])

    small_batches(docs.sparkSession)
    src = only(docs, id=id_col, text=text_col)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, token_ids array<int>").withColumnRenamed("id", id_col)


def byte_bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(id, bytes)``: the bytes that the ids stand for; a null array gives none."""

    @trimmed
    def run(batches):
        bpe = load(path)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    src = only(tokens, id=id_col, ids=ids_col)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def byte_bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of encoding each text and decoding its ids, in one pass.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes, in
    lowercase hex. Nulls, empty texts and ids are treated as in :func:`byte_bpe_encode`.
    """

    @trimmed
    def run(batches):
        bpe = load(path)
        for batch in batches:
            for i, j, ids, count in _encoded(bpe, batch, 1):
                raw = memoryview(ids.astype("<u4").tobytes())
                text = memoryview(bpe.decode(ids).tobytes())
                ends = np.r_[0, np.cumsum(count)]
                sizes = np.r_[0, np.cumsum(bpe.length[ids])][ends].tolist()
                ends = ends.tolist()
                of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                of_text = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count), pa.array(of_ids), pa.array(of_text)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    src = only(docs, id=id_col, text=text_col)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
