"""Token ids in Arrow IPC files of fixed-size-list batches.

Texts are encoded in ascending id order, joined to one stream per partition of the
id range and cut into sequences of equal length. A file is an Arrow IPC file whose
record batches hold ``ids`` (fixed-size lists of uint16 where the vocabulary allows,
else uint32) and ``mask`` (a dictionary of fixed-size lists of uint8, one byte an id: 0 where the last
sequence is padded, else 1; a file has one mask of ones and at most one other). The lists have no offsets and no
bits, so the ids of sequence s of a memory-mapped file are a slice of its buffers, and its mask is a slice of the
dictionary, which is read once as the file is opened. An index table, written last, says where each text begins and
which files count; files of lost or repeated tasks are in no index.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .pretokens import Memo
from .store import Workspace, only, trimmed

PORTION = 1 << 20
#: Ids in a sequence and sequences in a record batch.
SEQUENCE, SEQUENCES = 2048, 256


class Tokenizer:
    """A byte-level tokenizer file of the tokenizers library, applied to pre-tokens.

    A text that holds an added token is encoded by the library as a whole, which knows where it counts. A
    file whose texts are normalised or cut in another way than :mod:`pretokens` does is refused.
    """

    def __init__(self, path: str, special: bool):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        parts = json.loads(self.library.to_str())
        cut = parts["pre_tokenizer"] or {}
        if parts["normalizer"] is not None or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level files without a normaliser and without a prefix space are supported")
        self.library.encode_special_tokens = not special
        self.library.no_padding()
        self.library.no_truncation()
        self.small = self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.memo = Memo(self.encode_pretokens)
        added = self.library.get_added_tokens_decoder().values()
        self.marks = [t.content.encode() for t in added if t.content and (special or not t.special)]

    def encode_pretokens(self, tokens: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and how many each text has."""
        raw = data.tobytes()
        marked = []
        if any(m in raw for m in self.marks):
            marked = [k for k in range(len(offsets) - 1) if any(raw.find(m, offsets[k], offsets[k + 1]) >= 0 for m in self.marks)]
        if not marked:
            return self.memo(data, offsets)
        length = np.diff(offsets)
        plain = np.ones(len(length), bool)
        plain[marked] = False
        left = np.where(plain, length, 0)
        ids, count = self.memo(data[np.repeat(plain, length)], np.r_[0, np.cumsum(left)])
        pieces = np.split(ids, np.cumsum(count)[:-1])
        for k in marked:
            pieces[k] = np.array(self.library.encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)


@lru_cache(maxsize=2)
def load(path: str, special: bool = True) -> Tokenizer:
    return Tokenizer(path, special)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _Writer:
    """One file; ids are appended, full batches written as they fill."""

    def __init__(self, root: str, name: str, kind: pa.DataType, length: int):
        self.fs, base = _open(root)
        self.fs.create_dir(base, recursive=True)
        self.kind, self.length = kind, length
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.sink = self.fs.open_output_stream(f"{base}/{name}")
        self.file = pa.ipc.new_file(self.sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.rest, self.held = [], 0

    def append(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.length * SEQUENCES:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        full = self.length * SEQUENCES
        whole = len(ids) // full * full
        for i in range(0, whole, full):
            self._batch(ids[i : i + full], full)
        ids = ids[whole:]
        if last and len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, ids.dtype)
            padded[: len(ids)] = ids
            self._batch(padded, len(ids))
            ids = ids[:0]
        self.rest, self.held = [ids], len(ids)

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        values = pa.array(ids.astype(self.kind.to_pandas_dtype()))
        padded = valid < len(ids)
        masks = np.ones((1 + padded, self.length), np.uint8)
        which = np.zeros(len(ids) // self.length, np.int8)
        if padded:
            masks[1, valid % self.length :] = 0
            which[-1] = 1
        masks = pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), self.length)
        columns = [pa.FixedSizeListArray.from_arrays(values, self.length), pa.DictionaryArray.from_arrays(which, masks)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.file.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, root: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, length: int = SEQUENCE, special: bool = True) -> DataFrame:
    """Writes the files below ``root`` (a folder that all executors share) and returns their index.

    The index has ``(id, part, file, seq, local_start, start, n_tokens)``: ``start`` counts the ids of all
    documents before, ``local_start`` those in the same file. A null text is empty; each text is followed
    by ``end_id`` unless that is None. Null ids come first; rows of equal ids are ordered by their texts.
    An empty table gives an empty index and no file. With ``special`` the file's special tokens, written out in
    a text, become their ids, as by the library's default; without, they are plain text (its ``encode_special_tokens``).
    """
    spark = docs.sparkSession

    @trimmed
    def run(batches):
        from pyspark import TaskContext

        tokenizer, writer, place, seq = load(tokenizer_path, special), None, 0, 0
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            for i, j in K.portions(offsets, PORTION):
                if writer is None:
                    writer = _Writer(f"{root}/files", name, pa.uint16() if tokenizer.small else pa.uint32(), length)
                ids, count = tokenizer(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(count), np.uint32(end_id))
                    count = count + 1
                writer.append(ids)
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.full(n, part, np.int32)), pa.array([name] * n), pa.array(np.arange(seq, seq + n)), pa.array(place + np.cumsum(count) - count), pa.array(count)],
                    names=["id", "part", "file", "seq", "local_start", "n_tokens"],
                )
                place += int(count.sum())
                seq += n
        if writer is not None:
            writer.close()

    src = only(docs, id=id_col, text=text_col)
    ordered = src.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"), "text")
    kind = src.schema["id"].dataType.simpleString()
    ordered.mapInArrow(run, f"id {kind}, part int, file string, seq long, local_start long, n_tokens long").write.parquet(f"{root}/index")
    index = spark.read.parquet(f"{root}/index")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))  # a row for each file
    return index.join(before, "part").select("id", "part", "file", "seq", "local_start", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens").withColumnRenamed("id", id_col)


class TokenFile:
    """Random access to the ids of one file; a local file is memory-mapped."""

    def __init__(self, root: str, name: str):
        fs, base = _open(root)
        where = f"{base}/files/{name}"
        self.source = pa.memory_map(where) if fs.type_name == "local" else fs.open_input_file(where)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.held = -1, np.zeros(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.held = k, self.reader.get_batch(k).column(0).flatten().to_numpy()
        return self.held

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence s, views of the file's buffers and of its dictionary of masks."""
        batch = self.reader.get_batch(s // SEQUENCES)
        a = s % SEQUENCES * self.length
        m = batch.column(1).indices[s % SEQUENCES].as_py() * self.length
        return batch.column(0).flatten().to_numpy()[a : a + self.length], batch.column(1).dictionary.flatten().to_numpy()[m : m + self.length]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on."""
        full, out = self.length * SEQUENCES, []
        while n:
            k, i = divmod(start, full)
            piece = self._batch(k)[i : i + n]
            if not len(piece):
                raise ValueError("the file ends before the ids that its index names")
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


def read_token_digests(index: DataFrame, root: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each text, its ids read from the files.

    The crc32 is of the ids as little-endian unsigned 32-bit integers.
    """

    @trimmed
    def run(batches):
        name, file = None, None
        for batch in batches:
            out = []
            for f, start, n in zip(batch["file"].to_pylist(), batch["local_start"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                if f != name:
                    if file:
                        file.close()
                    name, file = f, TokenFile(root, f)
                out.append(zlib.crc32(file.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    src = index.withColumnRenamed(id_col, "id").repartition("part").sortWithinPartitions("part", "seq")
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, special: bool = True) -> DataFrame:
    """Writes the documents' ids in the session's shared folder and returns the digests read back."""
    root = Workspace(docs.sparkSession, "token-files").root
    index = write_token_files(docs, tokenizer_path, root, id_col, text_col, end_id, special=special)
    return read_token_digests(index, root, id_col)
