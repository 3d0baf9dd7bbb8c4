"""Token-id files: ids packed in the fewest bits that hold the vocabulary, in blocks with byte offsets.

A file holds the documents of one range in ascending order of their ids. It is written as a stream, so its size isn't bound by memory::

    blocks: BLOCK ids each, packed from the lowest bit on; the last one is padded to whole bytes
    byte offset of each block and the end (64 bits)
    document ids (64 bits), valid flags (8 bits), first token of each document and the end (64 bits)
    offset of the index, bits, block size, documents, ids, ids of the range before the file      trailer, 6 x 64 bits
    magic "ALTK", version                                                                        8 bytes

A block is unpacked by array operations, and any range of ids is read from the blocks that it touches.

Nulls are empty texts; very long texts are encoded whole; documents with a null id come first and keep it; repeated ids stay separate
documents, in the order of a digest of their texts, then of the texts. Empty tables give no file. Other columns are ignored, so they can't clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import materialise, plan_bytes, scratch_dir, slices, table, texts_of, until_exit

MAGIC = b"ALTK\x02\0\0\0"
BLOCK = 4096
#: Text bytes that go into one file; a task writes one file unless it has more. Least input bytes of a task, and tasks for each core.
FILE_BYTES = 1 << 30
TASK_BYTES = 16 << 20
TASKS = 64
#: Ids that a reader holds at once.
READ_IDS = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids from the lowest bit on; eight ids take ``bits`` bytes."""
    n = len(ids)
    x = np.zeros(-(-n // 8) * 8, np.uint64)
    x[:n] = ids
    x = x.reshape(-1, 8)
    out = np.zeros((len(x), bits + 8), np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        v = x[:, j] << np.uint64(shift)
        for k in range((bits + shift + 7) // 8):
            out[:, at + k] |= ((v >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :bits]).tobytes()[: (n * bits + 7) // 8]


def unpack(data, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw = raw.reshape(-1, bits)
    out = np.zeros((groups, 8), np.uint64)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        for k in range((bits + shift + 7) // 8):
            out[:, j] |= raw[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (out[:, j] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n].astype(np.uint32)


class Writer:
    """Packs ids into a stream as they come; holds less than a block of them, and the index."""

    def __init__(self, stream, bits: int, first: int = 0):
        self.stream, self.bits, self.first = stream, bits, first
        self.keys: list = []
        self.counts: list[np.ndarray] = []
        self.rest = np.zeros(0, np.int64)
        self.size = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys += doc_ids
        self.counts.append(counts)
        self.size += len(ids)
        self.rest = np.concatenate((self.rest, ids))
        full = len(self.rest) // BLOCK * BLOCK
        if full:  # blocks of BLOCK ids are whole bytes, so many are packed at once
            self.stream.write(pack(self.rest[:full], self.bits))
            self.rest = self.rest[full:].copy()

    def close(self) -> None:
        self.stream.write(pack(self.rest, self.bits))
        blocks = -(-self.size // BLOCK)
        offsets = np.minimum(np.arange(blocks + 1, dtype=np.int64) * (BLOCK // 8 * self.bits), (self.size * self.bits + 7) // 8)
        valid = np.array([d is not None for d in self.keys], np.uint8)
        keys = np.array([d or 0 for d in self.keys], np.int64)
        ptr = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.counts])))).astype("<i8")
        for part in (offsets, keys, valid, ptr):
            self.stream.write(part.tobytes())
        self.stream.write(struct.pack("<6q", int(offsets[-1]), self.bits, BLOCK, len(keys), self.size, self.first) + MAGIC)


class TokenFile:
    """Reads a file that can seek; only its index is held."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        trailer = self._read(end - 56, 56) if end >= 56 else b""
        if trailer[48:] != MAGIC:
            raise ValueError("not a token file")
        at, self.bits, self.block, n, self.size, self.first = struct.unpack_from("<6q", trailer)
        blocks = -(-self.size // self.block)
        index = self._read(at, end - 56 - at)
        self.offsets = np.frombuffer(index, "<i8", blocks + 1)
        at = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(index, "<i8", n, at)
        self.valid = np.frombuffer(index, np.uint8, n, at + 8 * n)
        self.ptr = np.frombuffer(index, "<i8", n + 1, at + 9 * n)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def tokens(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of this file, from the blocks that hold them alone."""
        hi = self.size if hi is None else hi
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        raw = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        return unpack(raw, min(b * self.block, self.size) - a * self.block, self.bits)[lo - a * self.block : hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ptr[k]), int(self.ptr[k + 1]))


def write(df: DataFrame, where: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, end each with ``end_id`` and write token files to ``where``. Returns the list of files: part, name,
    documents, ids, and first: ids of the part before the file. Files of lost attempts are not in the list."""
    path = path or bpe.default_path()
    spark = df.sparkSession
    grain = max(TASK_BYTES, plan_bytes(df, text_col) // (spark.sparkContext.defaultParallelism * TASKS))
    parts = max(1, plan_bytes(df, text_col) // grain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        vocab = bpe.vocabulary(path)
        bits = max(1, int(max(vocab.size - 1, end_id)).bit_length())
        fs, root = pyarrow.fs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        before, held, name, out = 0, 0, "", None

        def row():
            out.close()
            out.stream.close()
            return pa.RecordBatch.from_pylist([{"part": part, "name": name, "documents": len(out.keys), "ids": out.size, "first": out.first}])

        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                texts = texts_of(piece, "text")
                flat, ptr = vocab.encode(texts)
                if out is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.tok"
                    out, held = Writer(fs.open_output_stream(f"{root}/{name}"), bits, before), 0
                out.add(piece.column("id").to_pylist(), np.insert(flat, ptr[1:], end_id), np.diff(ptr) + 1)
                held += sum(map(len, texts))
                if held >= FILE_BYTES:
                    yield row()
                    before, out = before + out.size, None
        if out is not None:
            yield row()

    order = ["id", "hash"]
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = source.repartitionByRange(int(parts), *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*order, "text"]])
    return materialise(ordered.drop("hash").mapInArrow(run, "part bigint, name string, documents bigint, ids bigint, first bigint"), "token-files")


def read(files: DataFrame, where: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32, from the files in the list; a task opens the files it is dealt."""
    spark = files.sparkSession
    totals = {r.part: r.ids for r in files.groupBy("part").agg(F.sum("ids").alias("ids")).collect()}  # a row for each write task, TASKS a core at most
    before = dict(zip(sorted(totals), np.concatenate(([0], np.cumsum([totals[k] for k in sorted(totals)])))[:-1].tolist(), strict=True)) if totals else {}

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(where)
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    f = TokenFile(source)
                    n, lo = len(f.doc_ids), 0
                    while lo < n:
                        hi = max(lo + 1, int(np.searchsorted(f.ptr, f.ptr[lo] + READ_IDS, "right")) - 1)
                        raw = memoryview(f.tokens(int(f.ptr[lo]), int(f.ptr[hi])).astype("<u4").tobytes())
                        ptr = f.ptr[lo : hi + 1] - f.ptr[lo]
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                        start = f.ptr[lo:hi] + f.first + before[part]
                        yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[lo:hi], mask=f.valid[lo:hi] == 0), pa.array(start), pa.array(np.diff(ptr)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])
                        lo = hi

    schema = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not totals:
        return spark.createDataFrame([], schema)
    return files.select("part", "name").repartition(len(totals), "name").mapInArrow(run, schema)


def op10_token_files(spark, sf_dir) -> DataFrame:
    where = f"{scratch_dir(spark)}/arborlake/tokens-{uuid.uuid4().hex}"
    where = where if "://" in where or where.startswith("file:") else f"file://{where}"
    until_exit(spark, where)
    return read(write(table(spark, sf_dir, "documents"), where), where)
