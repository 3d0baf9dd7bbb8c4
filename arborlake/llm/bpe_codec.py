"""BPE encoding and decoding through a minimal acyclic transducer.

The frequent pieces of the corpus are compiled into one minimal acyclic automaton with shared prefixes and suffixes. The weights
of its arcs add up to the number of a piece, and that number leads to its ids. The compiled lexicon is one block of bytes that
every worker maps into memory: broadcast values have no file of their own that could be mapped, so a worker writes its copy to one that
is unlinked at once and that no other process reads. Pieces that the lexicon lacks are merged exactly, so the result doesn't depend on
what it holds.

Nulls are empty texts; rows with a null id, repeated ids, empty tables and very long texts (taken whole, a slice of their own) are handled row by row. Results hold
only the id and the columns listed, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._common import discard, materialise, ragged_gather, slices, table, texts_of

#: Pieces in the lexicon; it only speeds encoding up, so its size bounds the broadcast and nothing else.
LEXICON_PIECES = 1 << 16
LONGEST_PIECE = 64
#: Steps of counts in which pieces come in, for each factor of e.
STEPS = 64


def frequent_pieces(df: DataFrame, text_col: str = "text", n: int = LEXICON_PIECES) -> list[bytes]:
    """The most frequent pieces of at most LONGEST_PIECE bytes, by their counts over all texts: n at most, as pieces of about one count
come in together or stay out together (unless no other come in: then the least ones). The driver gets no more than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                p = bpe.pretokenise(texts_of(part, text_col))
                count = np.bincount(p.codes, minlength=len(p.words))
                short = np.flatnonzero(np.asarray(pc.binary_length(p.words)) <= LONGEST_PIECE)
                yield pa.RecordBatch.from_arrays([p.words.take(pa.array(short)), pa.array(count[short].astype(np.int64))], ["piece", "n"])

    counts = df.select(text_col).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = materialise(counts.withColumn("step", F.floor(F.log("n") * STEPS).cast("int")), "pieces")
    cut, room = None, n
    for r in counts.groupBy("step").agg(F.count("*").alias("pieces")).orderBy(F.desc("step")).collect():  # STEPS for each e-fold of the counts
        if r.pieces > room:
            break
        cut, room = r.step, room - r.pieces
    some = counts.orderBy(F.desc("n"), "piece").limit(n) if cut is None else counts.where(F.col("step") >= cut)
    out = sorted(bytes(r[0]) for r in some.select("piece").collect())
    discard(counts)
    return out


class Automaton:
    """A minimal acyclic deterministic automaton over sorted byte strings, built one string after the other."""

    def __init__(self, words: list[bytes]):
        self.register: dict[tuple, int] = {}
        self.arcs: list[tuple[tuple[int, int], ...]] = []
        self.final: list[bool] = []
        path: list[list] = [[[], False]]  # arcs and finality of the states on the path of the last word
        last = b""
        for w in words:
            common = len(os.path.commonprefix([last, w]))
            while len(path) - 1 > common:
                self._fold(path, last)
            for _ in range(common, len(w)):
                path.append([[], False])
            path[-1][1] = True
            last = w
        while len(path) > 1:
            self._fold(path, last)
        self.root = self._state(path[0])
        self.words = words

    def _state(self, node: list) -> int:
        key = (node[1], tuple(node[0]))
        if key not in self.register:
            self.register[key] = len(self.arcs)
            self.arcs.append(key[1])
            self.final.append(key[0])
        return self.register[key]

    def _fold(self, path: list, last: bytes) -> None:
        node = path.pop()
        path[-1][0].append((last[len(path) - 1], self._state(node)))

    def tables(self) -> dict[str, np.ndarray]:
        """Arcs as sorted keys state * 256 + byte, with target and weight: the strings of the state that come before the arc's."""
        below = np.zeros(len(self.arcs), np.int64)
        key, target, weight = [], [], []
        for s, arcs in enumerate(self.arcs):  # a state is numbered after all that it leads to
            n = int(self.final[s])
            for b, t in arcs:
                key.append(s * 256 + b)
                target.append(t)
                weight.append(n)
                n += int(below[t])
            below[s] = n
        return {"key": np.array(key, np.int64), "target": np.array(target, np.int64), "weight": np.array(weight, np.int64), "final": np.array(self.final, np.int64), "root": np.array([self.root], np.int64)}


def compile_lexicon(words: list[bytes], path: str) -> bytes:
    """The automaton and the ids of its pieces as one block: a count, names, sizes, then 64-bit arrays."""
    words = sorted(set(words) - {b""})
    ids, ptr = bpe.vocabulary(path).merge(pa.array(words, pa.binary()))
    arrays = Automaton(words).tables() | {"ids": ids, "ptr": ptr}
    head = b"".join(struct.pack("<8sq", k.encode(), len(a)) for k, a in arrays.items())
    return struct.pack("<q", len(arrays)) + head + b"".join(a.astype("<i8").tobytes() for a in arrays.values())


class Lexicon:
    def __init__(self, block: bytes):
        fd, name = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(block)
            whole = np.memmap(name, np.uint8, "r")
        finally:
            os.unlink(name)  # the map stays
        n = struct.unpack_from("<q", whole, 0)[0]
        at = 8 + 16 * n
        for k in range(n):
            key, size = struct.unpack_from("<8sq", whole, 8 + 16 * k)
            setattr(self, key.rstrip(b"\0").decode(), whole[at : at + 8 * size].view("<i8"))
            at += 8 * size

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each piece in the lexicon, or -1: all pieces take one arc at a time."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        size = np.diff(off)
        live = np.flatnonzero((size > 0) & (size <= LONGEST_PIECE))
        state = np.full(len(live), self.root[0])
        number = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + data[off[live] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            live, arc, number = live[ok], arc[ok], number[ok]
            number = number + self.weight[arc]
            state = self.target[arc]
            step += 1
            done = size[live] == step
            hit = done & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~done], state[~done], number[~done]
        return out

    def encode_pieces(self, vocab: bpe.Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number = self.find(words)
        known = number >= 0
        new_ids, new_ptr = vocab.merge(words.take(pa.array(np.flatnonzero(~known))))
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[known] = self.ptr[number[known]]
        size[known] = self.ptr[number[known] + 1] - start[known]
        start[~known] = new_ptr[:-1] + len(self.ids)
        size[~known] = np.diff(new_ptr)
        every = np.concatenate((self.ids, new_ids))
        return every[ragged_gather(start, size)], np.concatenate(([0], np.cumsum(size)))


@functools.lru_cache(maxsize=1)
def _lexicon(block: bytes) -> Lexicon:
    return Lexicon(block)


@functools.cache
def _token_bytes(path: str) -> pa.Array:
    return pa.array(bpe.vocabulary(path).bytes, pa.large_binary())


@functools.cache
def _decimal(path: str) -> pa.Array:
    return pa.array([f"{k},".encode() for k in range(bpe.vocabulary(path).size)], pa.large_binary())


def _joined(entries: pa.Array, ids: np.ndarray, ptr: np.ndarray) -> list[memoryview]:
    """The entries of all ids, joined by text."""
    took = entries.take(pa.array(ids))
    off = np.frombuffer(took.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = memoryview(took.buffers()[2] or b"")
    at = off[ptr]
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lexicon: list[bytes] | None = None) -> DataFrame:
    """id, ids: array of the token ids of the whole text. lexicon: pieces to compile; those frequent in ``df`` if not given."""
    run = _encoder(df, path, id_col, text_col, lexicon)

    def ids(batches):
        for column, flat, ptr, _ in run(batches):
            yield pa.RecordBatch.from_arrays([column, pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(flat.astype(np.int32)))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(ids, T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the bytes of all ids; bytes that aren't UTF-8 become U+FFFD. A null list is an empty text."""
    path = path or bpe.default_path()

    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column(ids_col), pa.scalar([], batch.column(ids_col).type))
            ptr = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))))
            out = [bytes(b).decode("utf-8", "replace") for b in _joined(_token_bytes(path), np.asarray(pc.list_flatten(lists)), ptr)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))


def _encoder(df: DataFrame, path, id_col, text_col, lexicon):
    path = path or bpe.default_path()
    words = frequent_pieces(df, text_col) if lexicon is None else lexicon
    block = df.sparkSession.sparkContext.broadcast(compile_lexicon(words, path))

    def run(batches):
        vocab, lex = bpe.vocabulary(path), _lexicon(block.value)
        merge = functools.partial(lex.encode_pieces, vocab)
        for batch in batches:
            for part in slices(batch, text_col):
                flat, ptr = vocab.encode(texts_of(part, text_col), merge)
                yield part.column(id_col), flat, ptr, part

    return run


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lexicon: list[bytes] | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and decoded_equal (is the decoded text the input?)."""
    path = path or bpe.default_path()
    run = _encoder(df, path, id_col, text_col, lexicon)

    def digest(batches):
        for column, flat, ptr, part in run(batches):
            ids = [hashlib.sha256(m[:-1] if len(m) else m).hexdigest() for m in _joined(_decimal(path), flat, ptr)]
            back = _joined(_token_bytes(path), flat, ptr)
            decoded, same = [], []
            for m, text in zip(back, texts_of(part, text_col), strict=True):
                raw = bytes(m)
                same.append(raw == text.encode())
                decoded.append(hashlib.sha256(raw if same[-1] else raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column, pa.array(np.diff(ptr)), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(same)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_equal"])

    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("decoded_equal", T.BooleanType())]
    return df.select(id_col, text_col).mapInArrow(digest, T.StructType([df.schema[id_col], *out]))


def op5_bpe_codec(spark, sf_dir) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
