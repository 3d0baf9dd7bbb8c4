"""Token counts of every prefix of a text.

``last[p]``, the last token of the first ``p`` bytes of a piece, is the longest vocabulary entry ending at ``p`` that may stand
after ``last[p - len]``; the count at ``p`` is the count there plus one. One pass gives the exact count of every prefix, so
truncation and budget questions need no further encoding.

Nulls count as empty texts; very long texts and pieces are counted whole; rows with a null id, repeated ids and empty tables are passed through row by row. Only the id and
the columns listed here are returned, so other columns can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._common import ragged_gather, slices, table, texts_of

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Longer pieces take a loop by position instead of steps over all pieces.
LONG_PIECE = 256


class Lookup:
    """Values of 64-bit keys, -1 for absent ones: open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.values[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]
            self.values[slot[todo[free]]] = values[todo[free]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        more = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            s = slot[more]
            hit = (self.keys[s] == keys[more]) & (self.values[s] >= 0)
            out[more[hit]] = self.values[s[hit]]
            more = more[~hit & (self.values[s] >= 0)]
        return out


def _edges_blank(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Does each piece end, and does it start, with white space?"""
    n = len(words)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    out = []
    for at, char in ((off[1:] - 1, -1), (off[:-1], 0)):
        byte = data[np.clip(at, 0, len(data) - 1)]
        blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
        for k in np.flatnonzero(byte >= 0x80).tolist():
            blank[k] = bpe.classes()[ord(words[k].as_py().decode("utf-8", "surrogatepass")[char])] == bpe.SPACE
        out.append(blank & (off[1:] > off[:-1]))
    return out[0], out[1]


def _bytes_of(change: np.ndarray) -> np.ndarray:
    """One more byte takes away fewer tokens than the longest entry has bytes, so changes fit; checked, as vocabularies are parameters."""
    if len(change) and np.abs(change).max() > 127:
        raise OverflowError("a count changes by more than 127 within one byte")
    return change.astype(np.int8)


class PrefixCounter:
    def __init__(self, path: str):
        self.vocab = v = bpe.vocabulary(path)
        self.longest = max(map(len, v.ids))
        self.width = np.array([len(b) for b in v.bytes], np.int32)
        self.power = np.ones(1, np.uint64)
        listed = list(v.ids)
        data = np.frombuffer(b"".join(listed), np.uint8)
        ends = np.cumsum([len(b) for b in listed])
        starts = ends - [len(b) for b in listed]
        total = self._sums(data)
        self.find = Lookup((total[ends] - total[starts]) * self._inverse(int(starts.max()) + 1)[starts], np.array([v.ids[b] for b in listed], np.int32))
        pairs = np.array(list(v.pairs), np.uint64)
        self.pair = Lookup((pairs[:, 0] << np.uint64(32)) | pairs[:, 1], np.array(list(v.pairs.values()), np.int32))
        self.left = np.arange(v.size, dtype=np.int32)
        self.right = np.arange(v.size, dtype=np.int32)
        for (a, b), c in v.pairs.items():
            self.left[c], self.right[c] = a, b

    def _sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(data):
            n = 1 << int(len(data) + 1).bit_length()
            self.power = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, BASE)), dtype=np.uint64)
            self.inverse = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, INVERSE)), dtype=np.uint64)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=out[1:])
        return out

    def _inverse(self, n: int) -> np.ndarray:
        return self.inverse[:n]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do a, b stay two tokens when the bytes of both are encoded together? Undoes merges from the later one on."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, m = a[live], b[live], limit[live]
            made = self.pair((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            bad = (made >= 0) & (made < m)
            out[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # undo the later merge; where that token is a single byte, the other one; where both are, nothing crosses
            later = x > y
            x_one, y_one = self.left[x] == x, self.left[y] == y
            undo_x = (later & ~x_one) | (~later & y_one & ~x_one)
            undo_y = (~later & ~y_one) | (later & x_one & ~y_one)
            limit[live[undo_x]] = x[undo_x]
            a[live[undo_x]] = self.right[x[undo_x]]
            limit[live[undo_y]] = y[undo_y] + 1
            b[live[undo_y]] = self.left[y[undo_y]]
            live = live[undo_x | undo_y]
        return out

    def _entries(self, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All vocabulary entries inside the pieces: for each byte the number of the longest that ends there (-1: none), then of each entry
        its token and the number of the next shorter one. inside: length of the prefix that ends with each byte."""
        n = len(data)
        total = self._sums(data)
        head = np.full(n, -1, np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        count = 0
        where = np.arange(n)
        for k in range(1, min(self.longest, int(inside.max())) + 1):
            where = where[inside[where] >= k]
            begin = where - (k - 1)
            got = self.find((total[where + 1] - total[begin]) * self.inverse[begin])
            hit = got >= 0
            at, got = where[hit], got[hit]
            good = self.width[got] == k
            at, got = at[good], got[good]
            made.append((got, head[at]))
            head[at] = count + np.arange(len(at))
            count += len(at)
        return head, np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    def _by_steps(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Counts at every byte of the pieces (ends of prefixes), in the order of data."""
        n = len(data)
        inside = np.arange(n) - np.repeat(starts, sizes) + 1
        head, token, shorter = self._entries(data, inside)
        last = np.zeros(n, np.int64)
        counts = np.zeros(n, np.int32)
        order = np.argsort(inside, kind="stable")
        bounds = np.searchsorted(inside[order], np.arange(1, int(sizes.max()) + 2))
        for p in range(1, int(sizes.max()) + 1):
            at = order[bounds[p - 1] : bounds[p]]
            tried = head[at]
            while len(at):
                t = token[tried]
                before = at - self.width[t]
                whole = self.width[t] == p
                ok = whole.copy()
                rest = np.flatnonzero(~whole)
                ok[rest] = self.follows(last[before[rest]], t[rest])
                counts[at[ok]] = np.where(whole[ok], 1, counts[before[ok]] + 1)
                last[at[ok]] = t[ok]
                at, tried = at[~ok], shorter[tried[~ok]]
        return counts

    @functools.lru_cache(maxsize=1 << 18)
    def _follows_one(self, a: int, b: int) -> bool:
        return bool(self.follows(np.array([a]), np.array([b]))[0])

    def _by_position(self, piece: np.ndarray) -> np.ndarray:
        """The same for one long piece: entries by array operations, then one step a byte."""
        n = len(piece)
        head, token, shorter = (x.tolist() for x in self._entries(piece, np.arange(1, n + 1)))
        width = self.width.tolist()
        last, counts = [0] * (n + 1), [0] * (n + 1)
        for p in range(1, n + 1):
            e = head[p - 1]
            while e >= 0:
                t = token[e]
                before = p - width[t]
                if not before or self._follows_one(last[before], t):
                    last[p], counts[p] = t, counts[before] + 1
                    break
                e = shorter[e]
        return np.array(counts[1:], np.int32)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """int8 change of the count at each byte of each distinct piece, and the first byte of each piece (and the end)."""
        n = len(words)
        off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        sizes = np.diff(off)
        counts = np.zeros(len(data), np.int32)
        short = np.flatnonzero((sizes <= LONG_PIECE) & (sizes > 0))
        if len(short):
            at = ragged_gather(off[short], sizes[short])
            counts[at] = self._by_steps(data[at], np.concatenate(([0], np.cumsum(sizes[short])[:-1])), sizes[short])
        for k in np.flatnonzero(sizes > LONG_PIECE):
            counts[off[k] : off[k + 1]] = self._by_position(data[off[k] : off[k + 1]])
        delta = counts.copy()
        delta[1:] -= counts[:-1]
        first = off[:-1][sizes > 0]
        delta[first] = counts[first]
        # "'r" and the like, cut before the contraction is whole, are two pieces
        for k in np.flatnonzero(sizes == 3):
            if data[off[k]] == 39 and data[off[k] : off[k] + 3].tobytes() in (b"'re", b"'ve", b"'ll"):
                whole = counts[off[k] + 2]
                delta[off[k] : off[k] + 3] = [1, 1, whole - 2]
        return _bytes_of(delta), off

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """int8 change of the count at each byte of all texts, and the first byte of each text (and the end)."""
        parts, owner, after = self.vocab.segments(texts)
        p = bpe.pretokenise(parts)
        delta, off = self.words(p.words)
        size = np.diff(off)
        sums = np.concatenate(([0], np.cumsum(delta, dtype=np.int64)))[off]
        flat = delta[ragged_gather(off[:-1][p.codes], size[p.codes])] if len(p.codes) else np.zeros(0, np.int8)
        flat = flat.astype(np.int8, copy=True)
        self._white_space(p, flat)
        bytes_ptr = p.offsets[p.ptr]
        if (after >= 0).any():
            pieces = []
            for k, special in enumerate(after):
                pieces.append(flat[bytes_ptr[k] : bytes_ptr[k + 1]])
                if special >= 0:
                    name = self.vocab.bytes[special].decode()
                    # what is added can change no more than the last two pieces
                    lo, hi = int(p.ptr[k]), int(p.ptr[k + 1])
                    cut = max(lo, hi - 2)
                    before = int(np.diff(sums)[p.codes[lo:cut]].sum())
                    tail = p.data[p.offsets[cut] : p.offsets[hi]].decode("utf-8", "surrogatepass")
                    _, ptr = self.vocab.encode([tail + name[:i] for i in range(len(name))])
                    counts = before + np.diff(ptr)
                    pieces.append(_bytes_of(np.diff(np.append(counts, counts[0] + 1))))
            flat = np.concatenate(pieces)
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
        return flat, np.concatenate(([0], ends))

    def _white_space(self, p: bpe.Pieces, flat: np.ndarray) -> None:
        """A prefix that ends with a run of white space has one piece there, where the whole text has two."""
        if len(p.codes) < 2:
            return
        blank, opens = _edges_blank(p.words)
        k = np.flatnonzero(blank[p.codes[:-1]] & opens[p.codes[1:]])
        inner = np.ones(len(p.codes), bool)
        inner[p.ptr[:-1][p.ptr[:-1] < len(p.codes)]] = False  # first pieces of texts
        k = k[inner[k + 1]]
        known: dict[tuple[int, int], int] = {}
        for i in k.tolist():
            a, b = int(p.codes[i]), int(p.codes[i + 1])
            one = p.words[b].as_py().decode("utf-8", "surrogatepass")[0].encode()
            if (a, b) not in known:
                known[a, b] = len(self.vocab._core._encode_single_piece(p.words[a].as_py() + one))
            at, width = int(p.offsets[i + 1]), len(one)
            change = known[a, b] - int(flat[p.offsets[i] : at + width].sum(dtype=np.int64))
            flat[at + width - 1] += change
            if at + width < len(flat):
                flat[at + width] -= change


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, and prefix_delta: for each byte of the text, in one byte, the change of the
    token count; the running sum at the end of a character is the exact count of the prefix that ends there."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in slices(batch, text_col):
                flat, ptr = c.texts(texts_of(part, text_col))
                sums = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
                delta = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ptr.astype(np.int32)), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(ptr)), pa.array(sums[ptr[1:]] - sums[ptr[:-1]]), delta], [id_col, "n_bytes", "n_tokens", "prefix_delta"])

    schema = T.StructType([df.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_delta", T.BinaryType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def longest_prefix(counts: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """From the result of :func:`prefix_counts`: the most bytes of each text whose prefix has at most ``limit`` tokens."""

    def run(batches):
        for batch in batches:
            out = [int(np.append(np.flatnonzero(np.cumsum(np.frombuffer(d or b"", np.int8), dtype=np.int64) <= limit) + 1, 0).max()) if d else 0 for d in batch.column("prefix_delta").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.int64())], [id_col, "n_bytes_kept"])

    return counts.select(id_col, "prefix_delta").mapInArrow(run, T.StructType([counts.schema[id_col], T.StructField("n_bytes_kept", T.LongType())]))


def over(limit: int, n_tokens: str = "n_tokens") -> Column:
    return F.col(n_tokens) > limit


def op2_token_counts(spark, sf_dir) -> DataFrame:
    got = prefix_counts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_tokens", over(1024).alias("over_limit"))
