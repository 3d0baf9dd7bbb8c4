"""Byte-level BPE over Arrow batches.

A batch of texts is cut into pieces by array operations on code points, equal pieces are folded by a
dictionary, and only the distinct pieces are encoded. Every encoder of this module takes and returns whole texts.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken

SPACE, LETTER, NUMBER, OTHER, END = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, with one more for the end of a text."""
    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x110000] = END
    return out


def unicode_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Pieces:
    """Pieces of a list of texts. words: distinct pieces (binary); codes: of each piece in order; ptr: first piece of each text, and the end."""

    words: pa.Array
    codes: np.ndarray
    ptr: np.ndarray
    offsets: np.ndarray  # byte offset of each piece, and the end
    data: bytes


def pretokenise(texts: list[str]) -> Pieces:
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    end = (0x110000).to_bytes(4, "little")
    cp = np.frombuffer(end + end.join(raw) + end * 3, "<u4")
    kind = classes()[cp]
    n = len(cp)
    first = np.zeros(n, bool)
    ws = kind == SPACE
    # a run of other characters starts a piece, unless a plain space before it does
    first[1:] = (kind[1:] != kind[:-1]) & ~ws[1:] & (cp[:-1] != 32)
    # white space starts one where its run starts, and at its last character if something follows
    first[1:-1] |= ws[1:-1] & (~ws[:-2] | (~ws[2:] & (kind[2:] != END)))
    quote = np.flatnonzero(first[:-3] & (cp[:-3] == 39) & (kind[1:-2] == LETTER))
    if len(quote):
        a, b = cp[quote + 1], cp[quote + 2]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), "<u4"))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for where, k in ((quote[one], 2), (quote[two], 3)):
            first[where + 1] = False
            first[where + k] |= kind[where + k] == LETTER
    first &= kind != END
    starts = np.flatnonzero(first)
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    width[kind == END] = 0
    at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at[1:])
    data = "".join(texts).encode("utf-8", "surrogatepass")
    offsets = np.append(at[starts], at[-1])
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    folded = pieces.dictionary_encode()
    length = np.fromiter((len(r) // 4 + 1 for r in raw), np.int64, len(raw))
    ptr = np.searchsorted(starts, np.concatenate(([0], np.cumsum(length))))
    return Pieces(folded.dictionary, folded.indices.to_numpy(), ptr, offsets, data)


class Vocabulary:
    """Ids and merge order of a byte-level BPE file; ids follow the merge order, so an id is also a rank."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        back = unicode_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.size = max(*self.ids.values(), *self.special.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for k, v in [*self.ids.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes[v] = k
        self.pairs = {}
        for m in spec["model"]["merges"]:
            a, b = (bytes(back[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.pairs[self.ids[a], self.ids[b]] = self.ids[a + b]
        self._core = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+|\x00", mergeable_ranks=self.ids, special_tokens={})
        self._zero = self.ids[b"\0"]
        self.special_pattern = regex.compile("|".join(regex.escape(k) for k in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of each piece: all ids in order, and where each piece's ids start (and the end)."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        listed = words.to_pylist()
        odd = [k for k, w in enumerate(listed) if 0 in w]
        for k in odd:
            listed[k] = b"a"
        flat = np.asarray(self._core.encode_ordinary(b"\0".join(listed).decode("utf-8", "surrogatepass")), np.int64)
        cut = np.flatnonzero(flat == self._zero)
        ids = np.delete(flat, cut)
        ptr = np.concatenate(([0], cut - np.arange(len(cut)), [len(ids)]))
        if odd:
            parts = np.split(ids, ptr[1:-1])
            words_list = words.to_pylist()
            for k in odd:
                parts[k] = np.asarray(self._core._encode_single_piece(words_list[k]), np.int64)
            ids, ptr = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, ptr

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Cut texts at special strings: the parts, the text of each part, and the special id after each part (-1: none)."""
        parts: list[str] = []
        owner: list[int] = []
        after: list[int] = []
        for k, t in enumerate(texts):
            at = 0
            if self.special_pattern is not None and any(s in t for s in self.special):
                for m in self.special_pattern.finditer(t):
                    parts.append(t[at : m.start()])
                    owner.append(k)
                    after.append(self.special[m[0]])
                    at = m.end()
            parts.append(t[at:])
            owner.append(k)
            after.append(-1)
        return parts, np.asarray(owner, np.int64), np.asarray(after, np.int64)

    def encode(self, texts: list[str], merge=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the first id of each text (and the end). merge: another encoder of distinct pieces."""
        from ._common import ragged_gather

        parts, owner, after = self.segments(texts)
        p = pretokenise(parts)
        ids, ptr = (merge or self.merge)(p.words)
        count = ptr[1:] - ptr[:-1]
        each = count[p.codes] if len(p.codes) else np.zeros(0, np.int64)
        flat = ids[ragged_gather(ptr[:-1][p.codes], each)] if len(each) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(each)))
        part_ptr = total[p.ptr]
        if (after >= 0).any():
            put = after >= 0
            flat = np.insert(flat, part_ptr[1:][put], after[put])
            part_ptr = part_ptr + np.concatenate(([0], np.cumsum(put)))
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
        return flat, np.concatenate(([0], part_ptr[1:][last]))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
