"""Words of many texts by array operations.

A word is a longest run of ASCII letters and digits and of bytes beyond ASCII; A-Z and the capitals of Latin-1 are lowered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._common import mix64

BASE = 0x9E3779B97F4A7C15 | 1
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".!?\n"]] = True
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    base &= (1 << 64) - 1
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, int(n) * 9 // 8)
        have = _powers[base] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, base, np.uint64)), dtype=np.uint64)
    return have


def inverse_powers(n: int, base: int = BASE) -> np.ndarray:
    return powers(n, pow(base, -1, 1 << 64))


def sums(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Running sums of (byte + 1) * base ** place: differences, times an inverse power, are hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base)[: len(data)], out=out[1:])
    return out


@dataclass
class Words:
    data: np.ndarray  # all texts in UTF-8, each followed by a line feed
    text_start: np.ndarray
    start: np.ndarray  # bytes of each word
    end: np.ndarray
    text: np.ndarray  # text of each word
    hash: np.ndarray


def words(texts: list[str]) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    text_start = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))[:-1] if raw else np.zeros(0, np.int64)
    low = LOWER[data]
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[accent] += 32
    w = WORD[data]
    start = np.flatnonzero(w & ~np.concatenate(([False], w[:-1])))
    end = np.flatnonzero(w & ~np.concatenate((w[1:], [False]))) + 1
    total = sums(low)
    h = mix64((total[end] - total[start]) * inverse_powers(len(data))[start])
    text = np.searchsorted(text_start, start, "right") - 1
    return Words(data, text_start, start, end, text, h)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of k words of a text; all words of a text that has fewer."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    base = powers(k)
    first = np.searchsorted(w.text, w.text, "left")
    last = np.searchsorted(w.text, w.text, "right")
    for j in range(min(k, n)):
        h[: n - j] += np.where(np.arange(n - j) + j < last[: n - j], w.hash[j:] * base[j + 1], 0).astype(np.uint64)
    whole = np.arange(n) + k <= last
    short = (np.arange(n) == first) & (last - first < k)
    at = np.flatnonzero(whole | short)
    return mix64(h[at] ^ np.uint64(0x5851F42D4C957F2D)), w.text[at]
