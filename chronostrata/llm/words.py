"""Words of many texts at once, in numpy: boundaries and 64-bit hashes, without a Python step for words of up to 64 bytes."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are handled together; a longer text is handled alone.
PIECE = 1 << 20
#: Longer words are hashed by BLAKE2b.
LONG = 64
ODD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(8)
def byte_table(fold: bool) -> np.ndarray:
    """A 64-bit value for each byte; with ``fold``, A-Z have those of a-z."""
    t = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
    if fold:
        t[65:91] = t[97:123]
    return t


@functools.lru_cache(8)
def space_table(more: bytes = b"") -> np.ndarray:
    """Which bytes part words: space, tab to carriage return, and ``more``."""
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13, *more]] = True
    return t


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 65536)
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:
            return both[0][:n], both[1][:n]  # not kept
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, a line feed after each, and where each begins (one more at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.cumsum([0, *(len(t) + 1 for t in texts)])


def pieces(texts: Sequence[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes together stay below ``limit``, where one text alone does."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if len(texts) > i:
        yield i, len(texts)


def boundaries(data: np.ndarray, more: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~space_table(more)[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: equal words have equal hashes.

    Sums of powers modulo 2**64 have collisions by construction between words of a thousand letters; words
    over LONG bytes are hashed one by one instead.
    """
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte_table(fold)[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(ODD))


def document_words(texts: Sequence[bytes], fold: bool = False, more: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (one more at the end)."""
    data, at = joined(texts)
    starts, ends = boundaries(data, more)
    return hashed(data, starts, ends, fold), np.searchsorted(starts, at)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring words; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, (n * ODD) & MASK, np.uint64)
    for k in range(n):
        out += h[k : k + m] * np.uint64((BASE * (2 * k + 1) + 2 * k * ODD | 1) & MASK)
    return mixed(out)


def shingle_sets(texts: Sequence[bytes], n: int = 5, fold: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a shorter text has its whole
    sequence as its one shingle, an empty one none."""
    out: list[np.ndarray] = []
    for i, j in pieces(texts):
        h, at = document_words(texts[i:j], fold)
        w = windows(h, n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(w[a : b - n + 1]))
            else:
                out.append(windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
