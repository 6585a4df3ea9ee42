"""Digests of ordered byte blocks: SHA-256 by built-ins, BLAKE3 in numpy from the published paper."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the BLAKE3 specification: the initial value and the order of message words.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compressed(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The first eight words of the compression of many blocks at once: cv [n, 8], words [n, 16]."""
    n = len(cv)
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = cv.T, IV[:4, None]
    v[12], v[13] = counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v[14], v[15] = length, flags
    m = words.T.copy()
    quarters = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(quarters):
            for word, first, second in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] += v[b] + word
                v[d] = _turned(v[d] ^ v[a], first)
                v[c] += v[d]
                v[b] = _turned(v[b] ^ v[c], second)
        m = m[PERMUTATION]
    return (v[:8] ^ v[8:]).T


def _leaves(objects: list[bytes], first: int = 0, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The chunk values of all objects, one after another, and how many each has. ``first`` counts chunks
    before them; ``whole``: an object of one chunk is its own root."""
    sizes = np.array([len(x) for x in objects], np.int64)
    chunks = np.maximum(1, -(-sizes // 1024))
    start = np.cumsum(chunks) - chunks
    padded = np.zeros((int(chunks.sum()), 16, 16), "<u4")
    flat = padded.reshape(-1).view(np.uint8)
    for x, at in zip(objects, start.tolist()):
        flat[at * 1024 : at * 1024 + len(x)] = np.frombuffer(x, np.uint8)
    owner = np.repeat(np.arange(len(objects)), chunks)
    number = np.arange(len(owner)) - start[owner]
    size = np.minimum(1024, sizes[owner] - 1024 * number)
    blocks = np.maximum(1, -(-size // 64))
    root = np.where((chunks[owner] == 1) & whole, ROOT, 0)
    cv = np.tile(IV, (len(owner), 1))
    for k in range(int(blocks.max(initial=0))):
        at = np.flatnonzero(blocks > k)
        last = blocks[at] - 1 == k
        flags = np.where(k == 0, CHUNK_START, 0) | np.where(last, CHUNK_END | root[at], 0)
        cv[at] = compressed(cv[at], padded[at, k].astype(np.uint32), (first + number[at]).astype(np.uint64), np.clip(size[at] - 64 * k, 0, 64).astype(np.uint32), flags.astype(np.uint32))
    return cv, chunks


def _parents(left_right: np.ndarray, root: np.ndarray) -> np.ndarray:
    n = len(left_right)
    return compressed(np.tile(IV, (n, 1)), left_right, np.zeros(n, np.uint64), np.full(n, 64, np.uint32), np.where(root, PARENT | ROOT, PARENT).astype(np.uint32))


def _joined(cv: np.ndarray, counts: np.ndarray, whole: bool = True) -> np.ndarray:
    """The one value of each tree: neighbours are joined level by level, an odd last one moves up as it is."""
    while counts.max(initial=1) > 1:
        start = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(owner)) - start[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        after = (counts + 1) // 2
        begin = np.cumsum(after) - after
        out = np.empty((int(after.sum()), 8), np.uint32)
        odd = np.flatnonzero((place % 2 == 0) & (place + 1 == counts[owner]))
        out[begin[owner[odd]] + place[odd] // 2] = cv[odd]
        out[begin[owner[left]] + place[left] // 2] = _parents(np.concatenate([cv[left], cv[left + 1]], 1), (counts[owner[left]] == 2) & whole)
        cv, counts = out, after
    return cv


def blake3_all(objects: list[bytes]) -> list[str]:
    """256-bit digests in hexadecimal. Chunks of 1 KiB of all objects are compressed side by side, then joined as trees."""
    if not objects:
        return []
    raw = _joined(*_leaves(objects)).astype("<u4").tobytes()
    return [raw[32 * k : 32 * k + 32].hex() for k in range(len(objects))]


def blake3(data: bytes) -> str:
    return blake3_all([data])[0]


class Blake3:
    """The digest of data that come piece by piece. Complete subtrees of SUBTREE chunks are joined as they
    fill, so little more than one of them is held."""

    SUBTREE = 1 << 10

    def __init__(self):
        self.rest, self.chunks, self.stack = bytearray(), 0, []

    def update(self, data: bytes) -> None:
        self.rest += data
        size = self.SUBTREE * 1024
        while len(self.rest) > size:  # the last byte decides about the root, so some data always wait
            cv = _joined(*_leaves([bytes(self.rest[:size])], self.chunks, False), False)[0]
            del self.rest[:size]
            self.chunks += self.SUBTREE
            trees = self.chunks // self.SUBTREE
            while trees % 2 == 0:
                cv = _parents(np.concatenate([self.stack.pop(), cv])[None], np.zeros(1, bool))[0]
                trees //= 2
            self.stack.append(cv)

    def zeros(self, n: int) -> None:
        """``n`` zero bytes, never held at once."""
        while n > 0:
            self.update(bytes(min(n, 1 << 18)))
            n -= min(n, 1 << 18)

    def hexdigest(self) -> str:
        alone = not self.stack
        cv = _joined(*_leaves([bytes(self.rest)], self.chunks, alone), alone)[0]
        for k, left in enumerate(reversed(self.stack)):
            cv = _parents(np.concatenate([left, cv])[None], np.array([k == len(self.stack) - 1]))[0]
        return cv.astype("<u4").tobytes().hex()


#: Bytes that are digested side by side.
BATCH = 16 << 20


def blake3_hex(data: Column) -> Column:
    """BLAKE3 of a binary column; null stays null. Spark has no built-in, so batches go to numpy."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        out, held, size = [None] * len(values), [], 0
        for k, x in enumerate(values):
            if x is not None:
                held.append((k, bytes(x)))
                size += len(x)
            if held and (size >= BATCH or k == len(values) - 1):
                for (j, _), h in zip(held, blake3_all([x for _, x in held])):
                    out[j] = h
                held, size = [], 0
        for (j, _), h in zip(held, blake3_all([x for _, x in held])):
            out[j] = h
        return pd.Series(out, dtype=object)

    return digest(data)


def finished(digests: list[Blake3]) -> list[str]:
    """The digests of objects that have ended: those that fit one subtree are compressed side by side."""
    small = [k for k, d in enumerate(digests) if not d.stack]
    out = dict(zip(small, blake3_all([bytes(digests[k].rest) for k in small])))
    return [out[k] if k in out else d.hexdigest() for k, d in enumerate(digests)]


RUNNING = {"sha256": (hashlib.sha256, lambda ended: [d.hexdigest() for d in ended]), "blake3": (Blake3, finished)}


def ordered_digests(pieces: DataFrame, key: str, order: str, data: str, algorithm: str = "sha256") -> DataFrame:
    """key, digest, bytes, pieces of each object, whose ``data`` come in ``order``. One piece at a time goes
    through a running digest: an object of any size is never in one cell."""
    new, results = RUNNING[algorithm]
    columns = [key, "digest", "bytes", "pieces"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        at, digest, size, n, held, waiting = none, None, 0, 0, 0, []

        def rows() -> pd.DataFrame:
            found = results([d for _, d, _, _ in waiting])
            return pd.DataFrame([(k, h, s, m) for (k, _, s, m), h in zip(waiting, found)], columns=columns)

        for frame in frames:
            for k, x in zip(frame[key], frame[data]):
                if k != at:
                    if at is not none:
                        waiting.append((at, digest, size, n))
                        held += size
                    at, digest, size, n = k, new(), 0, 0
                digest.update(bytes(x) if x is not None else b"")
                size, n = size + (len(x) if x is not None else 0), n + 1
            if held > BATCH or len(waiting) > 10_000:
                yield rows()
                held, waiting = 0, []
        if at is not none:
            waiting.append((at, digest, size, n))
            yield rows()

    rows_of = pieces.filter(F.col(key).isNotNull()).select(key, order, data)
    kind = rows_of.schema[key].dataType.simpleString()
    return rows_of.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kind}, digest string, bytes long, pieces long")
