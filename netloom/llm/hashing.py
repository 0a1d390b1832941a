"""Word and window hashes of whole Arrow batches with numpy, without Python strings.

A word's hash is the sum of random numbers, one for each byte and its place in the
word (tabulation), so no words are made to collide by their structure; words of
over 256 bytes take a digest instead. Runs of words are polynomials over these
hashes: they are far shorter than the words on which such polynomials fail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE_BYTES, BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
CHUNK = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = powers(self.n, self.base), powers(self.n, self.inverse)
        return self.up[:n], self.down[:n]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class WordHasher:
    #: Places of a word that have numbers of their own.
    PLACES = 256

    def __init__(self, lower: bool):
        self.table = seeds(256 * self.PLACES, 11)
        self.fold = np.arange(256, dtype=np.uint8)
        self.space = np.zeros(256, bool)
        self.space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        if lower:
            self.fold[0x41:0x5B] += 32

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words in order: hash, document (from 0), first byte, byte after the last."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, z
        word = ~self.space[data]
        edge = np.zeros(n + 1, bool)  # a word cannot run over the start of a document
        edge[off] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends[:-1] &= ~word[1:] | edge[1:n]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(s):
            return np.zeros(0, np.uint64), s, s, e
        size = e - s
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        cells = ((place & (self.PLACES - 1)) << 8) | self.fold[data[word]]
        h = mix(np.add.reduceat(self.table[cells], first) + size.astype(np.uint64))
        for i in np.flatnonzero(size > self.PLACES).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.fold[data[s[i] : e[i]]].tobytes(), digest_size=8).digest(), "little")
        return h, np.searchsorted(off, s, "right") - 1, s, e


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, seed + k, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(BASE_A) + h[j : j + n]
    return mix(acc)


def windows(h: np.ndarray, k: int, base: Powers, salt: int) -> np.ndarray:
    """As grams, by prefix sums: for long windows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = base.get(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(salt)) * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])
