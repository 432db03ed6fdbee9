"""Hashed word shingles and MinHash signatures of whole texts, vectorised over a document's words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Hash values of a signature computed at once for a block of this many shingles.
BLOCK = 2048

_ODD = np.random.Generator(np.random.PCG64(20)).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Shingler:
    """Sets of hashed shingles; remembers the hashes of words for a while."""

    REMEMBERED = 300_000

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. Fewer words than ``width`` are one shingle; no words, none."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(codes))
        count = len(codes) - width + 1
        total = np.full(count, np.uint64(width))
        for i in range(width):
            total += codes[i : i + count] * _ODD[i]
        return np.unique(mixed(total))


class Signer:
    """MinHash signatures: minima of ``size`` linear maps of 32-bit hashes."""

    def __init__(self, size: int, seed: int = 7):
        random = np.random.Generator(np.random.PCG64(seed))
        self.factor = random.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
        self.shift = random.integers(0, 1 << 32, size, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.factor), np.uint32(0xFFFFFFFF))
        for at in range(0, len(low), BLOCK):
            block = low[at : at + BLOCK, None] * self.factor + self.shift
            np.minimum(best, block.min(axis=0), out=best)
        return best


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))
