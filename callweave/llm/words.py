"""Words of texts as 64-bit hashes, and hashes of runs of words, for whole slices at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

#: Any odd number with mixed bits: runs of hashes are polynomials in it modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def split(texts: list[bytes], table: bytes | None = None) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each text between bytes 9 to 13 and 32, after bytes.translate(table); and their numbers."""
    words = [(t.translate(table) if table else t).split() for t in texts]
    return words, np.fromiter(map(len, words), np.int64, len(words))


def hashes(words: list[list[bytes]], total: int) -> np.ndarray:
    """XXH64 of all words, in order."""
    return np.fromiter((h for w in words for h in map(xxhash.xxh64_intdigest, w)), np.uint64, total)


def runs(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all runs of k, from those of half the length; mixed, so that any bits may be used."""
    out, length = h, 1
    for bit in bin(k)[3:]:
        out = _then(out, out, length, length, base)
        length *= 2
        if bit == "1":
            out = _then(out, h, length, 1, base)
            length += 1
    return mix(out)


def _then(a: np.ndarray, b: np.ndarray, la: int, lb: int, base: int) -> np.ndarray:
    """Hashes of runs of la + lb from those of la and lb."""
    n = min(len(a), len(b) - la)
    if n <= 0:
        return np.zeros(0, np.uint64)
    return a[:n] * np.uint64(pow(base, lb, 1 << 64)) + b[la : la + n]


def starts(counts: np.ndarray, k: int) -> np.ndarray:
    """Positions in the texts' joined words at which a run of k lies within one text."""
    ends = np.cumsum(counts)
    n = np.maximum(counts - k + 1, 0)
    total = int(n.sum())
    first = ends - counts
    return np.arange(total) + np.repeat(first - (np.cumsum(n) - n), n)
