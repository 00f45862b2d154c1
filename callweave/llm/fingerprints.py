"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

#: Shingles unpacked to bits at once: 64 bytes each.
BLOCK = 1 << 16


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words joined by one space; of all words if there are fewer; none for no words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; zero for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK]).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")
