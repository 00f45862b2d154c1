"""Many Hamming distances at once on vertical bit planes.

Fingerprints are stored as 64 planes, lane i of plane j being bit j of fingerprint i. Distances of 64 lanes are counted
together: seven XOR planes go through a carry-save tree into three partial sums, which are added to bitwise counters. The
counters start so far below their end that the carry out of the last one says "over the radius"; words whose lanes are
all over it are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Groups of up to so many rows are compared lag by lag, larger ones query by query.
LAGGED = 64
#: Queries compared with a large group at once.
QUERIES = 64


def vertical(fps: np.ndarray, spare: int = 1) -> np.ndarray:
    """The 64 planes of fingerprints, as words of 64 lanes, with spare empty words behind."""
    n = len(fps)
    words = (n + 63) // 64 + spare
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def lanes(mask: np.ndarray) -> np.ndarray:
    """A boolean array as words of 64 lanes."""
    out = np.zeros((len(mask) + 63) // 64 * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def _add(counter: list[np.ndarray], at: int, carry: np.ndarray, dead: np.ndarray) -> np.ndarray:
    for i in range(at, len(counter)):
        counter[i], carry = counter[i] ^ carry, counter[i] & carry
    return dead | carry


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def over(xor_plane: Callable[[int, np.ndarray], np.ndarray], dead: np.ndarray, radius: int) -> np.ndarray:
    """For each word, the lanes whose distance is over the radius, or that were dead before.

    xor_plane(j, words): plane j of the XOR of both sides, for these words.
    """
    out = dead.copy()
    words = np.flatnonzero(dead != FULL)
    dead = dead[words]
    bits = max(3, radius.bit_length())
    offset = (1 << bits) - 1 - radius
    counter = [np.full(len(words), FULL if offset >> i & 1 else 0, np.uint64) for i in range(bits)]
    for first in range(0, 64, 7):
        if not len(words):
            return out
        x = [xor_plane(j, words) for j in range(first, min(first + 7, 64))]
        if len(x) == 7:
            s1, c1 = _full(x[0], x[1], x[2])
            s2, c2 = _full(x[3], x[4], x[5])
            s, c3 = _full(s1, s2, x[6])
            twos, fours = _full(c1, c2, c3)
            dead = _add(counter, 0, s, dead)
            dead = _add(counter, 1, twos, dead)
            dead = _add(counter, 2, fours, dead)
        else:
            for p in x:
                dead = _add(counter, 0, p, dead)
        out[words] = dead
        alive = dead != FULL
        if not alive.all():
            words, dead, counter = words[alive], dead[alive], [c[alive] for c in counter]
    return out


def alive_lanes(dead: np.ndarray) -> np.ndarray:
    """The positions of the lanes that are not dead, over all words in order."""
    words = np.flatnonzero(dead != FULL)
    bits = np.unpackbits((~dead[words]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return words[at] * 64 + lane


def near_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal key whose fingerprints differ in at most radius bits, as arrays of rows; keys are sorted.

    Pairs come in bounded portions, for the caller to merge; memory follows the rows, not the pairs.
    """
    n = len(keys)
    if not n:
        return
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, n))
    small = (sizes > 1) & (sizes <= LAGGED)
    if small.any():
        order = np.argsort(-sizes[small], kind="stable")
        start, size = first[small][order], sizes[small][order]
        rows = _runs(start, size)
        left = np.repeat(size, size) - (np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size))  # rows of its group from each on
        planes = vertical(fps[rows], spare=3)
        span = np.repeat(size, size)
        for lag in range(1, int(size[0])):
            m = int(np.searchsorted(-span, -lag, side="left"))  # rows in groups larger than lag
            dead = ~lanes(left[:m] > lag)
            q, r = np.uint64(lag // 64), np.uint64(lag % 64)

            def xor(j: int, w: np.ndarray, q=int(q), r=r) -> np.ndarray:
                p = planes[j]
                other = p[w + q] if not r else (p[w + q] >> r) | (p[w + q + 1] << (np.uint64(64) - r))
                return p[w] ^ other

            at = alive_lanes(over(xor, dead, radius))
            if len(at):
                yield rows[at], rows[at + lag]
    for k in np.flatnonzero(sizes > LAGGED):
        lo, size = int(first[k]), int(sizes[k])
        planes = vertical(fps[lo : lo + size], spare=0)
        width = planes.shape[1]
        lane = np.arange(width * 64)
        for q0 in range(0, size, QUERIES):
            queries = np.arange(q0, min(q0 + QUERIES, size))
            skip = q0 // 64  # earlier rows were queries themselves
            wide = width - skip
            bits = (fps[lo + queries][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            masks = np.where(bits.astype(bool), FULL, np.uint64(0))
            valid = (lane[None, skip * 64 :] > queries[:, None]) & (lane[None, skip * 64 :] < size)
            dead = ~np.concatenate([lanes(v) for v in valid])

            def xor(j: int, w: np.ndarray, wide=wide, skip=skip, masks=masks) -> np.ndarray:
                return planes[j][skip + w % wide] ^ masks[w // wide, j]

            at = alive_lanes(over(xor, dead, radius))
            if len(at):
                yield lo + queries[at // (wide * 64)], lo + skip * 64 + at % (wide * 64)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; parent points to smaller members and ends at roots."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
