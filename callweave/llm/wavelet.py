"""Wavelet matrix: a sequence of ids as bit planes with rank support.

Plane l holds bit l (from the highest) of each id, in an order that puts the zeros of every earlier plane before its
ones, each side in its former order. Ranks are kept for every BLOCK bits. So one id, a count of an id before a position,
and the k-th occurrence of an id each take one step for each plane, without the rest being decoded.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVLT1\0"
BLOCK = 512


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.bits = len(planes)
        self.ranks = [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
        return np.concatenate(([0], np.cumsum(ones))).astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(bits - 1, -1, -1):
            ones = (seq & seq.dtype.type(1 << shift)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            left = np.flatnonzero(~ones)  # indices are several times faster than masks here
            seq = seq.take(np.concatenate((left, np.flatnonzero(ones))))
            zeros.append(len(left))
        return cls(len(ids), planes, zeros)

    def to_bytes(self) -> bytes:
        head = struct.pack("<6sBQ", MAGIC, self.bits, self.n) + struct.pack(f"<{self.bits}Q", *self.zeros)
        return head + b"".join(p.tobytes() for p in self.planes) + b"".join(r.tobytes() for r in self.ranks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = struct.unpack_from("<6sBQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = struct.calcsize("<6sBQ")
        zeros = list(struct.unpack_from(f"<{bits}Q", data, at))
        at += 8 * bits
        size = (n + 7) // 8
        out = cls.__new__(cls)
        out.n, out.bits, out.zeros = n, bits, zeros
        out.planes = [np.frombuffer(data, np.uint8, size, at + i * size) for i in range(bits)]
        at += bits * size
        blocks = -(-size // (BLOCK // 8)) + 1
        out.ranks = [np.frombuffer(data, "<u4", blocks, at + i * 4 * blocks) for i in range(bits)]
        return out

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        part = self.planes[level][block * (BLOCK // 8) : (i + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of an id before position i."""
        if value >> self.bits:
            return 0
        lo, hi = 0, min(i, self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_in(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit of a plane."""
        directory = self.ranks[level].astype(np.int64)
        if not bit:
            directory = np.minimum(np.arange(len(directory)) * BLOCK, self.n) - directory
        block = int(np.searchsorted(directory, k, side="right")) - 1
        part = self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)]
        bits = np.unpackbits(part, bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(directory[block])])

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id; IndexError if there are fewer."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        lo = 0
        for level in range(self.bits):
            a = self._rank1(level, lo)
            lo = self.zeros[level] + a if value >> (self.bits - 1 - level) & 1 else lo - a
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select_in(level, bit, i - self.zeros[level] if bit else i)
        return i

    def positions(self, value: int) -> np.ndarray:
        """The positions of all occurrences of an id, ascending: their places in the last order, taken back plane by plane."""
        if value < 0 or value >> self.bits:
            return np.zeros(0, np.int64)
        lo, hi = 0, self.n
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        at = np.arange(lo, hi)
        for level in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            bit = value >> (self.bits - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            at = np.flatnonzero(bits == bit)[at - self.zeros[level] if bit else at]
        return np.sort(at)

    def occurrences(self, value: int) -> list[int]:
        return self.positions(value).tolist()

    def decode(self) -> np.ndarray:
        """All ids: the planes' orders undone from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = cur[:z]
            above[np.flatnonzero(ones)] = cur[z:] | kind(1 << (self.bits - 1 - level))
            cur = above
        return cur
