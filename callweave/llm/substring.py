"""Substring deduplication: removal of repeated windows of words.

Each window of k words has a Rabin-Karp hash. In two rounds of `packed` questions the windows' hashes are counted: the
first counts their upper 32 + b bits (b bits name the partition), which leaves the windows that may be repeated; the
second tells, for those, which slice has the earliest of each word sequence. A sequence is known there by two Rabin-Karp
hashes of 64 bits to different bases: among 10 ** 13 windows, two of different words' hashes are taken for the same once
in 10 ** 12 corpora; and words of one XXH64 matter where the nineteen words beside them are the same. A slice then knows
for each window whether its sequence starts earlier; such windows merge into maximal intervals, and their words go.

Texts of fewer than k words and null texts lose nothing. "Earlier" is a smaller doc_id (null ids first) or, in a
document, an earlier start; rows of equal doc_id are in the order of their slices. Windows are judged on the input. A very
long text is a slice of its own and is held whole by one worker, some ten times its bytes. No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed
from .common import BLOB_ROWS, stored
from .words import hashes, runs, split, starts

#: The base of the windows' second hashes: any odd number.
OTHER_BASE = 0xA0761D6478BD642F


@dataclass
class _Windows:
    """Of a slice's row: words, their counts, their hashes, window positions, window hashes."""

    words: list[list[bytes]]
    counts: np.ndarray
    each: np.ndarray
    at: np.ndarray
    one: np.ndarray
    k: int

    def two(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Second hashes of some windows."""
        return runs(self.each, self.k, OTHER_BASE)[self.at[which]] if len(self.at) else self.one


def _windows(row: pa.RecordBatch, k: int) -> _Windows:
    words, counts = split(packed.texts_of(row))
    at, each = starts(counts, k), hashes(words, int(counts.sum()))
    return _Windows(words, counts, each, at, runs(each, k)[at] if len(at) else np.zeros(0, np.uint64), k)


def _first_ids(row: pa.RecordBatch, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The doc_id of each window; a null is the least long."""
    ids = np.array([-(1 << 63) if i is None else i for i in packed.ids_of(row).to_pylist()], np.int64)
    return ids[np.searchsorted(np.cumsum(counts), at, side="right")]


def _flags(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def _unflag(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").view(bool)


def _repeated(slices: packed.Slices, k: int, parts: int) -> DataFrame:
    """First round. Answers: for the distinct hash tops of a slice and partition, whether another slice has them."""
    low = np.uint64(32 - (parts.bit_length() - 1))

    def ask(row: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        tops = np.unique(_windows(row, k).one >> low)
        for p, a, b in packed.cut(tops << low, parts):
            yield p, tops[a:b].astype(np.uint32).tobytes()

    def answer(part: int, numbers: list[int], questions: list[bytes]) -> Iterator[tuple[int, bytes]]:
        values = np.concatenate([np.frombuffer(q, np.uint32) for q in questions])
        order = np.sort(values)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        for number, q in zip(numbers, questions, strict=True):
            own = np.frombuffer(q, np.uint32)
            hit = np.isin(own, twice, assume_unique=True)
            if hit.any():
                yield number, _flags(hit)

    return packed.answered(slices, packed.asked(slices.frame, ask), answer)


def _candidates(row: pa.RecordBatch, h: np.ndarray, parts: int) -> np.ndarray:
    """Which windows have a hash top that another slice has."""
    low = np.uint64(32 - (parts.bit_length() - 1))
    tops = np.unique(h >> low)
    hit = np.zeros(len(tops), bool)
    flags = {a["part"]: a["answer"] for a in row.column(row.schema.get_field_index("answers"))[0].as_py() or ()}
    for p, a, b in packed.cut(tops << low, parts):
        if p in flags:
            hit[a:b] = _unflag(flags[p], b - a)
    return hit[np.searchsorted(tops, h >> low)]


def _later(slices: packed.Slices, rows: DataFrame, k: int, parts: int) -> DataFrame:
    """Second round. Answers: the hashes of a slice of which another slice has an earlier window."""

    def ask(row: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        w = _windows(row, k)
        may = np.flatnonzero(_candidates(row, w.one, parts)) if len(w.one) else w.at
        if len(may):
            one, two = w.one[may], w.two(may)
            order = np.lexsort((two, one))  # documents ascend: the first of equal ones is the earliest
            one, two = one[order], two[order]
            first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            ids = _first_ids(row, w.counts, w.at[may][order[first]])
            one, two = one[first], two[first]
            for p, a, b in packed.cut(one, parts):
                yield p, np.concatenate((one[a:b].view(np.int64), two[a:b].view(np.int64), ids[a:b])).tobytes()

    def answer(part: int, numbers: list[int], questions: list[bytes]) -> Iterator[tuple[int, bytes]]:
        thirds = [np.frombuffer(q, np.int64).reshape(3, -1) for q in questions]
        sizes = [x.shape[1] for x in thirds]
        one, two, ids = (np.concatenate([x[i] for x in thirds]) for i in range(3))
        number = np.repeat(np.array(numbers), sizes)
        order = np.lexsort((number, ids, two, one))
        later = np.zeros(len(one), bool)
        later[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        ends = np.cumsum(sizes)
        for own, lo, hi in zip(numbers, ends - sizes, ends, strict=True):
            if (hit := later[lo:hi]).any():
                yield own, np.concatenate((one[lo:hi][hit], two[lo:hi][hit])).tobytes()

    return packed.answered(slices, packed.asked(rows, ask), answer)


def _repeats(w: _Windows, later: list[np.ndarray]) -> np.ndarray:
    """Which windows of a slice have an earlier one: in the slice, or by the answers."""
    one, two = w.one, w.two()
    order = np.argsort(one, kind="stable")
    ordered = one[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(one)]
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(one)), 0))] if len(one) else order
    out = np.zeros(len(one), bool)
    out[order] = ~fresh & (two[first] == two[order])
    if later and len(one):
        known = np.concatenate(later, axis=1)
        known = known[:, np.argsort(known[0], kind="stable")]
        at = np.minimum(np.searchsorted(known[0], one), known.shape[1] - 1)
        out |= (known[0][at] == one) & (known[1][at] == two)
    return out


def removed(counts: np.ndarray, at: np.ndarray, repeats: np.ndarray, k: int) -> np.ndarray:
    """Which words a repeated window covers: the windows' union as maximal intervals."""
    edge = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(edge, at[repeats], 1)
    np.add.at(edge, at[repeats] + k, -1)
    return np.cumsum(edge)[:-1] > 0


def deduplicated(docs: DataFrame, k: int = 20, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept (the words left, joined by a space) if text; one row for each of docs (doc_id, text)."""
    slices = packed.sliced(docs)
    parts = slices.partitions()
    rows = packed.joined(slices.frame, _repeated(slices, k, parts))
    later = _later(slices, rows, k, parts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                w = _windows(row, k)
                counts = w.counts
                answers = row.column(row.schema.get_field_index("answers"))[0].as_py() or ()
                repeats = _repeats(w, [np.frombuffer(a["answer"], np.uint64).reshape(2, -1) for a in answers])
                gone = removed(counts, w.at, repeats, k)
                ends = np.cumsum(counts)
                n_removed, kept = [], []
                for own, lo, hi in zip(w.words, (ends - counts).tolist(), ends.tolist(), strict=True):
                    mask = gone[lo:hi]
                    n = int(mask.sum())
                    n_removed.append(n)
                    kept.append(b" ".join([w for w, g in zip(own, mask.tolist(), strict=True) if not g] if n else own))
                columns = [packed.ids_of(row), pa.array(counts), pa.array(n_removed, pa.int64()), pa.array([sha256(t).hexdigest() for t in kept])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([t.decode() for t in kept])] * text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text)

    return stored(packed.joined(slices.frame, later).mapInArrow(run, schema), "deduplicated", BLOB_ROWS)[0]
