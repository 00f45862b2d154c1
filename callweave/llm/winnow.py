"""Benchmark decontamination by winnowing.

Texts are sequences of words. Of each W consecutive hashes of K words the least (rightmost on ties) is a fingerprint, on
both sides; so a shared span of K + W - 1 = N words has a fingerprint in common. Documents' fingerprints are joined with
the benchmark's, and a hit is extended by looking up the windows of N words around it, as exact words. Items of fewer
than N words are one window of all their words; winnowing can't promise those, so their lengths are looked up directly.

A benchmark whose index takes CARRIED bytes at most is carried to the executors. A larger one is joined in Spark: document
fingerprints with their surrounding words against the windows that hold each fingerprint (`_hits_joined`).

Null texts have no words, items without words and items without an id are no items. Rows of equal item_id are one item.
Documents' ids may be null or repeated: each row is judged by its own text. No rows give none.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, filtered, ship, stored, utf8
from .words import hashes, runs, split, starts

N, K, W = 8, 5, 4
#: Bytes of a benchmark's index that may be carried to the executors, and bytes of its text from which an index is not tried.
CARRIED, TRIED = 32 << 20, 4 << 20
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]")
#: Lower-cases A-Z; what is in no word becomes a space.
TABLE = bytes(c if _WORD.fullmatch(bytes([c])) else 32 for c in bytes(range(256)).lower())


def fingerprints(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts' joined word hashes: the positions of winnowed K-grams, ascending, and their hashes."""
    grams = runs(h, K)
    first = starts(counts, N)  # each window of N words has W K-grams
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = grams[first], first.copy()
    for j in range(1, W):
        other = grams[first + j]
        lower = other <= least
        least = np.where(lower, other, least)
        at[lower] = first[lower] + j
    at = np.unique(at)
    return at, grams[at]


class Index:
    """Windows of benchmark items with their items, the fingerprints that lead to them, and the lengths of short items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        windows: dict[bytes, set[str]] = defaultdict(set)
        words, counts = split([t for _, t in items], TABLE)
        for (item, _), w in zip(items, words, strict=True):
            if w:
                for i in range(max(1, len(w) - N + 1)):
                    windows[b" ".join(w[i : i + N])].add(item)
        self.windows = {k: tuple(sorted(v)) for k, v in windows.items()}
        self.prints = np.unique(fingerprints(hashes(words, int(counts.sum())), counts)[1])
        short = sorted({len(w) for w in words if 0 < len(w) < N})
        self.short = {n: np.unique(np.concatenate([runs(hashes([w], n), n) for w in words if len(w) == n])) for n in short}

    def size(self) -> int:
        """Bytes that it takes to send."""
        return len(pickle.dumps(self))

    def hits(self, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(positions, n): places where a window of n words may occur, of texts' joined word hashes."""
        if len(self.prints):
            at, grams = fingerprints(h, counts)
            at = at[_in(grams, self.prints)]
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, at, side="right")
            near = (at[:, None] - np.arange(W)[None, :]).ravel()
            doc = np.repeat(doc, W)
            inside = (near >= (ends - counts)[doc]) & (near + N <= ends[doc])
            yield np.unique(near[inside]), N
        for n, known in self.short.items():
            at = starts(counts, n)
            yield at[_in(runs(h, n)[at], known)] if len(at) else at, n


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _covered(places: list[tuple[int, int]], total: int) -> int:
    """Words inside any of (start, length)."""
    mask = np.zeros(total, bool)
    for at, n in places:
        mask[at : at + n] = True
    return int(mask.sum())


def _result(doc_ids: pa.Array, counts: np.ndarray, places: dict[int, list[tuple[int, int]]], found: dict[int, set[str]]) -> pa.RecordBatch:
    rows = range(len(counts))
    items = [sorted(found.get(i, ())) for i in rows]
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(counts),
            pa.array([_covered(places[i], int(counts[i])) if i in places else 0 for i in rows], pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([sha256(",".join(x).encode()).hexdigest() for x in items]),
            pa.array(items, pa.list_(pa.string())),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items"],
    )


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"


def _found(index: Index, texts: list[bytes]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """For texts: their words, places (start, words) of occurring windows, and those windows' items."""
    words, counts = split(texts, TABLE)
    ends = np.cumsum(counts)
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for at, n in index.hits(hashes(words, int(counts.sum())), counts):
        doc = np.searchsorted(ends, at, side="right")
        for i, p in zip(doc.tolist(), (at - (ends - counts)[doc]).tolist(), strict=True):
            if (got := index.windows.get(b" ".join(words[i][p : p + n]))) is not None:
                places[i].append((p, n))
                items[i].update(got)
    return counts, places, items


def _carried(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1, 4 << 20):
            yield _result(b.column(0), *_found(shared.value, b.column(1).to_pylist()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, SCHEMA)


def _hits_joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same rows for a benchmark of any size: fingerprints (and short lengths) joined in Spark with the windows around them."""
    lengths = benchmark.select("item", F.size("words").alias("n")).where("n < 8").select("n").distinct()
    short = [r["n"] for r in lengths.collect()]  # seven lengths at most

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for item, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hashes([w], len(w))
                if len(w) < N:
                    rows.append((int(runs(h, len(w))[0].view(np.int64)), len(w), 0, b" ".join(w), item))
                    continue
                for at, key in zip(*fingerprints(h, np.array([len(w)])), strict=True):
                    rows += [(int(key.view(np.int64)), N, int(at) - s, b" ".join(w[s : s + N]), item) for s in range(max(0, int(at) - W + 1), min(int(at), len(w) - N) + 1)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "n", "back", "seq", "item"])

    def prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "t", 1 << 20):
            words, counts = split(b.column(1).to_pylist(), TABLE)
            h = hashes(words, int(counts.sum()))
            ends = np.cumsum(counts)
            for n in (N, *short):
                at, keys = fingerprints(h, counts) if n == N else ((p := starts(counts, n)), runs(h, n)[p] if len(p) else np.zeros(0, np.uint64))
                if len(at):
                    doc = np.searchsorted(ends, at, side="right")
                    own = (at - (ends - counts)[doc]).tolist()
                    before = [min(p, W - 1) if n == N else 0 for p in own]
                    around = [b" ".join(words[i][p - q : p + (N if n == N else n)]) for i, p, q in zip(doc.tolist(), own, before, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(keys.view(np.int64)), pa.array([n] * len(at), pa.int32()), pa.array(own, pa.int64()), pa.array(before, pa.int32()), pa.array(around, pa.binary())], ["row", "key", "n", "pos", "before", "around"])

    texts, _ = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).withColumn("row", F.monotonically_increasing_id()), "texts")
    known = benchmark.mapInArrow(windows, "key long, n int, back int, seq binary, item string").distinct()
    asked = texts.select("row", "t").mapInArrow(prints, "row long, key long, n int, pos long, before int, around binary")
    met = asked.join(known, ["key", "n"]).where(F.col("back") <= F.col("before"))
    words = F.split(F.decode("around", "utf-8"), " ")
    seq = F.encode(F.array_join(F.slice(words, F.col("before") - F.col("back") + 1, F.col("n")), " "), "utf-8")
    exact = met.where(seq == F.col("seq")).select("row", (F.col("pos") - F.col("back")).alias("pos"), "n", "item")
    hits = exact.groupBy("row").agg(F.collect_set(F.struct("pos", "n")).alias("places"), F.collect_set("item").alias("items"))

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "t", 4 << 20):
            _, counts = split(b.column(1).to_pylist(), TABLE)
            places = {i: [(p["pos"], p["n"]) for p in x] for i, x in enumerate(b.column(2).to_pylist()) if x}
            yield _result(b.column(0), counts, places, {i: set(x) for i, x in enumerate(b.column(3).to_pylist()) if x})

    return texts.join(hits, "row", "left").select("doc_id", "t", "places", "items").mapInArrow(digest, SCHEMA)


def _index(benchmark: DataFrame, carried: int) -> tuple[DataFrame, Index | None]:
    """The benchmark's items (item, t), and their index if it may be carried."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), utf8().alias("t"))
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > min(carried, TRIED):
        return items, None
    index = Index([(r["item"], bytes(r["t"])) for r in items.collect()])
    return items, index if index.size() <= carried else None


def _words(items: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = split(b.column(1).to_pylist(), TABLE)[0]
            rows = [(i, w) for i, w in zip(b.column(0).to_pylist(), own, strict=True) if w]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([w for _, w in rows], pa.list_(pa.binary()))], ["item", "words"])

    return items.mapInArrow(run, "item string, words array<binary>")


def contamination(docs: DataFrame, benchmark: DataFrame, carried: int = CARRIED) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated (two items or more) for each of docs (doc_id, text), against benchmark (item_id, text)."""
    ship(docs.sparkSession)
    items, index = _index(benchmark, carried)
    found = _carried(docs, index) if index else _hits_joined(docs, _words(items))
    return found.withColumn("contaminated", F.col("n_items") >= 2)


def clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, carried: int = CARRIED) -> DataFrame:
    """The rows of docs that hold windows of fewer than least_items items, with all their columns."""
    items, index = _index(benchmark, carried)
    if index is None:  # rows get numbers, by which those found go
        numbered, _ = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), utf8().alias("text"), F.monotonically_increasing_id().alias("doc_id")), "numbered")
        bad = _hits_joined(numbered, _words(items)).where(F.col("n_items") >= least_items).select("doc_id")
        return numbered.join(bad, "doc_id", "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def keep(texts: list[bytes]) -> np.ndarray:
        found = _found(shared.value, texts)[2]
        return np.array([len(found.get(i, ())) < least_items for i in range(len(texts))], bool)

    return filtered(docs, keep)
