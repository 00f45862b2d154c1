"""Best-fit packing of token sequences by exact-complement hashing.

`plan` works on the number of pieces of each length, not on pieces: at most `capacity` counts, whatever the input. Long
pieces are put together best fit, decreasing; each sequence so begun has a gap. The sums of one, two and three short
lengths are indexed by hash, and combinations that fill a gap exactly are used up, as often as the counts of their lengths
and of such gaps allow: singles, then pairs, then triples, those of the largest least length first, which spares the short
pieces. What is left then goes best fit, decreasing, into the gaps that are left. From which length on a piece is long
(SHORTS) and whether large or small gaps come first depends on the counts: all are tried, and the plan of fewest
sequences is taken, of equal ones that which fills most sequences by pairs and triples. The plan is a list of patterns
(lengths in a sequence) with repetitions. Each use takes up a length or a pattern, so there are a few times `capacity` of
them at most, which bounds what is sent to the executors.

Every piece has a rank among those of its length (its partition's count before it, plus those of earlier partitions), and
a slot of a pattern takes a run of ranks; so pieces find their places with no shuffle of their own.

`pack` cuts documents of more than capacity ids into pieces of capacity, the first of which may be shorter. Null texts
are empty: their document is the end id. Repeated rows and ids are documents of their own. A very long text is encoded whole
by one worker, and its pieces are rows. No rows give none.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, batches, ship, stored, utf8
from .tokens import END_ID, default_path, encoded, encoder

Pattern = tuple[int, ...]


#: Pieces of less than capacity over this are short.
SHORTS = (16, 8, 4, 2)


class _Sums:
    """The sums of one, two and three of some lengths, indexed by hash; combinations come with their largest least length first."""

    def __init__(self, lengths: np.ndarray):
        self._single = {int(n): [(int(n),)] for n in lengths}
        a, b = np.triu_indices(len(lengths))
        total = lengths[a] + lengths[b]
        order = np.lexsort((-lengths[a], total))
        total, small = total[order], lengths[a][order]
        first = np.flatnonzero(np.diff(total, prepend=-1))
        self._pair = {int(total[i]): own for i, own in zip(first, np.split(small, first[1:]), strict=False)}  # a sum's smaller parts, descending
        self._down = sorted(self._single, reverse=True)

    def of(self, size: int, total: int) -> Iterator[Pattern]:
        if size == 1:
            yield from self._single.get(total, ())
        elif size == 2:
            for least in self._pair.get(total, ()):
                yield int(total - least), int(least)
        else:
            for least in self._down:
                for pair in self.of(2, total - least) if 3 * least <= total else ():
                    if pair[1] < least:
                        break
                    yield *pair, least


class _Plan:
    """Sequences by their gaps: patterns and how often each is used."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.by_gap: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
        self.combined = 0  # sequences filled by a pair or a triple

    def best_fit(self, least: int) -> None:
        """Put in all pieces of least and more, the longest first, each into the smallest gap that it fits in."""
        open_ = np.zeros(self.capacity + 1, bool)
        open_[[g for g, x in self.by_gap.items() if x and g]] = True
        for length in range(self.capacity, least - 1, -1):
            while self.left[length]:
                fits = np.flatnonzero(open_[length:])
                if len(fits):
                    gap, each = length + int(fits[0]), 1
                    pattern, n = self.by_gap[gap].pop()
                    times = min(n, int(self.left[length]))
                    if times < n:
                        self.by_gap[gap].append((pattern, n - times))
                    open_[gap] = bool(self.by_gap[gap])
                else:
                    gap, pattern = self.capacity, ()
                    each = min(self.capacity // length, int(self.left[length]))
                    times = int(self.left[length]) // each
                self.left[length] -= times * each
                gap -= each * length
                self.by_gap[gap].append((pattern + (length,) * each, times))
                open_[gap] = gap > 0

    def fill(self, large_first: bool) -> None:
        """Fill gaps exactly with combinations of what is left."""
        sums = _Sums(np.flatnonzero(self.left))
        for size in (1, 2, 3):
            for gap in sorted((g for g, x in self.by_gap.items() if x and g), reverse=large_first):
                for combination in sums.of(size, gap):
                    parts = Counter(combination)
                    while self.by_gap[gap] and (most := min(int(self.left[x]) // n for x, n in parts.items())):
                        pattern, n = self.by_gap[gap].pop()
                        times = min(n, most)
                        if times < n:
                            self.by_gap[gap].append((pattern, n - times))
                        for x, k in parts.items():
                            self.left[x] -= k * times
                        self.by_gap[0].append((pattern + combination, times))
                        self.combined += times * (size > 1)
                    if not self.by_gap[gap]:
                        break

    def patterns(self) -> list[tuple[Pattern, int]]:
        return [x for group in self.by_gap.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; every piece is in one of them."""
    best: tuple[tuple[int, int], _Plan] | None = None
    for part in SHORTS:
        for large_first in (True, False):
            own = _Plan(counts, capacity)
            own.best_fit(max(1, capacity // part))
            own.fill(large_first)
            own.best_fit(1)
            rank = sum(n for _, n in own.patterns()), -own.combined
            if best is None or rank < best[0]:
                best = rank, own
    return best[1].patterns()


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of its pieces, with the run's first sequence and its offset in them."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and rank (earlier pieces of its length in its partition), with ids if asked for."""
    ship(docs.sparkSession)
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * ids
    names = [c.split()[0] for c in columns.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for b in batches(it, "t", 4 << 20):
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), encoded(b.column(1).to_pylist(), enc, end_id), strict=True):
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    to = at + capacity if k else first
                    own = data[4 * at : 4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(own), part, seen[to - at], own)[: len(names)])
                    seen[to - at] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, columns)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for: one row for each piece of docs (doc_id, text)."""
    cut, _ = stored(pieces(docs, capacity, tokenizer or default_path(), end_id, ids), "pieces", TEXT_ROWS)
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    at = places(plan({r["length"]: r["n"] for r in total}, capacity))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros((2, b.num_rows), np.int64)
            order = np.argsort(length, kind="stable")
            first = np.flatnonzero(np.diff(length[order], prepend=-1))
            for rows in np.split(order, first[1:]) if len(order) else []:
                begin, seq, off = at[int(length[rows[0]])]
                i = np.searchsorted(begin, rank[rows], side="right") - 1
                sequence[rows] = seq[i] + rank[rows] - begin[i]
                offset[rows] = off[i]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    ranked = cut.join(base, ["part", "length"]).select(*kept, (F.col("rank") + F.col("base")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
