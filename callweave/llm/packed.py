"""Asking for corpus-wide facts about very many hashes, packed.

A row for each n-gram of a corpus costs more than the n-grams themselves. Here documents are stored once as slices of some
megabytes; a slice asks each hash partition one question, a row with the sorted distinct hashes that fall into it; a
partition answers each of its slices with a row; and a slice joins its answers. So any hash, however hot, is one entry of
a slice at most, and a hash partition holds about PARTITION entries of all slices: there are as many partitions as that
takes. Rows are slices times partitions while a slice has entries for all of them, and as many as entries beyond.

Slices are stored as a table bucketed by slice id. A writing task numbers its slices so that they fall into a bucket of
its own; so no text is ever shuffled, and the joins with answers shuffle the answers alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import conf, on_release
from .common import BLOB_PAGES, TEXT_ROWS, batched, batches, drop, scratch, ship, utf8

#: Bytes of text in a slice; a longer document is a slice of its own.
SLICE = 2 << 20
#: Entries that a hash partition is meant to hold.
PARTITION = 2 << 20
MOST_BUCKETS = 1 << 16


def murmur3(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """The 32-bit hash by which Spark deals longs to buckets, as signed integers."""
    values = values.astype(np.uint64)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    h = np.full(len(values), seed, np.uint32)
    for half in (values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)):
        k = turn(half.astype(np.uint32) * c1, 15) * c2
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _numbers(part: int, buckets: int) -> Iterator[int]:
    """Slice ids of a task: its number in the upper bits, and all of them in one bucket."""
    step, at = max(1024, 4 * buckets), 0
    while True:
        ids = (np.int64(part) << np.int64(40)) + np.arange(at, at + step)
        yield from ids[murmur3(ids) % buckets == part % buckets].tolist()
        at += step


@dataclass
class Slices:
    """slice long, ids array<long>, lengths array<int>, texts binary (zstandard, joined), stored; and the bytes of text in all."""

    frame: DataFrame
    name: str
    path: str
    text_bytes: int
    buckets: int

    def partitions(self, entry_bytes: int = 6) -> int:
        """Hash partitions, a power of two, for one entry each entry_bytes of text."""
        return 1 << max(8, (self.text_bytes // entry_bytes // PARTITION).bit_length())

    def drop(self) -> None:
        spark = self.frame.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(spark, self.path)


def sliced(docs: DataFrame, size: int = SLICE) -> Slices:
    """Store docs (doc_id, text) as slices; in a slice documents ascend by id, nulls first."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"))
    buckets = max(1, min(MOST_BUCKETS, rows._jdf.rdd().getNumPartitions()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(TaskContext.get().partitionId(), buckets)
        held: list[pa.RecordBatch] = []
        total = 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.sort_by([("doc_id", "ascending")]) if not t["doc_id"].null_count else t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
            texts = t["t"].to_pylist()
            values = [next(numbers), t["doc_id"].to_pylist(), list(map(len, texts)), zstandard.compress(b"".join(texts), 1), total]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["slice", "ids", "lengths", "texts", "bytes"])

        for b in batches(it, "t", size):
            n = int(pc.sum(pc.binary_length(b.column(1))).as_py() or 0)
            if held and total + n > size:
                yield row()
                held, total = [], 0
            held.append(b)
            total += n
        if held:
            yield row()

    name, path = f"slices_{uuid.uuid4().hex}", scratch(spark, "slices")
    writer = rows.mapInArrow(run, "slice long, ids array<long>, lengths array<int>, texts binary, bytes long").write.format("parquet")
    # a task writes one bucket: no sort of blobs; and pages end by their size, not after a hundred blobs
    with conf(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"), batched(spark, TEXT_ROWS):
        writer.options(**BLOB_PAGES).option("compression", "none").option("path", path).bucketBy(buckets, "slice").saveAsTable(name)
    frame = spark.table(name)
    total = frame.agg(F.sum("bytes")).first()[0] or 0
    own = Slices(frame.drop("bytes"), name, path, int(total), buckets)
    on_release(own.drop)
    return own


def texts_of(row: pa.RecordBatch) -> list[bytes]:
    """The texts of a slice's row."""
    data = zstandard.decompress(row.column(row.schema.get_field_index("texts"))[0].as_py())
    ends = np.cumsum(row.column(row.schema.get_field_index("lengths"))[0].as_py(), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def ids_of(row: pa.RecordBatch) -> pa.Array:
    """The doc_ids of a slice's row."""
    return row.column(row.schema.get_field_index("ids")).flatten()


def asked(slices: DataFrame, ask: Callable[[pa.RecordBatch], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """slice, part, question: ask(a batch of one slice's row) gives (hash partition, question)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                got = list(ask(row))
                if got:
                    parts, payloads = zip(*got, strict=True)
                    number = row.column(0)[0].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(got), pa.int64()), pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], ["slice", "part", "question"])

    return slices.mapInArrow(run, "slice long, part int, question binary")


def answered(slices: Slices, questions: DataFrame, answer: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """slice, answers (array of part, answer): answer(part, its slices, their questions) gives (slice, answer)."""

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
        part, numbers, payloads = None, [], []
        for b in it:
            for p, number, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if numbers:
                        yield part, numbers, payloads
                    part, numbers, payloads = p, [], []
                numbers.append(number)
                payloads.append(payload)
        if numbers:
            yield part, numbers, payloads

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers, payloads in groups(it):
            got = list(answer(part, numbers, payloads))
            for lo in range(0, len(got), 1000):
                some = got[lo : lo + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array([a for _, a in some], pa.binary())], ["slice", "part", "answer"])

    out = questions.select("part", "slice", "question").repartition("part").sortWithinPartitions("part").mapInArrow(run, "slice long, part int, answer binary")
    # as many partitions as the slices' buckets: their join then moves no slice
    return out.repartition(slices.buckets, "slice").groupBy("slice").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))


def joined(slices: DataFrame, answers: DataFrame) -> DataFrame:
    """The slices with answers, null for a slice that has none."""
    return slices.join(answers.hint("shuffle_hash"), "slice", "left")


def stripped(keys: np.ndarray) -> bytes:
    """Hashes of one of 256 partitions or more, without the first byte, which the partition tells."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unstripped(data: bytes, size: int) -> np.ndarray:
    """The stripped hashes at the beginning of data, with 0 for the byte."""
    out = np.zeros((size, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8, 7 * size).reshape(-1, 7)
    return out.view("<u8").ravel()


def cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Of sorted 64-bit hashes: (hash partition, from, to), by their upper bits; partitions without any are left out."""
    if len(keys):
        part = keys >> np.uint64(64 - (parts.bit_length() - 1))
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        yield from zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)


__all__ = ["Slices", "answered", "asked", "cut", "ids_of", "joined", "murmur3", "sliced", "stripped", "texts_of", "unstripped"]
