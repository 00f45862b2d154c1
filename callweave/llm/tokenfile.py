"""Token ids in ascending doc_id order as wavelet-matrix shards, and their reading.

`write` deals the documents to ranges of doc_id, encodes each range in order and stores shards of whole documents with
about SHARD ids each: one row for a shard, its matrix and its documents' ids and lengths. `read` gives the documents back
from the shards; `tokens_at`, `counts` and `occurrences` answer from the shards' matrices without decoding them. A document
longer than SHARD ids is a shard of its own, and a very long text is encoded whole by one worker. Null texts are empty
documents, of the end id alone. Null ids come first. Rows with equal ids, null ones too, are in the order of the input, and
may be dealt to more than one range. No rows give no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOB_PAGES, TEXT_ROWS, batched, batches, ship, utf8
from .tokens import END_ID, default_path, encoder
from .wavelet import WaveletMatrix

SHARD = 1 << 16
SCHEMA = "part int, shard int, inner long, n_docs long, n_tokens long, doc_ids binary, null_ids int, lengths binary, matrix binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard: int = SHARD) -> None:
    """Store the ids of docs (doc_id, text) under path."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = max(enc.vocabulary - 1, end_id, 1).bit_length()
        part, number, inner = TaskContext.get().partitionId(), 0, 0  # inner: ids of this partition's earlier shards
        held: list[np.ndarray] = []  # runs of ids of whole documents
        lengths: list[np.ndarray] = []
        ids: list[int | None] = []

        def row() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            m = WaveletMatrix.build(np.concatenate(held), bits)
            known = np.array([i or 0 for i in ids], "<i8")
            values = [part, number, inner, len(ids), m.n, known.tobytes(), ids.count(None), n.astype("<i8").tobytes(), m.to_bytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        total = 0
        for b in batches(it, "t", 4 << 20):
            doc_ids = b.column(0).to_pylist()
            own, ends = enc.encode(b.column(1).to_pylist())
            own = np.insert(own, ends, end_id)  # after each document
            ends = ends + np.arange(1, len(ends) + 1)
            sizes = np.diff(ends, prepend=0)
            at = 0
            while at < len(sizes):
                room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard - total, side="right"))
                to = max(room, at + (not held))  # a document longer than a shard is a shard
                if to > at:
                    held.append(own[ends[at] - sizes[at] : ends[to - 1]])
                    lengths.append(sizes[at:to])
                    ids += doc_ids[at:to]
                    total += int(sizes[at:to].sum())
                if to < len(sizes):
                    yield row()
                    number, inner, total = number + 1, inner + total, 0
                    held, lengths, ids = [], [], []
                at = to
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"), F.monotonically_increasing_id().alias("place"))
    shards = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "t").mapInArrow(run, SCHEMA)
    with batched(docs.sparkSession, TEXT_ROWS):
        shards.write.options(**BLOB_PAGES).option("compression", "snappy").parquet(path)


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The shards under path, and how many ids are before each of their parts."""
    ship(spark)
    shards = spark.read.schema(SCHEMA).parquet(path)
    # partitions are doc_id ranges in order; the driver gets one number for each, some thousands at most
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([0] + [r["n"] for r in parts]).tolist()
    return shards, {r["part"]: b for r, b in zip(parts, ends, strict=False)}


def _asked(spark: SparkSession, path: str, answer: Callable[[WaveletMatrix, int], tuple[np.ndarray, np.ndarray]], names: tuple[str, str]) -> DataFrame:
    """Two columns of numbers that answer(matrix, ids before it) gives for each shard."""
    shards, bases = _shards(spark, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, inner, matrix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, n = answer(WaveletMatrix.from_bytes(matrix), bases[part] + inner)
                for lo in range(0, len(a), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 10_000], pa.int64()), pa.array(n[lo : lo + 10_000], pa.int64())], list(names))

    return shards.select("part", "inner", "matrix").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """position, id: the ids at some positions in all ids under path; positions that there are not give no row."""
    known = np.unique(np.array(positions, np.int64))

    def answer(m: WaveletMatrix, start: int) -> tuple[np.ndarray, np.ndarray]:
        own = known[np.searchsorted(known, start) : np.searchsorted(known, start + m.n)]
        return own, np.array([m.access(int(p) - start) for p in own], np.int64)

    return _asked(spark, path, answer, ("position", "id"))


def counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id, n: how often each of some ids occurs under path."""
    wanted = np.unique(np.array(ids, np.int64))
    own = _asked(spark, path, lambda m, start: (wanted, np.array([m.count(int(i)) for i in wanted], np.int64)), ("id", "n"))
    return own.groupBy("id").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id, position: all positions of some ids in all ids under path."""
    wanted = sorted(set(ids))

    def answer(m: WaveletMatrix, start: int) -> tuple[np.ndarray, np.ndarray]:
        found = [m.positions(i) for i in wanted]
        return np.repeat(np.array(wanted, np.int64), [len(x) for x in found]), start + np.concatenate([np.zeros(0, np.int64), *found])

    return _asked(spark, path, answer, ("id", "position"))


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids (unsigned 32-bit little-endian) of each document under path."""
    shards, bases = _shards(spark, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, inner, doc_ids, nulls, lengths, matrix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start = bases[part] + inner
                data = WaveletMatrix.from_bytes(matrix).decode().astype("<u4").tobytes()
                n = np.frombuffer(lengths, "<i8")
                at = np.concatenate(([0], np.cumsum(n)))
                known = np.frombuffer(doc_ids, "<i8")
                for lo in range(0, len(n), 2000):
                    hi = min(lo + 2000, len(n))
                    own = [data[4 * x : 4 * y] for x, y in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist(), strict=True)]
                    crc = np.fromiter(map(zlib.crc32, own), np.int64, hi - lo)
                    columns = [pa.array(known[lo:hi], mask=np.arange(lo, hi) < nulls), pa.array(start + at[lo:hi]), pa.array(n[lo:hi]), pa.array(crc)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    rows = shards.select("part", "inner", "doc_ids", "null_ids", "lengths", "matrix")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
