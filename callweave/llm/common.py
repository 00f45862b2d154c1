"""What the operators of this subpackage share: shipping code, scratch tables, text access.

Nothing here depends on the size of the data: every helper works per Arrow batch or through Spark tables. Steps over texts
and blobs that an operator runs itself have batches of TEXT_ROWS and BLOB_ROWS; what its user runs has the session's, which
Spark bounds by bytes (spark.sql.execution.arrow.maxBytesPerBatch). Scratch tables go as `operators.storage` says: with the scope that they are made in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.storage import conf, drop, scratch, ship

#: Rows of an Arrow batch of texts and of large blobs.
TEXT_ROWS, BLOB_ROWS = 256, 16
#: Writer options for rows of large blobs: pages and row groups are measured after each row.
BLOB_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def batched(spark: SparkSession, rows: int | None) -> AbstractContextManager[None]:
    """Arrow batches of so many rows for what runs in it, as a batch is held whole by JVM and worker; None: the session's."""
    return conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)) if rows else nullcontext()


def stored(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder, in Arrow batches of so many rows, and read it again: lineage ends there, a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with batched(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str = "text") -> Column:
    """A text column as its UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit(b""))


def unused(names: list[str], name: str) -> str:
    """A column's name that is none of names, whatever the case of letters."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def with_text(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with its texts as UTF-8 somewhere, and in which column: its own text, or one before the others if that is no string."""
    if isinstance(docs.schema["text"].dataType, StringType):
        return docs, docs.columns.index("text")
    return docs.select(utf8().alias(unused(docs.columns, "text as bytes")), *(F.col(f"`{c}`") for c in docs.columns)), 0


def texts_in(column: pa.Array) -> list[bytes]:
    """Texts as bytes without a copy of their column; null becomes empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def filtered(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, for which keep(texts as bytes) is true; whatever the columns' names."""
    ship(docs.sparkSession)
    rows, at = with_text(docs)
    more = len(rows.columns) - len(docs.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, at, 4 << 20):
            out = b.filter(pa.array(np.asarray(keep(texts_in(b.column(at))), bool)))
            yield pa.RecordBatch.from_arrays(out.columns[more:], out.schema.names[more:])

    return rows.mapInArrow(run, docs.schema)


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to about limit; a larger single row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def batches(it: Iterator[pa.RecordBatch], column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined and cut so that a binary column (by name or place) holds about limit bytes in each."""
    held: list[pa.RecordBatch] = []
    total = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in it:
        if not b.num_rows:
            continue
        c = b.column(column if isinstance(column, int) else b.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64)
        for lo, hi in slices(sizes, limit):
            n = int(sizes[lo:hi].sum())
            if held and total + n > limit:
                yield joined()
                held, total = [], 0
            held.append(b.slice(lo, hi - lo))
            total += n
    if held:
        yield joined()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash may be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each pair."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


__all__ = ["batched", "batches", "drop", "filtered", "mix", "ranges", "scratch", "ship", "slices", "stored", "table", "texts_in", "unused", "utf8", "with_text"]
