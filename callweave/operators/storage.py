"""Tables that cut lineage, in the folder that all executors share; and this package on the executors.

Scratch tables live as long as results may read them. `with scope(spark):` ends them: what was stored in it goes when it
is left, so results are to be used or written inside. Without one they go with `release`.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_OWN: dict[str, str] = {}
#: What undoes the scratch made so far; a list for each open scope, the first for what was made outside of any.
_MADE: list[list[Callable[[], None]]] = [[]]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers import it wherever they run."""
    sc = spark.sparkContext
    mark = f"{PACKAGE.name}_{sc.applicationId}.zip".replace("-", "_")
    if _OWN.get("shipped") == mark:
        return
    at = os.path.join(tempfile.mkdtemp(), mark)
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(at)
    _OWN["shipped"] = mark


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; an own one where that is unset, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='tables_')}")
    return base.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def on_release(undo: Callable[[], None]) -> None:
    """Have something undone at the end of the scope."""
    _MADE[-1].append(undo)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    on_release(lambda: drop(spark, path))
    return path


def release() -> None:
    """Undo what the innermost scope made."""
    while _MADE[-1]:
        _MADE[-1].pop()()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made in it go at its end."""
    _MADE.append([])
    try:
        yield
    finally:
        release()
        _MADE.pop()


@contextmanager
def conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs in it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
