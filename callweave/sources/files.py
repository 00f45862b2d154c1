"""JSON-lines sources and sinks: scans, split writing, resumable appends, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import GUARDED, MAIN, markdown


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """One row for each line of one or more files or folders; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))


def write_splits(records: DataFrame, path: str, column: str = "split") -> None:
    """A folder of JSON lines for each split, in place of what was there."""
    records.write.partitionBy(column).mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key is not yet under path, and tell how many there were; a second run appends none. The keys there are read once."""
    new = rows.join(spark.read.schema(f"{key} string").json(path), key, "left_anti") if exists(spark, path) else rows
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def write_pairs(pairs: DataFrame, path: str) -> dict[str, int]:
    """Preference pairs as JSON lines, in place of what was there; and how many there are of each type, the most first."""
    pairs.write.mode("overwrite").json(path)
    counts = pairs.sparkSession.read.schema("type string").json(path).groupBy("type").agg(F.count("*").alias("n"))
    return {r["type"]: r["n"] for r in counts.orderBy(F.desc("n"), "type").collect()}  # a row for each type


def done(spark: SparkSession, path: str, n: int, source: str | None = None) -> bool:
    """Whether a file or folder of lines has n of them and is newer than its source, if one is named."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def changed(name: str) -> int:
        p = fs_path(name)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
        last = 0
        while files.hasNext():
            last = max(last, files.next().getModificationTime())
        return last

    return exists(spark, path) and spark.read.text(path).count() == n and (source is None or changed(path) > changed(source))


def head(rows: DataFrame, seq: Column, n: int) -> DataFrame:
    """The first n rows in the order of seq."""
    return rows.orderBy(seq).limit(n)


def report_json(results: Sequence[dict]) -> str:
    """The report by "system/dataset", raw and guarded."""
    out: dict[str, dict] = {}
    for r in results:
        out.setdefault(f"{r['system']}/{r['dataset']}", {})[r["variant"]] = {k: v for k, v in r.items() if k not in ("system", "dataset", "variant")}
    return json.dumps(out, ensure_ascii=False, indent=1)


def report_markdown(results: Sequence[dict], notes: Sequence[tuple[str, int]] = ()) -> str:
    """Tables of raw and guarded results, and the most frequent notes."""
    text = "# Evaluation\n\n## Model alone\n\n" + markdown([r for r in results if r["variant"] == "raw"], MAIN)
    text += "\n## Model with guard\n\n" + markdown([r for r in results if r["variant"] == "guarded"], GUARDED)
    return text + ("\nNotes: " + ", ".join(f"{n} ({c})" for n, c in notes) + "\n" if notes else "")
