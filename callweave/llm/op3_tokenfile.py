"""Query op3_tokenfile: all documents written as wavelet-matrix shards and read back."""

from pyspark.sql import DataFrame, SparkSession

from .common import scratch, table
from .tokenfile import read, write


def op3_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, ids=False)
