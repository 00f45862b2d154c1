"""Query op2_packing: all documents packed into sequences of at most 1024 ids."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=1024)
