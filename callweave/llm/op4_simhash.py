"""Query op4_simhash: classes of near copies among all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import near_duplicates


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)
