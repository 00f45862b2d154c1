"""Query op5_quality: quality scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import quality


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
