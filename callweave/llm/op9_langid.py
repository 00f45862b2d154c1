"""Query op9_langid: languages of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .langid import identified


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
