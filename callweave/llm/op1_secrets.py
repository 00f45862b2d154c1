"""Query op1_secrets: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secretscan import scanned


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("secrets", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return scanned(table(spark, sf_dir, "documents")).select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"))
