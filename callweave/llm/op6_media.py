"""Query op6_media: all documents stored as JPEG images in a table, read back, with digests and thumbnail hashes."""

from pyspark.sql import DataFrame, SparkSession

from .common import TEXT_ROWS, stored, table
from .media import features, stored_media


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, _ = stored(stored_media(table(spark, sf_dir, "documents")), "media", TEXT_ROWS)
    return features(media)
