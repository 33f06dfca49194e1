"""Reader for landed feed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files (one RSS document per file) as (path, xml)."""
    return (spark.read.option("wholetext", True).text(path)
                 .select(F.input_file_name().alias("snapshot_id"), F.col("value").alias("xml")))
