"""A4 / A5 on a stored target: row-level upserts that rewrite only what they touch.

The target is a directory of parquet files partitioned by key bucket. A batch reads and
rewrites the buckets its keys fall into (dynamic partition overwrite: the new files of a
bucket take the place of the old ones when the job commits); the files of all other
buckets stay as they are. The version guard makes a repeated batch change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .store import upsert_versioned

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def create_target(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Lay out ``rows`` (one per key) under ``path``. The number of buckets is stored with them."""
    spark = rows.sparkSession
    spark.createDataFrame([(key, buckets)], "key string, buckets int").write.mode("overwrite").parquet(f"{path}/layout")
    _write(rows.withColumn("bucket", _bucket(key, buckets)), path)


def _write(rows: DataFrame, path: str) -> None:
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(f"{path}/rows"))


def read_target(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def upsert_stored(spark: SparkSession, path: str, batch: DataFrame, version: str = "version", arrival="arrival",
                  keep_first: tuple = ("id", "created_at")) -> int:
    """Apply ``batch`` to the target by the rule of ``upsert_versioned``; the
    number of buckets rewritten. Rows without a key are dropped. The driver sees bucket numbers only."""
    layout = spark.read.parquet(f"{path}/layout").first()
    key, buckets = layout.key, layout.buckets
    arr = [arrival] if isinstance(arrival, str) else list(arrival)
    new = cut_lineage(batch.where(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets)))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if not touched:
        return 0
    # literals, so that the scan lists the touched directories only
    old = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert_versioned(old.select("*", *[F.lit(-1).alias(a) for a in arr if a not in old.columns]),
                              new.drop("bucket"), key, version, arr, keep_first)
    _write(merged.select(*old.columns).withColumn("bucket", _bucket(key, buckets)), path)
    return len(touched)
