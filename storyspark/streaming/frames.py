"""Clustered events to the small public client frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import source_domain


def client_frame_fields(clustered: DataFrame) -> DataFrame:
    """The five public fields; version, embedding and score never leave."""
    return clustered.select(F.col("cluster_id").cast("string").alias("cluster_id"),
                            F.col("id").cast("string").alias("article_id"), "title",
                            source_domain("url").alias("source_domain"), "is_new_cluster")


def client_frames(clustered: DataFrame) -> DataFrame:
    """One JSON frame per event: {"type": "article.clustered", "data": {...}}."""
    f = client_frame_fields(clustered)
    return f.select(F.to_json(F.struct(F.lit("article.clustered").alias("type"),
                                       F.struct(*f.columns).alias("data"))).alias("frame"))
