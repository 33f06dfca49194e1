"""Readers for the driver tables and the article / cluster views derived from
them. Every derived column is a plain expression, and the same derivation is
given as SQL (``*_SQL``) for the DuckDB oracles.

documents -> articles: arrival = doc_id; url = https://<source>.example.com/a/<doc_id>;
title = first 60 chars; extracted_at = 2024-01-01 + doc_id minutes; feed = source;
quality_score = labels.quality (0 when missing); published_at = extracted_at minus
(doc_id % 13) hours, null when doc_id % 10 = 3 (so null ordering is exercised).
embeddings -> vector articles: arrival = vec_id; url = https://src<vec_id % 20>.example.com/v/<vec_id>;
extracted_at = 2024-01-01 + vec_id minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_hash

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

EPOCH_SQL = "TIMESTAMP '2024-01-01 00:00:00'"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def minutes_after_epoch(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MINUTE", c, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def articles(spark: SparkSession, sf_dir: str, with_quality: bool = True) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"),
                   F.col("doc_id").cast("string"))
    ext = minutes_after_epoch("doc_id")
    df = docs.select(
        F.col("doc_id"), F.col("doc_id").alias("arrival"), url.alias("url"),
        F.col("source").alias("feed_id"), F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"), F.length("text").cast("long").alias("content_length"),
        F.col("lang").alias("language"), ext.alias("extracted_at"),
        F.when(F.col("doc_id") % 10 == 3, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("HOUR", -(F.col("doc_id") % 13), ext)).alias("published_at"))
    df = df.withColumn("url_hash", url_hash("url"))
    if with_quality:
        lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
        df = (df.join(lab, "doc_id", "left")
                .withColumn("quality_score", F.coalesce(F.col("quality"), F.lit(0)).cast("double"))
                .drop("quality"))
    return df


ARTICLES_SQL = f"""
SELECT d.doc_id, d.doc_id AS arrival,
       'https://' || d.source || '.example.com/a/' || CAST(d.doc_id AS VARCHAR) AS url,
       d.source AS feed_id, substr(d.text, 1, 60) AS title, d.text AS content,
       CAST(length(d.text) AS BIGINT) AS content_length, d.lang AS language,
       {EPOCH_SQL} + d.doc_id * INTERVAL 1 MINUTE AS extracted_at,
       CASE WHEN d.doc_id % 10 = 3 THEN NULL
            ELSE {EPOCH_SQL} + d.doc_id * INTERVAL 1 MINUTE - (d.doc_id % 13) * INTERVAL 1 HOUR
       END AS published_at,
       sha256('https://' || d.source || '.example.com/a/' || CAST(d.doc_id AS VARCHAR)) AS url_hash,
       CAST(coalesce(l.quality, 0) AS DOUBLE) AS quality_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def vector_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    url = F.concat(F.lit("https://src"), (F.col("vec_id") % 20).cast("string"),
                   F.lit(".example.com/v/"), F.col("vec_id").cast("string"))
    return emb.select(
        "vec_id", F.col("vec_id").alias("arrival"), url.alias("url"),
        F.col("label"), F.col("embedding"),
        minutes_after_epoch("vec_id").alias("extracted_at")).withColumn(
        "url_hash", url_hash("url"))


VECTOR_ARTICLES_SQL = f"""
SELECT vec_id, vec_id AS arrival,
       'https://src' || CAST(vec_id % 20 AS VARCHAR) || '.example.com/v/' || CAST(vec_id AS VARCHAR) AS url,
       label, embedding, {EPOCH_SQL} + vec_id * INTERVAL 1 MINUTE AS extracted_at,
       sha256('https://src' || CAST(vec_id % 20 AS VARCHAR) || '.example.com/v/' || CAST(vec_id AS VARCHAR)) AS url_hash
FROM embeddings
"""
