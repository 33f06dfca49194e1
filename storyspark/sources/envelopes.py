"""A3: the JSON event envelope codec with a typed payload per subject.

Envelope: {event_id, event_type, timestamp, payload, metadata{source_service,
retry_count, trace_id, version}}. The payload is a JSON object on the wire; it is
read as its JSON text and typed with ``from_json`` and the subject's schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("source_service", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ])),
])

# payload schemas of the subjects that are really published
PAYLOAD_SCHEMAS: dict[str, str] = {
    "feed.process.command": "feed_url STRING, feed_id STRING",
    "feed.items.new": "feed_id STRING, feed_url STRING, item_url STRING, item_guid STRING, "
                      "item_title STRING, item_published STRING",
    "extract.completed": "url STRING, url_hash STRING, feed_id STRING, title STRING, content STRING, "
                         "content_length INT, authors ARRAY<STRING>, published_at STRING, language STRING, "
                         "top_image_url STRING, quality_score DOUBLE, extraction_method STRING",
    "article.duplicate": "url STRING, url_hash STRING, duplicate_of STRING, stage STRING, "
                         "hamming_distance INT, similarity_score DOUBLE",
    "article.unique": "url STRING, url_hash STRING, feed_id STRING, title STRING, content STRING, "
                      "content_length INT, authors ARRAY<STRING>, published_at STRING, language STRING, "
                      "top_image_url STRING, quality_score DOUBLE, extraction_method STRING, "
                      "simhash STRING, embedding ARRAY<FLOAT>",
    "article.clustered": "cluster_id STRING, article_id STRING, title STRING, source_domain STRING, "
                         "version INT, is_new_cluster BOOLEAN, similarity_score DOUBLE",
}


def write_envelopes(df: DataFrame, event_type: Column, payload_json: Column, event_id: Column,
                    timestamp: Column, source_service: str = "storyspark", trace_id: Column | None = None) -> DataFrame:
    """Rows -> one JSON envelope string per row (``value``). ``payload_json``
    is the JSON text of an object (``to_json`` of a struct; null: an empty
    object) and is written as that object. ``trace_id`` defaults to a UUID made
    of the event id, so a retried task writes the same envelope."""
    digest = F.md5(F.concat(F.lit("trace:"), event_id.cast("string")))
    made = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.to_json(F.struct(
        event_id.cast("string").alias("event_id"), event_type.alias("event_type"),
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")))
    meta = F.to_json(F.struct(
        F.lit(source_service).alias("source_service"), F.lit(0).alias("retry_count"),
        (made if trace_id is None else trace_id.cast("string")).alias("trace_id"), F.lit(1).alias("version")))
    return df.select(F.concat(
        F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), F.coalesce(payload_json, F.lit("{}")),
        F.lit(',"metadata":'), meta, F.lit("}")).alias("value"))


def read_envelopes(df: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON strings -> envelope columns (bad JSON gives nulls; route it with
    ``streaming.ops.poison_split``)."""
    e = df.select(F.from_json(F.col(value_col), ENVELOPE_SCHEMA).alias("e"))
    return e.select("e.*")


def typed_payload(envelopes: DataFrame, event_type: str, schema_ddl: str | None = None) -> DataFrame:
    """Envelopes of one subject with the payload parsed by its schema."""
    ddl = schema_ddl or PAYLOAD_SCHEMAS[event_type]
    return (envelopes.where(F.col("event_type") == event_type)
                     .withColumn("data", F.from_json("payload", ddl)))
