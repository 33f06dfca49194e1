"""RSS snapshots as Spark builds them from article rows: the input of the feed
queries (a fixture of the registered queries, not part of the feed reader)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def xml_escape(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, "&", "&amp;")
    c = F.regexp_replace(c, "<", "&lt;")
    return F.regexp_replace(c, ">", "&gt;")


def rss_snapshots(documents: DataFrame, window: int = 25, step: int | None = None) -> DataFrame:
    """One RSS 2.0 document per (feed, poll): poll k of a feed lists its
    articles with doc_id in [k*step, k*step + window), in doc_id order. With
    step < window consecutive polls overlap, so items recur across polls."""
    step = step or window
    k_hi = F.floor(F.col("doc_id") / step)
    k_lo = F.greatest(F.floor((F.col("doc_id") - window) / step) + 1, F.lit(0))
    d = documents.select(
        F.col("source").alias("feed_id"),
        F.explode(F.sequence(k_lo.cast("long"), k_hi.cast("long"))).alias("snapshot_id"),
        "doc_id", "text")
    d = d.select(
        "feed_id", "snapshot_id", "doc_id",
        F.concat(F.lit("<item><title>"), xml_escape(F.substring("text", 1, 60)), F.lit("</title><link>https://"),
                 F.col("feed_id"), F.lit(".example.com/a/"), F.col("doc_id").cast("string"),
                 F.lit("</link><guid>"), F.col("feed_id"), F.lit("-"), F.col("doc_id").cast("string"),
                 F.lit("</guid><pubDate>"),
                 F.date_format(F.timestamp_add("MINUTE", F.col("doc_id"),
                                               F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")),
                               "EEE, dd MMM yyyy HH:mm:ss"),
                 F.lit(" +0000</pubDate></item>")).alias("item"))
    snaps = d.groupBy("feed_id", "snapshot_id").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "item"))).alias("_items"))
    return snaps.select("feed_id", "snapshot_id", F.concat(
        F.lit('<rss version="2.0"><channel><title>'), F.col("feed_id"), F.lit("</title>"),
        F.array_join(F.transform("_items", lambda e: e["item"]), ""),
        F.lit("</channel></rss>")).alias("xml"))
