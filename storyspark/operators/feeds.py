"""Feed upkeep: item lists from feed snapshots (A1, E1, H3, Q17), the poll
log fold (D12, D13, H18) and the feed table derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import backoff_seconds
from ..functions.urls import item_key
from .asof import asof_latest

MAX_ITEMS_PER_FEED = 20
MAX_BACKOFF_SECONDS = 86_400
ERROR_STATUS_AT = 5

def _item(*fields: T.StructField) -> T.ArrayType:
    return T.ArrayType(T.StructType(list(fields)))


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


_RSS_ITEM = _item(_text("title"), _text("link"), _text("guid"), _text("pubDate"), _text("date"))
_LINK = _item(_text("_href"), _text("_rel"))
#: RSS 2.0 keeps its items in the channel, RDF (RSS 1.0) beside it, Atom has entries
FEED_SCHEMA = T.StructType([
    T.StructField("channel", T.StructType([_text("title"), T.StructField("item", _RSS_ITEM)])),
    T.StructField("item", _RSS_ITEM), _text("title"),
    T.StructField("entry", _item(_text("title"), T.StructField("link", _LINK), _text("id"), _text("published"), _text("updated"))),
])


def _parsed(snapshots: DataFrame, xml_col: str) -> DataFrame:
    return snapshots.withColumn("_doc", F.from_xml(F.col(xml_col), FEED_SCHEMA, {"ignoreNamespace": "true"}))


def feed_items(snapshots: DataFrame, xml_col: str = "xml", max_items: int = MAX_ITEMS_PER_FEED,
               keep_cols: tuple = ("feed_id", "snapshot_id")) -> DataFrame:
    """A1 + E1: one row per item of an RSS, RDF or Atom feed (title, link,
    guid, published), the first ``max_items`` per snapshot in document order; the
    cap comes before any de-duplication (Q17). Adds ``item_key`` (H3) and
    ``pos``. A feed that does not parse gives no item here and a row in
    :func:`feed_problems`."""
    keep = [c for c in keep_cols if c in snapshots.columns]
    # RFC 822 dates lose the weekday name (not a parse field in Spark)
    mail = lambda c: F.try_to_timestamp(F.regexp_replace(c, r"^\s*[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = lambda c: F.try_to_timestamp(c)
    rss = lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["guid"].alias("guid"),
                             F.coalesce(mail(i["pubDate"]), iso(i["date"])).alias("published"))
    main = lambda e: F.coalesce(
        F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"],
        F.get(e["link"], F.lit(0))["_href"])
    atom = lambda e: F.struct(e["title"].alias("title"), main(e).alias("link"), e["id"].alias("guid"),
                              iso(F.coalesce(e["published"], e["updated"])).alias("published"))
    items = F.coalesce(F.transform("_doc.channel.item", rss), F.transform("_doc.item", rss), F.transform("_doc.entry", atom))
    flat = _parsed(snapshots, xml_col).select(*keep, F.posexplode(items).alias("pos", "it")).where(F.col("pos") < max_items)
    return flat.select(*keep, "pos", "it.*").withColumn("item_key", item_key("guid", "link"))


def feed_problems(snapshots: DataFrame, xml_col: str = "xml",
                  keep_cols: tuple = ("feed_id", "snapshot_id")) -> DataFrame:
    """Snapshots that are no feed: missing, not well-formed, or without any
    known part, with the reason."""
    keep = [c for c in keep_cols if c in snapshots.columns]
    doc = _parsed(snapshots, xml_col)
    known = F.coalesce(F.col("_doc.channel").isNotNull() | F.col("_doc.item").isNotNull()
                       | F.col("_doc.entry").isNotNull() | F.col("_doc.title").isNotNull(), F.lit(False))
    return doc.where(~known).select(*keep, F.when(F.coalesce(F.trim(xml_col), F.lit("")) == "", "empty")
                                    .otherwise("not a feed").alias("reason"))


def new_items(items: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Items worth emitting: a key, a link, not seen before; within the
    snapshot stream only the first occurrence of a key (by snapshot, pos)."""
    ok = items.where(F.col("item_key").isNotNull() & F.col("link").isNotNull()
                     & (F.trim("link") != ""))
    if seen is not None:
        ok = ok.join(seen.select("item_key"), "item_key", "left_anti")
    first = ok.groupBy("item_key").agg(F.min(F.struct("snapshot_id", "pos")).alias("_f"))
    return ok.join(first, "item_key").where(
        F.struct("snapshot_id", "pos") == F.col("_f")).drop("_f")


def poll_log(events: DataFrame) -> DataFrame:
    """Events as a poll log: user_id = feed, 'error' = failed poll, others a
    success adding one article; value = latency ms. The validators of a success
    and the message of a failure stand for the HTTP answer: every third success
    (by id) has no validators."""
    failed = F.col("event_type") == "error"
    answered = ~failed & (F.col("event_id") % 3 != 0)
    return events.select(
        F.col("user_id").alias("feed_id"), F.col("event_id"), F.col("ts"), failed.alias("failed"),
        F.when(failed, 0).otherwise(1).alias("delta"), F.col("value").alias("latency_ms"),
        F.when(answered, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("etag"),
        F.when(answered, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("last_modified"),
        F.when(failed, F.concat(F.lit("poll "), F.col("event_id").cast("string"), F.lit(" failed"))).alias("error"))


def feed_state(log: DataFrame, poll_interval: int = 600,
               error_at: int = ERROR_STATUS_AT) -> DataFrame:
    """D12 + D13: fold a poll log (in ts, event_id order) into feed state.

    success: last_polled_at = ts, next_poll_at = ts + interval, article_count
    += delta, error_count = 0, etag and last_modified as answered (null
    overwrites), last_error = null. failure: error_count + 1, last_error, and
    next_poll_at = ts + min(interval * 2^errors, 86400), status 'error' once
    errors reach 5. Both set updated_at. Status is never reset by a success.
    Log columns etag, last_modified and error are optional. Aggregates and one
    as-of lookup only (no per-feed window), so a feed holding most of the log
    stays spread."""
    lg = log.withColumn("_o", F.unix_micros(F.col("ts").cast("timestamp")))
    for c in ("etag", "last_modified", "error"):
        if c not in log.columns:
            lg = lg.withColumn(c, F.lit(None).cast("string"))
    order, ok = F.struct("_o", "event_id"), ~F.col("failed")
    per = lg.groupBy("feed_id").agg(
        F.max(F.when(ok, order)).alias("_last_ok"),
        F.max(F.when(ok, F.struct("_o", "event_id", "ts", "etag", "last_modified"))).alias("_ok"),
        F.sum("delta").cast("long").alias("article_count"),
        F.max(F.struct("_o", "event_id", "ts", "failed", "error")).alias("_last"),
        F.min("ts").alias("created_at"))
    fails = lg.where("failed").select("feed_id", "_o", "event_id")
    oks = lg.where(~F.col("failed")).select("feed_id", "_o", "event_id")
    runs = asof_latest(fails, oks, ["feed_id"], "_o", [], out="_prev_ok",
                       bucket_size=86_400 * 1_000_000, tie="event_id")
    run_len = runs.groupBy("feed_id", F.col("_prev_ok").alias("_run")).agg(F.count("*").alias("_n"))
    worst = run_len.groupBy("feed_id").agg(F.max("_n").alias("max_run"))
    trailing = (fails.join(per.select("feed_id", "_last_ok"), "feed_id")
                     .where(F.col("_last_ok").isNull() | (order > F.col("_last_ok")))
                     .groupBy("feed_id").agg(F.count("*").alias("error_count")))
    st = (per.join(trailing, "feed_id", "left").join(worst, "feed_id", "left")
             .withColumn("error_count", F.coalesce("error_count", F.lit(0)).cast("int"))
             .withColumn("poll_interval", F.lit(poll_interval))
             .withColumn("status", F.when(F.coalesce("max_run", F.lit(0)) >= error_at,
                                          F.lit("error")).otherwise(F.lit("active")))
             .withColumn("next_poll_at", F.when(
                 F.col("_last.failed"),
                 F.timestamp_add("SECOND", backoff_seconds(F.col("poll_interval"), F.col("error_count")),
                                 F.col("_last.ts")))
                 .otherwise(F.timestamp_add("SECOND", F.col("poll_interval"), F.col("_last.ts")))))
    return st.select("feed_id", "status", "error_count", "article_count", F.col("_ok.ts").alias("last_polled_at"),
                     "next_poll_at", "poll_interval", "created_at", F.col("_ok.etag").alias("etag"),
                     F.col("_ok.last_modified").alias("last_modified"), F.col("_last.error").alias("last_error"),
                     F.col("_last.ts").alias("updated_at"))


def feeds_table(events: DataFrame, poll_interval: int = 600) -> DataFrame:
    """Feed rows derived from the poll log (id, url, name and the state)."""
    st = feed_state(poll_log(events), poll_interval)
    return st.select(
        F.col("feed_id").cast("string").alias("id"),
        F.concat(F.lit("https://feed"), F.col("feed_id").cast("string"),
                 F.lit(".example.com/rss")).alias("url"),
        F.concat(F.lit("Feed "), F.col("feed_id").cast("string")).alias("name"),
        "status", "error_count", "article_count", "last_polled_at", "next_poll_at",
        "poll_interval", "created_at")
