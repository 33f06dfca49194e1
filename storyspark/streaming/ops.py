"""Stream operators in their batch form (the same functions run inside
``foreachBatch`` or as streaming plans, see ``jobs``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import source_domain


def drop_repeated(df: DataFrame, key: str = "event_id", order: str = "ts") -> DataFrame:
    """I3 (batch twin): one row per key, the first delivery; deliveries of one
    time are ordered by a hash of the row, so the choice is always the same."""
    cols = df.columns
    first = F.struct(F.col(order), F.xxhash64(*cols))
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), first).alias("_r")).select("_r.*")


CORRUPT = "_corrupt"


def poison_split(df: DataFrame, payload_col: str, schema_ddl: str,
                 required: tuple = ("k",)) -> DataFrame:
    """I7 (batch twin): parse the JSON payload with a fixed schema; a row is
    ``valid`` when the payload is JSON of that schema (a field of another type
    is not) and the required fields are present. Invalid rows go to a second
    sink (filter on ``valid``), never retried."""
    parsed = F.from_json(F.col(payload_col), f"{schema_ddl}, {CORRUPT} STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    ok = F.col(payload_col).isNotNull() & F.col(f"parsed.{CORRUPT}").isNull()
    for f in required:
        ok = ok & F.col(f"parsed.{f}").isNotNull()
    return (df.withColumn("parsed", parsed).withColumn("valid", F.coalesce(ok, F.lit(False)))
              .withColumn("parsed", F.col("parsed").dropFields(CORRUPT)))


def first_deliveries(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Board events: an article counts once, for the cluster it came with first."""
    cols = events.columns
    return events.groupBy("article_id").agg(
        F.min_by(F.struct(*cols), F.struct(F.col(order), F.col("cluster_id"))).alias("_r")).select("_r.*")


def board_fold(events: DataFrame, newest: int = 300, order: str = "arrival") -> DataFrame:
    """I8 (batch twin): per cluster its articles (repeats of an article are
    ignored, whatever cluster they name), its sources by first arrival and the
    last update; the ``newest`` most recently updated."""
    e = first_deliveries(events, order).withColumn("domain", source_domain("url"))
    per = e.groupBy("cluster_id").agg(F.count("*").alias("articles"), F.max("extracted_at").alias("updated_at"))
    top = per.orderBy(F.desc("updated_at"), "cluster_id").limit(newest)
    seen = e.groupBy("cluster_id", "domain").agg(F.min(order).alias("first_at"))
    named = seen.join(top.select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("first_at", "domain"))).alias("s"))
    return top.join(named, "cluster_id", "left").select(
        "cluster_id", "articles", "updated_at", F.transform("s", lambda x: x["domain"]).alias("sources"))


def board_partials(deliveries: DataFrame, order: str = "arrival") -> DataFrame:
    """What the board needs of some first deliveries, per cluster and domain."""
    return deliveries.withColumn("domain", source_domain("url")).groupBy("cluster_id", "domain").agg(
        F.count("*").alias("articles"), F.min(order).alias("first_at"), F.max("extracted_at").alias("updated_at"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of one cluster and domain as one; merging again changes nothing."""
    return partials.groupBy("cluster_id", "domain").agg(
        F.sum("articles").alias("articles"), F.min("first_at").alias("first_at"), F.max("updated_at").alias("updated_at"))


def board_of(partials: DataFrame) -> DataFrame:
    """Merged partials -> a board row per cluster (its domains, so a list is bounded by them)."""
    return partials.groupBy("cluster_id").agg(
        F.sum("articles").alias("articles"), F.max("updated_at").alias("updated_at"),
        F.sort_array(F.collect_list(F.struct("first_at", "domain"))).alias("s")).select(
        "cluster_id", "articles", "updated_at", F.transform("s", lambda x: x["domain"]).alias("sources"))


def newest_clusters(board: DataFrame, newest: int) -> DataFrame:
    return board.orderBy(F.desc("updated_at"), "cluster_id").limit(newest)


def retain(df: DataFrame, ts_col: str = "ts", seconds: int = 7 * 24 * 3600) -> DataFrame:
    """Keep rows within ``seconds`` of the newest one, which the plan looks
    up itself (a one-row aggregate, broadcast)."""
    newest = df.agg(F.max(ts_col).alias("_newest"))
    return (df.join(F.broadcast(newest), F.col(ts_col) >= F.timestamp_add("SECOND", F.lit(-seconds), F.col("_newest")))
              .select(*df.columns))
