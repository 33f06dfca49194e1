"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import min_content_ok, unicode_trim
from ..functions.vectors import valid_vector


def min_content(df: DataFrame, text_col: str = "content", min_chars: int = 50) -> DataFrame:
    """B1: drop rows whose trimmed text is missing or shorter than
    ``min_chars``; the kept text is the trimmed text."""
    t = df.withColumn(text_col, unicode_trim(text_col))
    t = t.withColumn("content_length", F.length(text_col).cast("long"))
    return t.where(F.col(text_col).isNotNull() & (F.col("content_length") >= min_chars))


def article_rules(dim: int | None = None) -> dict[str, Column]:
    """Field rules of the stored article (ranges, lengths, domains)."""
    rules = {
        "title_len": F.length("title") >= 1,
        "content_len": F.length("content") >= 1,
        "language_len": F.length("language").between(2, 10),
        "quality_range": F.col("quality_score").between(0.0, 1.0),
        "content_length_nonneg": F.col("content_length") >= 0,
        "url_hash_len": F.length("url_hash") == 64,
    }
    if dim is not None:
        rules["embedding_dim"] = F.col("embedding").isNull() | (F.size("embedding") == dim)
    return rules


def split_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """B2: adds ``valid`` and ``reasons`` (names of failed rules, in rule
    order; null or false counts as failed). Filter both ways for the valid
    and the quarantine set."""
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.withColumn("reasons", failed).withColumn("valid", F.size("reasons") == 0)


def valid_vectors(df: DataFrame, vec_col: str = "embedding", dim: int = 384) -> DataFrame:
    """Adds ``valid_vector``: exactly ``dim`` values, not all zero."""
    return df.withColumn("valid_vector", valid_vector(vec_col, dim))


def due_feeds(feeds: DataFrame, now, limit: int = 50) -> DataFrame:
    """Active feeds with next_poll_at <= now, most overdue first (id
    breaks ties so the cut is deterministic). TakeOrdered: no full sort."""
    return (feeds.where((F.col("status") == "active") & (F.col("next_poll_at") <= F.lit(now)))
                 .orderBy(F.col("next_poll_at").asc(), F.col("id").asc()).limit(limit))


def active_clusters(clusters: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Active clusters, most recent activity first, paged."""
    return (clusters.where(F.col("status") == "active")
                    .orderBy(F.desc("last_activity"), F.asc("id")).offset(offset).limit(limit))


PUBLIC_ARTICLE_COLS = ["id", "url", "title", "content", "authors", "language",
                       "top_image_url", "cluster_id", "quality_score", "published_at",
                       "extracted_at", "feed_id", "content_length"]
PUBLIC_CLUSTER_COLS = ["id", "label", "article_count", "last_activity", "top_sources",
                       "status", "created_at"]


def public_view(df: DataFrame, kind: str = "article") -> DataFrame:
    """Only public fields (no version, embedding, simhash, centroid,
    decay); the projection reaches the scan."""
    cols = PUBLIC_ARTICLE_COLS if kind == "article" else PUBLIC_CLUSTER_COLS
    return df.select(*[c for c in cols if c in df.columns])


def lookup(df: DataFrame, key_col: str, keys) -> DataFrame:
    """Point lookup (a value) or batch lookup (a DataFrame of keys, as a
    semi-join)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(key_col)).distinct(),
                       key_col, "left_semi")
    if isinstance(keys, (list, tuple, set)):
        return df.where(F.col(key_col).isin(list(keys)))
    return df.where(F.col(key_col) == F.lit(keys))


def recent_embeddings(df: DataFrame, since, limit: int = 10_000,
                      key: str = "url_hash", vec: str = "embedding",
                      time_col: str = "extracted_at") -> DataFrame:
    """(key, vector) with a vector, extracted since ``since``, newest first."""
    return (df.where(F.col(vec).isNotNull() & (F.col(time_col) >= F.lit(since)))
              .orderBy(F.desc(time_col), F.asc(key)).limit(limit).select(key, vec, time_col))


def alive(df: DataFrame, now, expire_col: str = "expire_at") -> DataFrame:
    """Strict TTL: an entry at exactly its expiry is dead."""
    return df.where(F.col(expire_col) > F.lit(now))


def alive_by_ttl(df: DataFrame, now, ts_col: str, ttl_seconds: int) -> DataFrame:
    """B10 on the write time: ts + ttl > now, written as ts > now - ttl so
    the predicate reaches the scan (PushedFilters) and row groups are skipped."""
    return df.where(F.col(ts_col) > F.timestamp_add("SECOND", F.lit(-int(ttl_seconds)), F.lit(now)))


def modified_only(snapshots: DataFrame, state: DataFrame, key: str = "feed_id") -> DataFrame:
    """Adds ``modified``: false for a 304 answer or when etag and
    last_modified equal the stored ones (null-safe)."""
    st = state.select(F.col(key), F.col("etag").alias("_etag"),
                      F.col("last_modified").alias("_lm"))
    j = snapshots.join(st, key, "left")
    same = (F.col("etag").eqNullSafe(F.col("_etag")) & F.col("last_modified").eqNullSafe(F.col("_lm"))
            & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()))
    status = F.col("http_status") if "http_status" in snapshots.columns else F.lit(200)
    return j.withColumn("modified", ~((status == 304) | same)).drop("_etag", "_lm")
