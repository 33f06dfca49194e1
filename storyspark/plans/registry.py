"""Registered queries (one per operator row) and their DuckDB oracles.

Every query reads the driver tables (or data Spark derives from them) whole;
parameters are fixed up front. Column names and types match the SQL twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import simhash as SH
from ..functions import text as TX
from ..functions import urls as U
from ..functions.topics import classify_topic, topic_sql
from ..functions.vectors import l2_norm, l2_normalize, valid_vector
from ..operators import clusters as CL
from ..operators import dedup as DD
from ..operators import feeds as FD
from ..operators import filters as FL
from ..operators import index as IX
from ..operators import lsh as LSH
from ..operators import reports as RP
from ..operators import store as ST
from ..operators import vectors as VE
from ..session import cut_lineage, ensure_checkpoint_dir, idle_cores, ship_package
from ..sources import tables as TB
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VEC_THRESHOLD = 0.3          # embeddings table: checked thresholds 0.3 to 0.5
LSH_THRESHOLD = 0.5
NOW_FEEDS = "2024-01-31 00:00:00"
NOW_CLUSTERS = "2024-01-02 00:00:00"


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _vector_text(vec: Column) -> Column:
    """A whole vector as text, components in units of 1e-5 (for comparison)."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 100000).cast("long").cast("string")), ",")


def _t(spark, sf, name):
    return TB.read_table(spark, sf, name)


_ART = f"arts AS ({TB.ARTICLES_SQL})"
_VART = f"varts AS ({TB.VECTOR_ARTICLES_SQL})"

# ----------------------------------------------------------------------------
# H: scalar functions
# ----------------------------------------------------------------------------

@register("url_hash", f"""
WITH {S.canonical_url_ctes('c', 'pages', 'page_id', 'url')}
SELECT id AS page_id, canon AS canonical_url, sha256(canon) AS url_hash,
       sha256(url) AS raw_url_hash, netloc AS source_domain FROM c""")
def q_url_hash(spark, sf):
    """H1, H4, H5 on every page URL."""
    p = _t(spark, sf, "pages")
    return p.select("page_id", U.canonical_url("url").alias("canonical_url"),
                    U.url_hash("url").alias("url_hash"), U.raw_url_hash("url").alias("raw_url_hash"),
                    U.source_domain("url").alias("source_domain"))


@register("normalize_url", f"""
WITH {S.canonical_url_ctes('c', 'pages', 'page_id', 'url')},
k AS (SELECT id, lscheme, lnetloc, cpath, params,
        array_to_string(list_filter(string_split(query, '&'),
          lambda x: NOT regexp_matches(x, '^(?i)utm_') AND split_part(x, '=', 2) <> '' AND contains(x, '=')), '&') AS q
      FROM c)
SELECT id AS page_id,
       (CASE WHEN lscheme <> '' THEN lscheme || ':' ELSE '' END) || '//' || lnetloc || cpath
       || (CASE WHEN params <> '' THEN ';' || params ELSE '' END)
       || (CASE WHEN q <> '' THEN '?' || q ELSE '' END) AS normalized_url
FROM k""")
def q_normalize_url(spark, sf):
    """H2: canonical URL without utm_* and blank params (urllib quoting)."""
    p = _t(spark, sf, "pages")
    return p.select("page_id", U.normalize_url(F.col("url")).alias("normalized_url"))


@register("normalize_text", """
SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm_md5,
       CAST(length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS BIGINT) AS norm_len
FROM documents""")
def q_normalize_text(spark, sf):
    """H6 over whole documents (md5 of the normalized text)."""
    d = _t(spark, sf, "documents")
    n = TX.normalize_text("text")
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_len"))


@register("shingles", """
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM documents),
w AS (SELECT doc_id, CASE WHEN norm = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(norm, ' ') END AS ws FROM n),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) ELSE
        list_transform(generate_series(1, greatest(len(ws) - 2, 1)), lambda i: array_to_string(ws[i:i+2], ' ')) END AS sh
      FROM w)
SELECT doc_id, CAST(len(sh) AS INTEGER) AS n_shingles, md5(array_to_string(sh, '|')) AS shingles_md5 FROM s""")
def q_shingles(spark, sf):
    """H7: 3-word shingles of every document."""
    d = _t(spark, sf, "documents")
    sh = TX.shingles(TX.normalize_text("text"))
    return d.select("doc_id", F.size(sh).alias("n_shingles"),
                    F.md5(F.array_join(sh, "|")).alias("shingles_md5"))


@register("topic", f"""
SELECT conv_id, turn, {topic_sql('text')} AS topic FROM conversations""")
def q_topic(spark, sf):
    """Keyword topic of every conversation turn."""
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", classify_topic("text").alias("topic"))


@register("split_authors", """
SELECT c_custkey, array_to_string(list_filter(list_transform(
         string_split(' ' || c_name || ' ;; ' || c_mktsegment || ' ; ', ';'),
         lambda s: trim(s)), lambda s: s <> ''), '|') AS authors
FROM customer""")
def q_split_authors(spark, sf):
    """H13: ';'-separated author strings to trimmed, non-blank names."""
    c = _t(spark, sf, "customer")
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit(" ;; "), F.col("c_mktsegment"), F.lit(" ; "))
    return c.select("c_custkey", F.array_join(TX.split_authors(raw), "|").alias("authors"))


@register("parse_day", """
SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS day,
       try_strptime(o_orderpriority, '%Y-%m-%d') IS NULL AS bad_is_null
FROM orders""")
def q_parse_day(spark, sf):
    """H14: 'YYYY-MM-DD' to midnight UTC, null when it does not parse."""
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey",
                    TX.parse_day(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz").alias("day"),
                    TX.parse_day("o_orderpriority").isNull().alias("bad_is_null"))


@register("l2_normalize", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(round(x / nrm * 100000) AS BIGINT)), ',') AS unit,
       round(sqrt(list_sum(list_transform(v, lambda x: (x / nrm) * (x / nrm)))), 6) AS norm
FROM n""")
def q_l2_normalize(spark, sf):
    """Unit vectors (all components in 1e-5 and the resulting norm)."""
    e = _t(spark, sf, "embeddings")
    u = l2_normalize("embedding")
    return e.select("vec_id", _vector_text(u).alias("unit"), F.round(l2_norm(u), 6).alias("norm"))


@register("simhash", f"""
WITH {S.simhash_ctes('sh', 'documents', 'doc_id', 'text')}
SELECT id AS doc_id, sim_hi, sim_lo, {S.hex128('sim_hi', 'sim_lo')} AS simhash_hex,
       {S.reference_bands_sql('sim_hi', 'sim_lo')} AS bands
FROM sh""")
def q_simhash(spark, sf):
    """D1 + H8: 128-bit SimHash of every document, hex, reference bands."""
    docs = _t(spark, sf, "documents")
    d = DD.with_simhash(docs, "text", partitions=idle_cores(docs))
    bands = SH.reference_bands("sim_hi", "sim_lo")
    return d.select("doc_id", "sim_hi", "sim_lo", SH.simhash_hex("sim_hi", "sim_lo").alias("simhash_hex"),
                    F.array_join(F.transform(bands, lambda b: b["value"]), ",").alias("bands"))


# ----------------------------------------------------------------------------
# B: filters
# ----------------------------------------------------------------------------

@register("min_content", """
SELECT doc_id, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS content_length
FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50""")
def q_min_content(spark, sf):
    """B1: drop documents whose trimmed text is under 50 characters."""
    d = _t(spark, sf, "documents")
    return FL.min_content(d, "text", 50).select("doc_id", "content_length")


@register("valid_vectors", """
SELECT vec_id, len(embedding) = 64 AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS valid_vector
FROM embeddings""")
def q_valid_vectors(spark, sf):
    """Dimension and non-zero check (dimension 64 in this table)."""
    return FL.valid_vectors(_t(spark, sf, "embeddings"), "embedding", 64).select("vec_id", "valid_vector")


@register("quarantine", f"""
WITH {_ART}
SELECT doc_id,
       (length(title) >= 1 AND length(content) >= 1 AND length(language) BETWEEN 2 AND 10
        AND quality_score BETWEEN 0 AND 1 AND content_length >= 0 AND length(url_hash) = 64) AS valid,
       concat_ws(',', CASE WHEN NOT length(title) >= 1 THEN 'title_len' END,
                 CASE WHEN NOT length(content) >= 1 THEN 'content_len' END,
                 CASE WHEN NOT length(language) BETWEEN 2 AND 10 THEN 'language_len' END,
                 CASE WHEN NOT quality_score BETWEEN 0 AND 1 THEN 'quality_range' END,
                 CASE WHEN NOT content_length >= 0 THEN 'content_length_nonneg' END,
                 CASE WHEN NOT length(url_hash) = 64 THEN 'url_hash_len' END) AS reasons
FROM arts""")
def q_quarantine(spark, sf):
    """B2: article field rules, valid flag and failed rule names."""
    a = FL.split_valid(TB.articles(spark, sf), FL.article_rules())
    return a.select("doc_id", "valid", F.array_join("reasons", ",").alias("reasons"))


# feeds derived from the poll log in events (user_id = feed)
def _feed_state_sql(src: str = "events", p: str = "") -> str:
    return """
{p}lg AS (SELECT user_id AS feed_id, event_id, ts, event_type = 'error' AS failed,
              CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN 'v' || event_id END AS etag,
              CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS last_modified,
              CASE WHEN event_type = 'error' THEN 'poll ' || event_id || ' failed' END AS error,
              CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS delta FROM {src}),
{p}ord AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ts, event_id) AS rn,
               sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS oks_so_far FROM {p}lg),
{p}runs AS (SELECT feed_id, oks_so_far, count(*) AS n FROM {p}ord WHERE failed GROUP BY feed_id, oks_so_far),
{p}lastok AS (SELECT feed_id, max(CASE WHEN NOT failed THEN ts END) AS last_polled_at,
                  max(CASE WHEN NOT failed THEN rn END) AS last_ok_rn,
                  CAST(sum(delta) AS BIGINT) AS article_count, min(ts) AS created_at,
                  arg_max(ts, rn) AS last_ts, arg_max(failed, rn) AS last_failed, arg_max_null(error, rn) AS last_error,
                  arg_max_null(etag, CASE WHEN NOT failed THEN rn END) AS etag,
                  arg_max_null(last_modified, CASE WHEN NOT failed THEN rn END) AS last_modified FROM {p}ord GROUP BY feed_id),
{p}trail AS (SELECT o.feed_id, count(*) AS error_count FROM {p}ord o JOIN {p}lastok l USING (feed_id)
          WHERE o.failed AND (l.last_ok_rn IS NULL OR o.rn > l.last_ok_rn) GROUP BY o.feed_id),
{p}fs AS (SELECT l.feed_id,
          CASE WHEN coalesce((SELECT max(n) FROM {p}runs r WHERE r.feed_id = l.feed_id), 0) >= 5 THEN 'error' ELSE 'active' END AS status,
          CAST(coalesce(t.error_count, 0) AS INTEGER) AS error_count, l.article_count, l.last_polled_at,
          CASE WHEN l.last_failed THEN l.last_ts + to_seconds(CAST(least(600 * pow(2, coalesce(t.error_count, 0)), 86400) AS BIGINT))
               ELSE l.last_ts + to_seconds(600) END AS next_poll_at,
          600 AS poll_interval, l.created_at, l.etag, l.last_modified, l.last_error, l.last_ts AS updated_at
       FROM {p}lastok l LEFT JOIN {p}trail t USING (feed_id)),
{p}feeds AS (SELECT CAST(feed_id AS VARCHAR) AS id, 'https://feed' || CAST(feed_id AS VARCHAR) || '.example.com/rss' AS url,
                 status, error_count, article_count, last_polled_at, next_poll_at, created_at FROM {p}fs)""".format(src=src, p=p)


@register("poll_state", f"""
WITH {_feed_state_sql()}
SELECT feed_id, status, error_count, article_count, last_polled_at, next_poll_at, etag, last_modified, last_error, updated_at FROM fs""")
def q_poll_state(spark, sf):
    """D12 + D13 + H18: feed state folded from the whole poll log."""
    st = FD.feed_state(FD.poll_log(_t(spark, sf, "events")))
    return st.select("feed_id", "status", "error_count", "article_count", "last_polled_at", "next_poll_at",
                     "etag", "last_modified", "last_error", "updated_at")


@register("due_feeds", f"""
WITH {_feed_state_sql()}
SELECT id, next_poll_at FROM feeds WHERE status = 'active' AND next_poll_at <= TIMESTAMP '{NOW_FEEDS}'
ORDER BY next_poll_at, id LIMIT 50""")
def q_due_feeds(spark, sf):
    """Active feeds due at a fixed time, most overdue first, 50."""
    f = FD.feeds_table(_t(spark, sf, "events"))
    return FL.due_feeds(f, F.lit(NOW_FEEDS).cast("timestamp_ntz"), 50).select("id", "next_poll_at")


@register("all_feeds", f"""
WITH {_feed_state_sql()}
SELECT id, url, created_at FROM feeds ORDER BY created_at DESC, id LIMIT 100 OFFSET 10""")
def q_all_feeds(spark, sf):
    """feeds by created desc, paged."""
    f = FD.feeds_table(_t(spark, sf, "events"))
    return RP.all_feeds(f, 100, 10).select("id", "url", "created_at")


@register("recent_articles", f"""
WITH {_ART}
SELECT url_hash AS id, doc_id, published_at FROM arts
ORDER BY published_at DESC NULLS FIRST, extracted_at DESC, url_hash LIMIT 20 OFFSET 10""")
def q_recent_articles(spark, sf):
    """published desc (nulls first), created desc, paged."""
    a = TB.articles(spark, sf).withColumn("id", F.col("url_hash")).withColumn("created_at", F.col("extracted_at"))
    return RP.recent_articles(a, 20, 10).select("id", "doc_id", "published_at")


@register("page_meta", f"""
WITH {_ART}
SELECT 3 AS page, 25 AS per_page, count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM arts""")
def q_page_meta(spark, sf):
    """paging metadata over all articles."""
    return RP.page_meta(TB.articles(spark, sf, with_quality=False), 3, 25)


@register("active_clusters", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS last_activity FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 100 OFFSET 20""")
def q_active_clusters(spark, sf):
    """Orders stand for clusters (status O = active), newest first, paged."""
    o = _t(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("archived").alias("status"),
        F.col("o_orderdate").alias("last_activity"))
    return FL.active_clusters(o, 100, 20).select("id", "last_activity")


@register("articles_of_cluster", """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_shipdate AS published_at
FROM lineitem WHERE l_orderkey = 1 ORDER BY l_shipdate DESC NULLS LAST, id LIMIT 50""")
def q_articles_of_cluster(spark, sf):
    """one cluster's members (lineitems of order 1), published desc."""
    li = _t(spark, sf, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").alias("cluster_id"), F.col("l_shipdate").alias("published_at"))
    return RP.articles_of_cluster(li, 1, 50).select("id", "published_at")


@register("public_articles", f"""
WITH {_ART}
SELECT url_hash AS id, url, title, language, quality_score, published_at, extracted_at, feed_id, content_length
FROM arts""")
def q_public_articles(spark, sf):
    """The public projection of articles (internals never selected)."""
    a = TB.articles(spark, sf).withColumn("id", F.col("url_hash"))
    return FL.public_view(a, "article").drop("content")


@register("lookup_keys", f"""
WITH {_ART}
SELECT doc_id, url_hash FROM arts WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def q_lookup_keys(spark, sf):
    """Batch lookup of articles by a key set (semi-join)."""
    a = TB.articles(spark, sf, with_quality=False)
    keys = _t(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return FL.lookup(a, "doc_id", keys).select("doc_id", "url_hash")


@register("recent_vectors", f"""
WITH {_VART}
SELECT url_hash, extracted_at,
       array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT)), ',') AS vector FROM varts
WHERE extracted_at >= TIMESTAMP '2024-01-01 03:00:00' ORDER BY extracted_at DESC, url_hash LIMIT 100""")
def q_recent_vectors(spark, sf):
    """Newest vectors since a time, 100."""
    v = TB.vector_articles(spark, sf)
    r = FL.recent_embeddings(v, F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"), 100)
    return r.select("url_hash", "extracted_at", _vector_text(F.col("embedding")).alias("vector"))


@register("ttl_alive", """
SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-15 00:00:00'""")
def q_ttl_alive(spark, sf):
    """Cache entries (expire = ts + 24 h) alive at a fixed time; strict."""
    e = _t(spark, sf, "events")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return FL.alive_by_ttl(e, now, "ts", 24 * 3600).select("event_id")


@register("changed_snapshots", """
WITH s AS (SELECT event_id, user_id AS feed_id, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS etag FROM events),
st AS (SELECT user_id AS feed_id, arg_max(CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), ts) AS etag
       FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT s.event_id, NOT (s.etag IS NOT DISTINCT FROM st.etag AND s.etag IS NOT NULL) AS modified
FROM s LEFT JOIN st ON st.feed_id = s.feed_id""")
def q_changed_snapshots(spark, sf):
    """Snapshots whose etag equals the stored one are unchanged."""
    e = _t(spark, sf, "events")
    snaps = e.select("event_id", F.col("user_id").alias("feed_id"),
                     F.floor(F.col("value") / 10).cast("long").cast("string").alias("etag"),
                     F.lit(None).cast("string").alias("last_modified"))
    state = (e.where(F.col("event_type") != "error").groupBy(F.col("user_id").alias("feed_id"))
              .agg(F.max_by(F.floor(F.col("value") / 10).cast("long").cast("string"), "ts").alias("etag"))
              .withColumn("last_modified", F.lit(None).cast("string")))
    return FL.modified_only(snaps, state).select("event_id", "modified")


# ----------------------------------------------------------------------------
# C / E / G: joins, ranking, sets
# ----------------------------------------------------------------------------

@register("known_url_guard", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q_known_url_guard(spark, sf):
    """Drop incoming rows whose key is already stored (anti-join)."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    stored = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return DD.known_url_guard(li, stored, "l_orderkey")


@register("latest_version", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
                               ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem)
WHERE rn = 1""")
def q_latest_version(spark, sf):
    """Highest version per key; equal versions: first arrival wins."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                          "l_quantity")
    return ST.latest_version(li, "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"])


@register("upsert_versioned", """
WITH u AS (
  SELECT o_orderkey AS k, 0 AS version, 'o' || o_orderkey AS id, o_orderdate AS created_at, o_totalprice AS payload,
         -1::BIGINT AS o1, -1::BIGINT AS o2 FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber, 'l' || l_orderkey || '-' || l_linenumber, l_shipdate, l_extendedprice,
         l_partkey, l_suppkey FROM lineitem)
SELECT f.k, f.id, f.created_at, w.version, w.payload
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o1, o2) AS r FROM u) f
JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, o1, o2) AS r FROM u) w ON w.k = f.k
WHERE f.r = 1 AND w.r = 1""")
def q_upsert_versioned(spark, sf):
    """A4 / A5: versioned upsert of every lineitem (version = line number)
    into the orders table; id and created_at stay as first inserted."""
    t = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(0).alias("version"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("payload"),
        F.lit(-1).cast("long").alias("o1"), F.lit(-1).cast("long").alias("o2"))
    b = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("version"),
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_shipdate").alias("created_at"), F.col("l_extendedprice").alias("payload"),
        F.col("l_partkey").alias("o1"), F.col("l_suppkey").alias("o2"))
    return ST.upsert_versioned(t, b, "k", "version", ["o1", "o2"])


@register("first_seen", """
SELECT user_id, arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id""")
def q_first_seen(spark, sf):
    """First event per key by arrival."""
    e = _t(spark, sf, "events").select("user_id", "event_id", "ts")
    return ST.first_seen(e, "user_id", "ts").select("user_id", "event_id")


@register("timeline", """
SELECT key, score FROM (SELECT user_id AS key, max(ts) AS score FROM events GROUP BY user_id)
ORDER BY score DESC, key LIMIT 1000""")
def q_timeline(spark, sf):
    """One entry per key with its latest score, newest 1,000."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("score"))
    return ST.capped_timeline(e, "key", "score", 1000)


@register("changed_keys", """
SELECT key, marked_at FROM (
  SELECT user_id AS key, min(ts) AS marked_at FROM events WHERE event_type = 'click' GROUP BY user_id) m
WHERE key NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
ORDER BY marked_at, key LIMIT 50""")
def q_changed_keys(spark, sf):
    """Distinct changed keys for one entity, minus processed, first 50."""
    e = _t(spark, sf, "events")
    marks = e.select(F.col("event_type").alias("entity"), F.col("user_id").alias("key"),
                     F.col("ts").alias("marked_at"))
    done = e.where("event_type = 'purchase' AND value > 100").select(F.col("user_id").alias("key"))
    return ST.changed_keys(marks, done, "click", 50)


@register("simhash_pairs", f"""
WITH {S.simhash_ctes('sh', 'documents', 'doc_id', 'text')},
fp AS (SELECT sim_hi AS hi, sim_lo AS lo, count(*) AS n FROM sh GROUP BY 1, 2)
SELECT a.hi, a.lo, b.hi AS nhi, b.lo AS nlo, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS dist,
       a.n, b.n AS nn
FROM fp a JOIN fp b ON (a.hi < b.hi OR (a.hi = b.hi AND a.lo < b.lo))
WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 11""")
def q_simhash_pairs(spark, sf):
    """Distinct fingerprint pairs within Hamming 11 (12 disjoint bands)
    with their row counts; copies are counted, never paired."""
    docs = _t(spark, sf, "documents")
    d = DD.with_simhash(docs, "text", partitions=idle_cores(docs))
    return DD.simhash_pairs(d, 11).select("hi", "lo", "nhi", "nlo", "dist", "n", "nn")


def _docs_k1_sql(limit: int) -> str:
    return f"""
WITH {_ART},
{S.simhash_ctes('sh', 'arts', 'doc_id', 'content')},
nodes AS (SELECT a.doc_id AS rid, a.arrival AS a, a.extracted_at AS t, a.url_hash AS uid, sh.sim_hi AS hi, sh.sim_lo AS lo,
                 true AS can_keep FROM arts a JOIN sh ON sh.id = a.doc_id),
edges AS (
  SELECT x.rid AS s, y.rid AS r, 'url' AS kind, 0 AS prio, CAST(NULL AS INTEGER) AS dist, CAST(NULL AS DOUBLE) AS score
  FROM nodes x JOIN nodes y ON x.uid = y.uid AND x.a < y.a
  UNION ALL
  SELECT x.rid, y.rid, 'simhash', 1, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER), NULL
  FROM nodes x JOIN nodes y ON x.a < y.a AND x.t + INTERVAL 72 HOUR > y.t
  WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= {limit}),
{S.mis_ctes('k1', 'nodes', 'edges')}
SELECT rid AS doc_id, kept, stage, duplicate_of, distance FROM k1"""


@register("dedup_decide", _docs_k1_sql(3))
def q_dedup_decide(spark, sf):
    """K1 (URL + SimHash stages, limit 3, 72 h) over all documents."""
    a = DD.with_simhash(TB.articles(spark, sf, with_quality=False), partitions=idle_cores(_t(spark, sf, "documents")))
    r = DD.dedup_decide(a, id_col="doc_id", hamming_limit=3)
    return r.select("doc_id", "kept", "stage", "duplicate_of", "distance")


@register("dedup_decide_wide", _docs_k1_sql(11))
def q_dedup_decide_wide(spark, sf):
    """K1 with SimHash limit 11 (12 bands), so near (not exact) copies meet."""
    a = DD.with_simhash(TB.articles(spark, sf, with_quality=False), partitions=idle_cores(_t(spark, sf, "documents")))
    r = DD.dedup_decide(a, id_col="doc_id", hamming_limit=11)
    return r.select("doc_id", "kept", "stage", "duplicate_of", "distance")


def _vec_k1_sql(thr: float, use_url: bool = True) -> str:
    url_edges = """
  SELECT x.rid AS s, y.rid AS r, 'url' AS kind, 0 AS prio, CAST(NULL AS INTEGER) AS dist, CAST(NULL AS DOUBLE) AS score
  FROM nodes x JOIN nodes y ON x.uid = y.uid AND x.a < y.a
  UNION ALL""" if use_url else ""
    return f"""
WITH {_VART},
nodes AS (SELECT vec_id AS rid, arrival AS a, url_hash AS uid, CAST(embedding AS DOUBLE[]) AS e,
                 list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS can_keep FROM varts),
edges AS ({url_edges}
  SELECT x.rid AS s, y.rid AS r, 'vector' AS kind, 2 AS prio, CAST(NULL AS INTEGER) AS dist,
         list_cosine_similarity(x.e, y.e) AS score
  FROM nodes x JOIN nodes y ON x.a < y.a
  WHERE x.can_keep AND y.can_keep AND list_cosine_similarity(x.e, y.e) >= {thr}),
{S.mis_ctes('k1', 'nodes', 'edges')}"""


@register("dedup_vectors", _vec_k1_sql(VEC_THRESHOLD) + """
SELECT rid AS vec_id, kept, stage, duplicate_of, score FROM k1""")
def q_dedup_vectors(spark, sf):
    """K1 vector stage (cosine >= 0.3 on the embeddings table)."""
    v = TB.vector_articles(spark, sf)
    r = DD.dedup_decide(v, id_col="vec_id", vector_col="embedding", use_simhash=False,
                        cos_threshold=VEC_THRESHOLD)
    return r.select("vec_id", "kept", "stage", "duplicate_of", "score")


def _repeat_urls_sql() -> str:
    return _docs_k1_sql(3).replace("a.url_hash AS uid", "'u' || CAST(a.doc_id // 3 AS VARCHAR) AS uid").replace(
        "SELECT rid AS doc_id, kept, stage, duplicate_of, distance FROM k1",
        "SELECT k1.rid AS doc_id, kept, stage, n.uid AS duplicate_of, distance FROM k1 LEFT JOIN nodes n ON n.rid = k1.duplicate_of")


@register("dedup_repeat_urls", _repeat_urls_sql())
def q_dedup_repeat_urls(spark, sf):
    """K1 under its default id, the url: three documents in a row share one."""
    a = DD.with_simhash(TB.articles(spark, sf, with_quality=False)).withColumn(
        "url_hash", F.concat(F.lit("u"), F.floor(F.col("doc_id") / 3).cast("string")))
    return DD.dedup_decide(a).select("doc_id", "kept", "stage", "duplicate_of", "distance")


GIVEN_COS, GIVEN_CLUSTER = 0.5, 0.3


def _given(spark, sf) -> DataFrame:
    """All documents with content as articles with fingerprints, each with a given vector: that of vec_id =
    doc_id modulo the number of embeddings, so vectors repeat and every one that a
    document reaches takes part."""
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    n = max(e.count(), 1)
    # fingerprints first, so that no text is shuffled for its vector
    a = DD.with_simhash(FL.min_content(TB.articles(spark, sf, with_quality=False), "content", 50)).drop("content")
    return a.withColumn("_vec", F.pmod(F.col("doc_id"), F.lit(n))).join(e, "_vec", "left").drop("_vec")


def _given_sql() -> str:
    return f"""
WITH {_ART},
{S.simhash_ctes('sh', 'arts', 'doc_id', 'content')},
nodes AS (SELECT a.doc_id AS rid, a.arrival AS a, a.extracted_at AS t, a.url_hash AS uid, sh.sim_hi AS hi, sh.sim_lo AS lo,
                 CAST(v.embedding AS DOUBLE[]) AS e, v.embedding IS NOT NULL AS can_keep
          FROM arts a JOIN sh ON sh.id = a.doc_id LEFT JOIN embeddings v ON v.vec_id = a.doc_id % (SELECT count(*) FROM embeddings)
          WHERE length(trim(a.content)) >= 50),
cos AS MATERIALIZED (SELECT x.vec_id AS v, y.vec_id AS w, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS c
        FROM embeddings x CROSS JOIN embeddings y),
ne AS (SELECT count(*) AS ne FROM embeddings),
edges AS (
  SELECT x.rid AS s, y.rid AS r, 'simhash' AS kind, 1 AS prio,
         CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER) AS dist, CAST(NULL AS DOUBLE) AS score
  FROM nodes x JOIN nodes y ON x.a < y.a AND x.t + INTERVAL 72 HOUR > y.t
  WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3
  UNION ALL
  SELECT x.rid, y.rid, 'vector', 2, NULL, least(c, 1.0) FROM ne, nodes x JOIN nodes y ON x.a < y.a
  JOIN cos ON v = x.rid % ne AND w = y.rid % ne AND c >= {GIVEN_COS}),
{S.mis_ctes('k1', 'nodes', 'edges')}"""


@register("dedup_given", _given_sql() + """
SELECT rid AS doc_id, kept, stage, duplicate_of, distance, score FROM k1""")
def q_dedup_given(spark, sf):
    """K1 with both stages over all documents, vectors given: SimHash (limit 3,
    72 h), then cosine >= 0.5."""
    a = cut_lineage(_given(spark, sf).select("doc_id", "arrival", "extracted_at", "url_hash", "sim_hi", "sim_lo", "embedding"))
    r = DD.dedup_decide(a, id_col="doc_id", vector_col="embedding", cos_threshold=GIVEN_COS)
    return r.select("doc_id", "kept", "stage", "duplicate_of", "distance", "score")


@register("story_given", _given_sql() + f""",
nodes2 AS (SELECT n.* FROM nodes n JOIN k1 ON k1.rid = n.rid AND k1.kept),
edges2 AS (SELECT x.rid AS s, y.rid AS r, 'vector' AS kind, 2 AS prio, CAST(NULL AS INTEGER) AS dist, least(c, 1.0) AS score
           FROM ne, nodes2 x JOIN nodes2 y ON x.a < y.a JOIN cos ON v = x.rid % ne AND w = y.rid % ne AND c >= {{GIVEN_CLUSTER}}),
{{S.mis_ctes('k2', 'nodes2', 'edges2')}}
SELECT k1.rid AS doc_id, k1.kept, k1.stage, n.uid AS duplicate_of, CASE WHEN k2.kept THEN o.uid ELSE m.uid END AS cluster_id,
       k2.kept AS is_new_cluster
FROM k1 LEFT JOIN nodes n ON n.rid = k1.duplicate_of LEFT JOIN k2 ON k2.rid = k1.rid
LEFT JOIN nodes o ON o.rid = k1.rid LEFT JOIN nodes m ON m.rid = k2.duplicate_of""".replace("{{", "{").replace("}}", "}").replace(
    "{GIVEN_CLUSTER}", str(GIVEN_CLUSTER)).replace("{S.mis_ctes('k2', 'nodes2', 'edges2')}", S.mis_ctes("k2", "nodes2", "edges2")))
def q_story_given(spark, sf):
    """K3 with given vectors: dedup (cosine >= 0.5), then story clusters of the
    kept articles (cosine >= 0.3)."""
    from .flows import story_flow
    r = story_flow(spark, sf, GIVEN_CLUSTER, _given(spark, sf), cos_threshold=GIVEN_COS)
    return r.select("doc_id", "kept", "stage", "duplicate_of", "cluster_id", "is_new_cluster")


# earlier names of the two queries above
register("dedup_given_all")(q_dedup_given)
register("story_given_all")(q_story_given)


@register("vector_pairs", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.vec_id AS left_id, y.vec_id AS right_id, round(list_cosine_similarity(x.v, y.v), 6) AS score
FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {VEC_THRESHOLD}""")
def q_vector_pairs(spark, sf):
    """Cosine >= 0.3 pairs, earlier row first (exact blocked join)."""
    e = _t(spark, sf, "embeddings")
    return VE.vector_pairs(e, "vec_id", "vec_id", "embedding", VEC_THRESHOLD)


@register("vector_pairs_lsh")
def q_vector_pairs_lsh(spark, sf):
    """C3 by sign random projections: cosine >= 0.5 pairs of the whole embeddings table, each
    found with probability 0.99 (no SQL twin: recall is tested against the exact join)."""
    return LSH.vector_pairs_lsh(_t(spark, sf, "embeddings"), "vec_id", "vec_id", "embedding", LSH_THRESHOLD)


def _label_centroids_sql() -> str:
    return """
ex AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i) GROUP BY label),
cl AS (SELECT c2.label, c2.c, la.last_activity FROM cen c2 JOIN
         (SELECT label, max(TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL 1 MINUTE) AS last_activity
          FROM embeddings GROUP BY label) la USING (label))"""


def _label_centroids(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    sums = CL.vector_sums(e, "label", "embedding")
    act = e.groupBy("label").agg(F.max(TB.minutes_after_epoch("vec_id")).alias("last_activity"))
    return (sums.join(act, "label")
                .select(F.col("label").alias("id"),
                        F.transform("vsum", lambda x: x / F.col("n")).alias("centroid"),
                        "last_activity", F.lit("active").alias("status")))


KNN_SQL = f"""
WITH {_label_centroids_sql()},
s AS (SELECT cl.label AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cl.c) AS score
      FROM embeddings e, cl WHERE list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cl.c) >= {VEC_THRESHOLD}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(least(score, 1.0), 4) AS score, rank FROM r WHERE rank <= 10"""


@register("knn_search", KNN_SQL)
def q_knn_search(spark, sf):
    """C4: top 10 articles per story centroid (label means), cosine >= 0.3."""
    qs = _label_centroids(spark, sf).select(F.col("id").alias("query_id"), F.col("centroid").alias("qvec"))
    hits = VE.knn_search(qs, _t(spark, sf, "embeddings"), k=10, threshold=VEC_THRESHOLD,
                         c_id="vec_id", c_vec="embedding")
    return hits.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long"))


@register("knn_indexed", KNN_SQL)
def q_knn_indexed(spark, sf):
    """C4 over a stored index of the embeddings table: the rows of knn_search."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    IX.write_index(_t(spark, sf, "embeddings"), path, "vec_id", "embedding")
    qs = _label_centroids(spark, sf).select(F.col("id").alias("query_id"), F.col("centroid").alias("qvec"))
    hits = IX.search(spark, path, qs, k=10, threshold=VEC_THRESHOLD, c_id="vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long"))


@register("assign_centroid", f"""
WITH {_label_centroids_sql()},
s AS (SELECT e.vec_id, cl.label, least(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cl.c), 1.0) AS score,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cl.c) DESC,
                                cl.last_activity DESC, cl.label) AS rn
      FROM embeddings e, cl)
SELECT vec_id, CASE WHEN score >= {VEC_THRESHOLD} THEN label END AS match_id, round(score, 6) AS match_score
FROM s WHERE rn = 1""")
def q_assign_centroid(spark, sf):
    """Nearest of the newest 100 active story centroids, join at >= 0.3."""
    cl = _label_centroids(spark, sf)
    a = VE.assign_to_centroid(_t(spark, sf, "embeddings"), cl, VEC_THRESHOLD, 100, "embedding")
    return a.select("vec_id", F.col("match_id").cast("int").alias("match_id"),
                    F.round("match_score", 6).alias("match_score"))


# ----------------------------------------------------------------------------
# K2 + store reports (clusters built from the embeddings table)
# ----------------------------------------------------------------------------

def _story_articles(spark, sf) -> DataFrame:
    v = TB.vector_articles(spark, sf)
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    lab = _t(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    a = v.join(d, "vec_id", "left").join(lab, "vec_id", "left")
    return a.select(
        "vec_id", "arrival", "url", "url_hash", "embedding", "extracted_at",
        F.col("vec_id").cast("string").alias("id"),
        F.coalesce(F.substring("text", 1, 60), F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("title"),
        F.coalesce("lang", F.lit("en")).alias("language"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("content_length"),
        F.coalesce("quality", F.lit(0)).cast("double").alias("quality_score"),
        F.when(F.col("vec_id") % 10 == 3, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("HOUR", -(F.col("vec_id") % 13), "extracted_at")).alias("published_at"))


_STORY_SQL = f"""
{_VART},
story AS (SELECT v.vec_id, v.arrival, v.url, v.url_hash, v.embedding, v.extracted_at, CAST(v.vec_id AS VARCHAR) AS id,
                 coalesce(substr(d.text, 1, 60), 'vector ' || CAST(v.vec_id AS VARCHAR)) AS title,
                 coalesce(d.lang, 'en') AS language, CAST(coalesce(length(d.text), 0) AS BIGINT) AS content_length,
                 CAST(coalesce(l.quality, 0) AS DOUBLE) AS quality_score,
                 CASE WHEN v.vec_id % 10 = 3 THEN NULL ELSE v.extracted_at - (v.vec_id % 13) * INTERVAL 1 HOUR END AS published_at
          FROM varts v LEFT JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN labels l ON l.doc_id = v.vec_id),
nodes AS (SELECT vec_id AS rid, arrival AS a, CAST(embedding AS DOUBLE[]) AS e,
                 list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS can_keep FROM varts),
edges AS (SELECT x.rid AS s, y.rid AS r, 'vector' AS kind, 2 AS prio, CAST(NULL AS INTEGER) AS dist,
                 list_cosine_similarity(x.e, y.e) AS score
          FROM nodes x JOIN nodes y ON x.a < y.a
          WHERE x.can_keep AND y.can_keep AND list_cosine_similarity(x.e, y.e) >= {VEC_THRESHOLD}),
{S.mis_ctes('k1', 'nodes', 'edges')},
asg AS (SELECT s.*, CAST(CASE WHEN k.kept THEN k.rid ELSE k.duplicate_of END AS VARCHAR) AS cluster_id,
               coalesce(k.kept, false) AS is_new_cluster, CASE WHEN k.kept THEN NULL ELSE k.score END AS similarity_score
        FROM story s JOIN k1 k ON k.rid = s.vec_id),
dom AS (SELECT cluster_id, regexp_extract(url, '^https://([^/]*)', 1) AS domain, min(arrival) AS first_at
        FROM asg GROUP BY 1, 2),
srcs AS (SELECT cluster_id, array_to_string(list(domain ORDER BY first_at), '|') AS top_sources
         FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first_at) AS rn FROM dom) WHERE rn <= 10
         GROUP BY cluster_id),
clus AS (SELECT a.cluster_id AS id, CAST(count(*) AS BIGINT) AS article_count, arg_min(title, arrival) AS label,
                max(extracted_at) AS last_activity, min(extracted_at) AS created_at,
                pow(0.5, (epoch(TIMESTAMP '{NOW_CLUSTERS}') - epoch(max(extracted_at))) / 3600.0 / 6.0) AS decay_score
         FROM asg a GROUP BY a.cluster_id),
clusters_t AS (SELECT c.*, CASE WHEN c.decay_score < 0.05 THEN 'decayed' ELSE 'active' END AS status, s.top_sources
               FROM clus c JOIN srcs s ON s.cluster_id = c.id)"""

_STORE_CACHE: dict = {}


def _story_store(spark, sf):
    """(assigned articles, clusters) built by K2 from the embeddings table;
    memoized per session (both sides are checkpointed)."""
    key = (id(spark), sf)
    if key not in _STORE_CACHE:
        arts = _story_articles(spark, sf)
        asg = CL.cluster_articles(arts, None, id_col="vec_id", threshold=VEC_THRESHOLD)
        from ..session import cut_lineage
        asg = cut_lineage(asg)
        cl = CL.build_clusters(asg)
        cl = RP.decay(cl.withColumn("status", F.lit("active")),
                      F.lit(NOW_CLUSTERS).cast("timestamp_ntz"))
        cl = cut_lineage(cl)
        _STORE_CACHE[key] = (asg, cl)
    return _STORE_CACHE[key]


@register("cluster_articles", f"""
WITH {_STORY_SQL}
SELECT vec_id, cluster_id, is_new_cluster, round(similarity_score, 6) AS similarity_score FROM asg""")
def q_cluster_articles(spark, sf):
    """K2: leader clustering at cosine 0.3 over the embeddings table."""
    asg, _ = _story_store(spark, sf)
    return asg.select("vec_id", "cluster_id", "is_new_cluster",
                      F.round("similarity_score", 6).alias("similarity_score"))


@register("cluster_stats", f"""
WITH {_STORY_SQL}
SELECT id AS cluster_id, article_count, label, last_activity, top_sources, CAST(article_count AS INTEGER) AS version
FROM clusters_t""")
def q_cluster_stats(spark, sf):
    """Count, label (first member), activity, first 10 sources."""
    _, cl = _story_store(spark, sf)
    return cl.select(F.col("id").alias("cluster_id"), "article_count", "label", "last_activity",
                     F.array_join("top_sources", "|").alias("top_sources"), "version")


@register("centroids", f"""
WITH {_STORY_SQL},
ex AS (SELECT cluster_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM asg),
sm AS (SELECT cluster_id, i, sum(x) AS s FROM ex GROUP BY 1, 2),
nr AS (SELECT cluster_id, sqrt(sum(s * s)) AS n FROM sm GROUP BY 1)
SELECT sm.cluster_id, string_agg(CAST(CAST(round(sm.s / nr.n * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY sm.i) AS centroid
FROM sm JOIN nr USING (cluster_id) GROUP BY sm.cluster_id""")
def q_centroids(spark, sf):
    """D2 (sum form): unit centroid per cluster (all components in 1e-5)."""
    _, cl = _story_store(spark, sf)
    return cl.select(F.col("id").alias("cluster_id"), _vector_text(F.col("centroid")).alias("centroid"))


_EXPORT_CLUSTERS_SQL = f"""
SELECT id AS cluster_id, {topic_sql('label')} AS topic, label, article_count, status, top_sources,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(created_at) % 1000000 <> 0
            THEN '.' || lpad(CAST(microsecond(created_at) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS created_at,
       strftime(last_activity, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(last_activity) % 1000000 <> 0
            THEN '.' || lpad(CAST(microsecond(last_activity) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS last_activity,
       round(decay_score, 4) AS decay_score
FROM clusters_t"""


@register("export_clusters", f"""
WITH {_STORY_SQL}
{_EXPORT_CLUSTERS_SQL}""")
def q_export_clusters(spark, sf):
    """Flat cluster export with topic, pipe-joined sources, ISO times."""
    _, cl = _story_store(spark, sf)
    return RP.export_clusters(cl)


@register("export_articles", f"""
WITH {_STORY_SQL},
ct AS (SELECT id AS cluster_id, label AS cluster_label, {topic_sql('label')} AS topic FROM clusters_t)
SELECT a.id AS article_id, coalesce(ct.topic, 'Unclustered') AS topic, coalesce(ct.cluster_label, '') AS cluster_label,
       coalesce(a.cluster_id, '') AS cluster_id, a.title AS article_title, a.url, a.language, a.content_length,
       round(a.quality_score, 4) AS quality_score,
       strftime(a.extracted_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS extracted_at,
       coalesce(strftime(a.published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', '') AS published_at
FROM asg a LEFT JOIN ct ON ct.cluster_id = a.cluster_id""")
def q_export_articles(spark, sf):
    """A8 + C6: article export with cluster label and topic."""
    asg, cl = _story_store(spark, sf)
    return RP.export_articles(asg, cl)


@register("export_nested", f"""
WITH {_STORY_SQL},
ec AS ({_EXPORT_CLUSTERS_SQL})
SELECT ec.topic, ec.cluster_id, ec.article_count, a.id AS article_id, a.title, a.language, a.content_length,
       round(a.quality_score, 4) AS quality_score,
       coalesce(strftime(a.published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', '') AS published_at
FROM ec LEFT JOIN asg a ON a.cluster_id = ec.cluster_id""")
def q_export_nested(spark, sf):
    """A9 + D9 flattened: topic -> cluster -> article rows."""
    asg, cl = _story_store(spark, sf)
    f = RP.export_nested_flat(asg, cl)
    return f.select("topic", "cluster_id", "article_count", "article_id", "title", "language", "content_length",
                    "quality_score", "published_at")


@register("topic_summary", f"""
WITH {_STORY_SQL}
SELECT {topic_sql('label')} AS topic, count(*) AS clusters FROM clusters_t GROUP BY 1""")
def q_topic_summary(spark, sf):
    """Clusters per topic."""
    _, cl = _story_store(spark, sf)
    return RP.topic_summary(cl)


@register("export_totals", f"""
WITH {_STORY_SQL}
SELECT (SELECT count(DISTINCT {topic_sql('label')}) FROM clusters_t) AS topic_count,
       (SELECT CAST(count(*) AS BIGINT) FROM clusters_t) AS total_clusters,
       (SELECT CAST(count(*) AS BIGINT) FROM asg WHERE cluster_id IN (SELECT id FROM clusters_t)) AS total_articles""")
def q_export_totals(spark, sf):
    """Topic, cluster and article totals of the export."""
    asg, cl = _story_store(spark, sf)
    return RP.export_totals(asg, cl)


@register("stats", f"""
WITH {_STORY_SQL}, {_feed_state_sql()}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM asg) AS articles, (SELECT CAST(count(*) AS BIGINT) FROM clusters_t) AS clusters,
       (SELECT CAST(count(*) AS BIGINT) FROM clusters_t WHERE status = 'active') AS active_clusters,
       (SELECT CAST(count(*) AS BIGINT) FROM feeds) AS feeds""")
def q_stats(spark, sf):
    """Articles, clusters, active clusters, feeds."""
    asg, cl = _story_store(spark, sf)
    return RP.counts(asg, cl, FD.feeds_table(_t(spark, sf, "events")))


@register("cluster_detail", f"""
WITH {_STORY_SQL},
r AS (SELECT cluster_id, id AS article_id, title, published_at,
             row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC NULLS LAST, id) AS rank FROM asg)
SELECT c.id AS cluster_id, c.label, c.article_count, r.article_id, CAST(r.rank AS INTEGER) AS rank
FROM clusters_t c LEFT JOIN r ON r.cluster_id = c.id AND r.rank <= 100""")
def q_cluster_detail(spark, sf):
    """C7 flattened: each cluster with its newest 100 articles."""
    asg, cl = _story_store(spark, sf)
    rows = RP.cluster_detail_rows(cl, asg, 100)
    return rows.select("cluster_id", "label", "article_count", "article_id", F.col("rank").cast("int"))


@register("decay", f"""
WITH {_STORY_SQL}
SELECT id, round(decay_score, 6) AS decay_score, status FROM clusters_t""")
def q_decay(spark, sf):
    """H22 + I12: decay score and status of every cluster at a fixed time."""
    _, cl = _story_store(spark, sf)
    return cl.select("id", F.round("decay_score", 6).alias("decay_score"), "status")


@register("client_frames", f"""
WITH {_STORY_SQL}
SELECT cluster_id, id AS article_id, title, regexp_extract(url, '^https://([^/]*)', 1) AS source_domain,
       is_new_cluster FROM asg""")
def q_client_frames(spark, sf):
    """The public frame fields of every clustered event."""
    asg, _ = _story_store(spark, sf)
    from ..streaming.frames import client_frame_fields
    return client_frame_fields(asg)


# ----------------------------------------------------------------------------
# D: other aggregations
# ----------------------------------------------------------------------------

@register("metric_totals", """
SELECT event_type AS name, sum(value) AS total FROM events GROUP BY event_type""")
def q_metric_totals(spark, sf):
    """Named counters."""
    e = _t(spark, sf, "events").select(F.col("event_type").alias("name"), "value")
    return RP.metric_totals(e).withColumn("total", F.round("total", 6))


ORACLES["metric_totals"] = """
SELECT event_type AS name, round(sum(value), 6) AS total FROM events GROUP BY event_type"""


@register("latency_merged")
def q_latency_merged(spark, sf):
    """D11 by sketches per event type and day, merged over the days (no SQL twin: the rank
    error is tested against exact ranks)."""
    e = _t(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), F.col("value").alias("latency_ms"))
    return RP.merged_latency(RP.latency_sketches(e, "latency_ms", ["event_type", "day"]), ["event_type"])


@register("latency_summary", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rk,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT event_type, n,
             max(CASE WHEN rk = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN value END) AS p50,
             max(CASE WHEN rk = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) THEN value END) AS p90,
             max(CASE WHEN rk = least(CAST(floor(n * 0.99) AS BIGINT), n - 1) THEN value END) AS p99
      FROM r GROUP BY event_type, n)
SELECT p.event_type, p.n, round(m.mean, 6) AS mean, p.p50, p.p90, p.p99
FROM p JOIN (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) m USING (event_type)""")
def q_latency_summary(spark, sf):
    """N, mean, p50/p90/p99 (index rule int(n*q)) per event type."""
    e = _t(spark, sf, "events").select("event_type", F.col("value").alias("latency_ms"))
    s = RP.latency_summary(e, "latency_ms", "event_type")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), "p50", "p90", "p99")


# ----------------------------------------------------------------------------
# I: stream operators, batch twins
# ----------------------------------------------------------------------------

@register("event_once", """
SELECT event_id, min(ts) AS ts FROM (SELECT event_id, ts FROM events
  UNION ALL SELECT event_id, ts FROM events WHERE event_type = 'click') GROUP BY event_id""")
def q_event_once(spark, sf):
    """I3 batch twin: clicks delivered twice, each event_id kept once."""
    from ..streaming.ops import drop_repeated
    e = _t(spark, sf, "events").select("event_id", "ts", "event_type")
    twice = e.unionByName(e.where("event_type = 'click'"))
    return drop_repeated(twice, "event_id").select("event_id", "ts")


@register("poison_split", """
WITH env AS (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, 5)
                WHEN event_id % 5 = 0 THEN '{"k": "abc"}' ELSE props END AS payload FROM events)
SELECT event_id, coalesce(CASE WHEN json_valid(payload) THEN json_type(payload, '$.k') IN ('UBIGINT', 'BIGINT') END, false) AS valid,
       CAST(CASE WHEN json_valid(payload) AND json_type(payload, '$.k') IN ('UBIGINT', 'BIGINT')
                 THEN json_extract(payload, '$.k') END AS INTEGER) AS k
FROM env""")
def q_poison_split(spark, sf):
    """I7 batch twin: payloads that are not valid JSON of the schema go aside."""
    from ..streaming.ops import poison_split
    e = _t(spark, sf, "events")
    env = e.select("event_id", F.when(F.col("event_type") == "error", F.substring("props", 1, 5))
                   .when(F.col("event_id") % 5 == 0, '{"k": "abc"}')
                   .otherwise(F.col("props")).alias("payload"))
    r = poison_split(env, "payload", "k INT")
    return r.select("event_id", "valid", F.col("parsed.k").alias("k"))


@register("live_board", f"""
WITH {_STORY_SQL},
ev AS (SELECT cluster_id, id AS article_id, title, regexp_extract(url, '^https://([^/]*)', 1) AS domain,
              arrival, extracted_at FROM asg
       UNION ALL SELECT CASE WHEN arrival % 2 = 0 THEN '0' ELSE cluster_id END, id, title,
              regexp_extract(url, '^https://([^/]*)', 1), arrival + 100000, extracted_at
       FROM asg WHERE arrival % 7 = 0),
d AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY arrival, cluster_id) = 1),
s AS (SELECT cluster_id, domain, min(arrival) AS first_at FROM d GROUP BY ALL),
b AS (SELECT cluster_id, CAST(count(*) AS BIGINT) AS articles, max(extracted_at) AS updated_at FROM d GROUP BY cluster_id)
SELECT b.*, (SELECT string_agg(domain, '|' ORDER BY first_at, domain) FROM s WHERE s.cluster_id = b.cluster_id) AS sources
FROM b ORDER BY updated_at DESC, cluster_id LIMIT 300""")
def q_live_board(spark, sf):
    """I8 batch twin: per cluster distinct articles (repeats ignored),
    sources, last update; newest 300 clusters."""
    from ..streaming.ops import board_fold
    asg, _ = _story_store(spark, sf)
    ev = asg.select("cluster_id", F.col("id").alias("article_id"), "title", "url", "arrival", "extracted_at")
    # redelivered later, some naming another cluster: an article counts once
    again = ev.where(F.col("arrival") % 7 == 0).withColumn(
        "cluster_id", F.when(F.col("arrival") % 2 == 0, "0").otherwise(F.col("cluster_id"))).withColumn(
        "arrival", F.col("arrival") + 100000)
    return board_fold(ev.unionByName(again), 300).withColumn("sources", F.array_join("sources", "|"))


@register("retain", """
SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def q_retain(spark, sf):
    """Keep events within 7 days of the newest one."""
    from ..streaming.ops import retain
    e = _t(spark, sf, "events")
    return retain(e, "ts", 7 * 24 * 3600).select("event_id")


# ----------------------------------------------------------------------------
# A: sources
# ----------------------------------------------------------------------------

@register("page_title", """
WITH t AS (SELECT page_id,
   coalesce(nullif(regexp_extract(html, '<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']+)["'']', 1), ''),
            nullif(regexp_extract(html, '<meta[^>]+content=["'']([^"'']+)["''][^>]+property=["'']og:title["'']', 1), '')) AS og,
   CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS tt
   FROM pages),
u AS (SELECT page_id, trim(coalesce(og, tt), ' \t\n\r') AS raw FROM t)
SELECT page_id, coalesce(nullif(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'),
        '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), ''), 'Unknown Title') AS title
FROM u""")
def q_page_title(spark, sf):
    """Og:title (either attribute order), else <title>, unescaped."""
    from ..sources.pages import page_title
    p = _t(spark, sf, "pages")
    return p.select("page_id", page_title("html").alias("title"))


@register("page_extract")
def q_page_extract(spark, sf):
    """A2: raw pages to title, text (as its digest), authors, date, image; short text dropped
    (no SQL twin: tested against a plain version)."""
    from ..sources.pages import extract_pages
    return extract_pages(_t(spark, sf, "pages")).select(
        "page_id", "url_hash", "title", F.sha2("content", 256).alias("content_sha256"), "content_length",
        F.array_join("authors", "|").alias("authors"), "published_at", "top_image_url", "raw_html_size")


@register("feed_items", """
WITH d AS (SELECT source AS feed_id, doc_id // 25 AS snapshot_id, doc_id FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY feed_id, snapshot_id ORDER BY doc_id) - 1 AS pos FROM d)
SELECT feed_id, snapshot_id, CAST(pos AS INTEGER) AS pos,
       'https://' || feed_id || '.example.com/a/' || CAST(doc_id AS VARCHAR) AS link,
       'guid:' || feed_id || '-' || CAST(doc_id AS VARCHAR) AS item_key
FROM p WHERE pos < 20""")
def q_feed_items(spark, sf):
    """A1 + E1 + H3: RSS snapshots (built by Spark from the documents, one per
    feed and 25-document window) parsed back to items, first 20 each."""
    from .feed_fixture import rss_snapshots
    snaps = rss_snapshots(_t(spark, sf, "documents"))
    it = FD.feed_items(snaps, "xml", 20)
    return it.select("feed_id", "snapshot_id", F.col("pos").cast("int").alias("pos"), "link", "item_key")


@register("embed_docs")
def q_embed_docs(spark, sf):
    """Every document to a 384-d unit vector (feature hashing default)."""
    docs = _t(spark, sf, "documents")
    d = VE.embed(docs, "text", "embedding", partitions=idle_cores(docs))
    return d.select("doc_id", F.size("embedding").alias("dim"),
                    F.round(l2_norm("embedding"), 4).alias("norm"),
                    valid_vector("embedding", 384).alias("valid"))


@register("dedup_full")
def q_dedup_full(spark, sf):
    """K1 with both stages: SimHash (limit 3, 72 h) then cosine >= 0.92 on
    J1 vectors, over all documents."""
    a = DD.with_simhash(TB.articles(spark, sf, with_quality=False), partitions=idle_cores(_t(spark, sf, "documents")))
    a = VE.embed(a, "content", "embedding")
    a = cut_lineage(a.select("doc_id", "arrival", "extracted_at", "url_hash", "sim_hi", "sim_lo", "embedding"))
    r = DD.dedup_decide(a, id_col="doc_id", vector_col="embedding")
    return r.select("doc_id", "kept", "stage", "duplicate_of", "distance", "score")


@register("upsert_clusters", f"""
WITH {_STORY_SQL},
t AS (SELECT id, label, article_count, CAST(article_count AS INTEGER) AS version, top_sources, created_at, last_activity AS updated_at FROM clusters_t),
b AS (SELECT CASE WHEN length(label) % 4 = 0 THEN 'n' || id ELSE id END AS id, 'new ' || label AS label, article_count + 1 AS article_count,
             version + length(label) % 3 - 1 AS version, top_sources, created_at + INTERVAL 1 HOUR AS created_at,
             updated_at + INTERVAL 1 HOUR AS updated_at FROM t)
SELECT coalesce(t.id, b.id) AS id, CASE WHEN t.id IS NULL OR b.version > t.version THEN b.label ELSE t.label END AS label,
       CASE WHEN t.id IS NULL OR b.version > t.version THEN b.article_count ELSE t.article_count END AS article_count,
       CASE WHEN t.id IS NULL OR b.version > t.version THEN b.version ELSE t.version END AS version,
       coalesce(t.top_sources, b.top_sources) AS top_sources, coalesce(t.created_at, b.created_at) AS created_at,
       CASE WHEN t.id IS NULL OR b.version > t.version THEN b.updated_at ELSE t.updated_at END AS updated_at
FROM t FULL JOIN b ON t.id = b.id""")
def q_upsert_clusters(spark, sf):
    """A5: a batch of newer, equal, older and new cluster versions into the
    cluster table; created_at stays, updated_at moves with an accepted version."""
    _, cl = _story_store(spark, sf)
    t = cl.select("id", "label", "article_count", F.col("article_count").cast("int").alias("version"),
                  F.array_join("top_sources", "|").alias("top_sources"), "created_at", F.col("last_activity").alias("updated_at"))
    size = F.length("label")
    b = t.select(F.when(size % 4 == 0, F.concat(F.lit("n"), F.col("id"))).otherwise(F.col("id")).alias("id"),
                 F.concat(F.lit("new "), F.col("label")).alias("label"), (F.col("article_count") + 1).alias("article_count"),
                 (F.col("version") + size % 3 - 1).cast("int").alias("version"), "top_sources",
                 F.timestamp_add("HOUR", F.lit(1), "created_at").alias("created_at"),
                 F.timestamp_add("HOUR", F.lit(1), "updated_at").alias("updated_at"), F.lit(1).cast("long").alias("arrival"))
    return ST.upsert_versioned(t, b, "id", "version", "arrival", keep_first=("created_at",))


@register("upsert_feeds", f"""
WITH {_feed_state_sql("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00')", "e_")},
{_feed_state_sql("events", "a_")}
SELECT t.id, t.url, t.created_at, t.last_polled_at, b.status, b.article_count, b.next_poll_at
FROM e_feeds t JOIN a_feeds b ON b.url = t.url
UNION ALL
SELECT b.id, b.url, b.created_at, b.last_polled_at, b.status, b.article_count, b.next_poll_at
FROM a_feeds b WHERE b.url NOT IN (SELECT url FROM e_feeds)""")
def q_upsert_feeds(spark, sf):
    """Feed rows seeded from the first half of the poll log, then
    re-seeded from the whole log: key url, last write wins, id / created_at /
    last_polled_at keep the stored value."""
    ev = _t(spark, sf, "events")
    first = FD.feeds_table(ev.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
    full = FD.feeds_table(ev)
    cols = ["id", "url", "created_at", "last_polled_at", "status", "article_count", "next_poll_at"]
    t = first.select(*cols, F.lit(0).cast("long").alias("arrival"))
    b = full.select(*cols, F.lit(1).cast("long").alias("arrival"))
    return ST.upsert_last_write(t, b, "url", "arrival").select(*cols)


@register("centroid_table", f"""
WITH {_STORY_SQL}
SELECT id, article_count, (SELECT string_agg(CAST(CAST(round(s / n * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY i)
  FROM (SELECT i, sum(x) AS s, sqrt(sum(sum(x) * sum(x)) OVER ()) AS n
        FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
              FROM asg WHERE cluster_id = clusters_t.id) GROUP BY i)) AS centroid
FROM clusters_t WHERE status = 'active'""")
def q_centroid_table(spark, sf):
    """C11: active clusters with a full-size centroid (dimension 64 here)."""
    _, cl = _story_store(spark, sf)
    return RP.centroid_table(cl, 64).select("id", "article_count", _vector_text(F.col("centroid")).alias("centroid"))


@register("timeline_vectors", """
WITH tl AS (SELECT user_id AS key, max(ts) AS score FROM events GROUP BY user_id ORDER BY score DESC, key LIMIT 100),
vc AS (SELECT vec_id AS key, TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL 1 MINUTE + INTERVAL 24 HOUR AS expire_at
       FROM embeddings)
SELECT tl.key, tl.score FROM tl JOIN vc ON vc.key = tl.key WHERE vc.expire_at > TIMESTAMP '2024-01-01 12:00:00'""")
def q_timeline_vectors(spark, sf):
    """Newest 100 timeline keys joined to cached vectors alive at a
    fixed time (cache entry = embedding row, expiry extracted_at + 24 h)."""
    tl = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("score"))
    tl = ST.capped_timeline(tl, "key", "score", 1000)
    vc = TB.vector_articles(spark, sf).select(
        F.col("vec_id").alias("key"), F.timestamp_add("HOUR", F.lit(24), "extracted_at").alias("expire_at"))
    return RP.timeline_vectors(tl, vc, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), 100).select("key", "score")


@register("search_articles", f"""
WITH {_label_centroids_sql()},
s AS (SELECT cl.label AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cl.c) AS score
      FROM embeddings e, cl WHERE list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cl.c) >= {VEC_THRESHOLD}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT r.query_id, CAST(r.rank AS BIGINT) AS rank, round(least(r.score, 1.0), 4) AS score, CAST(r.vec_id AS VARCHAR) AS id,
       substr(d.text, 1, 60) AS title, substr(d.text, 1, 200) AS content_preview,
       'src' || CAST(r.vec_id % 20 AS VARCHAR) || '.example.com' AS source_domain
FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 10""")
def q_search_articles(spark, sf):
    """C4 + C8: semantic search per story centroid (top 10, >= 0.3), hits
    resolved to public article rows in rank order; hits without a stored
    article are dropped."""
    qs = _label_centroids(spark, sf).select(F.col("id").alias("query_id"), F.col("centroid").alias("qvec"))
    hits = VE.knn_search(qs, _t(spark, sf, "embeddings"), k=10, threshold=VEC_THRESHOLD,
                         c_id="vec_id", c_vec="embedding")
    hits = hits.select("query_id", F.col("rank").cast("long").alias("rank"),
                       F.round("score", 4).alias("score"), F.col("vec_id").cast("string").alias("hit_id"))
    d = _t(spark, sf, "documents")
    stored = TB.vector_articles(spark, sf).join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select(
        F.col("vec_id").cast("string").alias("id"), F.substring("text", 1, 60).alias("title"), "url",
        F.col("text").alias("content"), F.lit(None).cast("string").alias("cluster_id"),
        F.lit(None).cast("timestamp").alias("published_at"))
    res = RP.resolve_hits(hits, stored, "hit_id")
    return res.select("query_id", "rank", "score", F.col("hit_id").alias("id"), "title", "content_preview",
                      "source_domain")


@register("envelope_parse", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS "timestamp", 'storyspark' AS source_service, 0 AS retry_count,
       regexp_replace(md5('trace:' || event_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS trace_id,
       1 AS version FROM events""")
def q_envelope_parse(spark, sf):
    """A3: every event written as a JSON envelope, read back, payload typed
    per subject (schema 'k INT' for these events)."""
    from ..sources.envelopes import read_envelopes, write_envelopes
    e = _t(spark, sf, "events")
    env = write_envelopes(e, F.col("event_type"), F.col("props"), F.col("event_id"), F.col("ts"))
    back = read_envelopes(env)
    return back.select(F.col("event_id").cast("long").alias("event_id"), "event_type",
                       F.from_json("payload", "k INT")["k"].alias("k"), "timestamp", "metadata.source_service",
                       "metadata.retry_count", "metadata.trace_id", "metadata.version")


@register("export_topic", f"""
WITH {_STORY_SQL},
ec AS ({_EXPORT_CLUSTERS_SQL})
SELECT cluster_id, topic, label, article_count FROM ec WHERE lower(topic) = lower('technology')""")
def q_export_topic(spark, sf):
    """Cluster export filtered by topic (case-insensitive equality)."""
    _, cl = _story_store(spark, sf)
    return RP.export_clusters(cl, "technology").select("cluster_id", "topic", "label", "article_count")


@register("story_flow")
def q_story_flow(spark, sf):
    """K3: documents -> min content -> SimHash -> vectors -> two-stage dedup
    -> story clustering of the kept articles (the flagship flow)."""
    from .flows import story_flow
    return story_flow(spark, sf)


@register("seen_items", """
WITH d AS (SELECT source AS feed_id, doc_id FROM documents),
s AS (SELECT feed_id, doc_id,
             unnest(generate_series(CAST(greatest(floor((doc_id - 500) / 400.0) + 1, 0) AS BIGINT),
                                    CAST(floor(doc_id / 400.0) AS BIGINT))) AS snapshot_id FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY feed_id, snapshot_id ORDER BY doc_id) - 1 AS pos FROM s),
items AS (SELECT * FROM p WHERE pos < 20),
f AS (SELECT *, row_number() OVER (PARTITION BY feed_id, doc_id ORDER BY snapshot_id, pos) AS rn FROM items)
SELECT feed_id, snapshot_id, CAST(pos AS INTEGER) AS pos,
       'guid:' || feed_id || '-' || CAST(doc_id AS VARCHAR) AS item_key
FROM f WHERE rn = 1""")
def q_seen_items(spark, sf):
    """I4 + A1 + Q17 batch twin: overlapping polls of every feed (window 500
    doc ids, step 400), capped at 20 items per poll before de-duplication;
    an item is emitted at its first poll only."""
    from .feed_fixture import rss_snapshots
    snaps = rss_snapshots(_t(spark, sf, "documents"), window=500, step=400)
    it = FD.feed_items(snaps, "xml", 20)
    new = FD.new_items(it)
    return new.select("feed_id", "snapshot_id", F.col("pos").cast("int").alias("pos"), "item_key")
