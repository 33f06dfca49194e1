"""Story clustering: K2 (leader clustering), centroid update D2, cluster
stats D3 to D5.

Batch form of the reference's one-article-at-a-time rule:
1. every article is compared with the newest ``max_active`` active centroids
   (C5); at or above the threshold it joins the best one;
2. among the rest, seeds are K1's rule on the cosine >= threshold graph (a
   row opens a cluster unless an earlier seed is similar enough); every other
   row joins its most similar earlier seed;
3. centroids move once per batch: normalize(c * n + sum(v)) from per-
   dimension sums (map-side combined, so a huge cluster never sits in one
   task); counts, versions, labels, sources and activity are aggregates.
With one article per batch this is the reference rule exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import source_domain
from ..functions.vectors import l2_normalize
from ..session import cut_lineage
from .dedup import HEAD_ROWS, dedup_decide, kept_neighbors
from .vectors import assign_to_centroid, key_vectors, known_vectors, pack_blocks

CLUSTER_THRESHOLD = 0.75
MAX_ACTIVE = 100
TOP_SOURCES = 10

_HELD = 4096     # groups whose sums a task holds before it hands them on


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, vector) rows -> sums and counts per group, in bounded memory."""
    held: dict[str, list] = {}

    def out():
        rows = [(g, s.tolist(), n) for g, (s, n) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                                           pa.array([r[2] for r in rows], pa.int64())], ["g", "s", "n"])

    for batch in batches:
        for g, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if v.is_valid:
                x = np.asarray(v.values, dtype=np.float64)
                if g in held:
                    held[g][0] += x
                    held[g][1] += 1
                else:
                    held[g] = [x.copy(), 1]
        if len(held) >= _HELD:
            yield out()
    yield out()


def vector_sums(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Per group: element-wise sum of the vectors (array<double>) and count.
    Each partition adds up its vectors per group first; only those partial sums
    are laid out by dimension and merged."""
    partial = df.select(F.col(group).cast("string").alias("g"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(
        _partial_sums, "g string, s array<double>, n long")
    ex = partial.select("g", "n", F.posexplode("s").alias("i", "x"))
    dims = ex.groupBy("g", "i").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    arr = dims.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("_v"), F.max("n").alias("n"))
    return arr.select(F.col("g").cast(df.schema[group].dataType).alias(group),
                      F.transform("_v", lambda e: e["s"]).alias("vsum"), "n")


def update_centroid(centroid, count, vsum) -> F.Column:
    """D2 (sum form): normalize(c * n + sum(v))."""
    c = F.coalesce(F.col(centroid).cast("array<double>"),
                   F.array_repeat(F.lit(0.0), F.size(vsum)))
    mixed = F.zip_with(c, F.col(vsum), lambda a, b: a * F.coalesce(F.col(count), F.lit(0)) + b)
    return l2_normalize(mixed)


def seed_neighbors(rows: DataFrame, packed: DataFrame, threshold: float, arrival_col: str = "arrival",
                   head_rows: int = HEAD_ROWS) -> DataFrame:
    """Of the neighbours of the vectors of ``rows`` (columns of ``key_vectors``, packed in ``packed``)
    those that are seeds: (vid1, vid2, nvid1, nvid2, score), self pairs included. K1's rule on the
    vectors alone decides alike with these and with all neighbours, as only kept rows count. Where
    pairs are few, all neighbours (see ``dedup.kept_neighbors``)."""
    a = F.col(arrival_col).cast("long")
    keyed = rows.where(F.col("vec_ok") & a.isNotNull()).groupBy("vid1", "vid2").agg(F.min(a).alias("a"))
    base = cut_lineage(keyed.select((F.col("a") * 2).alias("rid"), F.col("a").alias("id"), "a", F.lit(0).cast("long").alias("t"),
                                    F.lit(None).cast("string").alias("uid"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"),
                                    "vid1", "vid2", F.lit(True).alias("can_keep")))
    return kept_neighbors(base, packed, threshold, head_rows, use_url=False, use_simhash=False, window_seconds=None)[0]


def seed_clusters(rows: DataFrame, packed: DataFrame, threshold: float, id_col: str, arrival_col: str = "arrival",
                  time_col: str = "extracted_at", neighbors: DataFrame | None = None) -> DataFrame:
    """``rows`` (columns of ``key_vectors``, packed in ``packed``) with ``cluster_id``, ``is_new_cluster`` and
    ``similarity_score`` by the seed rule. All ``neighbors`` may be given."""
    seeds = dedup_decide(rows, id_col=id_col, arrival_col=arrival_col, time_col=time_col, packed=packed, neighbors=neighbors,
                         cos_threshold=threshold, use_url=False, use_simhash=False, window_seconds=None)
    return seeds.select(
        *rows.columns,
        F.when(F.col("kept"), F.col(id_col)).otherwise(F.col("duplicate_of"))
         .cast("string").alias("cluster_id"),
        F.col("kept").alias("is_new_cluster"),
        F.when(F.col("kept"), F.lit(None).cast("double")).otherwise(F.col("score"))
         .alias("similarity_score"))


def cluster_articles(articles: DataFrame, clusters: DataFrame | None = None, *,
                     id_col: str = "url_hash", arrival_col: str = "arrival",
                     time_col: str = "extracted_at", vec_col: str = "embedding",
                     threshold: float = CLUSTER_THRESHOLD, max_active: int = MAX_ACTIVE,
                     dim: int | None = None) -> DataFrame:
    """K2 assignments: one row per article with ``cluster_id``,
    ``is_new_cluster`` (the article opened it) and ``similarity_score``
    (null for a new cluster). Invalid vectors (missing, wrong size, all zero)
    are quarantined: cluster_id null, ``quarantined`` true.

    The seed graph is exact. K2 is the batch form of the sequential centroid
    rule; with one article per batch it is that rule."""
    valid = F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)
    if dim is not None:
        valid = valid & (F.size(vec_col) == dim)
    arts = articles.withColumn("quarantined", ~F.coalesce(valid, F.lit(False)))
    good = arts.where(~F.col("quarantined"))
    if clusters is not None:
        good = assign_to_centroid(good, clusters, threshold, max_active, vec_col, dim=dim)
    else:
        good = (good.withColumn("match_id", F.lit(None).cast("string"))
                    .withColumn("match_score", F.lit(None).cast("double")))
    matched = good.where(F.col("match_id").isNotNull())
    rest = good.where(F.col("match_id").isNull()).drop("match_id", "match_score")
    rest = key_vectors(rest, vec_col)
    out_new = seed_clusters(rest, pack_blocks(known_vectors(rest, vec_col)), threshold, id_col, arrival_col, time_col).select(
        *articles.columns, F.lit(False).alias("quarantined"), "cluster_id", "is_new_cluster", "similarity_score")
    out_old = matched.select(*articles.columns, "quarantined",
                             F.col("match_id").cast("string").alias("cluster_id"),
                             F.lit(False).alias("is_new_cluster"),
                             F.round("match_score", 6).alias("similarity_score"))
    out_bad = arts.where("quarantined").select(
        *articles.columns, "quarantined", F.lit(None).cast("string").alias("cluster_id"),
        F.lit(False).alias("is_new_cluster"), F.lit(None).cast("double").alias("similarity_score"))
    return out_new.unionByName(out_old).unionByName(out_bad)


def _first_domains(dom: DataFrame, key: str, top_n: int) -> DataFrame:
    """The first ``top_n`` domains per key as an array ``_d``. The rank limit
    runs in each partition before the shuffle, so no list is longer than that."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first_at", "domain"))
    return (dom.withColumn("_rank", rank).where(F.col("_rank") <= top_n)
            .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first_at", "domain"))).alias("_d")))


def cluster_stats(assigned: DataFrame, *, arrival_col: str = "arrival",
                  time_col: str = "extracted_at", title_col: str = "title",
                  url_col: str = "url", top_n: int = TOP_SOURCES) -> DataFrame:
    """D3 to D5 for clusters built in this batch: article_count, version
    (one per member), label (title of the first member), last_activity,
    created_at and top_sources (first ``top_n`` distinct domains by arrival,
    as the reference appends them)."""
    a = assigned.where(F.col("cluster_id").isNotNull())
    per = a.groupBy("cluster_id").agg(
        F.count("*").alias("article_count"),
        F.min_by(F.col(title_col), F.col(arrival_col)).alias("label"),
        F.max(time_col).alias("last_activity"),
        F.min(time_col).alias("created_at"))
    dom = (a.withColumn("domain", source_domain(url_col))
            .groupBy("cluster_id", "domain").agg(F.min(arrival_col).alias("first_at")))
    srcs = _first_domains(dom, "cluster_id", top_n).select(
        "cluster_id", F.transform("_d", lambda e: e["domain"]).alias("top_sources"))
    return (per.join(srcs, "cluster_id")
               .withColumn("version", F.col("article_count").cast("int"))
               .withColumn("status", F.lit("active"))
               .withColumn("decay_score", F.lit(1.0)))


def build_clusters(assigned: DataFrame, vec_col: str = "embedding", **kw) -> DataFrame:
    """Cluster rows (stats + centroid) for clusters opened in this batch."""
    st = cluster_stats(assigned, **kw)
    sums = vector_sums(assigned.where(F.col("cluster_id").isNotNull()), "cluster_id", vec_col)
    cen = sums.select("cluster_id", l2_normalize("vsum").alias("centroid"))
    return st.join(cen, "cluster_id").withColumnRenamed("cluster_id", "id")


def merge_into_clusters(clusters: DataFrame, assigned: DataFrame, vec_col: str = "embedding",
                        time_col: str = "extracted_at", url_col: str = "url",
                        arrival_col: str = "arrival", top_n: int = TOP_SOURCES) -> DataFrame:
    """D2 to D4 for existing clusters: count and version grow by the joins,
    centroid = normalize(c*n + sum(v)), activity moves, new domains are
    appended while fewer than ``top_n`` are held."""
    joins = assigned.where(F.col("cluster_id").isNotNull() & ~F.col("is_new_cluster"))
    sums = vector_sums(joins, "cluster_id", vec_col).withColumnRenamed("cluster_id", "id")
    act = joins.groupBy(F.col("cluster_id").alias("id")).agg(F.max(time_col).alias("_last"))
    dom = (joins.withColumn("domain", source_domain(url_col))
                .groupBy(F.col("cluster_id").alias("id"), "domain")
                .agg(F.min(arrival_col).alias("first_at")))
    newdom = _first_domains(dom, "id", top_n)
    c = (clusters.join(sums, "id", "left").join(act, "id", "left").join(newdom, "id", "left")
                 .withColumn("n", F.coalesce("n", F.lit(0))))
    merged_src = F.slice(F.array_distinct(F.concat(
        F.coalesce("top_sources", F.array().cast("array<string>")),
        F.coalesce(F.transform("_d", lambda e: e["domain"]), F.array().cast("array<string>")))), 1, top_n)
    return (c.withColumn("centroid", F.when(F.col("n") > 0,
                                            update_centroid("centroid", "article_count", "vsum"))
                         .otherwise(F.col("centroid").cast("array<double>")))
             .withColumn("article_count", (F.col("article_count") + F.col("n")).cast("long"))
             .withColumn("version", (F.col("version") + F.col("n")).cast("int"))
             .withColumn("last_activity", F.greatest("last_activity", "_last"))
             .withColumn("top_sources", merged_src)
             .drop("vsum", "n", "_last", "_d"))
