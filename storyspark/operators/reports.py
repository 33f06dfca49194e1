"""Reports and reads over the article / cluster tables: exports (A7 to A9),
counts (D6 to D11), paging (F1 to F6), cluster detail (C7), search hits (C8),
timeline vectors (C10) and the centroid table (C11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_preview, decay_score, iso_time, round4
from ..functions.topics import UNCLUSTERED_TOPIC, classify_topic
from ..functions.urls import source_domain
from ..session import cut_lineage


def _topic_ok(topic_col, topic_filter):
    if not topic_filter:
        return F.lit(True)
    return F.lower(topic_col) == F.lit(topic_filter.lower())


def export_clusters(clusters: DataFrame, topic_filter: str | None = None) -> DataFrame:
    """A7 + A10: one flat row per cluster, newest activity first; topic from
    the label; sources pipe-joined; decay rounded to 4; ISO times."""
    df = clusters.select(
        F.col("id").cast("string").alias("cluster_id"),
        classify_topic(F.coalesce("label", F.lit(""))).alias("topic"),
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("article_count", F.lit(0)).cast("long").alias("article_count"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce(F.array_join("top_sources", "|"), F.lit("")).alias("top_sources"),
        F.coalesce(iso_time("created_at"), F.lit("")).alias("created_at"),
        F.coalesce(iso_time("last_activity"), F.lit("")).alias("last_activity"),
        round4(F.coalesce("decay_score", F.lit(0.0))).alias("decay_score"),
        F.col("last_activity").alias("_la"))
    return (df.where(_topic_ok(F.col("topic"), topic_filter))
              .orderBy(F.desc_nulls_last("_la"), "cluster_id").drop("_la"))


def cluster_topics(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.col("id").cast("string").alias("cluster_id"),
                           F.coalesce("label", F.lit("")).alias("cluster_label"),
                           classify_topic(F.coalesce("label", F.lit(""))).alias("topic"))


def export_articles(articles: DataFrame, clusters: DataFrame,
                    topic_filter: str | None = None) -> DataFrame:
    """A8 + C6: articles with cluster label and topic (``Unclustered`` when
    the cluster is unknown), newest extraction first. The cluster side is a
    plain join: Catalyst/AQE broadcast it only when its measured size allows."""
    ct = cluster_topics(clusters)
    a = articles.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    j = a.join(ct, "cluster_id", "left")
    df = j.select(
        F.col("id").cast("string").alias("article_id"),
        F.coalesce("topic", F.lit(UNCLUSTERED_TOPIC)).alias("topic"),
        F.coalesce("cluster_label", F.lit("")).alias("cluster_label"),
        F.coalesce("cluster_id", F.lit("")).alias("cluster_id"),
        F.coalesce("title", F.lit("")).alias("article_title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("content_length", F.lit(0)).cast("long").alias("content_length"),
        round4(F.coalesce("quality_score", F.lit(0.0))).alias("quality_score"),
        F.coalesce(iso_time("extracted_at"), F.lit("")).alias("extracted_at"),
        F.coalesce(iso_time("published_at"), F.lit("")).alias("published_at"),
        F.col("extracted_at").alias("_ex"))
    return (df.where(_topic_ok(F.col("topic"), topic_filter))
              .orderBy(F.desc_nulls_last("_ex"), "article_id").drop("_ex"))


def export_nested(articles: DataFrame, clusters: DataFrame,
                  topic_filter: str | None = None) -> DataFrame:
    """A9 + D9: the topic -> cluster -> article document, nested by struct:
    one row per article with its ``cluster`` struct (clusters without
    articles keep one row). No row holds a whole topic or cluster, so a hot
    topic never sits in one task; ``write_export`` lays it out per topic."""
    flat = export_nested_flat(articles, clusters, topic_filter)
    return flat.select(
        "topic",
        F.struct("cluster_id", "label", "article_count", "status",
                 F.split("top_sources", r"\|").alias("top_sources"), "created_at",
                 "last_activity").alias("cluster"),
        F.when(F.col("article_id").isNotNull(),
               F.struct("article_id", "title", "url", "language", "content_length", "quality_score",
                        "extracted_at", "published_at")).alias("article"))


def write_export(articles: DataFrame, clusters: DataFrame, path: str,
                 topic_filter: str | None = None) -> None:
    """A7 to A9 sinks: CSV exports with a header, the nested document as JSON
    lines partitioned by topic, and its totals as one JSON line."""
    export_clusters(clusters, topic_filter).write.mode("overwrite").option("header", True).csv(
        f"{path}/clusters_export")
    export_articles(articles, clusters, topic_filter).write.mode("overwrite").option("header", True).csv(
        f"{path}/articles_export")
    export_nested(articles, clusters, topic_filter).write.mode("overwrite").partitionBy("topic").json(
        f"{path}/nested")
    export_totals(articles, clusters, topic_filter).write.mode("overwrite").json(f"{path}/totals")


def export_nested_flat(articles: DataFrame, clusters: DataFrame,
                       topic_filter: str | None = None) -> DataFrame:
    """A9 flattened: one row per (topic, cluster, article); clusters without
    articles keep one row with null article fields."""
    c = export_clusters(clusters, topic_filter)
    a = articles.select(F.col("cluster_id").cast("string").alias("cluster_id"),
                        F.col("id").cast("string").alias("article_id"),
                        F.coalesce("title", F.lit("")).alias("title"),
                        F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("language", F.lit("en")).alias("language"),
                        F.coalesce("content_length", F.lit(0)).cast("long").alias("content_length"),
                        round4(F.coalesce("quality_score", F.lit(0.0))).alias("quality_score"),
                        F.coalesce(iso_time("extracted_at"), F.lit("")).alias("extracted_at"),
                        F.coalesce(iso_time("published_at"), F.lit("")).alias("published_at"))
    return c.join(a, "cluster_id", "left")


def export_totals(articles: DataFrame, clusters: DataFrame,
                  topic_filter: str | None = None) -> DataFrame:
    """Topic count, cluster count and article count after the filter
    (one aggregation over clusters and their matched articles)."""
    c = export_clusters(clusters, topic_filter).select("cluster_id", "topic")
    a = (articles.select(F.col("cluster_id").cast("string").alias("cluster_id"))
                 .join(c.select("cluster_id"), "cluster_id", "left_semi"))
    tagged = c.select("topic", F.lit(1).alias("_c"), F.lit(0).alias("_a")).unionByName(
        a.select(F.lit(None).cast("string").alias("topic"), F.lit(0).alias("_c"), F.lit(1).alias("_a")))
    return tagged.groupBy().agg(F.countDistinct("topic").alias("topic_count"),
                                F.sum("_c").cast("long").alias("total_clusters"),
                                F.sum("_a").cast("long").alias("total_articles"))


def topic_summary(clusters: DataFrame) -> DataFrame:
    """Clusters per topic, largest first."""
    return (clusters.select(classify_topic(F.coalesce("label", F.lit(""))).alias("topic"))
                    .groupBy("topic").agg(F.count("*").alias("clusters"))
                    .orderBy(F.desc("clusters"), "topic"))


def counts(articles: DataFrame, clusters: DataFrame, feeds: DataFrame) -> DataFrame:
    """Articles, clusters, active clusters, feeds (one aggregation)."""
    z = F.lit(0)
    tagged = (articles.select(F.lit(1).alias("_a"), z.alias("_c"), z.alias("_ac"), z.alias("_f"))
              .unionByName(clusters.select(z.alias("_a"), F.lit(1).alias("_c"),
                                           F.when(F.col("status") == "active", 1).otherwise(0).alias("_ac"),
                                           z.alias("_f")))
              .unionByName(feeds.select(z.alias("_a"), z.alias("_c"), z.alias("_ac"),
                                        F.lit(1).alias("_f"))))
    return tagged.groupBy().agg(*[F.sum(c).cast("long").alias(n) for c, n in
                                  [("_a", "articles"), ("_c", "clusters"),
                                   ("_ac", "active_clusters"), ("_f", "feeds")]])


def metric_totals(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Named counters."""
    return df.groupBy(name).agg(F.sum(value).alias("total"))


RANK_ROWS = 100_000      # values of a band that are sorted at once
_CUTS = 64               # cuts of a band that is narrowed


def exact_quantiles(df: DataFrame, col: str, qs: list[float], group: str | None = None,
                    rank_rows: int = RANK_ROWS) -> DataFrame:
    """D11 percentile rule: sorted[min(int(n*q), n-1)] (0-based), exactly.

    All percentiles go together. A band of values that holds the wanted rank
    starts as the whole group; while it holds more than ``rank_rows`` values it is
    cut at approximate percentiles, counted between the cuts, and replaced by the
    part with the rank (or answered, when that is one repeated value). So no task
    ever sorts more than ``rank_rows`` values, however large a group is."""
    key = group or "_g"
    v = df.select((F.col(group) if group else F.lit(0)).alias("_k"), F.col(col).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    n = v.groupBy("_k").agg(F.count("*").alias("n"))
    # one row per group and percentile: the rank inside the open band (lo, hi), and the band's size
    open_ = cut_lineage(n.select("_k", "n", F.explode(wanted).alias("w")).select(
        F.col("_k").alias("k"), F.col("w.i").alias("i"), F.least(F.floor(F.col("n") * F.col("w.q")), F.col("n") - 1).cast("long").alias("rank"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "n"))

    def inside(bands, *more):
        # without groups there are len(qs) bands at most
        side = bands if group else F.broadcast(bands)
        within = (F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi")))
        return v.join(side, F.col("_k").eqNullSafe(F.col("k")) & within).select("k", "i", "rank", "n", "_v", *more)

    found = None
    while True:
        sorted_ = (inside(open_.where(F.col("n") <= rank_rows)).groupBy("k", "i")
                   .agg(F.get(F.sort_array(F.collect_list("_v")), F.first("rank").cast("int")).alias("value")))
        large = cut_lineage(open_.where(F.col("n") > rank_rows))
        answered = sorted_
        narrowed = None
        if not large.isEmpty():
            grid = [i / _CUTS for i in range(_CUTS + 1)]
            cuts = inside(large).groupBy("k", "i").agg(
                F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(g) for g in grid]), 10 * _CUTS)).alias("cuts"))
            held = inside(large.join(cuts.withColumnsRenamed({"k": "ck", "i": "ci"}),
                                     F.col("k").eqNullSafe(F.col("ck")) & (F.col("i") == F.col("ci"))), "cuts")
            below = F.size(F.filter("cuts", lambda c: c < F.col("_v")))
            # cell 2b + 1: equal to cut b; cell 2b: between cut b - 1 and cut b
            cell = F.when(F.array_contains("cuts", F.col("_v")), 2 * below + 1).otherwise(2 * below)
            counts = held.select("k", "i", "rank", "cuts", cell.alias("cell")).groupBy("k", "i", "cell").agg(
                F.count("*").alias("c"), F.first("rank").alias("rank"), F.first("cuts").alias("cuts"))
            w = Window.partitionBy("k", "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)   # at most 131 cells
            hit = cut_lineage(counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
                              .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))))
            place = F.floor(F.col("cell") / 2).cast("int")
            answered = answered.unionByName(hit.where("cell % 2 = 1").select("k", "i", F.get("cuts", place).alias("value")))
            bounds = large.select(F.col("k").alias("bk"), F.col("i").alias("bi"), "lo", "hi")
            narrowed = cut_lineage(hit.where("cell % 2 = 0").join(
                bounds, F.col("k").eqNullSafe(F.col("bk")) & (F.col("i") == F.col("bi"))).select(
                "k", "i", (F.col("rank") - F.col("before")).alias("rank"),
                F.coalesce(F.when(place > 0, F.get("cuts", place - 1)), "lo").alias("lo"),
                F.coalesce(F.get("cuts", place), "hi").alias("hi"), F.col("c").alias("n")))
        found = answered if found is None else found.unionByName(answered)
        if narrowed is None or narrowed.isEmpty():
            break
        found = cut_lineage(found)
        open_ = narrowed
    out = found.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"p{int(round(q * 100))}")
                                   for i, q in enumerate(qs)]).withColumnRenamed("k", key)
    return out if group else out.drop("_g")


def latency_summary(df: DataFrame, col: str = "latency_ms", group: str | None = None,
                    elapsed_seconds: float | None = None) -> DataFrame:
    """N, mean, p50, p90, p99 (reference index rule) and rate."""
    keys = [group] if group else ["_g"]
    src = df if group else df.withColumn("_g", F.lit(0))
    base = src.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"))
    q = exact_quantiles(src, col, [0.5, 0.9, 0.99], group or "_g")
    out = base.join(q, keys, "left")
    if not group:
        out = out.drop("_g")
    if elapsed_seconds:
        out = out.withColumn("rate", F.col("n") / F.lit(float(elapsed_seconds)))
    return out


KLL_K = 200              # size of a quantile sketch: about 1.7 % of rank at 99 % confidence


def latency_sketches(df: DataFrame, col: str, keys: list[str], k: int = KLL_K) -> DataFrame:
    """D11 mergeable: ``(*keys, n, total, sketch)``, a KLL sketch of a few kB per group. Tables of
    several days or batches are merged by :func:`merged_latency` without the rows."""
    value = F.col(col).cast("double")
    return df.where(value.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_latency(sketches: DataFrame, keys: list[str], qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``(*keys, n, mean, p50, p90, p99)`` of merged sketches; percentiles to the sketch's rank error."""
    out = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"),
                                      F.kll_merge_agg_double("sketch").alias("sketch"))
    return out.select(*keys, "n", "mean", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in qs])


def recent_articles(articles: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """published desc (nulls first, as Postgres DESC), created desc, id."""
    return (articles.orderBy(F.desc_nulls_first("published_at"), F.desc("created_at"), F.asc("id"))
                    .offset(offset).limit(limit))


def articles_of_cluster(articles: DataFrame, cluster_id, limit: int = 50,
                        offset: int = 0) -> DataFrame:
    """one cluster's articles, published desc nulls last, id."""
    return (articles.where(F.col("cluster_id") == F.lit(cluster_id))
                    .orderBy(F.desc_nulls_last("published_at"), F.asc("id"))
                    .offset(offset).limit(limit))


def all_feeds(feeds: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """feeds by created desc, id."""
    return feeds.orderBy(F.desc("created_at"), F.asc("id")).offset(offset).limit(limit)


def page_meta(df: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """page, per_page (1..200), total, total_pages."""
    if not 1 <= per_page <= 200 or page < 1:
        raise ValueError("page >= 1 and 1 <= per_page <= 200")
    return (df.groupBy().agg(F.count("*").alias("total"))
              .select(F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), "total",
                      F.ceil(F.col("total") / F.lit(per_page)).cast("long").alias("total_pages")))


def cluster_detail(clusters: DataFrame, articles: DataFrame, per_cluster: int = 100) -> DataFrame:
    """Each cluster with its newest ``per_cluster`` articles nested (the
    nested list is bounded by ``per_cluster``)."""
    rows = cluster_detail_rows(clusters, articles, per_cluster)
    return rows.groupBy("cluster_id", "label", "article_count").agg(
        F.sort_array(F.collect_list(F.struct("rank", "article_id", "title", "published_at")))
        .alias("articles"))


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """Top ``k`` rows per group, with their ``rank``. Spark applies the rank
    limit in each partition before the shuffle (WindowGroupLimit), so of a hot
    group at most ``k`` rows per map task meet."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cluster_detail_rows(clusters: DataFrame, articles: DataFrame, per_cluster: int = 100) -> DataFrame:
    """C7 flat: each cluster with its newest ``per_cluster`` articles
    (published desc nulls last, id)."""
    a = articles.select(F.col("cluster_id").cast("string").alias("cluster_id"),
                        F.col("id").cast("string").alias("article_id"), "title", "published_at")
    a = top_k_per_group(a, "cluster_id", [F.desc_nulls_last("published_at"), F.asc("article_id")],
                        per_cluster)
    c = clusters.select(F.col("id").cast("string").alias("cluster_id"), "label", "article_count")
    return c.join(a, "cluster_id", "left")


def resolve_hits(hits: DataFrame, articles: DataFrame, hit_id: str = "id") -> DataFrame:
    """Search hits to public rows, hit order kept, missing ids dropped."""
    pub = articles.select("id", "title", "url", F.col("cluster_id").cast("string").alias("cluster_id"),
                          "published_at", content_preview("content").alias("content_preview"),
                          source_domain("url").alias("source_domain"))
    return hits.join(pub, hits[hit_id] == pub["id"]).drop(pub["id"])


def timeline_vectors(timeline: DataFrame, vectors: DataFrame, now, limit: int = 100,
                     key: str = "key", score: str = "score") -> DataFrame:
    """Newest ``limit`` timeline keys joined to cached vectors still
    alive at ``now`` (strict), missing omitted."""
    top = timeline.orderBy(F.desc(score), F.asc(key)).limit(limit)
    live = vectors.where(F.col("expire_at") > F.lit(now))
    return top.join(live, key)


def centroid_table(clusters: DataFrame, dim: int) -> DataFrame:
    """C11: active clusters with a full-size centroid, and their count."""
    return (clusters.where((F.col("status") == "active") & F.col("centroid").isNotNull()
                           & (F.size("centroid") == dim))
                    .select("id", "centroid", "article_count"))


def decay(clusters: DataFrame, now, half_life_hours: float = 6.0,
          decayed_below: float = 0.05) -> DataFrame:
    """H22 + I12: rescore by age since last activity; 'decayed' below the
    limit; lifetime hours since creation."""
    age_h = (F.unix_micros(F.lit(now).cast("timestamp"))
             - F.unix_micros(F.col("last_activity").cast("timestamp"))) / F.lit(3.6e9)
    score = decay_score(age_h, half_life_hours)
    life_h = (F.unix_micros(F.col("last_activity").cast("timestamp"))
              - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(3.6e9)
    return (clusters.withColumn("decay_score", score)
                    .withColumn("status", F.when(F.col("decay_score") < decayed_below, F.lit("decayed"))
                                .otherwise(F.col("status")))
                    .withColumn("lifetime_hours", life_h))

