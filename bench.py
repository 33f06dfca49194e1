"""Headline timings at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

The reference's published number is fingerprint + dedup decision +
clustering with vectors supplied (articles per second, one core). Here:
``dedup_cluster`` = B1 -> D1 SimHash -> J1 vectors -> K1 (both stages) ->
K2 clustering of the kept articles over every document; the other entries
time the stages and a few reports. Each query is fully executed with the
no-op sink (nothing is collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from storyspark.plans import flows  # noqa: E402
from storyspark.plans.registry import QUERIES  # noqa: E402
from storyspark.session import get_spark  # noqa: E402
from storyspark.sources import tables as TB  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
STAGE_QUERIES = ["simhash", "dedup_decide", "knn_search", "assign_centroid", "poll_state",
                 "latency_summary", "url_hash", "topic", "upsert_versioned", "feed_items",
                 "vector_pairs", "vector_pairs_lsh", "knn_indexed", "dedup_vectors", "cluster_articles"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = get_spark(f"local[{CPUS}]", app="storyspark-bench", shuffle_partitions=max(8, 2 * CPUS))
    n_docs = TB.read_table(spark, SF_DIR, "documents").count()
    times: dict[str, float] = {}
    t0 = time.time()
    run(flows.story_flow(spark, SF_DIR))
    times["dedup_cluster"] = round(time.time() - t0, 3)
    # the reference's comparison: fingerprint + dedup + clustering with the
    # vectors supplied (embeddings computed once and cut with a checkpoint)
    from storyspark.operators import vectors as VE
    from storyspark.session import cut_lineage, idle_cores
    t = time.time()
    spread_over = idle_cores(TB.read_table(spark, SF_DIR, "documents"))
    with_vec = cut_lineage(VE.embed(TB.articles(spark, SF_DIR), "content", "embedding", partitions=spread_over))
    times["embed"] = round(time.time() - t, 3)
    t = time.time()
    run(flows.story_flow(spark, SF_DIR, articles=with_vec))
    times["dedup_cluster_vectors_given"] = round(time.time() - t, 3)
    # the reference's workload is almost all duplicates: the same number of
    # articles, each with the text and vector of one of the first 100
    heavy = with_vec.drop("content", "embedding").withColumn("_c", F.col("doc_id") % 100).join(
        with_vec.where("doc_id < 100").select(F.col("doc_id").alias("_c"), "content", "embedding"), "_c").drop("_c")
    heavy = cut_lineage(heavy)
    t = time.time()
    run(flows.story_flow(spark, SF_DIR, articles=heavy))
    times["dedup_cluster_duplicate_heavy"] = round(time.time() - t, 3)
    for name in STAGE_QUERIES:
        t = time.time()
        run(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    out = {"metric": "dedup_cluster_wall", "value": times["dedup_cluster"], "unit": "sec",
           "queries": times, "sf": sf, "cores": CPUS, "documents": n_docs,
           "articles_per_sec": round(n_docs / times["dedup_cluster"], 1),
           "articles_per_sec_duplicate_heavy": round(n_docs / times["dedup_cluster_duplicate_heavy"], 1),
           "articles_per_sec_vectors_given": round(n_docs / times["dedup_cluster_vectors_given"], 1)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
