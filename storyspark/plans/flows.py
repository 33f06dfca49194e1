"""K3: the composite flow, extract -> dedup -> cluster -> board, as one
Spark job graph (each hop a DataFrame stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as CL
from ..operators import dedup as DD
from ..operators import filters as FL
from ..operators import vectors as VE
from ..session import cut_lineage, ensure_checkpoint_dir, idle_cores, ship_package
from ..sources import tables as TB


def prepared(articles: DataFrame, embed: bool = True, partitions: int | None = None) -> DataFrame:
    """B1 -> D1 -> J1, checkpointed, without the texts. Embeddings are computed for
    every row that passed the content filter (the vector stage needs them for
    kept rows); vectors and fingerprints may be supplied, by rows that passed it. ``partitions`` spreads
    a small single-split input first."""
    a = articles
    if "sim_hi" not in a.columns:
        a = DD.with_simhash(FL.min_content(a, "content", 50), partitions=partitions)
    if embed and "embedding" not in a.columns:
        a = VE.embed(a, "content", "embedding")
    return cut_lineage(VE.key_vectors(a.drop("content", "text"), "embedding") if embed else a.drop("content", "text"))


def dedup_stage(articles: DataFrame, hamming_limit: int = 3, cos_threshold: float = 0.92,
                embed: bool = True, partitions: int | None = None) -> DataFrame:
    """B1 -> D1 -> J1 -> K1, without the texts (see ``prepared``)."""
    a = prepared(articles, embed, partitions)
    return DD.dedup_decide(a, id_col="url_hash", vector_col="embedding" if embed else None,
                           hamming_limit=hamming_limit, cos_threshold=cos_threshold)


def story_flow(spark: SparkSession, sf_dir: str, cluster_threshold: float = 0.75,
               articles: DataFrame | None = None, cos_threshold: float = 0.92) -> DataFrame:
    """Documents to decisions and story clusters: one row per document with
    kept / stage / duplicate_of and, for kept ones, cluster_id. ``articles``
    may be given (e.g. with an ``embedding`` column already supplied)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    arts = articles if articles is not None else TB.articles(spark, sf_dir)
    # articles that are given keep their partitions
    partitions = idle_cores(TB.read_table(spark, sf_dir, "documents")) if articles is None else None
    a = prepared(arts, partitions=partitions)
    # the vectors are packed once for both stages, and compared once if they have few neighbours; no other step moves them
    packed = VE.pack_blocks(VE.known_vectors(a, "embedding"))
    a = a.drop("embedding")
    near = DD.listed_neighbors(packed, min(cos_threshold, cluster_threshold))
    near = None if near is None else cut_lineage(near)
    within = lambda least: None if near is None else near.where(F.col("score") >= least)
    dec = cut_lineage(DD.dedup_decide(a, id_col="url_hash", cos_threshold=cos_threshold, packed=packed, neighbors=within(cos_threshold)))
    unique = dec.where("kept").select("url_hash", "arrival", "extracted_at", "vid1", "vid2", "vec_ok")
    asg = CL.seed_clusters(unique, packed, cluster_threshold, id_col="url_hash", neighbors=within(cluster_threshold))
    # a kept row is known by its arrival: its url may repeat among dropped rows
    return (dec.select("doc_id", "arrival", "url_hash", "kept", "stage", "duplicate_of", "distance", "score")
               .join(asg.select("arrival", "cluster_id", "is_new_cluster"), "arrival", "left").drop("arrival"))
