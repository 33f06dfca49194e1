"""D2 in arrival order: the exact centroid sequence of the one-at-a-time rule.

An article that joins a cluster of n articles moves its centroid to
normalize((c n + v) / (n + 1)). Normalising at every step makes the result depend on the
order, so the fold cannot be summed in parts. Members are laid out by a range
shuffle on (cluster, arrival); each range partition holds stretches of the order, a
cluster that fits in one is folded at once, and one that spans several is folded stretch after
stretch with a carried (centroid, count). A task sees one partition at most, never
a whole large cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK_ROWS = 20_000      # members per range partition, on average


def fold_in_order(centroid: np.ndarray | None, count: int, vectors: list[np.ndarray]) -> tuple[np.ndarray | None, int]:
    """The rule itself, one vector after the other."""
    for v in vectors:
        v = np.asarray(v, np.float64)
        moved = v if centroid is None else (centroid * count + v) / (count + 1)
        norm = np.linalg.norm(moved)
        centroid, count = (moved / norm if norm > 0 else moved), count + 1
    return centroid, count


_STATE = pa.schema([("cluster_id", pa.string()), ("centroid", pa.list_(pa.float64())), ("article_count", pa.int64())])
_DDL = "cluster_id string, centroid array<double>, article_count long"


def _fold(members: pa.Table, carried: pa.Table) -> pa.Table:
    if not len(members):
        return carried.select(_STATE.names).cast(_STATE)
    members = members.sort_by([("arrival", "ascending"), ("id", "ascending")])
    start, count = (None, 0)
    if len(carried):
        start, count = carried.column("centroid")[0].as_py(), carried.column("article_count")[0].as_py()
    c, n = fold_in_order(None if start is None else np.asarray(start), count, members.column("v").to_pylist())
    return pa.Table.from_arrays([pa.array([members.column("cluster_id")[0].as_py()]), pa.array([c.tolist()], pa.list_(pa.float64())),
                                 pa.array([n], pa.int64())], schema=_STATE)


def ordered_centroids(assigned: DataFrame, clusters: DataFrame | None = None, vec_col: str = "embedding", id_col: str = "url_hash",
                      arrival_col: str = "arrival", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(cluster_id, centroid, article_count)`` after the articles of ``assigned`` (with
    ``cluster_id``) joined in order of arrival, then id. ``clusters`` (id, centroid, article_count) are
    the clusters before; without one a cluster starts with its first article. Rows without a
    cluster or vector are left out; clusters that nothing joins stay as they are."""
    rows = assigned.where(F.col("cluster_id").isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col("cluster_id").cast("string").alias("cluster_id"), F.col(arrival_col).alias("arrival"), F.col(id_col).alias("id"),
        F.col(vec_col).cast("array<double>").alias("v"))
    parts = max(1, -(-rows.count() // chunk_rows))
    ranged = cut_lineage(rows.repartitionByRange(parts, "cluster_id", "arrival", "id").withColumn("part", F.spark_partition_id()))
    # the stretches of a cluster in order: one row per (cluster, partition)
    turn = W.partitionBy("cluster_id").orderBy("part")
    stretches = ranged.select("cluster_id", "part").distinct().withColumn("turn", F.row_number().over(turn))
    dealt = cut_lineage(ranged.join(stretches, ["cluster_id", "part"]).drop("part"))
    state = None if clusters is None else clusters.select(
        F.col("id").cast("string").alias("cluster_id"), F.col("centroid").cast("array<double>").alias("centroid"),
        F.col("article_count").cast("long").alias("article_count"))
    if state is None:
        state = assigned.sparkSession.createDataFrame([], _DDL)
    last = dealt.agg(F.max("turn")).first()[0] or 0
    for k in range(1, last + 1):
        now = dealt.where(F.col("turn") == k)
        state = cut_lineage(now.groupBy("cluster_id").cogroup(state.groupBy("cluster_id")).applyInArrow(_fold, _DDL))
    return state
