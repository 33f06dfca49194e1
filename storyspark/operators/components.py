"""Connected components of a link table as DataFrame rounds.

Large-star / small-star (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): each round points every vertex at the smallest vertex seen
near it, in O(log^2 n) rounds. Only links are moved, never documents. A round
is two joins on the vertex; minima combine before the shuffle and AQE splits a
hot vertex, so no task holds the neighbours of one vertex. Each round is cut
with a reliable checkpoint, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``links(u, v)``, undirected, long vertices -> ``(u, root)`` for every
    vertex that is not the smallest of its component. Self-links and repeated
    links are ignored; an empty table gives an empty table."""
    current = cut_lineage(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        # links, then an order-free digest of them: unchanged means every
        # component is one star around its smallest vertex
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return current.select("u", F.col("v").alias("root"))
        seen = state
        current = cut_lineage(_small_star(_large_star(current)))
