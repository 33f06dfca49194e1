"""Skew-safe as-of lookup: for each left row, the latest right row with the
same key and a strictly smaller order value.

A window partitioned by key alone would put a hot key (a third of the data)
into one task. Here the window is partitioned by (key, order bucket), so a task
holds at most one bucket of one key; a small per-bucket summary carries the
latest right row across buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], order: str,
                value_cols: list[str], out: str = "match",
                bucket_size: int = 1 << 20, tie: str | None = None) -> DataFrame:
    """Adds struct ``out`` = (``order``, ``tie``, *value_cols) of the latest
    right row with equal ``keys`` and a smaller (order, tie) (null when none).
    ``order`` must be a numeric column present on both sides; ``tie``, if given,
    orders rows of one ``order`` value."""
    ties = [tie] if tie else []
    payload = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in ties + value_cols])
    lq = left.withColumn("_side", F.lit(0)).withColumn("_bk", F.floor(F.col(order) / bucket_size))
    rs = (right.select(*keys, order, *ties, payload.alias("_p")).withColumn("_side", F.lit(1))
               .withColumn("_bk", F.floor(F.col(order) / bucket_size)))
    u = lq.unionByName(rs, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, "_bk").orderBy(order, *ties, "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (u.withColumn("_in", F.last(F.when(F.col("_side") == 1, F.col("_p")), ignorenulls=True).over(w))
            .where(F.col("_side") == 0))
    summ = rs.groupBy(*keys, "_bk").agg(F.max("_p").alias("_b"))
    qk = lq.select(*keys, "_bk").distinct()
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (qk.join(summ, keys + ["_bk"], "full_outer")
               .withColumn("_c", F.last("_b", ignorenulls=True).over(wb))
               .select(*keys, "_bk", "_c"))
    res = inb.join(carry, keys + ["_bk"], "left")
    return (res.withColumn(out, F.coalesce("_in", "_c"))
               .drop("_in", "_c", "_side", "_bk", "_p"))
