"""Versioned tables: upserts (A4 to A6), latest version (E2), first seen
(E3), capped timeline (E4) and changed keys (G2).

All per-key choices are aggregates (max_by / min_by over a struct ordering),
not row_number windows: they combine map-side (as sort aggregates, since the
buffers hold structs), so a hot key never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _arrivals(arrival) -> list[str]:
    return [arrival] if isinstance(arrival, str) else list(arrival)


def latest_version(df: DataFrame, key: str, version: str = "version",
                   arrival="arrival") -> DataFrame:
    """Per key the row with the highest version; equal versions are
    refused, so the first arrival wins ties. ``arrival`` is one numeric
    column or a list of them (compared in order)."""
    cols = [c for c in df.columns]
    best = F.max_by(F.struct(*cols),
                    F.struct(F.col(version), *[-F.col(a) for a in _arrivals(arrival)]))
    return df.groupBy(key).agg(best.alias("_r")).select("_r.*")


def first_seen(df: DataFrame, key: str, arrival="arrival") -> DataFrame:
    """The first row per key by arrival (``dropDuplicates`` may keep any);
    ``arrival`` is one column or a list of them, e.g. time then event id."""
    cols = [c for c in df.columns]
    order = F.struct(*[F.col(a) for a in _arrivals(arrival)])
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select("_r.*")


def upsert_versioned(target: DataFrame, batch: DataFrame, key: str, version: str = "version",
                     arrival="arrival", keep_first: tuple = ("id", "created_at")) -> DataFrame:
    """A4 / A5: apply ``batch`` rows in arrival order to ``target``: insert a
    new key; update an existing key only when the new version is higher.
    ``keep_first`` columns stay as first inserted. Same columns both sides;
    target rows count as earlier than every batch row. ``arrival`` is one
    numeric column or a list of them (compared in order)."""
    arr = _arrivals(arrival)
    cols = [c for c in target.columns if c not in arr]
    ords = [f"_ord{i}" for i in range(len(arr))]
    t = target.select(*cols, *[F.lit(-1.0).alias(o) for o in ords])
    b = batch.select(*cols, *[F.col(a).cast("double").alias(o) for a, o in zip(arr, ords)])
    u = t.unionByName(b)
    keep = [c for c in keep_first if c in cols]
    rest = [c for c in cols if c not in keep and c != key]
    agg = u.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(version), *[-F.col(o) for o in ords])).alias("_w"),
        *([F.min_by(F.struct(*keep), F.struct(*[F.col(o) for o in ords])).alias("_f")] if keep else []))
    return agg.select(key, *[F.col(f"_f.{c}").alias(c) for c in keep],
                      *[F.col(f"_w.{c}").alias(c) for c in rest]).select(*cols)


def upsert_last_write(target: DataFrame, batch: DataFrame, key: str = "url",
                      arrival: str = "arrival",
                      keep_first: tuple = ("id", "created_at", "last_polled_at")) -> DataFrame:
    """Key ``url``; the last write wins (no version guard); ``keep_first``
    columns keep the stored value."""
    cols = [c for c in target.columns if c != arrival]
    t = target.select(*cols, F.lit(-1).cast("long").alias("_ord"))
    b = batch.select(*cols, F.col(arrival).cast("long").alias("_ord"))
    u = t.unionByName(b)
    keep = [c for c in keep_first if c in cols]
    rest = [c for c in cols if c not in keep and c != key]
    agg = u.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col("_ord")).alias("_w"),
        *([F.min_by(F.struct(*keep), F.col("_ord")).alias("_f")] if keep else []))
    return agg.select(key, *[F.col(f"_f.{c}").alias(c) for c in keep],
                      *[F.col(f"_w.{c}").alias(c) for c in rest]).select(*cols)


def capped_timeline(df: DataFrame, key: str, score: str, cap: int = 1000,
                    limit: int | None = None, offset: int = 0) -> DataFrame:
    """One entry per key with its latest score, newest ``cap`` kept,
    then a page. Top-k is TakeOrdered (partial per partition)."""
    best = df.groupBy(key).agg(F.max(score).alias(score))
    top = best.orderBy(F.desc(score), F.asc(key)).limit(cap)
    if limit is not None:
        top = top.orderBy(F.desc(score), F.asc(key)).offset(offset).limit(limit)
    return top


def changed_keys(marks: DataFrame, processed: DataFrame | None, entity: str, n: int,
                 entity_col: str = "entity", key_col: str = "key",
                 order_col: str = "marked_at") -> DataFrame:
    """Distinct keys marked for ``entity``, not yet processed, first
    ``n`` by first mark time (each key is taken once)."""
    m = (marks.where(F.col(entity_col) == entity)
              .groupBy(key_col).agg(F.min(order_col).alias(order_col)))
    if processed is not None:
        m = m.join(processed.select(key_col), key_col, "left_anti")
    return m.orderBy(F.asc(order_col), F.asc(key_col)).limit(n)
