"""Keyed stream state with strict expiry (I4, I5, I6) on Spark's own state store.

Every key keeps its entries with the time at which they die; an entry that is hit is
renewed, an entry at exactly its time to live is dead (``expire_at > now``), and a timer
removes what has died, so the state holds live entries only. Times are event
times: the answer does not depend on when a batch runs, and a replayed batch finds the state
as it was. Sessions need the RocksDB state store (:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.simhash import disjoint_bands, hamming
from ..functions.vectors import l2_norm
from ..operators.lsh import plan_bands, signatures

HOUR_MS = 3_600_000
SIMHASH_HOURS, VECTOR_HOURS, SEEN_DAYS = 72, 24, 7


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SeenProcessor(StatefulProcessor):
    """I4: per key the time its entry dies. A row is emitted if no live entry is met;
    every row renews the entry."""

    def __init__(self, columns: list[str], ttl_ms: int):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", T.StructType([T.StructField("expire_at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("at_ms", kind="stable")
        old = self.expiry.get()
        dies = old[0] if old is not None else None
        times = batch["at_ms"].to_numpy()
        # a row is new if the one before it, or the entry, is dead at its time
        before = np.concatenate([[-np.inf if dies is None else dies], np.maximum.accumulate(times[:-1]) + self.ttl_ms])
        if dies is not None:
            before = np.maximum(before, dies)
        fresh = before <= times
        dies = int(max(times.max() + self.ttl_ms, dies or 0))
        self.expiry.update((dies,))
        if old is not None:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(dies)
        yield batch.loc[fresh, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expiry.clear()
        yield from ()

    def close(self) -> None:
        pass


def _event_ms(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return (df.withColumn("at_time", F.col(ts).cast("timestamp")).withWatermark("at_time", watermark)
            .withColumn("at_ms", F.unix_millis("at_time")))


def seen_items(items: DataFrame, key: str = "item_key", ts: str = "polled_at", ttl_ms: int = SEEN_DAYS * 24 * HOUR_MS,
               watermark: str = "1 hour") -> DataFrame:
    """I4 as a streaming plan: the rows of ``items`` whose key had no live entry.
    Rows without a key are dropped; rows of one time and key are taken in the order read."""
    rows = _event_ms(items.where(F.col(key).isNotNull()), ts, watermark)
    return (rows.groupBy(key).transformWithStateInPandas(
        SeenProcessor(items.columns, ttl_ms), outputStructType=items.schema, outputMode="Append", timeMode="EventTime"))


_ENTRY = T.StructType([T.StructField("expire_at", T.LongType()), T.StructField("owner", T.StringType())])
_PAYLOAD = T.StructType([T.StructField("payload", T.BinaryType())])


class NeighborProcessor(StatefulProcessor):
    """Per bucket key the live entries, one per distinct payload, with the latest
    owner. A row meets the live entries within ``limit`` and renews or adds its own."""

    def __init__(self, kind: str, limit: float, ttl_ms: int):
        self.kind, self.limit, self.ttl_ms = kind, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", _PAYLOAD, _ENTRY)

    def _scores(self, one: bytes, others: list[bytes]) -> np.ndarray:
        if self.kind == "hamming":
            x = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1) ^ np.frombuffer(one, np.uint8)
            return np.unpackbits(x, axis=1).sum(axis=1).astype(float)
        v = np.frombuffer(one, np.float32).astype(np.float64)
        m = np.frombuffer(b"".join(others), np.float32).reshape(len(others), -1).astype(np.float64)
        return np.minimum(m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v)), 1.0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "arrival"], kind="stable")
        live = {bytes(k[0]): v for k, v in self.entries.iterator()}
        out, changed = [], set()
        for row in batch.itertuples(index=False):
            now, own = int(row.at_ms), bytes(row.payload)
            held = [p for p, (dies, _) in live.items() if dies > now and len(p) == len(own)]
            if held:
                score = self._scores(own, held)
                ok = score <= self.limit if self.kind == "hamming" else score >= self.limit
                out += [(row.id, live[held[i]][1], float(score[i])) for i in np.flatnonzero(ok)]
            live[own] = (max(now + self.ttl_ms, live[own][0] if own in live else 0), row.id)
            changed.add(own)
        for p in changed:
            self.entries.updateValue((p,), live[p])
        self.handle.registerTimer(min(dies for dies, _ in live.values()))
        yield pd.DataFrame(out, columns=["id", "neighbor", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rest = expiredTimerInfo.getExpiryTimeInMs(), []
        for p, (dies, _) in list(self.entries.iterator()):
            if dies <= now:
                self.entries.removeKey(p)
            else:
                rest.append(dies)
        if rest:
            self.handle.registerTimer(min(rest))
        yield from ()

    def close(self) -> None:
        pass


def _neighbors(rows: DataFrame, processor: NeighborProcessor) -> DataFrame:
    return rows.groupBy("bucket").transformWithStateInPandas(
        processor, outputStructType="id string, neighbor string, score double", outputMode="Append", timeMode="EventTime")


def band_neighbors(articles: DataFrame, id_col: str = "url_hash", ts: str = "extracted_at", limit: int = 3,
                   hours: int = SIMHASH_HOURS, watermark: str = "1 hour") -> DataFrame:
    """``(id, neighbor, score)`` of a stream with ``sim_hi``, ``sim_lo`` and ``arrival``: per band and
    distinct live fingerprint within ``limit`` bits the article that had it last.
    A pair that shares several bands comes once for each."""
    a = _event_ms(articles, ts, watermark)
    payload = F.unhex(F.concat(F.lpad(F.hex("sim_hi"), 16, "0"), F.lpad(F.hex("sim_lo"), 16, "0")))
    band = F.explode(disjoint_bands("sim_hi", "sim_lo", limit + 1)).alias("b")
    rows = a.select(F.col(id_col).alias("id"), "arrival", "at_time", "at_ms", payload.alias("payload"), band).select(
        F.concat_ws(":", "b.band", "b.value", "b.value2").alias("bucket"), "id", "arrival", "at_time", "at_ms", "payload")
    return _neighbors(rows, NeighborProcessor("hamming", limit, hours * HOUR_MS))


def vector_neighbors(articles: DataFrame, id_col: str = "url_hash", ts: str = "extracted_at", vec_col: str = "embedding",
                     threshold: float = 0.92, recall: float = 0.99, expected: int = 1_000_000, hours: int = VECTOR_HOURS,
                     watermark: str = "1 hour") -> DataFrame:
    """The cache of recent vectors, by sign random projections: per shared
    signature and distinct live vector with cosine >= threshold the article
    that had it last. ``expected`` live vectors choose the bits of a signature."""
    bits, tables = plan_bands(expected, threshold, recall)
    a = _event_ms(articles.where(F.col(vec_col).isNotNull()).where(l2_norm(vec_col) > 0), ts, watermark)
    signed = signatures(a.withColumn("vec", F.col(vec_col)), bits, tables, keep=(id_col, "arrival", "at_time", "at_ms"))
    rows = signed.select(F.col(id_col).alias("id"), "arrival", "at_time", "at_ms", F.col("vb").alias("payload"),
                         F.posexplode("keys").alias("t", "k")).select(
        F.concat_ws(":", "t", "k").alias("bucket"), "id", "arrival", "at_time", "at_ms", "payload")
    return _neighbors(rows, NeighborProcessor("cosine", threshold, hours * HOUR_MS))


def band_pairs(articles: DataFrame, again: DataFrame, id_col: str = "url_hash", ts: str = "extracted_at", limit: int = 3,
               hours: int = SIMHASH_HOURS, watermark: str = "1 hour") -> DataFrame:
    """I1 by a stream-stream join: ``(left_id, right_id, dist)`` of two readings of one
    stream, ``left`` less than ``hours`` earlier (or of one time and an earlier arrival) and within
    ``limit`` bits. A pair comes from the first band it shares, so once. Both sides'
    state is bounded by the watermarks and the time range of the join."""
    def side(df: DataFrame, p: str) -> DataFrame:
        every = disjoint_bands("sim_hi", "sim_lo", limit + 1)
        return (df.withColumn(f"{p}at", F.col(ts).cast("timestamp")).withWatermark(f"{p}at", watermark)
                .select(F.col(id_col).alias(f"{p}id"), F.col("arrival").alias(f"{p}arrival"), F.col("sim_hi").alias(f"{p}hi"),
                        F.col("sim_lo").alias(f"{p}lo"), f"{p}at", every.alias(f"{p}all"), F.explode(every).alias(f"{p}b")))

    x, y = side(articles, "l"), side(again, "r")
    dist = hamming("lhi", "llo", "rhi", "rlo")
    earlier_band = F.exists(F.arrays_zip(F.col("lall").alias("x"), F.col("rall").alias("y")), lambda z: (z["x"] == z["y"]) & (z["x"]["band"] < F.col("lb.band")))
    order = (F.col("lat") < F.col("rat")) | ((F.col("lat") == F.col("rat")) & (F.col("larrival") < F.col("rarrival")))
    joined = x.join(y, (F.col("lb") == F.col("rb"))
                    & (F.col("lat") <= F.col("rat")) & (F.col("lat") > F.col("rat") - F.expr(f"INTERVAL {hours} HOURS")))
    return joined.where(order & (dist <= limit) & ~earlier_band).select(
        F.col("lid").alias("left_id"), F.col("rid").alias("right_id"), dist.alias("dist"))
