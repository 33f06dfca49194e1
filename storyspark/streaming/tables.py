"""State tables of micro-batch jobs that compact: one snapshot and the deltas since.

A batch appends its rows as a delta of its epoch and reads one snapshot and the deltas
between the snapshot and itself. Every ``every`` epochs the rows up to the epoch
before are written as a new snapshot, laid out by key bucket, without what has
expired; then one row in ``pointer`` makes it the current one.

Replay: a batch only sees snapshots and deltas of epochs below its own, and overwrites its
own delta, so it finds the same rows however often it runs, also if it failed inside a
compaction: a snapshot without its pointer row is not read and is written again.
The snapshot before the current one and the deltas since it stay; older ones are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet. Any other
    failure to read rises: a storage error is not an empty state."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class StateTable:
    """``path/delta/epoch=E/bucket=B``, ``path/snapshot/upto=E/bucket=B`` and ``path/pointer``.

    ``fold`` merges the rows of a key when a snapshot is written (default: rows stay as they
    are); it must give the same state for rows and for their folded form."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, every: int = 8,
                 fold: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.every, self.fold = buckets, every, fold

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def snapshots(self, below: int) -> list[int]:
        """Epochs that complete snapshots go up to, newest first."""
        rows = read_if_any(self.spark, f"{self.path}/pointer")
        if rows is None:
            return []
        return [r.upto for r in rows.where(F.col("upto") < below).select("upto").distinct().orderBy(F.desc("upto")).collect()]

    def read(self, epoch: int, buckets: list[int] | None = None) -> DataFrame | None:
        """The state a batch starts from: all rows of epochs below ``epoch`` (of some
        buckets only, if given, whose directories alone are then read); None if there are none."""
        upto = next(iter(self.snapshots(epoch)), None)
        parts = []
        if upto is not None:
            parts.append(read_if_any(self.spark, f"{self.path}/snapshot/upto={upto}"))
        delta = read_if_any(self.spark, f"{self.path}/delta")
        if delta is not None:
            parts.append(delta.where((F.col("epoch") < epoch) & (F.col("epoch") > (-1 if upto is None else upto))).drop("epoch"))
        parts = [p for p in parts if p is not None]
        if not parts:
            return None
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets) if buckets else F.lit(False)) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("bucket")

    def append(self, rows: DataFrame, epoch: int) -> None:
        """The rows of one batch; a replayed epoch replaces itself."""
        (rows.withColumn("bucket", self.bucket(F.col(self.key))).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/delta/epoch={epoch}"))

    def compact(self, epoch: int, alive: Column | None = None) -> bool:
        """At the end of the batch ``epoch``, write a snapshot of the epochs below it if
        ``every`` of them have passed since the last. ``alive`` keeps the rows that any
        later batch can still need."""
        known = self.snapshots(epoch)
        if epoch - 1 - (known[0] if known else -1) < self.every:
            return False
        rows = self.read(epoch)
        if rows is None:
            return False
        if alive is not None:
            rows = rows.where(alive)
        if self.fold is not None:
            rows = self.fold(rows)
        (rows.withColumn("bucket", self.bucket(F.col(self.key))).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.path}/snapshot/upto={epoch - 1}"))
        self.spark.range(1).select(F.lit(epoch - 1).alias("upto")).write.mode("append").parquet(f"{self.path}/pointer")
        if known:
            self._remove(known[0], known[1:])
        return True

    def _remove(self, kept: int, older: list[int]) -> None:
        """Snapshots before ``kept`` and the deltas it holds."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = [f"{self.path}/snapshot/upto={e}" for e in older]
        delta = read_if_any(self.spark, f"{self.path}/delta")
        if delta is not None:
            gone += [f"{self.path}/delta/epoch={r.epoch}" for r in
                     delta.where(F.col("epoch") <= kept).select("epoch").distinct().collect()]
        for p in gone:
            place = jvm.org.apache.hadoop.fs.Path(p)
            place.getFileSystem(conf).delete(place, True)
