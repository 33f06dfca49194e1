"""Session set-up and lineage helpers.

The library never creates its own storage locations on a cluster: iterative
jobs cut lineage with ``DataFrame.checkpoint()`` into the directory the cluster
names in ``spark.checkpoint.dir``. Only a local session (tests, bench) gets a
scratch directory when that setting is missing.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every session gets unless the caller already set them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (addPyFile of a zip of
    the package), once per SparkContext."""
    sc = spark.sparkContext
    key = id(sc._jsc) if getattr(sc, "_jsc", None) is not None else id(sc)
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="storyspark-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "storyspark"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="storyspark")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def get_spark(master: str | None = None, app: str = "storyspark",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is also the executor
            builder = builder.config("spark.driver.memory",
                                     os.environ.get("STORYSPARK_DRIVER_MEM", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One process; local-cluster masters have executors of their own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting a scratch one only locally."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared "
            "checkpoint directory on the cluster")
    scratch = tempfile.mkdtemp(prefix="storyspark-ckpt-",
                               dir=os.environ.get("STORYSPARK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one.
    The plan is persisted first so the checkpoint write does not compute it
    a second time; the cache is released once the files are written."""
    ensure_checkpoint_dir(df.sparkSession)
    from pyspark import StorageLevel
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def with_tasks(packed: DataFrame, tasks: int) -> DataFrame:
    """Every row of ``packed``, which is checkpointed, with every ``task`` from 0, one task to a partition: each reads the
    checkpoint from one end to the other, and nothing is shuffled."""
    numbers = packed.sparkSession.range(0, tasks, 1, tasks).select(F.col("id").cast("int").alias("task"))
    return packed.coalesce(1).crossJoin(numbers.hint("shuffle_replicate_nl"))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Before per-row Python work on a small file of one split: ``partitions``
    partitions, if the caller asks for them. Large scans have their own splits."""
    return df.repartition(partitions) if partitions else df


def idle_cores(table: DataFrame) -> int | None:
    """``partitions`` for :func:`spread`: the session's cores where the scan of ``table`` has fewer
    splits than that. A large table has splits of its own; its rows are not moved."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return cores if table.rdd.getNumPartitions() < cores else None
