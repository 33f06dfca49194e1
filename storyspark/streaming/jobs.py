"""Structured Streaming jobs.

State that must cross micro-batches lives in compacting tables (``tables.StateTable``): a
batch reads one snapshot and the deltas since, only epochs below its own, and
overwrites its own, so a replayed epoch after a failure is idempotent. State that is kept by key with
an expiry is in ``state``. Everything else is a plain streaming plan with
event-time watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clusters as CL
from ..operators import dedup as DD
from ..operators import filters as FL
from ..operators import vectors as VE
from ..operators import reports as RP
from ..operators.store import first_seen
from .ops import board_of, board_partials, first_deliveries, merge_partials, newest_clusters, poison_split
from .tables import StateTable, read_if_any

STATE_COLS = ["url_hash", "arrival", "extracted_at", "url", "title", "sim_hi", "sim_lo", "embedding"]


_state = read_if_any
NO_EPOCH = (1 << 62)      # above every epoch
COMPACT_EVERY = 8        # epochs between two snapshots of a state table


def _read_epochs(spark: SparkSession, path: str, below: int, newest_only: bool = False) -> DataFrame | None:
    df = _state(spark, path)
    if df is None:
        return None
    df = df.where(F.col("epoch") < below)
    if newest_only:
        last = df.agg(F.max("epoch").alias("e")).first().e
        return None if last is None else df.where(F.col("epoch") == last).drop("epoch")
    return df.drop("epoch")


def prepare_articles(df: DataFrame, embed: bool = True) -> DataFrame:
    """B1 -> D1 (-> J1) on a micro-batch of extracted articles."""
    a = DD.with_simhash(FL.min_content(df, "content", 50))
    return VE.embed(a, "content", "embedding") if embed else a.withColumn(
        "embedding", F.lit(None).cast("array<float>"))


def dedup_batch(batch: DataFrame, epoch_id: int, state_dir: str, out_dir: str,
                vector: bool = True, **k1) -> None:
    """I1 body: K1 for one micro-batch against the kept-row state. Kept rows never
    expire, as the url and vector rules have no time limit; those that only the
    fingerprint rule could need are left out by K1 itself."""
    spark = batch.sparkSession
    state = StateTable(spark, state_dir, "url_hash", every=COMPACT_EVERY)
    prior = state.read(epoch_id)
    dec = DD.dedup_decide(batch, id_col="url_hash", vector_col="embedding" if vector else None,
                          prior_kept=prior, **k1)
    dec = dec.persist()
    (dec.drop("embedding").withColumn("epoch", F.lit(epoch_id))
        .write.mode("overwrite").partitionBy("epoch").option("partitionOverwriteMode", "dynamic")
        .parquet(out_dir))
    state.append(dec.where("kept").select(*STATE_COLS), epoch_id)
    dec.unpersist()
    state.compact(epoch_id)


def dedup_stream(articles: DataFrame, state_dir: str, out_dir: str, checkpoint: str,
                 prepare: Callable[[DataFrame], DataFrame] = prepare_articles,
                 vector: bool = True, available_now: bool = True, **k1) -> StreamingQuery:
    """Streaming two-stage dedup. ``articles`` is a streaming DataFrame
    of extracted articles (url_hash, arrival, extracted_at, url, title,
    content). Decisions go to ``out_dir``; kept rows to ``state_dir``."""
    def run(df: DataFrame, epoch_id: int) -> None:
        dedup_batch(prepare(df), epoch_id, state_dir, out_dir, vector, **k1)
    w = articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def cluster_batch(batch: DataFrame, epoch_id: int, clusters_dir: str, out_dir: str, **k2) -> None:
    """I2 body: K2 for one micro-batch of unique articles against the
    current cluster table; writes the assignments and the clusters that the
    batch opened or changed (the table is the newest row of each id, see
    :func:`cluster_table`)."""
    spark = batch.sparkSession
    current = cluster_table(spark, clusters_dir, epoch_id)
    asg = CL.cluster_articles(batch, current, **k2).persist()
    (asg.drop("embedding").withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
        .partitionBy("epoch").option("partitionOverwriteMode", "dynamic").parquet(out_dir))
    opened = asg.where("is_new_cluster").select("cluster_id")
    new = CL.build_clusters(asg.join(opened, "cluster_id", "left_semi"))
    table = new.select("id", "label", "centroid", "article_count", "version", "status",
                       "decay_score", "top_sources", "last_activity", "created_at")
    if current is not None:
        joined = asg.where("cluster_id is not null and not is_new_cluster").select(F.col("cluster_id").alias("id")).distinct()
        changed = current.join(joined, "id", "left_semi")
        merged = CL.merge_into_clusters(changed, asg).select(*table.columns)
        table = merged.unionByName(table)
    state = _clusters(spark, clusters_dir)
    state.append(table.withColumn("written_at", F.lit(epoch_id)), epoch_id)
    asg.unpersist()
    state.compact(epoch_id)


def _newest(rows: DataFrame) -> DataFrame:
    cols = rows.columns
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), "written_at").alias("_r")).select("_r.*")


def _clusters(spark: SparkSession, clusters_dir: str) -> StateTable:
    return StateTable(spark, clusters_dir, "id", every=COMPACT_EVERY, fold=_newest)


def cluster_table(spark: SparkSession, clusters_dir: str, below: int | None = None) -> DataFrame | None:
    """The cluster table that I2 has written: per id the row of its last epoch
    (before ``below``, if given); None before the first batch."""
    rows = _clusters(spark, clusters_dir).read(NO_EPOCH if below is None else below)
    return None if rows is None else _newest(rows).drop("written_at")


def cluster_stream(unique: DataFrame, clusters_dir: str, out_dir: str, checkpoint: str,
                   available_now: bool = True, **k2) -> StreamingQuery:
    """Streaming story clustering (one table version per micro-batch)."""
    def run(df: DataFrame, epoch_id: int) -> None:
        cluster_batch(df, epoch_id, clusters_dir, out_dir, **k2)
    w = unique.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def seen_items_stream(items: DataFrame, state_dir: str, out_dir: str, checkpoint: str, key: str = "item_key",
                      ts: str = "polled_at", keep_days: int = 7) -> StreamingQuery:
    """I4: items whose key was not met within ``keep_days`` before. Every
    sighting renews a key's entry, so an item that stays in its feed is emitted
    once, however long it stays. State: the last sighting per key and batch."""
    def run(df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        known = _read_epochs(spark, state_dir, epoch_id)
        batch = first_seen(df.where(F.col(key).isNotNull()), key, ts)
        if known is not None:
            last = known.groupBy(key).agg(F.max("last_seen").alias("last_seen"))
            batch = batch.join(last, key, "left").where(
                F.col("last_seen").isNull() | (F.col("last_seen") < F.timestamp_add("DAY", F.lit(-keep_days), F.col(ts)))).drop("last_seen")
        _write_epoch(batch.select(*df.columns), out_dir, epoch_id)
        _write_epoch(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ts).alias("last_seen")), state_dir, epoch_id)
    return (items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())


def event_once_stream(events: DataFrame, key: str = "event_id", ts: str = "ts",
                      watermark: str = "7 days") -> DataFrame:
    """Drop repeated keys (redelivered events). The watermark bounds the
    state by time; rows later than the watermark are dropped."""
    return (events.withColumn("_evt", F.col(ts).cast("timestamp"))
                  .withWatermark("_evt", watermark)
                  .dropDuplicatesWithinWatermark([key]).drop("_evt"))


def poison_split_stream(envelopes: DataFrame, payload_col: str, schema_ddl: str,
                        good_dir: str, bad_dir: str, checkpoint: str,
                        required: tuple = ("k",)) -> StreamingQuery:
    """Valid envelopes to one sink, bad JSON / wrong schema to another
    (never retried)."""
    def run(df: DataFrame, epoch_id: int) -> None:
        r = poison_split(df, payload_col, schema_ddl, required).withColumn("epoch", F.lit(epoch_id))
        r = r.persist()
        for path, cond in ((good_dir, F.col("valid")), (bad_dir, ~F.col("valid"))):
            (r.where(cond).drop("parsed").write.mode("overwrite").partitionBy("epoch")
              .option("partitionOverwriteMode", "dynamic").parquet(path))
        r.unpersist()
    return (envelopes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
                     .trigger(availableNow=True).start())


def live_board_stream(clustered: DataFrame, state_dir: str, board_dir: str, checkpoint: str, newest: int = 300) -> StreamingQuery:
    """I8: the board as a table, one version per micro-batch, by mergeable partials.

    The state holds the ids that were met (so a repeat in any later batch changes nothing)
    and per cluster and domain how many articles came, when first and the last update. A batch
    reads the id buckets and the clusters it touches, and the board before it: a cluster
    that is not touched cannot move up."""
    cols = ["cluster_id", "article_id", "url", "arrival", "extracted_at"]

    def run(df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        ids = StateTable(spark, f"{state_dir}/ids", "article_id", every=COMPACT_EVERY)
        partials = StateTable(spark, f"{state_dir}/partials", "cluster_id", every=COMPACT_EVERY, fold=merge_partials)
        new = first_deliveries(df.select(*cols)).persist()
        known = ids.read(epoch_id, _buckets(ids, new))
        if known is not None:
            new = new.join(known, "article_id", "left_anti")
        part = board_partials(new).persist()
        touched = part.select("cluster_id").distinct()
        before = partials.read(epoch_id, _buckets(partials, touched))
        merged = part if before is None else merge_partials(part.unionByName(before.join(touched, "cluster_id", "left_semi")))
        rows = board_of(merged)
        shown = _read_epochs(spark, board_dir, epoch_id, newest_only=True)
        if shown is not None:
            rows = rows.unionByName(shown.join(touched, "cluster_id", "left_anti").select(*rows.columns))
        _write_epoch(newest_clusters(rows, newest), board_dir, epoch_id)
        ids.append(new.select("article_id"), epoch_id)
        partials.append(part, epoch_id)
        new.unpersist()
        part.unpersist()
        ids.compact(epoch_id)
        partials.compact(epoch_id)
    return (clustered.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
                     .trigger(availableNow=True).start())


def _buckets(state: StateTable, rows: DataFrame) -> list[int]:
    """The state's buckets that some rows fall into."""
    return [r.b for r in rows.select(state.bucket(F.col(state.key)).alias("b")).distinct().collect()]


def decay_stream(ticks: DataFrame, clusters_dir: str, status_dir: str, out_dir: str, checkpoint: str, ts: str = "ts",
                 half_life_hours: float = 6.0, decayed_below: float = 0.05) -> StreamingQuery:
    """At every trigger (the newest ``ts`` of its ticks is its time) the active clusters whose score has
    fallen below the limit become ``decayed`` by a versioned update of their own
    (version + 1, see :func:`with_status`) and are emitted once, to ``out_dir``. A cluster that
    gets articles after that has a higher version and is active again."""
    def run(df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        now = df.agg(F.max(F.col(ts).cast("timestamp")).alias("now")).first().now
        current = cluster_table(spark, clusters_dir)
        if now is None or current is None:
            return
        state = _statuses(spark, status_dir)
        active = with_status(current, state.read(epoch_id)).where("status = 'active'")
        gone = (RP.decay(active, now, half_life_hours, decayed_below).where("status = 'decayed'")
                .withColumn("version", F.col("version") + 1).withColumn("decayed_at", F.lit(now))
                .select("id", "status", "decay_score", "lifetime_hours", "version", "decayed_at").persist())
        _write_epoch(gone, out_dir, epoch_id)
        state.append(gone, epoch_id)
        gone.unpersist()
        state.compact(epoch_id)
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _highest(rows: DataFrame) -> DataFrame:
    cols = rows.columns
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), "version").alias("_r")).select("_r.*")


def _statuses(spark: SparkSession, status_dir: str) -> StateTable:
    return StateTable(spark, status_dir, "id", every=COMPACT_EVERY, fold=_highest)


def with_status(clusters: DataFrame, updates: DataFrame | None) -> DataFrame:
    """The cluster table under the status updates of the decay job: an update counts
    while its version is higher than the cluster's."""
    if updates is None:
        return clusters
    u = _highest(updates).select("id", F.col("status").alias("_s"), F.col("decay_score").alias("_d"), F.col("version").alias("_v"))
    newer = F.col("_v") > F.col("version")
    pick = lambda new, old: F.when(newer, F.col(new)).otherwise(F.col(old))
    return (clusters.join(u, "id", "left").withColumn("status", pick("_s", "status")).withColumn("decay_score", pick("_d", "decay_score"))
            .withColumn("version", pick("_v", "version")).select(*clusters.columns))


def _write_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    """One epoch of a state table; a replayed epoch replaces itself."""
    (df.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").partitionBy("epoch")
       .option("partitionOverwriteMode", "dynamic").parquet(path))


def retain_stream(events: DataFrame, ts: str = "ts", days: int = 7, now: str | None = None) -> DataFrame:
    """Rows older than ``days`` at the time of processing (or at ``now``)
    are dropped, statelessly."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return events.where(F.col(ts).cast("timestamp") >= F.timestamp_add("DAY", F.lit(-days), at))


def _pending(queue: DataFrame) -> DataFrame:
    """Keys marked since they were last taken: ``(key, marked_at, step, taken)``."""
    last = F.coalesce(F.max(F.when(F.col("taken"), F.col("step"))), F.lit(-1)).alias("last")
    marks = queue.where(~F.col("taken")).join(queue.groupBy("key").agg(last), "key").where(F.col("step") > F.col("last"))
    return marks.groupBy("key").agg(F.min("marked_at").alias("marked_at"), F.max("step").alias("step")).withColumn("taken", F.lit(False))


def changed_keys_stream(marks: DataFrame, state_dir: str, out_dir: str, checkpoint: str, entity: str, n: int = 50,
                        entity_col: str = "entity", key_col: str = "key", order_col: str = "marked_at") -> StreamingQuery:
    """G2 as a queue: every micro-batch adds its marks of ``entity`` and takes the ``n`` waiting keys
    that were marked first, each once however often it was marked. A key marked again after it was
    taken waits again. State: the waiting keys (a snapshot holds nothing else)."""
    def run(df: DataFrame, epoch_id: int) -> None:
        queue = StateTable(df.sparkSession, state_dir, "key", every=COMPACT_EVERY, fold=_pending)
        new = (df.where((F.col(entity_col) == entity) & F.col(key_col).isNotNull())
               .groupBy(F.col(key_col).alias("key")).agg(F.min(order_col).alias("marked_at"))
               .withColumn("step", F.lit(2 * epoch_id).cast("long")).withColumn("taken", F.lit(False)))
        before = queue.read(epoch_id)
        rows = new if before is None else new.unionByName(before)
        took = _pending(rows).orderBy("marked_at", "key").limit(n).persist()
        _write_epoch(took.select("key", "marked_at"), out_dir, epoch_id)
        queue.append(new.unionByName(took.select("key", "marked_at", F.lit(2 * epoch_id + 1).cast("long").alias("step"),
                                                 F.lit(True).alias("taken"))), epoch_id)
        took.unpersist()
        queue.compact(epoch_id)
    return marks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_totals_stream(metrics: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """D10 as a stateful aggregate (run it in update mode): the total of every counter
    that a batch changed. State: one number per name."""
    return RP.metric_totals(metrics, name, value)
