"""Streaming jobs equal their batch twins."""

import tempfile

from pyspark.sql import functions as F

from storyspark.operators import dedup as DD
from storyspark.sources import tables as TB
from storyspark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_dedup_stream_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    arts = TB.articles(spark, SF, with_quality=False).select(
        "url_hash", "arrival", "extracted_at", "url", "title", "content")
    # land the table as 4 files in arrival order -> 4 micro-batches
    import time
    for k in range(4):   # written one after another: file order = arrival order
        (arts.where((F.col("arrival") >= 50 * k) & (F.col("arrival") < 50 * (k + 1) if k < 3 else F.lit(True)))
             .coalesce(1).write.mode("append").parquet(f"{scratch}/in"))
        time.sleep(1.1)
    src = spark.readStream.schema(arts.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = J.dedup_stream(src, f"{scratch}/state", f"{scratch}/out", f"{scratch}/ckpt",
                       prepare=lambda df: J.prepare_articles(df, embed=False), vector=False)
    q.awaitTermination()
    got = {r.url_hash: (r.kept, r.duplicate_of) for r in spark.read.parquet(f"{scratch}/out").collect()}
    batch = DD.dedup_decide(J.prepare_articles(arts, embed=False))
    exp = {r.url_hash: (r.kept, r.duplicate_of) for r in batch.collect()}
    assert got == exp


def test_event_once_stream_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    ev = TB.read_table(spark, SF, "events").select("event_id", "ts", "event_type")
    twice = ev.unionByName(ev.where("event_type = 'click'"))
    twice.repartition(3).write.parquet(f"{scratch}/in")
    src = spark.readStream.schema(twice.schema).parquet(f"{scratch}/in")
    q = (J.event_once_stream(src).writeStream.format("memory").queryName("once_t")
          .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.event_id for r in spark.sql("SELECT event_id FROM once_t").collect())
    assert got == sorted(r.event_id for r in ev.collect())


def test_cluster_stream_keeps_table_consistent(spark):
    import time
    from storyspark.operators import vectors as VE
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    arts = VE.embed(TB.articles(spark, SF, with_quality=False), "content", "embedding").select(
        "url_hash", "arrival", "extracted_at", "url", "title", "embedding")
    for k in range(2):
        (arts.where((F.col("arrival") >= 100 * k) & (F.col("arrival") < 100 * (k + 1)))
             .coalesce(1).write.mode("append").parquet(f"{scratch}/in"))
        time.sleep(1.1)
    src = spark.readStream.schema(arts.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = J.cluster_stream(src, f"{scratch}/clusters", f"{scratch}/assigned", f"{scratch}/ckpt",
                         threshold=0.75)
    q.awaitTermination()
    asg = spark.read.parquet(f"{scratch}/assigned").where("cluster_id IS NOT NULL")
    cur = J.cluster_table(spark, f"{scratch}/clusters").cache()
    assert asg.count() == 200
    assert asg.join(cur, asg.cluster_id == cur.id, "left_anti").count() == 0
    assert cur.agg(F.sum("article_count")).first()[0] == 200
    assert cur.select("id").distinct().count() == cur.count()


def _land(df, path, cuts, col):
    """Files written one after another: file order is the order of ``col``."""
    import time
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        df.where((F.col(col) >= lo) & (F.col(col) < hi)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def test_dedup_stream_with_vectors_and_repeated_urls_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    vec = TB.read_table(spark, SF, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    arts = DD.with_simhash(TB.articles(spark, SF, with_quality=False)).withColumn("_v", F.col("doc_id") % 90).join(vec, "_v").select(
        F.concat(F.lit("u"), F.floor((F.col("doc_id") % 150) / 2).cast("string")).alias("url_hash"), "arrival", "extracted_at", "url", "title",
        "sim_hi", "sim_lo", "embedding")
    _land(arts, f"{scratch}/in", [0, 70, 140, 1000], "arrival")
    src = spark.readStream.schema(arts.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    J.dedup_stream(src, f"{scratch}/state", f"{scratch}/out", f"{scratch}/ckpt", prepare=lambda df: df).awaitTermination()
    cols = ["arrival", "kept", "stage", "duplicate_of", "distance", "score"]
    got = sorted(map(tuple, spark.read.parquet(f"{scratch}/out").select(*cols).collect()))
    exp = sorted(map(tuple, DD.dedup_decide(arts, vector_col="embedding").select(*cols).collect()))
    assert got == exp and len(got) == 200 and {r[2] for r in got} >= {"url", "vector", None}


def test_state_errors_rise(spark, tmp_path):
    import pytest
    assert J._state(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        J._state(spark, str(tmp_path / "bad")).count()


def test_poison_stream_equals_batch(spark):
    from storyspark.streaming.ops import poison_split
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    rows = [(1, '{"k": 1}'), (2, '{"k": "abc"}'), (3, "{"), (4, None), (5, '{"j": 1}'), (6, '{"k": 7, "x": [1]}'), (7, '{"k": null}')]
    df = spark.createDataFrame(rows, "id long, payload string")
    df.write.parquet(f"{scratch}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{scratch}/in")
    J.poison_split_stream(src, "payload", "k INT", f"{scratch}/good", f"{scratch}/bad", f"{scratch}/ckpt").awaitTermination()
    batch = {r.id: r.valid for r in poison_split(df, "payload", "k INT").collect()}
    assert batch == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert {r.id for r in spark.read.parquet(f"{scratch}/good").collect()} == {1, 6}
    assert {r.id for r in spark.read.parquet(f"{scratch}/bad").collect()} == {2, 3, 4, 5, 7}


def test_board_stream_equals_batch(spark):
    from storyspark.streaming.ops import board_fold
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    arts = TB.articles(spark, SF, with_quality=False)
    ev = arts.select((F.col("doc_id") % 9).cast("string").alias("cluster_id"), F.col("doc_id").cast("string").alias("article_id"),
                     "url", "arrival", "extracted_at")
    again = ev.where("arrival % 7 = 0").withColumn("cluster_id", F.lit("other")).withColumn("arrival", F.col("arrival") + 1000)
    ev = ev.unionByName(again)
    _land(ev, f"{scratch}/in", [0, 80, 1100, 5000], "arrival")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    J.live_board_stream(src, f"{scratch}/state", f"{scratch}/board", f"{scratch}/ckpt", newest=5).awaitTermination()
    out = spark.read.parquet(f"{scratch}/board")
    last = out.where(F.col("epoch") == out.agg(F.max("epoch")).first()[0]).drop("epoch")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, board_fold(ev, 5).select(*last.columns).collect()))
    assert last.count() == 5 and last.where("cluster_id = 'other'").count() == 0


def test_retain_stream_drops_old_rows(spark):
    from storyspark.streaming.ops import retain
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    df = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-08 00:00:00")], "id long, t string").select(
        "id", F.col("t").cast("timestamp_ntz").alias("ts"))
    df.write.parquet(f"{scratch}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{scratch}/in")
    q = (J.retain_stream(src, days=7, now="2024-01-08 00:00:00").writeStream.format("memory").queryName("kept_t")
          .trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r.id for r in spark.sql("SELECT id FROM kept_t").collect()} == {2, 3} == {r.id for r in retain(df).collect()}


def test_seen_items_are_renewed_by_every_sighting(spark):
    scratch = tempfile.mkdtemp(prefix="storyspark-stream-")
    days = [("a", 1), ("b", 1), ("a", 6), ("c", 6), ("a", 11), ("b", 11), (None, 11), ("c", 11), ("c", 12)]
    df = spark.createDataFrame(days, "item_key string, day int").withColumn(
        "polled_at", F.timestamp_add("DAY", F.col("day"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    _land(df, f"{scratch}/in", [0, 2, 7, 100], "day")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    J.seen_items_stream(src, f"{scratch}/state", f"{scratch}/out", f"{scratch}/ckpt").awaitTermination()
    got = sorted((r.item_key, r.day) for r in spark.read.parquet(f"{scratch}/out").collect())
    # a is met every five days; b comes back after ten, when its entry has gone
    assert got == [("a", 1), ("b", 1), ("b", 11), ("c", 6)]
