"""Keyed state with expiry, the band join, compacting tables, the decay job."""

import os
import random
import tempfile
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.operators import dedup as DD
from storyspark.operators import reports as RP
from storyspark.streaming import jobs as J
from storyspark.streaming import ops as OP
from storyspark.streaming import state as S
from storyspark.streaming.tables import StateTable

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def land(df, path, cuts, col):
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        df.where((F.col(col) >= lo) & (F.col(col) < hi)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def stream(spark, df, scratch, cuts, col="arrival"):
    land(df, f"{scratch}/in", cuts, col)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")


def run(out, name, scratch):
    out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{scratch}/ckpt").outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_seen_items_equal_a_loop_and_expire(rocks):
    r = random.Random(3)
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    hours = sorted(r.randrange(0, 400) for _ in range(300))
    rows = [(i, r.choice("abcdefgh"), T0 + timedelta(hours=h)) for i, h in enumerate(hours)]
    rows += [(300, "once", T0 + timedelta(hours=400)), (301, None, T0 + timedelta(hours=400)),
             (302, "edge", T0 + timedelta(hours=401)), (303, "edge", T0 + timedelta(hours=425)), (304, "z", T0 + timedelta(hours=2000))]
    df = rocks.createDataFrame(rows, "arrival int, item_key string, polled_at timestamp")
    src = stream(rocks, df, scratch, [0, 80, 160, 250, 304, 400])
    ttl = 24 * S.HOUR_MS
    got = sorted(x.arrival for x in run(S.seen_items(src, ttl_ms=ttl), "seen_t", scratch))
    dies, want = {}, []
    for i, k, t in rows:
        if k is not None:
            if dies.get(k, t) <= t:         # at exactly its time to live an entry is dead
                want.append(i)
            dies[k] = t + timedelta(hours=24)
    assert got == want and 302 in got and 303 in got and 1 < len(want) < len(rows) - 1
    # the last batch moved the watermark past all but its own key
    held = {x.key.item_key for x in rocks.read.format("statestore").option("stateVarName", "expiry").load(f"{scratch}/ckpt").collect()}
    assert held <= {"z"}


def plain_hamming(a, b):
    return bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") + bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1")


def articles(seed, n=160):
    """Fingerprints in groups of a few flips, at rising times."""
    r = random.Random(seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bases = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(12)]
    rows = []
    for i in range(n):
        hi, lo = r.choice(bases)
        for _ in range(r.randrange(4)):
            b = r.randrange(128)
            hi, lo = (hi ^ (1 << b), lo) if b < 64 else (hi, lo ^ (1 << (b - 64)))
        rows.append((f"u{i}", i, T0 + timedelta(hours=2 * (i // 2)), signed(hi), signed(lo)))
    return rows


SCHEMA = "url_hash string, arrival int, extracted_at timestamp, sim_hi long, sim_lo long"


def test_band_neighbors_equal_a_loop(rocks):
    rows = articles(5)
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    src = stream(rocks, rocks.createDataFrame(rows, SCHEMA), scratch, [0, 50, 100, 200])
    got = {(x.id, x.neighbor, x.score) for x in run(S.band_neighbors(src), "bands_t", scratch)}
    want = set()
    for i, (u, _, t, hi, lo) in enumerate(rows):
        latest = {}
        for v, _, s, a, b in rows[:i]:
            if s + timedelta(hours=72) > t:
                latest[(a, b)] = v
        want |= {(u, v, float(plain_hamming((hi, lo), p))) for p, v in latest.items() if plain_hamming((hi, lo), p) <= 3}
    assert got == want and len(want) > 50
    # what is left is younger than 72 h at the watermark: an hour before the newest row of the batch before the last
    alive = rows[99][2] - timedelta(hours=1) - timedelta(hours=72)
    left = rocks.read.format("statestore").option("stateVarName", "entries").load(f"{scratch}/ckpt").collect()
    ages = [datetime.fromtimestamp(x.value.expire_at / 1000, timezone.utc) - timedelta(hours=72) for x in left] if left and "value" in left[0] else []
    assert all(a > alive for a in ages)


def test_vector_cache_equals_a_loop(rocks):
    r = np.random.default_rng(2)
    centres = r.standard_normal((6, 32))
    vectors = (centres[r.integers(0, 6, 60)] + 0.1 * r.standard_normal((60, 32))).astype(np.float32)
    vectors[40] = vectors[39]
    rows = [(f"u{i}", i, T0 + timedelta(hours=i), v.tolist()) for i, v in enumerate(vectors)] + [("none", 60, T0 + timedelta(hours=60), None)]
    df = rocks.createDataFrame(rows, "url_hash string, arrival int, extracted_at timestamp, embedding array<float>")
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    src = stream(rocks, df, scratch, [0, 30, 100])
    got = {(x.id, x.neighbor): x.score for x in run(S.vector_neighbors(src, expected=500), "vecs_t", scratch)}
    u = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = {}
    for i in range(60):
        latest = {vectors[j].tobytes(): j for j in range(max(0, i - 23), i)}       # 24 hours, strictly
        want.update({(f"u{i}", f"u{j}"): u[i] @ u[j] for j in latest.values() if u[i] @ u[j] >= 0.92})
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 50
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got)


def test_band_join_equals_batch_pairs(spark):
    rows = articles(8)
    df = spark.createDataFrame(rows, SCHEMA)
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    x = stream(spark, df, scratch, [0, 60, 120, 200])
    y = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    got = sorted((p.left_id, p.right_id, p.dist) for p in run(S.band_pairs(x, y), "join_t", scratch))
    near = DD.simhash_neighbors(df, 3)          # batch C2 on the same rows
    a = df.alias("a").join(near, (F.col("a.sim_hi") == F.col("hi")) & (F.col("a.sim_lo") == F.col("lo"))).alias("a")
    b = df.alias("b")
    both = (a.join(b, (F.col("b.sim_hi") == F.col("nhi")) & (F.col("b.sim_lo") == F.col("nlo")))
            .where("(a.extracted_at < b.extracted_at OR (a.extracted_at = b.extracted_at AND a.arrival < b.arrival)) "
                   "AND a.extracted_at > b.extracted_at - INTERVAL 72 HOURS")
            .select(F.col("a.url_hash"), F.col("b.url_hash"), "dist"))
    assert got == sorted(map(tuple, both.collect())) and len(got) > 100


def test_state_table_compacts_and_replays(spark, tmp_path):
    path = str(tmp_path / "state")
    fold = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))
    table = StateTable(spark, path, "k", buckets=4, every=3, fold=fold)
    batch = lambda e: spark.createDataFrame([(f"k{i % 7}", 1) for i in range(e, e + 10)], "k string, v long")
    total = lambda df: {r.k: r.v for r in fold(df).collect()}
    want, seen = {}, []
    for e in range(12):
        if e:
            assert total(table.read(e)) == want
        for r in batch(e).collect():
            want[r.k] = want.get(r.k, 0) + r.v
        table.append(batch(e), e)
        seen.append(table.compact(e))
        if e in (3, 7):
            # the epoch runs again, once with a snapshot already made, once with one half made
            if e == 7:
                pointers = f"{path}/pointer"
                keep = [r.upto for r in spark.read.parquet(pointers).collect() if r.upto != 5]
                assert keep
            before = dict(want)
            table.append(batch(e), e)
            table.compact(e)
            assert total(table.read(e + 1)) == before
    assert seen.count(True) >= 3
    upto = table.snapshots(1 << 40)[0]
    files = table.read(12).inputFiles()
    assert {f.split("/snapshot/")[1].split("/")[0] for f in files if "/snapshot/" in f} == {f"upto={upto}"}
    assert len(os.listdir(f"{path}/snapshot")) <= 2 and len([d for d in os.listdir(f"{path}/delta") if d.startswith("epoch=")]) < 12


def test_unfinished_snapshot_is_not_read(spark, tmp_path):
    path = str(tmp_path / "state")
    table = StateTable(spark, path, "k", buckets=2, every=2)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    for e in range(2):
        table.append(rows, e)
    # a compaction that died before its pointer row
    rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/snapshot/upto=0")
    assert table.snapshots(99) == [] and table.read(2).count() == 4
    table.append(rows, 2)
    assert table.compact(2) and table.snapshots(99) == [1] and table.read(3).count() == 6
    assert table.read(1).count() == 2 or table.read(2).count() == 4      # earlier epochs still see their own past
    one = table.read(3, [0]).count() + table.read(3, [1]).count()
    assert one == 6


def test_dedup_stream_reads_snapshots(spark, monkeypatch):
    monkeypatch.setattr(J, "COMPACT_EVERY", 2)
    rows = articles(11, 120)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("array<float>").alias("embedding"))
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    src = stream(spark, df, scratch, [0, 20, 40, 60, 80, 100, 200])
    J.dedup_stream(src, f"{scratch}/state", f"{scratch}/out", f"{scratch}/ckpt", prepare=lambda x: x, vector=False).awaitTermination()
    cols = ["arrival", "kept", "stage", "duplicate_of", "distance"]
    got = sorted(map(tuple, spark.read.parquet(f"{scratch}/out").select(*cols).collect()))
    assert got == sorted(map(tuple, DD.dedup_decide(df).select(*cols).collect()))
    assert StateTable(spark, f"{scratch}/state", "url_hash").snapshots(99)


def test_board_partials_equal_batch_over_many_epochs(spark, monkeypatch):
    monkeypatch.setattr(J, "COMPACT_EVERY", 2)
    r = random.Random(1)
    rows = []
    for i in range(240):
        rows.append((f"c{r.randrange(25)}", f"a{i if r.random() < .8 else r.randrange(i + 1)}", f"https://s{r.randrange(5)}.example.com/{i}", i,
                     T0 + timedelta(minutes=r.randrange(5000))))
    df = spark.createDataFrame(rows, "cluster_id string, article_id string, url string, arrival int, extracted_at timestamp")
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    src = stream(spark, df, scratch, [0, 40, 80, 120, 160, 200, 300])
    J.live_board_stream(src, f"{scratch}/state", f"{scratch}/board", f"{scratch}/ckpt", newest=6).awaitTermination()
    out = spark.read.parquet(f"{scratch}/board")
    for e, upto in ((1, 80), (3, 160), (5, 300)):
        last = out.where(F.col("epoch") == e).drop("epoch")
        want = OP.board_fold(df.where(F.col("arrival") < upto), 6).select(*last.columns)
        assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert StateTable(spark, f"{scratch}/state/partials", "cluster_id").snapshots(99)


def test_decay_is_written_and_emitted_once(spark):
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    base = [(f"c{i}", "l", [1.0, 0.0], 3, 3, "active", 1.0, ["s"], T0 + timedelta(hours=h), T0) for i, h in enumerate((0, 5, 20, 30))]
    cols = "id string, label string, centroid array<double>, article_count long, version int, status string, decay_score double, top_sources array<string>, last_activity timestamp, created_at timestamp"
    J._clusters(spark, f"{scratch}/clusters").append(spark.createDataFrame(base, cols).withColumn("written_at", F.lit(0)), 0)
    ticks = [(0, T0 + timedelta(hours=27)), (1, T0 + timedelta(hours=33)), (2, T0 + timedelta(hours=34))]
    src = stream(spark, spark.createDataFrame(ticks, "n int, ts timestamp"), scratch, [0, 1, 2, 3], "n")
    J.decay_stream(src, f"{scratch}/clusters", f"{scratch}/status", f"{scratch}/out", f"{scratch}/ckpt").awaitTermination()
    sent = sorted((r.epoch, r.id, r.version) for r in spark.read.parquet(f"{scratch}/out").collect())
    limit = 6 * np.log2(1 / 0.05)
    want, gone = [], set()
    for e, (_, now) in enumerate(ticks):
        for c in base:
            if c[0] not in gone and (now - c[8]).total_seconds() / 3600 > limit:
                gone.add(c[0])
                want.append((e, c[0], 4))
    assert sent == sorted(want) and 0 < len(want) < 4
    table = J.with_status(J.cluster_table(spark, f"{scratch}/clusters"), J._statuses(spark, f"{scratch}/status").read(99))
    assert {r.id: r.status for r in table.collect()} == {c[0]: "decayed" if c[0] in gone else "active" for c in base}
    # one that gets an article later is active again
    J._clusters(spark, f"{scratch}/clusters").append(spark.createDataFrame([(*base[0][:3], 5, 5, *base[0][5:])], cols).withColumn("written_at", F.lit(1)), 1)
    table = J.with_status(J.cluster_table(spark, f"{scratch}/clusters"), J._statuses(spark, f"{scratch}/status").read(99))
    assert {r.id: (r.status, r.version) for r in table.collect()}["c0"] == ("active", 5)


def test_metric_totals_stream_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_type").alias("name"), F.round("value").cast("long").alias("value"), (F.col("event_id") % 3).cast("int").alias("part"))
    src = stream(spark, e, scratch, [0, 1, 2, 3], "part")
    (J.metric_totals_stream(src).writeStream.format("memory").queryName("totals_t").outputMode("update")
     .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start().awaitTermination())
    rows = spark.sql("SELECT * FROM totals_t").collect()
    got = {}
    for r in rows:
        got[r.name] = max(got.get(r.name, 0), r.total)      # values are not negative, so the last total is the largest
    want = {r.name: r.total for r in RP.metric_totals(e).collect()}
    assert got == want and len(rows) == 3 * len(want)


def test_merged_sketches_keep_the_rank_error(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_type", F.to_date("ts").alias("day"), "value")
    per_day = RP.latency_sketches(e, "value", ["event_type", "day"])
    assert per_day.count() > 5
    got = {r.event_type: r for r in RP.merged_latency(per_day, ["event_type"]).collect()}
    values = {}
    for r in e.where("value is not null").collect():
        values.setdefault(r.event_type, []).append(r.value)
    assert set(got) == set(values)
    for k, v in values.items():
        v = np.sort(v)
        assert got[k].n == len(v) and got[k].mean == pytest.approx(v.mean())
        for q in (0.5, 0.9, 0.99):
            x = got[k][f"p{round(q * 100)}"]
            low, high = np.searchsorted(v, x, "left") / len(v), np.searchsorted(v, x, "right") / len(v)
            assert low - 0.03 <= q <= high + 0.03
    assert RP.merged_latency(RP.latency_sketches(e.where("value < -1"), "value", ["event_type", "day"]), ["event_type"]).count() == 0


def test_changed_key_queue_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(J, "COMPACT_EVERY", 2)
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "b"]), r.choice([None] + [f"k{i}" for i in range(30)]), i, i // 40) for i in range(240)]
    df = spark.createDataFrame(rows, "entity string, key string, marked_at int, part int")
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    src = stream(spark, df, scratch, [0, 1, 2, 3, 4, 5, 6], "part")
    J.changed_keys_stream(src, f"{scratch}/state", f"{scratch}/out", f"{scratch}/ckpt", "a", n=7).awaitTermination()
    got = {}
    for x in spark.read.parquet(f"{scratch}/out").collect():
        got.setdefault(x.epoch, set()).add((x.key, x.marked_at))
    waiting, want = {}, {}
    for e in range(6):
        for entity, key, at, part in rows:
            if part == e and entity == "a" and key is not None:
                waiting[key] = min(at, waiting.get(key, at))
        want[e] = set(sorted(waiting.items(), key=lambda x: (x[1], x[0]))[:7])
        for k, _ in want[e]:
            del waiting[k]
    assert got == want and StateTable(spark, f"{scratch}/state", "key").snapshots(99)


def test_cluster_stream_equals_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(J, "COMPACT_EVERY", 2)
    r = np.random.default_rng(12)
    base = np.eye(6)
    vectors = [base[k] + 0.25 * r.standard_normal(6) for k in (0, 1, 0, 1, 0, 2)]
    rows = [(f"u{i}", i, T0 + timedelta(hours=i), f"https://s{i % 2}.example.com/{i}", f"t{i}", v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "url_hash string, arrival int, extracted_at timestamp, url string, title string, embedding array<double>")
    scratch = tempfile.mkdtemp(prefix="storyspark-state-")
    src = stream(spark, df, scratch, list(range(7)))
    J.cluster_stream(src, f"{scratch}/clusters", f"{scratch}/out", f"{scratch}/ckpt", threshold=0.75).awaitTermination()
    state, want = {}, {}
    for u, _, _, _, _, v in rows:
        v = np.asarray(v)
        near = max(state, key=lambda c: state[c][0] @ v / np.linalg.norm(v), default=None)
        if near is not None and state[near][0] @ v / np.linalg.norm(v) >= 0.75:
            c, n = state[near]
            c = (c * n + v) / (n + 1)
            state[near], want[u] = (c / np.linalg.norm(c), n + 1), near
        else:
            state[u], want[u] = (v / np.linalg.norm(v), 1), u
    assert {x.url_hash: x.cluster_id for x in spark.read.parquet(f"{scratch}/out").collect()} == want and 1 < len(state) < 6
    table = {x.id: x for x in J.cluster_table(spark, f"{scratch}/clusters").collect()}
    assert set(table) == set(state)
    for k, (c, n) in state.items():
        assert table[k].article_count == n and np.allclose(table[k].centroid, c, atol=1e-9)
    assert J._clusters(spark, f"{scratch}/clusters").snapshots(99)
