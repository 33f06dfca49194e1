"""Stored upserts and order-exact centroids against plain loops."""

import os
import random

import numpy as np

from storyspark.operators import centroids as CE
from storyspark.operators import store as ST
from storyspark.operators import upserts as UP

COLS = "k string, version int, id string, created_at int, v string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def test_stored_upsert_equals_the_operator_and_leaves_other_buckets(spark, tmp_path):
    r = random.Random(1)
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", 1, f"id{i}", i, "old") for i in range(200)], COLS)
    UP.create_target(first, path, "k", buckets=32)
    batch_cols = COLS + ", arrival int"
    for n in range(3):
        before = UP.read_target(spark, path)
        rows = [(f"k{r.randrange(230)}", r.randrange(4), f"b{n}-{i}", 1000 + i, f"n{n}-{i}", i) for i in range(6)] + [(None, 9, "x", 1, "x", 9)]
        batch = spark.createDataFrame(rows, batch_cols)
        want = ST.upsert_versioned(before.selectExpr("*", "-1 as arrival"), batch.where("k is not null"), "k").select(*before.columns)
        want = sorted(map(tuple, want.collect()))
        old = files(path)
        touched = UP.upsert_stored(spark, path, batch)
        new = files(path)
        assert sorted(map(tuple, UP.read_target(spark, path).select(*before.columns).collect())) == want
        bucket = lambda p: p.split("bucket=")[1].split("/")[0]
        changed = {bucket(p) for p in set(new) ^ set(old)} | {bucket(p) for p in set(new) & set(old) if new[p] != old[p]}
        assert 0 < len(changed) <= touched <= 6
        assert {p for p in old if bucket(p) not in changed} <= set(new)
        # the same batch again changes no row
        UP.upsert_stored(spark, path, batch)
        assert sorted(map(tuple, UP.read_target(spark, path).select(*before.columns).collect())) == want
    assert UP.upsert_stored(spark, path, spark.createDataFrame([], batch_cols)) == 0


def test_centroids_follow_arrival_order(spark):
    r = np.random.default_rng(3)
    sizes = {"big": 400, "mid": 45, "one": 1, "zero": 3}
    rows = []
    for c, n in sizes.items():
        for i in range(n):
            v = np.zeros(8) if c == "zero" else r.standard_normal(8)
            rows.append((c, int(r.integers(0, 10_000)), f"{c}{i}", v.tolist()))
    rows += [(None, 1, "none", [1.0] * 8), ("big", 2, "nov", None), ("mid", 7, "ta", [1.0] * 8), ("mid", 7, "tb", [-2.0] * 8)]
    df = spark.createDataFrame(rows, "cluster_id string, arrival int, url_hash string, embedding array<double>").repartition(5)
    start = {"mid": (np.ones(8) / np.sqrt(8), 5), "idle": (np.eye(8)[0], 2)}
    known = spark.createDataFrame([(k, c.tolist(), n) for k, (c, n) in start.items()], "id string, centroid array<double>, article_count long")
    got = {x.cluster_id: x for x in CE.ordered_centroids(df, known, chunk_rows=40).collect()}
    want = dict(start)
    for c, _, _, v in sorted((x for x in rows if x[0] and x[3] is not None), key=lambda x: (x[1], x[2])):
        centroid, n = want.get(c, (None, 0))
        moved = np.asarray(v) if centroid is None else (centroid * n + np.asarray(v)) / (n + 1)
        norm = np.linalg.norm(moved)
        want[c] = (moved / norm if norm > 0 else moved, n + 1)
    assert set(got) == set(want)
    for c, (centroid, n) in want.items():
        assert got[c].article_count == n and np.allclose(got[c].centroid, centroid, atol=1e-12)
    assert CE.ordered_centroids(df.where("arrival < 0")).count() == 0
