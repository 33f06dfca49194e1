"""C3 by signatures and C4 over a stored index against the exact operators."""

import re

import numpy as np
import pytest

from storyspark.operators import index as IX
from storyspark.operators import lsh as L
from storyspark.operators import vectors as VE


def near_vectors(n, dim, seed, noise):
    """Groups of vectors around common centres, a few per group."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 4, dim))
    return (centres[r.integers(0, len(centres), n)] + noise * r.standard_normal((n, dim))).astype(np.float32)


def frame(spark, vectors, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


def pairs(df):
    return {(r.left_id, r.right_id): r.score for r in df.collect()}


def exact_pairs(vectors, threshold):
    u = vectors.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    return {(int(i), int(j)): s[i, j] for i, j in zip(*np.nonzero(np.triu(s, 1) >= threshold))}


def test_plan_reaches_the_recall():
    for threshold in (0.3, 0.5, 0.8, 0.92, 0.99):
        for rows in (100, 10_000, 10**9):
            bits, tables = L.plan_bands(rows, threshold, 0.99)
            assert 1 - (1 - L.agreement(threshold) ** bits) ** tables >= 0.99
    few, many = L.plan_bands(10**4, 0.92, 0.99), L.plan_bands(10**9, 0.92, 0.99)
    assert many[0] > few[0]         # longer keys as rows grow, so buckets stay small
    assert L.sketch_limit(0.92) < 64 and L.sketch_limit(-1.0) == 256


@pytest.mark.parametrize("threshold, noise", [(0.92, 0.25), (0.8, 0.4)])
def test_recall_against_the_exact_join(spark, threshold, noise):
    vectors = near_vectors(1500, 48, 3, noise)
    want = exact_pairs(vectors, threshold)
    got = pairs(L.vector_pairs_lsh(frame(spark, vectors), "id", "id", "embedding", threshold))
    assert len(want) > 300
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-5 for p in got)
    assert len(got) >= 0.99 * len(want)


def test_on_the_embeddings_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = pairs(VE.vector_pairs(e, "vec_id", "vec_id", "embedding", 0.5))
    got = pairs(L.vector_pairs_lsh(e, "vec_id", "vec_id", "embedding", 0.5))
    assert set(got.items()) <= set(want.items())
    assert len(got) >= 0.97 * len(want) and (len(want) == 0 or got)


def test_hot_signature_copies_and_odd_rows(spark):
    """One bucket holds most vectors; copies are one row; null, zero and other dimensions."""
    r = np.random.default_rng(4)
    base = r.standard_normal(32)
    hot = (base + 0.02 * r.standard_normal((300, 32))).astype(np.float32)
    vectors = np.concatenate([hot, r.standard_normal((100, 32)).astype(np.float32)])
    extra = [(1000 + i, vectors[0].tolist()) for i in range(50)] + [(2000, None), (2001, [0.0] * 32), (2002, [1.0, 2.0]), (2003, [2.0, 4.1])]
    df = frame(spark, vectors, extra)
    want = exact_pairs(vectors, 0.92)
    got = L.vector_pairs_lsh(df, "id", "id", "embedding", 0.92, with_counts=True, pair_bucket=20, block_rows=64).collect()
    found = {(x.left_id, x.right_id) for x in got}
    assert (2002, 2003) in found and found - {(2002, 2003)} <= set(want)
    assert len(found) >= 0.99 * len(want)
    assert {x.n_left for x in got if x.left_id == 0} == {51}
    none = L.vector_pairs_lsh(df.where("id < 0"), "id", "id", "embedding", 0.92)
    assert none.count() == 0


def hits(df):
    return sorted((r.query_id, r.id, round(r.score, 9), r.rank) for r in df.collect())


@pytest.mark.parametrize("threshold, k", [(0.5, 5), (0.85, 50), (-1.0, 3)])
def test_index_equals_the_scan(spark, tmp_path, threshold, k):
    vectors = near_vectors(1200, 24, 5, 0.3)
    extra = [(5000, vectors[3].tolist()), (5001, vectors[3].tolist()), (6000, None), (6001, [0.0] * 24)]
    corpus = frame(spark, vectors, extra)
    IX.write_index(corpus, str(tmp_path / "ix"), cells=12, ring_rows=40)
    r = np.random.default_rng(9)
    asked = [(f"q{i}", (vectors[i * 7] + 0.1 * r.standard_normal(24)).tolist()) for i in range(90)]
    asked += [("far", (-vectors.sum(0)).astype(float).tolist()), ("null", None), ("zero", [0.0] * 24)]
    queries = spark.createDataFrame(asked, "query_id string, qvec array<double>")
    got = IX.search(spark, str(tmp_path / "ix"), queries, k, threshold, query_rows=20)
    want = VE.knn_search(queries.where("qvec is not null"), corpus.where("embedding is not null"), k, threshold)
    assert hits(got) == hits(want) and len(hits(got)) > 100


def test_scan_lists_only_cells_in_reach(spark, tmp_path):
    r = np.random.default_rng(6)
    centres = np.eye(16, dtype=np.float32)[:8] * 10
    vectors = np.concatenate([c + 0.05 * r.standard_normal((50, 16)).astype(np.float32) for c in centres])
    IX.write_index(frame(spark, vectors), str(tmp_path / "ix"), cells=40)
    one = spark.createDataFrame([("a", centres[2].tolist())], "query_id string, qvec array<double>")
    found = IX.search(spark, str(tmp_path / "ix"), one, 60, 0.9)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", found._jdf.queryExecution().toString())
    listed = {int(c) for s in scans for c in re.findall(r"cell#\d+ = (\d+)", s)}
    listed |= {int(c) for s in scans for group in re.findall(r"cell#\d+ IN \(([^)]*)\)", s) for c in group.split(",")}
    every = spark.read.parquet(str(tmp_path / "ix" / "rows")).select("cell").distinct().count()
    assert 0 < len(listed) < every / 2 and found.count() == 50


def test_empty_index(spark, tmp_path):
    nothing = spark.createDataFrame([], "id long, embedding array<float>")
    IX.write_index(nothing, str(tmp_path / "ix"))
    q = spark.createDataFrame([("a", [1.0, 2.0])], "query_id string, qvec array<double>")
    assert IX.search(spark, str(tmp_path / "ix"), q).count() == 0


def test_a_pair_in_many_buckets_comes_once(spark):
    """Near copies share nearly every key; vectors of two dimensions meet in one batch."""
    r = np.random.default_rng(12)
    vectors = (r.standard_normal(32) + 0.02 * r.standard_normal((60, 32))).astype(np.float32)
    df = frame(spark, vectors, [(2000, [1.0, 2.0]), (2001, [2.0, 4.1])])
    for bucket in (L.PAIR_BUCKET, 20):
        near = L.neighbors_lsh(VE.distinct_vectors(df, "embedding"), 0.92, bits=4, tables=30, pair_bucket=bucket, block_rows=16)
        assert near.count() == near.select("vid1", "vid2", "nvid1", "nvid2").distinct().count() == 60 * 59 // 2 + 1
    assert L.signature_words(0.5, 7, 77) > L.SKETCH_WORDS       # 256 bits do not tell chance pairs at 0.5


def test_no_row_of_a_key_is_shuffled(spark):
    """Vectors are packed and read by the tasks of the tables; what is exchanged after that is pairs. Same pairs with
    several slices of keys and with long buckets shared out."""
    vectors = near_vectors(120, 16, 3, 0.2)
    df = VE.distinct_vectors(frame(spark, vectors), "embedding")
    want = {tuple(sorted(p)) for p in exact_pairs(vectors, 0.8)}
    near = L.neighbors_lsh(df, 0.8, bits=3, tables=24)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan for x in ("keys#", "sig#", "FlatMapGroupsInArrow"))
    found = set()
    for least in (L.SLICE_BYTES, 2048):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(L, "SLICE_BYTES", least)
            m.setattr(L, "SHORT_BUCKET", 8)
            m.setattr(L, "SAMPLE_LEAST", 1)
            rows = L.neighbors_lsh(df, 0.8, bits=3, tables=24, pair_bucket=10, block_rows=16).collect()
        keys = {tuple(sorted(((r.vid1, r.vid2), (r.nvid1, r.nvid2)))) for r in rows}
        assert len(keys) == len(rows) and len(want) * 0.95 <= len(rows) <= len(want)
        found.add(frozenset(keys))
    assert len(found) == 1
