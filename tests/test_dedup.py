"""Dedup rules (C1, C2, C3, K1) as tiny DataFrames, and K1 against the
sequential loop on the smallest driver table."""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from storyspark.functions.simhash import simhash_py
from storyspark.operators import dedup as DD
from storyspark.operators import vectors as VE
from storyspark.sources import tables as TB

from .test_functions import _flip

SCHEMA = "url_hash string, arrival long, extracted_at timestamp_ntz, sim_hi long, sim_lo long"


def _rows(spark, items, vec=False):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    data = [(u, a, base + dt.timedelta(minutes=a), h, l) + ((v,) if vec else ())
            for (u, a, h, l, *rest) in items for v in ([rest[0]] if vec else [None])]
    schema = SCHEMA + (", embedding array<float>" if vec else "")
    return spark.createDataFrame(data, schema)


def test_near_and_far_fingerprints(spark):
    hi, lo = simhash_py("breaking news about the markets today in the city")
    near = _flip(hi, lo, [1, 70])                       # distance 2
    far = _flip(hi, lo, list(range(0, 80, 8)))          # distance 10
    df = _rows(spark, [("a", 1, hi, lo), ("b", 2, *near), ("c", 3, *far)])
    r = {x.url_hash: x for x in DD.dedup_decide(df).collect()}
    assert r["a"].kept and not r["b"].kept and r["c"].kept
    assert r["b"].stage == "simhash" and r["b"].duplicate_of == "a" and r["b"].distance == 2


def test_window_expiry_is_strict(spark):
    import datetime as dt
    hi, lo = simhash_py("same story text again and again")
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, t0, hi, lo), ("b", 2, t0 + dt.timedelta(hours=72), hi, lo),
                                ("c", 3, t0 + dt.timedelta(hours=72, seconds=-1), hi, lo)], SCHEMA)
    # arrival order a, b, c but c is earlier in time than b: use times in order
    df = spark.createDataFrame([("a", 1, t0, hi, lo), ("c", 2, t0 + dt.timedelta(hours=71), hi, lo),
                                ("b", 3, t0 + dt.timedelta(hours=143), hi, lo)], SCHEMA)
    r = {x.url_hash: x.kept for x in DD.dedup_decide(df).collect()}
    # c is within 72 h of a (dropped); b is 143 h after a -> a's entry expired
    assert r == {"a": True, "c": False, "b": True}


def test_same_vector_names_earlier_key(spark):
    v = [0.5] * 8
    df = _rows(spark, [("a", 1, 1, 1, v), ("b", 2, 999, -5, v), ("c", 3, 123, 77, [1.0] + [0.0] * 7)], vec=True)
    r = {x.url_hash: x for x in DD.dedup_decide(df, vector_col="embedding").collect()}
    assert r["a"].kept and not r["b"].kept and r["c"].kept
    assert r["b"].stage == "vector" and r["b"].duplicate_of == "a" and abs(r["b"].score - 1.0) < 1e-9


def test_known_url_and_repeat_after_drop(spark):
    hi, lo = simhash_py("text one two three four")
    df = _rows(spark, [("a", 1, hi, lo), ("a", 2, 5, 5)])
    df = df.withColumn("rowid", F.col("arrival"))
    r = {x.rowid: x for x in DD.dedup_decide(df, id_col="rowid").collect()}
    assert r[1].kept and not r[2].kept and r[2].stage == "url"
    stored = spark.createDataFrame([("a",)], "url_hash string")
    assert DD.known_url_guard(df, stored).count() == 0


def test_zero_vector_never_kept(spark):
    df = _rows(spark, [("a", 1, 1, 1, [0.0] * 4), ("b", 2, 2, 2, [1.0, 0.0, 0.0, 0.0])], vec=True)
    r = {x.url_hash: x for x in DD.dedup_decide(df, vector_col="embedding").collect()}
    assert not r["a"].kept and r["a"].stage == "no_vector" and r["b"].kept


def _sequential(docs, limit=3):
    kept, out = [], {}
    for r in docs.itertuples():
        hi, lo = simhash_py(r.text)
        t = r.doc_id * 60
        best = None
        for kd, kt, khi, klo in kept:
            if kt + 72 * 3600 > t:
                d = bin((hi ^ khi) & (2**64 - 1)).count("1") + bin((lo ^ klo) & (2**64 - 1)).count("1")
                if d <= limit and (best is None or (d, -kd) < best[:2]):
                    best = (d, -kd, kd)
        if best is None:
            kept.append((r.doc_id, t, hi, lo))
            out[r.doc_id] = (True, None, None)
        else:
            out[r.doc_id] = (False, best[2], best[0])
    return out


def test_k1_equals_sequential_loop(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").sort_values("doc_id")
    a = DD.with_simhash(TB.articles(spark, "/root/testdata/sf0.001", with_quality=False))
    for bucket in (1 << 18, 16):   # one bucket, and many buckets (carry path)
        got = DD.dedup_decide(a, id_col="doc_id", bucket_size=bucket).toPandas()
        exp = _sequential(docs)
        for r in got.itertuples():
            dup = None if pd.isna(r.duplicate_of) else int(r.duplicate_of)
            dist = None if pd.isna(r.distance) else int(r.distance)
            assert exp[r.doc_id] == (bool(r.kept), dup, dist), r.doc_id


def test_prior_kept_rows_block(spark):
    hi, lo = simhash_py("stream state text that was kept before")
    prior = _rows(spark, [("p", 1, hi, lo)])
    batch = _rows(spark, [("x", 2, hi, lo), ("y", 3, 7, 7)])
    r = {x.url_hash: x for x in DD.dedup_decide(batch, prior_kept=prior).collect()}
    assert set(r) == {"x", "y"} and not r["x"].kept and r["x"].duplicate_of == "p" and r["y"].kept


def test_repeated_url_in_a_batch(spark):
    df = _rows(spark, [("a", 1, 1, 1), ("a", 2, 2**40 - 1, 5), ("b", 3, -1, 7), ("a", 4, 1, 1)])
    out = DD.dedup_decide(df).collect()
    r = {x.arrival: x for x in out}
    assert len(out) == 4 and [r[i].kept for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert r[2].stage == r[4].stage == "url" and r[2].duplicate_of == r[4].duplicate_of == "a"


def test_repeated_url_across_batches(spark):
    prior = _rows(spark, [("a", 1, 1, 1), ("p", 2, 2**50 - 1, 9)])
    batch = _rows(spark, [("a", 3, 2**40 - 1, 5), ("a", 4, 77, -3), ("n", 5, -1, -1)])
    out = DD.dedup_decide(batch, prior_kept=prior).collect()
    r = {x.arrival: x for x in out}
    assert len(out) == 3 and [r[i].kept for i in (3, 4, 5)] == [False, False, True]
    assert r[3].stage == "url" and r[3].duplicate_of == "a"


def test_a_long_chain_needs_no_round_per_link(spark):
    """Each row is 2 bits from the one before and 4 from the one before that."""
    hi, lo, rows = 0, 0, []
    for i in range(200):
        rows.append((f"u{i}", i, hi, lo))
        bits = [(2 * i) % 128, (2 * i + 1) % 128]
        hi ^= sum(1 << b for b in bits if b < 63)
        lo ^= sum(1 << (b - 64) for b in bits if 64 <= b < 127)
    kept = []
    for _, a, h, l in rows:
        if not any((h ^ x).bit_count() + (l ^ y).bit_count() <= 3 for _, x, y in kept):
            kept.append((a, h, l))
    df = _rows(spark, rows)
    want = {a for a, _, _ in kept}
    got = {x.arrival for x in DD.dedup_decide(df).where("kept").collect()}
    assert got == want and 50 < len(want) < 150


def test_components_too_large_for_a_task_go_round_again(spark):
    rows = [(f"u{i}", i, (1 << (2 * i)) - 1, 0) for i in range(9)]
    want = {x.arrival: (x.kept, x.duplicate_of) for x in DD.dedup_decide(_rows(spark, rows)).collect()}
    got = {x.arrival: (x.kept, x.duplicate_of) for x in DD.dedup_decide(_rows(spark, rows), component_rows=2).collect()}
    assert got == want and [want[i][0] for i in range(9)] == [i % 2 == 0 for i in range(9)]


def test_given_vectors_use_every_embedding(spark, tmp_path):
    """700 embeddings, of which the last 200 nearly repeat earlier ones, against the sequential rule."""
    from storyspark.plans.registry import QUERIES
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 64))
    v[500:] = v[100:300] + r.normal(0, 0.1, (200, 64))
    v[500:600] = v[100:200] + r.normal(0, 2.0, (100, 64))          # cosine about 0.45: a cluster, not a copy
    pd.DataFrame({"vec_id": range(700), "embedding": list(v.astype("float32")), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10 ** 6, 40)) for _ in range(720)]
    pd.DataFrame({"doc_id": range(720), "source": "s", "lang": "en", "text": texts}).to_parquet(tmp_path / "documents.parquet")
    unit = v.astype("float32").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)

    def firsts(ids, least):
        out = []
        for d in ids:
            if not out or (unit[[o % 700 for o in out]] @ unit[d % 700]).max() < least:
                out.append(d)
        return out

    kept = firsts(range(720), 0.5)
    assert 500 < len(kept) < 620
    got = {x.doc_id: x for x in QUERIES["dedup_given_all"](spark, str(tmp_path)).collect()}
    assert len(got) == 720 and [d for d in sorted(got) if got[d].kept] == kept
    story = {x.doc_id: x for x in QUERIES["story_given_all"](spark, str(tmp_path)).collect()}
    assert [d for d in sorted(story) if story[d].is_new_cluster] == firsts(kept, 0.3)


def test_keys_of_more_blocks_find_the_same_pairs(spark, monkeypatch):
    """All pairs within the limit, each once, however many blocks a key has; rows of one fingerprint are counted."""
    import random
    r = random.Random(5)
    base = [r.getrandbits(128) for _ in range(30)]
    flip = lambda x, n: x ^ sum(1 << i for i in r.sample(range(128), n))
    prints = base + [flip(x, n) for x in base for n in (1, 3, 6, 11, 12)] + base[:7] + [0, (1 << 128) - 1]
    half = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(half(x >> 64), half(x & (1 << 64) - 1)) for x in prints] + [(None, None)] * 2
    df = spark.createDataFrame(rows, "sim_hi long, sim_lo long")
    n, keys = Counter(rows[:-2]), sorted(set(rows[:-2]))
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    for limit, together in ((3, (1, 3)), (11, (1, 2))):
        want = sorted((*a, *b, apart(a, b), n[a], n[b]) for a in keys for b in keys if a < b and apart(a, b) <= limit)
        for k in together:
            monkeypatch.setattr(DD, "LONG_KEY", 999)
            monkeypatch.setattr(DD, "plan_blocks", lambda rows, limit: (limit + k, k))
            got = DD.simhash_pairs(df, limit).select("hi", "lo", "nhi", "nlo", "dist", "n", "nn").collect()
            assert sorted(map(tuple, got)) == want and len(want) > 30


def test_chance_pairs_stay_in_proportion():
    """Pairs of unlike fingerprints that share a key, by fingerprint: they do not grow with the table."""
    met = lambda rows: (lambda b, k: math.comb(b, k) * rows / 2 ** (128 * k / b))(*DD.plan_blocks(rows, 11))
    assert DD.plan_blocks(10_000, 11) == (12, 1) and DD.plan_blocks(10 ** 6, 11) == (13, 2)
    assert all(met(n) < 1500 for n in (10 ** 4, 10 ** 5, 10 ** 6, 3 * 10 ** 6, 10 ** 7))
    assert all(len(DD.block_masks(b, k)) == math.comb(b, k) for b, k in ((12, 1), (13, 2), (14, 3)))


def test_far_fingerprints_meet_without_a_row_per_key(spark, monkeypatch):
    """Beyond long keys, what is shuffled is the fingerprints once; same pairs with several slices, and for some that ask."""
    import random
    r = random.Random(9)
    base = [r.getrandbits(128) for _ in range(60)]
    prints = base + [x ^ sum(1 << i for i in r.sample(range(128), n)) for x in base for n in (2, 7, 11, 13)]
    half = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(half(x >> 64), half(x & (1 << 64) - 1)) for x in prints]
    df = spark.createDataFrame(rows + [(None, None)], "sim_hi long, sim_lo long")
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    want = {(*a, *b, apart(a, b)) for a in rows for b in rows if a != b and apart(a, b) <= 11}
    near = DD.simhash_neighbors(df, 11, include_self=False)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DD, "PACKED_PRINTS", 7)
    for size in (1 << 22, 50):
        monkeypatch.setattr(DD, "SLICE_PRINTS", size)
        got = [tuple(x) for x in DD.simhash_neighbors(df, 11, include_self=False).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        some = spark.createDataFrame(rows[:20], "sim_hi long, sim_lo long")
        got = [tuple(x) for x in DD.simhash_neighbors(df, 11, include_self=False, asking=some).collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if w[:2] in rows[:20]}


def test_kept_neighbours_decide_like_all(spark):
    """With urls, fingerprints and vectors together, heads decide as all neighbours do, and the list of all is not made."""
    g = np.random.default_rng(4)
    n = 240
    v = g.normal(size=(n, 10)).astype("float32")
    v[60], v[7] = v[5], 0
    half = lambda x: x - (1 << 64) if x >> 63 else x
    words = [int(x) for x in g.integers(0, 2 ** 62, 40)]
    rows = [(i, f"u{i % 200}", i, words[i % 40], half(words[(i * 7) % 40]), None if i == 9 else v[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, url_hash string, arrival long, sim_hi long, sim_lo long, embedding array<float>").withColumn(
        "extracted_at", F.timestamp_micros(F.col("arrival") * 3_600_000_000))
    keyed = VE.key_vectors(df, "embedding").cache()
    packed = VE.pack_blocks(VE.known_vectors(keyed, "embedding"), block_rows=64)
    every = VE.block_pairs(packed, packed, 0.3, include_self=True, both=True)
    told = lambda out: sorted(map(tuple, out.select("id", "kept", "stage", "duplicate_of", "distance", "score").collect()), key=str)
    want = told(DD.dedup_decide(keyed, id_col="id", neighbors=every))
    assert {w[2] for w in want} == {None, "url", "simhash", "vector", "no_vector"}
    assert told(DD.dedup_decide(keyed, id_col="id", packed=packed, cos_threshold=0.3, head_rows=16)) == want
    assert told(DD.dedup_decide(keyed, id_col="id", packed=packed, cos_threshold=0.3)) == want
    assert DD.listed_neighbors(packed, 0.3, sample=100) is None
