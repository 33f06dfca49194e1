"""Vector operators against numpy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.operators import vectors as VE


def _table(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")


@pytest.mark.parametrize("block_rows, pivots", [(2048, 256), (16, 256), (16, 3)])
@pytest.mark.parametrize("threshold", [0.92, 0.3])
def test_every_pair_is_found(spark, block_rows, pivots, threshold):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 24))
    m = np.concatenate([base + 0.15 * k * r.normal(size=base.shape) for k in range(4)]).astype(np.float32)
    m = np.concatenate([m, m[:5], np.zeros((1, 24), np.float32)])
    df = _table(spark, m)
    vecs = VE.distinct_vectors(df, "embedding").cache()
    got = {(x.vid1, x.nvid1): x.score for x in VE.vector_neighbors(vecs, threshold, False, block_rows, pivots).collect()}
    ids = [x.v for x in df.select("id", VE.vector_id("embedding")[0].alias("v")).orderBy("id").collect()]
    u = m[:160].astype(float) / np.linalg.norm(m[:160].astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    want = {(ids[i], ids[j]): cos[i, j] for i, j in zip(*np.nonzero(cos >= threshold)) if i != j}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_other_dimensions_meet_among_themselves(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(x.left_id, x.right_id) for x in VE.vector_pairs(df, "id", "id", "embedding", 0.9).collect()}
    assert got == {(1, 2), (3, 4)}


def test_search_answers_every_query(spark):
    r = np.random.default_rng(5)
    c, q = r.normal(size=(300, 8)).astype(np.float32), r.normal(size=(60, 8)).astype(np.float32)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, qvec array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    cos = unit(q) @ unit(c).T
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-cos[i])[:5] if cos[i, j] >= 0.2}
    for block in (2048, 7):
        hits = VE.knn_search(queries, _table(spark, c), 5, 0.2, query_block=block).collect()
        assert {(x.query_id, x.id) for x in hits} == want


def test_one_bad_text_loses_one_row(spark):
    class Model:
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return np.array([[len(t), 1.0] for t in texts])

    rows = [(i, "bad" if i == 17 else None if i == 3 else "x" * (i + 1)) for i in range(40)]
    out = VE.embed(spark.createDataFrame(rows, "id long, content string").coalesce(1), model_factory=Model).collect()
    assert [x.id for x in out if x.embedding is None] == [3, 17]


def test_nearest_centroid(spark):
    arts = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], None), (3, None, "z"), (4, [0.0, 0.0], "w")],
                                 "id long, embedding array<float>, match_note string")
    cl = spark.createDataFrame([("a", [1.0, 0.1], 1), ("b", [0.6, 0.8], 2)], "id string, centroid array<double>, last_activity int")
    got = {x.id: (x.match_id, x.match_note) for x in VE.assign_to_centroid(arts, cl, 0.7).collect()}
    assert got == {1: ("a", "x"), 2: ("b", None), 3: (None, "z"), 4: (None, "w")}
    assert all(x.match_id is None for x in VE.assign_to_centroid(arts, cl.limit(0), 0.7).collect())


def test_a_batch_against_a_state(spark):
    r = np.random.default_rng(9)
    m = r.normal(size=(120, 6)).astype(np.float32)
    vecs = VE.distinct_vectors(_table(spark, m), "embedding").cache()
    ids = [x.v for x in _table(spark, m).select("id", VE.vector_id("embedding")[0].alias("v")).orderBy("id").collect()]
    asking = vecs.where(F.col("vid1").isin(ids[:20])).select("vid1", "vid2")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(cos >= 0.6)) if i != j and (i < 20 or j < 20)}
    for block, pivots in ((2048, 4), (8, 256), (8, 2)):
        got = VE.vector_neighbors(vecs, 0.6, False, block, pivots, asking=asking)
        assert {(x.vid1, x.nvid1) for x in got.collect()} == want


def test_pairs_come_from_the_blocks_without_a_shuffle(spark):
    r = np.random.default_rng(6)
    m = r.normal(size=(300, 8)).astype(np.float32)
    vecs = _table(spark, np.concatenate([m, m, m[:1].repeat(50, axis=0)]))
    v1, v2 = VE.vector_id("embedding")
    packed = VE.pack_blocks(vecs.select(v1.alias("vid1"), v2.alias("vid2"), F.col("embedding").alias("vec")), block_rows=64)
    assert packed.select(F.sum(F.size("rows"))).first()[0] == 300       # copies are packed once
    pairs = VE.block_pairs(packed, packed, 0.5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    assert pairs.count() == np.count_nonzero(np.triu(u @ u.T, 1) >= 0.5)


def test_first_look_bounds_the_cosine():
    """Shorter rows never show less than the cosine, and the pairs are those of whole vectors."""
    import numpy as np
    from storyspark.operators import vectors as V
    g = np.random.default_rng(2)
    centre = g.normal(size=(6, 128))
    x, y = (((centre[g.integers(0, 6, 4200)] + 0.4 * g.normal(size=(4200, 128))) * np.linspace(3, 0.1, 128)).astype("float32") for _ in range(2))
    y[:40] = x[:40] * 2
    ux, uy = V._unit(x), V._unit(y)
    lx, ly = V._first_look(ux, uy, 0.99)
    assert lx.shape[1] < 128
    assert (lx[:900] @ ly[:900].T >= ux[:900] @ uy[:900].T - 1e-5).all()
    got = {(int(a), int(b)) for i, j, _ in V._pairs_at(x, y, 0.99, False) for a, b in zip(i, j)}
    assert got == set(zip(*(k.tolist() for k in np.nonzero(ux.astype(float) @ uy.T.astype(float) >= 0.99)))) and len(got) >= 40


def test_story_flow_compares_vectors_once(spark, tmp_path, monkeypatch):
    """Of vectors with few neighbours, one product of all blocks serves both stages."""
    import numpy as np
    import pandas as pd
    from storyspark.operators import clusters as CL
    from storyspark.operators import dedup as DD
    from storyspark.operators import vectors as V
    from storyspark.plans import flows
    g = np.random.default_rng(3)
    words = [" ".join(f"w{x}" for x in g.integers(0, 10 ** 6, 40)) for _ in range(30)]
    words += [w + " more" for w in words[:5]]
    pd.DataFrame({"doc_id": range(35), "source": "s", "lang": "en", "text": words}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": [0], "quality": [1], "toxic": [0]}).to_parquet(tmp_path / "labels.parquet")
    calls, real = [], V.block_pairs
    for module in (CL, DD, V):
        monkeypatch.setattr(module, "block_pairs", lambda *a, **k: calls.append(1) or real(*a, **k), raising=False)
    got = flows.story_flow(spark, str(tmp_path)).collect()
    assert len(calls) == 1
    assert len(got) == 35 and sorted(r.doc_id for r in got if r.stage) == list(range(30, 35))
