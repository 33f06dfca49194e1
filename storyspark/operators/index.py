"""C4 over a stored index: exact search of vectors kept in pivot cells.

:func:`write_index` deals a corpus once to the cells of sampled pivots (nearest pivot by
angle) and writes it partitioned by cell; within a cell rows are ordered by their
angle to the pivot and cut into rings of about ``RING_ROWS`` rows. A query meets a ring only if
a vector of it can lie within the threshold angle: by the triangle inequality the
angles of both to the pivot then differ by no more than that. :func:`search` prunes the cells no
query needs at the scan, joins queries to rings, and answers exactly as
``knn_search`` does, without collecting a query.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.vectors import l2_norm
from ..session import cut_lineage
from .vectors import _SLACK, _angles, _unit32, _unit_rows

RING_ROWS = 2048         # corpus rows per ring, on average
MAX_CELLS = 1024         # pivots at most: the only thing of the corpus that a driver or task holds whole
QUERY_ROWS = 4096        # queries that meet a ring in one task, on average
QUERY_BLOCK = 512        # of them scored at a time


def _pivots(blobs: list[bytes]) -> np.ndarray:
    return _unit32(blobs) if blobs else np.ones((1, 1), np.float32)


def _bytes(kind: str):
    """Vector -> raw values, ``f4`` or ``f8`` as the column has them."""
    @F.pandas_udf("binary")
    def run(vs: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=kind).tobytes() for v in vs], dtype=object)
    return run


def _to_pivots(blobs: pd.Series, kind: str, pivots: np.ndarray) -> np.ndarray:
    return _angles(blobs if kind == "f4" else blobs.map(lambda b: np.frombuffer(b, kind).astype("f4").tobytes()), pivots)


def _nearest(pivots: np.ndarray, kind: str):
    @F.pandas_udf("cell int, angle float")
    def run(blobs: pd.Series) -> pd.DataFrame:
        ang = _to_pivots(blobs, kind, pivots)
        odd = np.isnan(ang[:, 0])                       # another dimension: a cell of its own
        ang[odd] = 0
        return pd.DataFrame({"cell": np.where(odd, len(pivots), ang.argmin(axis=1)).astype(np.int32), "angle": ang.min(axis=1)})
    return run


def write_index(corpus: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None,
                ring_rows: int = RING_ROWS) -> None:
    """Write ``corpus(id_col, vec_col)`` under ``path``: ``rows`` (id, vb, angle, ring, partitioned by
    cell), ``pivots`` (cell, vb), ``rings`` (cell, ring, near, far, n) and ``layout``. Null and zero
    vectors are left out, as they match nothing."""
    spark = corpus.sparkSession
    kind = "f4" if corpus.schema[vec_col].dataType.elementType.typeName() == "float" else "f8"
    vb = (corpus.where(F.col(vec_col).isNotNull()).where(l2_norm(vec_col) > 0)
          .select(F.col(id_col).alias("id"), _bytes(kind)(vec_col).alias("vb")))
    n = vb.count()
    cells = cells or min(MAX_CELLS, max(1, math.isqrt(n)))
    picked = [np.frombuffer(r.vb, kind).astype("f4") for r in vb.orderBy(F.xxhash64("vb"), "vb").select("vb").limit(cells).collect()]
    size = max(map(len, picked), default=1)
    blobs = [v.tobytes() for v in picked if len(v) == size]
    spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "cell int, vb binary").write.mode("overwrite").parquet(f"{path}/pivots")
    placed = cut_lineage(vb.withColumn("c", _nearest(_pivots(blobs), kind)("vb")).select("id", "vb", "c.cell", "c.angle"))

    # ring borders of each cell: quantiles of the angle, found by counting
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    steps = F.greatest(F.ceil(F.col("n") / ring_rows).cast("int"), F.lit(1))
    share = F.array(*[F.lit(i / 64) for i in range(1, 65)])
    borders = (placed.groupBy("cell").agg(F.percentile_approx("angle", share, 1024).alias("q")).join(sizes, "cell")
               .select("cell", steps.alias("steps"), "q"))
    # 64 measured borders; a cell of more rings cuts each of them by hash
    bands = F.least(F.col("steps"), F.lit(64))
    band = F.size(F.filter("q", lambda b: b < F.col("angle")))
    ring = (F.floor(band * bands / 64) * F.ceil(F.col("steps") / bands)
            + F.pmod(F.xxhash64("vb"), F.ceil(F.col("steps") / bands))).cast("int")
    ringed = placed.join(F.broadcast(borders), "cell").withColumn("ring", ring).select("id", "vb", "angle", "ring", "cell")
    # read with the schema, as an empty index has no file to take it from
    (spark.createDataFrame([(kind, ringed.schema.json())], "kind string, schema string").write.mode("overwrite").parquet(f"{path}/layout"))
    (ringed.repartition("cell", "ring").sortWithinPartitions("cell", "ring", "angle")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows"))
    (spark.read.schema(ringed.schema).parquet(f"{path}/rows").groupBy("cell", "ring").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("n"))
     .write.mode("overwrite").parquet(f"{path}/rings"))


def _met(pivots: np.ndarray, radius: dict[int, float], limit: float):
    """Cells a query can have a match in, with its angle to each pivot."""
    reach = np.array([radius.get(i, -np.inf) for i in range(len(pivots))], np.float32) + limit + _SLACK

    @F.pandas_udf("array<struct<cell: int, angle: float>>")
    def run(blobs: pd.Series) -> pd.Series:
        out = []
        for row in _to_pivots(blobs, "f8", pivots):
            if np.isnan(row[0]):
                out.append([{"cell": len(pivots), "angle": 0.0}])
            else:
                out.append([{"cell": int(i), "angle": float(row[i])} for i in np.flatnonzero(row <= reach)])
        return pd.Series(out, dtype=object)
    return run


def _best(k: int, threshold: float, kind: str, schema: pa.Schema):
    """Rows of a ring and the queries that meet it -> the best ``k`` rows of each query."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return schema.empty_table()
        ids = rows.column("id")
        corpus = [np.frombuffer(b, kind) for b in rows.column("vb").to_pylist()]
        asked = [np.frombuffer(b, "f8") for b in queries.column("vb").to_pylist()]
        dims, asked_dims = np.array(list(map(len, corpus))), np.array(list(map(len, asked)))
        parts = []
        for d in np.unique(asked_dims):
            at, q = np.flatnonzero(dims == d), np.flatnonzero(asked_dims == d)
            if not len(at):
                continue
            m = _unit_rows([corpus[i] for i in at])
            for lo in range(0, len(q), QUERY_BLOCK):
                some = q[lo:lo + QUERY_BLOCK]
                score = m @ _unit_rows([asked[i] for i in some]).T
                r, c = np.nonzero(score >= threshold)
                parts.append(pd.DataFrame({"q": some[c], "r": at[r], "score": np.minimum(score[r, c], 1.0)}))
        if not parts:
            return schema.empty_table()
        found = pd.concat(parts, ignore_index=True)
        found["id"] = ids.take(pa.array(found["r"].to_numpy())).to_numpy(zero_copy_only=False)
        found = found.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
        found = found[found.groupby("q").cumcount() < k]
        return pa.Table.from_arrays([queries.column("qid").take(pa.array(found["q"].to_numpy())).combine_chunks(),
                                     ids.take(pa.array(found["r"].to_numpy())).combine_chunks(),
                                     pa.array(found["score"].to_numpy())], schema=schema)
    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, threshold: float = 0.7,
           q_id: str = "query_id", q_vec: str = "qvec", c_id: str = "id", query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(q_id, c_id, score, rank)``: per query the top ``k`` rows of the index with
    cosine >= threshold, by score desc then id, exactly those of ``knn_search``.

    The driver holds the pivots, the ring borders and the numbers of the cells that any query needs."""
    layout = spark.read.parquet(f"{path}/layout").first()
    kind = layout.kind
    rows = spark.read.schema(T.StructType.fromJson(json.loads(layout.schema))).parquet(f"{path}/rows")
    rings = spark.read.parquet(f"{path}/rings")
    pivots = _pivots([bytes(r.vb) for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()])
    radius = {r.cell: r.far for r in rings.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    limit = math.acos(max(-1.0, min(1.0, threshold)))

    asked = (queries.where(F.col(q_vec).isNotNull()).where(l2_norm(q_vec) > 0)
             .select(F.col(q_id).alias("qid"), _bytes("f8")(q_vec).alias("vb")))
    met = asked.withColumn("m", F.explode(_met(pivots, radius, limit)("vb"))).select("qid", "vb", "m.cell", "m.angle")
    inside = ((F.col("angle") >= F.col("near") - limit - _SLACK) & (F.col("angle") <= F.col("far") + limit + _SLACK)) | (F.col("cell") == len(pivots))
    shares = max(1, -(-asked.count() // query_rows))
    met = cut_lineage(met.join(rings.select("cell", "ring", "near", "far"), "cell").where(inside).select(
        "qid", "vb", "cell", "ring", F.pmod(F.xxhash64(F.col("qid").cast("string")), F.lit(shares)).cast("int").alias("share")))

    group = ["cell", "ring", "share"]
    tasks = met.select(*[F.col(c).alias(f"for_{c}") for c in group]).distinct()
    needed = sorted(r.for_cell for r in tasks.select("for_cell").distinct().collect())
    # the cells are literals, so the scan lists only their directories
    near = (rows.where(F.col("cell").isin(needed) if needed else F.lit(False))
            .join(tasks, (F.col("cell") == F.col("for_cell")) & (F.col("ring") == F.col("for_ring"))).drop("cell", "ring"))
    id_type, qid_type = rows.schema["id"].dataType, met.schema["qid"].dataType
    ddl = f"`{q_id}` {qid_type.simpleString()}, `{c_id}` {id_type.simpleString()}, score double"
    schema = pa.schema([(q_id, to_arrow_type(qid_type)), (c_id, to_arrow_type(id_type)), ("score", pa.float64())])
    found = near.groupBy(*[f"for_{c}" for c in group]).cogroup(met.groupBy(*group)).applyInArrow(_best(k, threshold, kind, schema), ddl)
    w = Window.partitionBy(q_id).orderBy(F.desc("score"), F.col(c_id))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
