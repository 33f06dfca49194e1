"""Vector operators: embeddings (J1), similarity pairs (C3), search (C4),
nearest centroid (C5) and small vector helpers.

The similarity join is exact: distinct vectors are packed once into blocks around
sampled pivots, block pairs that the angle bounds rule out are skipped, and the
rest meet as matrix products of bounded size (see ``block_pairs``).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import l2_norm
from ..session import cut_lineage, spread

DEFAULT_DIM = 384

# ----------------------------------------------------------------------------
# embeddings
# ----------------------------------------------------------------------------

_TOKEN = re.compile(r"\w+")
CACHED_TOKENS = 1 << 19     # tokens whose slot and sign a model remembers


class FeatureHasher:
    """Default text -> unit vector model: signed feature hashing of word
    tokens over the whole text (CRC-32 of each token picks slot and sign),
    sublinear term weight log(1 + tf) so repeated lines do not dominate.
    A user model is any callable list[str] -> ndarray (n, dim)."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim
        self._seen: dict[str, tuple[int, float]] = {}     # token -> slot, sign

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        cache = self._seen
        if len(cache) > CACHED_TOKENS:
            cache.clear()
        for i, t in enumerate(texts):
            if not t:
                continue
            toks = _TOKEN.findall(t.lower())
            if not toks:
                continue
            count = Counter(toks)
            uniq = sorted(count)                  # slots are added up in this order
            hits = []
            for tok in uniq:
                hit = cache.get(tok)
                if hit is None:
                    h = zlib.crc32(tok.encode("utf-8"))
                    hit = (h % self.dim, 1.0 if (h >> 31) & 1 else -1.0)
                    cache[tok] = hit
                hits.append(hit)
            idx, sgn = zip(*hits)
            times = np.fromiter(map(count.__getitem__, uniq), np.int64, len(uniq))
            np.add.at(out[i], np.array(idx, np.int64), np.array(sgn, np.float32) * np.log1p(times).astype(np.float32))
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out


def _embed_batch(model, texts: list) -> list:
    """Vectors of a batch; when the model fails on it, of its halves, so that
    one bad text costs its own row only. Null texts give null."""
    try:
        mat = np.asarray(model([t or "" for t in texts]), dtype=np.float32)
        if mat.ndim != 2 or mat.shape[0] != len(texts):
            raise ValueError("the model returned another number of vectors")
    except Exception:  # noqa: BLE001 - any model failure means no vector
        if len(texts) <= 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return _embed_batch(model, texts[:half]) + _embed_batch(model, texts[half:])
    return [None if t is None else row for t, row in zip(texts, mat)]


def embed(df: DataFrame, text_col: str = "content", out_col: str = "embedding",
          model_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
          dim: int = DEFAULT_DIM, partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` array<float>. The model is built once per task by
    ``model_factory`` (iterator UDF). A row whose embedding fails (exception
    or wrong size) gets null, and is dropped by callers as the reference does."""
    factory = model_factory or (lambda: FeatureHasher(dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            vals = texts.where(texts.notna(), None).tolist()
            yield pd.Series(_embed_batch(model, vals), dtype=object)

    return spread(df, partitions).withColumn(out_col, _embed(F.col(text_col)))


# ----------------------------------------------------------------------------
# Vector identity and SRP signatures
# ----------------------------------------------------------------------------

def vector_id(col) -> tuple[Column, Column]:
    """Two independent hashes of the vector (96 bits together): the key used
    to collapse identical vectors before any pair search."""
    c = F.col(col) if isinstance(col, str) else col
    return F.xxhash64(c), F.hash(c).cast("long")


@F.pandas_udf(T.BinaryType())
def vec_bytes(vs: pd.Series) -> pd.Series:
    """Vector -> raw float32 bytes (compact, Arrow-friendly)."""
    return pd.Series([None if v is None else np.asarray(v, dtype=np.float32).tobytes() for v in vs],
                     dtype=object)


def distinct_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """One row per distinct non-zero vector: (vid1, vid2, vec)."""
    v1, v2 = vector_id(vec_col)
    return (df.where(F.col(vec_col).isNotNull())
              .select(v1.alias("vid1"), v2.alias("vid2"), F.col(vec_col).alias("vec"))
              .dropDuplicates(["vid1", "vid2"])
              .where(l2_norm("vec") > 0))


def key_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with the vector's id (vid1, vid2) and whether it may be kept (vec_ok: there and not all zero)."""
    v1, v2 = vector_id(vec_col)
    return df.withColumns({"vid1": v1, "vid2": v2, "vec_ok": F.coalesce(F.exists(vec_col, lambda x: x != 0), F.lit(False))})


def known_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """(vid1, vid2, vec) of the rows of ``key_vectors`` with a non-zero vector, copies included."""
    return df.where(F.col(vec_col).isNotNull() & (l2_norm(vec_col) > 0)).select("vid1", "vid2", F.col(vec_col).alias("vec"))


BLOCK_ROWS = 2048         # distinct vectors per block of a small table, on average
BLOCKS = 8                # a larger table is cut into so many blocks, until one holds BLOCK_BYTES
BLOCK_BYTES = 16 << 20
MAX_PIVOTS = 256          # pivots (and so cells) at most; larger cells are cut into blocks
TILE = 1 << 22            # scores a task holds at a time
TILE_ROWS = 512           # rows of either side whose scores stay in a core's cache
LOW_DIMS = (32, 64, 96, 128, 192)     # axes that a first look may take
LOW_PAIRS = 1 << 24       # pairs from which axes are worth finding
LOW_SAMPLE = 512          # rows of either side that they are found on
DIM_COST, TILE_COST, EXACT_COST = 0.02, 1.0, 3000.0   # of a pair: per dimension, besides, and if it must be looked at again
PAIR_ROWS = 1 << 15       # pairs it hands on at a time
SIZING_ROWS = 1 << 16     # vectors looked at to size the blocks
_SLACK = 1e-3             # radians allowed for float32 angles


def _unit32(blobs: list) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(len(blobs), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _angles(blobs: pd.Series, pivots: np.ndarray) -> np.ndarray:
    """Angle of each vector to each pivot; nan where the dimension differs."""
    out = np.full((len(blobs), len(pivots)), np.nan, dtype=np.float32)
    fits = [i for i, b in enumerate(blobs) if len(b) == 4 * pivots.shape[1]]
    if fits:
        out[fits] = np.arccos(np.clip(_unit32([blobs.iat[i] for i in fits]) @ pivots.T, -1, 1))
    return out


def _first_look(ux: np.ndarray, uy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shorter rows whose products are the cosines of the unit rows or more: the coordinates on a few axes, and
    the length of what they leave over (by Cauchy-Schwarz). The axes are the main ones of a sample, as many as make the
    least work on it; the rows themselves, if none do."""
    if len(ux) * len(uy) < LOW_PAIRS or ux.shape[1] < 2 * LOW_DIMS[0]:
        return ux, uy
    some = [u[::-(-len(u) // LOW_SAMPLE)] for u in (ux, uy)]
    both = np.concatenate(some).astype(np.float64)
    axes = np.linalg.eigh(both.T @ both)[1][:, ::-1].astype(np.float32)

    def low(u, k):
        at = u @ np.ascontiguousarray(axes[:, :k])
        return np.hstack([at, np.linalg.norm(u - at @ axes[:, :k].T, axis=1, keepdims=True)])

    best = (TILE_COST + DIM_COST * ux.shape[1], None)
    for k in LOW_DIMS:
        if 2 * k <= ux.shape[1]:
            again = np.mean(low(some[0], k) @ low(some[1], k).T >= threshold - 1e-4)
            best = min(best, (TILE_COST + DIM_COST * k + EXACT_COST * float(again), k), key=lambda c: c[0])
    return (ux, uy) if best[1] is None else (low(ux, best[1]), low(uy, best[1]))


def _near_at(ux: np.ndarray, uy: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows whose products reach the threshold, or come within rounding of it, some tens of thousands at a time."""
    held, n = [], 0
    for at in range(0, len(ux), TILE_ROWS):
        for to in range(at if same else 0, len(uy), TILE_ROWS):
            right = uy[to:to + TILE_ROWS]
            found = np.flatnonzero((ux[at:at + TILE_ROWS] @ right.T >= threshold - 1e-4).ravel())
            if not len(found):
                continue
            i, j = np.divmod(found, len(right))
            i, j = i + at, j + to
            if same:
                i, j = i[i < j], j[i < j]
            held.append((i, j))
            n += len(i)
            if n >= PAIR_ROWS:
                yield tuple(np.concatenate(s) for s in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(s) for s in zip(*held))


def _exact(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``x`` and ``y``, side by side, reach the threshold, and their cosines in float64."""
    u, v = x.astype(np.float64), y.astype(np.float64)
    cos = np.minimum(np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)), 1.0)
    return cos >= threshold, cos


def _pairs_at(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the rows of ``x`` and ``y`` at or above the threshold, a bounded number
    at a time; with ``same`` (one block with itself) only i < j."""
    wx, wy = _unit(x), _unit(y)
    ux, uy = _first_look(wx, wy, threshold)
    for i, j in _near_at(ux, uy, threshold, same):
        for k in range(0, len(i), PAIR_ROWS):
            a, b = i[k:k + PAIR_ROWS], j[k:k + PAIR_ROWS]
            if ux is not wx:
                ok = np.einsum("ij,ij->i", wx[a], wy[b]) >= threshold - 1e-4
                a, b = a[ok], b[ok]
            ok, cos = _exact(x[a], y[b], threshold)
            if ok.any():
                yield a[ok], b[ok], cos[ok]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops vectors that came before, so that a partition sends a large group of copies once."""
    seen: set = set()
    for batch in batches:
        ids = list(zip(batch.column("vid1").to_pylist(), batch.column("vid2").to_pylist()))
        new = []
        for k, i in enumerate(ids):
            if i not in seen:
                seen.add(i)
                new.append(k)
        if len(seen) > 1 << 17:
            seen.clear()
        yield batch.take(pa.array(new, pa.int64()))


def pack_blocks(vecs: DataFrame, block_rows: int | None = None, max_pivots: int = MAX_PIVOTS, asking: DataFrame | None = None) -> DataFrame:
    """Distinct non-zero vectors ``vecs(vid1, vid2, vec, ...)``, a row per block: ``(own, cell, dim,
    asks, radius, far, rows array<struct of all columns but vec>, mat)``. A vector may be given more than
    once; it is packed once. Checkpointed, one block to a partition.

    A hash sample of at most ``max_pivots`` vectors are pivots; a vector belongs to the cell of its
    nearest pivot, and cells beyond ``block_rows`` are cut into blocks by hash."""
    vecs = vecs.select("vid1", "vid2", *[c for c in vecs.columns if c not in ("vid1", "vid2")])
    key = [c for c in vecs.columns if c != "vec"]
    asks = F.lit(True)
    if asking is not None:
        vecs = vecs.join(asking.select("vid1", "vid2", F.lit(True).alias("asks")).distinct(), ["vid1", "vid2"], "left")
        asks = F.coalesce("asks", F.lit(False))
    n = vecs.select("vid1", "vid2").distinct().count()
    digest = F.xxhash64("vid1", "vid2")
    some = vecs.where(F.pmod(digest, F.lit(max(1, n // SIZING_ROWS))) == 0).dropDuplicates(["vid1", "vid2"])
    picked = some.select(digest.alias("h"), "vid1", "vec").orderBy("h", "vid1").limit(max_pivots).collect()
    dim = max((len(r.vec) for r in picked), default=1)
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, min(-(-n // BLOCKS), BLOCK_BYTES // (4 * dim)))
    picked = [r for r in picked if len(r.vec) == dim][:max(1, -(-n // block_rows))]
    pivots = _unit(np.array([r.vec for r in picked], np.float32).reshape(-1, dim)) if picked else np.ones((1, 1), np.float32)
    odd_cell = len(pivots)                       # the vectors of other dimensions

    @F.pandas_udf("cell int, angle float")
    def nearest(blobs: pd.Series) -> pd.DataFrame:
        ang = _angles(blobs, pivots)
        odd = np.isnan(ang[:, 0])
        ang[odd] = 0
        return pd.DataFrame({"cell": np.where(odd, odd_cell, ang.argmin(axis=1)).astype(np.int32), "angle": ang.min(axis=1)})

    def place(df):
        return (df.select(*key, vec_bytes("vec").alias("vb"), asks.alias("asks")).withColumn("c", nearest("vb"))
                .withColumn("part", F.col("c.cell") * 2 + (~F.col("asks")).cast("int")))

    # a cell has two parts: the vectors that ask, and the others; parts that the sample does not show share a partition
    count = np.zeros(2 * odd_cell + 2, np.int64)
    count[0] = n
    if odd_cell > 1:
        shown = {r.part: r.n for r in place(some).groupBy("part").agg(F.count("*").alias("n")).collect()}
        for part in range(len(count)):
            count[part] = -(-n * shown.get(part, 0) // sum(shown.values()))
    blocks = -(-count // block_rows)
    first = np.where(blocks > 0, np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks.sum())
    starts, sizes = (F.array(*[F.lit(int(x)) for x in v]) for v in (first, np.maximum(blocks, 1)))
    spot = F.element_at(starts, F.col("part") + 1) + F.pmod("vid2", F.element_at(sizes, F.col("part") + 1)).cast("int")
    apart = np.zeros((odd_cell + 1, odd_cell + 1), np.float32)
    apart[:-1, :-1] = np.arccos(np.clip(pivots @ pivots.T, -1, 1))

    def pack(table: pa.Table) -> pa.Table:
        """One block."""
        ids = np.stack([table.column(c).to_numpy() for c in ("vid1", "vid2")], axis=1)
        at = pa.array(np.unique(ids, axis=0, return_index=True)[1])
        table = table.take(at).combine_chunks()
        cell = table.column("cell")[0].as_py()
        rows = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in key], key)
        number = table.column("spot")[0].as_py() * len(count) + table.column("part")[0].as_py()
        return pa.table({"own": pa.array([number], pa.int64()), "cell": table.column("cell")[:1], "dim": table.column("dim")[:1],
                         "asks": table.column("asks")[:1], "radius": [float(np.max(table.column("angle").to_numpy()))],
                         "far": pa.array([apart[cell].tolist()], pa.list_(pa.float32())), "mat": [b"".join(table.column("vb").to_pylist())],
                         "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)})

    fields = T.StructType([T.StructField(c, vecs.schema[c].dataType) for c in key])
    flat = place(vecs).select(spot.alias("spot"), "part", "c.cell", (F.length("vb") / 4).cast("int").alias("dim"), "asks", "c.angle", "vb", *key)
    flat = flat.mapInArrow(_first_copies, flat.schema)
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("own", T.LongType()), ("cell", T.IntegerType()), ("dim", T.IntegerType()), ("asks", T.BooleanType()), ("radius", T.DoubleType()),
        ("far", T.ArrayType(T.FloatType())), ("mat", T.BinaryType()), ("rows", T.ArrayType(fields)))])
    return cut_lineage(flat.repartitionById(int(blocks.sum()) + 1, "spot").groupBy("spot", "part", "dim").applyInArrow(pack, schema))


def pick_vectors(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks of ``packed`` with a column ``at``: the places in ``rows`` of the vectors
    ``wanted(vid1, vid2)``, to which ``block_pairs`` then keeps. Places are sent, no vectors."""
    places = packed.select("own", "dim", F.posexplode("rows").alias("at", "r")).select("own", "dim", "at", "r.vid1", "r.vid2")
    at = (places.join(wanted.select("vid1", "vid2").distinct(), ["vid1", "vid2"], "left_semi")
          .groupBy("own", "dim").agg(F.sort_array(F.collect_list("at")).alias("at")))
    return packed.join(F.broadcast(at), ["own", "dim"])


def block_pairs(left: DataFrame, right: DataFrame, threshold: float, include_self: bool = False, both: bool = False) -> DataFrame:
    """Pairs of packed vectors with cosine >= threshold: the columns of ``rows``, those of the
    other side with an n before, and ``score``. Exact. ``right`` is ``left`` itself (each pair once, or in both
    directions with ``both``) or of the same packing (every left vector against every right one, itself too).

    Two blocks meet unless the angle of their pivots rules out any pair; the blocks are
    read from their checkpoint and never shuffled, and a task holds two of them."""
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    one = left is right
    take = lambda df: "at" if "at" in df.columns else F.lit(None).cast("array<int>").alias("at")
    side = lambda df, x: (df.select("own", "cell", "dim", "asks", "radius", "far", "mat", "rows", take(df))
                          .select(*[F.col(c).alias(f"{x}_{c}") for c in ("own", "cell", "dim", "asks", "radius", "far", "mat", "rows", "at")]))
    a, b = side(left, "a"), side(right, "b")
    meet = ((F.abs(F.col("a_dim") - F.col("b_dim")) < 1)
            & (F.element_at("a_far", F.col("b_cell") + 1) <= F.col("a_radius") + F.col("b_radius") + limit + _SLACK))
    if one:
        meet = meet & (F.col("a_own") <= F.col("b_own")) & (F.col("a_asks") | F.col("b_asks"))
    fields = left.schema["rows"].dataType.elementType
    names = [*fields.names, *[f"n{c}" for c in fields.names], "score"]

    def block(batch: pa.RecordBatch, r: int, x: str):
        mat, rows, at = (batch.column(f"{x}_{c}")[r] for c in ("mat", "rows", "at"))
        mat = np.frombuffer(mat.as_buffer(), np.float32).reshape(-1, batch.column("a_dim")[r].as_py())
        return (mat[at.values.to_numpy()], rows.values.take(at.values)) if at.is_valid else (mat, rows.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = one and batch.column("a_own")[r] == batch.column("b_own")[r]
                (x, ids), (y, nids) = block(batch, r, "a"), block(batch, r, "b")
                for i, j, cos in _pairs_at(x, y, threshold, same):
                    u, v, score = ids.take(pa.array(i)).flatten(), nids.take(pa.array(j)).flatten(), pa.array(cos)
                    yield pa.RecordBatch.from_arrays([*u, *v, score], names)
                    if both:
                        yield pa.RecordBatch.from_arrays([*v, *u, score], names)
                if same and include_self:
                    yield pa.RecordBatch.from_arrays([*ids.flatten(), *ids.flatten(), pa.array(np.ones(len(ids)))], names)

    schema = T.StructType([*fields.fields, *[T.StructField(f"n{f.name}", f.dataType) for f in fields.fields], T.StructField("score", T.DoubleType())])
    return (a.join(b.hint("shuffle_replicate_nl"), meet)
            .select("a_own", "b_own", "a_dim", "a_mat", "b_mat", "a_rows", "b_rows", "a_at", "b_at").mapInArrow(run, schema))


def vector_neighbors(vecs: DataFrame, threshold: float, include_self: bool = True,
                     block_rows: int | None = None, max_pivots: int = MAX_PIVOTS,
                     asking: DataFrame | None = None) -> DataFrame:
    """C3 on non-zero vectors: (vid1, vid2, nvid1, nvid2, score) for every
    ordered pair with cosine >= threshold (both directions), plus self pairs.
    Exact: no pair is missed, whatever the number of vectors. With ``asking``
    (vid1, vid2), only pairs with at least one of these: a batch against a large
    state never compares the state with itself.

    The vectors are moved once, into blocks (see ``pack_blocks``); blocks meet as matrix
    products (see ``block_pairs``), so neither what is moved nor a task's memory grows
    with the number of comparisons."""
    packed = pack_blocks(vecs.select("vid1", "vid2", "vec"), block_rows, max_pivots, asking)
    return block_pairs(packed, packed, threshold, include_self, both=True)


def vector_pairs(df: DataFrame, id_col: str, order_col: str, vec_col: str,
                 threshold: float = 0.92, with_counts: bool = False) -> DataFrame:
    """C3 report: (left_id earlier, right_id later, score) for every pair of
    distinct vectors with cosine >= threshold, each vector represented by
    its earliest row. Copies of one vector are counted (``with_counts``
    adds n_left / n_right), never paired, so a group of copies costs one row."""
    reps = _earliest(df, id_col, order_col, vec_col)
    # the earliest row of a vector travels with it, so that the pairs are not joined any more
    packed = pack_blocks(distinct_vectors(df, vec_col).join(reps, ["vid1", "vid2"]))
    return _report(block_pairs(packed, packed, threshold), with_counts)


def _earliest(df: DataFrame, id_col: str, order_col: str, vec_col: str) -> DataFrame:
    """(vid1, vid2, ord, id, n): the earliest row of each vector and the number of its copies."""
    v1, v2 = vector_id(vec_col)
    rows = df.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(order_col).alias("ord"),
        v1.alias("vid1"), v2.alias("vid2"))
    return (rows.groupBy("vid1", "vid2").agg(F.min(F.struct("ord", "id")).alias("first"), F.count("*").alias("n"))
            .select("vid1", "vid2", "first.*", "n"))


def _report(near: DataFrame, with_counts: bool) -> DataFrame:
    earlier = F.struct("ord", "id") < F.struct("nord", "nid")
    pick = lambda x, y: F.when(earlier, F.col(x)).otherwise(F.col(y))
    out = near.select(pick("id", "nid").alias("left_id"), pick("nid", "id").alias("right_id"),
                      F.round("score", 6).alias("score"), pick("n", "nn").alias("n_left"), pick("nn", "n").alias("n_right"))
    return out if with_counts else out.drop("n_left", "n_right")


def pair_report(df: DataFrame, id_col: str, order_col: str, vec_col: str, near: DataFrame, with_counts: bool = False) -> DataFrame:
    """Neighbour pairs of distinct vectors (vid1, vid2, nvid1, nvid2, score), each once,
    as pairs of the earliest rows that hold them."""
    reps = _earliest(df, id_col, order_col, vec_col)
    other = reps.select(*[F.col(c).alias(f"n{c}") for c in reps.columns])
    return _report(near.join(reps, ["vid1", "vid2"]).join(other, ["nvid1", "nvid2"]), with_counts)


# ----------------------------------------------------------------------------
# C4: k-NN search; C5: nearest centroid
# ----------------------------------------------------------------------------

def _unit_rows(vectors: list) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    if m.size == 0:
        return m.reshape(0, 0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, m / np.where(n > 0, n, 1.0), np.nan)


QUERY_BLOCK = 2048     # queries per pass over the corpus
SCORE_ROWS = 1024      # corpus rows scored at a time


def knn_search(queries: DataFrame, corpus: DataFrame, k: int = 20, threshold: float = 0.7,
               q_id: str = "query_id", q_vec: str = "qvec", c_id: str = "id",
               c_vec: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """C4: per query, the top ``k`` corpus rows with cosine >= threshold, by
    score desc then corpus id. Returns (q_id, c_id, score, rank).

    Queries go in blocks dealt by hash, about ``query_block`` each: a block is
    broadcast and the corpus scanned once for it; each partition keeps its
    local top ``k`` per query, and a window over those picks the winners. Any
    number of queries is answered."""
    spark = corpus.sparkSession
    n_blocks = max(1, -(-queries.count() // query_block))
    dealt = queries.select(q_id, q_vec).withColumn("_b", F.pmod(F.xxhash64(F.col(q_id).cast("string")), F.lit(n_blocks)))
    id_type = corpus.schema[c_id].dataType
    qid_type = queries.schema[q_id].dataType
    schema = T.StructType([T.StructField(q_id, qid_type), T.StructField(c_id, id_type),
                           T.StructField("score", T.DoubleType())])

    def local_topk(shared):
        def run(it):
            ids, Q = shared.value
            ids = np.asarray(ids, dtype=object)
            best: list = []                    # local winners so far: (query number, corpus id, score)
            for pdf in it:
                pdf = pdf[pdf[c_vec].notna()]
                for at in range(0, len(pdf) if len(ids) else 0, SCORE_ROWS):
                    some = pdf.iloc[at:at + SCORE_ROWS]
                    S = _unit_rows(list(some[c_vec])) @ Q.T
                    row, q = np.nonzero(S >= threshold)
                    best.append(pd.DataFrame({"q": q, c_id: some[c_id].to_numpy()[row], "score": np.minimum(S[row, q], 1.0)}))
                if len(best) > 1:
                    best = [_top(pd.concat(best, ignore_index=True))]
            if best:
                top = _top(pd.concat(best, ignore_index=True))
                yield pd.DataFrame({q_id: ids[top["q"].to_numpy()], c_id: top[c_id].to_numpy(), "score": top["score"].to_numpy()})

        def _top(found):
            found = found.sort_values(["q", "score", c_id], ascending=[True, False, True], kind="stable")
            return found[found.groupby("q").cumcount() < k]
        return run

    local = None
    for b in range(n_blocks):
        rows = dealt.where(F.col("_b") == b).collect()
        mat = _unit_rows([r[1] for r in rows]) if rows else np.zeros((0, 1))
        part = corpus.select(c_id, c_vec).mapInPandas(
            local_topk(spark.sparkContext.broadcast(([r[0] for r in rows], mat))), schema)
        local = part if local is None else local.unionByName(part)
    w = Window.partitionBy(q_id).orderBy(F.desc("score"), F.col(c_id))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assign_to_centroid(articles: DataFrame, clusters: DataFrame, threshold: float = 0.75,
                       max_active: int = 100, a_vec: str = "embedding",
                       cluster_id: str = "id", centroid: str = "centroid",
                       order_cols: list | None = None, dim: int | None = None) -> DataFrame:
    """Compare every article with the newest ``max_active`` active
    centroids (listed by ``order_cols``, newest first); the best cosine wins,
    ties go to the earlier listed; join when score >= threshold. Adds
    ``match_id`` (null when no match) and ``match_score``.

    The candidate set is bounded by ``max_active`` (the reference's own
    bound), so it ships as a broadcast matrix and articles are scanned once."""
    spark = articles.sparkSession
    order_cols = order_cols or [F.desc("last_activity"), F.col(cluster_id)]
    cl = clusters
    if "status" in clusters.columns:
        cl = cl.where(F.col("status") == "active")
    cl = cl.where(F.col(centroid).isNotNull())
    if dim is not None:
        cl = cl.where(F.size(centroid) == dim)
    rows = cl.orderBy(*order_cols).select(cluster_id, centroid).limit(max_active).collect()
    cids = [r[0] for r in rows]
    cmat = _unit_rows([r[1] for r in rows]) if rows else np.zeros((0, 1))
    bc = spark.sparkContext.broadcast(cmat)

    @F.pandas_udf("place int, score double")
    def best_of(vectors: pd.Series) -> pd.DataFrame:
        place, score = np.full(len(vectors), -1), np.full(len(vectors), np.nan)
        has = np.flatnonzero(vectors.notna().to_numpy())
        if len(bc.value) and len(has):
            S = np.minimum(_unit_rows(list(vectors.iloc[has])) @ bc.value.T, 1.0)
            place[has] = np.argmax(np.nan_to_num(S, nan=-np.inf), axis=1)
            score[has] = S[np.arange(len(has)), place[has]]
        return pd.DataFrame({"place": place.astype(np.int32), "score": score})

    # only the vector goes through Python; ids come back by their place in the list
    names = F.array(*[F.lit(c) for c in cids]) if cids else F.array(F.lit(None))
    found = articles.withColumn("_best", best_of(F.col(a_vec)))
    score = F.when(~F.isnan("_best.score"), F.col("_best.score"))
    return (found.withColumn("match_score", score)
            .withColumn("match_id", F.when(score >= threshold, F.element_at(names, F.col("_best.place") + 1))
                        .cast(clusters.schema[cluster_id].dataType))
            .select(*articles.columns, "match_id", "match_score"))
