"""C3 at scale: approximate similarity join by sign random projections.

A bit of a signature says on which side of a random plane a vector lies; two vectors
at angle a agree on it with probability 1 - a / pi. ``bands`` bits make a key; pairs
that share the key of any of ``tables`` keys are candidates and are checked
exactly. ``plan_bands`` takes the cheapest (bits, tables) that finds a pair at the
threshold with the wanted probability (closer pairs are found more surely).

Scale: vectors are packed once; a task takes a table (or some), and of many vectors one slice of its
keys, reads all packed vectors, makes their keys and compares those of one bucket, as products
where it is long. No row of a key is written or shuffled. A pair is handed on by the first table it
shares only. Buckets of more than ``PAIR_BUCKET`` vectors (a hot signature) are cut into blocks, and their
pairs of blocks shared out to tasks. Copies of one vector are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, with_tasks
from .vectors import PAIR_ROWS, _exact, _near_at, _unit, _unit32, distinct_vectors, pair_report, vec_bytes

PAIR_BUCKET = 8192       # distinct vectors up to which one task compares a bucket
BLOCK_ROWS = 4096        # vectors of a hot bucket's block
ROW_COST = 1000          # moving a row against comparing two signatures
SKETCH_WORDS = 4         # 64-bit words of the shortest signature
MAX_WORDS = 32
CHANCE_Z = 3.7           # a signature is long enough when chance pairs lie so many standard deviations beyond the limit
SKETCH_SLACK = 4.0       # standard deviations a pair at the threshold may differ more than expected
MAX_BITS = 48
PACKED_BYTES = 1 << 20   # of vectors in a packed row
SLICE_BYTES = 64 << 20  # of vectors that a task holds, on average
SHORT_BUCKET = 64        # vectors from which a bucket is compared as a product
KEYED_ROWS = 8192        # vectors whose keys are made at a time
TASKS_PER_CORE = 4       # at least, while there are tables
EARLY_TABLES = 4         # whose keys a task holds beside those of its own table
SAMPLE_ROWS = 4096       # vectors that show how large buckets are
SAMPLE_LEAST = 16        # of them in a bucket, or it is not known to be large
MAX_PARTS = 64           # tasks that share the long buckets of a table
SEED = 11


def agreement(threshold: float) -> float:
    """Probability that two vectors with this cosine lie on one side of a random plane."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def plan_bands(rows: int, threshold: float, recall: float, row_cost: float = 8) -> tuple[int, int]:
    """(bits per key, tables): the recall is reached at the threshold, and rows moved
    (each as costly as ``row_cost`` pairs) plus chance pairs met in the buckets are fewest."""
    p, best = agreement(threshold), None
    for bits in range(1, MAX_BITS + 1):
        hit = p ** bits
        tables = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        cost = tables * (row_cost + rows / 2 ** bits)
        if best is None or cost < best[0]:
            best = (cost, bits, tables)
    return best[1], best[2]


def sketch_limit(threshold: float, words: int = SKETCH_WORDS) -> int:
    """Differing signature bits up to which a pair stays a candidate."""
    n, q = 64 * words, 1 - agreement(threshold)
    return min(n, math.ceil(n * q + SKETCH_SLACK * math.sqrt(n * q * (1 - q))))


def signature_words(threshold: float, bits: int, tables: int) -> int:
    """64-bit words of a signature: sketch and all keys, and enough for the limit to tell chance pairs."""
    words = SKETCH_WORDS - (-bits * tables // 64)
    while words < MAX_WORDS and 32 * words - CHANCE_Z * math.sqrt(16 * words) < sketch_limit(threshold, words):
        words += 1
    return words


def signatures(vecs: DataFrame, bits: int, tables: int, seed: int = SEED, keep: tuple[str, ...] = ("vid1", "vid2"),
               words: int = 0) -> DataFrame:
    """``(*keep, vb, sig binary, keys array<long>)`` of ``vecs(vec, ...)``; the signature has
    ``SKETCH_WORDS``, the bits of the keys and what ``words`` words need besides. Vectors of another dimension have planes of their own and another key space."""
    start, width = 64 * SKETCH_WORDS, max(64 * words, 64 * SKETCH_WORDS + bits * tables)

    @F.pandas_udf("sig binary, keys array<long>")
    def sign(blobs: pd.Series) -> pd.DataFrame:
        sig, keys = np.empty(len(blobs), object), np.empty(len(blobs), object)
        size = blobs.str.len().to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            planes = np.random.default_rng([seed, int(d)]).standard_normal((d // 4, width), np.float32)
            side = _unit32([blobs.iat[i] for i in at]) @ planes >= 0
            key = side[:, start:start + bits * tables].reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
            for i, s, k in zip(at, np.packbits(side, axis=1), key):
                sig[i], keys[i] = s.tobytes(), k ^ ((int(d) & 0xFFF) << 50)
        return pd.DataFrame({"sig": sig, "keys": keys})

    return (vecs.select(*keep, vec_bytes("vec").alias("vb")).withColumn("s", sign("vb"))
            .select(*keep, "vb", "s.sig", "s.keys"))


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one dimension as bytes, ``PACKED_BYTES`` to a row."""
    for batch in batches:
        size = pc.binary_length(batch.column("vb")).to_numpy()
        for width in np.unique(size):
            at, rows = np.flatnonzero(size == width), max(1, PACKED_BYTES // int(width))
            for k in range(0, len(at), rows):
                some = batch.take(pa.array(at[k:k + rows]))
                ids = np.stack([some.column(c).to_numpy() for c in ("vid1", "vid2")], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([int(width) // 4], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                                                  pa.array([b"".join(some.column("vb").to_pylist())], pa.binary())], ["dim", "ids", "mat"])


def _table_keys(unit: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """(rows, tables) keys of unit rows, a plane in a column of ``planes``."""
    powers = 1 << np.arange(bits, dtype=np.int64)[::-1]
    return np.concatenate([(unit[at:at + KEYED_ROWS] @ planes >= 0).reshape(min(KEYED_ROWS, len(unit) - at), -1, bits) @ powers
                           for at in range(0, len(unit), KEYED_ROWS)] or [np.zeros((0, planes.shape[1] // bits), np.int64)])


def _alike(unit: np.ndarray, key: np.ndarray, threshold: float, block_rows: int, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the unit rows with one key, sorted by it, that are near. Long buckets are compared as products, a ``part`` of their
    pairs of blocks in each task; of short ones, which the first part has, each row with those some places after it."""
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    starts = np.append(0, ends[:-1])
    long = ends - starts > SHORT_BUCKET
    n = 0
    for lo, hi in zip(starts[long], ends[long]):
        cut = [*range(lo, hi, block_rows), hi]
        spans = list(zip(cut, cut[1:]))
        for x, (xl, xh) in enumerate(spans):
            for yl, yh in spans[x:]:
                if n % parts == part:
                    for i, j in _near_at(unit[xl:xh], unit[yl:yh], threshold, xl == yl):
                        yield i + xl, j + yl
                n += 1
    if part or long.all():
        return
    left, step = np.flatnonzero(np.repeat(~long, ends - starts)), 0
    while len(left):
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        for at in range(0, len(left), PAIR_ROWS):
            i = left[at:at + PAIR_ROWS]
            i = i[np.einsum("ij,ij->i", unit[i], unit[i + step]) >= threshold - 1e-4]
            yield i, i + step


def _share_none(a: np.ndarray, b: np.ndarray, planes: np.ndarray, bits: int, at: int, upto: int) -> np.ndarray:
    """Places of the rows of ``a`` and ``b``, side by side, that share the key of none of the tables from ``at`` on; few tables at
    first, as near pairs share one soon."""
    left, size = np.arange(len(a)), 4
    while at < upto and len(left):
        some = planes[:, at * bits:min(at + size, upto) * bits]
        alike = ((a[left] @ some >= 0) == (b[left] @ some >= 0)).reshape(len(left), -1, bits).all(axis=2).any(axis=1)
        left, at, size = left[~alike], at + size, 2 * size
    return left


def neighbors_lsh(vecs: DataFrame, threshold: float, recall: float = 0.99, bits: int | None = None, tables: int | None = None,
                  pair_bucket: int = PAIR_BUCKET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vid1, vid2, nvid1, nvid2, score)``: pairs of ``vecs(vid1, vid2, vec)`` with cosine >=
    threshold, each once. A pair is found with probability ``recall`` or more; scores are exact."""
    packed = cut_lineage(vecs.select("vid1", "vid2", vec_bytes("vec").alias("vb")).mapInArrow(_pack_vectors, "dim int, ids binary, mat binary"))
    rows, size = packed.agg(F.sum(F.length("ids") / 16), F.sum(F.length("mat"))).first()
    rows, size = int(rows or 0), size or 0
    if bits is None or tables is None:
        bits, tables = plan_bands(max(rows, 1), threshold, recall, ROW_COST)
    start, words = 64 * SKETCH_WORDS, signature_words(threshold, bits, tables)
    width = max(64 * words, start + bits * tables)
    planes_of = lambda dim: np.random.default_rng([SEED, 4 * dim]).standard_normal((dim, width), np.float32)[:, start:start + bits * tables]
    # a task holds the vectors of one slice of the keys; more than one table, if there is one slice only
    slices = max(1, -(-size // SLICE_BYTES))
    tasks = -(-tables // max(1, tables // (TASKS_PER_CORE * vecs.sparkSession.sparkContext.defaultParallelism))) if slices == 1 else tables
    # the largest bucket as a sample shows it: what is beyond ``pair_bucket`` is shared out
    some = packed.select("dim", "mat").orderBy(F.xxhash64("ids")).limit(1).first()
    parts = 1
    if some is not None:
        mat = np.frombuffer(some.mat, np.float32).reshape(-1, some.dim)
        mat = mat[::-(-len(mat) // SAMPLE_ROWS)]
        most = max(int(np.unique(k, return_counts=True)[1].max()) for k in _table_keys(_unit(mat), planes_of(some.dim), bits).T)
        parts = max(1, min(MAX_PARTS, -(-(most * rows // len(mat)) // pair_bucket))) if most > SAMPLE_LEAST else 1
    names = ["vid1", "vid2", "nvid1", "nvid2", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, planes, mine = {}, {}, range(0)
        for batch in batches:
            task, cut = divmod(batch.column("task")[0].as_py(), slices * parts)
            cut, part = divmod(cut, parts)
            mine = range(task, tables, tasks)
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                mat = np.frombuffer(batch.column("mat")[r].as_buffer(), np.float32).reshape(-1, dim)
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64).reshape(-1, 2)
                if dim not in planes:
                    planes[dim] = planes_of(dim)
                if slices > 1:
                    key = _table_keys(_unit(mat), planes[dim][:, task * bits:(task + 1) * bits], bits)[:, 0]
                    at = np.flatnonzero((key * 0x9E3779B1 >> 8) % slices == cut)
                    mat, ids = mat[at], ids[at]
                else:
                    mat, ids = mat.copy(), ids.copy()
                held.setdefault(dim, []).append((mat, ids))
        for dim in list(held):
            mat, ids = (np.concatenate(c) for c in zip(*held.pop(dim)))
            unit = _unit(mat)
            first = _table_keys(unit, planes[dim][:, :EARLY_TABLES * bits], bits)
            for t in mine:
                key = _table_keys(unit, planes[dim][:, t * bits:(t + 1) * bits], bits)[:, 0]
                order = np.argsort(key, kind="stable")
                mat, unit, ids, key, first = mat[order], unit[order], ids[order], key[order], first[order]
                for i, j in _alike(unit, key, threshold, block_rows, part, parts):
                    new = ~(first[i, :t] == first[j, :t]).any(axis=1)       # a pair comes from the first table it shares
                    i, j = i[new], j[new]
                    for at in range(0, len(i), KEYED_ROWS):
                        a, b = i[at:at + KEYED_ROWS], j[at:at + KEYED_ROWS]
                        new = _share_none(unit[a], unit[b], planes[dim], bits, first.shape[1], t)
                        a, b = a[new], b[new]
                        ok, cos = _exact(mat[a], mat[b], threshold)
                        yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (*ids[a].T, *ids[b].T, cos)], names)

    pairs = with_tasks(packed, tasks * slices * parts).mapInArrow(run, "vid1 long, vid2 long, nvid1 long, nvid2 long, score double")
    # a product may put a vector that lies in a plane on either side of it, so that a pair comes from two tables
    one, other = F.struct("vid1", "vid2"), F.struct(F.col("nvid1").alias("vid1"), F.col("nvid2").alias("vid2"))
    return (pairs.select(F.least(one, other).alias("l"), F.greatest(one, other).alias("r"), "score").groupBy("l", "r").agg(F.max("score").alias("score"))
            .select("l.vid1", "l.vid2", F.col("r.vid1").alias("nvid1"), F.col("r.vid2").alias("nvid2"), "score"))


def vector_pairs_lsh(df: DataFrame, id_col: str, order_col: str, vec_col: str, threshold: float = 0.92,
                     recall: float = 0.99, with_counts: bool = False, **plan) -> DataFrame:
    """C3 report as :func:`..vectors.vector_pairs` gives it, by signatures instead of
    all blocks: ``(left_id earlier, right_id later, score)`` of distinct vectors with
    cosine >= threshold, each found with probability ``recall`` or more. Null and
    zero vectors pair with nothing; an empty table gives no rows."""
    near = neighbors_lsh(distinct_vectors(df, vec_col), threshold, recall, **plan)
    return pair_report(df, id_col, order_col, vec_col, near, with_counts)
