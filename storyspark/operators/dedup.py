"""Two-stage near-duplicate removal: C1 URL guard, D1 SimHash, C2 SimHash
neighbours, C3 vector neighbours and K1, the order-exact decision.

K1 rule (the reference's sequential loop): in arrival order, a row is dropped
when an earlier *kept* row matches it -- same url_hash (silent skip), SimHash
distance <= limit while the kept row's entry is alive (t_kept + window > t),
or vector cosine >= threshold; otherwise it is kept. The kept set is the
lexicographically first maximal independent set of that match graph; it is
computed in parallel: one round keeps every row without an earlier
neighbour, a second drops their neighbours, and what is left falls apart into
components of rows that share keys, each decided in one task by the sequential
rule itself. Only components beyond ``COMPONENT_ROWS`` go round again, so chains
do not cost a round per link, and there is no cap on rounds. Where vectors have many
neighbours, heads of the rows are decided one after another instead, and only the kept
ones are compared with the rest (``kept_neighbors``).

Scale notes
* Copies never become row pairs. Neighbour relations are built between
  *distinct* fingerprints / vectors; rows look them up by key.
* Each round is one as-of lookup ("latest kept / undecided row before me with
  key k") done by a window partitioned by (key, arrival bucket) -- no task
  holds more than one bucket of rows even if one key holds a third of the
  data -- plus a per-bucket summary carried across buckets.
* Rounds cut lineage with reliable checkpoints (spark.checkpoint.dir).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.simhash import hamming, simhash128
from ..session import cut_lineage, spread, with_tasks
from .components import smallest_reachable
from .vectors import block_pairs, key_vectors, known_vectors, pack_blocks, pick_vectors, vector_neighbors

K_URL, K_SIM, K_VEC = 0, 1, 2
COMPONENT_ROWS = 100_000     # rows of a component that one task decides
COMPONENT_ASKS = 10          # keys that they ask for, a row on average
ONE_TASK_ROWS = 16_384       # undecided rows up to which components are not told apart
LONG_KEY = 32                # bits of a key that few fingerprints share by chance
ROW_COST = 12                # moving a row against comparing two fingerprints
MAX_TOGETHER = 3             # blocks of a key at most
PACKED_PRINTS = 1 << 15      # fingerprints of a packed row
SLICE_PRINTS = 1 << 22       # that a task sorts by one key, on average
PAIRS_AT_ONCE = 1 << 20
HEAD_ROWS = 4096             # rows that the first step of the vector stage decides; each later step takes twice as many
FEW_NEAR = 8                 # neighbours of a vector, on average, up to which all are listed


def _materialize(df: DataFrame) -> DataFrame:
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def known_url_guard(new: DataFrame, stored: DataFrame, key: str = "url_hash") -> DataFrame:
    """Drop incoming rows whose key is already stored (anti-join)."""
    return new.join(stored.select(key), key, "left_anti")


def with_simhash(df: DataFrame, text_col: str = "content", partitions: int | None = None) -> DataFrame:
    """Add sim_hi / sim_lo (128-bit SimHash of the normalized text)."""
    return (spread(df, partitions).withColumn("_sh", simhash128(F.col(text_col)))
              .withColumn("sim_hi", F.col("_sh.sim_hi"))
              .withColumn("sim_lo", F.col("_sh.sim_lo")).drop("_sh"))


def plan_blocks(rows: int, limit: int) -> tuple[int, int]:
    """(blocks of the 128 bits, blocks per key) with which rows moved (each as costly as ``ROW_COST``
    pairs) plus chance pairs of so many fingerprints are fewest. Of limit + k blocks, a pair within the limit
    agrees on k at least."""
    cost = lambda k: math.comb(limit + k, k) * (ROW_COST + rows / 2 ** (128 * k / (limit + k)))
    k = min((k for k in range(1, MAX_TOGETHER + 1) if k == 1 or limit + k <= 128), key=cost)
    return limit + k, k


def block_masks(blocks: int, together: int) -> list[tuple[int, int]]:
    """(high, low) halves, signed, of the bits that each choice of ``together`` of the blocks covers."""
    bounds = [round(i * 128 / blocks) for i in range(blocks + 1)]
    each = [(1 << e) - (1 << s) for s, e in zip(bounds, bounds[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(sum(c) >> 64), signed(sum(c) & (1 << 64) - 1)) for c in combinations(each, together)]


def _prints_by_keys(fp: DataFrame, all_masks: list[tuple[int, int]], limit: int, asked: bool) -> DataFrame:
    """(hi, lo, nhi, nlo, dist) of the distinct fingerprints ``fp(hi, lo[, asks])`` that share a key, joined by it: smaller side first,
    or with ``asked`` every pair whose first side asks."""
    masks = F.array(*[F.struct(F.lit(h).cast("long").alias("hi"), F.lit(w).cast("long").alias("lo")) for h, w in all_masks])
    ex = fp.select(*fp.columns, F.posexplode(masks).alias("bno", "m")).select(
        F.xxhash64("bno", F.col("hi").bitwiseAND(F.col("m.hi")), F.col("lo").bitwiseAND(F.col("m.lo"))).alias("key"), "bno", *fp.columns)
    l, r = (ex.where("asks") if asked else ex).alias("l"), ex.alias("r")
    if asked:
        side = (F.col("l.hi") != F.col("r.hi")) | (F.col("l.lo") != F.col("r.lo"))
    else:
        side = (F.col("l.hi") < F.col("r.hi")) | ((F.col("l.hi") == F.col("r.hi")) & (F.col("l.lo") < F.col("r.lo")))
    differ = lambda m: (F.col("l.hi").bitwiseXOR(F.col("r.hi")).bitwiseAND(m["hi"])
                        .bitwiseOR(F.col("l.lo").bitwiseXOR(F.col("r.lo")).bitwiseAND(m["lo"])) != 0)
    first_key = ~differ(F.element_at(masks, F.col("l.bno") + 1)) & F.forall(F.slice(masks, 1, F.col("l.bno")), differ)
    near = hamming("l.hi", "l.lo", "r.hi", "r.lo") <= limit
    # nearly all pairs that share a key by chance end at the distance
    return (l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.bno") == F.col("r.bno")))
             .where(F.when(near, side & first_key).otherwise(False))
             .select(F.col("l.hi").alias("hi"), F.col("l.lo").alias("lo"),
                     F.col("r.hi").alias("nhi"), F.col("r.lo").alias("nlo"))
             .withColumn("dist", hamming("hi", "lo", "nhi", "nlo")))


def _pack_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints as bytes, some thousands to a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACKED_PRINTS):
            some = batch.slice(at, PACKED_PRINTS)
            cols = [some.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "asks")]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols], ["hi", "lo", "asks"])


def _prints_by_masks(fp: DataFrame, rows: int, all_masks: list[tuple[int, int]], limit: int, asked: bool) -> DataFrame:
    """As ``_prints_by_keys``, without a row per key: a task takes one mask and, of a large table, one slice of its keys,
    reads all packed fingerprints (16 bytes each), and sorts those of the slice by key. Nothing but the pairs is written."""
    masks = np.array(all_masks, np.int64).view(np.uint64).reshape(-1, 2)
    slices = max(1, -(-rows // SLICE_PRINTS))
    packed = cut_lineage(fp.where(F.col("hi").isNotNull() & F.col("lo").isNotNull()).select("hi", "lo", "asks").mapInArrow(
        _pack_prints, "hi binary, lo binary, asks binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            task = batch.column("task")[0].as_py()
            m = masks[task // slices]
            for r in range(batch.num_rows):
                hi, lo = (np.frombuffer(batch.column(c)[r].as_buffer(), np.uint64) for c in ("hi", "lo"))
                key = (hi & m[0]) * np.uint64(0x9E3779B97F4A7C15) ^ (lo & m[1]) * np.uint64(0xC2B2AE3D27D4EB4F)
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                at = np.flatnonzero((key >> np.uint64(32)) % np.uint64(slices) == task % slices)
                held.append((key[at], hi[at], lo[at], np.frombuffer(batch.column("asks")[r].as_buffer(), np.bool_)[at]))
        if not held:
            return
        key, hi, lo, asks = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(key)
        key, hi, lo, asks = key[order], hi[order], lo[order], asks[order]
        left, step = np.arange(len(key)), 0
        while len(left):                        # each with the one ``step`` places after it, while the key is the same
            step += 1
            left = left[left + step < len(key)]
            left = left[key[left] == key[left + step]]
            for at in range(0, len(left), PAIRS_AT_ONCE):
                i = left[at:at + PAIRS_AT_ONCE]
                j = i + step
                x, y = hi[i] ^ hi[j], lo[i] ^ lo[j]
                dist = np.bitwise_count(x) + np.bitwise_count(y)
                ok = np.flatnonzero(dist <= limit)
                ok = ok[((x[ok] & m[0]) | (y[ok] & m[1])) == 0]
                for earlier in masks[:task // slices]:       # a pair comes from the first key it shares
                    ok = ok[((x[ok] & earlier[0]) | (y[ok] & earlier[1])) != 0]
                i, j, dist = i[ok], j[ok], dist[ok].astype(np.int32)
                a, b = ((hi[k].view(np.int64), lo[k].view(np.int64)) for k in (i, j))
                if asked:
                    for u, v, some in ((a, b, asks[i]), (b, a, asks[j])):
                        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (*u, *v, dist)], names)
                else:
                    swap = (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] > b[1]))
                    u, v = ([np.where(swap, q, p) for p, q in zip(c, d)] for c, d in ((a, b), (b, a)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*u, *v, dist)], names)

    names = ["hi", "lo", "nhi", "nlo", "dist"]
    return with_tasks(packed, len(masks) * slices).mapInArrow(run, "hi long, lo long, nhi long, nlo long, dist int")


def simhash_neighbors(fps: DataFrame, limit: int = 3, include_self: bool = True,
                      asking: DataFrame | None = None, once: bool = False) -> DataFrame:
    """C2 on distinct fingerprints: (hi, lo, nhi, nlo, dist) for every ordered
    pair within Hamming ``limit`` (both directions, optional self pairs). With
    ``asking`` (sim_hi, sim_lo), only pairs whose first side is one of these; with
    ``once``, each pair smaller side first.

    Blocks of bits: a pair within the limit agrees on all blocks of some key. Keys of one
    block (limit + 1 of them) do while they are long; where chance pairs would grow with the
    square of the fingerprints, keys are of more blocks (``plan_blocks``), and as many keys
    would be many rows, they are made where they are compared (``_prints_by_masks``). A pair is emitted
    only from the first key on which it agrees, so no distinct shuffle is needed."""
    fp = fps.select(F.col("sim_hi").alias("hi"), F.col("sim_lo").alias("lo"))
    blocks, together = limit + 1, 1
    far = 128 // blocks < LONG_KEY
    if far:
        # by number, as rows of a few bytes would be put together into one task
        parts = max(int(fp.sparkSession.conf.get("spark.sql.shuffle.partitions")), fp.sparkSession.sparkContext.defaultParallelism)
        fp = cut_lineage(fp.repartition(parts, "hi", "lo").dropDuplicates())
        rows = fp.count()
        blocks, together = plan_blocks(rows, limit)
    else:
        fp = fp.dropDuplicates()
    all_masks = block_masks(blocks, together)
    told = fp
    if asking is not None:
        some = asking.select(F.col("sim_hi").alias("hi"), F.col("sim_lo").alias("lo")).distinct()
        told = fp.join(some.withColumn("asks", F.lit(True)), ["hi", "lo"], "left").select("hi", "lo", F.coalesce("asks", F.lit(False)).alias("asks"))
        fp = fp.join(some, ["hi", "lo"], "left_semi")
    if far:
        pairs = _prints_by_masks(told if asking is not None else told.withColumn("asks", F.lit(True)), rows, all_masks, limit, asking is not None)
    else:
        pairs = _prints_by_keys(told, all_masks, limit, asking is not None)
    swapped = F.struct(F.col("nhi").alias("hi"), F.col("nlo").alias("lo"), F.col("hi").alias("nhi"), F.col("lo").alias("nlo"))
    # not a union of the pairs with themselves, which would join twice
    both = pairs if once or asking is not None else pairs.select(
        F.explode(F.array(F.struct("hi", "lo", "nhi", "nlo"), swapped)).alias("p"), "dist").select("p.*", "dist")
    if include_self:
        both = both.unionByName(fp.select("hi", "lo", F.col("hi").alias("nhi"),
                                          F.col("lo").alias("nlo"), F.lit(0).alias("dist")))
    return both


def simhash_pairs(df: DataFrame, limit: int = 3) -> DataFrame:
    """C2 report: distinct fingerprint pairs (a < b) within ``limit``, with
    how many rows carry each side. Copies are counted, never paired; the fingerprints of
    ``df`` are computed once."""
    counts = cut_lineage(df.groupBy(F.col("sim_hi").alias("hi"), F.col("sim_lo").alias("lo")).agg(
        F.count("*").alias("n")))
    nb = simhash_neighbors(counts.select(F.col("hi").alias("sim_hi"), F.col("lo").alias("sim_lo")), limit, include_self=False, once=True)
    c2 = counts.select(F.col("hi").alias("nhi"), F.col("lo").alias("nlo"), F.col("n").alias("nn"))
    return nb.join(counts, ["hi", "lo"]).join(c2, ["nhi", "nlo"])


# ----------------------------------------------------------------------------
# K1
# ----------------------------------------------------------------------------

def _asof_latest(queries: DataFrame, sources: DataFrame, bucket_size: int,
                 single_bucket: bool = False) -> DataFrame:
    """For each query (rid, kt, ks, k1, k2, a, ...) find the latest source row
    with the same key and a smaller arrival, separately for kept ('K') and
    undecided ('U') sources. Adds k_last struct<a,t,id> and u_last struct<a,t>."""
    key = ["kt", "ks", "k1", "k2"]
    q = queries.withColumn("bk", F.floor(F.col("a") / bucket_size)).withColumn("side", F.lit(0))
    s = sources.withColumn("bk", F.floor(F.col("a") / bucket_size)).withColumn("side", F.lit(1))
    kept = F.when((F.col("side") == 1) & (F.col("kind") == "K"),
                  F.struct(F.col("a").alias("a"), F.col("t").alias("t"), F.col("sid").alias("id")))
    und = F.when((F.col("side") == 1) & (F.col("kind") == "U"),
                 F.struct(F.col("a").alias("a"), F.col("t").alias("t")))
    u = q.unionByName(s, allowMissingColumns=True)
    w = (Window.partitionBy(*key, "bk").orderBy("a", "side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (u.withColumn("k_in", F.last(kept, ignorenulls=True).over(w))
             .withColumn("u_in", F.last(und, ignorenulls=True).over(w))
             .where(F.col("side") == 0))
    if single_bucket:   # every arrival in one bucket: nothing to carry
        return (inb.withColumnRenamed("k_in", "k_last").withColumnRenamed("u_in", "u_last")
                   .drop("side", "bk", "kind", "sid"))
    # carry: latest kept / undecided in any earlier bucket of the same key
    summ = s.groupBy(*key, "bk").agg(
        F.max(F.when(F.col("kind") == "K", F.struct("a", "t", F.col("sid").alias("id")))).alias("k_b"),
        F.max(F.when(F.col("kind") == "U", F.struct("a", "t"))).alias("u_b"))
    qkeys = q.select(*key, "bk").distinct()
    allk = qkeys.join(summ, key + ["bk"], "full_outer")
    wb = Window.partitionBy(*key).orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (allk.withColumn("k_c", F.last("k_b", ignorenulls=True).over(wb))
                 .withColumn("u_c", F.last("u_b", ignorenulls=True).over(wb))
                 .select(*key, "bk", "k_c", "u_c"))
    out = inb.join(carry, key + ["bk"], "left")
    return (out.withColumn("k_last", F.coalesce("k_in", "k_c"))
               .withColumn("u_last", F.coalesce("u_in", "u_c"))
               .drop("k_in", "u_in", "k_c", "u_c", "side", "bk", "kind", "sid"))


def _decide_component(win_us: int | None):
    """The sequential rule over one component: rows in arrival order, each
    with the keys it asks for and the keys it is known by once kept."""
    def run(asks: pd.DataFrame, owns: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list] = {}
        for rid, key in zip(owns["own_rid"], owns["own_key"]):
            own.setdefault(rid, []).append(key)
        latest: dict = {}                     # key -> time of the latest kept row
        status, at = [], asks.sort_values(["a", "rid"], kind="stable")
        for rid, rows in at.groupby("rid", sort=False):
            t = rows["t"].iat[0]
            blocked = any(k in latest and (not sim or win_us is None or latest[k] > t - win_us)
                          for k, sim in zip(rows["key"], rows["sim"]))
            keep = not blocked and bool(rows["can_keep"].iat[0])
            status.append((rid, "K" if keep else "D"))
            if keep:
                for k in own.get(rid, ()):
                    latest[k] = t
        return pd.DataFrame(status, columns=["rid", "status"])
    return run


def _resolve(queries: DataFrame, sources: DataFrame, undecided: DataFrame, win_us: int | None,
             component_rows: int) -> tuple[DataFrame, DataFrame]:
    """Decide undecided rows whose component has at most ``component_rows``
    rows and ``COMPONENT_ASKS`` times as many keys asked for; returns (rid, status) of
    those and the rids of the others. No kept row may block an undecided one any more."""
    key = F.xxhash64("kt", "ks", "k1", "k2").alias("key")
    owns = cut_lineage(sources.join(undecided, "rid", "left_semi").select("rid", key))
    asks = cut_lineage(queries.join(undecided, "rid", "left_semi")
                       .select("rid", "a", "t", "can_keep", key, (F.col("kt") == K_SIM).alias("sim")))
    n_asked, n_rows = asks.agg(F.count("*"), F.count_distinct("rid")).first()
    if n_rows <= min(ONE_TASK_ROWS, component_rows) and n_asked <= min(ONE_TASK_ROWS, component_rows) * COMPONENT_ASKS:
        # all of it is less than a component may be
        whole = lambda df, *names: df.select(*names, F.lit(0).cast("long").alias("comp"))
        own_side = whole(owns.select(F.col("rid").alias("own_rid"), F.col("key").alias("own_key")), "own_rid", "own_key")
        decided = (whole(asks, *asks.columns).groupBy("comp").cogroup(own_side.withColumnRenamed("comp", "own_comp").groupBy("own_comp"))
                   .applyInPandas(_decide_component(win_us), "rid long, status string"))
        return decided, undecided.where("false").select("rid")
    # a key is a vertex only if an undecided row is known by it; hashes of rows
    # and keys share one space (a clash merges two components, which stay right)
    shared = asks.join(owns.select("key").distinct(), "key", "left_semi").select("rid", "key").union(owns.select("rid", "key"))
    vertex = F.xxhash64(F.lit("row"), F.col("rid"))
    roots = smallest_reachable(shared.select(vertex.alias("u"), F.col("key").alias("v")))
    member = cut_lineage(undecided.withColumn("u", vertex).join(roots, "u", "left")
                         .select("rid", F.coalesce("root", "u").alias("comp")))
    asked = asks.groupBy("rid").agg(F.count("*").alias("asked"))
    sizes = member.join(asked, "rid", "left").groupBy("comp").agg(F.count("*").alias("n"), F.sum("asked").alias("asked"))
    fits = (F.col("n") <= component_rows) & (F.coalesce("asked", F.lit(0)) <= component_rows * COMPONENT_ASKS)
    sized = cut_lineage(member.join(sizes.select("comp", fits.alias("fits")), "comp"))
    small = sized.where("fits").select("rid", "comp")
    rest = sized.where("not fits").select("rid")
    # new names, hence new columns: the two sides of a cogroup must not share one
    own_side = owns.join(small, "rid").select(*[F.col(c).alias(f"own_{c}") for c in ("rid", "key", "comp")])
    decided = (asks.join(small, "rid").groupBy("comp").cogroup(own_side.groupBy("own_comp"))
               .applyInPandas(_decide_component(win_us), "rid long, status string"))
    return decided, rest


def listed_neighbors(packed: DataFrame, threshold: float, sample: int = HEAD_ROWS, few: float = FEW_NEAR) -> DataFrame | None:
    """All neighbours of the packed vectors, both ways and with self pairs, if they are ``few`` a vector; else
    None. About ``sample`` vectors, chosen by hash, tell how many there are."""
    every = packed.agg(F.sum(F.size("rows"))).first()[0] or 0
    pairs = lambda blocks: block_pairs(blocks, blocks, threshold, include_self=True, both=True)
    if every > sample:
        some = packed.select(F.explode("rows").alias("r")).select("r.vid1", "r.vid2").where(
            F.pmod(F.xxhash64("vid1", "vid2"), F.lit(every)) < sample)
        own, met = pairs(pick_vectors(packed, some)).agg(
            F.count_if((F.col("vid1") == F.col("nvid1")) & (F.col("vid2") == F.col("nvid2"))), F.count("*")).first()
        if (met - own) * every > few * own * own:
            return None
    return pairs(packed)


def kept_neighbors(base: DataFrame, packed: DataFrame, threshold: float, head_rows: int = HEAD_ROWS,
                   **rule) -> tuple[DataFrame, DataFrame | None]:
    """(neighbours of the packed vectors as ``vector_neighbors`` gives them, kept rows). Where vectors have
    many neighbours, only the neighbours that are kept are given: K1 decides alike with these. Where they have few,
    all are given, and None for the kept rows. ``base``: the rows as ``dedup_decide`` holds them.

    The first ``head_rows`` open rows by arrival are decided by all neighbours among themselves and by what was
    kept before; rows like a kept vector are closed, and a head of twice the size follows. So rows are compared with
    kept ones, and no list of all pairs is made."""
    near = listed_neighbors(packed, threshold, head_rows)
    if near is not None:
        return near, None
    told = lambda df: df.select("id", "a", F.timestamp_micros("t").alias("t"), "uid", F.col("hi").alias("sim_hi"),
                                F.col("lo").alias("sim_lo"), "vid1", "vid2", F.col("can_keep").alias("vec_ok"))
    open_, found, kept, size = base.where(F.col("a").isNotNull()), [], [], head_rows
    while True:
        edge = open_.where("can_keep").select("a").orderBy("a").limit(size).agg(F.max("a")).first()[0]
        if edge is None:
            break
        head = cut_lineage(open_.where(F.col("a") <= edge))
        some = pick_vectors(packed, head)
        first = dedup_decide(told(head), id_col="id", arrival_col="a", time_col="t", url_col="uid",
                             neighbors=block_pairs(some, some, threshold, include_self=True, both=True),
                             prior_kept=told(reduce(DataFrame.unionByName, kept)) if kept and (rule["use_url"] or rule["use_simhash"]) else None, **rule)
        kept.append(cut_lineage(head.join(first.where("kept").select("a").distinct(), "a", "left_semi")))
        found.append(cut_lineage(block_pairs(pick_vectors(packed, kept[-1]), packed, threshold).select(
            F.col("nvid1").alias("vid1"), F.col("nvid2").alias("vid2"), F.col("vid1").alias("nvid1"), F.col("vid2").alias("nvid2"), "score")))
        later = open_.where(F.col("a") > edge)
        closed = later.join(found[-1].select("vid1", "vid2").distinct(), ["vid1", "vid2"], "left_semi").select("rid").distinct()
        open_ = cut_lineage(later.join(closed, "rid", "left_anti"))
        size *= 2
    if not found:                        # no row that could be kept
        none = base.where("false")
        return none.select("vid1", "vid2", F.col("vid1").alias("nvid1"), F.col("vid2").alias("nvid2"), F.lit(0.0).alias("score")), none
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, kept)


def dedup_decide(rows: DataFrame, *, id_col: str = "url_hash", arrival_col: str = "arrival",
                 time_col: str = "extracted_at", url_col: str = "url_hash",
                 vector_col: str | None = None, hamming_limit: int = 3,
                 window_seconds: float | None = 72 * 3600, cos_threshold: float = 0.92,
                 use_url: bool = True, use_simhash: bool = True,
                 prior_kept: DataFrame | None = None, neighbors: DataFrame | None = None,
                 bucket_size: int = 1 << 18, component_rows: int = COMPONENT_ROWS,
                 packed: DataFrame | None = None, head_rows: int = HEAD_ROWS) -> DataFrame:
    """K1: decide every row. ``rows`` needs id, arrival (unique, processing
    order), time (non-decreasing with arrival), url key, sim_hi/sim_lo and
    optionally a vector column (None disables the vector stage).
    ``use_url`` / ``use_simhash`` switch the other stages off (the cluster
    seed rule is this operator on the cosine graph alone).

    Returns one row per input row with ``kept`` (bool), ``stage`` (null, 'url',
    'simhash', 'vector' or 'no_vector'), ``duplicate_of`` (id of the kept row),
    ``distance`` (SimHash stage) and ``score`` (vector stage). A row is known
    by its arrival, so ids (and urls) may repeat. Naming rule (the reference's
    choice depends on set order): lowest distance / highest cosine, then the
    most recent kept row, then the smallest id.

    ``prior_kept`` (same columns): rows kept by earlier batches (streaming
    state); they count as kept and earlier, and are not returned.

    ``neighbors`` (as ``vector_neighbors`` gives them, self pairs included) may be given if ``rows`` has
    the columns of ``vectors.key_vectors``; ``vector_col`` is then not looked at. Likewise ``packed``, their vectors as
    ``vectors.pack_blocks`` gives them, without ``prior_kept``."""
    use_vec = vector_col is not None or neighbors is not None or packed is not None
    added = use_vec and neighbors is None and packed is None
    if added:
        rows = key_vectors(rows, vector_col)
        prior_kept = None if prior_kept is None else key_vectors(prior_kept, vector_col)
    row_id = lambda prior: F.col(arrival_col).cast("long") * 2 + (1 if prior else 0)

    def _proj(df, prior):
        cols = [row_id(prior).alias("rid"), F.col(id_col).alias("id"), F.col(arrival_col).cast("long").alias("a"),
                F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"),
                (F.col(url_col).cast("string") if use_url else F.lit(None).cast("string")).alias("uid"),
                (F.col("sim_hi") if use_simhash else F.lit(0).cast("long")).alias("hi"),
                (F.col("sim_lo") if use_simhash else F.lit(0).cast("long")).alias("lo"),
                F.lit(prior).alias("prior")]
        if use_vec:
            cols += ["vid1", "vid2", F.col("vec_ok").alias("can_keep")]
        else:
            cols += [F.lit(True).alias("can_keep")]
        return df.select(*cols)

    base = _proj(rows, False)
    if prior_kept is not None:
        base = base.unionByName(_proj(prior_kept, True))
    base = cut_lineage(base.withColumn("can_keep", F.coalesce("can_keep", F.lit(False))))

    # --- static keys: what a row asks for, and what a kept row is known by ---
    none = {"ks": F.lit(""), "k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"),
            "dist": F.lit(None).cast("int"), "score": F.lit(None).cast("double")}

    def keyed(df, kt, *extra, **cols):
        return df.select("rid", *extra, "a", "t", "can_keep", F.lit(kt).alias("kt"),
                         *[cols.get(c, none[c]).alias(c) for c in ("ks", "k1", "k2", "dist", "score")])

    asking = base.where(~F.col("prior"))
    keepable = base.where("can_keep")
    # the url key is always asked for (it is how every row meets the round
    # aggregate); with use_url=False no source carries it, so it never hits
    queries = keyed(asking, K_URL, ks=F.coalesce(F.col("uid"), F.lit("")))
    src_keys = keyed(keepable.where(F.col("uid").isNotNull()), K_URL, "id", ks=F.col("uid"))
    win_us = None if window_seconds is None else int(window_seconds * 1_000_000)
    lo_a, hi_a, lo_t = base.agg(F.min("a"), F.max("a"), F.min(F.when(~F.col("prior"), F.col("t")))).first()
    single = lo_a is None or (lo_a // bucket_size) == (hi_a // bucket_size)
    fresh = base
    if win_us is not None and lo_t is not None:
        # fingerprints of earlier batches that have expired for every new row
        fresh = base.where(~F.col("prior") | (F.col("t") > lo_t - win_us))
    if use_simhash:
        prints = lambda df: df.select(F.col("hi").alias("sim_hi"), F.col("lo").alias("sim_lo"))
        fpn = simhash_neighbors(prints(fresh), hamming_limit, asking=None if prior_kept is None else prints(asking))
        queries = queries.unionByName(keyed(asking.join(fpn, ["hi", "lo"]), K_SIM, k1=F.col("nhi"), k2=F.col("nlo"),
                                            dist=F.col("dist")))
        src_keys = src_keys.unionByName(keyed(fresh.where("can_keep"), K_SIM, "id", k1=F.col("hi"), k2=F.col("lo")))
    decided = None
    if use_vec:
        vn = neighbors
        if vn is None and prior_kept is not None:
            vectors = known_vectors(rows, vector_col).unionByName(known_vectors(prior_kept, vector_col))
            vn = vector_neighbors(vectors, cos_threshold, asking=asking.select("vid1", "vid2"))
        elif vn is None:
            vn, decided = kept_neighbors(base, pack_blocks(known_vectors(rows, vector_col)) if packed is None else packed, cos_threshold, head_rows,
                                         hamming_limit=hamming_limit, window_seconds=window_seconds, use_url=use_url, use_simhash=use_simhash,
                                         bucket_size=bucket_size, component_rows=component_rows)
        queries = queries.unionByName(keyed(asking.where(F.col("vid1").isNotNull()).join(vn, ["vid1", "vid2"]), K_VEC,
                                            k1=F.col("nvid1"), k2=F.col("nvid2"), score=F.col("score")))
        src_keys = src_keys.unionByName(keyed(keepable, K_VEC, "id", k1=F.col("vid1"), k2=F.col("vid2")))
    # the same for all rounds and one short step from the checkpointed base:
    # persisted (recomputable after executor loss), not checkpointed
    if decided is None:
        queries, src_keys = _materialize(queries), _materialize(src_keys)

    def hits_of(wanted, live):
        """Of each key that ``wanted`` rows ask for: the latest live row before."""
        s = src_keys.join(live, "rid").select(F.col("id").alias("sid"), "a", "t", "kt", "ks", "k1", "k2", "kind")
        hits = _asof_latest(queries.join(wanted, "rid", "left_semi"), s, bucket_size, single)
        alive = lambda last: F.lit(True) if win_us is None else (
            (F.col("kt") != K_SIM) | (F.col(f"{last}.t") > F.col("t") - F.lit(win_us)))
        return (hits.withColumn("k_hit", F.col("k_last").isNotNull() & alive("k_last"))
                .withColumn("u_hit", F.col("u_last").isNotNull() & alive("u_last")))

    def kinds(state, which):
        return state.where(F.col("status").isin(*which)).select("rid", F.col("status").alias("kind"))

    state = base.select("rid", F.when(F.col("prior"), "K").otherwise("U").alias("status"))
    if decided is not None:
        # all told by the heads; what is left is to name
        state = cut_lineage(base.where(F.col("rid").isNotNull()).select("rid").distinct().join(
            decided.select("rid", F.lit("K").alias("status")).distinct(), "rid", "left").select("rid", F.coalesce("status", F.lit("D")).alias("status")))
    left = base.where("not prior").limit(1).count() if decided is None else 0
    while left:
        # rows without an earlier live neighbour are kept, neighbours of kept rows go
        und = kinds(state, "U").select("rid")
        first = hits_of(und, kinds(state, "KU")).groupBy("rid").agg(
            F.max("k_hit").alias("blocked"), F.max("u_hit").alias("wait"), F.max("can_keep").alias("can_keep")).select(
            "rid", F.when(F.col("blocked"), "D").when(F.col("wait"), "U").when(F.col("can_keep"), "K").otherwise("D").alias("status"))
        state = cut_lineage(state.where("status <> 'U'").unionByName(first))
        und = kinds(state, "U").select("rid")
        second = hits_of(und, kinds(state, "K")).groupBy("rid").agg(
            F.when(F.max("k_hit"), "D").otherwise("U").alias("status"))
        state = cut_lineage(state.where("status <> 'U'").unionByName(second))
        und = kinds(state, "U").select("rid")
        if not und.limit(1).count():
            break
        decided, rest = _resolve(queries, src_keys, und, win_us, component_rows)
        state = cut_lineage(state.where("status <> 'U'").unionByName(decided)
                            .unionByName(rest.withColumn("status", F.lit("U"))))
        left = kinds(state, "U").limit(1).count()

    # naming pass over the final kept set: the sequential rule compares a
    # dropped row with *every* earlier kept row, not only those kept by the
    # round in which it was dropped
    hits = hits_of(kinds(state, "D").select("rid"), kinds(state, "K")).where("k_hit")
    latest, sid = -F.col("k_last.a"), F.col("k_last.id").alias("id")
    named = hits.groupBy("rid").agg(
        F.min(F.when(F.col("kt") == K_URL, F.struct(latest, sid))).alias("url_best"),
        F.min(F.when(F.col("kt") == K_SIM, F.struct(F.col("dist"), latest, sid))).alias("sim_best"),
        F.min(F.when(F.col("kt") == K_VEC, F.struct(-F.col("score"), latest, sid, F.col("score").alias("s")))).alias("vec_best"))
    named = named.select(
        "rid",
        F.when(F.col("url_best").isNotNull(), F.lit("url"))
         .when(F.col("sim_best").isNotNull(), F.lit("simhash"))
         .otherwise(F.lit("vector")).alias("stage"),
        F.coalesce(F.col("url_best.id"), F.col("sim_best.id"), F.col("vec_best.id")).alias("duplicate_of"),
        F.when(F.col("url_best").isNull(), F.col("sim_best.dist")).alias("distance"),
        F.when(F.col("url_best").isNull() & F.col("sim_best").isNull(),
               F.col("vec_best.s")).alias("score"))
    final = cut_lineage(state.join(named, "rid", "left"))
    if decided is None:
        queries.unpersist()
        src_keys.unpersist()
    if added:
        rows = rows.drop("vid1", "vid2", "vec_ok")
    out = rows.withColumn("__rid", row_id(False)).join(final.withColumnRenamed("rid", "__rid"), "__rid").drop("__rid")
    return (out.withColumn("kept", F.col("status") == "K")
               .withColumn("stage", F.when(F.col("status") == "D", F.coalesce("stage", F.lit("no_vector")))).drop("status")
               .withColumn("score", F.round("score", 6)))
