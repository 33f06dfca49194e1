"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: 64 majority bits of the XXH64 (seed 42) of all word shingles,
counted as often as they occur. Search: Pagh's covering masks ("CoverLSH",
2016). Bit position i gets a label in {0,1}^(r+1) \\ {0}; mask v holds the
positions whose label has odd overlap with v. The labels of at most r differing
positions span at most r dimensions, so some non-zero v is orthogonal to all of
them: two fingerprints within r bits agree on all of mask v. With r = 3 that is
15 tables of 32 to 36 bits, without a missed pair.

Scale: texts are read once; only (id, hash, fingerprint) is moved. Copies
collapse to one fingerprint before any search. A bucket of few distinct
fingerprints is compared pair by pair. A large bucket is never paired: every
member names the points within two flips of it in the bits its table leaves
free; a member within one flip of a point becomes the hub of all members within
two (distance 3 at most), which joins exactly the same components in linear
space, spread over the points instead of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import smallest_reachable
from ..session import cut_lineage

BITS, SEED = 64, 42
RADIUS = 3               # most differing bits of a link
SHINGLE = 3              # words per shingle
PAIR_BUCKET = 128        # distinct fingerprints up to which a bucket is paired
BLOCK = 1 << 16          # shingles hashed at a time


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks, unsigned."""
    size = 1 << (radius + 1)
    label = [1 + i % (size - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (label[i] & v).bit_count() % 2) for v in range(1, size)]


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one whole text; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and \\x20 \\x09-\\x0D only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        runs = zip(*(words[at + k:stop + k] for k in range(shingle))) if len(words) >= shingle else [words]
        digests = b"".join([xxhash.xxh64_digest(b" ".join(r), SEED) for r in runs])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Arrow-batched :func:`simhash64`; null text counts as empty."""
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash64(t, shingle) for t in texts], dtype="int64")
    return run(text)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row, computed once."""
    return cut_lineage(docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        fingerprint(F.col("text"), shingle).alias("fp")))


def _near_points(radius: int) -> list[list[int]]:
    """For each table, the flips of up to radius - 1 of its free bits, fewest first."""
    out = []
    for mask in covering_masks(radius):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        out.append([_signed(sum(c)) for k in range(radius) for c in combinations(free, k)])
    return out


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``distinct(fp)`` -> links ``(u, v)`` with at most ``radius`` differing
    bits, whose components are those of all such pairs (see the module text:
    pairs of large buckets are linked through hubs)."""
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks)])
    rows = (distinct.select("fp", F.explode(tables).alias("x"))
            .select("fp", F.col("x.t").alias("t"), F.col("x.mask").bitwiseAND(F.col("fp")).alias("key")))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(rows.join(sizes, ["t", "key"]))

    small = shared.where(F.col("n") <= pair_bucket)
    a, b = small.alias("a"), small.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # a pair is taken in the first table that holds it, so it comes out once
    earlier = F.lit(False)
    for t, m in enumerate(masks):
        earlier = earlier | ((F.col("a.t") > t) & (differ.bitwiseAND(F.lit(m)) == 0))
    pairs = (a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key"))
                    & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= radius))
             .where(~earlier).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))

    large = shared.where(F.col("n") > pair_bucket)
    if large.isEmpty():
        return pairs
    flips = F.array(*[F.array(*[F.lit(x) for x in row]) for row in _near_points(radius)])
    points = (large.select("t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
              .select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"),
                      (F.bit_count("flip") <= 1).alias("close")))
    # at most 1 + 32 + 496 fingerprints lie within two flips of a point
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(W.partitionBy("t", "z"))
    hubs = points.withColumn("hub", hub).where("hub is not null and hub <> fp")
    return pairs.union(hubs.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct())


def component_table(fps: DataFrame, radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``fps(doc_id, fp)`` -> ``(fp, root, component_id)`` per distinct
    fingerprint: ``root`` is the smallest linked fingerprint, ``component_id``
    the smallest doc_id of the component (null if it has none)."""
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = smallest_reachable(fingerprint_links(nodes.select("fp"), radius, pair_bucket))
    named = cut_lineage(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
                        .withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return named.select("fp", "root").join(least, "root")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                       pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Null text counts as empty (fingerprint 0, linked like any other). Repeated
    doc_ids keep their rows. A null doc_id stays null and never names a
    component; a component of null ids only has a null component_id. Other
    columns are ignored, whatever their names; an empty table gives no rows."""
    fps = fingerprints(docs, shingle)
    parts = component_table(fps, radius, pair_bucket)
    return fps.join(parts, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when each component keeps
    one: the smallest doc_id (null ids last), then the smallest text hash; of
    equal rows one stays. Rows meet their verdict on (doc_id, text hash), the
    only shuffle of whole texts."""
    fps = fingerprints(docs, shingle)
    parts = component_table(fps, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = fps.join(parts, "fp").groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("__kept_id"), F.col("first.text_hash").alias("__kept_hash"))
    tagged = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = tagged.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id"))
                       & (F.col("__hash") == F.col("__kept_hash")), "left_semi")
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != "doc_id"]
    order = W.partitionBy("doc_id", "__hash").orderBy(*(plain or [F.lit(0)]))
    return held.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(*docs.columns)
