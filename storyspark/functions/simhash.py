"""128-bit SimHash (D1) and its bit helpers.

A fingerprint is held as two signed bigints: ``sim_hi`` (bits 127..64) and
``sim_lo`` (bits 63..0) -- decimal(38,0) cannot hold every 128-bit value.
The per-document vote runs in an Arrow-batched UDF (numpy over MD5 digests);
everything else (bands, distance, hex) is native column arithmetic.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:                                  # the interpreter's own MD5 starts faster on a few bytes than OpenSSL's
    from _md5 import md5
except ImportError:
    from hashlib import md5

_WS = re.compile(r"\s+")

SIMHASH_SCHEMA = T.StructType([T.StructField("sim_hi", T.LongType()),
                              T.StructField("sim_lo", T.LongType())])


def simhash_py(text: str) -> tuple[int, int]:
    """Row helper: normalize (lower, strip, collapse whitespace), 3-word
    shingles (at least one), signed vote of the 128 MD5 bits per shingle,
    bit set when the vote is positive. No words gives 0."""
    words = _WS.sub(" ", text.lower().strip()).split()
    if not words:
        return 0, 0
    m = max(1, len(words) - 2)
    digests = b"".join([md5(" ".join(three).encode("utf-8")).digest() for three in zip(words, words[1:], words[2:])]
                       if m > 1 else [md5(" ".join(words[:3]).encode("utf-8")).digest()])
    # MSB-first unpacking: column k holds integer bit 127-k.
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(m, 128)
    votes = bits.sum(axis=0, dtype=np.int64) * 2 - m
    packed = np.packbits((votes > 0).astype(np.uint8)).tobytes()
    hi, lo = np.frombuffer(packed, dtype=">i8")
    return int(hi), int(lo)


@F.pandas_udf(SIMHASH_SCHEMA)
def simhash128(texts: pd.Series) -> pd.DataFrame:
    """D1 as an Arrow UDF; returns struct<sim_hi, sim_lo> (null for null text)."""
    n = len(texts)
    hi = np.zeros(n, dtype=np.int64)
    lo = np.zeros(n, dtype=np.int64)
    null = texts.isna().to_numpy()
    for i, t in enumerate(texts):
        if not null[i]:
            hi[i], lo[i] = simhash_py(t)
    out = pd.DataFrame({"sim_hi": pd.array(hi, dtype="Int64"),
                        "sim_lo": pd.array(lo, dtype="Int64")})
    out.loc[null, ["sim_hi", "sim_lo"]] = pd.NA
    return out


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _mask(nbits: int) -> Column:
    return F.lit(-1 if nbits >= 64 else (1 << nbits) - 1).cast("long")


def bit_range(hi, lo, start: int, length: int) -> Column:
    """Bits [start, start+length) of the 128-bit value as a bigint (length<=64)."""
    hi, lo = _c(hi), _c(lo)
    end = min(start + length, 128)
    parts = None
    if start < 64:
        n = min(end, 64) - start
        parts = F.shiftrightunsigned(lo, start).bitwiseAND(_mask(n))
    if end > 64:
        s = max(start, 64) - 64
        n = end - 64 - s
        h = F.shiftrightunsigned(hi, s).bitwiseAND(_mask(n))
        shift = max(0, 64 - start)
        h = F.shiftleft(h, shift) if shift else h
        parts = h if parts is None else parts.bitwiseOR(h)
    return parts


def disjoint_bands(hi, lo, n_bands: int) -> Column:
    """``n_bands`` contiguous, non-overlapping bands covering all 128 bits, as
    array<struct<band:int, value:bigint, value2:bigint>>. A pair at Hamming
    distance <= n_bands-1 agrees exactly on at least one band (pigeonhole)."""
    bounds = [round(i * 128 / n_bands) for i in range(n_bands + 1)]
    items = []
    for b in range(n_bands):
        s, e = bounds[b], bounds[b + 1]
        length = e - s
        if length <= 64:
            v1, v2 = bit_range(hi, lo, s, length), F.lit(0).cast("long")
        else:  # only when n_bands == 1
            v1, v2 = bit_range(hi, lo, s, 64), bit_range(hi, lo, s + 64, length - 64)
        items.append(F.struct(F.lit(b).alias("band"), v1.alias("value"), v2.alias("value2")))
    return F.array(*items)


def reference_bands(hi, lo, n_bands: int = 16, stride: int = 8, width: int = 16) -> Column:
    """H8: the reference band layout -- ``n_bands`` windows at an 8-bit stride
    with a 16-bit mask (overlapping), hex encoded without leading zeros."""
    items = []
    for i in range(n_bands):
        v = bit_range(hi, lo, i * stride, width)
        items.append(F.struct(F.lit(i).alias("band"), F.lower(F.hex(v)).alias("value")))
    return F.array(*items)


def hamming(hi1, lo1, hi2, lo2) -> Column:
    """H9: popcount of the XOR of two fingerprints."""
    return (F.bit_count(_c(hi1).bitwiseXOR(_c(hi2)))
            + F.bit_count(_c(lo1).bitwiseXOR(_c(lo2)))).cast("int")


def simhash_hex(hi, lo) -> Column:
    """Fingerprint as lower hex without leading zeros ('0' for zero)."""
    hi, lo = _c(hi), _c(lo)
    return F.when(hi == 0, F.lower(F.hex(lo))).otherwise(
        F.concat(F.lower(F.hex(hi)), F.lpad(F.lower(F.hex(lo)), 16, "0")))


def low64(lo) -> Column:
    """The low 64 bits (what the reference stores)."""
    return _c(lo)
