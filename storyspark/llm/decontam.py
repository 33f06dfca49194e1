"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case runs of letters and digits joined by
single spaces. An item of m characters may differ by k = m x ``RATE`` edits; cut
into k + 1 pieces, one of them must occur unchanged in any such passage. An
Aho-Corasick automaton over all pieces reads each document once; around every
piece hit Myers' bit-parallel algorithm finds the least edit distance of the whole
item to any substring, exactly.

Scale: documents are never shuffled. Items reach the workers by broadcast in
blocks of at most about ``BLOCK_CHARS`` characters; a larger benchmark is
matched block after block against all documents. Windows of one item that
touch are verified together, so a document costs its length per item hit at most.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .worker import held

RATE = 0.07             # edits per character of an item
LEAST_PIECE = 10        # characters of a piece, at least; bounds the edits of a short item
BLOCK_CHARS = 4_000_000

_BREAK = re.compile(r"[\W_]+")


def normalized(text: str | None) -> str:
    return _BREAK.sub(" ", (text or "").lower()).strip()


def budget(chars: int, rate: float = RATE) -> int:
    return max(0, min(int(chars * rate), chars // LEAST_PIECE - 1))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 consecutive pieces, as equal as possible, with their places."""
    cuts = [i * len(item) // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def best_match(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Myers: (least edit distance of the pattern to a substring of ``text``,
    the first end of such a substring). ``peq``: places of each character."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, j
        plus <<= 1
        up = ((minus << 1) | ~(vertical | plus)) & mask
        down = plus & vertical & mask
    return best, end


class Matcher:
    """Finds the items of one block in texts; lives in a worker."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        by_text = defaultdict(list)
        for item_id, text in items:
            if item := normalized(text):
                by_text[item].append(item_id)
        self.items = [(t, ids, budget(len(t), rate)) for t, ids in by_text.items()]
        self.peq = []
        places = defaultdict(list)
        for n, (item, _, edits) in enumerate(self.items):
            peq: dict[str, int] = defaultdict(int)
            for i, c in enumerate(item):
                peq[c] |= 1 << i
            self.peq.append(dict(peq))
            for at, piece in pieces(item, edits):
                places[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalized text) of every item found."""
        plain = normalized(text)
        if not plain or not self.items:
            return []
        windows = defaultdict(list)
        for last, (size, where) in self.automaton.iter(plain):
            for n, at in where:
                item, _, edits = self.items[n]
                begin = last + 1 - size - at
                windows[n].append((max(0, begin - edits), min(len(plain), begin + len(item) + edits)))
        found = []
        for n, spans in windows.items():
            item, ids, edits = self.items[n]
            best, end, reach = len(item), 0, -1
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= reach:
                    merged[-1][1] = reach = max(reach, b)
                else:
                    merged.append([a, b])
                    reach = b
            for a, b in merged:
                d, e = best_match(self.peq[n], len(item), plain[a:b])
                if d < best:
                    best, end = d, a + e
                if best == 0:
                    break
            if best <= edits and best < len(item):
                found += [(i, best, end) for i in ids]
        return found


def _matcher(shared) -> Matcher:
    return held(("decontam", getattr(shared, "_path", None) or id(shared)), lambda: Matcher(*shared.value))


def _blocks(benchmark: DataFrame, rate: float, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcasts of (items, rate), each of about ``block_chars`` at most, one at a
    time, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    sc = benchmark.sparkSession.sparkContext
    for b in range(n):
        yield sc.broadcast(([tuple(r) for r in dealt.where(F.col("block") == b).select("item_id", "text").collect()], rate)), n == 1


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, end)``: a row per document row and item
    found in it, with the least edit distance. Documents without an item give no
    row. Null and empty texts match nothing; an item without letters or digits
    is never found; items with equal texts are all named; repeated rows repeat
    their hits. Other columns are ignored; empty tables give no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                out = [(doc_id, *hit) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                       for hit in matcher.hits(text)]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        return run

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = None
    for shared, only in _blocks(benchmark, rate, block_chars):
        part = source.mapInArrow(scan(shared), "doc_id long, item_id long, distance int, end int")
        if not only:            # answered now, so that the driver and the workers hold one block
            part = cut_lineage(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item."""
    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(t) for t in batch.column("text").to_pylist()], pa.bool_()))
        return run

    spark = docs.sparkSession
    for shared, only in _blocks(benchmark, rate, block_chars):
        docs = docs.mapInArrow(keep(shared), docs.schema)
        if not only:
            folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/decontam-{uuid.uuid4().hex}"
            docs.write.parquet(folder)
            shared.destroy()
            docs = spark.read.parquet(folder)
    return docs
