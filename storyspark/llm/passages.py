"""Removal of passages that an earlier document holds already.

A passage is a run of windows of ``WINDOW`` words, each of which starts in a document with a
smaller id. Three passes over blocks of documents (ranges of doc_id, so an
earlier block holds earlier documents):

1. Confirm: every block sends the distinct hashes of its windows, each with a mark if two of
   its own documents share it, to buckets of the hash range. A bucket sees which
   hashes recur and in which block each comes first.
2. Passages: the first block cuts the runs of recurring windows out of the document that
   holds them first and sends these passages, as text, to the blocks where they recur.
3. Locate: a block compiles its passages into Aho-Corasick automata and streams all its
   documents through them. An automaton knows the aligned pieces of ``PIECE`` words of its
   passages, each word spelled by ``DIGITS`` digits of its number: any ``WINDOW`` words of a
   passage hold a whole piece, so no occurrence is missed. Windows around a hit are compared with the
   passage word by word; those of a smaller doc_id are removed.

The automata are sharded twice: by block, which has only the passages that occur
in it, and within a block at ``SHARD_WORDS`` words. Work and memory per task follow the size of
a block, whatever the number of passages.

Scale: texts are shuffled once, compressed; hashes travel sorted and delta-coded,
once per block that holds them, so a window in a third of all documents costs a few
bytes per block. Documents with equal ids may be dealt to several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
PIECE = (WINDOW + 1) // 2    # aligned pieces of this size: a window holds one whole
BLOCK_BYTES = 12 << 20       # of text per block, on average
BUCKET_BYTES = 24 << 20      # of text whose window hashes meet in one bucket, on average
SHARD_WORDS = 200_000        # words of the passages in one automaton, but whole passages
BASE, DIGITS = 64, 3         # nodes of few children are searched fast; numbers beyond BASE ** DIGITS take more digits
NO_ID = (1 << 63) - 1        # a null id comes after all others

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MARK = np.uint64(1)         # lowest bit of a sent hash: two documents of the block share it


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``(block, doc_id, key, data)``, kept in memory or on disk by block: compressed texts,
    ``key`` the id to compare by. Second result: bytes of text in all."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    cuts = np.empty(0, np.int64)
    if n > 1:
        key = F.coalesce("doc_id", F.lit(NO_ID))
        at = F.array(*[F.lit(i / n) for i in range(1, n)])
        cuts = np.array(source.agg(F.percentile_approx(key, at, F.lit(max(10_000, 20 * n)))).first()[0], np.int64)
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("data", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, done = zstandard.ZstdCompressor(level=1).compress, 0
        for batch in batches:
            ids = batch.column("doc_id")
            keys = pc.fill_null(ids, NO_ID).to_numpy()
            low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
            # an id that fills several blocks is dealt among them
            block = low + (done + np.arange(len(keys))) % (high - low + 1)
            done += len(keys)
            data = [pack(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), ids, pa.array(keys), pa.array(data, pa.binary())], schema=schema)

    dealt = source.mapInArrow(deal, "block int, doc_id long, key long, data binary").repartition(n, "block")
    return dealt.persist(StorageLevel.MEMORY_AND_DISK), total


class Block:
    """The documents of a block in order of their ids, as word numbers."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("key")
        unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = table.column("doc_id").combine_chunks()
        self.keys = table.column("key").to_numpy()
        self.texts = [unpack(d) for d in table.column("data").to_pylist()]
        lists = pc.ascii_split_whitespace(pa.array(self.texts, pa.large_binary()).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        ids, self.words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        real = ids != (self.words.index("") if "" in self.words else -1)
        sizes = pc.list_value_length(lists).to_numpy()
        counted = np.concatenate([[0], np.cumsum(real)])
        self.ends = counted[np.cumsum(sizes)] if len(sizes) else np.empty(0, np.int64)
        self.ids = ids[real]
        self.sizes = np.diff(self.ends, prepend=0)
        self.numbers = np.array([word_number(w) for w in self.words] or [0], np.uint64)
        end = np.repeat(self.ends, self.sizes)
        #: where windows start, and their hashes
        self.starts = np.flatnonzero(np.arange(len(self.ids)) + WINDOW <= end)
        self.hashes = window_hashes(self.numbers[self.ids])[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def key_at(self, places: np.ndarray) -> np.ndarray:
        """The id key of the document at each word place."""
        return self.keys[np.searchsorted(self.ends, places, "right")]


def word_number(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8"))


def window_hashes(numbers: np.ndarray) -> np.ndarray:
    """63-bit hashes (lowest bit clear) of all runs of ``WINDOW`` numbers."""
    n = len(numbers) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h *= _STEP
        h += numbers[j:j + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h & ~_MARK


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as the first one and the differences, each in
    as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return values[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[8])
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :blob[8]] = raw
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1), steps.view("<u8").ravel()]), dtype=np.uint64)


def _sent_hashes(buckets: int):
    """A block -> ``(bucket, block, hashes)``."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        order = np.argsort(block.hashes, kind="stable")         # equal hashes stay in document order
        h = block.hashes[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        last = np.append(first[1:], len(h)) - 1 if len(h) else first
        key = block.key_at(block.starts[order])
        out = h[first] | (key[first] < key[last]).astype(np.uint64)
        bucket = ((out >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        some = [b for b in range(buckets) if at[b] < at[b + 1]]
        return pa.Table.from_arrays([pa.array(some, pa.int32()), pa.array([table.column("block")[0].as_py()] * len(some), pa.int32()),
                                     pa.array([packed(out[at[b]:at[b + 1]]) for b in some], pa.binary())], schema=schema)
    return run


_ROUTE = pa.schema([("first", pa.int32()), ("hashes", pa.binary()), ("goes_to", pa.binary())])


def _routes(table: pa.Table) -> pa.Table:
    """The hashes of a bucket -> ``(first, hashes, goes_to)``: those that recur,
    under the first block that has them, with each block they recur in."""
    table = table.sort_by("block")
    parts = [unpacked(b) for b in table.column("hashes").to_pylist()]
    sent = np.concatenate(parts)
    block = np.repeat(table.column("block").to_numpy(), [len(p) for p in parts])
    order = np.argsort(sent & ~_MARK, kind="stable")            # equal hashes stay in block order
    h, block, shared = (sent & ~_MARK)[order], block[order], (sent & _MARK)[order] > 0
    opens = np.diff(h, prepend=~h[:1]) != 0
    first = block[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    wanted = ~opens | shared                                    # a later block, or two documents of the first
    first, h, block = first[wanted], h[wanted], block[wanted]
    order = np.argsort(first, kind="stable")
    first, h, block = first[order], h[order], block[order]
    own, at = np.unique(first, return_index=True)
    ends = np.append(at[1:], len(first))
    return pa.Table.from_arrays([
        pa.array(own.astype(np.int32)), pa.array([packed(h[a:b]) for a, b in zip(at, ends)], pa.binary()),
        pa.array([block[a:b].astype("<i4").tobytes() for a, b in zip(at, ends)], pa.binary())], schema=_ROUTE)


_PASSAGE = pa.schema([("goes_to", pa.int32()), ("owner", pa.int64()), ("words", pa.string())])


def _cut(docs: pa.Table, routes: pa.Table) -> pa.Table:
    """A block and the hashes wanted from it -> ``(goes_to, owner, words)``: runs of
    wanted windows where they come first."""
    if not len(routes) or not len(docs):
        return _PASSAGE.empty_table()
    block = Block(docs)
    order = np.argsort(block.hashes, kind="stable")
    h = block.hashes[order]
    asked = np.concatenate([unpacked(b) for b in routes.column("hashes").to_pylist()])
    goes_to = np.frombuffer(b"".join(routes.column("goes_to").to_pylist()), "<i4")
    place = block.starts[order[np.searchsorted(h, asked)]]
    order = np.lexsort((place, goes_to))
    place, goes_to = place[order], goes_to[order]
    opens = (np.diff(place, prepend=-2) != 1) | (np.diff(goes_to, prepend=-1) != 0)
    a = np.flatnonzero(opens)
    begin, end, to = place[a], place[np.append(a[1:], len(place)) - 1] + WINDOW, goes_to[a]
    texts: dict[tuple[int, int], str] = {}
    for span in zip(begin.tolist(), end.tolist()):
        if span not in texts:
            texts[span] = " ".join([block.words[i] for i in block.ids[slice(*span)].tolist()])
    return pa.Table.from_arrays([pa.array(to.astype(np.int32)), pa.array(block.key_at(begin)),
                                 pa.array([texts[s] for s in zip(begin.tolist(), end.tolist())], pa.string())], schema=_PASSAGE)


class Automaton:
    """Finds the windows of some passages in the word numbers of a block."""

    def __init__(self, passages: list[tuple[int, list[str]]]):
        letter: dict[str, int] = {}
        for _, words in passages:
            for w in words:
                letter.setdefault(w, len(letter) + 1)
        self.letter = letter
        flat = [w for _, words in passages for w in words]
        self.letters = np.array([letter[w] for w in flat], np.int64)
        ends = np.cumsum([len(words) for _, words in passages])
        end = np.repeat(ends, [len(words) for _, words in passages])
        starts = np.flatnonzero(np.arange(len(flat)) + WINDOW <= end)
        numbers = np.array([0] + [word_number(w) for w in letter], np.uint64)[self.letters]
        hashes = window_hashes(numbers)[starts]
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], starts[order]
        self.owners = np.repeat([owner for owner, _ in passages], [len(words) for _, words in passages])[self.places]
        self.digits = DIGITS
        while BASE ** self.digits <= len(letter):
            self.digits += 1
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text, begin = self._spelled(self.letters), 0
        for e in ends.tolist():
            for at in range(begin, e - PIECE + 1, PIECE):
                self.machine.add_word(text[at * self.digits:(at + PIECE) * self.digits])
            begin = e
        self.machine.make_automaton()

    def _spelled(self, letters: np.ndarray) -> str:
        """Numbers as ``digits`` characters each."""
        out = np.empty((len(letters), self.digits), np.uint8)
        for k in range(self.digits - 1, -1, -1):
            letters, out[:, k] = letters // BASE, letters % BASE + 48
        return out.tobytes().decode("ascii")

    def hits(self, letters: np.ndarray) -> np.ndarray:
        """Places of the last words of the pieces found. Words of no passage are zeros; a run
        of others shorter than a piece can hold none and is not spelled out."""
        known = letters > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= PIECE
        mark = np.zeros(len(letters) + 2, np.int8)
        mark[begin[long]] += 1
        mark[end[long] + 1] -= 1                 # with the zero after it, so that runs stay apart
        place = np.flatnonzero(np.cumsum(mark[:len(letters)], dtype=np.int64) > 0)
        last = np.fromiter((e for e, _ in self.machine.iter(self._spelled(letters[place]))), np.int64) + 1
        last = last[last % self.digits == 0] // self.digits - 1      # others start inside a word
        return place[last]

    def removable(self, block: Block) -> np.ndarray:
        """Starts of the windows of the block that a smaller document holds."""
        known = np.array([self.letter.get(w, 0) for w in block.words] or [0], np.int64)
        letters = known[block.ids]
        hits = self.hits(letters)
        if not len(hits):
            return hits
        # a window holds the piece that ends at e if it starts WINDOW - 1 to PIECE - 1 words before e
        edge = np.zeros(len(letters) + WINDOW + 1, np.int64)
        np.add.at(edge, np.maximum(hits - WINDOW + 1, 0), 1)
        np.add.at(edge, hits - PIECE + 2, -1)
        near = np.cumsum(edge)[block.starts] > 0
        start, h = block.starts[near], block.hashes[near]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.hashes[at] == h) & (self.owners[at] < block.key_at(start))
        start, place = start[same], self.places[at[same]]
        equal = np.ones(len(start), bool)
        for j in range(WINDOW):
            equal &= letters[start + j] == self.letters[place + j]
        return start[equal]


def _shards(passages: pa.Table) -> Iterator[list[tuple[int, list[str]]]]:
    held, size = [], 0
    for owner, words in zip(passages.column("owner").to_pylist(), passages.column("words").to_pylist()):
        held.append((owner, words.split(" ")))
        size += len(held[-1][1])
        if size >= SHARD_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(docs: pa.Table, passages: pa.Table) -> pa.Table:
    """A block and its passages -> ``(doc_id, n_words, n_removed, kept)``."""
    if not len(docs):
        return _KEPT.empty_table()
    block = Block(docs)
    edge = np.zeros(len(block.ids) + 1, np.int64)
    for shard in _shards(passages):
        gone = Automaton(shard).removable(block)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
    stays = np.cumsum(edge[:-1]) == 0
    left = np.diff(np.concatenate([[0], np.cumsum(stays)])[block.ends], prepend=0)
    out = []
    for text, end, size, n in zip(block.texts, block.ends.tolist(), block.sizes.tolist(), left.tolist()):
        words = text.split()
        out.append(b" ".join(words if n == size else compress(words, stays[end - size:end].tolist())))
    return pa.Table.from_arrays([block.doc_ids, pa.array(block.sizes.astype(np.int64)), pa.array((block.sizes - left).astype(np.int64)),
                                 pa.array(out, pa.binary()).cast(pa.string())], schema=_KEPT)


def passages(docs: DataFrame, total: int) -> DataFrame:
    """``(goes_to, owner, words)`` of :func:`blocks`: passages that recur, per block they recur in."""
    buckets = max(1, -(-total // BUCKET_BYTES))
    sent = docs.groupBy("block").applyInArrow(_sent_hashes(buckets), "bucket int, block int, hashes binary")
    # stated numbers of partitions, as rows are few and large
    routes = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_routes, "first int, hashes binary, goes_to binary")
    return docs.groupBy("block").cogroup(routes.groupBy("first")).applyInArrow(_cut, "goes_to int, owner long, words string")


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row: the words that stay, joined by one space.

    A word goes if a window of ``WINDOW`` words over it also starts in a row with a smaller
    doc_id (rows with equal ids remove nothing from each other; a null id counts as
    larger than any other). Texts of fewer words stay, null and empty texts give an
    empty string. White space is normalised in every row. Other columns are
    ignored, whatever their names; an empty table gives no rows.

    Removal is exact word by word; a recurring window could only be missed if another
    window of the corpus shared its 63-bit hash. The blocks stay
    persisted for the lazy result: ``spark.catalog.clearCache()`` lets them go."""
    held, total = blocks(docs, block_bytes)
    found = passages(held, total)
    return held.groupBy("block").cogroup(found.groupBy("goes_to")).applyInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept string")
