"""Sequence packing: first-fit decreasing in randomised groups.

Documents are tokenized where they lie; a document's ids (with the end id) are
cut into pieces of at most one sequence, so only its last piece is short.
Pieces, described by a few numbers each, are dealt at random to groups of about
``GROUP`` pieces. Within a group first-fit decreasing places each piece in the
leftmost sequence with room, found through a tournament tree of the largest
remaining capacities (log n steps). Groups are independent, so the job
is one tokenizing scan and one shuffle of piece descriptions; token ids move only
when the caller wants them (``with_ids``).

The group of a piece follows from what it is and where its copy lies among its
equals, not from the order rows arrive in, so a task that runs again deals
alike, and a document repeated in a third of all rows is spread evenly.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .worker import held

LENGTH = 4096            # tokens of a full sequence
END_ID = 2               # closes every document
GROUP = 4096             # pieces per group, on average
CACHE_WORDS = 600_000    # words a worker remembers (about 100 MB)
BATCH_BYTES = 8 << 20    # of text encoded at a time, but whole documents


# Characters up to U+024F without controls and white space are the same under NFC and
# have one lower case and class in all Unicode versions (but for U+0130)
_SETTLED = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+").fullmatch
# fixed value: the tokenizer's own splitting pattern
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
# byte-level alphabet: a printable byte stands for itself, the others follow from U+0100 on
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip([b for b in range(256) if b not in _PLAIN], range(0x100, 0x200)))


class WordEncoder:
    """Ids of whole texts from a cache of space-separated words. The tokenizer
    drops white space and never joins across it, so a text's ids are its words'
    ids one after the other. Arrow splits texts at ASCII white space and numbers
    the distinct words of a batch, so Python sees each of them once. A new word
    of settled characters is cut as the tokenizer cuts it and its parts go straight to
    the tokenizer's merges; any other new word goes through the whole tokenizer."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._reset()

    def _reset(self) -> None:
        self.slots, self.ids, self.ends = {"": 0}, array.array("I"), array.array("q", [0, 0])

    def _slots_of(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the cache."""
        if len(self.slots) + len(words) > CACHE_WORDS:
            self._reset()
        merge = self.tokenizer.model.tokenize
        for word in words:
            if word not in self.slots:
                if _SETTLED(word) and "<|" not in word:
                    for part in _PARTS(word.lower()):
                        part = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
                        self.ids.extend([t.id for t in merge(part)])
                else:
                    self.ids.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
                self.slots[word] = len(self.ends) - 1
                self.ends.append(len(self.ids))
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """One uint32 array per text (none null), closed by ``end_id``."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + BATCH_BYTES)))
            yield from self._some(texts.slice(at, stop - at), end_id)
            at = stop

    def _some(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        slots = self._slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.uint32)
        starts = ends[slots]
        lengths = ends[slots + 1] - starts
        done = np.concatenate([[0], np.cumsum(lengths)])
        flat = ids[np.repeat(starts - done[:-1], lengths) + np.arange(done[-1])] if done[-1] else np.empty(0, np.uint32)
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        at = done[words].tolist()
        for a, b in zip(at[:-1], at[1:]):
            yield np.append(flat[a:b], np.uint32(end_id)).astype("<u4")


def _encoder(shared) -> WordEncoder:
    """One encoder per worker and broadcast, so its cache outlives a task."""
    return held(("packing", getattr(shared, "_path", None) or id(shared)), lambda: WordEncoder(shared.value))


PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
         ("doc_tokens", pa.int64()), ("deal", pa.int64())]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``deal`` is its random number."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = PIECE + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, copies = _encoder(shared), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"), end_id)):
                for at in range(0, len(ids), length):
                    piece = ids[at:at + length]
                    crc = zlib.crc32(piece.tobytes())
                    key = f"{doc_id}:{at}:{crc}"
                    copies[key] += at == 0
                    nth = copies[key] if at == 0 else copies[f"{doc_id}:0:{zlib.crc32(ids[:length].tobytes())}"]
                    deal = xxhash.xxh64_intdigest(f"{key}:{part}:{nth}") >> 1
                    out.append((doc_id, at, len(piece), crc, len(ids), deal, *([piece.tolist()] * with_ids)))
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(cut, _DDL + (", ids array<long>" if with_ids else ""))


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, given in decreasing order; a length of at most
    ``capacity`` goes to the leftmost bin with room."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)          # room[i] = most room below node i
    bins = []
    for need in lengths:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < need:
                i += 1
        bins.append(i - leaves)
        room[i] -= need
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
    return bins


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP,
         with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``
    per piece, and ``ids`` if asked for. Offsets of a sequence are gapless from
    0 and end at ``length`` or earlier (the rest is padding).

    Null text counts as empty: such a document is its end id alone. Null and
    repeated doc_ids keep their rows; other columns are ignored, whatever their
    names; an empty table gives no rows."""
    cut = cut_lineage(pieces(docs, tokenizer_path, length, end_id, with_ids))
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod("deal", F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("deal", "ascending"), ("start", "ascending")])
        sizes = table.column("length").to_pylist()
        bins = first_fit_decreasing(sizes, length)
        filled, offsets = Counter(), []
        for b, n in zip(bins, sizes):
            offsets.append(filled[b])
            filled[b] += n
        base = table.column("group")[0].as_py() << 32
        return (table.drop_columns(["deal", "group"])
                .append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    kept = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    return dealt.groupBy("group").applyInArrow(place, kept + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from :func:`pack` with ids: the pieces of each
    sequence in order, without padding; at most one sequence length per row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
