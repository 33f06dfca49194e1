"""Packing: ids equal the library's, each id in one piece, gapless sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from storyspark.llm import packing as PK

SCHEMA = "doc_id long, text string, length string"
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(9)
    bits = ["The", " ", "\n", "'s", "É", "12", "##", "<|endoftext|>", "Zürich", "\t", "😀", "…", "é", "İ", "ΑΣ", "\xa0", "\x1c", "\x85", "　", "don't"]
    out = ["".join(r.choices(bits, k=r.randrange(60))) for _ in range(200)]
    out += ["".join(map(chr, range(a, a + 40))) for a in range(33, 0x300, 7)] + [chr(a) + "'S" + chr(a) for a in range(33, 0x260)]
    return out + [None, "", " ", "́ ́a", "word " * 12000, "x" * 9000, "<|startoftext|> a<|endoftext|>", "a " * 4095, "a " * 8191]


def test_ids_equal_the_library(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        encoder = PK.WordEncoder(f.read())
    monkeypatch.setattr(PK, "CACHE_WORDS", 40)
    monkeypatch.setattr(PK, "BATCH_BYTES", 50)
    ts = [t or "" for t in texts()]
    for t, got in zip(ts, encoder.encode(pa.array(ts), 2), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids + [2], t[:80]


def test_first_fit_decreasing_equals_a_plain_scan():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 300):
        sizes = sorted((r.randrange(1, 101) for _ in range(n)), reverse=True)
        room, want = [], []
        for s in sizes:
            b = next((i for i, x in enumerate(room) if x >= s), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= s
            want.append(b)
        assert PK.first_fit_decreasing(sizes, 100) == want


@pytest.mark.parametrize("group", [16, 4096])
def test_pack(spark, library, group):
    ts = texts()
    rows = [(i, t, "x") for i, t in enumerate(ts)] + [(None, "null id", ""), (5, ts[5], ""), (5, ts[5], "")]
    out = PK.pack(spark.createDataFrame(rows, SCHEMA), PATH, group=group, with_ids=True).cache()
    got = out.collect()
    docs = defaultdict(list)
    for i, t, _ in rows:
        docs[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(docs)
    for i, whole in docs.items():
        have = sorted((p.start, tuple(p.ids), p.doc_tokens) for p in by_doc[i])
        want = sorted((a, tuple(ids[a:a + 4096]), len(ids)) for ids in whole for a in range(0, len(ids), 4096))
        assert have == want
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    if group == 4096:
        assert len(by_seq) <= -(-sum(p.length for p in got) // 4096) + 1
    whole = {r.sequence_id: r.ids for r in PK.sequences(out).collect()}
    for p in got:
        assert whole[p.sequence_id][p.offset:p.offset + p.length] == p.ids


def test_empty_table(spark):
    assert PK.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
