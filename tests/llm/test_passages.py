"""Removal of repeated passages against plain window sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from storyspark.llm import passages as S

SCHEMA = "doc_id long, text string, key string, block string, kept int"


def plain(rows):
    first = defaultdict(set)
    order = lambda i: float("inf") if i is None else i
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - S.WINDOW + 1):
            first[tuple(w[k:k + S.WINDOW])].add(order(i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - S.WINDOW + 1):
            if min(first[tuple(w[k:k + S.WINDOW])]) < order(i):
                gone[k:k + S.WINDOW] = [True] * S.WINDOW
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def got(spark, rows, block_bytes, parts=3):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(parts)
    out = sorted(map(tuple, S.without_repeats(docs, block_bytes).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    spark.catalog.clearCache()
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["Word", "word", "日本", "x\x85y", "a b", "'"]
    passages = [" ".join(r.choices(vocab, k=r.choice([12, 13, 14, 20, 70]))) for _ in range(25)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(6)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choices(vocab, k=r.randrange(40))))
        rows.append((r.randrange(10 * n), r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(r.randrange(10 * n), r.choice(rows)[1]) for _ in range(n // 4)]               # copies
    near = [t.split() for _, t in rows if len(t) > 200][:30]
    for w in near:
        w[len(w) // 2] = "changed"
        rows.append((r.randrange(10 * n), " ".join(w)))
    rows += [(i, "x " * 300) for i in (3, 4, 5000)] + [(i, "a b " * 100 + "tail") for i in (6, 7)]
    rows += [(1, "hot line of thirteen words that many documents of one id share with others " * 2)] * 40
    return rows + [(None, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (8, None), (9, ""), (10, " \n\t "), (11, "one")]


@pytest.mark.parametrize("block_bytes", [1 << 30, 20_000, 2_000])
def test_equal_plain_removal(spark, block_bytes):
    rows = corpus(block_bytes % 97)
    out = got(spark, rows, block_bytes)
    assert out == plain(rows)
    assert sum(r[2] for r in out) > 1000


def test_long_texts_and_small_tables(spark):
    r = random.Random(2)
    words = [f"v{r.randrange(50000)}" for _ in range(120_000)]
    rows = [(5, " ".join(words)), (9, " ".join(words[1000:90_000])), (2, " ".join(words[50:70]))]
    assert got(spark, rows, 100_000) == plain(rows)
    assert got(spark, [], 1000) == []
    assert got(spark, [(None, None)], 1000) == [(None, 0, 0, "")]


def test_shards_find_the_same(monkeypatch):
    rows = [(i, t) for i, t in corpus(6) if i is not None and t]
    import zstandard
    pack = zstandard.ZstdCompressor().compress
    table = pa.table({"doc_id": [i for i, _ in rows], "key": [i for i, _ in rows], "data": [pack(t.encode()) for _, t in rows]})
    routes = S._routes(S._sent_hashes(1)(table.append_column("block", pa.array([0] * len(rows), pa.int32()))))
    found = S._cut(table, routes)
    one = S._kept(table, found)
    monkeypatch.setattr(S, "SHARD_WORDS", 60)
    assert len(list(S._shards(found))) > 10
    assert S._kept(table, found) == one
    assert sorted(zip(*one.to_pydict().values()), key=repr) == plain(rows)


def test_automaton_compares_words_not_hashes(monkeypatch):
    """With hashes that all collide, only equal words are removed."""
    import zstandard
    pack = zstandard.ZstdCompressor().compress
    text = " ".join(f"a{i}" for i in range(13))
    other = " ".join(f"a{i}" for i in range(7)) + " " + " ".join(f"b{i}" for i in range(6))
    table = pa.table({"doc_id": [4, 5], "key": [4, 5], "data": [pack(other.encode()), pack(text.encode())]})
    monkeypatch.setattr(S, "window_hashes", lambda n: np.zeros(len(n) - S.WINDOW + 1, np.uint64))
    passage = pa.table({"goes_to": pa.array([0], pa.int32()), "owner": [1], "words": [text]}, schema=S._PASSAGE)
    assert S._kept(table, passage).column("n_removed").to_pylist() == [0, 13]


def test_packed_values_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for top in (1 << 8, 1 << 40, 1 << 64):
            v = np.sort(r.integers(0, top, n, np.uint64, endpoint=False) if top < 1 << 64 else r.integers(0, (1 << 64) - 1, n, np.uint64))
            assert (S.unpacked(S.packed(v)) == v).all()


def test_many_words_take_more_digits(monkeypatch):
    monkeypatch.setattr(S, "BASE", 4)
    r = random.Random(3)
    text = [f"w{r.randrange(90)}" for _ in range(400)]
    machine = S.Automaton([(1, text[:200]), (2, text[200:])])
    assert machine.digits > S.DIGITS
    letters = np.array([machine.letter[w] for w in text])
    found = set(machine.hits(letters).tolist())
    want = {i + S.PIECE - 1 for i in range(len(text) - S.PIECE + 1)
            if any(text[i:i + S.PIECE] == part[k:k + S.PIECE] for part in (text[:200], text[200:]) for k in range(0, 200 - S.PIECE + 1, S.PIECE))}
    assert found == want
    letters[50:53] = 0
    assert set(machine.hits(letters).tolist()) == {e for e in want if e < 50 or e - S.PIECE + 1 > 52}
