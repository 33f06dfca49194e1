"""Covering SimHash against brute force: fingerprints, masks, components."""

import random
from itertools import combinations

import pytest
import xxhash

from storyspark.llm import simhash_cover as SC

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{row: component root} over (doc_id, fp) rows."""
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fps), key=str)


def test_masks_cover_every_small_difference():
    masks = SC.covering_masks()
    assert len(masks) == 15 and all(32 <= m.bit_count() <= 36 for m in masks)
    for bits in combinations(range(64), 3):
        x = sum(1 << b for b in bits)
        assert any(not m & x for m in masks)


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "A b\x0bC d É é", "x " * 5000, "a b c d e"])
def test_fingerprint_rule(text):
    assert SC.simhash64(text) % (1 << 64) == brute_fingerprint(text)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(str(i * i) for i in range(900))
    whole = SC.simhash64(text)
    monkeypatch.setattr(SC, "BLOCK", 7)
    assert SC.simhash64(text) == whole


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_components_match_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=80)) for _ in range(25)]
    texts = [(b if r.random() < .4 else b.replace(f" w{r.randrange(300)} ", " z ", 1)) for b in base for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "  "), (3, texts[3]), (None, texts[0]),
                                                   (None, "only null ids here"), (903, "word " * 30000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "text")
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert rows_of(SC.simhash_components(df)) == want
    assert rows_of(SC.simhash_components(df, pair_bucket=1)) == want  # every bucket by hubs


def test_large_buckets_keep_the_components(spark):
    r = random.Random(8)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            x ^= 1 << r.randrange(64)
            if r.random() < .5:
                x ^= 1 << r.randrange(64)
            fps.add(x)
    table = spark.createDataFrame([(i, SC._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for bucket in (1, 4, 1000) for r in SC.component_table(table, pair_bucket=bucket).collect()}
    for bucket in (1, 4, 1000):
        assert {r.fp: r.component_id for r in SC.component_table(table, pair_bucket=bucket).collect()} == got
    want = {int(f, 16): c for _, f, c in brute_components(list(enumerate(fps)))}
    assert {f % (1 << 64): c for f, c in got.items()} == want


def test_one_row_per_component_stays(spark):
    rows = [(5, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (2, "quite another text here", "z"),
            (None, "no id at all", "q"), (None, "a b c d", "q"), (None, "no id at all", "q"), (7, None, "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string")
    out = SC.keep_one_per_component(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(2, "a b c d", "y"), (2, "quite another text here", "z"), (None, "no id at all", "q"), (7, None, "n")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "fp int, root string, doc_id long, text string")
    assert SC.simhash_components(df).collect() == []
    assert SC.keep_one_per_component(df).collect() == []
