"""Decontamination against a full dynamic-programming edit distance."""

import random

from storyspark.llm import decontam as DC

DOCS = "doc_id long, text string, item_id string"
BENCH = "item_id long, text string"


def least_distance(item, text):
    """Least edit distance of ``item`` to a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def brute(docs, bench, rate=DC.RATE):
    out = []
    for doc_id, text, _ in docs:
        plain = DC.normalized(text)
        for item_id, item in bench:
            item = DC.normalized(item)
            if item and plain:
                d = least_distance(item, plain)
                if d <= DC.budget(len(item), rate) and d < len(item):
                    out.append((doc_id, item_id, d))
    return sorted(out, key=str)


def edited(r, text, n):
    s = list(text)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[i] = r.choice("abcdefg ")
        elif kind == 1:
            s.insert(i, r.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def fixture():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 7)))
    bench = [(i, " ".join(word() for _ in range(r.randrange(3, 25)))) for i in range(12)]
    bench += [(50, "abcde"), (51, ""), (52, None), (53, "!!"), (54, bench[0][1].upper() + "."), (None, bench[1][1])]
    docs = []
    for i in range(70):
        words = " ".join(word() for _ in range(r.randrange(0, 30)))
        item = bench[r.randrange(12)][1]
        docs.append((i, f"{words} {edited(r, item, r.randrange(0, 12))}, {words}" if r.random() < .7 else words, "x"))
    docs += [(100, None, ""), (101, "", ""), (102, bench[2][1].replace(" ", " | "), ""), (None, bench[3][1], ""),
             (103, bench[3][1], ""), (103, bench[3][1], ""), (104, "--abcde--", ""), (105, (bench[4][1] + " ") * 30, "")]
    return docs, bench


def test_hits_match_brute_force(spark):
    docs, bench = fixture()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)
    want = brute(docs, bench)
    assert sum(x[2] > 0 for x in want) > 10
    for chars in (DC.BLOCK_CHARS, 300):
        got = sorted(((x.doc_id, x.item_id, x.distance) for x in DC.leaks(d, b, block_chars=chars).collect()), key=str)
        assert got == want
        left = DC.without_leaks(d, b, block_chars=chars)
        bad = {x[0] for x in want}
        assert left.columns == d.columns
        assert sorted(map(tuple, left.collect()), key=str) == sorted((x for x in docs if x[0] not in bad), key=str)


def test_a_very_long_document(spark):
    item = " ".join(f"w{i * i}" for i in range(40))
    d = spark.createDataFrame([(1, "word " * 60000 + item + " z" * 60000, ""), (2, "word " * 60000, "")], DOCS)
    got = DC.leaks(d, spark.createDataFrame([(7, item)], BENCH)).collect()
    assert [(x.doc_id, x.item_id, x.distance) for x in got] == [(1, 7, 0)]


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    one_d, one_b = spark.createDataFrame([(1, "abc", "")], DOCS), spark.createDataFrame([(1, "abc")], BENCH)
    assert DC.leaks(none_d, one_b).collect() == [] and DC.leaks(one_d, none_b).collect() == []
    assert DC.without_leaks(one_d, none_b).count() == 1 and DC.without_leaks(none_d, one_b).count() == 0
