"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from storyspark.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, n string, w1 string, head int"


def plain(rows, least, longest, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][" ".join(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if " " in p and a >= least}
        kept = []
        for p, a in cands.items():
            w = p.split(" ")
            if any(100 * b >= 50 * a and len(q) > len(p) and f" {p} " in f" {q} " for q, b in cands.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = counts[" ".join(w[:k])], counts[" ".join(w[k:])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            kept.append((-score, -a, p.encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def got(spark, rows, parts=3, **kw):
    docs = spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(map(tuple, P.collocations(docs, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed, n=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Ärger", "ärger", "the", "THE", "x\x1fy", "a'b", " ", "　z", "日本"]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    rows = []
    for _ in range(n):
        words = r.choices(vocab, weight, k=r.randrange(0, 60))
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", " ; "]) for w in words)
        rows.append((text, r.choice(["en", "en", "fr", None, "und", "", "a b"])))
    return rows + [(None, "en"), ("", "en"), (None, None), (" \t ", "xx"), ("...", "xx"), ("one", "xx")]


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (3, 3, 25), (2, 5, 2000), (4, 4, 2000)])
def test_equal_plain_counts(spark, longest, least, top):
    rows = corpus(longest * 10 + least) + [("new york city hall " * 9, "en"), ("new york city hall", "en")] * 2 + [("hot words " * 20000, "fr")]
    assert got(spark, rows, longest=longest, least=least, top=top) == plain(rows, least, longest, top)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("", "en")]) == []


def test_chunks_do_not_matter():
    texts = [t or "" for t, _ in corpus(5)]
    count = Counter()
    words, rows, n = P.windows(texts)
    name = words.to_pylist() + [""]
    for row, k in zip(rows.tolist(), n.tolist()):
        count[tuple(name[i] for i in row)] += k
    one = Counter()
    for t in texts:
        words, rows, n = P.windows([t])
        name = words.to_pylist() + [""]
        for row, k in zip(rows.tolist(), n.tolist()):
            one[tuple(name[i] for i in row)] += k
    assert count == one


def test_scores_beyond_64_bits(spark):
    # the products of the contract reach 10^6 a a; the expression keeps 38 digits
    big = 10 ** 14
    row = spark.range(1).selectExpr(
        f"cast({big} as decimal(15,0)) * cast({big} as decimal(15,0)) * cast(1000000 as decimal(7,0)) div "
        f"(cast({big} as decimal(15,0)) * cast({big + 1} as decimal(15,0))) as s").first()
    assert row.s == 10 ** 6 * big * big // (big * (big + 1))


def test_shared_hashes_are_seen(spark, monkeypatch):
    rows = corpus(8)
    docs = spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    words = P.names(docs, 3, 0)
    assert not P._ambiguous(words, "id")
    assert P._ambiguous(words.withColumn("id", words["id"] % 7), "id")
    asked = []
    monkeypatch.setattr(P, "_ambiguous", lambda table, number: len(asked) < 2 and not asked.append(number))
    assert got(spark, rows, least=3) == plain(rows, 3, 3, 2000)      # other hashes, same phrases
    assert len(asked) == 2


def test_sums_of_rows_that_share_a_hash(monkeypatch):
    import numpy as np
    monkeypatch.setattr(P, "_mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    columns, n = P._summed([np.array([1, 2, 1, 2, 1]), np.array([5, 5, 5, 6, 5])], np.array([1, 2, 3, 4, 5]))
    assert sorted(zip(*[c.tolist() for c in columns], n.tolist())) == [(1, 5, 9), (2, 5, 2), (2, 6, 4)]


def test_packed_windows_round_trip():
    import numpy as np
    words, rows, n = P.windows([t or "" for t, _ in corpus(9)])
    number = np.array([P.word_number(w, 3) for w in words.to_pylist()] + [P.PAD], np.int64)
    lang, own, place, back = P._unpacked(P._packed(-7, number, rows, n), 3)
    assert lang == -7 and (back == n).all()
    for k in range(3):
        assert (own[place[k]] == number[rows[:, k]]).all()
