"""Pseudo-likelihood network: gradient, normalisation, scores, learning."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storyspark.llm import lm_score as LM

SCHEMA = "doc_id long, text string, n_words string"


def random_network(seed=1):
    r = np.random.default_rng(seed)
    return r.normal(0, 0.3, LM.SIZE)


def test_gradient_matches_differences():
    r, flat = np.random.default_rng(2), random_network()
    context, target = r.integers(0, LM.VOCAB + 1, (40, 4)), r.integers(0, LM.VOCAB, 40)
    g = LM.gradient(LM.unpacked(flat), context, target)
    loss = lambda x: -LM.log_probs(LM.unpacked(x), context, target).mean()
    at = np.argsort(-abs(g))[:200:10].tolist() + r.integers(0, LM.SIZE, 40).tolist()
    for i in at:
        step = np.zeros(LM.SIZE)
        step[i] = 1e-5
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=1e-6)


def test_probabilities_sum_to_one():
    p = LM.unpacked(random_network())
    every = np.arange(LM.VOCAB)
    context = np.tile([3, LM.VOCAB, 70, 900], (LM.VOCAB, 1))
    assert np.exp(LM.log_probs(p, context, every)).sum() == pytest.approx(1)


def test_scores_are_sums_over_single_positions(monkeypatch):
    p, vocab = LM.unpacked(random_network()), LM.Vocabulary([f"w{i}" for i in range(500)])
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(700)}" for _ in range(r.randrange(25))) for _ in range(40)] + [None, "", " \n ", "W1", "w1 " * 300]
    want = []
    for t in texts:
        ids = [LM.VOCAB] * 2 + [vocab[w] for w in (t or "").lower().split()] + [LM.VOCAB] * 2
        logs = [LM.log_probs(p, np.array([[ids[i - 2], ids[i - 1], ids[i + 1], ids[i + 2]]]), np.array([ids[i]]))[0]
                for i in range(2, len(ids) - 2)]
        want.append((len(logs), pytest.approx(sum(logs), abs=1e-9)))
    assert LM.score_texts(texts, vocab, p) == want
    monkeypatch.setattr(LM, "BLOCK", 7)
    monkeypatch.setattr(LM, "CHUNK_WORDS", 20)
    assert LM.score_texts(texts, vocab, p) == want


def ordered(r, pairs=[(f"a{i}", f"b{i}", f"c{i}") for i in range(12)]):
    return " ".join(" ".join(r.choice(pairs)) for _ in range(60))


def test_training_learns_both_sides():
    r = random.Random(4)
    vocab = LM.Vocabulary([f"{c}{i}" for c in "abc" for i in range(12)])
    counts = np.zeros(LM.VOCAB)
    counts[:36] = 100
    texts = [ordered(r) for _ in range(200)]
    flat, n = LM.train_part(iter([texts] * 40), vocab, LM.initial(counts), np.random.default_rng(1))
    assert 0.15 < n / (40 * 200 * 180) < 0.25
    held = ordered(r)
    mixed = held.split()
    r.shuffle(mixed)
    (n1, right), (n2, wrong) = LM.score_texts([held, " ".join(mixed)], vocab, LM.unpacked(flat))
    assert right / n1 > -np.log(36) + 1 and right / n1 > wrong / n2 + 1   # a held-out text is told from its shuffle


def test_rows(spark):
    r = random.Random(4)
    held = ordered(r)
    rows = [(i, ordered(r), "x") for i in range(240)]
    rows += [(900, held, ""), (902, None, ""), (903, "", ""), (None, held, ""), (904, "new " * 40000, "")]
    out = {x.doc_id: x for x in LM.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(out) == len(rows)
    assert out[900].mean_log_prob > -np.log(36) - 1 and out[900].n_words == 180
    assert out[None].log_prob == out[900].log_prob
    assert out[902].n_words == 0 and out[902].log_prob == 0 and out[903].mean_log_prob is None
    assert out[904].n_words == 40000 and np.isfinite(out[904].log_prob)


def test_empty_table(spark):
    assert LM.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_word_has_its_own_share(spark):
    """Two rare words of one bucket differ by the log of their counts, and all words' shares sum to one."""
    bucket = lambda w: zlib.crc32(w.encode()) % LM.HASHED
    rare = [f"r{i}" for i in range(4000)]
    a, b = [w for w in rare if bucket(w) == bucket("r0")][:2]
    texts = [f"w{i} " * 40 for i in range(LM.VOCAB - LM.HASHED)] + rare + [a] * 19 + [f"{a}", f"{b}", f"x {a}", f"x {b}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.log_prob for r in LM.score(docs).collect()}
    assert len(out) == len(texts)
    n, end = Counter(" ".join(texts).split()), len(texts)
    assert out[end - 4] - out[end - 3] == pytest.approx(np.log(n[a] / n[b]), abs=1e-6)
    assert out[end - 2] - out[end - 1] == pytest.approx(np.log(n[a] / n[b]), abs=1e-6)
    frequent, counts, shares = LM.word_counts(docs)
    rows = shares.collect()
    assert len(rows) == len(n) - len(frequent) and counts.sum() == sum(n.values())
    total = Counter()
    for r in rows:
        total[bucket(r.word)] += np.exp(r.share / LM.FIXED)
    assert list(total.values()) == pytest.approx([1] * len(total))


def test_classes_follow_the_distinct_words(monkeypatch):
    assert LM.classes_for(400_000) == 32 and LM.classes_for(10 ** 8) == 100
    for c in (32, 41, 100, 300):
        assert LM.classes_of(LM.size_of(c)) == c
    p = LM.unpacked(np.random.default_rng(1).normal(0, 0.3, LM.size_of(40)))
    assert np.exp(LM.log_probs(p, np.tile([3, 1600, 70, 900], (1600, 1)), np.arange(1600))).sum() == pytest.approx(1)


def test_training_predicts_every_position(spark):
    r = random.Random(6)
    texts = [ordered(r) for _ in range(50)] + ["one", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    frequent, counts, _ = LM.word_counts(docs)
    start = LM.initial(counts)
    assert sum(LM.train_round(docs, i, frequent, start)[1] for i in range(LM.ROUNDS)) == 50 * 180 + 1


def test_gradient_whatever_classes_are_multiplied_together(monkeypatch):
    r, flat = np.random.default_rng(2), random_network()
    context, target = r.integers(0, LM.VOCAB + 1, (300, 4)), r.integers(0, LM.VOCAB, 300) // r.integers(1, 40, 300)
    want = None
    for few in (0, 3, 8, 1000):
        monkeypatch.setattr(LM, "FEW", few)
        got = LM.gradient(LM.unpacked(flat), context, target)
        want = got if want is None else want
        assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("known", [0, 700, 1 << 18])
def test_known_shares_are_not_joined(spark, monkeypatch, known):
    """Scores do not depend on how many rare words the workers are given; those given leave the join."""
    r = random.Random(8)
    texts = [" ".join(f"w{min(int(r.expovariate(0.002)), 2500)}" for _ in range(60)) for _ in range(400)] + [None, "", "w0 " * 50 + "w2499 only once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    n = Counter(w for t in texts for w in LM.words_of(t))
    frequent, _, shares = LM.word_counts(docs)
    want = {x.word: x.share for x in shares.collect()}
    monkeypatch.setattr(LM, "KNOWN", known)
    words, flat, others = LM.train(docs)
    _, top, given = words.value
    left = {x.word: x.share for x in others.collect()}
    sent = dict(zip(given.column("word").to_pylist(), given.column("share").to_pylist()))
    assert not left.keys() & sent.keys() and {**left, **sent} == want
    assert len(sent) <= known + len(frequent) and (known < len(want) or not left) and (known or not sent)
    assert not left or not sent or min(n[w] for w in sent) >= max(n[w] for w in left)
    vocab, p = LM.Vocabulary(top, LM.classes_of(len(flat)), given), LM.unpacked(flat)
    plain = LM.score_texts(texts, LM.Vocabulary(top, LM.classes_of(len(flat))), p)
    (_, sums, shared, rest), = LM.score_chunks(texts, vocab, p)
    assert sums == pytest.approx([x for _, x in plain], abs=1e-6) and all(w in left for _, w in rest)
    assert shared.tolist() == [sum(sent.get(w, 0) for w in LM.words_of(t)) for t in texts]
    out = {x.doc_id: x for x in LM.score(docs).collect()}
    for i, (text, (count, network)) in enumerate(zip(texts, plain)):
        rare = Counter(w for w in LM.words_of(text) if w in want)
        assert (out[i].n_words, out[i].log_prob) == (count, pytest.approx(network + sum(k * want[w] for w, k in rare.items()) / LM.FIXED, abs=1e-4))


def test_words_split_together_are_those_of_each_text(monkeypatch):
    every = [f"a{chr(c)}B{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["", None, " \x1c\u2003 ", "\x85One  TWO\x1fthree\u2028", "\u0130\u03a3 \u03a3\u03a3 \u200bx", *every]
    for some, split in ((texts, LM.SPLIT), (texts[:9], 10)):
        monkeypatch.setattr(LM, "SPLIT", split)
        got, want = list(LM.split_words(some)), [LM.words_of(t) for t in some]
        assert (len(got) > 1) == (split == 10)
        assert [k for n, _ in got for k in n.tolist()] == [len(w) for w in want]
        assert [w for _, words in got for w in words.to_pylist()] == [w for ws in want for w in ws]


def test_places_of_many_words():
    given = pa.table({"word": ["g1", "g2"], "bucket": pa.array([3, 5], pa.int32()), "share": pa.array([-7, -9], pa.int64())})
    vocab = LM.Vocabulary(["f0", "f1"], given=given)
    words = ["f1", "other", "g2", "f0", "other", "\u00e9t\u00e9", "g1"]
    bucket = lambda w: LM.VOCAB - LM.HASHED + zlib.crc32(w.encode()) % LM.HASHED
    want = [1, bucket("other"), LM.VOCAB + 2, 0, bucket("other"), bucket("\u00e9t\u00e9"), LM.VOCAB + 1]
    assert vocab.places(pa.array(words)).tolist() == want == [vocab[w] for w in words]
    assert vocab.outputs[want].tolist() == [i if i < LM.VOCAB else LM.VOCAB - LM.HASHED + (3, 5)[i - LM.VOCAB - 1] for i in want]
    assert len(vocab.places(pa.array([], pa.string()))) == 0


def test_extreme_outputs_neither_overflow_nor_vanish():
    r, flat = np.random.default_rng(2), random_network().astype(np.float32)
    p = LM.unpacked(flat)
    p["cw"][-1], p["ww"][:, -1] = r.choice([-500, 500], LM.CLASSES), r.choice([-300, -100], (LM.CLASSES, LM.CLASSES))
    p["w"][-1] = r.choice([-90, 90], LM.HIDDEN)
    context, target = r.integers(0, LM.VOCAB + 1, (60, 4)), r.integers(0, LM.VOCAB, 60)
    with np.errstate(all="raise", under="ignore"):
        logs, g = LM.log_probs(p, context, target), LM.gradient(p, context, target)
    exact = LM.unpacked(flat.astype(float))
    assert logs == pytest.approx(LM.log_probs(exact, context, target), rel=1e-5, abs=1e-3) and np.isfinite(g).all()
    assert logs.min() < -400


def test_vocabulary_is_looked_up_once_for_all_chunks(monkeypatch):
    """One lookup, which hashes the vocabulary, serves a whole block, and chunks do not change what is seen."""
    vocab, calls, places = LM.Vocabulary([f"w{i}" for i in range(50)]), [], LM.Vocabulary.places
    monkeypatch.setattr(LM.Vocabulary, "places", lambda self, words: calls.append(len(words)) or places(self, words))
    monkeypatch.setattr(LM, "CHUNK_WORDS", 12)
    texts = ["w1 w2 x", None, "w3", "", "w4 y z w5 w6 w7 w8 w9 w10 w11", "w12"]
    chunks = list(LM._flat_ids(texts, vocab))
    assert calls == [15] and len(chunks) > 1
    pad = [vocab.size] * LM.WINDOW
    for lengths, words, flat, at in chunks:
        words, want = words.to_pylist(), []
        assert len(words) == lengths.sum() == len(at)
        for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
            want += pad + [vocab[w] for w in words[end - n:end]] + pad
        assert flat.tolist() == want
        assert flat[at].tolist() == [vocab[w] for w in words]
    assert [n for lengths, *_ in chunks for n in lengths.tolist()] == [len(LM.words_of(t)) for t in texts]
