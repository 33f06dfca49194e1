"""The corpus pipeline against plain Python, stage by stage."""

import random
import re
import zlib

import numpy as np

import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline as CP
from storyspark.llm import decontam as DC
from storyspark.llm import host_rules as HR

from .test_decontam import least_distance
from .test_host_rules import brute as brute_features
from .test_pii import brute_base
from .test_simhash_cover import brute_components, brute_fingerprint

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def make_tables(folder):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9)))
    prose = lambda: " ".join(word() for _ in range(90))
    items = [" ".join(word() for _ in range(14)) for _ in range(4)]
    texts = [prose() for _ in range(30)]
    texts += [t.replace("a", "A", 3) for t in texts[:8]] + texts[:5]
    texts += [f"{prose()} {items[i]} {prose()}" for i in range(4)]
    texts += [f"{prose()} reach me at a{i}.b@mail.example.org or +1 (212) 555-0{100 + i} from 10.0.{i}.7 {prose()}" for i in range(5)]
    texts += ["too short", None, "", "a b c " * 60, prose() + " |#%" * 40 + "\nx" * 30]
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose(), None, "s0", 1)]
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(4), pa.int64()), "text": items}), f"{folder}/benchmark.parquet")
    return rows, items


def failures(text):
    n, chars, symbols, dup, repeat, failed = brute_features(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    points = lambda part, of, pct: (100 * part > pct * of) + (100 * part > 2 * pct * of)
    soft = max(points(repeat, n, 25), points(dup, lines, 30)) + points(symbols, n, 10) + (chars < 3 * n or chars > 12 * n)
    return failed, soft


def brute(rows, items):
    judged = [(*failures(t), s or "") for _, t, _, s, _ in rows]
    hosts = {h: [f or n > 0 for f, n, x in judged if x == h] for _, _, h in judged}
    shares = [sum(x) / len(x) for x in hosts.values()]
    mean, var = np.mean(shares), np.var(shares, ddof=1)
    weight = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 2.0
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) >= HR.HOST_LIMIT}
    one = [r for r, (f, n, h) in zip(rows, judged) if not f and n < 2 and (n < 1 or h not in bad)]
    component = {}
    for i, f, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in one]):
        component[f] = c
    two, seen = [], set()
    for r in sorted(one, key=lambda r: (r[0] is None, r[0] or 0)):
        c = component[f"{brute_fingerprint(r[1]):016x}"]
        if c not in seen:
            seen.add(c)
            two.append(r)
    three = [r for r in two if all(least_distance(DC.normalized(x), DC.normalized(r[1])) > DC.budget(len(DC.normalized(x))) for x in items)]
    out = {}
    for i, t, lang, s, n in three:
        for kind, a, b in sorted(brute_base(t), key=lambda x: -x[1]):
            t = t[:a] + f"<{kind.upper()}>" + t[b:]
        out[i] = t
    return one, two, three, out


def test_stages_match_brute_force(spark, tmp_path):
    rows, items = make_tables(tmp_path)
    one, two, three, texts = brute(rows, items)
    assert len(rows) > len(one) > len(two) > len(three) > 20
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda rs: sorted((r[0] for r in rs), key=str)
    for (_, stage), want in zip(CP.STAGES[:4], [one, two, three, three]):
        docs_out = stage(spark, docs, str(tmp_path))
        assert docs_out.columns == docs.columns and docs_out.dtypes == docs.dtypes
        got = docs_out.collect()
        assert ids(got) == ids(want)
        docs = spark.createDataFrame(got, docs.schema)
    assert {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got if r.text != dict((x[0], x[1]) for x in rows)[r.doc_id])


def test_run_packs_the_clean_texts(spark, tmp_path):
    rows, items = make_tables(tmp_path)
    texts = brute(rows, items)[3]
    library = Tokenizer.from_file(CP.TOKENIZER)
    want = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                   for i, t in texts.items() for ids in [library.encode(t, add_special_tokens=False).ids + [2]]), key=str)
    got = CP.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got), key=str) == want


def test_stages_take_an_empty_table(spark, tmp_path):
    make_tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in CP.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
