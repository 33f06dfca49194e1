"""Token counts against the tokenizer library on whole texts."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from storyspark.llm import token_counts as TC

SCHEMA = "doc_id long, text string, n_tokens string"
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [None, "", " ", "   \n\n  x", "don't we'll I'M it's 's 'd", "a<|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext|", "é😀 한국어 ١٢٣ ½",
         "՘ \U000107bb₏ x", "tab\t\ttab\r\n \x0b\x0c\x1c\x85\xa0 z", "x" * 50000, " " * 5000 + "y", "word " * 20000, "12345678901 3.14 -- !!"]


def random_texts():
    r = random.Random(6)
    bits = ["the", " ", "  ", "\n", "'s", "'", "é", "12", "##", "<|endoftext|>", "Zürich", "\t", "😀", "…", "x1", "　"]
    return ["".join(r.choices(bits, k=r.randrange(40))) for _ in range(300)]


def test_counts_equal_the_library(spark, library):
    texts = TEXTS + random_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a b", ""), (3, texts[3], ""), (3, texts[3], "")]
    out = TC.count_tokens(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN, sample_rows=50)
    got = sorted(map(tuple, out.collect()), key=str)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)


def test_small_caches_do_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(TC, "CACHE_ROWS", 3)
    monkeypatch.setattr(TC, "LONGEST", 2)
    with open(PATH, encoding="utf-8") as f:
        counter = TC.TokenCounter(f.read(), P.PATTERN, {" the": 1})
    for t in random_texts():
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_empty_table(spark):
    assert TC.count_tokens(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []
