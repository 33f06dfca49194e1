"""Personal data against a plain reading of the rules."""

import hashlib
import random
import re

import pytest

from storyspark.llm import pii

SCHEMA = "doc_id long, text string"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_base(text):
    text = text or ""
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    return [(k, x.start(), x.end()) for k, r, ok in rules for x in re.finditer(r, text) if ok(x.group())]


ALPHABET = ["1", "23", "4556737586899855", "4", ".", "@", "a", "é", "😀", "-", " ", "+", "(", ")", "_", "0255", "256", "\n",
            "x@y.z", "1.2.3.4", "+49 30 1234567", "4556 7375 8689 9855", "%", "..", "a@b.c_d@e.f"]


def test_base_spans_match_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(ALPHABET, k=r.randrange(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "a@b.c_d@e.f and 1.2.3.4.5.6.7.8", "+1 2", "++12345678901 +1-", "00001.2.3.255 1.2.3.0000000000000000001",
              "a@b" + ".c" * 20000, "7" * 50000, "1." * 30000, "y" * 100000 + "@z.q", "+" + "1 " * 20000, "x@y.z " * 3000]
    texts += [texts[0]] * 2
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for row in pii.pii_digest(df).collect():
        want = brute_base(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id][:200]
        counts = [sum(k == n for k, _, _ in want) for n in pii.BASE]
        assert counts == [row.n_email, row.n_ip, row.n_card, row.n_phone]
        base = [s for s in row.spans.split(",") if s.split(":")[0] in pii.BASE]
        assert ",".join(base) == joined


@pytest.mark.parametrize("text, kind", [
    ("send to GB82 WEST 1234 5698 7654 32 today", "iban"), ("IBAN DE89370400440532013000.", "iban"),
    ("his ssn 123-45-6789 is", "ssn"), ("please call (212) 555-0142 now", "local_phone"),
    ("GB82 WEST 1234 5698 7654 33", None), ("123-45-6789 parts", None), ("ssn 000-45-6789", None),
    ("dial 212-555-0142 units", None), ("example ssn 123-45-6789", None)])
def test_further_kinds(spark, text, kind):
    got = pii.pii_digest(spark.createDataFrame([(1, text)], SCHEMA)).first()
    extra = [s.split(":")[0] for s in got.spans.split(",") if s and s.split(":")[0] not in pii.BASE]
    assert extra == ([kind] if kind else []) and got.n_extra == len(extra)


def test_context_moves_the_score(spark):
    df = spark.createDataFrame([(1, "visa card 4556737586899855"), (2, "sample 4556737586899855")], SCHEMA)
    got = [s.score for r in pii.with_spans(df, keep=("doc_id",)).orderBy("doc_id").collect() for s in r.spans if s.kind == "card"]
    assert got == [1.0, 0.4]


def test_redaction(spark):
    rows = [(1, "Mail a@b.cd, or +1 (212) 555-0142!", "x", 34), (2, None, "y", 0), (3, "", None, 0), (4, "clean é😀", "z", 8),
            (5, "+4556737586899855 end", "w", 21), (5, "+4556737586899855 end", "w", 21), (None, "1.2.3.4", "v", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([
        (1, "Mail <EMAIL>, or <PHONE>!", "x", 25), (2, None, "y", 0), (3, "", None, 0), (4, "clean é😀", "z", 8),
        (5, "+<CARD> end", "w", 11), (5, "+<CARD> end", "w", 11), (None, "<IP>", "v", 4)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.pii_digest(df).collect() == [] and pii.redact(df).collect() == []
