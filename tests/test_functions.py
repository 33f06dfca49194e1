"""Scalar rules (H rows) against the Python semantics they port."""

import hashlib
from urllib.parse import urlparse, urlunparse

from pyspark.sql import functions as F

from storyspark.functions import simhash as SH
from storyspark.functions import text as TX
from storyspark.functions import urls as U
from storyspark.functions.topics import classify_topic


def _py_url_hash(url):
    p = urlparse(url)
    n = urlunparse((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", p.params, p.query, ""))
    return hashlib.sha256(n.encode()).hexdigest()


URLS = ["https://Example.COM/a/b/", "https://example.com/a/b", "https://example.com/a/b#frag",
        "https://example.com/a/b?x=1", "https://example.com/", "https://example.com",
        "HTTP://Host:8080/Path/?q=A#x", "https://example.com/a/b;p=1?x=2",
        "https://example.com/a/;p=1/"]


def test_url_hash_matches_urllib(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: r.h for r in df.select("url", U.url_hash("url").alias("h")).collect()}
    for u in URLS:
        assert got[u] == _py_url_hash(u), u
    # host case and trailing slash are equal; query is not
    assert got["https://Example.COM/a/b/"] == got["https://example.com/a/b"] == got["https://example.com/a/b#frag"]
    assert got["https://example.com/a/b?x=1"] != got["https://example.com/a/b"]


def test_url_hash_pages_match_urllib(spark):
    import pandas as pd
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet", columns=["url"])
    df = spark.createDataFrame(pages)
    got = df.select("url", U.url_hash("url").alias("h")).toPandas()
    assert all(h == _py_url_hash(u) for u, h in zip(got.url, got.h))


def test_normalize_url_and_item_key(spark):
    rows = [("https://Ex.com/a/?utm_source=x&b=2#f",), ("https://ex.com/",), ("https://ex.com",),
            ("https://ex.com/p?utm_medium=a",), ("https://ex.com/p?a=&b=1",), (None,), ("https://ex.com/p?",),
            ("https://ex.com/p?b=2&a=1&b=3&UTM_Id=4&c&=5",), ("https://ex.com/p?q=a+b%20c%zz&%75tm_x=1&k~*=%C3%A9",)]
    df = spark.createDataFrame(rows, "url string")
    got = [r.n for r in df.select(U.normalize_url(F.col("url")).alias("n")).collect()]
    assert got == ["https://ex.com/a?b=2", "https://ex.com/", "https://ex.com/", "https://ex.com/p", "https://ex.com/p?b=1", None,
                   "https://ex.com/p", "https://ex.com/p?b=2&b=3&a=1&=5", "https://ex.com/p?q=a+b+c%25zz&k~%2A=%C3%A9"]
    k = spark.createDataFrame([(" id1 ", "https://x.com/a?utm_source=z"), (None, " https://x.com/a/ "),
                               (None, None), ("  ", "")], "guid string, link string")
    keys = [r.k for r in k.select(U.item_key("guid", "link").alias("k")).collect()]
    assert keys == ["guid:id1", "link:https://x.com/a", None, None]


def test_simhash_matches_python_and_ties(spark):
    texts = ["The quick brown fox jumps over the lazy dog", "a b", "", "   ", "One", "x y z w " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(SH.simhash128("t").alias("s")).collect()
    for t, r in zip(texts, got):
        hi, lo = SH.simhash_py(t)
        assert (r.s.sim_hi, r.s.sim_lo) == (hi, lo)
    assert SH.simhash_py("") == (0, 0)


def _flip(hi, lo, bits):
    v = ((hi & (2**64 - 1)) << 64) | (lo & (2**64 - 1))
    for b in bits:
        v ^= 1 << b
    h, l = v >> 64, v & (2**64 - 1)
    return (h - 2**64 if h >= 2**63 else h), (l - 2**64 if l >= 2**63 else l)


def test_hamming_and_bands(spark):
    hi, lo = SH.simhash_py("some text for the fingerprint under test here")
    h2, l2 = _flip(hi, lo, [3, 100])
    df = spark.createDataFrame([(hi, lo, h2, l2)], "a long, b long, c long, d long")
    r = df.select(SH.hamming("a", "b", "c", "d").alias("d"),
                  SH.reference_bands("a", "b").alias("bands"), SH.simhash_hex("a", "b").alias("hx")).first()
    assert r.d == 2
    v = ((hi & (2**64 - 1)) << 64) | (lo & (2**64 - 1))
    assert [b.value for b in r.bands] == [hex((v >> (8 * i)) & 0xFFFF)[2:] for i in range(16)]
    assert r.hx == hex(v)[2:]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Hello\t\nWORLD  x ", " a ;; b ; ", "2024-01-05", "said it")],
                               "t string, a string, d string, s string")
    r = df.select(TX.normalize_text("t").alias("n"), TX.split_authors("a").alias("au"),
                  TX.parse_day("d").alias("day"), TX.parse_day(F.lit("05/01/2024")).alias("bad"),
                  classify_topic("s").alias("topic"),
                  TX.backoff_seconds(F.lit(600), F.lit(4)).alias("b4"),
                  TX.backoff_seconds(F.lit(600), F.lit(10)).alias("b10")).first()
    assert r.n == "hello world x"
    assert r.au == ["a", "b"]
    assert str(r.day).startswith("2024-01-05") and r.bad is None
    assert r.topic == "Technology"      # plain substring rule: "ai" in "said"
    assert r.b4 == 9600 and r.b10 == 86400


def test_min_content_filter(spark):
    from storyspark.operators.filters import min_content
    df = spark.createDataFrame([(1, "x" * 49), (2, "  " + "y" * 50 + "  "), (3, None)], "id int, content string")
    got = {r.id: r.content_length for r in min_content(df).collect()}
    assert got == {2: 50}


def test_one_class_of_white_space(spark):
    from storyspark.functions.simhash import simhash_py, simhash128
    t = " One\x1ctwo\x1f three\x85\xa0four\u3000 "
    r = spark.createDataFrame([(t, "2024-01-01")], "t string, d string").select(
        TX.normalize_text("t").alias("n"), simhash128(F.col("t")).alias("s")).first()
    assert r.n == "one two three four" == " ".join(t.lower().split())
    assert (r.s.sim_hi, r.s.sim_lo) == simhash_py(t) == simhash_py("one two three four")


def test_days_have_four_digit_years(spark):
    days = ["2024-01-05", "2024-1-5", "24-1-1", "12024-01-01", "2024-13-01", "", None, " 2024-01-05"]
    got = [r.d for r in spark.createDataFrame([(d,) for d in days], "d string").select(TX.parse_day("d").alias("d")).collect()]
    assert [str(d)[:10] if d else None for d in got] == ["2024-01-05", "2024-01-05"] + [None] * 6
