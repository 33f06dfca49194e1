"""Quality rules per document, pooled by host, in Spark expressions only.

Two base rules reject a document by themselves. Softer rules give points:
repetition (words in repeated windows, or repeated lines) and symbols one beyond
their limit and two beyond twice that, odd word lengths one. A host's rate of
documents that fail any rule is shrunk to an empirical beta prior fitted to the
rates of all hosts, so a host with few documents is not judged by them alone.
A document goes at two points, or at one on a host whose shrunk rate reaches
``HOST_LIMIT``; a document without a point always stays.

Scale: the rules are row-local (whole texts, no explode); hosts are a combining
count, so a host with a third of the rows costs its map tasks only. The verdict
table has a row per bad host; AQE broadcasts it if it is small and splits a hot
host if it isn't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50          # base rule, percent of words
SOFT_REPEAT_PCT = 25
SOFT_SYMBOLS_PCT = 10        # symbols per 100 words
SOFT_LINES_PCT = 30          # repeated lines per 100 lines
WORD_CHARS = (3, 12)         # mean code points of a word
HOST_LIMIT = 0.5
FLAT_WEIGHT = 2.0            # prior weight when the host rates do not vary


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the feature columns (long), null text counting as empty.

    Words in repeated 3-word windows: windows are hashed to 64 bits, (hash,
    place) pairs sorted, equal neighbours mark places, and sorted places that
    lie less than three apart share words."""
    base = [c for c in docs.columns if c not in FEATURES]
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*base, text.alias("__t"))
    step = step.select(
        *base, "__t", F.array_remove(F.split("__t", r"[\x20\x09-\x0D]+", -1), "").alias("__w"),
        F.filter(F.split("__t", "\n", -1), lambda x: _without(x, WHITE) != "").alias("__l"))
    step = step.select(
        *base, "__t", "__w", "__l", F.when(F.size("__w") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("__w") - 3),
            lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("__h"))
    step = step.select(
        *base, "__t", "__w", "__l", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(
            F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__s"))
    hash_at = lambda k: F.get("__s", k)["h"]
    step = step.select(
        *base, "__t", "__w", "__l", F.when(F.size("__s") > 0, F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size("__s") - 1),
                     lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False))
                     | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False))),
            lambda k: F.get("__s", k)["i"])))
        .otherwise(F.array().cast("array<int>")).alias("__p"))
    place = lambda k: F.get("__p", k)
    covered = F.when(F.size("__p") > 0, F.aggregate(
        F.sequence(F.lit(0), F.size("__p") - 1), F.lit(0).cast("long"),
        lambda n, k: n + F.least(F.lit(3), F.coalesce(place(k + 1) - place(k), F.lit(3))))).otherwise(0)
    return step.select(
        *base, F.size("__w").cast("long").alias("n_words"),
        F.length(_without(F.col("__t"), WHITE)).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"))


def base_failed() -> Column:
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * n)


def soft_failures() -> Column:
    """Points of the softer rules. Repeated lines repeat their words too, so of
    these two the worse one counts."""
    n = F.col("n_words")

    def points(part: str, of: str, pct: int) -> Column:
        share = 100 * F.col(part)
        return (share > pct * F.col(of)).cast("int") + (share > 2 * pct * F.col(of)).cast("int")

    odd = (F.col("word_chars") < WORD_CHARS[0] * n) | (F.col("word_chars") > WORD_CHARS[1] * n)
    return (F.greatest(points("n_repeat_words", "n_words", SOFT_REPEAT_PCT), points("n_dup_lines", "n_lines", SOFT_LINES_PCT))
            + points("n_symbols", "n_words", SOFT_SYMBOLS_PCT) + odd.cast("int"))


def host_table(judged: DataFrame, host_col: str = "source") -> DataFrame:
    """``(host, n, failed, rate)`` of rows with ``base_failed`` and ``points``: documents,
    documents with any failure, and that share shrunk to the beta prior of all hosts
    (method of moments)."""
    hosts = cut_lineage(
        judged.groupBy(F.coalesce(F.col(host_col), F.lit("")).alias("host"))
        .agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | (F.col("points") > 0)).cast("long")).alias("failed")))
    share = F.col("failed") / F.col("n")
    mean, var = hosts.agg(F.avg(share), F.var_samp(share)).first()
    weight = FLAT_WEIGHT
    if mean is not None and var and var < mean * (1 - mean):
        weight = mean * (1 - mean) / var - 1
    mean = mean or 0.0
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def _with_verdict(judged: DataFrame, hosts: DataFrame, host_col: str, limit: float) -> DataFrame:
    """``kept`` beside ``base_failed`` and ``points``. Where no host reaches the limit
    (one at the limit does) only the documents' own points count."""
    bad = hosts.where(F.col("rate") >= limit).select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    allowed = F.when(F.col("__bad"), 1).otherwise(2)
    return (judged.join(bad, F.coalesce(F.col(host_col), F.lit("")) == F.col("__host"), "left")
            .withColumn("kept", ~F.col("base_failed") & (F.col("points") < allowed))
            .drop("__host", "__bad"))


def judge(docs: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``(doc_id, host column, features, base_failed, points, kept)``, one row per
    input row; texts are read once. A null host counts as the host ''; repeated
    rows are judged alike; an empty table gives no rows. Columns of ``docs``
    other than these are ignored, whatever their names."""
    features = with_features(docs.select("doc_id", host_col, "text")).drop("text")
    judged = cut_lineage(features.withColumn("base_failed", base_failed()).withColumn("points", soft_failures()))
    return _with_verdict(judged, host_table(judged, host_col), host_col, limit)


def kept_documents(docs: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns. Features are computed once: rows go
    to the shared folder with their points, hosts are counted from the narrow
    columns there, and the rows are read again under the verdict."""
    spark = docs.sparkSession
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col(host_col).alias("__h0"), "text")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/host-rules-{uuid.uuid4().hex}"
    (with_features(row).withColumn("base_failed", base_failed()).withColumn("points", soft_failures())
     # a row that no verdict can keep is counted, not written
     .select(F.when(~F.col("base_failed") & (F.col("points") < 2), F.col("__row")).alias("__row"), "__h0", "base_failed", "points")
     .write.parquet(folder))
    judged = spark.read.parquet(folder)
    return _with_verdict(judged, host_table(judged, "__h0"), "__h0", limit).where("kept").select("__row.*")


JUDGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, i + unnest([0, 1, 2]) AS j FROM r) GROUP BY k),
f AS (SELECT d.doc_id, d.host, len(w.w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(w.l) - len(list_distinct(w.l)))::BIGINT AS n_dup_lines,
        coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(w.l)::BIGINT AS n_lines
      FROM d JOIN w USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        greatest((100 * n_repeat_words > 25 * n_words)::INT + (100 * n_repeat_words > 50 * n_words)::INT,
                 (100 * n_dup_lines > 30 * n_lines)::INT + (100 * n_dup_lines > 60 * n_lines)::INT)
        + (100 * n_symbols > 10 * n_words)::INT + (100 * n_symbols > 20 * n_words)::INT
        + (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT AS soft FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft > 0) AS failed FROM b GROUP BY host),
m AS (SELECT avg(failed / n) AS m, var_samp(failed / n) AS v FROM h),
p AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 2.0 END AS weight FROM m),
bad AS (SELECT host FROM h, p WHERE (failed + m * weight) / (n + weight) >= 0.5)
"""

QUERY_SQL = JUDGE_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft < 2 AND (soft < 1 OR host NOT IN (SELECT host FROM bad)) AS kept FROM b
"""
