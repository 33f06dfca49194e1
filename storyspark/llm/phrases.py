"""Collocations per language from one pass over the longest windows.

Every word occurrence opens one window: itself and the next ``LONGEST - 1`` words of its
piece, taken from lead columns and padded where the piece ends. Only these longest windows
are counted. The count of any shorter phrase is the sum over the windows it
begins, so Spark's ROLLUP over (lang, w1, ..., w_LONGEST) gives the phrases of every
length, the words and the words' total at once.

In the sums words are 64-bit hashes; a table of all distinct words names them, and if two
words of a corpus ever share a hash, other hashes are taken, so counts are exact.

Scale: windows are counted per chunk of texts and travel packed, by hash of
their head (all words but the last), so the task of a bucket has all windows of its heads
and sums both. Windows of rare heads leave it as one row per shorter head (all sums stay
whole); what is rolled up, joined and ranked is little more than the frequent phrases and the
words. A frequent word or language is spread over the words that follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

LONGEST = 3              # words of the longest phrase
LEAST = 10               # occurrences of a candidate
INSIDE_PCT = 50          # a longer candidate with this share of a phrase's count hides it
TOP = 2000               # rows per language
PPM = 1_000_000
CHUNK_BYTES = 16 << 20   # of text counted at a time, but whole documents
BUCKET_BYTES = 16 << 20  # of text whose windows meet in one bucket, on average
NO_LANG = "und"
PAD = 0                  # where a window reaches beyond its piece; no word has this number
HELD_WORDS = 1_000_000   # words a task remembers to have named

_EDGE = b"\n"
# fixed values: the characters that end a piece, and the two that separate words
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _EDGE * 9)


def _tokens(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(ids of the words in order, -1 at every end of a piece; the distinct words)."""
    joined = _EDGE.join([t.encode("utf-8", "replace") for t in texts]).translate(_TABLE).replace(_EDGE, b" \n ")
    flat = pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    ids, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    blank, edge = pc.index(words, "").as_py(), pc.index(words, "\n").as_py()
    ids = ids[ids != blank]
    ids[ids == edge] = -1
    return ids, words


def windows(texts: list[str], longest: int = LONGEST) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, distinct padded windows as rows of word numbers, -1 = pad, their counts)."""
    ids, words = _tokens(texts)
    lead = np.full((longest, len(ids)), -1, np.int64)
    lead[0] = ids
    for k in range(1, longest):
        # the k-th next word, unless a piece ended before it
        lead[k, :len(ids) - k] = ids[k:]
        lead[k][lead[k - 1] < 0] = -1
    rows = lead[:, ids >= 0]
    if not rows.shape[1]:
        return words, np.empty((0, longest), np.int64), np.empty(0, np.int64)
    size = len(words) + 1
    if size ** longest < 1 << 63:
        key = np.zeros(rows.shape[1], np.int64)
        for r in rows:
            key = key * size + r + 1
        key, n = np.unique(key, return_counts=True)
        out = np.empty((len(key), longest), np.int64)
        for k in range(longest - 1, -1, -1):
            key, out[:, k] = key // size, key % size - 1
        return words, out, n
    out, n = np.unique(rows.T, axis=0, return_counts=True)
    return words, out, n


def word_number(word: str, seed: int) -> int:
    """Signed 64-bit hash of a word, never ``PAD``."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8"), seed) or 1
    return h - (1 << 64) if h >> 63 else h


def _chunks(batches: Iterator[pa.RecordBatch], key: str | None = None) -> Iterator[tuple[int, list[str]]]:
    """(key, texts) of about CHUNK_BYTES together for all keys, whole texts."""
    held: dict[int, list[str]] = {}
    size = 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, text in zip(batch.column(key).to_pylist() if key else [0] * len(texts), texts):
            held.setdefault(k, []).append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _with_lang(docs: DataFrame, seed: int) -> DataFrame:
    lang = F.coalesce("lang", F.lit(NO_LANG))
    return docs.select(lang.alias("name"), F.xxhash64(F.lit(seed), lang).alias("lang"), "text")


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of some 64-bit columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (h >> np.uint64(29))) * _STEP + c.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _planes(c: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, which packs better."""
    return c.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _packed(lang: int, number: np.ndarray, rows: np.ndarray, n: np.ndarray) -> bytes:
    """Windows (rows of places in ``number``, sorted) and their counts, with the numbers they use."""
    used, place = np.unique(rows, return_inverse=True)
    place = place.reshape(rows.shape).T.copy()
    place[0, 1:] -= place[0, :-1].copy()
    head = np.array([lang, len(used), len(n)], "<i8").tobytes()
    return head + zstandard.compress(number[used].tobytes() + b"".join(map(_planes, place)) + n.astype("<i8").tobytes(), 1)


def _unpacked(blob: bytes, longest: int) -> tuple[int, np.ndarray, list[np.ndarray], np.ndarray]:
    """(lang, numbers, places in them for each column, counts)."""
    lang, used, size = np.frombuffer(blob, "<i8", 3).tolist()
    raw = zstandard.decompress(blob[24:])
    planes = np.frombuffer(raw, np.uint8, 4 * longest * size, 8 * used).reshape(longest, 4, size)
    place = [np.ascontiguousarray(c.T).view("<i4").ravel() for c in planes]
    place[0] = np.cumsum(place[0], dtype=np.int32)
    return lang, np.frombuffer(raw, "<i8", used), place, np.frombuffer(raw, "<i8", size, 8 * used + 4 * longest * size)


def _bucketed(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in order) of each bucket that has some."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if at[b] < at[b + 1]:
            yield b, order[at[b]:at[b + 1]]


_PACKED = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def bucket_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def window_counts(docs: DataFrame, seed: int, buckets: int, longest: int = LONGEST) -> DataFrame:
    """``(bucket, data)``: counts of the padded windows of every chunk of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _chunks(batches, "lang"):
            words, rows, n = windows(texts, longest)
            if len(n):
                number = np.array([word_number(w, seed) for w in words.to_pylist()] + [PAD], np.int64)
                head = _mixed([np.full(len(n), lang), *[number[c] for c in rows.T[:-1]]])
                yield _batch([(b, _packed(lang, number, rows[at], n[at])) for b, at in _bucketed(head, buckets)])

    return _with_lang(docs, seed).where("text is not null").select("lang", "text").mapInArrow(run, "bucket int, data binary")


def names(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``(id, word)`` of all distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: set[str] = set()
        for _, texts in _chunks(batches):
            _, words = _tokens(texts)
            new = [w for w in words.to_pylist() if w not in named and w not in ("", "\n")]
            if new:
                number = np.array([word_number(w, seed) for w in new], np.int64)
                yield _batch([(b, zstandard.compress("\n".join([new[i] for i in at.tolist()]).encode(), 1)) for b, at in _bucketed(_mixed([number]), buckets)])
            named = set() if len(named) > HELD_WORDS else named
            named.update(new)

    def distinct(table: pa.Table) -> pa.Table:
        words = sorted({w for blob in table.column("data").to_pylist() for w in zstandard.decompress(blob).decode().split("\n")})
        return pa.Table.from_arrays([pa.array([word_number(w, seed) for w in words], pa.int64()), pa.array(words, pa.string())], ["id", "word"])

    sent = docs.select("text").where("text is not null").mapInArrow(run, "bucket int, data binary").repartition(buckets, "bucket")
    return cut_lineage(sent.groupBy("bucket").applyInArrow(distinct, "id long, word string"))


def _ambiguous(table: DataFrame, number: str) -> bool:
    """Does one number stand for two names?"""
    rows, numbers = table.agg(F.count("*"), F.count_distinct(number)).first()
    return rows != numbers


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and the sums of their counts."""
    if not len(n):
        return columns, n
    h = _mixed(columns)
    order = np.argsort(h)
    columns = [c[order] for c in columns]
    new = np.any([np.diff(c) != 0 for c in columns], axis=0)
    if (new & (np.diff(h[order]) == 0)).any():           # rows that share a hash may lie mixed
        again = np.lexsort(columns)
        order, columns = order[again], [c[again] for c in columns]
        new = np.any([np.diff(c) != 0 for c in columns], axis=0)
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


def _folded(least: int, longest: int):
    """The packed windows of a bucket -> rows ``(lang, w1, ..., w_longest, n)`` with the same
    sums over every prefix: windows of a head met fewer than ``least`` times are one row per
    shorter head, those of a frequent head one padded row beside its frequent windows
    (which are taken off it)."""
    columns = ["lang", *[f"w{k + 1}" for k in range(longest)], "n"]

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(b, longest) for b in table.column("data").to_pylist()]
        # 32-bit places in the bucket's own tables of languages and words, until the end
        langs, number = np.unique([p[0] for p in parts]), np.unique(np.concatenate([[PAD], *[p[1] for p in parts]]))
        rows = [np.concatenate([np.full(len(p[3]), np.searchsorted(langs, p[0]), np.int32) for p in parts])]
        own = [np.searchsorted(number, p[1]).astype(np.int32) for p in parts]
        rows += [np.concatenate([t[p[2][k]] for t, p in zip(own, parts)]) for k in range(longest)]
        n = np.concatenate([p[3] for p in parts])
        del parts, own
        pad = int(np.searchsorted(number, PAD))
        rows, n = _summed(rows, n)
        heads, all_n = _summed(rows[:-1], n)
        big = (n >= least) & (rows[-1] != pad)
        kept, kept_n = [c[big] for c in rows], n[big]
        pads = lambda k: np.full(k, pad, np.int32)
        out = [(kept, kept_n), ([*kept[:-1], pads(len(kept_n))], -kept_n)]
        often = (all_n >= least) | (longest == 2)        # a head of one word always stays
        out.append(([*[c[often] for c in heads], pads(often.sum())], all_n[often]))
        if longest > 2:
            short, short_n = _summed([c[~often] for c in heads[:-1]], all_n[~often])
            out.append(([*short, pads(len(short_n)), pads(len(short_n))], short_n))
        names_of = [langs, *[number] * longest]
        return pa.Table.from_arrays([*[pa.array(t[np.concatenate([o[0][k] for o in out])]) for k, t in enumerate(names_of)],
                                     pa.array(np.concatenate([o[1] for o in out]))], columns)
    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``(lang, size, phrase, n)``: counts of the phrases of 1 to ``longest`` words met
    ``least`` times, and of all word occurrences (size 0, an empty phrase), per language."""
    seed, buckets = 0, bucket_count(docs)
    while True:
        word_names = names(docs, buckets, seed)
        lang_names = cut_lineage(_with_lang(docs, seed).select("lang", "name").distinct())
        if not _ambiguous(word_names, "id") and not _ambiguous(lang_names, "lang"):
            break
        seed += 1
    words = [f"w{k + 1}" for k in range(longest)]
    ddl = ", ".join(f"{c} long" for c in ["lang", *words, "n"])
    dealt = window_counts(docs, seed, buckets, longest).repartition(buckets, "bucket")
    sums = (dealt.groupBy("bucket").applyInArrow(_folded(least, longest), ddl)
            .rollup("lang", *words).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid")))
    # grouping_id has a bit for every column that is summed over
    sized = sums.where(F.col("gid") < (1 << longest)).withColumn("size", (F.lit(longest) - F.bit_count("gid")).cast("int"))
    whole = F.forall(F.slice(F.array(*words), F.lit(1), F.col("size")), lambda w: w != PAD)
    out = cut_lineage(sized.where(whole & ((F.col("size") < 1) | (F.col("n") >= least))).select("lang", "size", *words, "n"))
    for w in words:
        out = out.join(word_names.select(F.col("id").alias(w), F.col("word").alias(f"{w}_name")), w, "left")
    return cut_lineage(out.join(lang_names, "lang").select(
        F.col("name").alias("lang"), "size", F.concat_ws(" ", *[f"{w}_name" for w in words]).alias("phrase"), "n"))


def _part(words: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, inside_pct: int = INSIDE_PCT, top: int = TOP,
                 longest: int = LONGEST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to ``longest`` words
    of each language by score, then count, then UTF-8 order. ``score`` is that of the cut that
    scores lowest (of equals the earliest), floor(10^6 a a / (l r)) in 38-digit
    integers. A phrase inside a longer one with ``inside_pct`` percent of its count or more is left out.

    Null lang counts as ``und``; null and empty texts have no words; repeated rows count
    as often as they occur; other columns are ignored, whatever their names; an empty
    table gives no rows."""
    counts = phrase_counts(docs, least, longest)
    candidates = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("w"))
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("first"),
                    _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("second")))
    known = counts.where("size > 0")
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
            .join(known.select("lang", F.col("phrase").alias("second"), F.col("n").alias("r")), ["lang", "second"]))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("aa", (whole("a") * whole("a") * F.lit(PPM).cast("decimal(7,0)"))).withColumn("lr", whole("l") * whole("r"))
    scored = cuts.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct(F.expr("aa div lr").alias("score"), "k", "l", "r")).alias("cut"))
    if longest > 2:
        spans = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))")
        inside = (candidates.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "a")
                  .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
        scored = (scored.join(inside, ["lang", "phrase"], "left")
                  .where(F.col("longer").isNull() | (100 * F.col("longer") < inside_pct * F.col("a"))))
    place = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
                                             F.col("cut.score").alias("score"))


COLLOCATIONS_SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS k, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
w AS (SELECT lang, k, i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM p)),
f AS (SELECT lang, w1 AS phrase, 1 AS size, count(*) AS n FROM w GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r,
    ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
hid AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM c WHERE size = 3) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, t.n, score
FROM best JOIN t ON t.lang = best.lang LEFT JOIN hid ON hid.lang = best.lang AND hid.phrase = best.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""
