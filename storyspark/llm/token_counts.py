"""Token counts by a map-side two-tier lookup.

A byte-level BPE never merges across pre-tokens, so a text's token count is
the sum of its pre-tokens' counts. Tier one is a compact table of frequent
pre-tokens and their counts, learnt from a bounded random sample of documents
(``SAMPLE_ROWS`` on average, ``TABLE_ROWS`` kept) and broadcast (its size is
fixed by ``TABLE_ROWS`` x ``LONGEST`` characters). Tier two is a cache in each
worker: a miss is encoded by the tokenizer library and remembered, up to
``CACHE_ROWS`` entries, then the cache falls back to tier one. Both tiers only
save work; the counts are the library's. No pre-token is ever shuffled.

The library and the splitting module may know different Unicode versions; a
text with a code point that Python's own tables leave unassigned is therefore
encoded whole by the library.

"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024            # a document with more tokens is over the limit
SAMPLE_ROWS = 4000
TABLE_ROWS = 50_000
CACHE_ROWS = 500_000
LONGEST = 64            # characters of a pre-token that is remembered


class _Lengths(dict):
    """pre-token -> tokens; a missing one is encoded and remembered."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self._encode, self._frequent = tokenizer.encode, frequent

    def __missing__(self, token: str) -> int:
        n = len(self._encode(token, add_special_tokens=False))
        if len(token) <= LONGEST:
            if len(self) >= CACHE_ROWS + len(self._frequent):
                self.clear()
                self.update(self._frequent)
            self[token] = n
        return n


def _unassigned() -> re.Pattern:
    """Matches a code point without a category in Python's Unicode tables."""
    ranges, start = [], None
    for cp in range(sys.maxunicode + 2):
        free = cp <= sys.maxunicode and unicodedata.category(chr(cp)) == "Cn"
        if free and start is None:
            start = cp
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


_UNUSUAL = re.compile("[^\x00-\u024f]").search     # all assigned up to there


class TokenCounter:
    """Counts tokens of texts; lives in a worker."""

    def __init__(self, tokenizer_json: str, pattern: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(pattern).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # longest first, as the library finds them; each counts one token
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.lengths = _Lengths(self.tokenizer, frequent or {})
        self.unassigned = _unassigned().search

    def pieces(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def count(self, text: str) -> int:
        if _UNUSUAL(text) and self.unassigned(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        pieces, of = self.pieces(text), self.lengths.__getitem__
        return len(pieces) - 1 + sum(sum(map(of, self.split(p))) for p in pieces)


_WORKER: dict = {}


def frequent_table(docs: DataFrame, tokenizer_json: str, pattern: str, sample_rows: int = SAMPLE_ROWS,
                   table_rows: int = TABLE_ROWS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Tier one as (blob of keys, their byte ends, token counts). The sampled
    documents meet in one task, which counts pre-tokens and encodes the
    ``table_rows`` most frequent; only those reach the driver."""
    n = docs.count()
    sample = docs.select("text").where("text is not null").sample(min(1.0, sample_rows / max(n, 1)), seed=11)

    def learn(batches):
        counter, seen = TokenCounter(tokenizer_json, pattern), Counter()
        for batch in batches:
            for text in batch["text"]:
                for piece in counter.pieces(text):
                    seen.update(t for t in counter.split(piece) if len(t) <= LONGEST)
                if len(seen) > 20 * table_rows:   # keep the counts bounded
                    seen = Counter(dict(seen.most_common(10 * table_rows)))
        top = [t for t, _ in seen.most_common(table_rows)]
        yield pd.DataFrame({"token": pd.Series(top, dtype=object),
                            "n": pd.Series([counter.lengths[t] for t in top], dtype="int32")})

    rows = sample.repartition(1).mapInPandas(learn, "token string, n int").collect()
    keys = [r.token.encode() for r in rows]
    return b"".join(keys), np.cumsum([len(k) for k in keys], dtype=np.int64), np.array([r.n for r in rows], np.uint16)


def _unpack(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, lengths = table
    starts = [0, *ends[:-1].tolist()] if len(ends) else []
    return {blob[a:b].decode(): int(n) for a, b, n in zip(starts, ends.tolist(), lengths)}


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = LIMIT,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    Counts are the library's for the whole text without added begin, end or
    template tokens; special strings inside a text count one token each. Null
    text counts as empty (0, 0, false). Repeated rows and ids keep their rows;
    other columns are ignored; an empty table gives no rows."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    table = frequent_table(docs, tokenizer_json, pattern, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, pattern, table))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_counter(shared)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def worker_counter(shared) -> TokenCounter:
    """One counter per worker and broadcast, so its cache outlives a task."""
    key = getattr(shared, "_path", None) or id(shared)
    if _WORKER.get("key") != key:
        tokenizer_json, pattern, table = shared.value
        _WORKER.update(key=key, counter=TokenCounter(tokenizer_json, pattern, _unpack(table)))
    return _WORKER["counter"]
