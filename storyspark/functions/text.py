"""Text scalar functions (native column expressions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Characters Python's str.strip() removes (str.isspace() is true): fixed set.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# One class for trimming and collapsing, the same that Python's str.split() uses
# (Java's own \s leaves out \x1c to \x1f).
_WS = f"[{PY_WHITESPACE}]+"


def unicode_trim(col) -> Column:
    """Python ``str.strip()``: trims all Unicode whitespace, not only blanks
    (one linear pass; no regex)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def normalize_text(col) -> Column:
    """H6: lower case, trim, collapse every whitespace run to one blank."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), _WS, " "))


def words(col_normalized) -> Column:
    """Whitespace split of normalized text; empty text gives an empty array."""
    c = _c(col_normalized)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def shingles(col_normalized, n: int = 3) -> Column:
    """H7: one n-word shingle per position up to len-n+1, at least one.
    Built with zip_with over shifted slices, so no lambda re-reads the
    word array (a lambda that did would split the text once per shingle)."""
    w = words(col_normalized)
    size = F.size(w)
    m = F.greatest(size - (n - 1), F.lit(0))
    acc = F.slice(w, 1, m)
    for k in range(2, n + 1):
        acc = F.zip_with(acc, F.slice(w, k, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return (F.when(size == 0, F.array().cast("array<string>"))
             .when(size < n, F.array(F.array_join(w, " ")))
             .otherwise(acc))


def content_preview(col, n: int = 200) -> Column:
    """First n characters."""
    return F.substring(_c(col), 1, n)


def split_authors(col) -> Column:
    """Split on ';', trim, drop blanks."""
    parts = F.transform(F.split(_c(col), ";"), unicode_trim)
    return F.filter(parts, lambda x: x != "")


def parse_day(col) -> Column:
    """H14: 'YYYY-MM-DD' to midnight UTC, null when it does not parse."""
    # a year has exactly four digits
    day = F.when(_c(col).rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), _c(col))
    return F.try_to_timestamp(day, F.lit("y-M-d"))


def min_content_ok(col, min_chars: int = 50) -> Column:
    """B1 predicate: trimmed text present and at least ``min_chars`` long."""
    t = unicode_trim(col)
    return t.isNotNull() & (F.length(t) >= min_chars)


def iso_time(col) -> Column:
    """Python ``datetime.isoformat()`` of a UTC value (+00:00 offset,
    fraction only when non-zero)."""
    c = _c(col)
    frac = F.date_format(c, "SSSSSS")
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.concat(base, F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
                 F.lit("+00:00")))


def round4(col) -> Column:
    """4-digit rounding used by exports and search scores."""
    return F.round(_c(col).cast("double"), 4)


def decay_score(age_hours, half_life_hours: float = 6.0) -> Column:
    """Exponential decay; the reference declares it but never computes it."""
    return F.pow(F.lit(0.5), _c(age_hours).cast("double") / F.lit(float(half_life_hours)))


def backoff_seconds(poll_interval, error_count, max_seconds: int = 86_400) -> Column:
    """min(interval * 2^errors, max); errors = count after this failure."""
    raw = _c(poll_interval).cast("double") * F.pow(F.lit(2.0), _c(error_count).cast("double"))
    return F.least(raw, F.lit(float(max_seconds))).cast("long")
