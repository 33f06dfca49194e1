"""Downloaded pages to article rows.

The per-page HTML walk is a small stdlib ``html.parser`` helper run in
an Arrow UDF (one pass over the pages); titles, hashes and
the short-text filter are column expressions. A user extractor (J2) is any
callable (html, url) -> dict(text, title, author, date, image).
"""

from __future__ import annotations

import html as html_lib
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import min_content_ok, parse_day, split_authors, unicode_trim
from ..functions.urls import url_hash

# fixed values: the three patterns are the title rule itself
OG_TITLE_A = r"""<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']"""
OG_TITLE_B = r"""<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:title["']"""
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
UNKNOWN_TITLE = "Unknown Title"


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html_lib.unescape(x))


def page_title(html_col, extracted_title=None) -> Column:
    """Extractor title, else og:title (either attribute order), else
    <title>; stripped, then unescaped; 'Unknown Title' when nothing is left."""
    h = F.col(html_col) if isinstance(html_col, str) else html_col
    og = F.coalesce(F.nullif(F.regexp_extract(h, OG_TITLE_A, 1), F.lit("")),
                    F.nullif(F.regexp_extract(h, OG_TITLE_B, 1), F.lit("")))
    tt = F.when(h.rlike(TITLE_TAG), F.regexp_extract(h, TITLE_TAG, 1))
    fallback = html_unescape(unicode_trim(F.coalesce(og, tt)))
    t = fallback if extracted_title is None else F.coalesce(
        F.nullif(unicode_trim(extracted_title), F.lit("")), fallback)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(UNKNOWN_TITLE))


_SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "head"}
_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td"}


_CONTAINER = {"article", "section", "main", "div", "body", "ul", "ol", "table"}


class _Walker(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.blocks: list[str] = []
        self.cur: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.time_dt: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag in _BLOCK and not self.skip:
            self._end_block()      # an unclosed block ends where the next one starts
            self.cur = []
        elif tag == "br" and self.cur is not None:
            self.cur.append("\n")
        if tag == "meta":
            k = (a.get("property") or a.get("name") or "").lower()
            if k and a.get("content") is not None:
                self.meta.setdefault(k, a["content"])
        if tag == "time" and a.get("datetime") and self.time_dt is None:
            self.time_dt = a["datetime"]

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK or tag in _CONTAINER:
            self._end_block()

    def close(self):
        super().close()
        self._end_block()

    def _end_block(self):
        txt = " ".join("".join(self.cur or ()).split())
        if txt:
            self.blocks.append(txt)
        self.cur = None

    def handle_data(self, data):
        if self.cur is not None and not self.skip:
            self.cur.append(data)


def default_extractor(html: str, url: str | None = None) -> dict:
    """Paragraph-level text of the page body (boilerplate containers
    skipped), author / date / image from meta tags. Where the parser gives up on a broken
    page, what it has found until then stays."""
    w = _Walker()
    try:
        w.feed(html or "")
        w.close()
    except Exception:  # noqa: BLE001 - a broken page must not fail the job
        w._end_block()
    date = w.meta.get("article:published_time") or w.meta.get("date") or w.time_dt
    return {"text": "\n".join(w.blocks), "title": None, "author": w.meta.get("author"),
            "date": date[:10] if date else None, "image": w.meta.get("og:image")}


PAGE_ROWS = 64     # pages that a worker holds as Python strings
_OUT = T.StructType([T.StructField(f"x_{c}", T.StringType()) for c in ("text", "title", "author", "date", "image")])


def extract_pages(pages: DataFrame, extractor: Callable[[str, str], dict] | None = None,
                  min_chars: int = 50, html_col: str = "html") -> DataFrame:
    """A2: pages (page_id, url, html) to article rows: title, content
    (trimmed, >= ``min_chars``), content_length, authors, published_at,
    top_image_url, url_hash (canonical) and raw_html_size. One pass over the
    pages: the extractor is an Arrow UDF beside the other columns."""
    fn = extractor or default_extractor

    @F.arrow_udf(_OUT)
    def run(html: pa.Array, url: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(html), PAGE_ROWS):    # only so many pages at a time are Python strings
            rows = []
            for h, u in zip(html[at:at + PAGE_ROWS].to_pylist(), url[at:at + PAGE_ROWS].to_pylist()):
                try:
                    x = fn(h, u) or {}
                except Exception:  # noqa: BLE001 - extractor failure drops the page
                    x = {}
                rows.append([x.get(c) for c in ("text", "title", "author", "date", "image")])
            found.append(pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in zip(*rows)], _OUT.names))
        return pa.concat_arrays(found) if found else pa.array([], pa.struct([(c, pa.string()) for c in _OUT.names]))

    x = pages.withColumn("_x", run(F.col(html_col), F.col("url"))).select("page_id", "url", html_col, "_x.*")
    return (x.where(min_content_ok("x_text", min_chars))
            .select("page_id", "url", url_hash("url").alias("url_hash"),
                    page_title(html_col, F.col("x_title")).alias("title"),
                    unicode_trim("x_text").alias("content"),
                    F.length(unicode_trim("x_text")).cast("long").alias("content_length"),
                    F.coalesce(split_authors("x_author"), F.array().cast("array<string>")).alias("authors"),
                    parse_day("x_date").alias("published_at"),
                    F.col("x_image").alias("top_image_url"),
                    F.length(html_col).cast("long").alias("raw_html_size"),
                    F.lit(1.0).alias("quality_score"), F.lit("html_parser").alias("extraction_method")))
