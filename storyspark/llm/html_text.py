"""Main text of web pages from streaming parser events.

The standard library's parser streams tags and data; they become lines, one
per block element, each with its characters and tags. The text-to-tag ratios of
the lines are smoothed with a Gaussian; lines at or above the standard deviation
form the content clusters (Weninger et al., "CETR", 2010). The clusters choose
the content: the ``article`` or ``main`` with most cluster text and those beside it (of the same
parent) that have a fifth of that or more, else the deepest element that holds ``SHARE`` of it. Every
line inside it that is not marked as page furniture (element, role, or a class or id) is
text; short lines stay. A class or id marks furniture if all its parts are furniture
words or words for boxes, and one is a furniture word (``share-buttons``, not
``share-price``); on an inline element it must be one word. It does not hide an element with
most of the cluster text (unless an ``article`` or ``main`` outside it has some), nor anything inside
``pre`` or ``code``. Where only the body holds the clusters, lines before the
first (its headings aside) and after the last cluster line go too.

Row-local: no shuffle; memory is one page and its lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0          # of the Gaussian, in lines
SHARE = 0.8          # of the cluster text that the content element must hold

# fixed values: HTML's own element names, and the words that mark furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br".split())
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())
FURNITURE = frozenset("head title nav footer aside script style noscript template svg iframe object canvas button select textarea "
                      "input label dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation "
                  "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                  "subscription share sharing social related recommended comment comments disqus replies respond footer masthead "
                  "topbar toolbar pager pagination login signup hidden widget widgets skip alert toast copyright".split())
HEADER_WORDS = frozenset(["header", "banner", "masthead"])
WHOLE = frozenset(["hidden"])        # as a part of a class it says something else (overflow-hidden)
BOXES = frozenset("area bar block bottom box button buttons center col column container content group header holder icon icons inner item "
                  "items left line link links list nav outer panel post posts right row section side site strip text title top "
                  "unit wrap wrapper".split())
CODE = frozenset(["pre", "code"])
_WORD = re.compile(r"[a-z]+")


def _marks(tokens: set[str]) -> set[str]:
    """The furniture and header words of the classes and ids that mark furniture by all their parts."""
    found = set()
    for token in tokens:
        parts = set(_WORD.findall(token))
        # as a part of a class some words say something else (overflow-hidden)
        known = (parts & (WORDS | HEADER_WORDS)) - (WHOLE if len(parts) > 1 else frozenset())
        if known and parts <= known | BOXES:
            found |= known
    return found


class _Element:
    __slots__ = ("name", "number", "parent", "noise", "content", "skip", "code", "word", "fixed")

    def __init__(self, name, number, parent, noise, content, skip, code=False, word=False, fixed=False):
        self.name, self.number, self.parent, self.noise, self.content, self.skip = name, number, parent, noise, content, skip
        self.code, self.word, self.fixed = code, word, fixed   # word: hidden by its class; fixed: hidden whatever the classes say


class _Lines(HTMLParser):
    """Collects (text, tags, element, noise) per block line."""

    def __init__(self, spared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.spared = spared
        root = _Element("", 0, None, "", False, False)
        self.elements, self.stack, self.open = [root], [root], Counter()
        self.lines: list[tuple[str, int, _Element]] = []
        self.parts: list[str] = []
        self.tags = 0

    def _break(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1]))
        self.parts, self.tags = [], 0

    def _pop_to(self, name: str) -> None:
        if not self.open[name]:
            return
        while True:
            last = self.stack.pop()
            self.open[last.name] -= 1
            if last.name == name:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._break()
        self.tags += 1
        if tag in ENDS_P:
            self._pop_to("p")
        elif tag == "body":
            self._pop_to("head")
        elif tag in ("li", "option", "tr", "td", "th", "dt", "dd") and self.stack[-1].name == tag:
            self._pop_to(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        above = self.stack[-1]
        noise, content = above.noise, above.content or tag in ("article", "main")
        values = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
        content = content or values.get("role") == "main"
        named = values.get("class", "") + " " + values.get("id", "")
        code = above.code or tag in CODE
        tokens = set(named.split())
        words = tokens if tag in INLINE else _marks(tokens)
        if code or len(self.elements) in self.spared:
            words = set()
        plain = tag not in ("html", "body", "article", "main")
        hard = plain and (tag in FURNITURE or values.get("role") in ROLES or "hidden" in values or values.get("aria-hidden") == "true")
        word = bool(words & WORDS) and tag not in ("html", "body")
        if tag in ("article", "main") and noise == "form":
            noise = ""
        if not noise and plain:
            if hard or word:
                noise = "furniture"
            elif tag == "form":
                noise = "form"
            elif not above.content and (tag == "header" or words & HEADER_WORDS):
                noise = "header"
        elif not noise and tag in ("article", "main") and words & {"comment", "comments", "ad", "ads", "related", "promo", "sponsored"}:
            noise = "furniture"
        if (noise and not above.noise) or (above.noise and not noise):
            self._break()                      # furniture inside a line is a line of its own
        skip = above.skip or tag in ("script", "style", "template", "noscript", "svg")
        fixed = above.fixed or hard or noise in ("form", "header")
        made = _Element(tag, len(self.elements), above, noise, content, skip, code, word, fixed and not (noise == "" and content))
        self.elements.append(made)
        self.stack.append(made)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)       # "<p/>" opens a paragraph, as in browsers

    def handle_endtag(self, tag: str) -> None:
        was = self.stack[-1].noise
        if tag not in INLINE or (self.open[tag] and was):
            self._break()
        self.tags += 1
        if tag not in VOID:
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].skip:
            self.parts.append(data)

    def finish(self) -> list[tuple[str, int, _Element]]:
        self.close()
        self._break()
        return self.lines


def smoothed_ratios(chars: list[int], tags: list[int], sigma: float = SIGMA) -> np.ndarray:
    """Text-to-tag ratio of each line under a Gaussian; the ends repeat."""
    ratio = np.array(chars, float) / np.maximum(1, np.array(tags, float))
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _spared(parser: _Lines) -> frozenset[int]:
    """Elements that a class word hides although they hold most of the cluster
    text, and no article or main outside them has any."""
    lines = parser.lines
    if not any(e.word for e in parser.elements):
        return frozenset()
    open_ = [i for i, (_, _, e) in enumerate(lines) if not e.fixed]
    if not open_:
        return frozenset()
    smooth = smoothed_ratios([len(t) for t, _, _ in lines], [n for _, n, _ in lines])
    limit = min(smooth.std(), max(smooth[i] for i in open_))
    mass, named = Counter(), Counter()        # cluster text, and that of it in an article or main
    inside = [False] * len(parser.elements)
    for e in parser.elements[1:]:
        inside[e.number] = inside[e.parent.number] or (e.name in ("article", "main") and not e.word)
    for i in open_:
        if smooth[i] >= limit:
            number = lines[i][2].number
            mass[number] += len(lines[i][0])
            named[number] += len(lines[i][0]) * inside[number]
    for e in reversed(parser.elements[1:]):
        mass[e.parent.number] += mass[e.number]
        named[e.parent.number] += named[e.number]
    return frozenset(e.number for e in parser.elements if e.word and 2 * mass[e.number] > mass[0] and (
        named[e.number] == named[0] and (named[0] or not inside[e.number])))


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by newlines; empty if none."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    spared = _spared(parser)
    if spared:
        parser = _Lines(spared)
        parser.feed(html)
        lines = parser.finish()
    good = [i for i, (_, _, e) in enumerate(lines) if not e.noise]
    if not good:
        return ""
    smooth = smoothed_ratios([len(t) for t, _, _ in lines], [n for _, n, _ in lines])
    limit = min(smooth.std(), max(smooth[i] for i in good))
    cluster = [i for i in good if smooth[i] >= limit]
    mass = Counter()                          # cluster text at or below each element
    for i in cluster:
        mass[lines[i][2].number] += len(lines[i][0])
    for e in reversed(parser.elements[1:]):
        mass[e.parent.number] += mass[e.number]
    named = [e for e in parser.elements if e.name in ("article", "main") and not e.noise and mass[e.number]]
    if named:
        best = max(named, key=lambda e: (mass[e.number], e.number))     # the inner one of equals
        chosen = {e.number for e in named if e.parent is best.parent and mass[e.number] >= (1 - SHARE) * mass[best.number]}
    else:
        chosen = parser.elements[0]
        for e in parser.elements[1:]:
            if e.name not in INLINE | {"p"} and mass[e.number] >= SHARE * mass[0]:
                chosen = e                     # parents come first, so the deepest wins
        if chosen.name in ("", "html", "body"):
            first = cluster[0]                 # with the headings right above it
            while first and not lines[first - 1][2].noise and lines[first - 1][2].name in HEADINGS:
                first -= 1
            good = [i for i in good if first <= i <= cluster[-1]]
        chosen = {chosen.number}
    inside = [False] * len(parser.elements)
    for e in parser.elements:
        inside[e.number] = e.number in chosen or (e.parent is not None and inside[e.parent.number])
    return "\n".join(lines[i][0] for i in good if inside[lines[i][2].number])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row. Null and empty
    pages give an empty text; repeated rows and null ids keep their rows; other
    columns are ignored; an empty table gives no rows."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([main_text(h) for h in html], dtype=object)

    return (pages.select("page_id", "url", run(F.coalesce("html", F.lit(""))).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
