"""Main text of pages: layouts, furniture, references, broken markup."""

import numpy as np
import pytest

from storyspark.llm import html_text as HT

LONG = "This sentence is long enough to look like the body of an article on a page."
FURNITURE = [
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<header><h1>Site name</h1></header>", "<footer>&copy; us</footer>",
    "<aside>Read more elsewhere on this site today</aside>", "<div class='ad'>Buy this now, it is very cheap today</div>",
    "<div class='cookie-notice'>We use cookies on this site</div>", "<form><input name=q><button>Go</button> search here</form>",
    "<script>var t = '</p><p>no';</script>", "<style>p{margin:0}</style>", "<div id='comments'><article class='comment'><p>" + LONG + "</p></article></div>",
    "<div role='navigation'>menu words</div>", "<noscript>turn it on</noscript>", "<!-- <p>hidden</p> -->", "<section class='sidebar'><p>" + LONG + "</p></section>",
    "<ul class='breadcrumbs'><li>a</li><li>b</li></ul>", "<div class='share-buttons'>Share this with your friends now</div>",
    "<div class='related-posts'><h3>Related</h3><p>" + LONG + "</p></div>", "<section id='respond'><form>Leave a reply</form></section>",
    "<dialog open>Subscribe to our newsletter for more</dialog>", "<template><p>" + LONG + "</p></template>"]


@pytest.mark.parametrize("piece", FURNITURE)
@pytest.mark.parametrize("tag", ["article", "main", "div id='content'"])
def test_furniture_goes_wherever_it_stands(piece, tag):
    close = tag.split()[0]
    body = f"<{tag}><h1>Title</h1><p>{LONG}</p>%s<p>{LONG} End.</p></{close}>"
    want = f"Title\n{LONG}\n{LONG} End."
    assert HT.main_text(f"<html><head><title>x</title></head><body>{piece}{body % ''}{piece}</body></html>") == want
    if not piece.startswith("<header"):
        assert HT.main_text(f"<body>{body % piece}</body>") == want


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain words only", "plain words only"),
    ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;&eacute; &amp</p></article>", "a & b <c> é é &"),
    ("<article><p>one\n\t two<br>three<p><b>four<i>five</b></i> six", "one two three\nfourfive six"),
    ("<article><h1>T</h1><p>.</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "T\n.\nx\ny\n1\n2"),
    ("<article><p>x</p></article><article><p>" + LONG + "</p></article>", LONG),
    ("<form><article><p>inside a page form</p></article></form>", "inside a page form"),
    ("<article><p>a <span class='ad'>no</span> b</p></article>", "a\nb"),
    ("<article><header><h1>Own title</h1></header><p>x</p></article>", "Own title\nx"),
    ("</div></p><article></b><p>t", "t"), ("<nav>only a menu</nav>", "")])
def test_small_pages(html, text):
    assert HT.main_text(html) == text


def test_nothing_of_a_long_article_is_dropped():
    words = [f"w{i}" for i in range(60000)]
    html = "<nav>menu</nav><article>" + "".join(f"<p>{' '.join(words[i:i + 1 + i % 40])}</p>" for i in range(0, 60000, 40)) + "</article>"
    want = "\n".join(" ".join(words[i:i + 1 + i % 40]) for i in range(0, 60000, 40))
    assert HT.main_text(html) == want
    deep = "<div>" * 30000 + LONG + "</div></span>" * 30000
    assert HT.main_text(deep) == LONG


def test_smoothing_keeps_a_level_and_spreads_a_peak():
    assert np.allclose(HT.smoothed_ratios([10] * 5, [1] * 5), 10)
    peak = HT.smoothed_ratios([0, 0, 0, 100, 0, 0, 0], [1] * 7)
    assert peak.argmax() == 3 and 0 < peak[2] == pytest.approx(peak[4])


def test_rows(spark):
    rows = [(1, "u", "<article><p>é😀</p></article>", "x"), (1, "u", "<article><p>é😀</p></article>", "x"), (None, None, None, "x"), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, HT.extract(df).collect()), key=str) == sorted(
        [(1, "u", "é😀", 2), (1, "u", "é😀", 2), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert HT.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("html, text", [
    ("<div class='overflow-hidden'><article><p>" + LONG + "</p></article></div>", LONG),
    ("<nav>menu</nav><div class='elementor-widget-container'><p>a <b>b</b> " + LONG + "</p></div>", "a b " + LONG),
    ("<div class='widget'><div class='widget-box'><main><p>" + LONG + "</p></main></div></div>", LONG),
    ("<article><p>Its <span class='share-price'>price</span> rose. " + LONG + "</p></article>", "Its price rose. " + LONG),
    ("<article><p>" + LONG + "</p><pre>x = 1 <span class='hljs-comment'># one</span> <i class='comment'># two</i></pre></article>",
     LONG + "\nx = 1 # one # two"),
    ("<article><p>" + LONG + "</p></article><div id='comments'>" + f"<p>{LONG}</p>" * 9 + "</div>", LONG)])
def test_a_class_word_hides_no_content(html, text):
    assert HT.main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (f"<nav>menu</nav><article><h2>One</h2><p>{LONG}</p></article><article><p>{LONG} Two.</p></article><aside>x</aside>", f"One\n{LONG}\n{LONG} Two."),
    (f"<article><p>{LONG}</p><p class='share-price'>{LONG} Price.</p><div class='copyright-law'><p>Short law.</p></div>"
     f"<div id='social-policy'>{LONG} Policy.</div></article>", f"{LONG}\n{LONG} Price.\nShort law.\n{LONG} Policy."),
    (f"<article><p>{LONG}</p><div class='share-buttons-bar'>Share</div><div class='x cookie_notice'>{LONG}</div></article>", LONG),
    (f"<article><p>{LONG}</p></article><div><article><p>{LONG} Elsewhere.</p><p>{LONG}</p></article></div>", f"{LONG} Elsewhere.\n{LONG}")])
def test_siblings_and_compound_classes(html, text):
    assert HT.main_text(html) == text


def test_the_ratios_choose_the_region(monkeypatch):
    """Without the ratios another text comes out where no article names the content."""
    links = "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(12))
    html = f"<body><div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div><div><ul>{links}</ul></div></body>"
    assert HT.main_text(html) == f"{LONG}\n{LONG}"
    monkeypatch.setattr(HT, "smoothed_ratios", lambda chars, tags, sigma=1.0: np.ones(len(chars)))
    assert HT.main_text(html) != f"{LONG}\n{LONG}"
