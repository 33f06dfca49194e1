"""Feed, poll-state, page and frame rules."""

import datetime as dt
import json

from pyspark.sql import functions as F

from storyspark.operators import feeds as FD
from storyspark.sources.pages import extract_pages, page_title
from storyspark.streaming.frames import client_frames


def _rss(items):
    body = "".join(items)
    return f'<rss version="2.0"><channel><title>t</title>{body}</channel></rss>'


def test_item_cap_links_only_and_repeats(spark):
    many = [f"<item><title>T{i}</title><link>https://x.com/a/{i}</link><guid>g{i}</guid></item>"
            for i in range(25)]
    links = ["<item><title>A</title><link>https://x.com/p?utm_source=f</link></item>",
             "<item><title>B</title><link>https://x.com/p?utm_source=f</link></item>",
             "<item><title>C</title></item>"]
    snaps = spark.createDataFrame([("f1", 1, _rss(many)), ("f2", 1, _rss(links))],
                                  "feed_id string, snapshot_id long, xml string")
    it = FD.feed_items(snaps).collect()
    f1 = [r for r in it if r.feed_id == "f1"]
    assert len(f1) == 20 and [r.pos for r in f1] == list(range(20)) and f1[0].item_key == "guid:g0"
    f2 = sorted((r for r in it if r.feed_id == "f2"), key=lambda r: r.pos)
    assert [r.item_key for r in f2] == ["link:https://x.com/p", "link:https://x.com/p", None]
    new = FD.new_items(FD.feed_items(snaps)).where("feed_id = 'f2'").collect()
    assert len(new) == 1 and new[0].title == "A"
    seen = spark.createDataFrame([("guid:g3",)], "item_key string")
    assert FD.new_items(FD.feed_items(snaps), seen).where("item_key = 'guid:g3'").count() == 0


def test_poll_fold_backoff_and_error_status(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, "view", 1.0)] + [(1, 2 + i, t0 + dt.timedelta(minutes=10 * (i + 1)), "error", 1.0)
                                         for i in range(5)]
    rows += [(2, 10 + i, t0 + dt.timedelta(minutes=10 * i), "error", 1.0) for i in range(3)]
    rows += [(2, 20, t0 + dt.timedelta(minutes=40), "click", 1.0)]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, event_type string, value double")
    st = {r.feed_id: r for r in FD.feed_state(FD.poll_log(ev)).collect()}
    a = st[1]
    assert a.status == "error" and a.error_count == 5 and a.article_count == 1
    assert a.next_poll_at == t0 + dt.timedelta(minutes=50) + dt.timedelta(seconds=min(600 * 2 ** 5, 86400))
    b = st[2]
    assert b.status == "active" and b.error_count == 0 and b.article_count == 1
    assert b.next_poll_at == t0 + dt.timedelta(minutes=40, seconds=600)


def test_page_title_rules(spark):
    pages = [
        (1, '<html><head><meta property="og:title" content="OG &amp; one"><title>T</title></head></html>'),
        (2, "<html><head><meta content='OG two' property='og:title'><title>T</title></head></html>"),
        (3, "<html><head><TITLE>\n  Plain &lt;b&gt;  </TITLE></head></html>"),
        (4, "<html><body>no title</body></html>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r.t for r in df.select("page_id", page_title("html").alias("t")).collect()}
    assert got == {1: "OG & one", 2: "OG two", 3: "Plain <b>", 4: "Unknown Title"}


def test_extract_drops_short_text(spark):
    long_p = "word " * 20
    pages = [(1, "https://A.com/x/", f"<html><head><title>Hi</title><meta name='author' content='a; b'></head>"
                                     f"<body><nav>menu</nav><p>{long_p}</p><script>x</script></body></html>"),
             (2, "https://a.com/y", "<html><body><p>short</p></body></html>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = extract_pages(df).collect()
    assert [r.page_id for r in out] == [1]
    r = out[0]
    assert r.title == "Hi" and r.authors == ["a", "b"] and r.content == long_p.strip()
    assert "menu" not in r.content


def test_public_frame_has_five_fields(spark):
    df = spark.createDataFrame([("c1", "a1", "T", "https://x.com:8080/p", True, 3, 0.9)],
                               "cluster_id string, id string, title string, url string, is_new_cluster boolean, "
                               "version int, similarity_score double")
    frame = json.loads(client_frames(df).first().frame)
    assert frame["type"] == "article.clustered"
    assert set(frame["data"]) == {"cluster_id", "article_id", "title", "source_domain", "is_new_cluster"}
    assert frame["data"]["source_domain"] == "x.com:8080"


RSS = ('<rss version="2.0"><channel><title>t</title><item><title>a</title><link>https://x.com/1</link><guid>g1</guid>'
       '<pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><link>https://x.com/2</link></item></channel></rss>')
RDF = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/">'
       '<channel><title>t</title></channel><item rdf:about="u"><title>b</title><link>https://x.com/3</link>'
       '<dc:date>2024-01-02T00:00:00Z</dc:date></item></rdf:RDF>')
ATOM = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>c</title><id>urn:1</id>'
        '<link rel="self" href="https://x.com/self"/><link href="https://x.com/4"/><updated>2024-01-03T00:00:00Z</updated></entry>'
        '<entry><title>d</title><link rel="alternate" href="https://x.com/5"/></entry></feed>')


def test_rss_rdf_and_atom(spark):
    rows = [("rss", 1, RSS), ("rdf", 1, RDF), ("atom", 1, ATOM), ("broken", 1, "<rss><channel><item>"), ("page", 1, "<html><body/></html>"),
            ("none", 1, None), ("blank", 1, "  "), ("bare", 1, '<rss version="2.0"><channel><title>t</title></channel></rss>')]
    snaps = spark.createDataFrame(rows, "feed_id string, snapshot_id long, xml string")
    got = {(r.feed_id, r.pos): (r.link, r.item_key, str(r.published)[:10] if r.published else None) for r in FD.feed_items(snaps).collect()}
    assert got == {
        ("rss", 0): ("https://x.com/1", "guid:g1", "2024-01-01"), ("rss", 1): ("https://x.com/2", "link:https://x.com/2", None),
        ("rdf", 0): ("https://x.com/3", "link:https://x.com/3", "2024-01-02"),
        ("atom", 0): ("https://x.com/4", "guid:urn:1", "2024-01-03"), ("atom", 1): ("https://x.com/5", "link:https://x.com/5", None)}
    bad = {r.feed_id: r.reason for r in FD.feed_problems(snaps).collect()}
    assert bad == {"broken": "not a feed", "page": "not a feed", "none": "empty", "blank": "empty"}


def test_poll_fold_orders_equal_times_by_event(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 10, t, False, 1, "e1", None, None), (1, 11, t, True, 0, None, None, "boom"),      # success, then failure
            (2, 21, t, False, 1, None, None, None), (2, 20, t, True, 0, None, None, "x"),          # failure, then success
            (3, 30, t, False, 1, "e", "m", None), (3, 31, t + dt.timedelta(seconds=5), False, 1, None, None, None)]
    log = spark.createDataFrame(rows, "feed_id long, event_id long, ts timestamp_ntz, failed boolean, delta int, "
                                      "etag string, last_modified string, error string")
    r = {x.feed_id: x for x in FD.feed_state(log).collect()}
    assert r[1].error_count == 1 and r[1].next_poll_at == t + dt.timedelta(seconds=1200) and r[1].last_error == "boom" and r[1].etag == "e1"
    assert r[2].error_count == 0 and r[2].next_poll_at == t + dt.timedelta(seconds=600) and r[2].last_error is None
    assert r[3].etag is None and r[3].last_modified is None and r[3].updated_at == t + dt.timedelta(seconds=5)


def test_page_extract_equals_the_generated_articles(spark, tmp_path):
    """The page_extract query over generated pages whose fields are known beforehand."""
    import hashlib
    import html
    import random

    from storyspark.plans.registry import QUERIES
    r = random.Random(7)
    words = ["alpha", "b&b", "<tag>", "naïve", "日本", "\"q\"", "x"]
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(r.choices(words, k=r.randrange(1, 12))) for _ in range(r.randrange(0, 6))]
        body = []
        for b in blocks:
            tag = r.choice(["p", "h2", "li", "blockquote"])
            text = html.escape(b).replace(" ", r.choice([" ", "\n  ", " <b>", "&#32;"]), 1).replace("<b>", "<b></b>")
            body.append(f"<{tag}>{text}</{tag}>")
            body.append(r.choice(["", "<nav><p>menu menu</p></nav>", "<script>var p = '<p>no</p>';</script>", "<!-- <p>gone</p> -->", "<footer><li>foot</li></footer>"]))
        author, day, image = r.choice(["", "A B; C", "D"]), r.choice(["", "2024-03-09T10:00:00Z", "2023-12-31"]), r.choice(["", "https://i.example.com/x.png"])
        meta = "".join(f'<meta {k}="{n}" content="{v}">' for k, n, v in (("name", "author", author), ("property", "article:published_time", day),
                                                                         ("property", "og:image", image)) if v)
        page = f"<html><head><title> T {i} </title>{meta}</head><body><article>{''.join(body)}</article></body></html>"
        rows.append((i, f"https://e.com/{i}", page))
        text = "\n".join(blocks).strip()
        if len(text) >= 50:
            want[i] = (f"T {i}", hashlib.sha256(text.encode()).hexdigest(), len(text), "|".join(x.strip() for x in author.split(";") if x.strip()),
                       day[:10] or None, image or None, len(page))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x.page_id: (x.title, x.content_sha256, x.content_length, x.authors, None if x.published_at is None else str(x.published_at)[:10],
                       x.top_image_url, x.raw_html_size) for x in QUERIES["page_extract"](spark, str(tmp_path)).collect()}
    assert got == want and 20 < len(want) < 60


def test_extractor_keeps_text_found_before_a_failure(monkeypatch):
    from storyspark.sources import pages as P
    seen = []
    original = P._Walker.handle_starttag

    def breaks(self, tag, attrs):
        if tag == "video":
            raise ValueError("broken")
        seen.append(tag)
        original(self, tag, attrs)

    monkeypatch.setattr(P._Walker, "handle_starttag", breaks)
    out = P.default_extractor("<p>first part</p><p>second part<video><p>lost</p>")
    assert out["text"] == "first part\nsecond part" and "p" in seen


def test_pages_are_walked_some_at_a_time(spark):
    from storyspark.sources.pages import PAGE_ROWS, extract_pages

    def extractor(html, url):
        if "bad" in html:
            raise ValueError("no")
        return {"text": html * 60, "author": url}

    n = 3 * PAGE_ROWS + 5
    rows = [(i, f"https://a.example.com/{i}", None if i == 7 else "bad" if i == PAGE_ROWS else f"{i:04d}") for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.content for r in extract_pages(pages, extractor).collect()}
    assert got == {i: f"{i:04d}" * 60 for i in range(n) if i not in (7, PAGE_ROWS)}
