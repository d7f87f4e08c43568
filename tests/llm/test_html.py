import random
import re
import time
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from triplane.llm import html_tagpath as H


def article_of(html):
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", inside)).split())


@pytest.fixture(scope="module")
def pages():
    return [(r["page_id"], r["html"]) for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist()][:1000]


def test_given_pages_against_their_articles(spark):
    """The generator's pages have one article element; articles of a sentence or two may lose against an advert that is longer, and then both stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.digest(pages).collect()}
    assert len(got) == pages.count()
    right = 0
    for r in pages.collect():
        want = article_of(r.html)
        assert want in got[r.page_id].text and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
        right += got[r.page_id].text == want
        assert got[r.page_id].text == want or len(want) < 120
    assert right >= 0.98 * len(got)


def without_names(page_id, html):
    """Neither article elements nor telling classes."""
    r = random.Random(page_id)
    return re.sub(r"<(/?)article>", lambda m: "</div>" if m[1] else f'<div class="k{r.randrange(10**6)}">', html).replace('class="ad"', f'class="k{r.randrange(10**6)}"')


def test_the_ratios_decide(pages, monkeypatch):
    """A constant in their place keeps adverts on all pages."""
    own = [H.main_text(h) for _, h in pages]
    monkeypatch.setattr(H, "fused_ratios", lambda length, marks, of, container: np.ones(of.max() + 1))
    assert sum(H.main_text(h) != t for (_, h), t in zip(pages, own)) > 0.95 * len(pages)


def test_pages_without_their_names(pages):
    right = sum(H.main_text(without_names(i, h)) == article_of(h) for i, h in pages)
    assert right >= 0.95 * len(pages)


def test_comments_without_a_name_go(pages):
    right = 0
    for i, h in pages:
        r = random.Random(i)
        words = re.findall(r"\w+", article_of(h))[:40]
        said = "".join("<p>" + " ".join(r.choices(words, k=r.randrange(4, 12))) + ", nice.</p>" for _ in range(r.randrange(1, 5)))
        right += H.main_text(without_names(i, h).replace("<footer>", f"<div class=x3>{said}</div><footer>")) == article_of(h)
    assert right >= 0.93 * len(pages)


def test_no_word_of_a_class_drops_text_of_an_article():
    p = "<p>Some text of the article, with commas, which is long enough to count.</p>"
    for kind in ('class="login-history"', 'class="ad-hoc-networks"', 'id="comment-on-hegel"', 'class="notice-period side"'):
        text = H.main_text(f"<article>{p}<section {kind}><p>Short one.</p></section>{p}</article><div class=ad>Buy, buy.</div>")
        assert text.count("Some text") == 2 and ("Short one." in text) == (kind != 'class="notice-period side"') and "Buy" not in text
        assert H.main_text(f"<article>{p}<section {kind}>{p}{p}</section>{p}</article>").count("Some text") == 4


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page home">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do. Accept them, please.</p></div>
<div id="content"><div class="post"><h2>The title</h2>
<p>First paragraph, with some <b>bold</b> words &amp; commas; it goes on.<p>Second one &#233;&eacute; here, quite long as well, and it ends.
<p>Ok.</div>
<div class="comments"><p>Nice article, thanks, I liked it a lot. Really good, keep writing!</p></div></div>
<aside><p>Related things, which are long enough to be found, too. And more of it, here.</p></aside>
<form><p>Your name, please. Your mail, please.</p><input name=x></form>
<div class="ad">Buy this, buy that, and buy it now. A long advert, with commas, and so on.</div>
<script>if (a < b) { document.write("<p>never, never, never.</p>") }</script><!-- <p>nor this</p> -->
<footer>&copy; All of us, 2020.</footer>"""


def test_a_page_without_article():
    assert H.main_text(PAGE) == "The title First paragraph, with some bold words & commas; it goes on. Second one éé here, quite long as well, and it ends. Ok."


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<p>a &lt;b&gt; c</p>", "a <b> c"), ("<p>x<!-- open", "x"),
        ("<script>open", ""), ("</div></p>t", "t"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p title='a>b'>t</p>", "t"), ('<p title="open>t</p>', "t"),
        ("<nav>only menu</nav>", ""), ("<p>a\n\t b&nbsp;c</p>", "a b c"),
    ],
)
def test_awkward_pages(html, want):
    assert H.main_text(html) == want


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with a comma.</p>" for i in range(20_000)) + "</article>"
    assert H.main_text(page).count("Paragraph") == 20_000


def test_rows_on_spark(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "u", "", "y")]
    got = H.digest(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert H.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


NEUTRAL = "<html><body><div class={0}><p>Short words.</p></div><div class={1}><h1>A title</h1>{paragraphs}<ul><li>point</li></ul></div><div class={2}>Tail.</div></body></html>"


def test_names_do_not_decide():
    """Paths are told apart by their ratios: any class names give the same text."""
    paragraphs = "".join(f"<p>Sentence {i}, which goes on for a while, as they do; and it ends.</p>" for i in range(6))
    want = "A title " + " ".join(f"Sentence {i}, which goes on for a while, as they do; and it ends." for i in range(6)) + " point"
    for names in ("a b c", "zz9 q0 x-y", "one two three", "k k1 k2"):
        assert H.main_text(NEUTRAL.format(*names.split(), paragraphs=paragraphs)) == want


def test_the_threshold_decides(monkeypatch):
    page = "<body><div class=a><p>First paragraph, long enough, with commas, and more.</p><p>Second paragraph, long enough too, with commas.</p></div><div class=b><p>A few words, no more.</p></div></body>"
    assert H.main_text(page) == "First paragraph, long enough, with commas, and more. Second paragraph, long enough too, with commas."
    monkeypatch.setattr(H, "THRESHOLD", 0.0)
    assert H.main_text(page).endswith("A few words, no more.")
    assert H.main_text(page.replace("A few words, no more.", "x")).endswith("commas.")  # the floor


def test_names_are_one_term_of_the_score():
    """Sections whose names only resemble furniture stay; comments and adverts go."""
    p = "<p>Some text of the article, with commas, which is long enough to count.</p>"
    page = f"<article>{p}<section class='side-effects'>{p}</section><section id='related-work'>{p}</section><div class='widget-form'>{p}</div><div class='comments'><p>Nice, thanks, great, and so on.</p></div><div class=ad><p>Buy, buy, buy.</p></div>{p}</article>"
    assert H.main_text(page).count("Some text") == 5 and "Nice" not in H.main_text(page) and "Buy" not in H.main_text(page)


@pytest.mark.parametrize(
    "page",
    [
        "<div>x, y." * 100_000, "<div><p>x, y." * 50_000 + "</span></li></p>" * 50_000, "<a" * 500_000 + ">", "<li><table>" + "<div>" * 50_000 + "</li>" * 50_000,
        '<p title="x' * 50_000 + ">", "<!--" * 100_000, '<p>"<' * 100_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 20


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "kept", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert [tuple(r) for r in H.digest(pages).collect()] == [(1, "u", "a", 1)]
    assert pages.withColumn("main", H.text_of(pages.html)).collect()[0].text == "kept"
