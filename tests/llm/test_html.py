import html as entities
import re
import time

import pytest

from lodestrata.llm import html_extract
from lodestrata.llm.html_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><header><h1>The  title</h1></header><p>First &amp; <b>bold</b>
 text.</p><div class="ad">More adverts</div><p>Second<br>line &#8212; &eacute;.<p>Ok.</p><form><input><button>Send</button></form><blockquote>Quoted words here.</blockquote>
<ul><li>One item</li><li>Two</li></ul><section class="comments"><p>I disagree with this at length, dear author.</p></section></article>
<aside>Related things</aside><footer>&copy; me</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert extract(PAGE) == "The title\n\nFirst & bold text.\n\nSecond line — é.\n\nOk.\n\nQuoted words here.\n\nOne item\n\nTwo"


def test_page_without_article_by_ratio():
    body = "".join(f"<p>{'Some long sentence of the text. ' * 8}</p>" for _ in range(5))
    links = "".join(f'<div><a href="/{i}">l{i}</a> <a href="/{i}">m</a></div>' for i in range(30))
    got = extract(f"<body><div>{links}</div><div>{body}</div></body>")
    assert got.count("\n\n") == 4 and "l3" not in got


@pytest.mark.parametrize("html, want", [("", ""), (None, ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<article><p><b>One<br><p>Two</p></article>", "One\n\nTwo"), ("<p>x</nav></p><p>y", "x\n\ny"), ("<![foo <p>bar", "<![foo\n\nbar"), ("<script>never closed <p>text", ""), ("<p>" + "w " * 200000 + "</p>", ("w " * 200000).strip()), ("<article><p>a&nbsp;b&lt;c</p></article>", "a b<c"), ("<nav>menu</nav>", "")])
def test_odd_pages(html, want):
    assert extract(html) == want


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    got = main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars == len(r.text)) for r in got] == [(1, "u", True), (1, "u", True), (None, None, True), (2, "v", True)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "content-sidebar-wrap", "has-header", "nav-open"])
def test_layout_names_do_not_hide_the_article(name):
    side = '<div class="sidebar"><p>Other things to read</p></div>'
    assert extract(f'<body><div class="{name}"><div class="page-header x"><article><p>The text.</p></article></div>{side}</div></body>') == "The text."
    text = "Some long sentence of the text. " * 20
    assert extract(f'<body><div class="{name}"><p>{text}</p>{side}</div></body>') == text.strip()
    assert extract('<body><article><p>Short.</p></article><div class="comments"><article class="comment-body"><p>A far longer answer than the text.</p></article></div></body>') == "Short."


def test_reference_lists_of_an_article_stay():
    assert extract('<article><p>The text.</p><section><p><a href="/a">First source</a></p></section></article>') == "The text.\n\nFirst source"


LONG = "<p>" + "Some long sentence of the text. " * 9 + "</p>"


def test_nothing_of_an_article_is_lost():
    """Short blocks without a name of their own stay; named ones go."""
    for block, text in (("<div>He said no.</div>", "He said no."), ('<div class="caption">A view.</div>', "A view."), ('<div class="highlight"><pre>x = 1</pre></div>', "x = 1"), ('<div class="x">Buy it now.</div>', "Buy it now."), ("<table><tr><td>1</td></tr></table>", "1")):
        assert text in extract(f"<article>{LONG}{block}{LONG}<p>Ok.</p></article>").split("\n\n")
    assert "Buy" not in extract(f'<article>{LONG}<div class="ad-slot"><div>Buy it now.</div></div></article>')
    assert "Buy" not in extract(f'<article>{LONG}</article><div class="x">{LONG.replace("Some", "Buy")}</div>')
    assert extract(f'<article>{LONG}<p class="share-price">12 p.</p><section class="social-policy"><h2>Policy</h2></section></article>').endswith("12 p.\n\nPolicy")


def test_short_blocks_of_a_page_built_of_divisions_stay():
    menu = "".join(f'<div><a href="/{i}">Item {i}</a></div>' for i in range(20))
    text = "<div>He said no.</div>".join(f"<div>{'Some long sentence of the text. ' * 9}</div>" for _ in range(4))
    got = extract(f'<body><div>{menu}</div><div><h1>A title</h1>{text}<div class="comments"><p>{"I disagree. " * 20}</p></div></div><div>Short end</div></body>').split("\n\n")
    assert got[0] == "A title" and got.count("He said no.") == 3 and len(got) == 8


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "x" + "</i>" * 1000, "<div>" * 100_000 + "x", "<p><b>" * 50_000 + "x", "<ul><li><i>" * 30_000 + "x", "<span>" * 50_000 + "</div><p>x" * 2000])
def test_deep_nesting_takes_linear_time(page):
    began = time.process_time()
    assert "x" in extract(page)
    assert time.process_time() - began < 4


def plain(page):
    """Blocks of a page's one article, with regular expressions alone."""
    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d|li|ul)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_pages_against_plain_reading(spark, sf_dir, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert pages and all(extract(p) == plain(p) for p in pages)
    monkeypatch.setattr(html_extract, "_smooth", lambda values: [0.0] * len(values))
    assert all(extract(p) != plain(p) for p in pages)


def test_named_regions_alone_are_no_text():
    assert extract('<div class="ad">Buy now</div>') == "" and extract('<div class="cookie-notice"><p>We use cookies</p></div><p>Text.</p>') == "Text."
    assert extract('<div class="AD-slot">Buy now</div><article><p>a</p></article>') == "a"


def test_ratios_decide_where_markup_says_nothing(spark, sf_dir, monkeypatch):
    """Pages without names and sectioning elements: no text is lost, and it is the smoothed
    ratios that keep out what is around it."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    bare = [re.sub(r"<(/?)(article|nav|aside|footer|header|section|main)\b", r"<\1div", re.sub(r'\s(class|id|role)="[^"]*"', "", p)) for p in pages]
    got, want = [extract(p).split("\n\n") for p in bare], [plain(p).split("\n\n") for p in pages]
    assert all(set(w) <= set(g) for g, w in zip(got, want, strict=True))
    exact = sum(g == w for g, w in zip(got, want, strict=True))
    monkeypatch.setattr(html_extract, "_smooth", lambda values: [1.0] * len(values))
    assert exact > 0 == sum(extract(p).split("\n\n") == w for p, w in zip(bare, want, strict=True))
