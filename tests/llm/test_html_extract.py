import html as entities
import math
import re

import pyarrow.parquet as pq
import pytest

from arcweave.llm import html_extract
from arcweave.llm.html_extract import extract_pages, main_text

LONG = "This is a long paragraph of the article with a good number of words in it, as articles have."


def test_article_of_the_test_pages():
    html = f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is very good and cheap.</div><article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Short.</p><p>A  b\n c&nbsp;d</p></article><footer>&copy; x</footer></body></html>'
    assert main_text(html) == f"Title & more\n{LONG}\nShort.\nA b c d"


@pytest.mark.parametrize(
    "noise",
    [
        "<aside>Side words here that are long enough to look like text of an article.</aside>",
        '<div class="sidebar">Side words here that are long enough to look like text of an article.</div>',
        '<div id="cookie-notice"><p>We use cookies and this notice is a long sentence about them.</p></div>',
        '<section class="comments"><p>I am a reader and this is my long comment on the article above.</p></section>',
        "<form><label>Name</label><input name=a><p>Please fill this form with your data and send it to us.</p></form>",
        '<div role="banner">A banner that is a long sentence about some offer of the day.</div>',
        "<script>document.write('<p>not text</p>')</script><style>p { color: red }</style><noscript>no script</noscript>",
        "<header><h2>Site name and slogan of some length</h2></header>",
    ],
)
@pytest.mark.parametrize("inside", [True, False])
def test_noise_goes(noise, inside):
    article = f"<article><h1>Title</h1><p>{LONG}</p>{noise if inside and not noise.startswith('<header') else ''}<p>End.</p></article>"
    page = f"<html><body>{'' if inside else noise}{article}{'' if inside else noise}</body></html>"
    assert main_text(page) == f"Title\n{LONG}\nEnd."


def test_without_article_element():
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(12)) + "</ul>"
    page = f"<html><body><div>{menu}</div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>{menu}</div></body></html>"
    assert main_text(page) == f"Title\n{LONG}\n{LONG}\nShort.\n{LONG}"


@pytest.mark.parametrize("open_", ['<div id="content">', '<div class="postBody entry">', "<main>", "<div>", "<td>"])
def test_containers(open_):
    close = "</" + open_[1:].split()[0].strip(">") + ">"
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Item number {k}</a></li>" for k in range(9)) + "</ul>"
    body = f"<h2>Title</h2><p>{LONG}</p><section><h3>Part</h3><p>Tiny.</p><blockquote>Quoted words</blockquote></section><p>{LONG}</p><p>{LONG}</p><p>End.</p>"
    page = f"<html><body><div>{menu}</div>{open_}{body}{close}<div>{menu}</div></body></html>"
    assert main_text(page) == f"Title\n{LONG}\nPart\nTiny.\nQuoted words\n{LONG}\n{LONG}\nEnd."


def test_misleading_class():
    page = f'<body><div class="post-meta"><p>By a writer</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>'
    assert main_text(page) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<nav>x</nav>", "<!-- open", "<script>open", "<", "&", "</p></p>"])
def test_odd_pages(html):
    assert main_text(html) in ("", "<", "&")


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_pages(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in found) == [(1, LONG, len(LONG)), (2, "", 0), (2, "", 0)]
    assert extract_pages(pages.limit(0)).count() == 0
    assert main_text("<article><p>" + "word " * 200_000 + "</p></article>") == ("word " * 200_000).strip()


def brute_lines(page):
    """(text, ratio, element around it) of each line, by cutting the page at its tags; for pages without stray or implied ends but for p."""
    page = re.sub(r"(?s)<(script|style|title).*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    out, text, tags, links, inside, around = [], "", 0, 0, 0, []
    for tag, data in re.findall(r"<(/?[a-z0-9]+)[^>]*>([^<]*)", page):
        name = tag.strip("/")
        if name in html_extract.BLOCK:
            if text.split():
                clean = " ".join(text.split())
                out.append((clean, max(0, len(clean) - links) / max(1, tags), next((a for a in around if a in ("nav", "article", "footer")), "")))
            text, tags, links = "", 0, 0
        tags += 1
        if name == "br":
            text += " "
        elif name not in html_extract.VOID:
            if tag[0] == "/":
                around = around[: len(around) - around[::-1].index(name) - 1] if name in around else around
            else:
                around = [*around, name]
            inside += (name == "a") * (-1 if tag[0] == "/" else 1)
        data = entities.unescape(data)
        links += len(data.strip()) if inside else 0
        text += data
    return out


def brute_cut(values):
    """The split of the sorted values that is its own midpoint of means, reached from the middle of the range."""
    cut = (min(values) + max(values)) / 2
    for _ in range(20):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            break
        cut = (math.fsum(low) / len(low) + math.fsum(high) / len(high)) / 2
    return cut


def test_pages_against_brute_force():
    """Ratios, smoothing and threshold written out anew, on all pages of a test table, and how often the threshold leaves the advert out by itself."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    decided = 0
    for page in pages:
        lines = brute_lines(page)
        weigh = lambda d: math.exp(-d * d / 2) if abs(d) <= 3 else 0.0
        smoothed = [sum(weigh(i - j) * r for j, (_, r, _) in enumerate(lines)) / sum(weigh(i - j) for j in range(len(lines))) for i in range(len(lines))]
        cut = brute_cut(smoothed)
        wanted = [t for (t, _, where), v in zip(lines, smoothed, strict=True) if where == "article" or (not where and v >= 3 * cut)]
        assert main_text(page) == "\n".join(wanted)
        decided += all(v < cut for (_, _, where), v in zip(lines, smoothed, strict=True) if not where)
    assert decided > 0.9 * len(pages)


def test_threshold_decides(monkeypatch):
    page = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column("html").to_pylist()[0]
    right = main_text(page)
    monkeypatch.setattr(html_extract, "threshold", min)
    assert main_text(page) != right


def test_menus_inside_the_article_go_and_words_in_names_do_not():
    menu = "<p><a href=1>Home</a> <a href=2>World</a> <a href=3>Sport</a></p>"
    links = "<ul>" + "".join(f"<li><a href={k}>Link {k}</a></li>" for k in range(5)) + "</ul>"
    ad = '<div class="ad-slot">Buy now! 50% off</div>'
    kept = '<p class="railway-share">Shares of the railway rose.</p><div class="story-notice-board">On the board.</div><p><label>Label</label> words</p><p><a href=4>One reference</a></p>'
    page = f"<body><nav>{menu}</nav><article><h1>Title</h1>{menu}<p>{LONG}</p><p>{LONG}</p>{ad}{kept}<p>{LONG}</p>{links}</article><footer>{menu}</footer></body>"
    assert main_text(page) == f"Title\n{LONG}\n{LONG}\nShares of the railway rose.\nOn the board.\nLabel words\nOne reference\n{LONG}"


def test_dense_text_outside_the_article_is_content():
    long = " ".join([LONG] * 20)
    page = f"<body><nav><ul><li><a href=1>Home</a></li></ul></nav><article><p>Short news.</p><p>Tiny.</p></article><div>{long}</div><div>An offer.</div><footer>f</footer></body>"
    assert main_text(page) == f"Short news.\nTiny.\n{long}"


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<b>" * 200_000 + "x", "<div><a>" * 60_000 + "</a>" * 60_000, "<i>" * 60_000 + "<div>" + "</i>" * 60_000, "<table><tr><td>" * 40_000])
def test_deep_nesting_is_linear(page):
    assert main_text(page) in ("", "x")
