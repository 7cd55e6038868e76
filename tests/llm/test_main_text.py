"""Main text of hand-made pages."""

import html
import re
import time

import pytest

from eventide.llm.main_text import extract, main_text

P1 = "A first long paragraph, with commas, to say what this article is about &amp; why."
P2 = "Another <b>bold</b> paragraph <a href='/x'>with a link</a> inside, and enough words to be a paragraph."
T1, T2 = "A first long paragraph, with commas, to say what this article is about & why.", (
    "Another bold paragraph with a link inside, and enough words to be a paragraph."
)
MENU = "<ul class='top'><li><a href='/a'>Alpha</a><li><a href='/b'>Beta, gamma</a></ul>"

PAGES = {
    "plain": (f"<html><body><nav>{MENU}</nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; x</footer>", f"Title\n{T1}\n{T2}"),
    "classes": (
        f"<body class='has-sidebar'><div id=header>Site name, slogan, and more</div><div class='post-content'><h2>T</h2><p>{P1}<p>{P2}</div>"
        "<div class='sidebar'><p>Side, side, side, side, side, side</p></div><div id='comments'><p>First, I say, no, no, no!</p></div>",
        f"T\n{T1}\n{T2}",
    ),
    "wrapped": (f"<article><div><p>{P1}</p></div><div><p>{P2}</p></div><div class='ad'>Buy, buy, buy, buy</div></article>", f"{T1}\n{T2}"),
    "siblings": (f"<body><div><p>{P1}</p></div><p>{P2}</p><div><a href=x>one</a> <a href=y>two</a></div>", f"{T1}\n{T2}"),
    "hidden": (f"<main><p hidden>no</p><p style='display:none'>no</p><p>{P1}</p><p aria-hidden=true>no</p></main>", T1),
    "code": (f"<div><script>if (a < b) '</p>'</script><style>p > a {{}}</style><p>{P1}<!-- <p>no</p> --></p></div>", T1),
    "white space": ("<p>  a\n\tb&nbsp;c<br>d  </p><p></p><p> </p>", "a b c d"),
    "references": ("<p>&lt;p&gt; &#233;&#xE9; &eacute; &unknown; &amp;amp; AT&T 1 < 2</p>", "<p> éé é &unknown; &amp; AT&T 1 < 2"),
    "broken": (f"<div><p><b>{P1}<br><p>{P2}<p>cut off &am", f"{T1}\n{T2}\ncut off &am"),
    "broken tag": (f"<div><p>{P1}</p><p cla", T1),
    "broken comment": (f"<div><p>{P1}</p><!-- never ended <p>no</p>", T1),
    "form": (f"<article><p>{P1}</p><form><label>Your name, please</label><input><textarea>x</p></textarea></form></article>", T1),
    "header": (f"<header><p>Site, site, site</p></header><article><header><h1>Title</h1><p>by someone</p></header><p>{P1}</p></article>", f"Title\n{T1}"),
    "links only": (f"<article><p>{P1}</p>{MENU}<ul><li>a real point</li><li>another</li></ul></article>", f"{T1}\na real point\nanother"),
    "table": (f"<article><p>{P1}</p><table><tr><td>1<td>2<tr><th>3</table></article>", f"{T1}\n1\n2\n3"),
    "notice": (f"<article><div class=cookie-notice>We use cookies, really</div><p>{P1}</p><section class=related-posts><p>More</p></section></article>", T1),
    "no markup": ("just text, no tags", "just text, no tags"),
    "quotes": (f"<div title='a > b' data-x=\"</div>\"><p>{P1}</p></div>", T1),
    "upper case": (f"<DIV><P>{P1}</P></DIV>", T1),
    "only menus": (f"<nav>{MENU}</nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, wanted = PAGES[name]
    assert main_text(source) == wanted


BODY, TEXT = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p>", f"Title\n{T1}\n{T2}"
LONG = "Well, I think so too, and more so than ever before. " * 20
WRAPPED = {
    "article": (f"<body><article class='post tag-search'>{BODY}</article><div class=sidebar>Side, side</div>", TEXT),
    "article without other words": (f"<body><article class='widget'>{BODY}</article><div><a href=x>end</a></div>", TEXT),
    "layout": (f"<body><div class='layout-sidebar-right'><div class=content>{BODY}</div><div class=sidebar><p>Side, side</p></div></div>", TEXT),
    "widget": (f"<body><div class=content><div class='elementor-widget-container'>{BODY}</div></div>", TEXT),
    "widgets": (
        f"<body><div class=elementor-widget><div class=elementor-widget-container><p>{P1}</p></div></div>"
        f"<div class=elementor-widget><div class=elementor-widget-container><p>{P2}</p></div></div>", f"{T1}\n{T2}",
    ),
    "form": (f"<body><form id='aspnetForm'><input><div class=content>{BODY}</div><div class=comments><p>No, no!</p></div></form>", TEXT),
    "form with words": (f"<body><form class='search-form'><label>Find</label><div>{BODY}</div></form>", TEXT),
    "header": (f"<body><div class='fixed-header'><div>{BODY}</div></div>", TEXT),
    "inline": (f"<body><div class='layout-sidebar-right'><h1>Title</h1><p>{P1} <span class=ad>Buy</span></p><p>{P2}</p></div>", TEXT),
    "long comments": (f"<body><div class=content>{BODY}</div><div id=comments><p>{LONG}</p></div>", TEXT),
    "long comments beside an article": (f"<body><article>{BODY}</article><div class=widget><h1>x</h1><p>{LONG}</p></div>", TEXT),
    "long notice": (f"<body><div class=content>{BODY}</div><div class=cookie-notice><p>{LONG}</p></div>", TEXT),
    "hidden": (f"<body><div class=content>{BODY}</div><div class=widget hidden><p>{LONG}</p></div>", TEXT),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_pages(name):
    source, wanted = WRAPPED[name]
    assert main_text(source) == wanted


POINTS = "<ul><li>a real point</li><li>another</li></ul>"
REST, REST_TEXT = f"{POINTS}<p>Short end.</p>", "a real point\nanother\nShort end."
TEASERS = "<div><a href=/1>Read this as well</a> <a href=/2>and that</a></div>"
MUCH, MUCH_TEXT = f"<p>{P1}</p><p>{P2}</p>" * 5, "\n".join([T1, T2] * 5)
LAYOUTS = {
    "div": (f"<body><div id=post><h1>Title</h1><div class=text>{MUCH}</div>{REST}</div>", f"Title\n{MUCH_TEXT}\n{REST_TEXT}"),
    "two wrappers": (
        f"<body><div id=post><h1>Title</h1><div><div class=text>{MUCH}</div></div>{REST}</div>{TEASERS}", f"Title\n{MUCH_TEXT}\n{REST_TEXT}",
    ),
    "body": (f"<body>{MENU}<h1>Title</h1><div class=text>{MUCH}</div>{REST}{TEASERS}", f"Title\n{MUCH_TEXT}\n{REST_TEXT}"),
    "table and code": (
        f"<div id=post><div class=text>{MUCH}</div><table><tr><td>1<td>2</table><pre>x = 1</pre><blockquote>So.</blockquote>"
        f"<figure><figcaption>Fig.</figcaption></figure><div>Short.</div>{TEASERS}{MENU}</div>", f"{MUCH_TEXT}\n1\n2\nx = 1\nSo.\nFig.\nShort.",
    ),
    "loose text": (f"<div id=post>Before it.<div class=text>{MUCH}</div>After it. <a href=x>y</a></div>", f"Before it.\n{MUCH_TEXT}\nAfter it. y"),
    "in an article": (
        f"<article><h1>Title</h1><div><div class=text>{MUCH}</div></div>{POINTS}<div>Short end.</div></article>{TEASERS}", f"Title\n{MUCH_TEXT}\n{REST_TEXT}",
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_blocks_beside_the_best_container(name):
    source, wanted = LAYOUTS[name]
    assert main_text(source) == wanted


@pytest.mark.parametrize("source", [None, "", " \n", "<", "<p", "</p>", "<!", "<!--", "<script>x", "<a <b <c>", "</html></body></div>"])
def test_scraps_do_not_break_it(source):
    assert main_text(source) in ("", "<")


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert main_text("<p>" + "word, " * 300_000).count("word,") == 300_000
    assert main_text("<p><b>x " * 20_000).count("x") == 20_000


def test_every_page_gives_a_row(spark):
    rows = [(i, f"u{i}", s, 1, "t") for i, (s, _) in enumerate(PAGES.values())] + [(None, None, None, 1, "t"), (3, "u3", PAGES["siblings"][0], 1, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    found = sorted((r.page_id is None, r.page_id, r.url, r.text, r.n_chars) for r in extract(pages).collect())
    assert found == sorted((i is None, i, u, main_text(s), len(main_text(s))) for i, u, s, *_ in rows)
    assert extract(pages.limit(0)).count() == 0


def plain(source):
    """Main text of a page that marks its article and cuts blocks at p and h1 only."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toLocalIterator():
        assert main_text(row.html) == plain(row.html)


N = 20_000
LARGE = {
    "one word": "<div class='ad x'>text, here " * N,
    "many words": "".join(f"<div class='{a} w{i}'>some text {i}" for i in range(N // 5) for a in ("ad", "promo", "menu", "widget", "sidebar")),
    "closed": "".join(f"<form>text {i}</form>" for i in range(N)),
    "nested": "<form>" * N + "text",
    "containers": "<div><p>abc, d" * N,
    "inside an article": f"<article><p>{P1}</p>" + "<div class=related>more, more" * N,
}


@pytest.mark.parametrize("name", LARGE)
def test_time_grows_with_the_page_only(name):
    begun = time.process_time()
    text = main_text(LARGE[name])
    assert time.process_time() - begun < 2
    assert name != "inside an article" or text == T1


def test_points_reach_eight_containers():
    """Two long paragraphs at the ends of deep wrappers; a menu beside the outermost does not come with them."""
    deep = f"<div><p>{P1 * 4}</p><p>{P2}</p></div>"
    for _ in range(12):
        deep = f"<div>{deep}</div>"
    assert main_text(f"<body>{deep}<div><a href=x>one</a> <a href=y>two</a></div></body>") == f"{T1 * 4}\n{T2}"
