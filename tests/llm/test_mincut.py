"""Pages of several makes, cuts against all partitions, odd pages."""

import itertools
import random
import re
import time
from html import unescape

import pytest

from eventlab.llm import catalog, mincut
from eventlab.llm.common import prepared

WEIGHTS = mincut.classifier()
PLAIN = """<html><head><title>x</title><style>p{}</style></head><body>
<header class="site-header"><h1><a href="/">My Site</a></h1><p>The best site of the world.</p></header>
<nav class="menu"><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all now please.</div>
<div id="content"><h1>Story of it</h1><p>First paragraph with some words &amp; more, and it goes on for a while.</p><p>Short.</p>
<div class="advert">Buy this now, it is very good and costs little.</div><ul><li>point one</li><li>point two</li></ul>
<p>Second   paragraph<br>over lines&nbsp;here, which is again rather long for the reader.</p>
<form><p>Subscribe to us for more of this</p><input name=x></form></div>
<aside class="sidebar"><h3>Related</h3><p>Some text in the sidebar that is long enough to look like a paragraph.</p></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I really liked this article, thanks for it. It is nice.</p></div></section>
<footer>&copy; 2020 My Site. All rights reserved by us.</footer></body></html>"""


def test_page_without_an_article_element():
    assert mincut.main_blocks(PLAIN, WEIGHTS) == [
        "Story of it", "First paragraph with some words & more, and it goes on for a while.", "Short.", "point one", "point two",
        "Second paragraph over lines here, which is again rather long for the reader."]


def test_article_with_foreign_parts_inside():
    html = """<body><div class=topbar>Free delivery on all orders today!</div><main><article><header><h1>Name</h1><p>By somebody, in May.</p></header>
    <p>Text one is here.</p><div class="ad-slot"><p>An advert that is long enough to look like text.</p></div><script>var a = "<p>no</p>";</script>
    <!-- <p>not this</p> --><table><tr><td>1</td><td>two</td></tr></table><p>Ok</p><nav>Next page</nav>
    <div class="comments-area"><p>A remark of a reader, who writes a lot about it.</p></div></article></main><footer><p>Imprint of the site.</p></footer></body>"""
    assert mincut.main_blocks(html, WEIGHTS) == ["Name", "By somebody, in May.", "Text one is here.", "1", "two", "Ok"]


@pytest.mark.parametrize("seed", range(5))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = 9
    gain = [rng.uniform(-2, 2) for _ in range(n)]
    edges = [(i, i + 1, rng.random()) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(6)]
    edges = [e for e in edges if e[0] != e[1]]

    def cost(side):
        return sum(-g if s else g for g, s in zip(gain, side)) / 2 + sum(c for a, b, c in edges if side[a] != side[b])

    least = min(cost(s) for s in itertools.product((False, True), repeat=n))
    assert abs(cost(mincut.cut(gain, edges)) - least) < 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_cut_of_many_nodes(seed):
    """Against the value of a maximum flow found path by path."""
    rng = random.Random(seed)
    n = 60
    gain = [rng.choice([-1, 1]) * rng.choice([0.5, 1, 2]) for _ in range(n)]
    edges = [(i, i + 1, rng.choice([0.25, 0.5, 1])) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), 0.5) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    left, near = list(gain), [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    flow = 0
    while True:
        come = {i: None for i in range(n) if left[i] > 0}
        queue = list(come)
        for i in queue:
            queue += [j for j, c in near[i].items() if c > 0 and come.setdefault(j, i) == i and j not in queue]
        goal = next((i for i in queue if left[i] < 0), None)
        if goal is None:
            break
        path = [goal]
        while come[path[-1]] is not None:
            path.append(come[path[-1]])
        path.reverse()
        by = min(left[path[0]], -left[goal], *(near[a][b] for a, b in zip(path, path[1:])))
        flow += by
        left[path[0]] -= by
        left[goal] += by
        for a, b in zip(path, path[1:]):
            near[a][b] -= by
            near[b][a] += by
    side = mincut.cut(gain, edges)
    lost = sum(g for g, s in zip(gain, side) if g > 0 and not s) - sum(g for g, s in zip(gain, side) if g < 0 and s)
    assert abs(lost + sum(c for a, b, c in edges if side[a] != side[b]) - flow) < 1e-9


BODY = "<h1>A title</h1><p>First paragraph with words that go on for some time, as they do.</p><p>Second one is here too, for the reader to see.</p>"
TEXT = ["A title", "First paragraph with words that go on for some time, as they do.", "Second one is here too, for the reader to see."]


@pytest.mark.parametrize("name", ["research-article", "post shared-layout", "promotion-free content", "ad-free story", "commentary", "researchArticle", "socialism post", "legality"])
def test_names_that_hold_other_words(name):
    page = f'<body><nav>Menu of it</nav><div class="{name}">{BODY}</div><div class="share-buttons">Share this now</div><footer>Imprint</footer></body>'
    assert mincut.main_blocks(page, WEIGHTS) == TEXT


@pytest.mark.parametrize("name", ["main-navigation", "topnav", "sidebar-left", "related-content", "searchform", "cookie_notice", "commentlist", "user-comments", "AdvertBox", "footer widgets"])
def test_names_of_page_furniture(name):
    page = f'<body><main>{BODY}</main><div class="{name}"><p>Some words that stand here for other reasons, and are rather many of them.</p></div></body>'
    assert mincut.main_blocks(page, WEIGHTS) == TEXT


@pytest.mark.parametrize("head", [
    "<html><head><title>T</title><meta charset=x><body>", "<head><link href=x>", "<head><title>T", "<title>never ended<body>", "<body><noscript>", "<body><noscript><img src=x><article>",
    "<body><iframe src=x>", "<head><noscript><style>p{}</style></noscript>", "<noscript>Please turn it on<body>"])
def test_end_tags_left_out(head):
    assert mincut.main_blocks(f"{head}<article>{BODY}</article>", WEIGHTS) == TEXT


def test_raw_elements_that_are_ended():
    page = f"<head><title>No</title></head><body><noscript><p>Turn scripts on</p></noscript><iframe><p>No frames</p></iframe><article>{BODY}</article><noscript><img></noscript>"
    assert mincut.main_blocks(page, WEIGHTS) == TEXT


@pytest.mark.parametrize("tag", ["<p class=a'>", '<p class=a">', "<p data-x='it is' y\">", "<p title=\"a > b\">", "<p title='a > b' \">", "<p '>"])
def test_stray_quotes(tag):
    page = f"<article>{tag}First one is here.</p><p>Second one is here.</p><p class='b'>Third one's here.</p><p>Fourth.</p></article>"
    assert mincut.main_blocks(page, WEIGHTS) == ["First one is here.", "Second one is here.", "Third one's here.", "Fourth."]


def test_fallback_text_and_unclosed_links():
    page = "<article><p>One is here.</p><canvas>Two is here.</canvas><object><p>Three is here.</p></object><audio>Four is here.</audio><p><a href=x>Five <a href=y>is</a> here.</p></article>"
    assert mincut.main_blocks(page, WEIGHTS) == ["One is here.", "Two is here.", "Three is here.", "Four is here.", "Five is here."]


@pytest.mark.parametrize("page", [
    "<article>" + "<p>Word here and there.</p>" * 60_000, "<body>" + "".join("<p>word</p>" if i % 7 else "<p>Some words of a paragraph, that goes on.</p>" for i in range(60_000)),
    "<noscript>" * 60_000 + "<p>A paragraph</p>", "<p title='" * 60_000])
def test_pages_of_many_blocks(page):
    start = time.process_time()
    mincut.main_blocks(page, WEIGHTS)
    assert time.process_time() - start < 30


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "just <b>text", "x"), (4, "<p>a<p>b</p", "x"), (5, "<div class='x", "x"), (5, "<div class='x", "x"),
            (6, "<article>" + "<p>Word here.</p>" * 3000 + "</article>", "x"), (7, "<b>" * 20_000 + "x" + "<p>y</p>" * 50, "x"), (8, "<script>never closed <p>a</p>", "x"),
            (None, "<article><p>&lt;p&gt; &eacute;</p></article>", "x")]
    df = prepared(spark).createDataFrame(rows, "page_id bigint, html string, text string")
    got = [r["text"] for r in mincut.extracted(df).collect()]
    assert got[:2] == ["", ""] and got[8] == "" and got[4] == got[5]
    assert got[6] == "\n".join(["Word here."] * 3000)
    assert got[9] == "<p> é"
    assert mincut.extracted(df.limit(0)).collect() == []


def test_every_page_of_the_table(spark, data):
    def want(h):
        a = h[h.index("<article>") + 9:h.index("</article>")]
        parts = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", a))
        return "\n".join(p for p in parts if p)

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in catalog.QUERIES["op4_main_text"](spark, data).collect()}
    pages = catalog.table(spark, data, "pages").collect()
    assert got == {r["page_id"]: (want(r["html"]), len(want(r["html"]))) for r in pages}


@pytest.mark.parametrize("attrs,seen", [
    ('class="mobile hidden lg:block"', True), ('data-title="The hidden valley"', True), ("title='aria-hidden=true or display:none'", True), ("data-hidden=1", True),
    ("href=/a/hidden class=x", True), ('aria-hidden="false"', True), ('style="--display:none"', True), ('aria-label=" hidden "', True),
    ("hidden", False), ('class="x"hidden', False), ("HIDDEN=''", False), ("hidden=until-found", False), ("aria-hidden=true", False), ("Aria-Hidden = 'True'", False),
    ('style="color:red; display : none"', False), ("style=display:none", False)])
def test_hidden_by_its_attributes_alone(attrs, seen):
    for tag in ("article", "div", "p"):
        assert [b[0] for b in mincut.blocks(f"<body><{tag} {attrs}>Words of it.</{tag}><p>After</p></body>")] == ["Words of it."] * seen + ["After"]


def test_formulas_stay():
    html = "<article><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds, as is shown in the text above.</p></article>"
    assert mincut.main_blocks(html, WEIGHTS) == ["So a=2 holds, as is shown in the text above."]
