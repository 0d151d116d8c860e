from __future__ import annotations

import html
import itertools
import re
import time
from math import exp

import pytest

from twinkeep.llm import extraction, labelled_pages, queries
from twinkeep.llm.htmltree import parse

MEDIUM = "/root/testdata/sf0.01"
LONG = "A longer paragraph of running text that says a lot of things, and goes on. " * 3


def article(page):
    """The article of a page of the given tables, by its own markup."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    parts = re.split(r"<(?:/?p|/?h1)>", inner[1]) if inner else []
    texts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in parts)
    return "\n".join(t for t in texts if t)


def test_tables_give_their_articles(spark):
    found = queries.op9_tree_extraction(spark, MEDIUM).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    assert len(found) == len(pages)
    right = 0
    for r in found:
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        right += r.text == article(pages[r.page_id].html)
    assert right == len(pages)


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet(f"{MEDIUM}/pages.parquet"))


@pytest.mark.parametrize(
    "page",
    [
        "<body><header>Site</header><div class=nav><a href=/>-Home</a></div><div class=content><h1>+T</h1><p>+{}</p><p>+S.</p></div>"
        "<div class=sidebar><p>-{}</p></div><div class=comments><p>-{}</p></div><div class=footer>-c</div>",
        "<body><main><h1>+T</h1><p>+{}<ul><li>+one<li>+two</ul><aside>-s</aside></main><section id=comments><p>-{}</p></section>",
        "<body><div><div><h1>+T</h1><p>+{}</p></div><div class=advert>-{}</div><div id=cookie-banner>-We {}</div></div>",
        "<body><article class=post><h2>+T</h2><p>+{}</p><form><p>-Sign up</p><button>-Go</button></form></article><footer>-f</footer>",
    ],
)
def test_other_layouts(model, page):
    page = re.sub(r"\{\}", LONG, page).replace(">Site<", ">-Site<")
    marked = [n.text for n in parse(page) if n.text]
    plain = re.sub(r">[+-]", ">", page)
    assert extraction.main_text(plain, model).split("\n") == [t[1:].strip() for t in marked if t[0] == "+"]


def test_marginals_match_all_assignments(model):
    page = "<body><nav><a href=x>home</a></nav><div class=content><p>Some text here.</p>more</div><footer>f</footer>"
    nodes = parse(page)
    weight = []
    for node in nodes:
        own = model.prior[node.text is not None]
        weight.append(own + sum(model.weights.get(f, 0.0) for f in extraction.features(node)))
    total, ones = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        z = sum(w for w, v in zip(weight, y) if v)
        for k, node in enumerate(nodes[1:], 1):
            z += model.edges[extraction._edge(nodes, node)][y[node.parent]][y[k]]
        total += exp(z)
        for k, v in enumerate(y):
            ones[k] += exp(z) * v
    assert extraction.marginals(nodes, model) == pytest.approx([o / total for o in ones], rel=1e-6)


def test_hard_markup_stays_linear_and_whole():
    for bad in ("<" * 50_000, "<a " * 50_000, '<a b="' * 20_000, "<p>" * 30_000, "<div>" * 20_000 + "x", "<li>" * 20_000, "<!--" * 20_000):
        parse(bad)
    assert [n.text for n in parse("a <b>b</b>&amp;c<br>d <p>e < f") if n.text] == ["a b&c d", "e < f"]
    assert [n.text for n in parse("<SCRIPT>x</script ><p hidden>y</P>z") if n.text] == ["y", "z"]


def test_formulas_stay_and_open_elements_lose_nothing():
    def texts(page):
        return [n.text for n in parse(page) if n.text]

    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p>see <object data=a>the plan</object>.</p>") == ["see the plan."]
    assert texts("<p>a<svg><text>no</text></svg>b<svg/>c</p><svg><p>d</p><template>e") == ["abc", "d", "e"]
    assert texts("<p>a</p><script>if (1 < 2) {}") == ["a"]
    assert texts("<noscript><p>turn it on</p></noscript><p>b</p>") == ["turn it on", "b"]
    assert texts("<dl><dt>a<dd>b<dl><dt>c</dl>d</dl><ul><li><p>e<ul><li>f</ul>g<li>h</ul>") == list("abcdefgh")


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>" * n + "</p></b></x>" * n,
        lambda n: "<x>" * n + "<y></y>" * n,
        lambda n: "<x>" * n + "<li>a</li>" * n,
        lambda n: "<ul><li>" + "<x>" * n + "<dt></dt><td></td>" * n,
        lambda n: "<svg/>" * n + "<template>" * n,
        lambda n: "<svg>a" * n,
        lambda n: f"<div {'a' * 20 * n}>b",
        lambda n: f"<div a{' ' * 20 * n}b>c",
    ],
)
def test_time_is_linear_in_tags(page):
    def seconds(n):
        started = time.process_time()
        parse(page(n))
        return time.process_time() - started

    seconds(1000)
    few, many = min(seconds(4000) for _ in range(3)), min(seconds(32_000) for _ in range(2))
    assert many < 24 * few + 0.1


def test_odd_rows(spark, model):
    page = f"<article><h1>T</h1><p>{LONG}</p></article>"
    data = [(1, page, 5), (1, page, 5), (None, None, 5), (2, "", 5), (3, "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", 5)]
    pages = spark.createDataFrame(data, "page_id long, html string, text int")
    rows = extraction.extract(pages, model).collect()
    assert [r.text.count("\n") for r in rows] == [1, 1, 0, 0, 2999]
    assert rows[2].text == rows[3].text == "" and rows[2].n_chars == 0
    assert extraction.extract(pages.limit(0), model).count() == 0
    alone = extraction.train(pages.limit(0))
    assert extraction.main_text(labelled_pages.filled(labelled_pages.PAGES[0]).replace("+ ", ""), alone)


def test_every_feature_seen_twice_is_kept(spark):
    def word(n):
        return "q" + "".join(chr(97 + n // 26**k % 26) for k in range(4))

    def page(k):
        names = " ".join(word(4 * (k // 2) + j) for j in range(4))
        return f"<html><body><main class='{names}'><p>One sentence of page {k}, long enough.</p></main></body></html>"

    pages = [(k, "u", page(k)) for k in range(3_600)]
    model = extraction.train(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sum(n.startswith("n:q") for n in model.weights) > 5_000
