"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree is a binary variable: main text or not. Nodes have chances
by what is seen of them (element, words of class, id and role, and for a block its
length, share of links and how it ends), edges by how parent and child go together.
Sum-product messages, once up and once down the tree, give each block's exact marginal;
blocks at 0.5 or more are the text, in page order.

Chances are counted on labelled pages: a bounded sample (about ``SAMPLE``, by hash of
the html) of those pages whose own markup shows an article, and the small hand-labelled
pages of ``labelled_pages``, which together count as much as the sample does. Every feature that
the sample shows ``LEAST_SEEN`` times is kept, so the sample bounds what is broadcast.

A null or empty page gives the empty text. Character references are decoded, white
space inside a block becomes one space, nothing is capped. Pages are independent:
repeated rows and null ids each give their result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import labelled_pages, rows
from twinkeep.llm.htmltree import Node, parse

SAMPLE, LEAST_SEEN, SMOOTHING = 4_000, 2, 0.5

#: Elements and names that show an article, and what is not part of one.
_ARTICLE = {"article", "main"}
_APART_TAGS = {"nav", "aside", "footer", "form"}
_APART = {"comment", "comments", "share", "social", "related", "ad", "ads", "advert", "sidebar", "notice", "cookie", "newsletter", "promo"}
_HEADING = re.compile("#h[1-6]$")
_END = re.compile(r"[.!?…:;。]['\")\]»”]*$")


#: Fixed values of HTML: elements that order text, in an article as in a menu. They say
#: nothing by themselves.
_PLAIN = {"ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "p", "caption", "center"}


def features(node: Node) -> list[str]:
    """What is seen of a node."""
    if node.text is None:
        tag = [] if node.tag in _PLAIN else [f"t:{node.tag}{'.' if node.names else ''}"]
        return [*tag, *(f"n:{name}" for name in node.names), *(["hidden"] if node.hidden else [])]
    size = len(node.text)
    share = node.linked / max(1, size)
    return [
        f"heading:{bool(_HEADING.match(node.tag))}",
        f"size:{(size >= 32) + (size >= 128)}",
        f"links:{0 if not node.linked else 1 if share < 0.5 else 2}",
        f"end:{bool(_END.search(node.text))}",
        *(["hidden"] if node.hidden else []),
    ]


def _edge(nodes: list[Node], node: Node) -> str:
    """The kind of edge to a node's parent: a block's, one within the page's frame, another."""
    if node.text is not None:
        return "block"
    return "frame" if nodes[node.parent].tag in ("html", "body") else "box"


def weak_labels(nodes: list[Node]) -> list[bool] | None:
    """Labels of the blocks of a page with an article, by its markup; None without."""
    inside, apart, found = [False] * len(nodes), [False] * len(nodes), False
    for k, node in enumerate(nodes):
        if k:
            inside[k], apart[k] = inside[node.parent], apart[node.parent]
        if node.text is None:
            shows = node.tag in _ARTICLE
            found |= shows
            inside[k] |= shows
            apart[k] |= node.tag in _APART_TAGS or not _APART.isdisjoint(node.names)
    return [i and not a for i, a in zip(inside, apart)] if found else None


def _all_labels(nodes: list[Node], blocks: list[bool]) -> list[int]:
    """Labels of all nodes: a container is what most of its text is."""
    good, size = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.text is not None:
            size[k] += len(node.text)
            good[k] += len(node.text) * blocks[k]
        if k:
            good[node.parent] += good[k]
            size[node.parent] += size[k]
    return [int(2 * g > s) if s else -1 for g, s in zip(good, size)]


def _count(nodes: list[Node], blocks: list[bool], weight: int, counts: Counter) -> None:
    labels = _all_labels(nodes, blocks)
    for k, node in enumerate(nodes):
        y = labels[k]
        if y < 0:
            continue
        counts[("node:block" if node.text is not None else "node:box", y)] += weight
        for name in features(node):
            counts[(name, y)] += weight
        if k and labels[node.parent] >= 0:
            counts[(f"edge:{_edge(nodes, node)}:{labels[node.parent]}", y)] += weight


@dataclass
class PageModel:
    """Log-odds of features, priors by kind of node, and log chances of edges."""

    weights: dict[str, float]
    prior: dict[bool, float]
    edges: dict[str, list[list[float]]]


def _model(counts: Counter) -> PageModel:
    s = SMOOTHING
    total = {(b, y): counts[(f"node:{'block' if b else 'box'}", y)] + s for b in (False, True) for y in (0, 1)}
    names = sorted({k for k, _ in counts if not k.startswith(("node:", "edge:"))})
    weights = {}
    for name in names:
        block = name.startswith(("heading:", "size:", "links:", "end:"))
        a, b = ((counts[(name, y)] + s) / (total[(block, y)] + 2 * s) for y in (1, 0))
        weights[name] = log(a / b)
    prior = {b: log(total[(b, 1)] / total[(b, 0)]) for b in (False, True)}
    edges = {}
    for b in ("block", "frame", "box"):
        n = [[counts[(f"edge:{b}:{p}", c)] + s for c in (0, 1)] for p in (0, 1)]
        whole = sum(map(sum, n))
        child = [n[0][c] + n[1][c] for c in (0, 1)]
        # How much more often the two go together than by chance.
        edges[b] = [[log(n[p][c] * whole / (sum(n[p]) * child[c])) for c in (0, 1)] for p in (0, 1)]
    return PageModel(weights, prior, edges)


def hand_counts(weight: int) -> Counter:
    """Counts of the hand-labelled pages, each taken ``weight`` times."""
    counts: Counter = Counter()
    for page in labelled_pages.PAGES:
        nodes = parse(labelled_pages.filled(page))
        blocks = [n.text is not None and n.text.startswith("+") for n in nodes]
        for node in nodes:
            if node.text is not None:
                node.text = node.text[2:]
        _count(nodes, blocks, weight, counts)
    return counts


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> PageModel:
    """Count chances on a sample of ``pages`` and the hand-labelled pages."""
    share = min(1.0, sample / max(1, pages.count()))
    # Copies of a page share its hash; they count once.
    chosen = pages.select(F.col(html).alias("html")).where("html IS NOT NULL")
    chosen = chosen.where(F.pmod(F.xxhash64("html", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()

    def make():
        counts: Counter = Counter()

        def work(texts: pa.Array):
            for text in texts.to_pylist():
                nodes = parse(text)
                blocks = weak_labels(nodes)
                if blocks is not None:
                    counts[("node:page", 1)] += 1
                    _count(nodes, blocks, 1, counts)
            return [[], [], []]

        def end():
            keys = list(counts)
            return [[k for k, _ in keys], [y for _, y in keys], [counts[k] for k in keys]]

        work.end = end
        return work

    met = (
        rows.generate(chosen, ["html"], make, "name string, y int, n long")
        .groupBy("name")
        .agg(*[F.sum(F.when(F.col("y") == y, F.col("n"))).alias(f"n{y}") for y in (0, 1)])
        .where(
            (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0)) >= LEAST_SEEN)
            | F.col("name").rlike("^(node|edge):")
        )
        .orderBy("name")
        .collect()
    )
    found = {(r.name, y): n for r in met for y, n in enumerate((r.n0, r.n1)) if n}
    counts = hand_counts(max(1, found.get(("node:page", 1), 0) // len(labelled_pages.PAGES)))
    counts.update(found)
    return _model(counts)


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + log(1 + exp(b - a))


def marginals(nodes: list[Node], model: PageModel) -> list[float]:
    """The chance of each node to be main text, by messages up and down the tree."""
    weights, count = model.weights, len(nodes)
    # Messages are log-chances of 0 and 1; beliefs gather a node's own and its children's.
    zero, one, up = [0.0] * count, [0.0] * count, [(0.0, 0.0)] * count
    for k, node in enumerate(nodes):
        one[k] = model.prior[node.text is not None] + sum(weights.get(f, 0.0) for f in features(node))
    for k in range(count - 1, 0, -1):
        node = nodes[k]
        e = model.edges[_edge(nodes, node)]
        m0 = _sum(e[0][0] + zero[k], e[0][1] + one[k])
        m1 = _sum(e[1][0] + zero[k], e[1][1] + one[k])
        up[k] = (m0, m1)
        zero[node.parent] += m0
        one[node.parent] += m1
    for k in range(1, count):
        node = nodes[k]
        e, (m0, m1) = model.edges[_edge(nodes, node)], up[k]
        # What the parent believes without this child.
        p0, p1 = zero[node.parent] - m0, one[node.parent] - m1
        zero[k] += _sum(e[0][0] + p0, e[1][0] + p1)
        one[k] += _sum(e[0][1] + p0, e[1][1] + p1)
    return [1 / (1 + exp(max(-700.0, min(700.0, z - o)))) for z, o in zip(zero, one)]


def main_text(page: str | None, model: PageModel) -> str:
    nodes = parse(page)
    chances = marginals(nodes, model)
    return "\n".join(n.text for n, c in zip(nodes, chances) if n.text is not None and c >= 0.5)


def extract(pages: DataFrame, model: PageModel, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array):
            found = [main_text(t, model) for t in texts.to_pylist()]
            return [pa.array(found, pa.string()), [len(t) for t in found]]

        return work

    return rows.append(pages, [html], make, "text string, n_chars long")
