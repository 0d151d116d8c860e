"""Blocks of a web page as a tree.

``parse`` walks the tags of a page once and builds a tree of its container elements, in
time linear in the page. Leaves are blocks: runs of text between block-level boundaries.
It is forgiving: an element left open ends with its parent, a closing tag without an
opening one is passed over, and a page may stop anywhere. Of an element without text that
is left open only the tag is passed over, unless browsers too take all that follows as its
content (scripts, styles).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![A-Za-z_:-])([A-Za-z_:-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements whose content is no text, those of them that run to the end
#: of the page when left open, elements without content, and elements that run inside a block
#: (formulas included).
RAW = {"script", "style", "template", "svg", "iframe", "textarea", "title"}
TO_THE_END = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "object",
    "math", "semantics", "annotation", "maction", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover",
    "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup",
    "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover",
}
#: Elements that a new one of the same group ends.
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
         "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOP = {"ul", "ol", "dl", "table", "select", "body", "html", "div", "article", "section", "aside", "nav", "main"}


@dataclass
class Node:
    tag: str
    names: tuple[str, ...] = ()
    parent: int = -1
    depth: int = 0
    #: A block's text, and how much of it stands in links; None for a container.
    text: str | None = None
    linked: int = 0
    hidden: bool = False


@dataclass
class _Open:
    tag: str
    node: int
    hidden: bool = field(default=False)


def _names(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role; whether the element is hidden."""
    names, hidden = [], bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes))
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = html.unescape(a or b or c).lower(), key.lower()
        if key in ("class", "id", "role"):
            names += re.findall(r"[a-z]+", value)
        elif key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key == "aria-hidden" and value == "true":
            hidden = True
    return tuple(dict.fromkeys(names)), hidden


def parse(page: str | None) -> list[Node]:
    """The nodes of a page, parents before children, blocks in page order.

    A block's ``tag`` is ``#`` and the element that it stands in.
    """
    page = page or ""
    nodes = [Node("html")]
    stack = [_Open("html", 0)]
    #: Where in the stack the open elements of each name are, and those that bound a search.
    places: dict[str, list[int]] = {}
    stops = [0]
    endless: set[str] = set()
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal pieces, linked
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            top = nodes[stack[-1].node]
            nodes.append(Node("#" + top.tag, (), stack[-1].node, top.depth + 1, text, linked, stack[-1].hidden))
        pieces, linked = [], 0

    def put(raw: str) -> None:
        nonlocal linked
        pieces.append(raw)
        if links:
            linked += len(raw)

    def close(place: int) -> None:
        """End the open elements from a place of the stack on."""
        while len(stack) > place:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in _STOP:
                stops.pop()

    at = 0
    while at < len(page):
        low = page.find("<", at)
        if low < 0:
            put(page[at:])
            break
        put(page[at:low])
        hit = _TAG.match(page, low)
        if not hit:
            put("<")
            at = low + 1
            continue
        at = hit.end()
        name = (hit[2] or "").lower()
        if not name:
            continue
        if hit[1]:
            if name in INLINE:
                links = max(0, links - (name == "a"))
                put(" " if name == "br" else "")
            elif places.get(name):
                flush()
                links = 0
                close(places[name][-1])
            elif name == "p":
                flush()
            continue
        if name in RAW:
            if not hit[0].endswith("/>") and name not in endless:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in TO_THE_END:
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if name in INLINE:
            links += name == "a"
            put(" " if name in ("br", "img", "wbr") else "")
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        ends = _ENDS.get(name)
        if ends or "p" in (o.tag for o in stack[-1:]):
            last = max((places[tag][-1] for tag in ends or {"p"} if places.get(tag)), default=0)
            if last > stops[-1]:
                close(last)
        names, hidden = _names(hit[3] or "")
        top = stack[-1]
        nodes.append(Node(name, names, top.node, nodes[top.node].depth + 1, None, 0, hidden or top.hidden))
        places.setdefault(name, []).append(len(stack))
        if name in _STOP:
            stops.append(len(stack))
        stack.append(_Open(name, len(nodes) - 1, hidden or top.hidden))
    flush()
    return nodes
