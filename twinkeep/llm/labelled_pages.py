"""Small labelled pages, beside those that the corpus labels by its own markup.

Blocks are written as marks: ``+`` for main text and ``-`` for the rest; one mark is a
few words, two a sentence, three a paragraph.
"""

from __future__ import annotations

import re

PAGES = (
    """<body><header class="site-header"><a href="/">-</a><p class="tagline">--</p></header>
    <nav class="menu main-menu"><ul><li><a href="/a">-</a><li><a href="/b">-</a><li><a href="/c">-</a></ul></nav>
    <main><article><h1>+</h1><p>+++<p>+<p>+++<p>+<p>++<h2>+</h2><ul><li>+<li>+<li>++</ul><p>+++</article></main>
    <aside class="sidebar"><h3>-</h3><ul><li><a href="/x">--</a><li><a href="/y">--</a></ul><p>--</aside>
    <section class="comments" id="comments"><h3>-</h3><div class="comment"><p>--</p></div>
    <div class="comment"><p>---</p></div></section><footer><p>--</p><a href="/z">-</a></footer></body>""",
    """<body><div id="header"><h2>-</h2></div><div id="nav" class="navbar"><a href="/1">-</a> <a href="/2">-</a></div>
    <div id="content" class="content"><h1>+</h1><p>+++</p><p>+</p><p>+++</p><p>+</p><blockquote>++</blockquote><p>+++</p>
    <ul><li>++</li><li>++</li></ul></div><div id="sidebar"><div class="widget"><h4>-</h4><p>--</p></div></div>
    <div class="ad banner advert">--</div><div id="footer">--</div></body>""",
    """<body><div class="cookie notice banner"><p>--</p><button>-</button></div>
    <div class="wrapper container"><div class="post entry"><h1 class="title">+</h1><div class="entry body text">
    <p>+++</p><p>+</p><p>+++</p><table><tr><td>+</td><td>+</td></tr><tr><td>++</td><td>+</td></tr></table><p>++</p></div></div>
    <div class="related posts"><h3>-</h3><a href="/r">--</a></div><form class="newsletter subscribe"><label>-</label>
    <input><button>-</button></form><div class="comments"><ol><li class="comment reply"><p>---</p></li></ol></div></div>
    <div class="footer copyright">--</div></body>""",
    """<body><header><h1><a href="/">-</a></h1><nav><a href="/1">-</a><a href="/2">-</a></nav></header>
    <div role="main" class="main"><article class="story"><header><h1>+</h1></header><p>++</p><p>+++</p>
    <div class="ad sponsored promo">--</div><p>+++</p><figure><figcaption>++</figcaption></figure><p>+++</p>
    <footer class="share social"><a href="/t">-</a><a href="/f">-</a></footer></article></div>
    <aside><p>---</p></aside><footer><ul><li><a href="/i">-</a></li></ul><p>--</p></footer></body>""",
    """<body><div class="topbar header"><span>-</span></div><div class="breadcrumb breadcrumbs"><a href="/">-</a></div>
    <div class="page"><div class="article body"><h2>+</h2><p>+++</p><pre>++</pre><p>+++</p><dl><dt>+</dt><dd>++</dd></dl></div>
    <div class="sidebar right"><p>--</p><p>--</p></div></div><div class="popup modal notice warning alert">--</div>
    <form class="login search"><p>-</p><select><option>-<option>-</select><p>--</p></form>
    <div class="bottom footer">--</div></body>""",
    """<body><nav><ul><li><a href="/1">-</a></ul></nav><div class="ad">--</div><article><h1>+</h1><p>+++<p>+<p>+++<p>++</article>
    <section class="comments"><h2>-</h2><article class="comment"><p>---</p></article><article class="comment"><p>--</p></article>
    </section><footer>--</footer></body>""",
    """<body><div class="notice">--</div><section class="main content"><h1>+</h1><h3>+</h3><p>+++</p><p>+</p><p>+++</p>
    <aside class="note advert">--</aside><p>+++</p></section><section class="reviews responses discussion"><p>---</p><p>--</p></section>
    <section class="newsletter"><p>--</p><form><label>-</label></form></section></body>""",
    """<body><div class="menu"><ul><li>-</li><li>-</li></ul></div><div><h1>+</h1><p>+++</p><p>+++</p><p>++</p></div>
    <div class="sidebar"><p>---</p><p>---</p></div><div id="comments"><p>---</p><p>---</p><p>---</p></div>
    <div class="disclaimer notice"><p>---</p></div><div class="ads">---</div><div class="footer"><p>---</p></div></body>""",
    """<body><main><h1>+</h1><p>+++</p><p>++</p><ul><li>+</li><li>+</li></ul><ol><li>+</li><li>+</li></ol><p>+++</p></main><section class="comments"><p>---</p><p>---</p></section>
    <aside><p>---</p><p>---</p></aside><div class="banner notice">---</div><form><p>---</p></form><footer><p>---</p></footer></body>""",
    """<body><header>-</header><article class="post hentry"><h2 class="title">+</h2><p>+++</p><h3>+</h3><p>+++</p><h2>+</h2><p>+</p><p>++</p>
    </article><footer>-</footer></body>""",
    """<body><header>--<a href="/">-</a></header><div class="article story"><h2>+</h2><p>+++</p><h4>+</h4><p>++</p></div><footer>---</footer></body>""",
    """<body><div id="wrap" class="outer"><div class="top">-</div><section><h1>+</h1><p>+++</p><p>+</p><p>+++</p></section>
    <section class="related"><a href="/q">--</a></section></div><div class="footer">-</div></body>""",
    """<body><div id="page" class="layout"><div class="header"><h1>-</h1></div><div class="columns row"><div class="menu left"><a href="/q">-</a></div>
    <section><h2>+</h2><p>+++</p><ul><li>+</li><li>++</li></ul><p>++</p></section></div></div></body>""",
)

_WORDS = "some words of a page that say what it is about and go on for a while".split()


def filled(page: str) -> str:
    """The page with its marks kept and turned into text of their length."""

    def text(mark: re.Match) -> str:
        size = {1: 3, 2: 14, 3: 70}[len(mark[1])]
        body = " ".join(_WORDS[k % len(_WORDS)] for k in range(size))
        return f">{mark[1][0]} {body}{'.' if size > 3 else ''}"

    return re.sub(r">\s*(\++|-+)(?=\s*<)", text, page)
