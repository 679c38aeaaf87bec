"""Main text of pages, regular and broken."""

import random
import time
from html.parser import HTMLParser

import pytest

from streamweave.llm.html_text import extract_main_text, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>menu one</a></nav>
<div id="cookie-notice">We use cookies, yes, always, and more cookies, too.</div><div class="wrap"><div class="story"><h2>Head &amp; more</h2>
<p>Para one, with, commas, and quite some text to be scored &#39;well&#39;.</p><p>Second<br>para   two, more text here, yes.<ul><li>item one<li>item two</ul></div>
<aside>Side, text, which is long enough to be counted, maybe.</aside><div class="comments"><p>Reader comment, long, long, text, text, text, text, text.</p></div></div>
<form><p>sign, up, now, please, today</p></form><footer>&copy; foot</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_article_without_boilerplate():
    assert main_text(PAGE) == "Head & more\n\nPara one, with, commas, and quite some text to be scored 'well'.\n\nSecond para two, more text here, yes.\n\nitem one\n\nitem two"


def test_unclosed_and_odd():
    assert main_text("<p>a<p>b") == "a\n\nb"
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<article><h1>x</h1><p>y") == "x\n\ny"
    assert main_text("<div>" * 3000 + "deep" + "</span>" * 3000) == "deep"
    assert main_text("<" * 5000) == "<" * 5000
    assert main_text("<!-- never closed <p>x</p>") == ""
    assert main_text("<script>only") == ""


def test_siblings_of_the_best_container_are_kept():
    part = "<div class='part'><p>" + "Some, longer, text of the story, " * 12 + "</p></div>"
    links = "<div>" + "<a href=x>another story, with a comma</a> " * 20 + "</div>"
    out = main_text(f"<body><div>{part}{part}{links}</div></body>")
    assert out.count("\n\n") == 1 and "another" not in out


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, PAGE, "old"), (3, PAGE, "old"), (None, "<p>é</p>", None)], "page_id long, html string, Text string")
    got = extract_main_text(df).collect()
    assert len(got) == 5 and [r["text"] for r in got][:2] == ["", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


LONG = "Some, longer, text of the story, " * 12


def test_marked_wrappers_of_the_article_stay():
    for mark in ("layout has-sidebar", "with-side", "no-ads", "page-legal", "related"):
        assert main_text(f'<body><div class="{mark}"><article><p>{LONG}</p></article><div class="sidebar"><p>{LONG[:40]}</p></div></div></body>').startswith(LONG.strip())
        if mark != "related":  # there the text outside is the page's
            assert main_text(f'<div class="{mark}"><div id="side"><p>{LONG}</p></div></div><p>Short, plain, notice of the site.</p>').startswith(LONG.strip())
    story = f"<div><p>{LONG}</p></div>"
    assert main_text(f'{story}<div class="comments"><article><p>{LONG * 3}</p></article></div><div class="site-footer"><p>{LONG[:60]}</p></div>') == LONG.strip()


def test_all_of_the_article_is_kept():
    assert main_text(f"<article><h1>Head</h1><p>short lead</p><div><p>{LONG}</p></div></article>") == f"Head\n\nshort lead\n\n{LONG.strip()}"
    parts = f"<section><p>{LONG}</p></section><section><p>brief part</p></section>"
    assert main_text(f"<main><article>{parts}</article></main>").endswith("brief part")
    assert "x = 1" in main_text(f"<div><p>{LONG}</p><figure><pre>x = 1</pre><figcaption>Listing</figcaption></figure></div>")


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a b='" * 100_000 + ">", '<a ">" ' * 100_000, "<p>x" + "<div>" * 20_000 + "<li>y</li>" * 20_000, "<ul><li>" + "<div>" * 20_000 + "<ul></ul><li>y</li>" * 20_000, "<title>" * 100_000, "<!--" * 200_000, "</div>" * 200_000 + "<b" * 200_000, "<table><tr><td>" * 10_000 + "<li>y</li>" * 20_000, "&" * 500_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 2.0


def test_class_words_never_empty_a_page():
    for mark in ("has-sidebar", "with-sidebar", "no-sidebar", "side-by-side", "nav-open", "menu-open", "legal", "article-header"):
        assert main_text(f'<body><div class="{mark}"><p>{LONG}</p><p>{LONG}</p></div></body>').count(LONG.strip()) == 2


def test_references_labels_and_headings_stay():
    refs = "".join(f"<li><a href=x>Author {i}, B. and Other, C. A long title of a cited work, 20{i:02}</a></li>" for i in range(9))
    page = f"<header>site</header><article><header><h1>Title</h1></header><h2>Head</h2><p>{LONG}</p><p><label>Labelled text</label></p><ul>{refs}</ul><ul><li><a href=x>one</a><li><a href=x>two</a></ul></article>"
    out = main_text(page)
    assert out.startswith("Title\n\nHead\n\n") and "Labelled text" in out and "Author 8" in out and "two" not in out


class Plain(HTMLParser):
    """The blocks of a page's article by a plain walk."""

    BREAKS = frozenset("p div li ul ol h1 h2 h3 h4 table tr td th section article blockquote pre figure figcaption".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.dropped, self.blocks, self.text = 0, 0, [], []

    def end_block(self):
        block = " ".join("".join(self.text).split())
        self.text.clear()
        if block:
            self.blocks.append(block)

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.end_block()
        if tag == "br":
            self.text.append(" ")
        self.inside += tag == "article"
        self.dropped += tag in ("script", "style", "aside", "nav", "form", "footer", "header")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.end_block()
        self.inside -= tag == "article"
        self.dropped -= tag in ("script", "style", "aside", "nav", "form", "footer", "header")

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.text.append(data)


def test_pages_equal_a_plain_walk(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    for html in pages:
        walk = Plain()
        walk.feed(html)
        walk.close()
        walk.end_block()
        assert main_text(html) == "\n\n".join(walk.blocks)


def test_generated_pages_have_their_main_text():
    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choice(["plain", "words", "of", "a", "story", "told", "here"]) for _ in range(rng.randrange(6, 30))).capitalize() + "."
    for _ in range(100):
        blocks = [sentence() + " " + sentence() for _ in range(rng.randrange(3, 9))]
        body = "".join(f"<{t}>{b}</{t}>" for b in blocks for t in [rng.choice(["p", "p", "p", "blockquote"])])
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div class="layout has-sidebar"><div id="content">{}</div></div>'])
        menu = "<ul>" + "".join(f"<li><a href=/{i}>{rng.choice(['home', 'about', 'news'])}</a></li>" for i in range(7)) + "</ul>"
        side = f'<div class="sidebar"><p>{sentence()}</p></div>'
        page = f'<html><body><nav>{menu}</nav>{rng.choice(["", side])}{wrap.format(body)}{rng.choice(["", side])}<div class="comments"><p>{sentence()}</p></div><footer>{sentence()}</footer></body></html>'
        assert main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("page, want", [
    (f"<body><nav><a href=x>Home</a><article><h1>T</h1><p>{LONG}</p></article></body>", "T\n\nLONG"),
    (f"<body><header><h1>Site</h1><div><p>{LONG}</p><p>{LONG}</p></div></body>", "Site\n\nLONG\n\nLONG"),
    (f"<body><div><p>{LONG}</p></div><footer><p>Copyright 2020, all rights, and words enough to be long.</p></body>", "LONG"),
    (f"<body><aside><article><p>A teaser, with some more words</p></article></aside><article><p>{LONG}</p></article></body>", "LONG"),
    (f"<body><div role=navigation><p>{LONG}</p>", "LONG"),
])
def test_unclosed_boilerplate(page, want):
    assert main_text(page) == want.replace("LONG", LONG.strip())


@pytest.mark.parametrize("mark", ["commentlist", "adsbygoogle", "AdBox", "cookieConsent", "col-right", "commentArea", "relatedPosts", "leftSidebar", "newsletterSignup"])
def test_joined_names_are_marks(mark):
    assert main_text(f"<article><p>{LONG}</p><div class={mark}><h2>Head</h2><p>Some text, of others</p></div></article>") == LONG.strip()


def test_headings_and_short_blocks_stand_beside_the_text():
    body = f"<h1>Title</h1><p>Short first.</p><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>one</li><li>two</li></ul><section><p>Short second.</p></section><p>Last.</p>"
    want = "\n\n".join(["Title", "Short first.", LONG.strip(), LONG.strip(), "one", "two", "Short second.", "Last."])
    assert main_text(f"<body><div id=menu><a>1</a></div><div id=content>{body}</div><p>© 2020 X</p></body>") == want
    assert main_text(f"<body><div><a href=1>Home</a> <a href=2>More</a></div>{body}<p>© 2020 X</p></body>") == want
