"""Main-text extraction from HTML by tree scoring (operator 3).

A page is scanned once into a light tree of containers and text blocks.  Each
block passes points for its length and its commas to its ancestors, less at
each level; a container's points are discounted by its link density.  The best
container is kept with those siblings that score well enough on their own.
Boilerplate elements (menus, headers, footers, sidebars, forms, scripts,
comments of readers, adverts, notices) are dropped before scoring, by element
name, role or the words of their class and id (an article's own header is part
of it).  A class is only a hint: a marked
element that holds the article or most of the page's paragraph points stays, and
a page that would be left empty is read again without the class rule.  Inside an
article or main all that isn't dropped is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, drop_clashing, fresh, table

#: Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas xmp noembed noframes".split())
SKIP = frozenset("nav header footer aside form button select option fieldset menu dialog head audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("html body article main section div td center".split())
#: An open <p> ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements whose start closes an open one of the same kind in the same list or table.
REPEATS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class or id that mark boilerplate.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|paywall|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|rail|widget|related|recommend\w*|trending|share|sharing|social|"
    r"comments?|disqus|reply|replies|respond|footer|foot|header|masthead|topbar|toolbar|login|signup|search|skip|copyright|legal|disclaimer|toc|"
    r"comment(?:list|area|form|thread|body|section|box|s?wrap\w*)s?|adsby\w+|ad(?:box|block|slot|unit|wrap\w*|space|zone|label|container|sense)s?|cookie\w+|(?:left|right)(?:bar|col|column|rail|side)|col-(?:left|right)|side(?:col|column|nav|menu))(?:$|[\s_-])",
    re.I,
)
#: Where a name in camel case has its next word.
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Words that turn a mark into a statement about the page (has-sidebar, no-ads).
STATES = re.compile(r"(?:has|have|with|without|no|not|is|show|hide)[_-]", re.I)
#: Marks of others' texts, which may outweigh the article.
OTHERS = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|trending|comments?|comment(?:list|area|form|thread|body|section|box|s?wrap\w*)s?|disqus|reply|replies|respond)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, with quotes.  Possessive: what is scanned once is never scanned again.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
MARKED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACES = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: What lists and tables are made of: the nearest one decides what a new element closes.
STRUCTURE = frozenset(REPEATS).union(*REPEATS.values(), "ul ol menu dl table tbody thead tfoot select".split())
#: Lists of links whose blocks are shorter than this on average are menus.
MENU_CHARS = 40


class Node:
    __slots__ = ("name", "parent", "children", "score", "chars", "link_chars", "blocks", "skip", "mark", "near", "serial")

    def __init__(self, name: str, parent: Node | None, skip: bool, mark: str = ""):
        self.name, self.parent, self.children, self.skip = name, parent, [], skip
        self.mark, self.serial = mark, 0
        self.near = self if name in STRUCTURE else parent.near if parent is not None else None
        self.score = 0.0
        self.chars = self.link_chars = self.blocks = 0
        if parent is not None:
            parent.children.append(self)


def _boilerplate(name: str, attributes: str) -> tuple[bool, str]:
    """(dropped for sure, the marking words of class and id if any)."""
    if name in SKIP:
        return True, ""
    if name in ("body", "html", "article", "main") or not attributes.strip():
        return False, ""
    mark = ""
    for key, value in MARKED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words = " ".join(CAMEL.sub("-", w) for w in value.split() if not STATES.match(CAMEL.sub("-", w)))
            if UNLIKELY.search(words):
                mark = f"{mark} {words}"
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, ""
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
    return False, mark


def scan(html: str):
    """(name, closing, attributes) of each tag and (None, False, text) of what lies between.

    Comments, declarations and the content of raw elements are passed over.
    Linear in the page, however broken: a tag's quotes are followed until they
    fail once (they never close), from then on a tag ends at the next ">"; and a
    "<" after the last ">" is text.
    """
    pos, n, last, quotes = 0, len(html), html.rfind(">"), True
    raw_end: dict[str, re.Pattern] = {}
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            yield None, False, html[pos:at]
        if at == n:
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            pos = end + 3 if end >= 0 else n
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            pos = end + 1 if end >= 0 else n
            continue
        m = NAME.match(html, at + 1) if at < last else None
        if m is None:
            yield None, False, "<"
            pos = at + 1
            continue
        rest = REST.match(html, m.end()) if quotes else None
        quotes = rest is not None
        pos = rest.end() if rest else html.find(">", m.end()) + 1
        name, attributes = m[2].lower(), html[m.end() : pos - 1]
        if name in RAW and not m[1]:
            if not attributes.rstrip().endswith("/"):
                if name not in raw_end:
                    raw_end[name] = re.compile(rf"</{re.escape(name)}\s*>", re.I)
                end = raw_end[name].search(html, pos)
                pos = end.end() if end else n
            continue
        yield name, bool(m[1]), attributes


def parse(html: str, broken: frozenset[int] = frozenset()) -> tuple[Node, set[int], list[Node]]:
    """The page as containers with text blocks (strings with link share) in page order.

    Also the numbers of those dropped elements that nothing closes before the body
    ends, and the elements of `broken` numbers, which are read like any other.
    """
    root = node = Node("#root", None, False)
    dropped, unclosed, read = 0, set(), []
    text: list[str] = []
    linked = 0
    links = 0  # open <a>

    def flush() -> None:
        nonlocal linked
        if text:
            block = SPACES.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if block and not node.skip:
                node.children.append((block, min(linked, len(block))))
            linked = 0

    opened: Counter[str] = Counter()

    def close_to(at: Node) -> Node:
        """Close every open element below `at`."""
        below = node
        while below is not at:
            opened[below.name] -= 1
            below = below.parent
        return at

    for name, closing, rest in scan(html):
        if name is None:
            if not node.skip:
                text.append(rest)
                linked += len(rest) if links else 0
            continue
        if name == "br":
            text.append("\n")
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        flush()
        if closing:
            if opened[name]:
                at = node
                while at.name != name:
                    if at.serial and name in ("body", "html"):
                        unclosed.add(at.serial)
                    at = at.parent
                node = close_to(at.parent)
                links = 0 if name in CONTAINERS else links
            continue
        if name in ENDS_P and node.name == "p":
            node = close_to(node.parent)
        if name in REPEATS:
            while node.near is not None and node.near.name in REPEATS[name]:
                node = close_to(node.near.parent)
        if name in VOID:
            continue
        skip, mark = (False, "") if name == "header" and opened["article"] else _boilerplate(name, rest)
        dropped += skip
        kept = skip and dropped in broken
        node = Node(name, node, node.skip or skip and not kept, mark)
        if kept:
            read.append(node)
        elif skip:
            node.serial = dropped
        opened[name] += 1
    flush()
    while node is not None:
        if node.serial:
            unclosed.add(node.serial)
        node = node.parent
    return root, unclosed, read


def _points(block: str) -> int:
    return 1 + block.count(",") + block.count("，") + min(len(block) // 100, 3)


def _drop_marked(root: Node) -> None:
    """Drop marked elements; without an unmarked article those stay that hold the article or most of the points."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.skip)
    if not any(x.mark for x in order):
        return
    # Per element: points in all but others' texts, points outside marks, and the same for articles.
    held = {}
    for node in reversed(order):
        every = bare = 0.0
        texts = any(isinstance(c, tuple) for c in node.children)
        article = bare_article = False
        for c in node.children:
            if isinstance(c, tuple):
                block, linked = c
                if len(block) >= 25 and node.name not in HEADINGS:
                    points = _points(block) * (1 - linked / len(block))
                    every, bare = every + points, bare + points
            elif not c.skip:
                e, b, a, ba, t = held[id(c)]
                texts |= t
                if not OTHERS.search(c.mark):
                    every, article = every + e, article or a
                if not c.mark:
                    bare, bare_article = bare + b, bare_article or ba
        own = node.name in ("article", "main") and texts
        held[id(node)] = every, bare, article or own, bare_article or own, texts
    _, outside, _, found, _ = held[id(root)]
    stack = [root]
    while stack:
        node = stack.pop()
        if node.mark:
            every, bare, article, bare_article, _ = held[id(node)]
            if found or OTHERS.search(node.mark) or not (article or every > outside):
                node.skip = True
                continue
            outside, found = outside + bare, found or bare_article
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip)


def _score(root: Node) -> list[Node]:
    """Points for every container, from its blocks and those below; children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.skip)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, tuple):
                block, linked = c
                node.chars += len(block)
                node.blocks += 1
                node.link_chars += linked
                if len(block) >= 25 and node.name not in HEADINGS:
                    points = _points(block)
                    at, share = node, 1.0
                    if at.name not in CONTAINERS and at.parent is not None:
                        at = at.parent
                    for level in range(4):
                        at.score += points * share
                        share = 0.5 if level == 0 else share / 2
                        at = at.parent
                        if at is None:
                            break
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.blocks += node.blocks
    return order


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _blocks(node: Node, out: list[str]) -> None:
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            out.append(at[0])
        elif not at.skip and not (at.name in ("ul", "ol", "table", "dl") and _density(at) > 0.6 and at.chars < MENU_CHARS * at.blocks):
            stack.extend(reversed(at.children))


def _substance(root: Node) -> tuple[float, bool]:
    """(points of the blocks, whether an article or main has text) below an element."""
    points, article, stack = 0.0, False, [root]
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, Node):
                stack += [] if c.skip else [c]
            else:
                at = node
                points += _points(c[0]) * (1 - c[1] / len(c[0])) if len(c[0]) >= 25 else 0.0
                while not article and at is not None and at is not root:
                    article, at = at.name in ("article", "main"), at.parent
    return points, article


def tree(html: str) -> Node:
    """The page without what is dropped for sure.

    A menu, header or the like that is never closed would swallow all that
    follows, so it is read like any other element if it holds the article, or
    most of the page's points.
    """
    root, unclosed, _ = parse(html)
    if unclosed:
        root, _, read = parse(html, frozenset(unclosed))
        every = _substance(root)[0]
        for node in read:
            points, article = _substance(node)
            node.skip = not (article or 2 * points > every)
    return root


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order joined by a blank line."""
    if not html:
        return ""
    root = tree(html)
    _drop_marked(root)
    return _best_text(root) or _best_text(tree(html))


#: Elements of running text.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl blockquote pre figure table section address details".split())
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)


def _goes_along(part) -> bool:
    """Whether a part beside the main text belongs to it: running text with few links, no line of rights."""
    if not isinstance(part, Node) or part.skip or part.name not in TEXT or not part.chars or _density(part) >= 0.25:
        return False
    lines: list[str] = []
    _blocks(part, lines)
    return bool(lines) and not RIGHTS.match(lines[0])


def _best_text(root: Node) -> str:
    order = _score(root)
    best, top = root, 0.0
    for node in order:
        if node.name in CONTAINERS or node is root:
            value = node.score * (1 - _density(node))
            if node.name in ("article", "main"):
                value *= 1.25
            if value > top:
                best, top = node, value
    if top == 0.0:  # only short blocks: an article or main element, else the whole body
        best = next((x for x in order if x.name in ("article", "main") and x.chars), root)
    # All of the article (the outermost one) or else the main element that it lies in.
    at, whole = best, None
    while at is not None:
        if at.name == "article" or at.name == "main" and whole is None:
            whole = at
        at = at.parent
    best = whole or best
    keep = [best]
    if best.parent is not None:
        bar = max(10.0, top * 0.2)
        beside, kept = best.parent.children, []
        for i, c in enumerate(beside):
            if c is best:
                kept.append(i)
            elif isinstance(c, Node) and not c.skip:
                long_text = c.name in ("p", "blockquote", "pre") and c.chars > 80 and _density(c) < 0.25
                if c.score * (1 - _density(c)) >= bar or long_text or c.name in ("article", "main") and c.name == best.name and c.chars:
                    kept.append(i)
        first, last = (kept[0], kept[-1]) if whole is None else (0, -1)
        if whole is None:  # headings, lists and short blocks go with the text that they stand next to
            while first > 0 and _goes_along(beside[first - 1]):
                first -= 1
            while last + 1 < len(beside) and _goes_along(beside[last + 1]):
                last += 1
        some = set(kept) | {i for i in range(first, last + 1) if _goes_along(beside[i])}
        keep = [c for i, c in enumerate(beside) if i in some]
    out: list[str] = []
    for c in keep:
        _blocks(c, out)
    return "\n\n".join(out)


def extract_main_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add text (never null) and n_chars (its code points) to each row.

    Null and empty pages, and pages without main text, give an empty text.
    Columns named text or n_chars are replaced; all others are kept, whatever
    they hold.  A map-only job; an empty table gives an empty result.
    """

    def texts(batches):
        for pages in batches:
            yield pa.array([main_text(h) for h in pages.to_pylist()], pa.string())

    udf = arrow_udf(df.sparkSession, texts, "string")
    (html,) = fresh(df, "html")
    kept = drop_clashing(df.withColumn(html, F.col(html_col)), ["text", "n_chars"])
    return kept.withColumn("text", udf(F.col(html))).withColumn("n_chars", F.length("text").cast("long")).drop(html)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
