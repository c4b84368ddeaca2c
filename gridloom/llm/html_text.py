"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks
before and after it, whether it is a heading, and what its surroundings are called (menus, headers, footers, ... by
element, or by the words of class and id). A small tree, trained once by Gini gain on a labelled table in this module,
says which blocks are the article's. Half of the table's pages call nothing by a name, so that words and links
decide there; names only add to them where a page has any.

What surrounds a block counts in full (aside = 1) if it is an element such as ``nav``, is hidden, or has a name whose
words all say so, or whose last or first word does (``cookie-notice``, ``site-footer``, ``ad-slot``); blocks in it are not the
article's. A name that only holds such a word (``has-sidebar``, ``content-sidebar-wrap``, ``legal-news``) counts half: a long
block with few links is kept there; beside a name of the article (``content legal-news``) it doesn't count. ``main``
ends all that is said around it but that it is hidden; around an ``article`` a full name counts half and a half one not
at all, while elements such as ``aside`` go on to count.

Defined results: a null or empty html has an empty text; script, style and other unseen elements are no text, closed or
not; a tag that is never closed is text, and so is what follows it; character references are decoded once; white space
(any Unicode white space) inside a block becomes one space; blocks are joined by a newline, in page order; equal rows get
equal texts; no text is cut, whatever its length; the tree alone decides on a block, whether or not others of the page
stand in ``article`` or ``main``; other columns are passed on. A page is read once from left to right, in time in proportion
to its length, however deep its elements and whatever it leaves open.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import schema_with, ship, with_columns

ship(__name__)

# Names of HTML elements.
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "option", "button", "canvas", "audio", "video", "map", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
#: Words of class, id or role that name what is not the article.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus topnav subnav breadcrumb breadcrumbs header masthead topbar footer foot colophon "
    "sidebar sidebars side aside widget widgets related recommended share sharing social follow subscribe subscription newsletter signup login cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist discussion disqus replies respond reply form search pagination pager tags toolbar copyright legal disclaimer paywall complementary contentinfo".split()
)
#: Such words that name a subject as often as a place; only as a name's last word do they count in full.
TOPICS = set("legal copyright disclaimer tags side form search social follow share sharing notice notices alert respond reply replies login signup discussion header consent banner banners promotion toolbar".split())
#: Words that make a name one of the page's layout, whatever else it holds.
LAYOUT_WORDS = set("has with without no wrap wrapper layout page container grid outer row".split())
MAIN = {"article", "main"}
MAIN_WORDS = set("article content main post story entry body text".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}

OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
TAG_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD_PART = re.compile(r"[A-Za-z]+")
#: Inline elements that go on after a paragraph that ends inside them, each at most so often.
CARRIED, CARRIED_TIMES = {"b", "i", "em", "strong", "u", "a", "span", "font", "small", "big", "s", "tt", "code"}, 3
CLOSES_P = BLOCK - {"html", "body"}

FEATURES = ("words", "link_density", "before_words", "before_links", "after_words", "after_links", "aside", "main", "heading")
#: Pages as rows of blocks: kind and number of words; n an item of a menu (a link), o a menu's item that is no link, c other
#: text beside the article (adverts, notices, footers), h a heading and p a paragraph of the article, l one that is a link,
#: k a paragraph with links in it. Made up for this module, not taken from any page.
PAGES = (
    "n1 n1 n1 n2 c7 h9 p110 p45 p3 p70 p22 c9", "n1 n1 n1 c12 h6 p60 p8 p95 p2 c13", "n2 n1 n1 n1 h12 p30 p1 p140 k40 p18 c6", "n1 n1 c4 h4 p250 p28 h3 p66 p5 c15",
    "n1 n3 n1 c9 h8 p16 p90 p12 p33 n1 n2 n1 c5", "h7 p80 p4 p55 k25 p120 c8 n1 n1", "n1 n1 n1 n1 h5 p400 c11", "p70 p6 p45 p90", "p25", "p7", "p200", "p2", "p1", "p3 p5", "h5 p60 p30", "n1 n1 o2 n1 c10 h7 p35 l4 p52 p77 c7",
    "n2 n2 n1 c3 h3 p20 p2 p2 p64 n4 n5 n6 c10", "n1 n1 n1 c14 h10 p5 p85 k60 p9 p40 c4", "n1 n1 n1 c5 h11 p14 p58 c12", "n1 n1 n1 c8 p130 p1 p38 c10", "n1 n1 h2 p49 p11 c3 c9 n1 n1 n2", "n1 n2 n1 c11 h5 p28 c8",
    "n1 n1 n1 n1 c6 h14 p300 p3 p150 p7 p21 c14", "n1 n1 n1 n1 c13 h3 p42 p26 p19 c2", "n1 n1 n1 c10 h13 p8 p31 p75 c10", "n1 n1 c2 h6 p2 p105 p48 p4 c5", "n1 n1 c9 h10 p17 p6 c7", "n1 n1 n1 c6 h8 p9 c11", "n1 n1 n1 c7 h4 p3 c8", "n1 n1 n2 p45 p21", "n1 n1 n1 p130 p8 p60 n1 n1 n1", "n2 n3 p24 p90 n1 n4 n2",
)


def page_rows(page: str, names: int = 0) -> list:
    """Rows (FEATURES, then 1 for a block of the article) of a page's blocks; names: what is beside the article is named so."""
    blocks = [(x[0], int(x[1:])) for x in page.split()]
    seen = [(words, {"n": 1.0, "l": 1.0, "k": 0.3}.get(kind, 0.0)) for kind, words in blocks]
    rows = []
    for i, (kind, _) in enumerate(blocks):
        before, after = seen[i - 1] if i else (0, 0.0), seen[i + 1] if i + 1 < len(seen) else (0, 0.0)
        article = int(kind in "hplk")
        rows.append((*seen[i], *before, *after, names * (1 - article), names * article, int(kind == "h"), article))
    return rows


#: The labelled table.
LABELLED = (
    *(r for page in PAGES for names in (0, 1) for r in page_rows(page, names)),
    # blocks inside the article, of any length beside any neighbour: text is kept, a link alone among links isn't
    *((w, d, b, 0.0, a, 0.0, 0, 1, h, 1) for w in (1, 4, 15, 60, 250) for d in (0.0, 0.3, 1.0) for b in (0, 3, 90) for a in (0, 3, 90) for h in (0, 1) if not (h and w > 15)),
    *((w, d, b, x, a, 1.0 - x, 0, 1, 0, 1) for w in (2, 20, 100) for d in (0.0, 0.3) for b in (1, 30) for a in (1, 30) for x in (0.0, 1.0)),
    *((w, 1.0, b, 1.0, a, 1.0, 0, 1, 0, 0) for w in (1, 3, 7) for b in (1, 4) for a in (1, 4)),
    # blocks of what is named as something else: none is kept
    *((w, d, b, x, a, x, 1, m, h, 0) for w in (1, 4, 15, 40, 60, 250) for d in (0.0, 0.3, 1.0) for b in (0, 3, 90) for a in (0, 3, 90) for x in (0.0, 1.0) for m in (0, 1) for h in (0, 1)),
    # blocks of what has such a word in its name: long ones with few links are kept, and shorter ones between long ones
    *((w, d, b, 0.0, a, 0.0, 0.5, m, 0, int(d == 0.0 and (w >= 40 or w >= 15 and b + a >= 90))) for w in (1, 4, 15, 40, 60, 250) for d in (0.0, 0.6) for b in (0, 3, 30, 90) for a in (0, 3, 30, 90) for m in (0, 1)),
    *((w, 1.0, b, 1.0, a, 1.0, 0.5, m, 0, 0) for w in (1, 3, 40) for b in (1, 4) for a in (1, 4) for m in (0, 1)),
)


def grow(rows: np.ndarray, depth: int = 14):
    """A tree by Gini gain: a class, or (feature, threshold, at most, above)."""
    y = rows[:, -1]
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            a, b = y[low], y[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return int(share >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def _named(name: str) -> float:
    """What a name (one word of class, id or role) says: 1 something beside the article, 0.5 that it may be, or 0."""
    parts = [w.lower() for w in WORD_PART.findall(name)]
    if ASIDE_WORDS.isdisjoint(parts):
        return 0.0
    if not LAYOUT_WORDS.isdisjoint(parts):
        return 0.5
    return 1.0 if parts[-1] in ASIDE_WORDS or parts[0] in ASIDE_WORDS - TOPICS else 0.5


def _setting(tag: str, attributes: str) -> tuple[int, float, int]:
    """What an element is by itself (2 hidden, 1 beside the article, or 0), what its names say, and whether it is named as the article."""
    kind, aside, main = int(tag in ASIDE - {"form", "fieldset"}), float(tag in ("form", "fieldset")), int(tag in MAIN)
    if not attributes or attributes.isspace() or tag in ("body", "html"):
        return kind, aside, main
    names: list = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names += value.split()
        elif name == "hidden" and value.lower() not in ("false", "until-found") or name == "aria-hidden" and value.lower() == "true":
            kind = 2
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            kind = 2
    said = {n: _named(n) for n in names}
    if any(v == 0 and not MAIN_WORDS.isdisjoint(w.lower() for w in WORD_PART.findall(n)) for n, v in said.items()):
        main = 1
        said = {n: v for n, v in said.items() if v != 0.5}
    if tag not in MAIN:
        aside = max([aside, *said.values()])
    return kind, aside, int(main and aside < 1)


class Stack:
    """Open elements. What is said around a place is kept for each depth, and where each tag stands, so that no step
    goes through the stack. An element that ends out of turn leaves a gap."""

    def __init__(self):
        self.items: list = []  # (tag, main, unseen) or None
        self.around = [(0.0, 0.0, False)]  # aside as seen from here, the same from inside an article, hidden
        self.places: dict = {}
        self.blocks: list = []
        self.main = self.unseen = self.links = self.headings = 0

    def push(self, tag: str, kind: int, aside: float, main: int) -> None:
        plain, inside, hidden = self.around[-1]
        hidden = hidden or kind == 2
        own, less = (1.0, 1.0) if kind else (aside, max(0.0, aside - 0.5))
        if tag != "main":
            outer = inside if tag == "article" else plain
            own, less = max(own, outer), max(less, outer if tag == "article" else inside)
        self.around.append((1.0, 1.0, True) if hidden else (own, less, False))
        at, unseen = len(self.items), int(tag in UNSEEN)
        self.items.append((tag, kind, aside, main, unseen))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        self._count((tag, kind, aside, main, unseen), 1)

    def _count(self, item: tuple, by: int) -> None:
        tag, _, _, main, unseen = item
        self.main += by * main
        self.unseen += by * unseen
        self.links += by * (tag == "a")
        self.headings += by * (tag in HEADING)

    def last(self, tag: str) -> int:
        """Where the innermost open element of this name is, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def block_after(self, at: int) -> bool:
        return bool(self.blocks) and self.blocks[-1] > at

    def top(self) -> str | None:
        return self.items[-1][0] if self.items and self.items[-1] else None

    def leave(self, at: int) -> list:
        """End all elements from at on; gives those that may go on after a paragraph."""
        carried: list = []
        while len(self.items) > at:
            item = self.items.pop()
            self.around.pop()
            if item:
                self.places[item[0]].pop()
                if item[0] in BLOCK:
                    self.blocks.pop()
                self._count(item, -1)
                if item[0] in CARRIED and sum(x[0] == item[0] for x in carried) < CARRIED_TIMES:
                    carried.append(item)
        return carried[::-1]

    def end_alone(self, at: int) -> None:
        item = self.items[at]
        self.places[item[0]].pop()
        self._count(item, -1)
        self.items[at] = None


def blocks(page: str) -> list:
    """[(text, words, link density, aside, main, heading)] in page order; aside may be 0.5."""
    out: list = []
    texts: list = []  # (text, in a link)
    stack = Stack()
    last_close = page.rfind(">")
    strict = True  # quotes hold a tag open; ends for good when one is never closed

    def flush():
        if not texts:
            return
        words = "".join(t for t, _ in texts).split()
        if words:
            linked = sum(len(t.split()) for t, a in texts if a)
            out.append((" ".join(words), len(words), min(1.0, linked / len(words)), stack.around[-1][0], int(stack.main > 0), int(stack.headings > 0)))
        texts.clear()

    def tag_end(pos):
        nonlocal strict
        while strict:
            m = TAG_STOP.search(page, pos)
            if m and m[0] == ">":
                return m.start()
            if not m:
                strict = False
            elif _after_equals(page, m.start()):
                pos = page.find(m[0], m.end()) + 1
                strict = pos > 0
            else:
                pos = m.end()
        return -1

    at, text_from, end = 0, 0, len(page)
    while at < end:
        m = OPENING.search(page, at)
        if not m:
            break
        start, what = m.start(), m[0]
        comment = what in ("<!--", "<![CDATA[", "<!", "<?")
        if not comment and start > last_close:  # a tag that is never closed
            at = m.end()
            continue
        if start > text_from and not stack.unseen:
            texts.append((html.unescape(page[text_from:start]), stack.links > 0))
        if comment:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(what, ">")
            stop = page.find(close, m.end())
            if what == "<![CDATA[" and not stack.unseen:
                texts.append((page[m.end() : stop if stop >= 0 else end], stack.links > 0))
            at = text_from = stop + len(close) if stop >= 0 else end
            continue
        name = TAG_NAME.match(page, start)
        tag, closing = name[1].lower(), what[1] == "/"
        stop = tag_end(name.end())
        if stop < 0:
            stop = page.find(">", name.end())
        attributes = page[name.end() : stop]
        at = text_from = stop + 1
        if tag in BLOCK:
            flush()
        elif tag in ("br", "img", "input", "option") and not stack.unseen:
            texts.append((" ", False))
        if closing:
            n = stack.last(tag)
            if n >= 0:
                if tag in BLOCK or tag in UNSEEN or not stack.block_after(n):
                    stack.leave(n)
                else:  # an inline element that was left open across blocks ends alone
                    stack.end_alone(n)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        n = stack.last("p")
        if tag in CLOSES_P and n >= 0:  # a paragraph ends where the next block begins
            if not stack.block_after(n):
                for t, kind, aside, main, _ in stack.leave(n):
                    if t in CARRIED:
                        stack.push(t, kind, aside, main)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack.top() == tag:
            stack.leave(len(stack.items) - 1)
        if tag == "body" and stack.unseen:
            stack.leave(0)  # a head that was never closed
        stack.push(tag, *_setting(tag, attributes))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = text_from = close.start() if close else end
    if text_from < end and not stack.unseen:
        texts.append((html.unescape(page[text_from:]), stack.links > 0))
    flush()
    return out


def _after_equals(page: str, at: int) -> bool:
    """Whether the quote at this place opens a value: an equals sign, and white space at most, comes before it."""
    at -= 1
    while at >= 0 and page[at].isspace():
        at -= 1
    return at >= 0 and page[at] == "="


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    out = []
    for i, (text, words, links, aside, main, heading) in enumerate(found):
        before, after = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        row = (words, links, before[1] if before else 0, before[2] if before else 0.0, after[1] if after else 0, after[2] if after else 0.0, aside, main, heading)
        if decide(tree, row):
            out.append(text)
    return "\n".join(out)


def trained_tree():
    return grow(np.array(LABELLED, float))


def _extract(tree):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(p, tree) for p in part.column(part.schema.names.index("html")).to_pylist()]
                yield with_columns(part, ("html",), text=pa.array(texts, pa.string()))

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """pages without html, and text."""
    return pages.mapInArrow(_extract(trained_tree()), schema_with(pages, ("html",), text=T.StringType()))
