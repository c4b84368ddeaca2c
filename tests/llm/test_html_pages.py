"""HTML extraction against a plain reading of pages, on pages that name nothing, and on hostile markup."""

import re
import time
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from gridloom.llm import html_text

PAGES = Path("/root/testdata/sf0.01/pages.parquet")


class Plain(HTMLParser):
    """Blocks of a page by the standard library's parser: every block tag ends the text before it."""

    def __init__(self):
        super().__init__()
        self.found, self.parts, self.open = [], [], []

    def cut(self):
        words = "".join(t for t, _ in self.parts).split()
        if words:
            self.found.append((" ".join(words), len(words), sum(len(t.split()) for t, a in self.parts if a) / len(words)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.cut()
        if tag == "br":
            self.parts.append((" ", False))
        elif tag not in html_text.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.cut()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag)]

    def handle_data(self, data):
        if not any(t in html_text.UNSEEN for t in self.open):
            self.parts.append((data, "a" in self.open))


@pytest.fixture(scope="module")
def pages():
    if not PAGES.exists():
        pytest.skip("no pages")
    return [p for p in pq.read_table(PAGES, columns=["html"])["html"].to_pylist() if p]


def test_blocks_equal_a_plain_reading(pages):
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert [(t, n, round(d, 9)) for t, n, d, *_ in html_text.blocks(page)] == [(t, n, round(d, 9)) for t, n, d in plain.found]


def unnamed(page):
    """The page with every element that says what it is made a div."""
    page = re.sub(r"</?(article|nav|footer|ul|li|main|header|aside)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", page)
    return re.sub(r"(<div)[^>]*>", r"\1>", page)


def test_pages_that_name_nothing(pages):
    """Words and links alone find nearly all that names find."""
    tree = html_text.trained_tree()
    kept = missed = extra = 0
    for page in pages:
        named, plain = (html_text.main_text(p, tree).split("\n") for p in (page, unnamed(page)))
        kept += len(named)
        missed += len(set(named) - set(plain))
        extra += len(set(plain) - set(named))
    assert kept > 1500 and missed <= 0.03 * kept and extra <= 0.02 * kept


ITEM, TEXT = "<div><a href=x>Item</a></div>", "Words of a paragraph that belongs to the text and goes on for a while, as such paragraphs do, until it ends."
HAND_MADE = [
    (f"<div>{ITEM * 4}<div>Buy it now</div><h1>A title of it</h1><p>{TEXT}</p><p>{TEXT} {TEXT}</p><p>{TEXT}</p><div>All rights kept</div></div>", ["A title of it", TEXT, f"{TEXT} {TEXT}", TEXT]),
    (f"{ITEM * 3}<table><tr><td>{TEXT} {TEXT}</td></tr><tr><td>{TEXT}</td></tr></table>{ITEM * 5}", [f"{TEXT} {TEXT}", TEXT]),
    (f"<div>{TEXT}<br>{TEXT}</div><div>{ITEM * 6}</div>", [f"{TEXT} {TEXT}"]),
    (f"<p>{TEXT}</p><p>Short one.</p><p>{TEXT} {TEXT} {TEXT}</p>", [TEXT, "Short one.", " ".join([TEXT] * 3)]),
    (f"<article><p>{TEXT}</p><p><a href=x>A sentence that is wholly a link.</a></p><p>{TEXT}</p></article>", [TEXT, "A sentence that is wholly a link.", TEXT]),
    ('<article class="overflow-hidden"><p>A few words here.</p></article>', ["A few words here."]),
    ('<p title="a hidden gem">Some words</p>', ["Some words"]),
    ('<div class="content legal-news"><p>Words of a short text.</p></div>', ["Words of a short text."]),
    ("<article><p>Let <math><mi>x</mi> + y</math> be.</p></article>", ["Let x + y be."]),
    ("<article><p title=don't>It's said that this isn't so.</p><p>But it's true, isn't it, as they say.</p></article>", ["It's said that this isn't so.", "But it's true, isn't it, as they say."]),
    ('<article><p>One <a href="x>two</a> three.</p></article>', ["One two three."]),
    ('<article hidden><p>Not seen by any reader.</p></article><article aria-hidden="false"><p>Seen by all of the readers.</p></article>', ["Seen by all of the readers."]),
    ("<article><p>Text of it.</p></article><div class='ad-slot'>Buy this</div><div id=comment-12><p>I like it</p></div>", ["Text of it."]),
]


@pytest.mark.parametrize(("page", "want"), HAND_MADE)
def test_hand_made_pages(page, want):
    assert html_text.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>", html_text.trained_tree()).split("\n") == want


HOSTILE = {"unclosed tags": "<a ", "nested": "<b>x", "open quotes": '<a href="x ', "quotes in text": '<a "> " ', "odd quotes": "<a =\">' =\" ", "deep blocks": "<div>x ", "carried": "<p><b>x", "ends": "</p><b>", "signs": "<", "raw": "<script>", "raw ends": "</script ", "comments": "<!--", "names": '<p class="ad', "references": "&#x", "lists": "<ul><li>"}


@pytest.mark.parametrize("what", HOSTILE)
def test_time_grows_with_the_page_alone(what):
    tree, unit = html_text.trained_tree(), HOSTILE[what]
    took = []
    for size in (250_000, 1_000_000):
        start = time.perf_counter()
        html_text.main_text(unit * (size // len(unit)), tree)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 2 and took[1] < 20


def test_open_markup_loses_no_text():
    tree = html_text.trained_tree()
    words = " ".join(f"word{i}" for i in range(3000))
    assert html_text.main_text(f"<article>{'<b>' * 5000}{words}", tree).split() == words.split()
    assert html_text.main_text(f"<article><p>{words} <a x", tree).split()[:3000] == words.split()
    assert html_text.main_text("<div>" * 5000 + f"<p>{words}", tree).split() == words.split()
