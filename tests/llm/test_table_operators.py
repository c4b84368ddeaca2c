"""Search, URL, mixing, page and token operators against plain versions."""

import math
import random
import re
import struct
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import html_text, mixing, pieces, topk, url_filter

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def plain_topk(rows, every, k):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        qv = min(v for i, v in fine if i == q)
        best = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_own_rows_take_no_candidate_s_place(spark):
    rows = [(0, [1.0, 2.0], "", "")] * 3 + [(i, [float(i), 1.0], "", "") for i in (1, 2, 3)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS).coalesce(1), F.col("vec_id") == 0, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_topk(rows, 50, 5)
    assert len(got) == 3


@pytest.mark.parametrize("block", [4096, 3])
def test_topk(spark, block):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, -0.01, 0.0, 0.0, 0.25, 0.3]) for _ in range(6)], "s", "r") for i in range(120)]
    rows += [(200, None, "", ""), (205, [0.1, None], "", ""), (210, [float("nan")], "", ""), (215, [float("inf"), 1.0], "", ""), (None, [1.0], "", ""), (220, [], "", ""), (225, [0.5, 0.5], "", ""), rows[10], (15, [0.9] * 9, "", "")]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 5 == 0, 5, block).collect()
    assert sorted(map(tuple, got)) == plain_topk(rows, 5, 5)


def test_topk_with_few_or_no_rows(spark):
    for rows in ([], [(1, [1.0], "", "")], [(0, [1.0], "", "")], [(0, [1.0], "", ""), (3, [-2.0], "", "")]):
        got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, 5).collect()
        assert sorted(map(tuple, got)) == plain_topk(rows, 5, 5)


def plain_rule(url, rules, otherwise="allow"):
    if url is None or "://" not in url:
        return "", "", None, otherwise
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return (host, path, *(max(fits)[2:] if fits else (None, otherwise)))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.b", "", "block")]
URLS = [
    None, "", "x", "http://", "://", "https://Example.COM/en/1", "https://www.example.com/en/1?x#y", "http://blog.www.example.com/en/", "ftp://com/", "http://com", "http://xcom/", "https://a.net/es/1", "https://a.net/ES/1", "https://net/fr/",
    "http://a.b", "http://q.a.b?z", "http://aXb/", "http://é.net/fr/ü", "http://ÀB.NET/fr/", "a://b://c.net/fr/", "http://h.example.com:80/en/x", "http://u@example.com/en/", "http://example.com/en", "http://a..com/", "http://.com/", "x\ny://a.net/fr/z\nw",
]


def test_url_filter(spark):
    rows = [(i, u, "h", "own") for i, u in enumerate(URLS * 2)] + [(None, URLS[5], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    listed = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", None, "block"), ("org", "/", None)], "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, listed).collect()
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(map(str, ((i, *plain_rule(u, RULES)) for i, u, *_ in rows)))
    none = url_filter.filter_urls(pages, listed.limit(0)).collect()
    assert len(none) == len(rows) and {r["verdict"] for r in none} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed).collect() == []


def test_bloom_passes_every_listed_key_and_few_others(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("__key"))
    blocks = 4000 * url_filter.BITS_PER_ENTRY // 256
    table = url_filter.bloom(keys, blocks)
    asked = spark.range(24000).select(F.concat(F.lit("k"), "id").alias("__key"), "id").withColumn("__block", url_filter.block_of(F.col("__key"), blocks)).join(table, "__block")
    for i, bits in enumerate(url_filter.lane_bits(F.col("__key"))):
        asked = asked.where(F.col(f"__w{i}").bitwiseAND(bits) == bits)
    hits = [r["id"] for r in asked.select("id").collect()]
    assert sum(i < 4000 for i in hits) == 4000 and sum(i >= 4000 for i in hits) < 600


def plain_targets(sizes):
    """Water-filling by rounds. sizes: {source: words}."""
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, free = {}, set(sizes)
    total = float(sum(sizes.values()))
    while True:
        left = total - sum(target[s] for s in sizes if s not in free)
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if w else {}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over


def mix_rows(seed, n=400):
    r = random.Random(seed)
    names = ["s%d" % k for k in range(9)] + [None, "", "é", "𝒳", "\uffff"]
    hot = r.choice(names)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 200])), hot if i % 3 == 0 else r.choice(names), "own") for i in range(n)]
    return rows + [(None, "a b c", "s1", "own"), (None, "a b c", "s1", "own"), (3, None, "s2", "own"), (7, "x y", None, None), rows[5], rows[5]]


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    monkeypatch.setattr(mixing, "COARSE", 3)
    rows = mix_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len((t or "").split())
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    assert sorted((str(i), size(t), sizes[s], round(want[s], 6)) for i, t, s, _ in rows) == sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in got)
    taken: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    sources: dict = {}
    for s in sizes:
        sources.setdefault((sizes[s], round(want[s], 6)), []).append(round(want[s]))
    for k, v in sources.items():
        assert abs(sum(taken[k]) - sum(v)) <= len(v)
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # the documents of the mix hold the words that it takes
    out = mixing.mixed_documents(docs).collect()
    assert out == [] or set(out[0].asDict()) == {"doc_id", "text", "source", "size"}
    assert abs(sum(size(r["text"]) for r in out) - sum(r["taken"] for r in got)) <= 8
    one = {i: t for i, t, *_ in rows if i not in (None, 3, 5, 7)}
    by_doc = {r["doc_id"]: r["taken"] for r in got}
    held: dict = {}
    for r in out:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + size(r["text"])
    assert all(held.get(i, 0) == by_doc[i] for i in one)


def test_mixing_follows_the_key_order(spark):
    """One source: all that comes before the cut in key order is taken whole."""
    rows = [(i, "w " * (1 + i % 7), s, "") for s, lo in (("a", 0), ("b", 300)) for i in range(lo, lo + 300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size string")).collect()
    for lo in (0, 300):
        mine = sorted((r for r in got if lo <= r["doc_id"] < lo + 300), key=lambda r: (r["__key"], r["doc_id"]))
        budget = round(mine[0]["target"])
        epochs, rest = divmod(budget, mine[0]["source_size"])
        for r in mine:
            cut = min(r["size"], rest)
            assert r["taken"] == epochs * r["size"] + cut
            rest -= cut


def test_mixing_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).collect() == []
    assert mixing.mixed_documents(spark.createDataFrame([], schema)).collect() == []
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}


PAGES = [
    (None, ""), ("", ""), ("plain words only here and some more", "plain words only here and some more"),
    ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li>More</li></ul></nav><!-- no <p>x</p> --><div class="ad">Buy this now please</div>'
     '<article><h1>Title of it</h1><p><b>First  part\n of &lt;text&gt; &amp;amp; more.<br><p>Second &eacute;&#233;&#xe9; one.</p><p>Short.</p></article><footer>&copy; me &middot; words words words</footer>', "Title of it\nFirst part of <text> &amp; more.\nSecond ééé one.\nShort."),
    ('<body><header><h1>Site</h1></header><main><p>The main part has a number of words in it.</p><aside><p>Related reading that is not the text of this page</p></aside><form><label>Your mail address please</label><input value="x"></form>'
     '<p>It goes on after <a href="x">one link</a> here.</p><section class="comments"><p>A reader says that this is a very good page indeed.</p></section></main><script>if (a < b) { "<p>no</p>" }</script></body>', "The main part has a number of words in it.\nIt goes on after one link here."),
    ('<div class="cookie-notice">We use cookies to make this site better for you and for us, you know.</div><div id="content"><p>Words of a text that has no article element around it.</p><p>And a second paragraph with enough words in it.</p></div>'
     '<div class="sidebar"><p>Some side words that go on for a while and yet are not the text.</p></div>', "Words of a text that has no article element around it.\nAnd a second paragraph with enough words in it."),
    ("<article><p>never closed <script>x", "never closed"), ("<article><p>a<!-- open comment <p>b", "a"), ("<p>1 < 2 and 3 > 2 is what the article says here, in full</p>", "1 < 2 and 3 > 2 is what the article says here, in full"),
]


def test_html_text(spark):
    rows = [(i, "u", h, "own") for i, (h, _) in enumerate(PAGES)] * 2
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(2 * [(i, t) for i, (_, t) in enumerate(PAGES)])
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.parametrize("beside", ['<footer><div class="text">(c) me</div></footer>', "<aside><article><p>A teaser of something else</p></article></aside>"])
def test_html_text_beside_a_rejected_main(beside):
    text = " ".join(["words of a long article"] * 12)
    assert html_text.main_text(f"<body><div id=wrap><p>{text}</p></div>{beside}</body>", html_text.trained_tree()) == text


LONG = "<p>" + " ".join(["words of a long article"] * 12) + "</p><p>" + " ".join(["and of its second part"] * 9) + "</p>"


@pytest.mark.parametrize(("start", "rest", "kept"), [
    ('<div class="content-sidebar-wrap"><main>', "</main></div>", True), ('<div class="sidebar"><main>', "</main></div>", True), ('<div class="layout has-sidebar">', "</div>", True),
    ('<div class="page tags-news">', "</div>", True), ('<div class="layout has-sidebar"><article>', "</article></div>", True), ('<form id="form1"><article>', "</article></form>", True),
    ('<div class="sidebar">', "</div>", False), ("<aside><article>", "</article></aside>", False), ('<div style="display:none"><main>', "</main></div>", False), ('<main><section class="comments">', "</section></main>", False),
])
def test_html_text_in_what_is_named_for_its_layout(start, rest, kept):
    text = html_text.main_text(f"<body>{start}{LONG}{rest}</body>", html_text.trained_tree())
    assert len(text.split()) == (105 if kept else 0)


def test_tree_keeps_nothing_of_what_is_beside_the_article():
    tree = html_text.trained_tree()
    sizes = (0, 1, 2, 3, 7, 10, 14, 20, 25, 40, 60, 100, 250, 2000)
    assert not any(html_text.decide(tree, (w, d, b, x, a, x, 1, m, h)) for w in sizes[1:] for d in (0.0, 0.2, 0.5, 1.0) for b in sizes for a in sizes for x in (0.0, 1.0) for m in (0, 1) for h in (0, 1))


def test_html_teasers_in_a_layout_are_not_text():
    page = f'<body><div class="layout has-sidebar">{LONG}<ul><li><a href="x">Home</a></li><li><a href="y">More of it</a></li></ul></div><div class="related"><article><p>A short teaser.</p></article></div></body>'
    assert len(html_text.main_text(page, html_text.trained_tree()).split()) == 105


def test_html_keeps_long_articles_whole():
    words = [f"word{i}" for i in range(30_000)]
    page = "<body><nav><a>x</a></nav><article>" + "".join(f"<p>{' '.join(words[i : i + 50])}</p>" for i in range(0, 30_000, 50)) + "</article></body>"
    assert html_text.main_text(page, html_text.trained_tree()).split() == words


@given(st.text("<>/ap!-&;\"'= \n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_html_survives_anything(page):
    assert html_text.main_text(page, html_text.trained_tree()) is not None


def test_tree_fits_its_table():
    rows = np.array(html_text.LABELLED, float)
    tree = html_text.trained_tree()
    assert all(html_text.decide(tree, r) == r[-1] for r in rows)


@pytest.fixture(scope="module")
def model():
    if not MODEL.exists():
        pytest.skip("no model file")
    return MODEL.read_bytes()


def as_unigram(data):
    """A unigram model of the same pieces, with made-up scores of a usual size."""

    def varint(n):
        out = b""
        while True:
            out, n = out + bytes([(n & 127) | (128 if n > 127 else 0)]), n >> 7
            if not n:
                return out

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value

    m = pieces.Model(data)
    out = b""
    for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
        score = -4 - (i * 7919 % 30011) / 3001 + len(p) if k == pieces.NORMAL else 0.0
        out += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(k))
    rest = b"".join(field(n, v) for n, v in pieces._fields(data) if n in (2, 3))
    return out + rest + field(2, bytes([3 << 3, 1]))


TEXTS = ["", " ", "a", "  two  spaces ", "The quick brown fox.\nNew line\t\ttabs", "éàü 日本語 🎉🎉 \x00\x7f", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "supercalifragilisticexpialidocious " * 3, "1234567890 3.14159", "        indented    code()", "\n\n\n", "▁▁x"]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_encoding_equals_the_library(model, kind):
    sentencepiece = pytest.importorskip("sentencepiece")
    data = model if kind == "bpe" else as_unigram(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    m = pieces.Model(data)
    encoder = pieces.Encoder(m)
    r = random.Random(4)
    words = ["the", "of", "tion", "ing", "Error", "hello", "ción", "éa", "zz", "…", "日", "\n", "==", "  "]
    texts = TEXTS + [r.choice(["", " "]).join(r.choice(words) for _ in range(r.randrange(30))) for _ in range(300)] + ["".join(r.choice("abeinorst ") for _ in range(r.randrange(60))) for _ in range(400)]
    wrong = [t for t in texts if np.frombuffer(encoder.encode(t), np.int32).tolist() != sp.encode(t)]
    if kind == "unigram":  # paths of equal score, up to single precision, may differ
        cost = lambda ids: sum(m.scores[i] for i in ids)
        assert len(wrong) < 20
        wrong = [t for t in wrong if abs(cost(np.frombuffer(encoder.encode(t), np.int32)) - cost(sp.encode(t))) > 1e-3]
    assert wrong == []


def test_a_stream_equals_one_search_and_holds_a_window(model):
    m = pieces.Model(model)
    r = random.Random(6)
    text = "".join(r.choice("abeinorstlu") for _ in range(9000))
    whole = [m.ids[p] for p in m.merged(text[:400])]
    s = pieces.Stream(m, 64)
    assert s.feed(text[:400]) + s.finish() == whole
    out, most = [], 0
    for at in range(0, len(text), 37):
        out += s.feed(text[at : at + 37])
        most = max(most, len(s.text))
    out += s.finish()
    one = pieces.Stream(m, 10**9)
    assert out == one.feed(text) + one.finish() and "".join(m.pieces[i] for i in out) == text
    assert most < 64 + 37 + 8 * m.longest


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_round_trip(text):
    if not MODEL.exists() or "▁" in text:
        return
    m = cached_model()
    ids = np.frombuffer(pieces.Encoder(m).encode(text), np.int32).tolist()
    assert pieces.Decoder(m).decode(ids).decode() == text


def cached_model(held=[]):  # noqa: B006
    if not held:
        held.append(pieces.Model(MODEL.read_bytes()))
    return held[0]


def test_encode_and_decode_tables(spark, model):
    rows = [(i, t, "own") for i, t in enumerate(t for t in [*TEXTS[:-1], None])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, str(MODEL)), str(MODEL)).collect()
    assert sorted((r["doc_id"], str(r["decoded"])) for r in out) == sorted((i, str(t)) for i, t, _ in rows)
    assert {r["ids"] is None for r in out if r["text"] is None} == {True}
    assert pieces.encode(df.limit(0), str(MODEL)).collect() == []


def test_unread_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(bytes([2 << 3 | 2, 2, 3 << 3, 4]))
