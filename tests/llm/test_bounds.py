"""Cases at the edges of the operators' bounds: large numbers, equal rows, long texts, small samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, mixing, quality_classifier, toxicity, topk

from .test_table_operators import VECTORS, plain_topk, plain_targets


def test_large_components_are_exact(spark):
    rows = [(i, v, "", "") for i, v in enumerate([[1.0], [8388608.0], [33554432.0], [-33554432.0], [3e13], [0.0], [2.0**40 + 2.0**17]])]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, 6).collect()
    assert sorted(map(tuple, got)) == plain_topk(rows, 50, 6)
    mixed = [(0, [3e30, 1.0], "", ""), (1, [0.0, 5.0], "", ""), (2, [0.0, -7.0], "", "")]  # great components whose products are 0
    got = topk.top_k(spark.createDataFrame(mixed, VECTORS), F.col("vec_id") == 0, 5).collect()
    assert sorted(map(tuple, got)) == plain_topk(mixed, 50, 5)


def test_a_score_that_is_no_long_is_an_error():
    one, own = np.array([[2.0**40]]), np.zeros((1, 1), bool)
    with pytest.raises(OverflowError):
        topk.scored(one, one, own, 0)
    assert topk.scored(one, one, ~own, -5).tolist() == [[-5]]
    assert topk.scored(np.array([[2.0**40, -(2.0**40)]]), np.array([[2.0**40, 2.0**40]]), own, 0).tolist() == [[0]]


def test_equal_rows_share_what_they_take_to_the_word(spark):
    rows = [(1, "a b c d e f g h i j k l m", "s", "x")] * 4 + [(2, "q " * 11, "t", "y")] + [(1, "a b c d e f g h i j k l m", "t", "z")] * 2 + [(None, "n n", None, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __place string").repartition(3)
    taken = mixing.mix_sources(docs).collect()
    out = mixing.mixed_documents(docs).collect()
    want: dict = {}
    for r in taken:
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    got: dict = {}
    for r in out:
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + len(r["text"].split())
    assert got == {k: v for k, v in want.items() if v}
    # what each of them takes is what the mix said, as a list of its whole and part epochs
    pieces = sorted(len(r["text"].split()) for r in out if r["doc_id"] == 1 and r["source"] == "s")
    expected = sorted(x for r in taken if r["doc_id"] == 1 and r["source"] == "s" for x in [13] * (r["taken"] // 13) + [r["taken"] % 13] * (r["taken"] % 13 > 0))
    assert pieces == expected
    sizes = {"s": 52, "t": 37, None: 6}
    for s, target in plain_targets(sizes).items():
        assert abs(sum(v for (_, x), v in got.items() if x == s) - target) <= 0.5


def test_numbering_is_dense_in_hot_groups(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id").repartition(7)
    got = mixing.numbered(rows, ["g"]).collect()
    for g in (True, False):
        mine = sorted(r["__place"] for r in got if r["g"] == g)
        assert mine == list(range(len(mine)))
    assert sorted(r["id"] for r in got) == list(range(1000))


def test_mixing_cuts_a_very_long_text(spark):
    docs = spark.createDataFrame([(0, "w " * 400_000, "a"), (1, "v " * 100_000, "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_documents(docs).collect()
    for i in (0, 1):
        assert sum(len(r["text"].split()) for r in out if r["doc_id"] == i) == got[i]


def test_hot_keys_join_as_others_do(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 700).alias("k"), "id")
    right = common.materialize(left.groupBy(F.col("k").alias("kk")).agg(F.count("*").alias("n"), F.max("id").alias("top")).where("kk is null or kk % 2 = 0"))
    got = sorted((r["id"], r["top"]) for r in common.join_skewed(left, right, {"k": "kk"}, "n", 9000).collect())
    top: dict = {}
    keys = {r["id"]: r["k"] for r in left.collect()}
    for i, k in keys.items():
        if k is None or k % 2 == 0:
            top[k] = max(top.get(k, -1), i)
    assert [i for i, _ in got] == list(range(9000)) and all(t == top.get(keys[i]) for i, t in got)


def test_the_sample_skips_what_does_not_fit(spark):
    docs = [(i, f"word{i} " * 20) for i in range(300)] + [(10_000 + i, "long " * 4000) for i in range(4)]
    labels = [(i, i % 2, i % 2) for i, _ in docs] + [(50_000 + i, 1, 1) for i in range(1000)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every = common.sampled_texts(d, lab, "toxic", (5, 0), 10**6, 10**9)
    fits = common.sampled_texts(d, lab, "toxic", (5, 0), 10**6, 19_999)
    assert sum(len(t) > 1000 for t, _ in every) >= 1
    short = [x for x in every if len(x[0]) < 1000]
    assert fits[:100] == short[:100] and sum(len(t) for t, _ in fits) <= 19_999
    some = common.sampled_texts(d, lab, "toxic", (5, 0), 50, 10**9)  # labels without a document take no places
    assert some == every[:50]


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_classifier.quality])
def test_one_long_text_does_not_empty_the_sample(spark, run):
    docs = [(i, ("you idiot %% " if i % 2 else "kind words here ") * 5) for i in range(120)] + [(500 + i, "x" * 17_000_000) for i in range(1)]
    labels = [(i, 1 - i % 2, i % 2) for i, _ in docs]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    right = [r["predicted"] == (r["doc_id"] % 2 if run is toxicity.toxicity else 1 - r["doc_id"] % 2) for r in got if r["doc_id"] < 200]
    assert sum(right) / len(right) > 0.95


def test_only_a_local_master_may_use_a_folder_of_its_own(spark):
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://elsewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Far)


def test_null_ids_keep_their_own_spans(spark):
    """Texts that 32 bits can't tell apart: each row without an id loses its own words alone."""
    from gridloom.llm import recompression

    passage = " ".join(f"p{i}" for i in range(22))
    rows = [(1, passage)] + [(None, f"{passage} {' '.join(f't{i}x{j}' for j in range(i % 7))}".strip()) for i in range(400)] + [(None, " ".join(f"u{i}v{j}" for j in range(24))) for i in range(200)] + [(None, None), (None, "")]
    got = recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) s").collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(recompression.brute_force(rows), key=key)


@pytest.mark.parametrize("settle", [9, 3_000_000])
def test_words_decide_where_fingerprints_collide(spark, monkeypatch, settle):
    """With three names for all words, nearly every window has another's fingerprint; the words still tell them apart."""
    from gridloom.llm import recompression

    from .test_text_operators import corpus

    monkeypatch.setattr(recompression, "_names", lambda words: np.fromiter((len(w) % 3 + 1 for w in words), np.uint64, len(words)))
    monkeypatch.setattr(recompression, "SETTLE_WINDOWS", settle)
    rows = [(i, t) for i, t, *_ in corpus(21, 60) if i is not None]
    got = recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) s").collect()
    assert sorted(map(tuple, got)) == sorted(recompression.brute_force(rows))


def test_only_windows_of_shared_symbols_are_sent(spark):
    """The first round tells rows of symbols that stand in two places; texts that share nothing send no window."""
    from gridloom.llm import recompression

    passage = [f"p{i}" for i in range(40)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(300)] + (passage if k < 2 else []))) for k in range(8)]
    docs = spark.createDataFrame(rows, "__row long, text string")
    asked = docs.select("text", "__row").mapInArrow(recompression._ask(20, 8), "__b int, __m binary")
    told = asked.repartition(3, "__b").mapInArrow(recompression._tell, "__row long, __sym long").collect()
    assert {r["__row"] for r in told} == {0, 1}
    names = recompression._names([w.encode() for w in passage])
    flat = np.concatenate([[np.uint64(0)], names, [np.uint64(0)]])
    symbols, _ = recompression.window_symbols(flat, np.arange(1, 22), 20)
    assert {r["__sym"] for r in told} >= set(symbols[1:-1].view(np.int64).tolist()[2:-2])


def test_every_window_has_a_symbol_of_the_rounds():
    """Windows without a symbol of the last round are keyed by one of the first, and runs of one word by the run."""
    from gridloom.llm import recompression

    rng = np.random.default_rng(8)
    words = np.concatenate([[0], rng.integers(1, 2**62, 4000), [0]]).astype(np.uint64)
    at = np.arange(1, 3982)
    key, place = recompression.window_symbols(words, at, 20)
    known = set()
    for rounds in (recompression.ROUNDS, 1):
        s = recompression.recompress(words, rounds)
        known |= {(int(n), int(p)) for n, p in zip(s["name"], s["start"])}
    assert all((int(k), int(p)) in known and a <= p < a + 20 for k, p, a in zip(key, place, at))
    run = np.concatenate([[0], np.full(50, 7), [0]]).astype(np.uint64)
    assert len(set(recompression.window_keys(run, np.arange(1, 32), 20)[0].tolist())) == 1


def test_very_long_and_very_common_urls(spark):
    from gridloom.llm import url_filter

    from .test_table_operators import RULES, plain_rule

    long = ["https://www.example.com/en/" + "a/" * 200_000, "https://" + "s." * 3000 + "net/fr/x?" + "q" * 100_000, "x" * 300_000]
    urls = long + [None] * 400 + ["http://hot.org/"] * 300 + ["http://a.net/es/"] * 300 + [f"http://h{i}.com/{i}" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {i: plain_rule(u, RULES) for i, u in enumerate(urls)}


@pytest.mark.parametrize("at_once", [2, 50_000])
def test_targets_of_many_sources(spark, monkeypatch, at_once):
    """Sources in ranges of a few get the targets that all of them together get."""
    monkeypatch.setattr(mixing, "SOURCES_AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    sizes = {f"s{i}é"[: 2 + i % 3]: int(rng.choice([0, 1, 7, 7, 300, 9000])) for i in range(40)} | {None: 12, "": 5, "𝒳": 7, "￿": 7}
    rows = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, docs long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.targets(common.materialize(rows)).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
