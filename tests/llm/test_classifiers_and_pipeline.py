"""The classifiers on held-out rows, and the pipeline against plain versions of its stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from gridloom.llm import pieces, quality_classifier, quality_rules, recompression, simhash, toxicity
from gridloom.llm.queries import MODEL_FILE, QUERIES

from .test_text_operators import DOCS, corpus, plain_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def toxic_rows(n=1500, seed=8):
    r = random.Random(seed)
    vocab = [a + b + c for a in ("th", "er", "on", "an", "st") for b in ("a", "e", "i", "o") for c in ("nd", "ng", "re", "ti", "sh", "lo")]
    stems = ["grumf", "snark"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        bad = i % 7 == 0
        if bad:
            for _ in range(r.randrange(2, 5)):
                words.insert(r.randrange(len(words)), r.choice([r.choice(stems) + r.choice(vocab), "idiot", "st0pid you", "LOSER!!"]))
        junk = i % 5 == 1
        if junk:
            words = [w + r.choice(["%%%", "&&&"]) for w in words] if i % 2 else [w for w in words for _ in range(12)]
        docs.append((i, " ".join(words), "en", "s", 1))
        if i % 4:
            labels.append((i, None if i % 50 == 0 else int(not junk), int(bad)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "you idiot", "en", "s", 0), (n + 2, "퟿ 🎉 " + "long" * 30_000, "en", "s", 0), docs[3], docs[3]]
    labels += [(None, 1, 1), labels[0], (n + 1, 0, 0), (10**9, 1, 1)]
    return docs, labels


@pytest.mark.parametrize(("run", "column", "modulus", "held", "cut"), [(toxicity.toxicity, 2, 5, 0, 0.5), (quality_classifier.quality, 1, 4, 2, 0.7)])
def test_held_out_rows(spark, run, column, modulus, held, cut):
    docs, labels = toxic_rows()
    d, lab = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = run(d, lab).collect()
    assert len(got) == len(docs)
    truth = {x[0]: x[column] for x in labels}
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["held_out"] and truth.get(r["doc_id"]) is not None and (r["doc_id"] or 10**6) < 1500:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]]
    assert total > 100 and right / total > 0.95
    assert sorted(map(str, run(d.repartition(7), lab).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_classifier.quality])
def test_held_out_labels_are_not_read(spark, run):
    docs, labels = toxic_rows(400)
    modulus, held = {toxicity.toxicity: (5, 0), quality_classifier.quality: (4, 2)}[run]
    other = [(i, q, t) if i is None or zlib.crc32(str(i).encode()) % modulus != held else (i, 1 - (q or 0), 1 - t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (sorted(map(str, run(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_classifier.quality])
def test_nothing_to_learn_from(spark, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1), (2, None, None, None, None)], DOCS)
    assert len(run(docs, none).collect()) == 2
    assert run(docs.limit(0), none).collect() == []
    assert len(run(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect()) == 2


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    at, share = toxicity.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and 0 < share[0] and share[-1] < 1


def test_long_text_scores_as_its_words_do():
    sample = [(b"good words here " * 5, 1), (b"bad%% words%% here%% " * 5, 0)] * 30
    m = quality_classifier.Embeddings(sample)
    r = quality_classifier.Reader(m, cache=2)
    assert abs(r.score(b"good words here " * 50_000) - r.score(b"good words here " * 50)) < 1e-3
    assert r.score(None) == r.score(b" \n")


def test_pipeline_equals_its_stages_done_plainly(spark, tmp_path):
    rows = [x for x in corpus(11, 120) if x[0] is not None]
    seen, docs = set(), []
    for x in rows:
        if x[0] not in seen:
            seen.add(x[0])
            docs.append(x)
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    judged = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(docs, DOCS)).collect()}
    left = [x for x in docs if judged[x[0]]]
    left = [x for x, (i, _, c) in zip(left, plain_components(left)) if i == c]
    cut = {i: n for i, _, n, _ in recompression.brute_force([(a, b) for a, b, *_ in left])}
    first: dict = {}
    texts = {}
    for i, t, *_ in sorted(left):
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if first.setdefault(g, (i, p)) != (i, p):
                gone.update(range(p, p + 20))
        texts[i] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t
        assert len(gone) == cut[i]
    # what the mix takes of each document is held to its own test; here, that it takes of these texts alone, in token form
    decode = pieces.Decoder(pieces.Model(open(MODEL_FILE, "rb").read())).decode
    assert out
    for r in out:
        words, own = decode(r["ids"]).split(), texts[r["doc_id"]].encode().split()
        assert words == own[: len(words)] and words and r["n_ids"] == len(r["ids"])
    total = sum(len((t or "").encode().split()) for t in texts.values())
    assert abs(sum(len(decode(r["ids"]).split()) for r in out) - total) <= 3


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == DOCS.names and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_stages_keep_clashing_columns(spark):
    schema = T.StructType([*DOCS.fields, *(T.StructField(n, T.StringType()) for n in ("n_words", "kept_text", "taken", "ids", "target"))])
    rows = [(i, " ".join(f"u{i}k{j}" for j in range(40)), "en", "s", 9, "a", "b", "c", "d", "e") for i in range(6)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(rows, schema), "")
        assert out.columns == schema.names and {tuple(r)[5:] for r in out.collect()} == {("a", "b", "c", "d", "e")}


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_simhash_of_the_stage_is_the_query_s(spark):
    rows = [(i, "One two three four  five six seven\neight nine ten " * 8 if i == 3 else "one two three four five six seven eight nine ten " * 8, "en", "s", 1) for i in range(5)]
    assert len(simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == 1


def test_word_features_one_by_one():
    words = ["a", "né", "𝒳y", "abcdefgh", "<>", "a", "z" * 90]
    at, found = quality_classifier.features([w.encode() for w in words])
    grams = [[g for n in (3, 4, 5) for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n))] for w in words]
    assert np.bincount(at).tolist() == [1 + len(g) for g in grams]
    for k, w in enumerate(words):  # a word's features are the same in any company, and equal grams get equal features
        _, alone = quality_classifier.features([w.encode()])
        assert found[at == k].tolist() == alone.tolist()
        assert len(set(alone[1:].tolist())) == len(set(grams[k]))
    ids, times = quality_classifier.text_features("né né a".encode())
    assert times.sum() == 2 * 4 + 2 + 4 and times[ids == quality_classifier.SAME].tolist() == [4]


def test_reader_forgets_but_scores_alike():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)).encode() for _ in range(40)] + [b"", None, b"q" * 300, b"q" * 300]
    model = quality_classifier.Embeddings([(t, k % 2) for k, t in enumerate(texts[:40])])
    small, large = quality_classifier.Reader(model, 5), quality_classifier.Reader(model)
    assert [small.score(t) for t in texts] == [large.score(t) for t in texts]
    assert max(map(len, large.cache)) <= 64
