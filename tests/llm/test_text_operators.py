"""Operators on documents against plain versions: hashes, words and windows are computed one by one here."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from gridloom.llm import quality_rules, recompression, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def corpus(seed=1, n=160):
    """Copies, near copies, shared passages, runs, ties, nulls, empty and long texts, repeated rows and ids."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ÀB", "the", "of", "a b", "𝒳"]
    passage = " ".join(r.choice(vocab) for _ in range(47))
    texts = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 19, 20, 21, 40, 90, 200]))]
        kind = i % 8
        if kind == 1 and texts:
            texts.append(r.choice(texts))
            continue
        if kind == 2:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if kind == 3:
            words += [r.choice(vocab)] * r.choice([5, 30, 70])
        if kind == 4 and texts:
            words = (r.choice(texts) or "").split()
            if words:
                words[r.randrange(len(words))] = r.choice(vocab).upper()
        if kind == 5:
            words = words[:15] * 4
        texts.append(r.choice([" ", "\n", " \t", "  "]).join(words) if i % 3 else " ".join(words))
    texts += [None, "", " \n\t ", passage, passage, "x " * 500, "z" * 20000, "\x1c \x85   q"]
    rows = [(k, t, ["en", None, "de"][k % 3], ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, passage, "en", "a", 1), (None, texts[5], "en", "a", 1), rows[9], rows[9], (12, "another text of the same id " + passage, "en", "a", 1)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def test_recompression_matches_word_windows(spark, rows):
    got = recompression.dedup_substrings(frame(spark, rows)).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) s").collect()
    want = recompression.brute_force([(a, b) for a, b, *_ in rows])
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("window", [3, 8, 20, 33])
def test_recompression_any_window(spark, window):
    rows = [(i, t) for i, t, *_ in corpus(window, 90) if i is not None]
    got = recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) s").collect()
    assert sorted(map(tuple, got)) == sorted(recompression.brute_force(rows, window))


def test_settling_in_steps_gives_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(recompression, "SETTLE_WINDOWS", 7)
    monkeypatch.setattr(recompression, "BATCH_WORDS", 150)
    monkeypatch.setattr(recompression, "PIECE_WORDS", 60)
    test_recompression_matches_word_windows(spark, rows)


def test_settling_holds_one_window_of_each(monkeypatch):
    most, later = 0, recompression._later

    def watched(identity, key, pos):
        nonlocal most
        most = max(most, len(key))
        return later(identity, key, pos)

    monkeypatch.setattr(recompression, "SETTLE_WINDOWS", 50)
    words = np.array([0, *range(1, 31), 0], np.uint64)
    at = np.arange(1, 12)
    sym, whole = recompression.window_keys(words, at, 20)
    one = lambda doc: recompression._pack(1, np.full(11, doc), np.full(11, 3), at - 1, np.ones(11, np.int64), sym, whole)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 300, pa.int32()), pa.array([one(d) for d in reversed(range(300))], pa.binary())], names=["__b", "__m"])
    monkeypatch.setattr(recompression, "_later", watched)
    out = pa.Table.from_batches(recompression._settle([batch])).to_pydict()
    assert sorted(out["__k"]) == list(range(1, 300)) and set(out["__r"]) == {11}
    assert most <= 11 + 50 + 11


def test_symbols_inside_a_window_depend_on_it_alone():
    """A symbol whose extent lies in a window is found at the same place wherever the window stands."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        core = rng.integers(1, 6, 30).astype(np.uint64)
        seen = []
        for _ in range(2):
            pre, post = (rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
            words = np.concatenate([[0], pre, core, post, [0]]).astype(np.uint64)
            s, at = recompression.recompress(words), 1 + len(pre)
            inside = (s["left"] >= at) & (s["right"] <= at + 30)
            seen.append({(int(n), int(a - at), int(b - at)) for n, a, b in zip(s["name"][inside], s["start"][inside], s["end"][inside])})
        assert seen[0] == seen[1]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                least[root(a)] = root(b)
    ids: dict = {}
    for a, row in enumerate(rows):
        if row[0] is not None:
            ids[root(a)] = min(ids.get(root(a), row[0]), row[0])
    return [(row[0], fps[a] - (1 << 64) if fps[a] >> 63 else fps[a], ids.get(root(a))) for a, row in enumerate(rows)]


@pytest.mark.parametrize("limit", [simhash.SHARD_LIMIT, 7])
def test_simhash_components(spark, rows, limit, monkeypatch):
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda v, r: real(v, r, limit))
    got = [tuple(x) for x in simhash.near_duplicates(frame(spark, rows)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_bands_miss_no_pair(spark, blocks, monkeypatch):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    values = np.unique(np.concatenate([base, *[base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 60)).astype(np.uint64)) for k in (1, 2, 3, 4)]]))
    n = {4: 10, 5: 2**16 * 300, 6: 2**27 * 300}[blocks]
    assert len(simhash.band_masks(n, 3)) == {4: 4, 5: 10, 6: 20}[blocks]
    monkeypatch.setattr(simhash, "band_masks", lambda _, r, f=simhash.band_masks: f(n, r))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "__fp long")
    edges = simhash.links(df).collect()
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    want = simhash.least_labels(len(values), a, b)
    got = simhash.least_labels(len(values), np.array([at[e["src"]] for e in edges]), np.array([at[e["dst"]] for e in edges]))
    assert np.array_equal(want, got)


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**10, 900, dtype=np.uint64) * np.uint64(0x40100401004001))
    tree = simhash.BKTree(values)
    assert any(isinstance(n, tuple) for n in tree.nodes)
    q, t = tree.within(values, 3)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    assert sorted(zip(q.tolist(), t.tolist())) == sorted(zip(a.tolist(), b.tolist()))


def test_long_text_is_taken_in_chunks():
    text = " ".join(f"t{i % 977}" for i in range(40_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_near_dedup_keeps_one_of_each_component(spark, rows):
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    comp = {}
    for i, f, c in plain_components(rows):
        comp.setdefault(c, []).append(i)
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted(c for c in comp if c is not None)
    assert len(set(ids)) == len(ids)


def plain_measures(text):
    words = WORD.findall(text or "")
    grams: dict = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark, rows):
    rows = [*rows, (9001, "one two three four five six seven %% && ||\nsame line\nsame line\n same line", "en", "a", 3)]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    want = sorted((str(a), *plain_measures(t)) for a, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_sketches_merge_by_addition(spark, rows):
    measured = quality_rules.measure(frame(spark, rows), keep_text=False)
    whole = quality_rules.thresholds(quality_rules.sketches(measured)).collect()
    parts = [quality_rules.sketches(measured.where(f"pmod(hash(doc_id), 3) = {k}")) for k in range(3)]
    from pyspark.sql import functions as F

    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, quality_rules.thresholds(merged).collect())) == sorted(map(str, whole))


def test_rejects_stand_out_in_their_group(spark):
    clean = [(i, " ".join(f"a{(i * 7 + j) % 400}" for j in range(80)), "en", "s", 1) for i in range(60)]
    junk = [(100, " ".join(f"b{j}%%%" for j in range(80)), "en", "s", 1), (101, "same words on a line\n" * 1 + "\n".join(f"q{j}\nagain" for j in range(40)), "en", "s", 1)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(60)) and not got[100] and not got[101]
    assert sorted(r["doc_id"] for r in quality_rules.keep_quality(frame(spark, clean + junk)).collect()) == list(range(60))


@pytest.mark.parametrize("ratio", ["symbols", "dup_lines_of_lines", "repeats_below_base"])
def test_each_stage_ratio_alone_rejects(spark, ratio):
    clean = [(i, "\n".join(" ".join(f"a{(i * 7 + 12 * k + j) % 900}" for j in range(12)) for k in range(20)), "en", "s", 1) for i in range(60)]
    unique = [" ".join(f"u{k}x{j}" for j in range(12)) for k in range(20)]
    junk = {
        "symbols": "\n".join(unique).replace("x", "%x"),
        "dup_lines_of_lines": "\n".join(f"{line}\nread more about it" for line in unique),
        "repeats_below_base": "\n".join(f"{line} five words said ten times" if k < 10 else line for k, line in enumerate(unique)),
    }[ratio]
    docs = frame(spark, [*clean, (100, junk, "en", "s", 1)])
    judged = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(docs).collect()}
    assert judged[100] == (False, ratio != "symbols")
    assert sorted(r["doc_id"] for r in quality_rules.keep_quality(docs, quality_rules.STAGE_RATIOS).collect()) == list(range(60))
    others = {n: x for n, x in quality_rules.STAGE_RATIOS.items() if n != ratio}
    assert quality_rules.keep_quality(docs, others).count() == 61


@pytest.mark.parametrize("run", [recompression.dedup_substrings, simhash.near_duplicates, simhash.drop_near_duplicates, quality_rules.quality_rules, quality_rules.keep_quality])
def test_empty_table_and_clashing_columns(spark, run):
    assert run(spark.createDataFrame([], DOCS)).collect() == []
    names = ["kept_text", "n_words", "kept", "base_failed", "component_id", "bucket", "ratio", "comp", "node"]
    schema = T.StructType([*DOCS.fields, *(T.StructField(n, T.StringType()) for n in names)])
    rows = [(1, "some words here and there again", "en", "s", 4, *names), (2, None, None, None, None, *[None] * len(names)), (None, "", "", "", 0, *names)]
    assert len(run(spark.createDataFrame(rows, schema)).collect()) >= 0


def test_filters_leave_columns_as_they_were(spark):
    schema = T.StructType([*DOCS.fields, T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType())])
    rows = [(i, " ".join(f"v{i}x{j}" for j in range(30)), "en", "s", 9, "mine", "own") for i in range(5)]
    for stage in (quality_rules.keep_quality, simhash.drop_near_duplicates):
        out = stage(spark.createDataFrame(rows, schema))
        assert out.columns == schema.names and sorted(map(tuple, out.collect())) == rows
