"""Features, trees, calibration and gradient descent against versions that do them one number at a time."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import quality_classifier as quality
from gridloom.llm import toxicity


def sample(seed, n=60):
    r = random.Random(seed)
    vocab = ["the", "cat", "né", "WORD", "x!", "idiot", "st0pid", "you", "soooo", "a.b", "𝒳", "LOSER!!", "f*ck", "don't", "—", "12", "z" * 70]
    return [(" ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 7, 40]))).encode(), r.randrange(2)) for _ in range(n)] + [(b"", 0), (b" \n ", 1)]


def plain_toxic_features(text, words, stems):
    """Every feature by its definition, word by word."""
    raw = [w for w in re.split("[\x20\x09-\x0d]+", text.decode()) if w]
    if not raw:
        return [0.0] * len(toxicity.FEATURES)
    n = len(raw)
    low = [toxicity.plain(w) for w in raw]
    fixed, word = [w in toxicity.INSULTS for w in low], [w in words for w in low]
    stem = [any(len(w) >= k and w[:k] in stems for k in toxicity.STEMS) for w in low]
    you = [w in toxicity.SECOND for w in low]
    hit = [a or b or c for a, b, c in zip(fixed, word, stem)]
    near = sum(h and any(you[max(0, i - 4) : i + 5]) for i, h in enumerate(hit))
    core = [w.strip(toxicity.EDGE) for w in raw]
    shout = sum(len(c) > 2 and c.isupper() for c in core)
    odd = sum(not c.isalpha() and bool(toxicity.INNER.search(c)) for c in core)
    stretch = sum(bool(toxicity.STRETCH.search(w)) for w in low)
    letters = max(1, len(text) - n)
    per = 100 / n
    return [
        per * sum(fixed), per * sum(word), per * sum(stem), per * sum(hit), min(20, sum(hit)), per * near, per * sum(you),
        sum(65 <= b <= 90 for b in text) / letters, per * shout, per * text.count(b"!"), sum(b in b".,;:!?" for b in text) / letters, per * odd, per * stretch, math.log1p(n),
    ]


def test_toxic_features_equal_plain_ones():
    words, stems = {"cat"}, {"lose", "idio"}
    for cache in (2, 200_000):
        reader = toxicity.Reader(words, stems, cache)
        for text, _ in sample(1) + sample(2):
            assert np.allclose(reader.features(text), plain_toxic_features(text, words, stems))


def test_a_very_long_text_has_the_densities_of_its_parts():
    reader = toxicity.Reader({"cat"}, set())
    one, many = reader.features(b"you cat IDIOT ok. " * 50), reader.features(b"you cat IDIOT ok. " * 200_000)
    assert np.allclose(one[[0, 1, 2, 3, 6, 8]], many[[0, 1, 2, 3, 6, 8]]) and np.isfinite(many).all()


@pytest.mark.parametrize("seed", range(4))
def test_a_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    binned, grad, hess = rng.integers(0, 6, (80, 4)), rng.normal(size=80), rng.uniform(0.05, 0.25, 80)
    trees = toxicity.Trees(least=5)
    rows = np.flatnonzero(rng.random(80) < 0.8)

    def gain(f, cut):
        low = rows[binned[rows, f] <= cut]
        high = rows[binned[rows, f] > cut]
        if min(len(low), len(high)) < 5:
            return 0.0
        return sum(grad[x].sum() ** 2 / (hess[x].sum() + 1) for x in (low, high)) - grad[rows].sum() ** 2 / (hess[rows].sum() + 1)

    best = max(gain(f, c) for f in range(4) for c in range(6))
    assert math.isclose(gain(*trees._split(binned, grad, hess, rows)), best, rel_tol=1e-9)


def test_trees_score_as_a_walk_through_each():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (200, 3)).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 2] > 2)).astype(float)
    trees = toxicity.Trees(rounds=12).fit(x, y)
    for row, got in zip(x[:50], trees.raw(x[:50])):
        total = trees.base
        for tree, value in trees.trees:
            node = 0
            for level in tree:
                f, cut = level[node] if node < len(level) else (0, math.inf)
                node = 2 * node + (row[f] > cut)
            total += value[node]
        assert math.isclose(total, got, rel_tol=1e-9)
    assert ((trees.raw(x) > 0) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_equals_the_min_max_formula(seed):
    rng = np.random.default_rng(seed)
    score = rng.permutation(40).astype(float)
    y = (rng.random(40) < 0.3 + score / 100).astype(float)
    at, share = toxicity.isotonic(score, y)
    ordered = y[np.argsort(score)]
    plain = [max(min(ordered[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    blocks = [[plain[0], 1]]
    for v in plain[1:]:
        if math.isclose(v, blocks[-1][0]):
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1])
    assert np.allclose(share, np.maximum.accumulate([(v * n + 0.5) / (n + 1) for v, n in blocks])) and len(at) == len(blocks)


def plain_quality_features(text):
    """{feature: how often}: words, character n-grams, bigrams and repeats, one by one."""
    found: dict = {}

    def add(key, by=1.0):
        found[key] = found.get(key, 0.0) + by

    words = text.split()
    for w in words:
        for f in quality.features([w])[1].tolist():
            add(f)
    for a, b in zip(words, words[1:]):
        add(int(quality.pairs(quality.word_keys([a, b]))[0]))
        if a == b:
            add(quality.SAME, 4.0)
    return found


def test_quality_features_equal_plain_ones():
    for text, _ in sample(3):
        ids, times = quality.all_features(text)
        assert dict(zip(ids.tolist(), times.tolist())) == plain_quality_features(text)
    two = quality.pairs(quality.word_keys([b"a", b"b", b"a", b"a", b"b"]))
    assert two[0] == two[3] != two[1] and (two > quality.SAME).all() and (two <= quality.SAME + quality.PAIRS).all()


def test_gradient_descent_equals_loops(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 2)
    rows = [(t, y) for t, y in sample(4, 12)]
    model = quality.Embeddings(rows)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.SAME + 1 + quality.PAIRS, quality.DIM)).astype(np.float32).astype(float)
    out, bias, done = [[0.0, 0.0] for _ in range(quality.DIM)], [0.0, 0.0], 0
    texts = [plain_quality_features(t) for t, _ in rows]
    for _ in range(2):
        for k in rng.permutation(len(rows)):
            rate = quality.RATE * (1 - done / (2 * len(rows)))
            done += 1
            total = sum(texts[k].values())
            weights = {f: n / total for f, n in texts[k].items()}
            mean = [sum(w * vectors[f][d] for f, w in weights.items()) for d in range(quality.DIM)]
            z = [sum(mean[d] * out[d][c] for d in range(quality.DIM)) + bias[c] for c in (0, 1)]
            e = [math.exp(v - max(z)) for v in z]
            p = [v / sum(e) - (c == rows[k][1]) for c, v in enumerate(e)]
            back = [sum(out[d][c] * p[c] for c in (0, 1)) for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for c in (0, 1):
                    out[d][c] -= 0.1 * rate * mean[d] * p[c]
            bias = [bias[c] - 0.005 * rate * p[c] for c in (0, 1)]
            for f, w in weights.items():
                vectors[f] -= rate * w * np.array(back)
    effect = vectors @ np.array([o[1] - o[0] for o in out])
    assert np.allclose(model.effect, effect, atol=1e-4) and math.isclose(model.bias, bias[1] - bias[0], abs_tol=1e-4)
    reader = quality.Reader(model)
    for text, _ in rows:
        f = plain_quality_features(text)
        z = sum(model.effect[k] * n for k, n in f.items()) / sum(f.values()) if f else 0.0
        assert math.isclose(reader.score(text), 1 / (1 + math.exp(-(z + model.bias))), rel_tol=1e-6)


def test_bigrams_alone_can_tell_texts_apart():
    """Texts of the same words, in one order or the other."""
    r = random.Random(2)
    rows = []
    for k in range(300):
        pairs = [(a, b) if k % 2 else (b, a) for a, b in (r.choice([("alpha", "beta"), ("gamma", "delta"), ("one", "two")]) for _ in range(12))]
        rows.append((" ".join(f"{a} {b} x{r.randrange(40)}" for a, b in pairs).encode(), k % 2))
    reader = quality.Reader(quality.Embeddings(rows[:200]))
    assert sum((reader.score(t) >= 0.5) == y for t, y in rows[200:]) >= 95


def test_pieces_of_a_long_text_count_each_pair(monkeypatch):
    model = quality.Embeddings([(b"good words here " * 5, 1), (b"bad%% words%% here%% " * 5, 0)] * 20)
    text = b" ".join(random.Random(3).choice([b"good", b"words", b"bad%%", b"here"]) for _ in range(1000))
    whole = quality.Reader(model).score(text)
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    assert math.isclose(quality.Reader(model, 3).score(text), whole, rel_tol=1e-9)


def test_learned_words_are_what_the_counts_say():
    rows = [(f"grumf{i // 3 % 9}x c{i}".encode() if i % 3 == 0 else f"plain d{i} words".encode(), int(i % 3 == 0)) for i in range(90)]
    words, stems = toxicity.learned_lexicon(rows)
    assert "grum" in stems and "grumf" in stems and not any(s.startswith("plai") for s in stems) and "plain" not in words
    assert zlib.crc32(b"x") and all(isinstance(w, str) for w in words)
