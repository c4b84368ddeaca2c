"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of toxic words (a short fixed list, and words and word stems learned from
labelled training rows), how near they stand to a second person, and rates of capitals, punctuation, stretched letters and
obfuscated words. Learning runs in the driver on a bounded sample (TRAIN_DOCS rows, TRAIN_CHARS characters) of the
training fold; a quarter of the sample, held back from the trees, calibrates their scores.

Defined results: a null or wordless text is scored by its (zero) features; rows without a label are scored like all
others; without any training row of both labels every score is the share of label 1 (0 if there is none); equal
texts get equal scores; a null doc_id counts as the empty text for the fold; labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from gridloom.llm.common import is_held_out, mix, raw_texts, sampled_texts, schema_with, ship, with_columns

ship(__name__)

FOLD = (5, 0)
TRAIN_DOCS, TRAIN_CHARS = 6_000, 16_000_000
# Insults and second-person words, by language (en, de, fr, es).
INSULTS = set(
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown ugly filthy vermin imbecile retard jerk bastard bitch whore slut asshole dickhead cunt fuck fucking shit bullshit "
    "arschloch idiotin trottel dummkopf schlampe hurensohn abschaum wichser miststück connard connasse salope imbécile crétin abruti ordure pute merde idiota imbécil estúpido estúpida gilipollas cabrón puta mierda basura escoria asqueroso".split()
)
SECOND = set("you your yours yourself you're u ur ya du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros contigo".split())
LEET = str.maketrans("013457@$!|€", "oieastasile")
EDGE = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>«»“”„‘’…-–—*_~#/\\&%+="
INNER = re.compile(r"[^\W\d_][\d@$!*#%_.+|-]+[^\W\d_]|^[\d@$!]+[^\W\d_]{2}")
STRETCH = re.compile(r"(.)\1\1")
STEMS = (4, 5, 6)
FIXED, WORD, STEM, YOU, ODD, LONG, SHOUT = 1, 2, 4, 8, 16, 32, 64
FEATURES = ("fixed", "word", "stem", "any", "any_count", "near_you", "you", "capitals", "shout", "exclaim", "punctuation", "odd", "stretch", "log_words")


def plain(word: str) -> str:
    """Lower case without edge punctuation; digits and signs inside letters read as the letters they stand for."""
    w = word.lower().strip(EDGE)
    if w.isalpha() or not w:
        return w
    t = w.translate(LEET)
    return "".join(c for c in t if c.isalpha()) if any(c.isalpha() for c in w) else w


def learned_lexicon(sample: list) -> tuple[set, set]:
    """(words, stems) that stand in toxic training texts in many contexts and hardly ever in others.

    A context is the word before, so that copies of one text count once."""
    counts: dict = {}
    seen: set = set()
    totals = [0, 0]
    for text, y in sample:
        before = ""
        for raw in text.split():
            w = plain(raw.decode())
            pair = (before, w, y)
            before = w
            if not w or pair in seen:
                continue
            seen.add(pair)
            totals[y] += 1
            for key in (w, *((n, w[:n]) for n in STEMS if len(w) >= n)):
                counts.setdefault(key, [0, 0])[y] += 1
    ratio = (totals[1] + 1) / (totals[0] + 1)
    words, stems = [], []
    for key, (clean, toxic) in counts.items():
        if toxic >= 6 and clean <= 0.02 * toxic / max(ratio, 0.02) and toxic > 8 * ratio * (clean + 1):
            words.append(key) if isinstance(key, str) else stems.append(key[1])
    return set(words), set(stems)


class Reader:
    """Texts to features; what a word is, is kept in a bounded cache."""

    def __init__(self, words: set, stems: set, cache: int = 200_000):
        self.words, self.stems, self.size, self.cache = words, stems, cache, {}

    def _word(self, raw: bytes) -> int:
        text = raw.decode()
        w = plain(text)
        code = FIXED * (w in INSULTS) | WORD * (w in self.words) | STEM * any(w[:n] in self.stems for n in STEMS if len(w) >= n) | YOU * (w in SECOND)
        core = text.strip(EDGE)
        code |= ODD * (not core.isalpha() and INNER.search(core) is not None) | LONG * (STRETCH.search(w) is not None) | SHOUT * (len(core) > 2 and core.isupper())
        if len(raw) <= 64:
            if len(self.cache) >= self.size:
                self.cache.clear()
            self.cache[raw] = code
        return code

    def features(self, data: bytes | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        data = data or b""
        raw = data.split()
        if not raw:
            return out
        n, get = len(raw), self.cache.get
        codes = np.array([c if (c := get(w)) is not None else self._word(w) for w in raw], np.uint8)
        hit, you = (codes & (FIXED | WORD | STEM)) > 0, (codes & YOU) > 0
        near = 0
        if hit.any() and you.any():
            reach = np.convolve(you, np.ones(9, int))[4 : 4 + n] > 0
            near = int((hit & reach).sum())
        chars = np.frombuffer(data, np.uint8)
        capitals = int(((chars >= 65) & (chars <= 90)).sum())
        letters = max(1, len(data) - len(raw))
        punctuation = sum(data.count(c) for c in b".,;:!?")
        per = 100.0 / n
        out[:] = (
            per * int((codes & FIXED > 0).sum()), per * int((codes & WORD > 0).sum()), per * int((codes & STEM > 0).sum()), per * int(hit.sum()), min(20, int(hit.sum())), per * near, per * int(you.sum()),
            capitals / letters, per * int((codes & SHOUT > 0).sum()), per * data.count(b"!"), punctuation / letters, per * int((codes & ODD > 0).sum()), per * int((codes & LONG > 0).sum()), np.log1p(n),
        )
        return out


class Trees:
    """Boosted regression trees for the log-odds, on histogram bins (numpy)."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        # rare features need cuts among their non-zero values too
        cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 9)) if len(v := x[:, f][x[:, f] > 0]) else c, [0.0]])) for f, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            tree = []
            for _ in range(self.depth):
                level = []
                for k in range(int(node.max()) + 1):
                    level.append(self._split(binned, grad, hess, np.flatnonzero(node == k)))
                feature, cut = np.array([f for f, _ in level]), np.array([c for _, c in level])
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
                tree.append([(int(f), float(cuts[f][c]) if c < len(cuts[f]) else np.inf) for f, c in level])
            leaves = 2**self.depth
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            value = self.rate * g / (h + 1.0)
            score = score + value[node]
            self.trees.append((tree, value))
        return self

    def _split(self, binned, grad, hess, rows):
        best = (0.0, 0, 1 << 30)
        g, h = grad[rows], hess[rows]
        if len(rows) >= 2 * self.least:
            total_g, total_h = g.sum(), h.sum()
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                m = int(b.max()) + 1
                if m < 2:
                    continue
                cg, ch, cn = np.cumsum(np.bincount(b, g, m)), np.cumsum(np.bincount(b, h, m)), np.cumsum(np.bincount(b, minlength=m))
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                gain[(cn < self.least) | (len(rows) - cn < self.least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), f, at)
        return best[1], best[2]

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in tree:
                feature = np.array([f for f, _ in level] + [0] * (int(node.max(initial=0)) + 1 - len(level)))
                cut = np.array([c for _, c in level] + [np.inf] * (int(node.max(initial=0)) + 1 - len(level)))
                node = 2 * node + (x[np.arange(len(x)), feature[node]] > cut[node])
            score += value[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, share of label 1) of each block, shares smoothed by a half each way."""
    order = np.argsort(score, kind="stable")
    blocks: list = []
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([s, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    b = np.array(blocks, float)
    return b[:, 0] / b[:, 2], np.maximum.accumulate((b[:, 1] + 0.5) / (b[:, 2] + 1))


class Classifier:
    def __init__(self, sample: list):
        y = np.array([t for _, t in sample], float)
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees, self.words, self.stems = None, set(), set()
        if len(set(y.tolist())) < 2:
            return
        # the part by a hash of the text, so that copies fall on one side
        side = np.array([int(mix(np.array([xxh64_intdigest(t, 11)], np.uint64))[0] % np.uint64(4)) for t, _ in sample])
        fit = np.flatnonzero(side != 0)
        if len({*y[fit].tolist()}) < 2:
            fit = np.arange(len(y))
        check = np.setdiff1d(np.arange(len(y)), fit)
        self.words, self.stems = learned_lexicon([sample[i] for i in fit])
        reader = Reader(self.words, self.stems)
        x = np.array([reader.features(t) for t, _ in sample])
        self.trees = Trees().fit(x[fit], y[fit])
        if len({*y[check].tolist()}) < 2:
            check = fit
        self.calibration = isotonic(self.trees.raw(x[check]), y[check])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.interp(self.trees.raw(x), *self.calibration)


def _score(model: Classifier):
    def run(batches):
        reader = Reader(model.words, model.stems)
        for batch in batches:
            texts = raw_texts(batch.column(batch.schema.names.index("text")))
            x = np.array([reader.features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield with_columns(batch, ("text",), score=pa.array(model.scores(x)))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple = FOLD, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    model = Classifier(sampled_texts(docs, labels, label, fold, max_docs, max_chars))
    slim = docs.select("doc_id", "text")
    scored = slim.mapInArrow(_score(model), schema_with(slim, ("text",), score=T.DoubleType()))
    return scored.select("doc_id", is_held_out(*fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
