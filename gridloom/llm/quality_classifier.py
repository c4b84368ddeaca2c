"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax output.

A word's features are its own hash and those of its character n-grams (3 to 5, with word marks); each two words in a
row are a bigram, hashed to buckets of its own, and one more feature says that a word repeats the one before. Vectors
and output weights are learned by numpy stochastic gradient descent in the driver, on a bounded sample (TRAIN_DOCS rows,
TRAIN_CHARS characters) of the training fold. As the output is linear in the average, scoring needs one number for each
feature; a word's sum is kept in a bounded cache.

Defined results: a null or wordless text has no features and gets the output of the zero vector; a text of any length
is read whole, in pieces of AT_ONCE words; rows without a label
are scored like all others; without training rows of both labels every score is the share of label 1 (1 if there is
none); equal texts get equal scores; a null doc_id counts as the empty text for the fold; labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import is_held_out, mix, raw_texts, sampled_texts, schema_with, ship, with_columns

ship(__name__)

FOLD = (4, 2)
TRAIN_DOCS, TRAIN_CHARS = 4_000, 14_000_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 8, 6, 12.0
SAME = BUCKETS  # a word repeats the one before
PAIRS = 1 << 16  # buckets of bigrams, after SAME
AT_ONCE = 50_000
_P = np.uint64(0x100000001B3)


def features(words: list) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, feature) for all features of a list of words; a word's own come in an order of their own."""
    own = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % BUCKETS
    marked = (b"<" + b"> <".join(words) + b">").decode().split(" ")
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(marked)))
    at, found, h = [np.arange(len(words))], [own], codes
    for n in range(2, 6):
        h = h[:-1] * _P + codes[n - 1 :]
        if n > 2:
            whole = np.flatnonzero(word[: len(h)] == word[n - 1 :])
            at.append(word[whole])
            found.append((mix(h[whole] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(found)


def word_keys(words: list) -> np.ndarray:
    """A 64-bit name of each word, of which bigrams are made."""
    return mix(np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words)) + _P)


def pairs(keys: np.ndarray) -> np.ndarray:
    """The features of the bigrams of words with these keys."""
    return (mix(keys[:-1] * _P + keys[1:]) % np.uint64(PAIRS)).astype(np.int64) + SAME + 1


def text_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text and how often each occurs."""
    words = data.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    at, found = features(list(counts))
    same = sum(map(bytes.__eq__, words, words[1:]))
    weights = np.append(np.fromiter(counts.values(), np.float64, len(counts))[at], same * 4.0)
    ids, place = np.unique(np.append(found, SAME), return_inverse=True)
    times = np.bincount(place, weights)
    return ids[times > 0], times[times > 0]


def all_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """text_features and the text's bigrams, and how often each occurs."""
    ids, times = text_features(data)
    two, twice = np.unique(pairs(word_keys(data.split())), return_counts=True)
    return np.concatenate([ids, two]), np.concatenate([times, twice])


class Embeddings:
    def __init__(self, sample: list, seed: int = 7):
        y = np.array([t for _, t in sample], np.int64)
        self.share = float(y.mean()) if len(y) else 1.0
        self.effect, self.bias = None, 0.0
        if len(set(y.tolist())) < 2:
            return
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (SAME + 1 + PAIRS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        texts = [(i, (w / w.sum()).astype(np.float32)) if len(i) else (i, w.astype(np.float32)) for i, w in (all_features(t) for t, _ in sample)]
        rounds, done = EPOCHS * len(texts), 0
        for _ in range(EPOCHS):
            for k in rng.permutation(len(texts)):
                ids, weights = texts[k]
                rate = RATE * (1 - done / rounds)
                done += 1
                mean = weights @ vectors[ids]
                z = mean @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1
                back = out @ p
                out -= (0.1 * rate) * np.outer(mean, p)
                bias -= 0.005 * rate * p
                vectors[ids] -= rate * np.outer(weights, back)
        self.effect = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])


class Reader:
    """Scores texts; a word's sum of effects, number of features and key are kept while no more than ``cache`` are held."""

    def __init__(self, model: Embeddings, cache: int = 200_000):
        self.m, self.size, self.cache = model, cache, {}
        self.sums, self.counts, self.keys, self.used = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64), 0

    def _learn(self, words: list) -> None:
        for lo in range(0, len(words), AT_ONCE):
            some = words[lo : lo + AT_ONCE]
            at, found = features(some)
            n = self.used + len(some)
            if n > len(self.sums):
                self.sums, self.counts, self.keys = (np.concatenate([x[: self.used], np.zeros(2 * n - self.used, x.dtype)]) for x in (self.sums, self.counts, self.keys))
            self.sums[self.used : n] = np.bincount(at, self.m.effect[found])
            self.counts[self.used : n] = np.bincount(at)
            self.keys[self.used : n] = word_keys(some)
            self.cache.update(zip(some, range(self.used, n)))
            self.used = n

    def score(self, data: bytes | None) -> float:
        m = self.m
        if m.effect is None:
            return m.share
        words = (data or b"").split()
        total, number, last = 0.0, 0, None
        for lo in range(0, len(words), AT_ONCE):
            some = words[lo : lo + AT_ONCE]
            if self.used > self.size:
                self.cache.clear()
                self.used = 0
            new = [w for w in dict.fromkeys(some) if w not in self.cache]
            if new:
                self._learn(new)
            at = np.fromiter(map(self.cache.__getitem__, some), np.int64, len(some))
            keys = self.keys[at] if last is None else np.concatenate([last, self.keys[at]])
            two = pairs(keys)
            same = 4 * (int((at[1:] == at[:-1]).sum()) + int(lo > 0 and some[0] == words[lo - 1]))
            total += float(self.sums[at].sum()) + float(m.effect[two].sum()) + same * float(m.effect[SAME])
            number += int(self.counts[at].sum()) + len(two) + same
            last = keys[-1:]
            for w in new:
                if len(w) > 64:
                    del self.cache[w]
        z = total / number if number else 0.0
        return float(1 / (1 + np.exp(-np.clip(z + m.bias, -500, 500))))


def _score(model: Embeddings):
    def run(batches):
        reader = Reader(model)
        for batch in batches:
            texts = raw_texts(batch.column(batch.schema.names.index("text")))
            yield with_columns(batch, ("text",), score=pa.array([reader.score(t) for t in texts], pa.float64()))

    return run


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple = FOLD, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    model = Embeddings(sampled_texts(docs, labels, label, fold, max_docs, max_chars))
    slim = docs.select("doc_id", "text")
    scored = slim.mapInArrow(_score(model), schema_with(slim, ("text",), score=T.DoubleType()))
    return scored.select("doc_id", is_held_out(*fold).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
