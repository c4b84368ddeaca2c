"""Substring dedup by recompression: removes every word covered by a window of ``window`` words that also starts earlier.

Words become 64-bit names. Rounds of recompression then name maximal runs of one symbol, and pairs whose left and
right symbols fall on opposite sides of a partition of all names. A name is a fingerprint of the words below it, so it
is the same in every task: the naming is global without a dictionary that grows with the corpus. With each symbol goes
the extent of words that its existence depends on; a symbol whose extent lies inside a window exists in every occurrence
of that window, at the same place. So each window is keyed by one symbol inside it: the longest of the last round, then by
name, then the leftmost; if it has none, one of the first round; if its words are all one, the run of them.

Three Spark rounds follow. In the first, each map batch asks, once for each symbol that keys a window, whether the symbol
stands anywhere else; all that ask for one symbol meet, and the rows whose symbols are shared are told. In the second, rows
send only the windows that a shared symbol keys, with their words; windows of one symbol meet in one task, which groups
them by fingerprint, compares the words themselves with those of the group's first, and finds the earliest. In the third,
each row is cut by the spans it was told of. A batch's own repeats are found before either shuffle, so a passage in a
third of all documents sends one message for each batch and symbol; the task that settles these goes through them as a
stream and holds only the earliest of each window so far.

Defined results: documents are ordered by doc_id, null last (as if it were 2**63 - 1, the largest id); rows that repeat a
doc_id are one document's texts, told apart by 128 bits of the text, and equal windows at the same doc_id and start are one
occurrence, so neither removes the other. A null text has no words. Texts of fewer than ``window`` words lose nothing; a
text of any length is taken whole. An empty table gives an empty result. All other columns are passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from gridloom.llm.common import mix, raw_texts, schema_with, ship, task_count, with_columns

ship(__name__)

WINDOW = 20
ROUNDS = 4
BATCH_WORDS = 1_200_000
PIECE_WORDS = 60_000
SETTLE_WINDOWS = 3_000_000
_B1 = np.uint64(0x9E3779B97F4A7C15)
_B2 = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xA0761D6478BD642F)
TEXT_KEY = np.dtype([("a", np.int64), ("b", np.int64)])  # 128 bits of a text


def recompress(words: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Symbols of the last round over ``words`` (names; 0 separates documents, and is first and last).

    Gives arrays name, start, end (words spanned), left, right (extent that the symbol depends on)."""
    n = len(words)
    start = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] == 0)]))
    end = np.append(start[1:], n)
    runs = (end - start).astype(np.uint64)
    name = words[start]
    name = np.where((runs > 1) & (name != 0), mix(name * _B2 + runs) | np.uint64(1), name)
    left, right = start - 1, end + 1  # a run ends where its neighbours differ
    for k in range(rounds):
        side = (mix(name + np.uint64((2 * k + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(np.int8)
        side[name == 0] = 2
        joins = (side[:-1] == 0) & (side[1:] == 1)
        first = np.append(joins, False)
        second = np.concatenate([[False], joins])
        # a left symbol left alone depends on what follows it, a right one on what precedes it
        new_left = np.where((side == 1) & ~second, np.minimum(left, np.concatenate([left[:1], left[:-1]])), left)
        new_right = np.where((side == 0) & ~first, np.maximum(right, np.concatenate([right[1:], right[-1:]])), right)
        at = np.flatnonzero(first)
        name = name.copy()
        end = end.copy()
        name[at] = mix(name[at] * _B1 + mix(name[at + 1] * _B2 + np.uint64(k))) | np.uint64(1)
        end[at] = end[at + 1]
        new_right[at] = right[at + 1]
        new_left[at] = left[at]
        keep = ~second
        name, start, end, left, right = name[keep], start[keep], end[keep], new_left[keep], new_right[keep]
    return {"name": name, "start": start, "end": end, "left": left, "right": right}


def _best_in_ranges(priority: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the greatest priority in each [lo, hi), the leftmost of equals (doubling tables; hi > lo)."""
    out = np.empty(len(lo), np.int64)
    if not len(lo):
        return out
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    best = np.arange(len(priority))
    for k in range(int(level.max()) + 1):
        m = np.flatnonzero(level == k)
        if len(m):
            a, b = best[lo[m]], best[hi[m] - (1 << k)]
            out[m] = np.where(priority[a] >= priority[b], a, b)
        a, b = best[: -(1 << k) or None], best[(1 << k) :]
        a = a[: len(b)]
        best = np.concatenate([np.where(priority[a] >= priority[b], a, b), best[len(b) :]]) if len(b) else best
    return out


def window_symbols(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at ``at``: the name of the symbol that keys it, and where that symbol starts."""
    key, place = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    left = np.arange(len(at))
    for rounds in (ROUNDS, 1):
        if len(left):
            s = recompress(words, rounds)
            lo, hi = np.searchsorted(s["left"], at[left], "left"), np.searchsorted(s["right"], at[left] + window, "right")
            some = np.flatnonzero(lo < hi)
            length = np.minimum(s["end"] - s["start"], 63).astype(np.uint64)
            best = _best_in_ranges((length << np.uint64(58)) | (s["name"] >> np.uint64(6)), lo[some], hi[some])
            key[left[some]], place[left[some]] = s["name"][best], s["start"][best]
            left = left[lo >= hi]
    if len(left):  # whatever is left: the names of its words in order, which for a run of one word is the run's own
        other = np.zeros(len(left), np.uint64)
        for k in range(window):
            other = mix(other * _B2 + words[at[left] + k])
        key[left], place[left] = other ^ _C, at[left]
    return key, place


def window_keys(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at ``at``: the key (the chosen symbol's name) and the fingerprint of all its words."""
    return window_symbols(words, at, window)[0], fingerprints(words, at, window)


def fingerprints(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), _B1, np.uint64))])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), _INV, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1])])
    return mix((sums[at + window] - sums[at]) * back[at])


def _names(words: list) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, 7) or 1 for w in words), np.uint64, len(words))


class _Numbers(dict):
    """The number of each word; a new word gets the next one."""

    def __init__(self):
        super().__init__()
        self.words: list = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


class Words:
    """Words by number: numbers are equal for equal words only, so that words are compared as numbers."""

    def __init__(self):
        self.number = _Numbers()
        self.words = self.number.words
        self._names, self.named = np.zeros(0, np.uint64), 0

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def names(self, numbers: np.ndarray) -> np.ndarray:
        """The names of words with these numbers; -1 is no word and has name 0."""
        n = len(self.words)
        if self.named < n:
            if n > len(self._names):
                self._names = np.concatenate([self._names[: self.named], np.zeros(2 * n - self.named, np.uint64)])
            self._names[self.named : n] = _names(self.words[self.named :])
            self.named = n
        out = self._names[numbers]
        out[numbers < 0] = 0
        return out


def _runs(*columns: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Starts of the runs of consecutive pos in which all columns stay the same, then the length."""
    if not len(pos):
        return np.zeros(1, np.int64)
    new = pos[1:] != pos[:-1] + 1
    for c in columns:
        new = new | (c[1:] != c[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(pos)]])


def _text_keys(th: np.ndarray) -> np.ndarray:
    """Keys of texts as TEXT_KEY; plain integers are its first half."""
    if th.dtype == TEXT_KEY:
        return th
    out = np.zeros(len(th), TEXT_KEY)
    out["a"] = th
    return out


def _pack(kind: int, key, th, start, n, sym, whole) -> bytes:
    """One message. Columns of its runs, then 48 bits of each window's fingerprint (kind 1; kind 0 are settled repeats)."""
    low = (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = ((whole >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    return b"".join([np.array([kind, len(key), len(whole)], np.int64).tobytes(), key.astype(np.int64).tobytes(), _text_keys(th).tobytes(), start.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), sym.astype(np.uint64).tobytes() if kind else b"", low.tobytes(), high.tobytes()])


def _unpack(blob: bytes) -> tuple:
    kind, r, w = np.frombuffer(blob, np.int64, 3)
    at, out = 24, []
    for dtype, m in ((np.int64, r), (TEXT_KEY, r), (np.int32, r), (np.int32, r), (np.uint64, r if kind else 0), (np.uint32, w), (np.uint16, w)):
        out.append(np.frombuffer(blob, dtype, int(m), at))
        at += int(m) * np.dtype(dtype).itemsize
    return int(kind), out, at


def _same_first(c: np.ndarray) -> np.ndarray:
    """Whether each element of a sorted array has an equal neighbour."""
    eq = c[1:] == c[:-1]
    return np.concatenate([[False], eq]) | np.concatenate([eq, [False]])


def _later(identity: list, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows, those of which an equal one comes first (by key, pos), and the rest, as index arrays.

    identity: arrays that are all equal for equal windows only."""
    mixed = identity[0] * _B1
    for x in identity[1:]:
        mixed = mix(mixed ^ x) * _B2
    order = np.argsort(mixed)
    m = order[_same_first(mixed[order])]
    if not len(m):
        return m, np.arange(len(key))
    # among these few, a full comparison: no two different windows count as equal
    m = m[np.lexsort((pos[m], key[m], *(x[m] for x in identity)))]
    new = np.zeros(len(m), bool)
    new[0] = True
    for x in identity:
        new[1:] |= x[m][1:] != x[m][:-1]
    first = m[np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))]
    late = m[(key[m] != key[first]) | (pos[m] != pos[first])]
    rest = np.ones(len(key), bool)
    rest[late] = False
    return late, np.flatnonzero(rest)


def _columns(parts: list) -> list:
    """Columns of the tuples of arrays in parts, which is emptied; each column's pieces go as it is joined."""
    pieces = [list(x) for x in zip(*parts)]
    parts.clear()
    out = []
    for x in pieces:
        out.append(np.concatenate(x))
        x.clear()
    return out


def verified_later(sym: np.ndarray, whole: np.ndarray, key: np.ndarray, pos: np.ndarray, at: np.ndarray, numbers: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """_later of windows whose words are numbers[at : at + window]: the words decide, the fingerprints only sort."""
    identity = [sym, whole]
    while True:
        late, rest = _later(identity, key, pos)
        if not len(late):
            return late, rest
        mixed = identity[0] * _B1
        for x in identity[1:]:
            mixed = mix(mixed ^ x) * _B2
        order = rest[np.argsort(mixed[rest], kind="stable")]
        first = order[np.searchsorted(mixed[order], mixed[late])]
        if _equal_spans(at[late], at[first], numbers, window):
            return late, rest
        differ = np.zeros(len(late), bool)
        for k in range(window):
            differ |= numbers[at[late] + k] != numbers[at[first] + k]
        # different words with one fingerprint: number the contents of these groups, and tell windows apart by that too
        exact, seen = np.zeros(len(key), np.uint64), {}
        for i in np.flatnonzero(np.isin(mixed, mixed[late[differ]])).tolist():
            exact[i] = seen.setdefault(numbers[at[i] : at[i] + window].tobytes(), len(seen) + 1)
        identity = [sym, whole, exact]


def _equal_spans(a: np.ndarray, b: np.ndarray, numbers: np.ndarray, window: int) -> bool:
    """Whether the windows at a equal those at b, word by word; windows that follow one another on both sides are compared
    as one span."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cut = _runs(b - a, pos=a)
    first, n = cut[:-1], np.diff(cut) + window - 1
    steps = _steps(n)
    return bool((numbers[np.repeat(a[first], n) + steps] == numbers[np.repeat(b[first], n) + steps]).all())


class Pieces:
    """Texts of rows, gathered into pieces of PIECE_WORDS words; ``take`` gets each piece as (rows, names, row of each
    window, its start in the text, its start in the piece, numbers)."""

    def __init__(self, window: int, take):
        self.window, self.take, self.vocabulary, self.rows, self.size, self.held = window, take, Words(), [], 0, 0

    def add(self, text: bytes | None, row) -> None:
        words = (text or b"").split()
        if len(words) >= self.window:
            self.rows.append((row, self.vocabulary.numbers(words)))
            self.size += len(words)
            self.held += len(words)
            if self.size >= PIECE_WORDS:
                self.close()

    def close(self) -> None:
        if not self.rows:
            return
        sizes = np.array([len(n) for _, n in self.rows])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1
        numbers = np.full(int(sizes.sum()) + len(sizes) + 1, -1, np.int32)
        numbers[np.delete(np.arange(len(numbers)), np.append(begin - 1, len(numbers) - 1))] = np.concatenate([n for _, n in self.rows])
        names = self.vocabulary.names(numbers)
        counts = sizes - self.window + 1
        doc = np.repeat(np.arange(len(sizes)), counts)
        pos = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        self.take([r for r, _ in self.rows], names, doc, pos, begin[doc] + pos, numbers)
        self.rows, self.size = [], 0

    def forget(self) -> None:
        self.vocabulary, self.held = Words(), 0


def _sorted_parts(bucket: np.ndarray):
    """(bucket, indices) of each bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else [0]
    for lo, hi in zip(edges, edges[1:]):
        yield int(bucket[order[lo]]), order[lo:hi]


def _messages(rows):
    schema = pa.schema([("__b", pa.int32()), ("__m", pa.binary())])
    rows = list(rows)
    for lo in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows[lo : lo + 512]], pa.int32()), pa.array([m for _, m in rows[lo : lo + 512]], pa.binary())], schema=schema)


def _bucket_of(sym: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(sym) % np.uint64(buckets)).astype(np.int64)


def _ask(window: int, buckets: int):
    """First round: which of the symbols that key a window does the batch hold, and where (kind 1: symbol, row, whether it
    is known to be shared; kind 0: rows whose symbols the batch itself shows to be shared)."""

    def flush(parts):
        sym, row, place = _columns(parts)
        order = np.lexsort((place, row, sym))
        sym, row, place = sym[order], row[order], place[order]
        fresh = np.concatenate([[True], (sym[1:] != sym[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1])])
        sym, row = sym[fresh], row[fresh]
        shared = _same_first(sym)
        one = np.concatenate([[True], sym[1:] != sym[:-1]])
        told = np.flatnonzero(shared & np.concatenate([[True], (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])]))
        if len(told):
            yield int(row[told[0]] % np.uint64(buckets)), b"".join([np.array([0, len(told)], np.int64).tobytes(), sym[told].tobytes(), row[told].tobytes()])
        sym, row, shared = sym[one], row[one], shared[one]
        for b, i in _sorted_parts(_bucket_of(sym, buckets)):
            yield b, b"".join([np.array([1, len(i)], np.int64).tobytes(), sym[i].tobytes(), row[i].tobytes(), shared[i].tobytes()])

    def run(batches):
        parts: list = []

        def take(rows, names, doc, pos, at, numbers):
            sym, place = window_symbols(names, at, window)
            place = place - (at - pos)  # from the text's begin
            new = np.concatenate([[True], (sym[1:] != sym[:-1]) | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
            parts.append((sym[new], np.array(rows, np.int64).view(np.uint64)[doc[new]], place[new]))

        pieces = Pieces(window, take)
        for batch in batches:
            names = batch.schema.names
            for text, row in zip(raw_texts(batch.column(names.index("text"))), batch.column(names.index("__row")).to_pylist()):
                pieces.add(text, row)
                if pieces.held >= BATCH_WORDS:
                    pieces.close()
                    yield from _messages(flush(parts))
                    pieces.forget()
        pieces.close()
        if parts:
            yield from _messages(flush(parts))

    return run


def _tell(batches):
    """All questions about some symbols -> (__row, __sym) for each row of a symbol that stands in more than one place."""
    schema = pa.schema([("__row", pa.int64()), ("__sym", pa.int64())])
    asked: list = []

    def out(row, sym):
        for lo in range(0, len(row), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(row[lo : lo + 65536].view(np.int64)), pa.array(sym[lo : lo + 65536].view(np.int64))], schema=schema)

    for batch in batches:
        for blob in batch.column(1).to_pylist():
            kind, n = np.frombuffer(blob, np.int64, 2)
            sym, row = np.frombuffer(blob, np.uint64, n, 16), np.frombuffer(blob, np.uint64, n, 16 + 8 * n)
            if kind:
                asked.append((sym, row, np.frombuffer(blob, bool, n, 16 + 16 * n)))
            else:
                yield from out(row, sym)
    if asked:
        sym, row, known = _columns(asked)
        order = np.argsort(sym, kind="stable")
        sym, row, known = sym[order], row[order], known[order]
        start = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        count = np.diff(np.append(start, len(sym)))
        shared = np.repeat((count > 1) | np.logical_or.reduceat(known, start), count) & ~known
        yield from out(row[shared], sym[shared])


def _claim(window: int, buckets: int):
    """Second round: the windows that a shared symbol keys, with their words (kind 2), and the batch's own repeats (kind 0)."""

    def flush(parts, vocabulary):
        key, th, pos, at, sym, whole, numbers, shift = [], [], [], [], [], [], [], 0
        for k, t, p, a, s, w, n in parts:
            for held, x in zip((key, th, pos, at, sym, whole, numbers), (k, t, p, a + shift, s, w, n)):
                held.append(x)
            shift += len(n)
        parts.clear()
        key, th, pos, at, sym, whole, numbers = (np.concatenate(x) for x in (key, th, pos, at, sym, whole, numbers))
        late, rest = verified_later(sym, whole, key, pos, at, numbers, window)
        late.sort()
        cut = _runs(key[late], th[late], pos=pos[late])
        a = late[cut[:-1]] if len(late) else late
        none = np.zeros(0, np.uint64)
        if len(a):
            yield int(key[a[0]]) % buckets, _pack(0, key[a], th[a], pos[a], np.diff(cut), none, none)
        cut = _runs(key[rest], th[rest], sym[rest], pos=pos[rest])
        first, n = (rest[cut[:-1]] if len(rest) else rest), np.diff(cut)
        word = vocabulary.words.__getitem__
        for b, r in _sorted_parts(_bucket_of(sym[first], buckets)):
            f, m = first[r], n[r]
            span = m + window - 1
            text = b" ".join(map(word, numbers[np.repeat(at[f], span) + _steps(span)].tolist()))
            yield b, _pack(2, key[f], th[f], pos[f], m, sym[f], none) + text

    def run(batches):
        parts: list = []

        def take(rows, names, doc, pos, at, numbers):
            sym, _ = window_symbols(names, at, window)
            mark = lambda s, d: mix(s + d.astype(np.uint64) * _B2)
            told = np.concatenate([mark(np.array(r[1], np.int64).view(np.uint64), np.full(len(r[1]), d)) for d, r in enumerate(rows)])
            some = np.flatnonzero(np.isin(mark(sym, doc), told))
            if len(some):
                d = doc[some]
                key, th = np.array([r[0][0] for r in rows], np.int64), np.array([r[0][1:] for r in rows], TEXT_KEY)
                parts.append((key[d], th[d], pos[some], at[some], sym[some], fingerprints(names, at[some], window), numbers))

        pieces = Pieces(window, take)
        for batch in batches:
            column = lambda n: batch.column(batch.schema.names.index(n))
            for text, *row, told in zip(raw_texts(column("text")), *(column(n).to_pylist() for n in ("__k", "__th", "__t2", "__syms"))):
                pieces.add(text, (tuple(row), told))
                if pieces.held >= BATCH_WORDS:
                    pieces.close()
                    if parts:
                        yield from _messages(flush(parts, pieces.vocabulary))
                    pieces.forget()
        pieces.close()
        if parts:
            yield from _messages(flush(parts, pieces.vocabulary))

    return run


def _settle(batches, window: int = WINDOW):
    """All messages of some buckets -> runs (__k, __th, __t2, start and n) of windows that start earlier elsewhere.

    Whenever as many windows have come as are held (and SETTLE_WINDOWS at least), repeats go out and the earliest of
    each window stay. So memory follows the distinct windows of a partition, not the occurrences of a common passage.
    Windows that come with their words (kind 2) are compared by these, others (kind 1) by 48 bits beside the symbol."""
    schema = pa.schema([("__k", pa.int64()), ("__th", pa.int64()), ("__t2", pa.int64()), ("__r", pa.int64())])
    got: list = []
    vocabulary, numbers = Words(), [np.zeros(0, np.int32)]
    held = fresh = 0

    def out(key, th, start, n):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(th["a"].copy()), pa.array(th["b"].copy()), pa.array((start.astype(np.int64) << 32) | n.astype(np.int64))], schema=schema)

    def settled(more: bool):
        nonlocal held, fresh, vocabulary
        key, th, pos, sym, whole, at = _columns(got)
        flat = np.concatenate(numbers)
        late, rest = verified_later(sym, whole, key, pos, at, flat, window) if len(flat) else _later([sym, whole], key, pos)
        late = late[np.lexsort((pos[late], th["b"][late], th["a"][late], key[late]))]
        cut = _runs(key[late], th[late], pos=pos[late])
        if len(late):
            a = late[cut[:-1]]
            for lo in range(0, len(a), 65536):
                yield out(key[a[lo : lo + 65536]], th[a[lo : lo + 65536]], pos[a[lo : lo + 65536]], np.diff(cut)[lo : lo + 65536])
        if not more:
            return
        if len(flat):  # the words of the windows that stay, numbered anew
            spans = _runs(pos=at[rest])
            first, n = at[rest[spans[:-1]]], np.diff(spans)
            kept = np.repeat(first, n + window - 1) + _steps(n + window - 1)
            old = vocabulary.words
            used, again = np.unique(flat[kept], return_inverse=True)
            vocabulary = Words()
            numbers[:] = [vocabulary.numbers([old[i] for i in used.tolist()])[again].astype(np.int32)] if len(used) else [flat[:0]]
            at = np.zeros(len(key), np.int64)
            at[rest] = np.repeat(np.concatenate([[0], np.cumsum(n + window - 1)[:-1]]), n) + _steps(n)
            whole[rest] = fingerprints(_C + numbers[0].astype(np.uint64), at[rest], window) if len(rest) else whole[rest]
        got.append((key[rest], th[rest], pos[rest], sym[rest], whole[rest], at[rest]))
        held, fresh = len(rest), 0

    for batch in batches:
        for blob in batch.column(1).to_pylist():
            kind, (key, th, start, n, sym, low, high), end = _unpack(blob)
            if kind == 0:
                if len(key):
                    yield out(key, th, start, n)
                continue
            if kind == 1:
                whole, at = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), np.zeros(len(low), np.int64)
            else:
                own = vocabulary.numbers(blob[end:].split())
                begin = np.concatenate([[0], np.cumsum(n + np.int64(window - 1))[:-1]])
                at = np.repeat(begin, n) + _steps(n)
                whole = fingerprints(_C + own.astype(np.uint64), at, window)  # numbers name words as long as the vocabulary stands
                at = at + sum(map(len, numbers))
                numbers.append(own)
            got.append((np.repeat(key, n), np.repeat(th, n), np.repeat(start, n) + _steps(n), np.repeat(sym, n), whole, at))
            fresh += len(at)
            if fresh >= max(held, SETTLE_WINDOWS):
                yield from settled(True)
    if fresh:
        yield from settled(False)


def _steps(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _cut(window: int):
    def run(batches):
        for batch in batches:
            column = lambda n: batch.column(batch.schema.names.index(n))
            texts, spans, own = raw_texts(column("text")), column("__spans").to_pylist(), zip(*(column(n).to_pylist() for n in ("__k", "__th", "__t2")))
            kept, n_words, n_removed = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, (text, runs, row) in enumerate(zip(texts, spans, own)):
                words = (text or b"").split()
                n_words[i] = len(words)
                runs = [x["__r"] for x in runs or () if (x["__k"], x["__th"], x["__t2"]) == row]
                if runs:
                    r = np.array(runs, np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, r >> 32, 1)
                    np.add.at(edge, (r >> 32) + (r & 0xFFFFFFFF) + window - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    n_removed[i] = len(words) - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                kept.append(b" ".join(words))
            yield with_columns(batch, ("__spans", "__row", "__k", "__th", "__t2"), kept_text=pa.array(kept, pa.binary()).cast(pa.string()), n_words=pa.array(n_words), n_removed=pa.array(n_removed))

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with kept_text (the kept words joined by one space), n_words and n_removed (longs)."""
    text = F.coalesce("text", F.lit(""))
    keys = {"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__th": F.xxhash64(text), "__t2": F.xxhash64(F.lit("second"), text)}
    # __row finds a row; where two rows share it by chance, each is asked for more and the keys tell their spans apart
    keyed = docs.withColumns(keys).withColumn("__row", F.xxhash64(*keys))
    parts = task_count(docs)
    asked = keyed.select("text", "__row").mapInArrow(_ask(window, 8 * parts), "__b int, __m binary")
    told = asked.repartition(parts, "__b").mapInArrow(_tell, "__row long, __sym long").groupBy("__row").agg(F.collect_set("__sym").alias("__syms"))
    # both joins take all of a row, so that they share one shuffle of the texts
    claimed = keyed.join(told, "__row").mapInArrow(_claim(window, 8 * parts), "__b int, __m binary")
    late = claimed.repartition(parts, "__b").mapInArrow(lambda batches: _settle(batches, window), "__k long, __th long, __t2 long, __r long")
    spans = late.groupBy(F.xxhash64(*keys).alias("__row")).agg(F.collect_list(F.struct(*keys, "__r")).alias("__spans"))
    joined = keyed.join(spans, "__row", "left")
    return joined.mapInArrow(_cut(window), schema_with(docs, (), kept_text=T.StringType(), n_words=T.LongType(), n_removed=T.LongType()))


def brute_force(rows: list, window: int = WINDOW) -> list:
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept_sha256)] by comparing the words themselves."""
    big = (1 << 63) - 1
    first: dict = {}
    texts = [(big if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    for k, _, w in texts:
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, (k, p)), (k, p))
    out = []
    for k, i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (k, p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out
