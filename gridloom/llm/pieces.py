"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for the last ``longest piece`` boundaries only, the best path's last piece. Ids are committed as
soon as the backpointer paths of all boundaries in the window run through one common boundary. With a unigram model a
path's score is the sum of its pieces' scores. With a BPE model a path lives only while each two neighbouring pieces
are what the merges make of their two surfaces; by that rule one path lives at each boundary, and it is the BPE
encoding of the text up to there, so the result is the library's for either kind.

Where no piece of the vocabulary can cross (before a word's space mark after another character, or around a
character that no piece holds) all paths meet, so the text falls apart there; the parts' ids are kept in a bounded cache.
A text is read in slices of SLICE characters, and GROUP characters of slices are searched at a time: their new parts in
sorted order, so that a search goes on from the boundary up to which it equals the one before. A part of more than LONG
characters goes through the stream slice by slice, and its ids leave as they are committed.

Defined results: a null text has null ids, an empty one none; characters without a piece become byte pieces, or the
unknown id where the model has none; texts of any length need slices and a window of bounded size; other columns are passed on. Decoding
gives the text back exactly, but for literal U+2581 marks (read as spaces) and unknown ids (their surface, as the model says).
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import schema_with, ship, with_columns

ship(__name__)

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CACHE = 250_000
SLICE, GROUP, LONG = 1 << 16, 1 << 20, 256


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """The parts of a serialised sentencepiece model that encoding and decoding need."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(f.get(2, 0.0))
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = {n: v for n, v in _fields(value) if n in (3, 40)}
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or USER in self.kinds:
            raise ValueError("only unigram and BPE models that don't rewrite characters and have no user-defined pieces are read")
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if not normalizer.get(5, 1):
            raise ValueError("only models that escape spaces are read")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        known = {c for p in self.ids for c in p}
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.hard = [c for c in "\n\t\r\x0b\x0c" if c not in known]
        # every end of a piece: its id if it is a piece that a path may use, else -1
        self.ends = {p[k:]: -1 for p in self.ids for k in range(len(p))}
        self.ends |= {p: i for p, i in self.ids.items() if self.kind == UNIGRAM or self.merged(p) == [p]}
        self.pairs: dict = {}

    def normalized(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def slices(self, text: str, size: int):
        """normalized(text) in pieces that come from ``size`` characters of the text each."""
        begun = space = False
        for lo in range(0, len(text), size):
            part = text[lo : lo + size]
            if self.squeeze:
                part = re.sub(" +", " ", part)
                if space or not begun:
                    part = part.lstrip(" ")
                if space and part:
                    part, space = " " + part, False
                if part.endswith(" "):
                    part, space = part[:-1], True
            if part:
                yield (MARK if self.prefix and not begun else "") + part.replace(" ", MARK)
                begun = True

    def merged(self, text: str) -> list:
        """BPE by definition: again and again the neighbours whose union scores best, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges make the pieces [a, b] of their union."""
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        left, right = self.pieces[a], self.pieces[b]
        found = self.pairs[a << 32 | b] = self.merged(left + right) == [left, right]
        return found

    def without_piece(self, surface: str) -> list:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in surface.encode()] if len(self.bytes) == 256 else [self.unknown]


def _squash(ids: list, unknown: int) -> list:
    """Neighbouring unknown ids are one."""
    return [x for k, x in enumerate(ids) if x != unknown or not k or ids[k - 1] != unknown]


class Stream:
    """Viterbi over a text that arrives in parts; gives ids. Holds the window and the paths that haven't met yet.

    For each boundary: where the best path's last piece starts, its id (-1: a character without a piece), and, for a
    unigram model, the path's score."""

    def __init__(self, model: Model, step: int = 256):
        self.m, self.step = model, step
        self.text, self.back, self.code, self.best, self.done = "", [0], [-1], [0.0], 0

    def feed(self, part: str) -> list:
        out: list = []
        search = self._search_bpe if self.m.kind == BPE else self._search_unigram
        for lo in range(0, len(part), self.step):
            more = part[lo : lo + self.step]
            self.text = self.text + more if self.text else more
            search(len(self.text))
            self.done = len(self.text)
            if self.done >= self.step + self.m.longest:
                out += self._commit()
        return out

    def resume(self, text: str, same: int) -> list:
        """Ids of a text that equals the one before (of a resume) in its first ``same`` characters."""
        del self.back[same + 1 :], self.code[same + 1 :], self.best[same + 1 :]
        self.text, self.done = text, same
        (self._search_bpe if self.m.kind == BPE else self._search_unigram)(len(text))
        self.done = len(text)
        return self._trace(len(text))

    def finish(self) -> list:
        out = self._trace(len(self.text))
        self.reset()
        return out

    def reset(self) -> None:
        self.text, self.back, self.code, self.best, self.done = "", [0], [-1], [0.0], 0

    def _trace(self, end: int) -> list:
        back, code, out = self.back, self.code, []
        while end:
            i, start = code[end], back[end]
            if i >= 0:
                out.append(i)
            else:
                out.extend(reversed(self.m.without_piece(self.text[start:end])))
            end = start
        out.reverse()
        return out

    def _search_bpe(self, upto: int):
        text, back, code, ends, pairs = self.text, self.back, self.code, self.m.ends.get, self.m.pairs.get
        for e in range(self.done + 1, upto + 1):
            s, start, pick = e - 1, e - 1, -1
            while s >= 0:
                i = ends(text[s:e])
                if i is None:
                    break
                if i >= 0:
                    a = code[s]
                    # after a character without a piece, and at the start, every piece may stand
                    fits = True if a < 0 else pairs(a << 32 | i)
                    if fits if fits is not None else self.m.may_follow(a, i):
                        start, pick = s, i
                        break
                s -= 1
            back.append(start)
            code.append(pick)

    def _search_unigram(self, upto: int):
        m, text, best = self.m, self.text, self.best
        for e in range(self.done + 1, upto + 1):
            s, start, pick, top = e - 1, e - 1, -1, best[e - 1] + m.unknown_score
            while s >= 0:
                i = m.ends.get(text[s:e])
                if i is None:
                    break
                if i >= 0 and ((score := best[s] + m.scores[i]) >= top or pick < 0):
                    start, pick, top = s, i, score
                s -= 1
            best.append(top)
            self.back.append(start)
            self.code.append(pick)

    def _commit(self) -> list:
        """Trace all boundaries that a later piece may start from until they agree on one."""
        alive = set(range(self.done - self.m.longest, self.done + 1))
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            alive.add(self.back[far])
        meet = alive.pop()
        if not meet:
            return []
        out = self._trace(meet)
        self.text = self.text[meet:]
        self.back = [0, *(b - meet for b in self.back[meet + 1 :])]
        self.code = self.code[meet:]
        if self.m.kind == UNIGRAM:
            self.best = [b - self.best[meet] for b in self.best[meet:]]
        self.done -= meet
        return out


class Encoder:
    """Whole texts to packed ids. Parts that pieces can't cross are searched on their own and kept in a cache."""

    def __init__(self, model: Model, cache: int = CACHE, size: int = SLICE, group: int = GROUP):
        self.m, self.limit, self.cache, self.older = model, cache, {}, {}  # two generations, so that frequent parts stay
        self.size, self.group = size, group
        self.stream, self.sorted, self.single = Stream(model), Stream(model), Stream(model)  # the first may hold an open part
        hard = "".join(model.hard)
        self.part = re.compile(f"{MARK}*[^{MARK}{re.escape(hard)}]+|{MARK}+" + (f"|[{re.escape(hard)}]" if hard else "")) if model.splits else None
        self.rest = {False: re.compile(f"{MARK}*[^{MARK}{re.escape(hard)}]*"), True: re.compile(f"[^{MARK}{re.escape(hard)}]*")}

    def _split(self, text: str):
        """Lists of parts, or packed ids of (a piece of) one long part, in order."""
        if self.part is None:
            for piece in self.m.slices(text, self.size):
                yield array("i", self.stream.feed(piece)).tobytes()
            yield array("i", self.stream.finish()).tobytes()
            return
        carry, open_, worded = "", False, False  # open_: the stream holds the begin of a long part, worded: and it has more than marks
        for piece in self.m.slices(text, self.size):
            if open_:
                more = self.rest[worded].match(piece)[0]
                worded = worded or bool(more.strip(MARK))
                yield array("i", self.stream.feed(more)).tobytes()
                piece = piece[len(more) :]
                if not piece:
                    continue
                yield array("i", self.stream.finish()).tobytes()
                open_ = False
            parts = self.part.findall(carry + piece)
            carry = parts.pop()
            yield parts
            if len(carry) > LONG:
                yield array("i", self.stream.feed(carry)).tobytes()
                carry, open_, worded = "", True, bool(carry.strip(MARK))
                if self.m.hard and piece[-1] in self.m.hard:
                    worded = True
        if open_:
            yield array("i", self.stream.finish()).tobytes()
        elif carry:
            yield [carry]

    def _learn(self, new: set) -> None:
        """Ids of parts into the cache; in sorted order each search starts from what the one before has in common."""
        again = {p for p in new if p in self.older}
        if len(self.cache) + len(new) > self.limit:
            self.older, self.cache = self.cache, {}
            kept = self.older
        else:
            kept = None
        for p in again:
            self.cache[p] = (kept or self.older).get(p) or self._alone(p)
        before, stream, cache = "", self.sorted, self.cache
        for p in sorted(new - again):
            if len(p) > LONG:
                cache[p] = self._alone(p)
                continue
            k, n = 0, min(len(p), len(before))
            while k < n and p[k] == before[k]:
                k += 1
            cache[p] = array("i", stream.resume(p, k)).tobytes()
            before = p
        stream.reset()

    def _alone(self, part: str) -> bytes:
        return array("i", self.single.feed(part) + self.single.finish()).tobytes()

    def encode_many(self, texts: list) -> list:
        """Packed ids of each text (None for None)."""
        out: list = [None if t is None else [] for t in texts]
        held: list = []
        size = 0

        def flush():
            new = set()
            for _, items in held:
                new.update(items)
            needed = new
            new = new.difference(self.cache)
            if new:
                before = self.cache
                self._learn(new)
                if self.cache is not before:  # a new generation: what this group needs comes along
                    for p in needed - new:
                        self.cache[p] = before[p]
            get = self.cache.__getitem__
            for i, items in held:
                out[i].append(b"".join(map(get, items)))
            for p in new:
                if len(p) > 64:
                    del self.cache[p]
            held.clear()

        for i, text in enumerate(texts):
            for items in self._split(text) if text else ():
                if isinstance(items, bytes):
                    if held:
                        flush()
                        size = 0
                    out[i].append(items)
                else:
                    held.append((i, items))
            size += len(text or "")
            if size >= self.group and held:
                flush()
                size = 0
        if held:
            flush()
        return [None if x is None else self._joined(x) for x in out]

    def _joined(self, packed: list) -> bytes:
        data = b"".join(packed)
        if not self.m.bytes and data:
            data = np.array(_squash(np.frombuffer(data, np.int32).tolist(), self.m.unknown), np.int32).tobytes()
        return data

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


class Decoder:
    def __init__(self, model: Model):
        self.prefix = model.prefix
        self.table = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)]

    def decode(self, ids: list) -> bytes:
        data = b"".join(map(self.table.__getitem__, ids))
        return data[1:] if self.prefix and data.startswith(b" ") else data


def _encode(model: Model, column: str, result: str | None = None):
    def run(batches):
        encoder, table = Encoder(model), Decoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed = encoder.encode_many(part.column(part.schema.names.index(column)).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(p or b"") // 4 for p in packed])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([p is None for p in packed]))
                new = {"ids": ids}
                if result:
                    new[result] = pa.array([None if p is None else table.decode(np.frombuffer(p, np.int32).tolist()).decode(errors="replace") for p in packed], pa.string())
                yield with_columns(part, (), **new)

    return run


def _decode(table: Decoder, column: str, result: str):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                col = part.column(part.schema.names.index(column))
                flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                valid = col.is_valid().to_pylist()
                texts = [table.decode(flat[offsets[i] : offsets[i + 1]].tolist()).decode(errors="replace") if valid[i] else None for i in range(len(valid))]
                yield with_columns(part, (), **{result: pa.array(texts, pa.string())})

    return run


def load(model_file: str) -> Model:
    with open(model_file, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model_file: str, column: str = "text") -> DataFrame:
    """docs with ids (array of int). The driver reads the model (its size is fixed) and sends it with the tasks."""
    return docs.mapInArrow(_encode(load(model_file), column), schema_with(docs, (), ids=T.ArrayType(T.IntegerType())))


def encode_and_decode(docs: DataFrame, model_file: str, column: str = "text", result: str = "decoded") -> DataFrame:
    """docs with ids and the text that they stand for, in one pass."""
    schema = schema_with(docs, (), ids=T.ArrayType(T.IntegerType()), **{result: T.StringType()})
    return docs.mapInArrow(_encode(load(model_file), column, result), schema)


def decode(encoded: DataFrame, model_file: str, column: str = "ids", result: str = "decoded") -> DataFrame:
    """encoded with the text that its ids stand for."""
    return encoded.mapInArrow(_decode(Decoder(load(model_file)), column, result), schema_with(encoded, (), **{result: T.StringType()}))
