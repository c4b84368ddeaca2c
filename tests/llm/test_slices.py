"""Encoding in slices and in sorted order, against whole searches and the library."""

import random

import numpy as np
import pytest

from gridloom.llm import pieces

from .test_table_operators import MODEL, as_unigram


@pytest.fixture(scope="module")
def data():
    if not MODEL.exists():
        pytest.skip("no model file")
    return MODEL.read_bytes()


def texts(seed, n=120):
    r = random.Random(seed)
    alphabet = ["the", "tion", "ing", "é", "日本", "\n", "\t", " ", "  ", "▁", "\x00", "🎉", "zq", "qz", ".", "aaaa"]
    return ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(n)] + ["x" * 5000, " " * 3000 + "a", "ab" * 900 + "\n" + "cd" * 900 + " end", "▁" * 700, "\n" * 600, "a b\n" * 400]


@pytest.mark.parametrize(("size", "group", "cache"), [(1, 1, 3), (7, 50, 40), (64, 10**9, 250_000), (1 << 16, 1 << 20, 250_000)])
@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_any_slices_give_the_library_s_ids(data, kind, size, group, cache):
    sentencepiece = pytest.importorskip("sentencepiece")
    raw = data if kind == "bpe" else as_unigram(data)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Model(raw)
    some = texts(size)
    packed = pieces.Encoder(model, cache, size, group).encode_many([*some, None])
    assert packed.pop() is None
    got = [np.frombuffer(p, np.int32).tolist() for p in packed]
    wrong = [(a, b) for a, b in zip(got, (library.encode(t) for t in some)) if a != b]
    if kind == "unigram":  # paths of equal score, up to single precision, may differ
        cost = lambda ids: sum(model.scores[i] for i in ids)
        wrong = [(a, b) for a, b in wrong if abs(cost(a) - cost(b)) > 1e-3 * max(1, len(a))]
    assert wrong == []


def test_normalising_in_slices_equals_the_whole(data):
    model = pieces.Model(data)
    for squeeze in (False, True):
        for prefix in (False, True):
            model.squeeze, model.prefix = squeeze, prefix
            for t in texts(3):
                for size in (1, 3, 10, 10**6):
                    assert "".join(model.slices(t, size)) == model.normalized(t)


def test_a_very_long_text_keeps_a_bounded_window(data):
    model = pieces.Model(data)
    encoder = pieces.Encoder(model)
    r = random.Random(9)
    word = "".join(r.choice("abcdefghij") for _ in range(300_000))
    text = "some words before " + word + " and after\n" + "the same words again " * 60_000
    most, feed = 0, encoder.stream.feed

    def watched(part):
        nonlocal most
        out = feed(part)
        most = max(most, len(encoder.stream.text))
        return out

    encoder.stream.feed = watched
    ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
    assert pieces.Decoder(model).decode(ids).decode() == text
    assert most < 4 * (256 + model.longest)
    sentencepiece = pytest.importorskip("sentencepiece")
    assert ids == sentencepiece.SentencePieceProcessor(model_proto=data).encode(text)


def test_encode_and_decode_in_one_pass(spark, data):
    rows = [(i, t, "own") for i, t in enumerate([None, "", "a b", "x" * 2000, "é\n 日"])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    one = pieces.encode_and_decode(df, str(MODEL)).collect()
    two = pieces.decode(pieces.encode(df, str(MODEL)), str(MODEL)).collect()
    assert sorted(map(str, one)) == sorted(str(r) for r in two)
    assert [r["decoded"] for r in one] == [t for _, t, _ in rows]
