"""BPE against the tokenizers library; packing against its rules."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kgspark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    " \n\t ",
    "It's a\x1cb\x1fc\x85d ΑΣ İ ''s x's''t ½²Ⅷ５ <|endoftext|>foo <|startoftext|>",
    "é" * 3 + "é ́a ﷺ 中文字 한글 が 🙂🙂",
    "a" * 5000,
    "!'" * 3000,
    "ab3d" * 2000,
    "the quick brown fox " * 6000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(encoder, text):
    return np.concatenate([*encoder.encode(text), np.empty(0, "<u4")]).tolist()


def test_random_texts_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 100)  # many piece edges
    monkeypatch.setattr(bpe, "STEP", 16)
    encoder, rng = bpe.Encoder(PATH), random.Random(3)
    for alphabet, longest, count in (("aabcdehinorstt'ßéÉΣσİ 1٣²\x1c\x85 !?&-_́̀中가​🙂", 80, 800), ("aetnoh'", 2500, 40), ("abÉ'!?.12中ß", 2500, 20)):
        for _ in range(count):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
            assert _ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


def test_stream_holds_a_bounded_window():
    encoder = bpe.Encoder(PATH)
    stream, most, ids = bpe.WordStream(encoder), 0, []
    for _ in range(200):
        for part in stream.feed("abtheing" * 20):
            ids += part
        most = max(most, len(stream.held))
    assert most <= 2 * encoder.lookahead + 2 * bpe.STEP
    assert ids + stream.end() == encoder.finish(list("abtheing" * 4000))


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 2
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 3
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c")])


def test_round_trip_rows(spark, documents, library):
    rows = list(enumerate(ODD)) + [(1, ""), (None, "null id")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(documents(rows), PATH).collect()}
    expected = set()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        expected.add((i, len(ids), *digests))
    assert got == expected
    encoded = bpe.encode(documents(rows[:6]), PATH)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    assert back[3] == library.decode(library.encode(ODD[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(documents([]), PATH).count() == 0


def test_pieces_and_places(spark, documents, library):
    rng = random.Random(5)
    rows = list(enumerate(ODD)) + [(100 + i, "word " * rng.randint(0, 3000)) for i in range(150)] + [(0, None), (None, "x y")]
    rows += [(500 + i, "same length here") for i in range(700)]  # one hot length
    got = packing.pack_documents(documents(rows), PATH).collect()
    expected = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece in range(math.ceil(len(ids) / 2048)):
            part = ids[piece * 2048 : piece * 2048 + 2048]
            expected.append((i, piece, piece * 2048, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = math.ceil(sum(r.length for r in got) / 2048)
    assert len(by_sequence) <= least * 1.02 + 1
    assert packing.pack_documents(documents([]), PATH).count() == 0


def test_plan_fills_gaps_exactly():
    for counts, sequences in (({1500: 3, 548: 3}, 3), ({1000: 2, 600: 2, 448: 2}, 2), ({1000: 1, 500: 1, 300: 1, 248: 1}, 1), ({1024: 5}, 3), ({3: 1}, 1), ({}, 0)):
        assert packing.plan_packing(counts).sequences == sequences
