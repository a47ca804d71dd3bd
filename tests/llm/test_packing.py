import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import DOCS, docs, write
from tokenizers import Tokenizer

from tallyrock.llm import packing


def placed(runs, size):
    """Sequences as lists of (offset, length), and the ranks of each length."""
    fill, ranks = {}, {}
    for length, a, b, first, per, at in runs:
        for r in range(a, b):
            ranks.setdefault(length, []).append(r)
            fill.setdefault(first + (r - a) // per, []).append((at + length * ((r - a) % per), length))
    return fill, ranks


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 64, 1024])
    counts = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 3000)))
    fill, ranks = placed(packing.plan(counts, size), size)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for pieces in fill.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= size
    # best fit decreasing over single pieces needs as many
    rooms = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(size - length)
    assert len(fill) == len(rooms)


@pytest.mark.parametrize("n, pieces", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (9, [(0, 1), (1, 4), (5, 4)])])
def test_cut(n, pieces):
    assert packing.cut(n, 4) == pieces


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_ids_are_those_of_the_tokenizer(library):
    fast = packing.Tokens()
    texts = [t or "" for _, t in DOCS] + ["<|endoftext|>", "a <|endoftext|> b", "  two  spaces\n\n\ttabs ", "don't I'LL we've", "‍﻿\x00", "１２３ ½ ²", "<|endoftext|><|endoftext|>", "\x1c \x1d\x85\u2028 x"]
    for t in texts:
        assert fast.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


@pytest.mark.parametrize("one", [" ", "\n", "\t \n", "7", "a", "é", "!", "\x1c", "word ", "a  "])
@pytest.mark.parametrize("tail", ["x", " x", "", "<|endoftext|> x", "\n"])
def test_ids_of_long_runs(library, monkeypatch, one, tail):
    """Runs beyond every bound, with the bounds drawn down."""
    monkeypatch.setattr(packing, "LONG_RUN", 64)
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", 100)
    fast = packing.Tokens()
    for head in ("", "x", "x ", " <|endoftext|>"):
        for n in (60, 64, 65, 500):
            t = head + one * n + tail
            assert fast.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, (head, n)


@pytest.mark.parametrize("one", [" ", "\n", "7", "a", " \n"])
def test_ids_of_a_million(library, one):
    t = "so " + one * 1_000_000 + "x"
    assert packing.Tokens().ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark, clashes=True))
    got = packing.op1_packing(spark, d).collect()
    tokens = packing.Tokens()
    want = Counter()
    for doc, text in DOCS:
        ids = [*tokens.ids(text or "").tolist(), packing.END_TOKEN]
        for k, (start, length) in enumerate(packing.cut(len(ids), packing.SIZE)):
            want[doc, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= packing.SIZE


def test_salts_and_empty(spark, monkeypatch):
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0
    monkeypatch.setattr(packing, "PIECES_PER_SALT", 3)
    got = packing.pack(packing.pieces(docs(spark, [(i, "same words here") for i in range(50)]))).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 50 and len({r.sequence_id for r in got}) == 1
