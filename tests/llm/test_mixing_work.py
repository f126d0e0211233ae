"""Operator 13: what its work is made of: words cut by Arrow, wide steps, tables of two bytes a slot."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import mixing


def known_of(words):
    counts = np.array([40, 20, *range(len(words), 0, -1)])
    return mixing.Dictionary(words, counts, int(counts.sum()), len(words) + 25, 0.6, (30, 24))


def odd_texts(n=400):
    rnd = random.Random(2)
    some = [b" ", b"  ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1f", b"\x00", b"\x85", b"\xc2\xa0", "é".encode(), "İ".encode(), "ẞ".encode(), b"\xff", b"A", b"Zz", b"word", b"x" * 90]
    return [b"", b" ", b"end", *(b"".join(rnd.choices(some, k=rnd.randint(0, 12))) for _ in range(n))]


@pytest.mark.parametrize("together", [1 << 20, 100])
def test_all_texts_are_cut_as_one_is(monkeypatch, together):
    monkeypatch.setattr(mixing, "TOGETHER", together)
    texts, known = odd_texts(), known_of([b"word", b"a", b"zz"])
    column = pa.array([None, *texts, b"cut off"], pa.binary()).slice(1, len(texts))
    got, others, owner = mixing.read_all(column, known)
    place = {w: i + 2 for i, w in enumerate(known.words)}
    rare = [[w for w in mixing.tokens(t) if w not in place] for t in texts]
    assert [t.symbols.tolist() for t in got] == [[*(place.get(w, mixing.ESCAPE) for w in mixing.tokens(t)), mixing.END] for t in texts]
    assert others.view(pa.binary()).to_pylist() == [w for r in rare for w in r]
    assert owner.tolist() == [k for k, r in enumerate(rare) for _ in r]
    number = {}
    for t, r in zip(got, rare, strict=True):
        assert t.contexts[t.symbols != mixing.ESCAPE].tolist() == t.symbols[t.symbols != mixing.ESCAPE].tolist()
        for w, c in zip(r, t.contexts[t.symbols == mixing.ESCAPE].tolist(), strict=True):
            assert c >= 1 << 31 and number.setdefault(w, c) == c
    assert len(set(number.values())) == len(number) > 100
    assert mixing.read(texts[-1], known).others == Counter(rare[-1])


def test_long_texts_are_cut_in_parts(monkeypatch):
    data, known = b" ".join(b"w%d" % (i % 700) for i in range(300_000)), known_of([b"w1", b"w2"])
    whole = mixing.read(data, known)
    monkeypatch.setattr(mixing, "TOGETHER", 1 << 30)
    at_once = mixing.read(data, known)
    assert len(data) > 1 << 20 and (whole.symbols == at_once.symbols).all() and (whole.contexts == at_once.contexts).all() and whole.others == at_once.others


def test_steps_are_wide():
    """Lanes of like length go together: a few long texts among short ones don't make every lane's steps narrow."""
    known, r = known_of([b"a", b"b", b"c"]), np.random.default_rng(1)
    tables = mixing.Tables.of(np.zeros((2, 1 << mixing.WORD_BITS)), np.zeros((2, 1 << mixing.WORD_BITS), np.uint8))
    sizes = [2000 if k % mixing.LANES == 0 else 30 for k in range(4 * mixing.LANES)]
    texts = [mixing.Text(r.integers(0, 5, n), np.zeros(n, np.uint32), Counter()) for n in sizes]
    calls, spread = [], mixing.spread
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "spread", lambda known, symbols: calls.append(len(symbols)) or spread(known, symbols))
        bits = mixing.mixed(known, tables, np.full((mixing.WORD_GATES, mixing.WORD_INPUTS), 0.3), texts)
    assert sum(calls) == sum(sizes) and (bits > 0).all()
    assert len(calls) < 2 * 2000 / mixing.CHUNK  # 500 where each of four groups waits for a long text


def test_tables_hold_two_bytes_a_slot():
    odds, evidence = np.array([[-30.0, -1.5, 0.0, 0.01, 12.3, 31.0]]), np.array([[3, 0, 1, 2, 3, 0]], np.uint8)
    tables = mixing.Tables.of(odds, evidence)
    found, bits = tables.take(0, np.arange(6))
    assert tables.slots.itemsize == 2 and found == pytest.approx(odds[0], abs=0.005) and bits.tolist() == evidence[0].tolist()
