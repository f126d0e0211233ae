"""Operator 13: the counts by hand, the mixer in plain Python, what scores depend on, held-out texts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def corpus(n=300):
    """Texts whose next word often follows from the one before, rare words among them."""
    rnd = random.Random(5)
    syllable = lambda: rnd.choice("bdfgklmnprst") + rnd.choice("aeiou")
    vocabulary = ["".join(syllable() for _ in range(rnd.randint(1, 3))) for _ in range(150)]
    follow = {w: rnd.choices(vocabulary, k=3) for w in vocabulary}
    out = []
    for _ in range(n):
        words = [rnd.choice(vocabulary)]
        for _ in range(rnd.randint(5, 120)):
            words.append(rnd.choice(follow[words[-1]]) if words[-1] in follow and rnd.random() < 0.8 else "".join(syllable() for _ in range(5)) if rnd.random() < 0.2 else rnd.choice(vocabulary))
        out.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in words))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = corpus() + ["É é x\ty\x0bz\n", "", None, "   ", "w" * 5000 + " " + "w" * 5000 + " ok", "İ STRASSE ß"] + ["novelword"] * 14
    return list(enumerate(texts)) + [(3, "again the same id"), (None, "no id"), (None, None), (7, texts[7]), (7, texts[7])]


@pytest.fixture(scope="module")
def small(monkeypatch_module):
    monkeypatch_module.setattr(mixing, "SHARE", 1000)
    monkeypatch_module.setattr(mixing, "PRICED", 3000)


@pytest.fixture(scope="module")
def monkeypatch_module():
    with pytest.MonkeyPatch.context() as m:
        yield m


@pytest.fixture(scope="module")
def scored(spark, rows, small):
    df = spark.createDataFrame([(i, t, "a", 1.5) for i, t in rows], "doc_id long, text string, word string, bits double")
    return mixing.score(df.repartition(3)).collect()


def test_counts_and_base(rows, scored):
    train, fold = Counter(), lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    for i, t in rows:
        if fold(i) != 2:
            train.update([*words_of(t), " "])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        tokens = [*words_of(t), " "]
        want[(i, fold(i) == 2, len(tokens), sum(train[w] > 0 for w in tokens), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want
    assert any(r.held_out and r.n_known < r.n_tokens for r in scored)


def test_scores_do_not_depend_on_partitions(spark, rows, scored, small):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    again = mixing.score(df.repartition(1)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score)
    for a, b in zip(sorted(scored, key=key), sorted(again, key=key), strict=True):
        assert a.doc_id == b.doc_id and a.score == pytest.approx(b.score, abs=1e-4) and a.bits_per_byte == pytest.approx(b.bits_per_byte, abs=1e-4)
    same = {round(r.score, 4) for r in scored if r.doc_id == 7}
    assert len(same) == 1


def test_held_out_texts_beat_the_base(rows, scored):
    held = [r for r in scored if r.held_out and r.n_tokens > 20]
    assert len(held) > 20 and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in scored)
    sizes = {(i, t): len((t or "").encode()) for i, t in rows}
    for r in scored:
        if r.doc_id not in (3, None):
            assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / max(1, sizes[r.doc_id, rows[r.doc_id][1]]), abs=1e-5)


def some_model(rnd, words=40):
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(words)})
    counts = np.array([30, 20, *(rnd.randint(1, 200) for _ in names)])
    known = mixing.Dictionary([n.encode() for n in names], counts, int(counts.sum()), len(names) + 25, 0.6, (30, 24))
    r = np.random.default_rng(3)
    tables = mixing.Tables.of(r.normal(0, 1.5, (2, 1 << mixing.WORD_BITS)), r.integers(0, 4, (2, 1 << mixing.WORD_BITS)).astype(np.uint8))
    return names, known, tables, r.normal(0.3, 0.1, (mixing.WORD_GATES, mixing.WORD_INPUTS))


def plain_bits(known, tables, weights, text, segment, chunk):
    """The same mixing for one text, a decision at a time."""
    bits, total = mixing.WORD_BITS, 0.0
    contexts = [0xFFFFFFFF, 0xFFFFFFFF, *text.contexts.tolist()]
    mul = lambda a, b: (a * b) & 0xFFFFFFFF

    def slot(context, node, size):
        return mul(context ^ mul(node, 0x9E3779B1), 0x85EBCA6B) >> (32 - size)

    def stirred(h):
        h = mul(h ^ (h >> 16), 0x7FEB352D)
        h = mul(h ^ (h >> 15), 0x846CA68B)
        return h ^ (h >> 16)

    squash = lambda x: min(1 - mixing.LEAST, max(mixing.LEAST, 1 / (1 + math.exp(-x))))
    for start in range(0, len(text.symbols), segment):
        w = weights.copy()
        own = defaultdict(lambda: [0, 0])
        cells = [squash((c - mixing.CELLS // 2 + 0.5) / 1.5) for c in range(mixing.CELLS)]
        stop = min(len(text.symbols), start + segment)
        for at in range(start, stop, chunk):
            decisions = []
            for i in range(at, min(stop, at + chunk)):
                h1 = stirred((contexts[i + 1] + 1) & 0xFFFFFFFF)
                h2 = stirred(((mul(contexts[i + 1], 0x297A2D39) ^ mul(contexts[i], 0x1B873593)) + 2) & 0xFFFFFFFF)
                s = text.symbols[i]
                for k in range(known.starts[s], known.starts[s] + known.lengths[s]):
                    decisions.append((h1, h2, int(known.paths[k]) >> 1, int(known.paths[k]) & 1))
            moves, cell_moves = np.zeros_like(w), [0.0 for _ in cells]
            seen = [tuple(own[n % (1 << mixing.OWN_BITS)]) for _, _, n, _ in decisions]
            for d, (h1, h2, node, side) in enumerate(decisions):
                (x1, e1), (x2, e2) = (tables.take(k, np.array([slot(h, node, bits)])) for k, h in enumerate((h1, h2)))
                x = [known.odds[node], x1[0], x2[0], math.log((seen[d][1] + mixing.PRIOR) / (seen[d][0] + mixing.PRIOR))]
                gate = int(e1[0]) * 4 + int(e2[0])
                dot = sum(p * q for p, q in zip(w[gate], x, strict=True))
                p, c = squash(dot), max(0, min(mixing.CELLS - 1, math.floor(dot * 1.5) + mixing.CELLS // 2))
                q = (p + cells[c]) / 2
                total -= math.log2(q if side else 1 - q)
                moves[gate] += mixing.RATE * (side - p) * np.array(x)
                cell_moves[c] += side - cells[c]
            for _, _, node, side in decisions:
                own[node % (1 << mixing.OWN_BITS)][side] += 1
            w += moves
            cells = [min(1 - mixing.LEAST, max(mixing.LEAST, c + m / mixing.TRUST)) for c, m in zip(cells, cell_moves, strict=True)]
    return total


def test_lanes_do_what_one_text_does(monkeypatch):
    rnd = random.Random(8)
    names, known, tables, weights = some_model(rnd)
    monkeypatch.setattr(mixing, "SEGMENT", 50)
    monkeypatch.setattr(mixing, "CHUNK", 4)
    monkeypatch.setattr(mixing, "LANES", 3)
    texts = [mixing.read(" ".join(rnd.choice([*names, "unknown", "zzz"]) for _ in range(n)).encode(), known) for n in (0, 1, 7, 49, 50, 51, 130)]
    got = mixing.mixed(known, tables, weights, texts)
    assert got == pytest.approx([plain_bits(known, tables, weights, t, 50, 4) for t in texts], rel=2e-3)
    alone = [mixing.mixed(known, tables, weights, [t])[0] for t in texts]
    assert got == pytest.approx(alone, abs=1e-6)


def test_one_token_texts_sum_to_one():
    """Over all first tokens the mixer's probabilities sum to 1, and so do those of letters up to a length."""
    _, known, tables, weights = some_model(random.Random(4))
    start = [mixing.Text(np.array([s], np.int32), np.array([0], np.uint32), Counter()) for s in range(len(known.counts))]
    assert np.exp2(-mixing.mixed(known, tables, weights, start)).sum() == pytest.approx(1, abs=1e-4)
    r = np.random.default_rng(1)
    model = mixing.Letters(mixing.Tables.of(r.normal(0, 1, (4, 1 << mixing.LETTER_BITS)), r.integers(0, 4, (4, 1 << mixing.LETTER_BITS)).astype(np.uint8)), r.normal(0.3, 0.1, (mixing.LETTER_GATES, 4)))
    every = [bytes(w) for n in (1,) for w in itertools.product(range(256), repeat=n)]
    data = [w for w in every if w != b" "]
    first = model.bits([b"", *data])  # a word and the blank after it
    cost = np.array([model.bits([w + bytes([b]) for b in range(256)]) for w in (b"a", b"b")])
    assert (first > 0).all() and cost.shape == (2, 256) and len({*first.round(9)}) > 200
    whole = sum(np.exp2(-prefix_bits(model, w)) for w in every)
    assert whole == pytest.approx(1, abs=1e-4)


def prefix_bits(model, prefix):
    _, _, _, side, p = model.inputs([prefix])
    p = p[: 8 * len(prefix)]
    return float(-np.log2(np.where(side[: 8 * len(prefix)], p, 1 - p).astype(float)).sum())


def test_tree_and_prices():
    _, known, _, _ = some_model(random.Random(1))
    assert np.exp2(-known.lengths.astype(float)).sum() == pytest.approx(1)
    assert len({tuple(known.paths[s : s + n].tolist()) for s, n in zip(known.starts, known.lengths, strict=True)}) == len(known.counts)
    counts, spelt = np.array([1] * 20 + [2, 8] + [0] * 1024), np.full(1046, 10.0)
    spelt[:22] = 60
    assert np.exp2(-known.price(spelt, counts)).sum() < 1.05 and (known.price(np.array([5000.0]), np.array([0])) > 4999).all()


def test_repeats_of_rare_words():
    """The closed form is the product over the words in any order, and over all next words the process sums to 1."""
    _, known, _, _ = some_model(random.Random(1))
    text = mixing.read(b"xx yy XX zz xx", known)
    assert text.others == {b"xx": 3, b"yy": 1, b"zz": 1}
    for order in (["xx", "yy", "xx", "zz", "xx"], ["zz", "xx", "xx", "xx", "yy"]):
        want, seen = 0.0, Counter()
        for t, w in enumerate(order):
            if t:
                want -= math.log2((seen[w] - mixing.NEW if seen[w] else 1 + mixing.NEW * len([c for c in seen.values() if c])) / (t + 1))
            seen[w] += 1
        assert mixing.repeats(text.others.values()) == pytest.approx(want)
    assert mixing.repeats([]) == mixing.repeats([1]) == 0


def test_long_texts_are_read_in_parts():
    data = b" ".join(b"w%d" % (i % 700) for i in range(3000)) + b"\n" + b"x" * 3000
    assert b"".join(mixing.parts_of(data, 100)) == data and [w for p in mixing.parts_of(data, 100) for w in mixing.tokens(p)] == mixing.tokens(data)


def test_odd_rows(spark, odd, empty):
    out = mixing.score(odd())
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd().collect())
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3)) and all(math.isfinite(r.score) for r in got)
    assert mixing.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = mixing.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only.n_known, only.train_tokens, only.base_score, only.n_tokens) == (0, 0, 0.0, 3) and only.score < 0
    assert out.where(F.col("bits_per_byte") < 0).isEmpty()
