"""Operators 1 and 3: against the tokenizers library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tallyloom.llm import bpe, packing, tokenizing  # noqa: E402

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PATHS = {n: public_tokenizers.path(n) for n in NAMES}


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    return tokenizers.Tokenizer.from_file(PATHS[request.param]), bpe.load(tokenizing.vocabulary(PATHS[request.param]))


def texts():
    rnd = random.Random(1)
    out = ["", " ", "   a", "a  ", "a   b", "x\n \ny", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ", "I'll we're don't", "日本語 😀", "x" * 3000, "ab" * 900 + "!" * 90, "12 34٣½Ⅻ", "\x1c\x85\x00", "é ﬁ"]
    return out + ["".join(rnd.choice("abcdeé \n\t'!.1Σ日\x1c　") for _ in range(rnd.randint(0, 50))) for _ in range(1500)]


def test_encoding_is_the_librarys(both):
    library, own = both
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), t


@pytest.mark.parametrize("values", [None, 1])
def test_part_table(monkeypatch, values):
    """Ids by the table, and where hashes of different parts meet (all that are equally long) without it."""
    if values:
        monkeypatch.setattr(bpe, "BYTE_VALUES", np.full(256, values, np.uint64))
    own = bpe.load(tokenizing.vocabulary(PATHS["byte_bpe_50k.json"]))
    table, some = bpe.PartTable(own, 50), texts()[:400]
    for batch in (some[:100], some[50:300], ["", ""], some):
        for t, ids in zip(batch, table.encode(batch), strict=True):
            assert ids.tolist() == own.encode(t), t


def test_compatibility_and_both_exact_mergers(both):
    _, own = both
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    flat, at = own.encode_words(words)
    for i, w in enumerate(words):
        symbols = w[:-1] + chr(ord(w[-1]) + 256) if own.end else w
        assert flat[at[i] : at[i + 1]].tolist() == own.merge_exactly(symbols) == own.merge_rows([symbols])[0].tolist()


def test_encode_and_decode_frames(spark, odd, empty):
    path = PATHS["byte_bpe_50k.json"]
    df = odd().withColumn("ids", F.lit("clash"))
    back = tokenizing.decode(tokenizing.encode(df, path), path)
    assert all((r.text or "") == r.decoded for r in back.collect())
    assert back.columns[-2:] == ["ids", "decoded"] and "extra" in back.columns
    assert tokenizing.encode(empty, path).count() == 0 and tokenizing.digests(empty, path).count() == 0


def test_digests(odd):
    library = tokenizers.Tokenizer.from_file(PATHS["word_bpe_49k.json"])
    want = set()
    for r in odd().collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in tokenizing.digests(odd(), PATHS["word_bpe_49k.json"]).collect()} == want


def check_packing(docs, rows, capacity=2048):
    library = tokenizers.Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    wanted = sorted(((r.doc_id is not None, r.doc_id or 0), tuple(library.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    lengths, sequences = {}, {}
    for p in rows:
        assert 0 < p.length <= capacity
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        lengths.setdefault(p.doc_id, 0)
        lengths[p.doc_id] += p.length
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= capacity
    by = {}
    for (known, doc), ids in wanted:
        by.setdefault(doc if known else None, []).append(ids)
    assert {k: sum(map(len, v)) for k, v in by.items()} == lengths
    for p in rows:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in by[p.doc_id])
    return sequences


def test_packing(spark, odd, empty, sf):
    path = PATHS["byte_bpe_50k.json"]
    check_packing(odd(), packing.pack(odd(), path).collect())
    assert packing.pack(empty, path).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, path).collect()
    sequences = check_packing(docs, rows)
    assert sum(p.length for p in rows) / (2048 * len(sequences)) > 0.97
    tied = odd(["same text"] * 500)
    assert len(check_packing(tied, packing.pack(tied, path).collect())) <= 2


def test_plans_use_every_piece_and_little_more():
    rnd = np.random.default_rng(1)
    for n in (1, 30, 4000):
        counts = {int(k): int(v) for k, v in zip(*np.unique(rnd.integers(1, 257, n), return_counts=True), strict=True)}
        used, sequences = {}, 0
        for items, copies in packing.plan(counts, 256):
            assert sum(k * v for k, v in items.items()) <= 256 and copies > 0
            sequences += copies
            for k, v in items.items():
                used[k] = used.get(k, 0) + v * copies
        assert used == counts
        if n == 4000:
            assert sequences * 256 < 1.03 * sum(k * v for k, v in counts.items())
    assert packing.plan({}, 256) == []


def test_knapsack_is_exhaustive():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        length = np.unique(rnd.integers(1, 12, 4))
        value = rnd.random(len(length))
        best = 0.0
        stack = [(0, 0, 0.0)]
        while stack:
            i, load, worth = stack.pop()
            best = max(best, worth)
            if i < len(length):
                stack += [(i + 1, load + k * length[i], worth + k * value[i]) for k in range((20 - load) // length[i] + 1)]
        got, taken = packing.knapsack(value, length, 20)
        assert got == pytest.approx(best) and taken @ length <= 20 and taken @ value == pytest.approx(got)
