"""Operators 11 and 12: brute force, bounds, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import infilling, negatives


def brute_negatives(rows, positives=5, negatives_=10, low=30, high=90):
    """rows: (id, vector, label). Python's whole numbers and sorts."""
    good = [(n, i, [int(np.floor(256 * v)) for v in x], y) for n, (i, x, y) in enumerate(rows) if i is not None and x is not None and y is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for n, i, x, y in good:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, z, strict=False)), j, m, w) for m, j, z, w in good if m != n]
        for s, p, _, _ in sorted(t for t in scored if t[3] == y)[:positives]:
            found = sorted(t for t in scored if t[3] != y and 30 * -s <= 100 * -t[0] <= 90 * -s)[:negatives_]
            out += [(i, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(found)]
    return sorted(out)


KIND = "vec_id long, embedding array<double>, label int, rid long, positives string"


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], KIND).repartition(parts)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("block", [(1, 1), (3, 50), (256, 8192)])
def test_negatives_against_brute_force(spark, monkeypatch, block):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((4, 6))
    rows = []
    for i in range(330):
        y = int(rnd.integers(4))
        rows.append((i * 20 % 3000, (centres[y] + rnd.standard_normal(6) * 0.7).round(1).tolist(), y))  # ids repeat, scores tie
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan")] * 6, 2), (None, [1.0] * 6, 1), (400, [1.0] * 6, None), (500, [], 1), (600, [2.0, 1.0], 2), (700, [3.0] * 9, 3), (800, [0.0] * 6, 0), rows[0], rows[0]]
    monkeypatch.setattr(negatives, "ANCHORS", block[0])
    monkeypatch.setattr(negatives, "ROWS", block[1])
    got = mined(spark, rows)
    assert len(got) > 500 and got == brute_negatives(rows)


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.95], 2), (4, [0.1], 2)]
    assert mined(spark, rows) == brute_negatives(rows) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_scores_are_exact():
    rnd = random.Random(2)
    for size in (10, 2**30, 2**45, 2**70):
        a, b = ([[rnd.randint(-size, size) for _ in range(5)] for _ in range(4)] for _ in range(2))
        a, b = ([[int(float(v)) for v in r] for r in m] for m in (a, b))
        want = [[max(-negatives.MOST, min(negatives.MOST, sum(x * y for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert negatives.inner(np.array(a, float), np.array(b, float)).tolist() == want
    assert negatives.ranges([10, -10, 0, 7], 30, 90) == [(3, 9), (-3, -9), (0, 0), (3, 6)]


def brute_infilling(doc_id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    return (len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def test_infilling_against_brute_force(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abzAZ019 \n\t.é日😀<>PSM\u0301") for _ in range(rnd.randint(0, 120))) for _ in range(1500)]
    texts += ["a" * 100_000, "é" * 50_000, "a b" * 40_000, "<P>", "x<S>y", "<M", "<P", "<<S", "a<P", "\x00", "😀", None, "", "[@`{/"]
    rows = list(enumerate(texts)) + [(None, "no id at all"), (None, None)]
    df = spark.createDataFrame([(i, t, "n", "f") for i, t in rows], "doc_id long, text string, n string, form string").repartition(3)
    out = infilling.transform(df, salt="1")
    got = infilling.restore(out.withColumn("restored", F.lit(3))).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r[2:7]) == brute_infilling(r.doc_id, r.text), r.doc_id
        assert r.restored == (r.text or "")


def test_ranked_marks():
    rnd = random.Random(9)
    for width in (1, 63, 64, 65, 1000, 100_000):
        marks = rnd.getrandbits(width) | 1
        places = [i for i in range(width) if marks >> i & 1] if width <= 1000 else [m.start() for m in re.finditer("1", bin(marks)[:1:-1])]
        for k in {0, len(places) - 1, len(places) // 2, len(places) // 3}:
            assert infilling.nth(marks, k, width) == places[k]


def test_infilling_keeps_other_columns(odd, empty):
    out = infilling.transform(odd())
    assert out.columns == [c for c in odd().columns if c != "n"] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.count() == odd().count() and infilling.transform(empty).count() == 0 and infilling.restore(out).where("restored <> coalesce(text, '')").isEmpty()
    with pytest.raises(ValueError):
        infilling.transform(odd(), output="text")
