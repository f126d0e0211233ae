"""Operators 2, 7, 8 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fingerprints, graph, neardup, suffixes, vectors
from tallyloom.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(t, width):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute_components(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs}
    union = Union(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                union.join(a, b)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def near_copies(seed, bases, copies, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, words))]
        for _ in range(copies):
            t = base[:]
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            out.append(" ".join(t))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(spark, odd, width, percent):
    docs = list(enumerate(near_copies(width, 20, 12) + ["", None, "a b", "A  b", "a b"]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.join(df, width, percent).collect()}
    assert got == brute_components(docs, width, percent)


def test_jaccard_tiles(spark, monkeypatch):
    """A chain of texts, in one large group, whose ends are far apart; tiles of a few rows."""
    monkeypatch.setattr(graph, "TILE", 8)
    rnd = random.Random(9)
    words, docs = [f"v{i}" for i in range(100)], []
    for i in range(60):
        words[rnd.randrange(100)] = f"n{i}"
        docs.append((i, " ".join(words)))
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (90, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.join(df, 3, percent).collect()}
        assert got == brute_components(docs, 3, percent)


def test_jaccard_edges(odd, empty):
    rows = neardup.join(odd(), 3, 90).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == odd().count()
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 5, 0), (0, 5, 0), (8, 1, 8), (9, 1, 9), (None, 1, 9)} <= got
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert neardup.join(empty).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    rnd = random.Random(21)
    a, b, c = (" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(500)) for _ in range(60)) for _ in range(3))
    rows = [(8, a), (8, b), (3, b + " tail"), (4, a + " tail"), (8, c), (9, c), (9, c), (None, c), (None, "alone here now"), (None, "alone here now"), (5, ""), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(4)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in neardup.join(df, 3, 90).collect())
    assert got == sorted([(8, 4), (8, 3), (3, 3), (4, 4), (8, 8), (9, 8), (9, 8), (-1, 8), (-1, -1), (-1, -1), (5, 5), (5, 5), (6, 6)])
    kept = neardup.keep_one(df, 3, 90)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.where("text <> ''").collect()) == sorted([(3, b + " tail"), (4, a + " tail"), (8, c), (-1, "alone here now")])
    assert kept.where("text = '' or text is null").count() == 3


def test_tiles_hand_on_a_row_for_each_member(spark, monkeypatch):
    """A group of close but mostly unlike sets, and one in which all are alike: no pairs come out."""
    monkeypatch.setattr(graph, "TILE", 16)
    rnd = random.Random(4)
    base = [f"v{i}" for i in range(80)]
    docs = []
    for i in range(120):
        t = base[:]
        for k in rnd.sample(range(80), 5 if i % 2 else 3):
            t[k] = f"n{i}x{k}"
        docs.append((i, " ".join(t)))
    made = []
    honest = neardup.between
    monkeypatch.setattr(neardup, "between", lambda *a: made.append((out := honest(*a)).count()) or out)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.join(df, 1, 90).collect()}
    assert got == brute_components(docs, 1, 90)
    assert all(n < 1000 for n in made)


def test_sketch_distance_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    sketch = neardup.Sketch(80)
    for _ in range(200):
        n = int(rnd.integers(2, 200))
        a = np.unique(rnd.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(n * 0.08) :], rnd.integers(0, 1 << 60, int(n * 0.05)).astype(np.uint64))))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        cells = set(sketch.cells(len(a))) & set(sketch.cells(len(b)))
        assert cells
        for c in cells:
            x, y = sketch.blocks(a, c), sketch.blocks(b, c)
            wide = min(len(x), len(y))
            assert (x[:wide] == y[:wide]).any()
            assert np.bitwise_count((x[:wide] ^ y[:wide]).astype(np.uint32)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1064)]
    union = Union({x for link in links for x in link})
    for a, b in links:
        union.join(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in graph.components(df, Scratch(spark, "t"), "x").collect()}
    assert got == {x: union.find(x) for x in union.up}
    assert graph.components(df.limit(0), Scratch(spark, "t"), "x").count() == 0


def brute_vectors(rows, least=0.98):
    union, links = Union([r[0] for r in rows]), dict.fromkeys((r[0] for r in rows), 0)
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))]
    for k, (i, x, a) in enumerate(ok):
        for j, y, b in ok[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return {i: (links[i], union.find(i), union.find(i) == i) for i in links}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 16)
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((12, 32))
    rows = [(i, (base[i % 12] + rnd.standard_normal(32) * 0.04).astype(np.float32).tolist(), int(i % 12 % 3)) for i in range(240)]
    rows += [(300 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(9)]
    rows += [(400, None, 1), (401, [0.0] * 32, 1), (402, [float("nan")] * 32, 1), (403, [None] * 32, 1), (404, rows[0][1], None), (405, [], 1), (406, rows[0][1][:16], 0), (407, [float("inf")] * 32, 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.9 * there and all(got[i][0] <= want[i][0] for i in want)
    assert {i: g[1] for i, g in got.items()} == {i: w[1] for i, w in want.items()}
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(df.where("label is null")).first().n_links == 0


@pytest.mark.parametrize("setting", [{"RECALL": 1.1, "MOST_ROTATIONS": 4}, {"stacked": None}])
def test_vectors_beyond_the_tables_are_all_compared(spark, monkeypatch, setting):
    """Where no number of rotations is enough, and for vectors longer than the sample's, every link is found."""
    monkeypatch.setattr(graph, "TILE", 16)
    for k, v in setting.items():
        if v is not None:
            monkeypatch.setattr(vectors, k, v)
        else:  # a sample without the longer vectors
            monkeypatch.setattr(vectors, "least_hashed", lambda rows, *a: rows.where(F.size("e") < 24))
    rnd = np.random.default_rng(9)
    base = rnd.standard_normal((6, 24))
    rows = [(i, (base[i % 6] + rnd.standard_normal(24) * 0.13).astype(np.float32).tolist()[: 24 if i % 5 else 7], int(i % 2)) for i in range(120)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute_vectors(rows)
    assert sum(w[0] for w in want.values()) > 50 and got == want


def test_vector_ids_that_repeat_or_lack(spark):
    rows = [(8, [1.0, 0.0], 1), (8, [0.0, 1.0], 1), (3, [0.01, 1.0], 1), (4, [1.0, 0.01], 1), (None, [1.0, 0.02], 1), (-5, [0.7, 0.7], 1), (None, [-1.0, 0.0], 1)]
    got = sorted((r.vec_id if r.vec_id is not None else 99, r.n_links, r.component_id if r.component_id is not None else 99) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(8, 2, 4), (8, 1, 3), (3, 1, 3), (4, 2, 4), (99, 2, 4), (-5, 0, -5), (99, 0, 99)])


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rnd.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    for rows in (1000, 1 << 20, 1 << 26):
        model = vectors.learn(x[:1000], rows)
        assert model.substring == max(16, rows.bit_length())
        met = (model.codes(x) == model.codes(0.98 * x + np.sqrt(1 - 0.98**2) * side)).any(1)
        assert met.mean() > 0.97, rows
    assert vectors.learn(np.zeros((0, 8))).codes(np.ones((2, 8))).shape[0] == 2 and vectors.learn(x[:1, :3]).codes(x[:4, :3]).shape == (4, 4)


def brute_repeats(docs, width):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        windows = [raw[k : k + width] for k in range(len(raw) - width + 1)]
        cover = bytearray(len(raw))
        for k, w in enumerate(windows):
            if w in seen:
                cover[k : k + width] = b"\1" * width
        seen.update(windows)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out[i] = (len(raw), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(raw, cover, strict=True) if not c)).hexdigest())
    return out


def passages(seed, n):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcdefé ") for _ in range(rnd.randint(30, 160))) for _ in range(8)]
    shared += ["ab" * 60, "a" * 90, shared[0][:60] + shared[1][-40:]]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice([rnd.choice(shared), "".join(rnd.choice("ghijkl ñ") for _ in range(rnd.randint(0, 80)))]) for _ in range(rnd.randint(0, 8)))
        out.append(t[rnd.randint(0, 20) :])
    return out + ["", None, shared[0], shared[0]]


@pytest.mark.parametrize("width, crowd, block", [(50, 50_000, 1 << 20), (50, 1, 700), (24, 50_000, 300), (77, 2, 2000)])
def test_repeats(spark, monkeypatch, width, crowd, block):
    """Crowds that are halved down to single windows, and texts that are cut into parts."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SORT_WINDOWS", 100)
    monkeypatch.setattr(suffixes, "SCAN_BYTES", block)
    docs = list(enumerate(passages(width, 80)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(df, width).collect()}
    assert got == brute_repeats(docs, width)


def test_one_core_in_many_surroundings(spark, monkeypatch):
    """A string of 40 bytes in every document, with other bytes around it; now and then a whole window occurs again."""
    monkeypatch.setattr(suffixes, "CROWD", 500)
    rnd = random.Random(31)
    core = "the one string that all documents share "
    around = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    docs = [(i, around(rnd.randint(0, 12)) + core + around(rnd.randint(0, 12))) for i in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(df).collect()}
    want = brute_repeats(docs, 50)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 50


def test_long_texts_are_cut_and_whole(spark):
    rnd = random.Random(32)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3 << 20))
    rows = [(0, long), (1, "start " + long[(1 << 20) - 30 : (1 << 20) + 30] + " end"), (2, "x" + long), (3, None), (None, long), (-4, long[5:65])]
    got = {r.doc_id: r for r in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (60, 1) or got[1].n_removed > 60
    assert got[2].n_removed == len(long) and got[2].n_spans == 1 and got[0].n_removed == 60 and got[-4].n_removed == got[None].n_removed == 0


def test_repeats_edges(odd, empty):
    rows = suffixes.digests(odd()).collect()
    assert len(rows) == odd().count() and suffixes.digests(empty).count() == 0
    got = [(r.doc_id, r.n_removed) for r in rows]
    assert got.count((8, 0)) == 2 and (6, rows[0].n_bytes) not in got
    long = next(len(r.text) for r in odd().collect() if r.doc_id == 6)
    assert (6, long) in got and (1, 0) in got
    kept = suffixes.remove(odd(), 50)
    assert kept.columns == odd().columns
    assert {r.doc_id: r.text for r in kept.collect()}[6] == "" and kept.count() == odd().count()


def test_removal_keeps_whole_characters(spark):
    rows = [(0, "é" * 100), (1, "x" + "é" * 70 + "日本")]
    got = {r.doc_id: r.text for r in suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string"), 51).collect()}
    assert got[0] == "é" * 100 and set(got[1]) <= set("xé日本") and got[1].startswith("x") and got[1].endswith("日本")


def test_sorting_is_lexicographic():
    rnd = random.Random(6)
    rows = ["".join(rnd.choice("ab") for _ in range(50)) for _ in range(100)]
    rows += [r[:34] + "".join(rnd.choice("abc") for _ in range(16)) for r in rows for _ in range(3)] + rows[:20]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    for width in (50, 48, 33, 8, 5):
        position = np.concatenate((np.arange(len(rows)) * 50, np.array([3, 17, 60])))
        order, at = suffixes.deep_shallow(data, position, width)
        suffix = [data[i : i + width].tobytes() for i in position]
        assert [suffix[i] for i in order] == sorted(suffix)
        assert len(at) == len(set(suffix)) and all(suffix[order[k]] != suffix[order[k - 1]] for k in at[1:])
    first = np.array([0, 7, 8, 200])
    order, at = suffixes.deep_shallow(data, position, 50, first)
    for s, e in zip(first, [*first[1:], len(position)], strict=True):
        own = [data[i : i + 50].tobytes() for i in position[s:e]]
        assert [data[i : i + 50].tobytes() for i in position[order[s:e]]] == sorted(own) and set(first) <= set(at)
    tails = sorted({r[34:] for r in rows})
    rnd.shuffle(tails)
    assert [tails[i] for i in suffixes.blind_trie_order([t.encode() for t in tails])] == sorted(tails)


def naive_boundaries(data):
    ends, at, n = [], 0, len(data)
    h = []
    for i in range(n):
        v = 0
        for j in range(max(0, i - 31), i + 1):
            v = (v + (int(fingerprints.GEAR[data[j]]) << (i - j))) & 0xFFFFFFFF
        h.append(v >> 20)
    while n - at > fingerprints.LEAST:
        end = min(at + fingerprints.MOST, n)
        for k in range(at + fingerprints.LEAST, end):
            mask = fingerprints.STRICT if k < at + fingerprints.TARGET else fingerprints.LOOSE
            if h[k - 1] & mask == 0:
                end = k
                break
        ends.append(end)
        at = end
    return ends + ([n] if at < n else [])


def test_chunk_boundaries():
    rnd = random.Random(7)
    for n in (0, 1, 16, 17, 64, 300, 3000):
        data = bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
        assert not n or fingerprints.boundaries(data) == naive_boundaries(data)


def test_fingerprints(spark, odd, empty):
    docs = [(i, t) for i, t in enumerate(passages(3, 60))] + [(100, "last one here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in fingerprints.neighbours(df).collect()}
    order = sorted(docs)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = fingerprints.edited(t, following)
        assert (got[i].n_chars, got[i].edited_text) == (len(t), new)
        assert got[i].fingerprint == fingerprints.written(fingerprints.chunks(t)) and got[i].edited_fingerprint == fingerprints.written(fingerprints.chunks(new))
        assert got[i].near_next == fingerprints.similarity(got[i].fingerprint, fingerprints.written(fingerprints.chunks(following)))
        assert got[i].near_edited == fingerprints.similarity(got[i].fingerprint, got[i].edited_fingerprint)
    assert fingerprints.neighbours(odd()).count() == odd().count()
    assert fingerprints.neighbours(empty).count() == 0 and fingerprints.neighbours(odd(["only"])).first().edited_text == "onon"
    same = {r.fingerprint for r in fingerprints.fingerprint(odd()).collect() if r.doc_id in (5, 6)}
    assert len(same) == 1


def test_fingerprints_resist_shifts():
    rnd = random.Random(8)
    t = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    a, b = fingerprints.chunks(t), fingerprints.chunks(t[:9000] + " inserted " + t[9000:])
    assert fingerprints.containment(a, b) > 0.95
    assert fingerprints.containment(a, fingerprints.chunks(t[5000:9000])) > 0.9  # of the smaller set
    other = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    assert fingerprints.containment(a, fingerprints.chunks(other)) < 0.05


def test_no_operator_calls_local_checkpoints():
    import pathlib

    top = pathlib.Path(neardup.__file__).parent
    assert not any("localCheckpoint" in p.read_text() for p in top.glob("*.py"))
