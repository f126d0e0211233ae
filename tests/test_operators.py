"""Operators on small tables: published values, brute force, edge cases."""

import random
import threading
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import assemble, boundary, chatml, clean, config, evaluate, history, match, sample, stats
from tallyloom.plans import pipelines
from tallyloom.plans.roundtrips import Repeater
from tallyloom.schemas import SCORES
from tallyloom.sources import writers
from tallyloom.streaming import incremental

ASPECTS = "array<struct<term:string,category:string,polarity:string>>"


def scored(spark, rows):
    flat = lambda xs: [(x, None, None) if isinstance(x, str) else x for x in xs]
    return spark.createDataFrame([(i, flat(p), flat(g)) for i, (p, g) in enumerate(rows)], f"i int, predicted {ASPECTS}, gold {ASPECTS}")


def test_published_term_metrics(spark):
    df = scored(spark, [(["telefon", "batareya"], ["telefon", "ekran"]), (["narx"], ["narx", "sifat"])])
    r = evaluate.term_metrics(df).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 2) and [round(x, 4) for x in (r.precision, r.recall, r.f1)] == [0.6667, 0.5, 0.5714]


@pytest.mark.parametrize("n, m, tp, want", [(839, 721, 515, (0.6138, 0.7143, 0.6603)), (757, 721, 484, (0.6394, 0.6713, 0.6549)), (933, 721, 499, (0.5348, 0.6921, 0.6034)), (839, 721, 601, (0.7163, 0.8336, 0.7705))])
def test_published_scores_from_counts(spark, n, m, tp, want):
    r = evaluate.micro(spark.createDataFrame([(tp, n - tp, m - tp)], "tp long, fp long, fn long")).first()
    assert tuple(round(x, 4) for x in (r.precision, r.recall, r.f1)) == want


def test_metrics_at_the_edges(spark):
    for rows in ([], [([], [])], [([], ["a"])], [(["a"], [])]):
        r = evaluate.term_metrics(scored(spark, rows)).first()
        assert r.f1 == 0.0
    df = scored(spark, [([("A ", None, "positive"), ("a", None, "negative"), ("b", None, "")], [("a", None, "negative"), ("b", None, "positive")])])
    m = evaluate.matched_polarities(df).collect()
    assert [(x["is"], x["should"]) for x in m] == [("negative", "negative")]
    r = evaluate.pair_metrics(df).first()
    assert (r.tp, r.total_predictions, r.total_references) == (1, 3, 2)


def test_partial_matches(spark):
    r = evaluate.term_metrics(scored(spark, [(["a", "ab", "x"], ["abc", "a"])]), partial=True).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1)


def macro(pairs):
    out = []
    for label in {x for p in pairs for x in p}:
        tp, fp, fn = (sum(f(a, b) for a, b in pairs) for f in (lambda a, b: a == b == label, lambda a, b: a == label != b, lambda a, b: a != label == b))
        out.append(2 * tp / (2 * tp + fp + fn))
    return sum(out) / len(out)


def test_macro_f1(spark):
    rnd = random.Random(3)
    pairs = [(rnd.choice("pnu"), rnd.choice("pnnx")) for _ in range(200)]
    df = spark.createDataFrame(pairs, "`is` string, should string")
    assert evaluate.sentiment_macro_f1(df).first().macro_f1 == pytest.approx(macro(pairs))
    assert evaluate.sentiment_accuracy(df).first().accuracy == pytest.approx(sum(a == b for a, b in pairs) / 200)


#: Published counts: reviews of each domain, and the sample that was drawn of 300.
DOMAINS = {"Restoran/Ovqatlanish": 1600, "Bank/Moliya": 900, "Telekommunikatsiya": 300, "Tibbiyot/Sog'liqni saqlash": 109, "Ta'lim": 100, "Boshqa": 509, "tiny": 2, "E": 1}


def test_allocation(spark):
    df = spark.createDataFrame([(d,) for d, n in DOMAINS.items() for _ in range(n)], "business_category string")
    got = {r.domain: r.target for r in sample.allocation(df).collect()}
    assert got == {"Restoran/Ovqatlanish": 50, "Bank/Moliya": 30, "Telekommunikatsiya": 25, "Tibbiyot/Sog'liqni saqlash": 25, "Ta'lim": 20, "Boshqa": 149, "tiny": 3, "E": 3}
    assert sample.allocation(df.limit(0)).count() == 0
    low = {r.domain: r.target for r in sample.allocation(df, size=100).collect()}
    assert set(low) == set(list(DOMAINS)[:5])


def test_stratified_sizes_and_repeatability(spark):
    df = spark.createDataFrame([(i, "a" if i < 5000 else "b") for i in range(5002)], "id int, business_category string")
    one, two = ({r.id for r in sample.stratified(df.repartition(n), "id", size=100, targets={"a": 40}).collect()} for n in (2, 5))
    assert one == two and len([i for i in one if i < 5000]) == 40 and len(one) == 42


@pytest.mark.parametrize("n, val", [(6089, 609), (99, 10), (1, 1), (0, 0)])
def test_split_sizes(spark, n, val):
    rows = {r.split: r["count"] for r in sample.split(spark.range(n), "id").groupBy("split").count().collect()}
    assert rows.get("validation", 0) == val and sum(rows.values()) == n


#: Published histograms of 307 judgements, their means and tiers.
HISTOGRAM = {"completeness": (7, 33, 158, 73, 36), "accuracy": (0, 0, 12, 138, 157), "sentiment": (19, 21, 37, 28, 202), "relevance": (0, 10, 69, 122, 106), "overall": (3, 23, 86, 132, 63)}


def test_published_judge_report(spark):
    columns = [[k + 1 for k, n in enumerate(HISTOGRAM[s]) for _ in range(n)] for s in SCORES]
    rows = [(f"d{i % 3}", r) for i, r in enumerate(zip(*columns, strict=True))]
    df = spark.createDataFrame(rows, "business_category string, judge_scores struct<" + ",".join(f"{s}:int" for s in SCORES) + ">")
    total = stats.judge_means(df).where("over_all = 1").first()
    assert [round(total[s], 2) for s in SCORES] == [3.32, 4.47, 4.21, 4.06, 3.75] and total.n == 307
    assert {r.dimension: tuple(r[f"n{k}"] for k in range(1, 6)) for r in stats.score_histogram(df).collect()} == HISTOGRAM
    assert tuple(stats.tier_counts(df).first()) == (195, 86, 26)
    assert stats.report_lines(stats.judge_means(df)).count() == 4


def test_clean_keeps_the_first(spark):
    texts = ["same text here", None, "", "   ", "nine char", "ten chars.", "  8 strip  ", "same text here", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ordinal long, review_text string")
    assert sorted(r.ordinal for r in clean.clean(df.repartition(3)).collect()) == [0, 5, 6]
    assert tuple(clean.stage_counts(df).first()) == (9, 7, 5, 4, 3)
    assert clean.first_of_each(df, "review_text").count() == 7
    assert clean.clean(df.limit(0)).count() == 0


def test_ids_are_dense(spark):
    df = spark.range(500).select((F.col("id") * 7).alias("ordinal"), F.concat(F.lit("some text "), F.col("id") % 400).alias("review_text"), F.lit("x").alias("object_name"))
    categories = spark.createDataFrame([("x", "cat")], "object_name string, business_category string")
    got = clean.prepare(df.repartition(6), categories).orderBy("ordinal").collect()
    assert [r.review_id for r in got] == [f"rev_{i:05d}" for i in range(400)]


def brute_fuzzy(raw, ann):
    want = {}
    for i, r in enumerate(raw):
        best = max(((SequenceMatcher(None, r.strip().lower(), a.lower()).ratio(), -j) for j, a in enumerate(ann) if a is not None), default=(0, 0)) if r is not None else (0, 0)
        if best[0] > 0.95:
            want[i] = (-best[1], best[0])
    return want


def fuzzy_rows(spark, raw, ann):
    make = lambda rows, a, b: spark.createDataFrame(list(enumerate(rows)), f"{a} int, {b} string").repartition(3)
    return {r.i: (r.annotated_index, r.match_score) for r in match.fuzzy(make(raw, "i", "t"), make(ann, "j", "u"), "i", "t", "j", "u").collect()}


def test_fuzzy_is_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.choice([0, 5, 19, 20, 30, 60, 199, 220]))) for _ in range(40)]
    near = lambda t: "".join(c if rnd.random() > 0.02 else rnd.choice("xyz") for c in t)
    raw, ann = [near(rnd.choice(base)) + " " for _ in range(80)], [near(b).upper() for b in base for _ in range(2)]
    want = brute_fuzzy(raw + [None], ann + [None])
    assert len(want) > 20 and fuzzy_rows(spark, raw + [None], ann + [None]) == want


def test_fuzzy_on_texts_of_one_vocabulary(spark):
    """Texts of a few frequent words, over 200 characters, which difflib takes for junk; edits are put in everywhere."""
    rnd = random.Random(7)
    words = ["the", "of", "and", "that", "in", "service", "room", "good", "not", "was"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([4, 15, 60, 150]))) for _ in range(25)]

    def edited(t):
        out = list(t)
        for _ in range(rnd.randint(1, max(1, len(t) // 18))):
            k = rnd.randrange(len(out))
            out[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "é", "😀", "E"])
        return "".join(out)

    raw, ann = [edited(rnd.choice(base)) for _ in range(80)], base + [edited(b) for b in base]
    want = brute_fuzzy(raw, ann)
    assert 10 < len(want) < 80 and fuzzy_rows(spark, raw, ann) == want


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
        assert match.common_subsequence(a, b) == row[-1]
    assert match.common_subsequence("é" * 5000 + "x", "é" * 5000) == 5000


def test_difflib_sees_few_pairs():
    """The bound turns away what shares its characters with a text but not their order."""

    class Counting(SequenceMatcher):
        calls = 0

        def ratio(self):
            Counting.calls += 1
            return super().ratio()

    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(words, 60)) for _ in range(20)]
    for y in texts:
        matcher = Counting()
        matcher.set_seq2(y)
        assert [match.ratio_above(matcher, x, y, 0.95) > 0.95 for x in texts] == [x == y for x in texts]
    assert Counting.calls == 20


def test_few_pairs_are_candidates(spark):
    """Of texts of the same words in other orders only edited ones meet, though each frequent word is in all of them."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(3000)]
    common = words[:20]
    texts = [" ".join(rnd.choice(common) if rnd.random() < 0.6 else rnd.choice(words) for _ in range(150)) for _ in range(300)]
    xs = spark.createDataFrame([(i, t[: len(t) // 2] + "#" + t[len(t) // 2 + 3 :]) for i, t in enumerate(texts)], "i int, x string")
    ys = spark.createDataFrame(list(enumerate(texts)), "j int, y string")
    got = {(r.i, r.j) for r in match.candidates(xs, ys).collect()}
    assert {(i, i) for i in range(300)} <= got
    assert len(got) < 400


def test_one_block_is_difflib():
    """Where the common beginning or end is said to be all that difflib finds, it is; rare letters run into the edit or not."""
    rnd, sure = random.Random(11), 0
    for _ in range(3000):
        y = "".join(rnd.choice("abcd" * 8 + "xyz" + "éq" * rnd.randint(0, 1)) for _ in range(rnd.choice([0, 1, 30, 199, 200, 260, 400])))
        other = "".join(rnd.choice("#xa") for _ in range(rnd.randint(0, 3)))
        x = rnd.choice([y + other, other + y[rnd.randint(0, 3) :], y[: len(y) - rnd.randint(0, 3)] + other, other + y + other])
        got = match.one_block(x, y)
        sure += got is not None
        assert got is None or got == SequenceMatcher(None, x, y).ratio(), (x, y)
    assert sure > 1000


def test_one_block_knows_texts_without_rare_letters():
    """difflib was asked for each of them."""
    rnd = random.Random(18)
    for y in repeated_words(rnd, 100):
        x = rnd.choice(["#" + y[1:], y[:-3] + "##", y[:50] + "#" + y[50:], y + y[:9]])
        got, junk = match.one_block(x, y), all(y.count(c) > len(y) // 100 + 1 for c in set(y)) and len(y) >= 200
        assert got == SequenceMatcher(None, x, y).ratio() if junk else got is None or got == SequenceMatcher(None, x, y).ratio()


def test_near_texts_are_matched_by_few_segments(spark, monkeypatch):
    """Texts that differ by a character write a few rows each; all were cut as fine as the lowest ratio asks, 150 rows each."""
    rnd, rows = random.Random(12), []
    texts = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(1000)) for _ in range(100)]
    once = match.once

    def counted(df):
        held = once(df)
        rows.append(held.count())
        return held

    monkeypatch.setattr(match, "once", counted)
    got = fuzzy_rows(spark, [t + "#" for t in texts], texts)
    assert got == {i: (i, 2000 / 2001) for i in range(100)}
    assert sum(rows) < 40 * len(texts)


def test_rounds_leave_no_match_out(spark):
    """Best matches just above and below each ratio that is looked for first."""
    rnd = random.Random(13)
    base = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150)) for _ in range(20)]
    base += [t * 3 + "".join(rnd.choice("abcdefgh") for _ in range(1000)) for t in base[:6]]

    def edited(t, n):
        for _ in range(n):
            k = rnd.randrange(len(t))
            t = t[:k] + rnd.choice("#ABé") + t[k + rnd.randint(0, 1) :]
        return t

    raw = [edited(t, max(1, int(len(t) * share))) for t in base for share in (0.001, 0.012, 0.018, 0.045, 0.06)]
    want = brute_fuzzy(raw, base)
    assert len(want) > 60 and fuzzy_rows(spark, raw, base) == want


def repeated_words(rnd, n):
    """Texts of a few words, each many times in turn: difflib takes their letters for junk."""
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    return [" ".join(w for w in rnd.sample(words, rnd.randint(3, 6)) for _ in range(rnd.randint(12, 20))) for _ in range(n)]


def test_texts_that_difflib_sees_nothing_in_write_few_rows(spark, monkeypatch):
    """Texts with another first character but no match were cut into some hundred segments; each place of one was a row."""
    rnd, rows, once = random.Random(14), [], match.once
    texts = repeated_words(rnd, 60)
    raw = ["#" + t[1:] if k % 3 else t + "#" for k, t in enumerate(texts)]
    want = brute_fuzzy(raw, texts)

    def counted(df):
        held = once(df)
        rows.append(held.count())
        return held

    monkeypatch.setattr(match, "once", counted)
    assert 20 <= len(want) < 40 and fuzzy_rows(spark, raw, texts) == want
    assert sum(rows) < 40 * len(texts)


def test_block_and_ratio_order_leave_no_match_out(spark, monkeypatch):
    """Many small blocks, with and without the rounds of high ratios before; best matches of few and of many edits."""
    rnd = random.Random(15)
    base = repeated_words(rnd, 12) + ["".join(rnd.choice("abcdefghijklmnopqrst ") for _ in range(rnd.choice([12, 25, 90, 400]))) for _ in range(30)]
    raw = [rnd.choice(base) for _ in range(70)]
    for k, t in enumerate(raw):
        for _ in range(rnd.choice([1, 2, 3, 1 + len(t) // 50])):
            at = rnd.randrange(len(t))
            t = t[:at] + rnd.choice(["", "#", "é"]) + t[at + rnd.randint(0, 1) :]
        raw[k] = t
    ann = base + [t[:9] + "b" + t[10:] for t in base]
    want = brute_fuzzy(raw, ann)
    monkeypatch.setattr(match, "BLOCK", 20_000)
    assert 20 < len(want) < 70 and fuzzy_rows(spark, raw, ann) == want
    monkeypatch.setattr(match, "PASSES", 0)
    assert fuzzy_rows(spark, raw, ann) == want


def test_pieces_meet_wherever_few_edits_are():
    rnd, cut, all_set = random.Random(16), match.Pieces(), np.full(1 << 12, 255, np.uint8)
    codes = lambda t: (np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64), np.array([len(t)]))
    for _ in range(2000):
        x = y = "".join(rnd.choice("ab") for _ in range(rnd.randint(3, 30)))
        for _ in range(rnd.randint(0, match.EDITS)):
            at = rnd.randint(0, len(y))
            y = y[:at] + rnd.choice("ab") + y[at:] if rnd.random() < 0.5 else y[:at] + y[at + 1 :]
        if y:
            assert np.intersect1d(cut.of_raw(*codes(x))[1], cut.of_annotated(*codes(y), all_set, (1 << 15) - 1)[1]).size, (x, y)


def test_a_quarter_of_long_texts_tells_most_apart():
    """It turns away what the whole does; other texts of the same words cost a full comparison of each character."""
    rnd, asked, whole = random.Random(19), [], match.common_subsequence
    words = ["".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(600)) for _ in range(6)]
    for k in range(24):
        t = texts[k % 6]
        for _ in range(rnd.choice([1, len(t) // 30, len(t) // 19, len(t) // 12])):
            at = rnd.choice([0, 40, rnd.randrange(len(t))])
            t = t[:at] + rnd.choice(["", "#"]) + t[at + rnd.randint(0, 1) :]
        texts.append(t)
    match.common_subsequence = lambda a, b: asked.append(len(b)) or whole(a, b)
    try:
        got = {(x, y): match.may_exceed(x, y, 0.95) for x in texts for y in texts}
    finally:
        match.common_subsequence = whole
    assert got == {(x, y): 2 * whole(x, y) / (len(x) + len(y)) > 0.95 for x in texts for y in texts}
    assert sum(n > 1500 for n in asked) < len(got) // 2


def test_block_turns_away_no_match():
    rnd = random.Random(17)
    texts = repeated_words(rnd, 40) + ["".join(rnd.choice("abcdefghijklmnopqrst ") for _ in range(rnd.choice([0, 3, 40, 300, 900]))) for _ in range(80)]
    block = match.Block(list(range(len(texts))), texts, 0.95)
    met = 0
    for t in texts:
        for _ in range(rnd.randint(0, len(t) // 15)):
            at = rnd.randrange(len(t))
            t = t[:at] + rnd.choice(["", "x"]) + t[at + rnd.randint(0, 1) :]
        got = {block.ids[k] for k in block.near_to(t)}
        assert {k for k, x in enumerate(texts) if len(x) + len(t) and 2 * match.common_subsequence(x, t) / (len(x) + len(t)) > 0.95} <= got
        met += len(got)
    assert met < 400


def test_exact_match(spark):
    raw = spark.createDataFrame([(0, " a "), (1, "b"), (2, None)], "i int, t string")
    ann = spark.createDataFrame([(5, "a"), (3, "a\n"), (4, "c"), (6, None)], "j int, u string")
    assert [(r.i, r.annotated_index, r.match_score) for r in match.exact(raw, ann, "t", "u", "j").collect()] == [(0, 3, 1.0)]


def test_history(spark):
    rnd = random.Random(5)
    loss = [rnd.random() for _ in range(50)]
    rows = [("r", i, i, v, None, None) for i, v in enumerate(loss)] + [("r", 100, 20, None, 0.5, None), ("r", 101, 40, None, 0.4, None), ("r", 102, 60, None, 0.4, None), ("r", 103, 60, 0.7, None, 9.0)]
    df = spark.createDataFrame(rows, "run_id string, seq long, step int, train_loss double, eval_loss double, train_runtime double").repartition(4)
    s = history.summary(df).first()
    assert (s.n_train, s.first_loss, s.final_loss, s.last_step_loss, s.min_loss, s.best_eval_loss, s.best_eval_step) == (51, loss[0], 0.7, loss[-1], min(loss), 0.4, 40)
    e = loss[0]
    for v in [*loss[1:], 0.7]:
        e = 0.1 * v + 0.9 * e
    assert history.ema_last(df).first().ema == pytest.approx(e) and history.ema(df).orderBy(F.desc("seq")).first().ema == pytest.approx(e)
    assert [r.best for r in history.running_best(df).orderBy("seq").collect()] == [0.5, 0.4, 0.4]
    assert history.by_step(df, ["r"]).orderBy("step").first().r == 0.5


def test_merge_and_tiers(spark):
    ann = spark.createDataFrame([("a", 0, None), ("b", 1, [("t", None, "positive")]), ("c", 2, [])], f"review_id string, ordinal int, aspects {ASPECTS}").withColumns({"business_category": F.lit(None).cast("string"), "text": F.lit("x"), "business_name": F.lit("n"), "user_rating": F.lit(1), "num_aspects": F.lit(1), "annotation_source": F.lit("m")})
    s = spark.createDataFrame([("a", (4, 4, 4, 4, 4, "")), ("b", (1, 1, 1, 1, None, ""))], "review_id string, judge_scores struct<" + ",".join(f"{k}:int" for k in SCORES) + ",explanation:string>")
    m = assemble.merge_scores(ann, s).persist()
    assert {r.review_id: (r.quality_tier, r.judge_overall) for r in m.collect()} == {"a": ("include", 4), "b": ("exclude", 0), "c": ("unjudged", None)}
    assert {r.review_id for r in assemble.silver(m).collect()} == {"a", "c"}
    d = assemble.dataset_stats(m).first()
    assert (d.total, d.judged, d.total_aspects, d.polarity_counts, d.business_category_counts) == (3, 2, 1, {"positive": 1}, {"Boshqa": 3})
    assert len(assemble.published(m).columns) == 9


def test_memory_and_batches(spark):
    r = spark.range(1).select(config.memory(F.lit(7.0), F.lit(2048), F.lit(1), F.lit(4)).alias("m"), config.batch_for_memory(F.lit(45.0)).alias("b"), config.resolve(F.lit("q"), {"q": "full"}).alias("n")).first()
    assert [round(x, 2) for x in r.m] == [3.26, 1.63, 0.03, 4.92] and (r.b, r.n) == (4, "full")
    d = spark.createDataFrame([("h", 0, "NVIDIA RTX 4090", 24.0), ("h", 1, "NVIDIA L40", 48.0), ("cpu", None, None, None)], "host string, device int, name string, memory_gb double")
    assert {x.host: (x.num_gpus, x.batch_size, x.grad_accum, x.device_map) for x in config.recommend(d).collect()} == {"h": (2, 4, 2, "auto"), "cpu": (0, 1, 8, "cpu")}


def test_calls_take_some_rows_at_a_time(spark):
    """A call without a size had the prompts of a whole Arrow batch, 3000 here, all of them Python strings at once."""
    df = spark.range(3000).select("id", F.concat(F.lit("p"), F.col("id")).alias("prompt"), F.lit("old").alias("answer")).coalesce(1)
    got = boundary.ask(df, "prompt", "answer", lambda: lambda prompts: [f"{len(prompts)} {p}" for p in prompts]).collect()
    assert [r.answer.split()[1] for r in got] == [f"p{i}" for i in range(3000)] and got[0].__fields__ == ["id", "prompt", "answer"]
    assert max(int(r.answer.split()[0]) for r in got) <= boundary.ROWS


def test_stand_in_judge_forgets_what_it_answered():
    """It kept every prompt of a partition."""
    judge, prompts = Repeater(), [f"{i} User rating: {i % 5 + 1}/5" for i in range(50)]
    for some in (prompts, [*prompts, prompts[0]]):
        assert all(a.startswith("Sorry") for a in judge(some)) and judge.asked == set(some)
        assert not any(a.startswith("Sorry") for a in judge(some)) and not judge.asked


def test_boundary_tries_again(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "i int, prompt string").coalesce(1)

    def make():
        seen = set()

        def client(prompts):
            out = [p if p in seen or p != "p3" else None for p in prompts]
            seen.update(prompts)
            return out

        return client

    got = boundary.ask(df, "prompt", "answer", make, sleep=lambda s: None).orderBy("i").collect()
    assert [r.answer for r in got] == [f"p{i}" for i in range(5)]
    assert [boundary.backoff(k) for k in range(5)] == [5, 10, 20, 40, 60]


def test_flows(spark):
    rows = [(i, f"some review text {i}", "x", 5.0, '{"aspects": [{"term": "narx", "category": "c", "polarity": "positive"}]}' if i % 3 else "?", '{"completeness": 4, "accuracy": 4, "sentiment": 4, "relevance": 4, "overall": 4}') for i in range(60)]
    df = spark.createDataFrame(rows, "ordinal long, review_text string, object_name string, rating_value double, raw_output string, judge_raw string")
    categories = spark.createDataFrame([("x", "cat")], "object_name string, business_category string")
    merged = pipelines.build_dataset(df, categories, size=10)
    counts = {r.quality_tier: r["count"] for r in merged.groupBy("quality_tier").count().collect()}
    assert counts == {"include": 10, "unjudged": 50}
    chat = spark.createDataFrame([(str(i), f"t{i}", [("a", "positive")], None) for i in range(20)], "sentence_id string, text string, aspect_terms array<struct<term:string,polarity:string>>, aspect_categories array<struct<category:string,polarity:string>>")
    ready = pipelines.prepare(chat)
    assert ready.where("split = 'validation'").count() == 2
    scores = pipelines.evaluate_outputs(ready.select(F.col("text").alias("chatml"), F.lit('{"aspects": [{"term": "A ", "polarity": "positive"}]}').alias("raw_output")))
    assert scores["exact"].first().f1 == 1.0 and scores["macro_f1"].first().macro_f1 == 1.0


def test_busy_services_use_up_no_tries(spark):
    df = spark.createDataFrame([("p",)], "prompt string").repartition(1)

    def asked(busy, tries):
        """Of a client that is busy for a while, then gives an answer that doesn't parse, then one that does."""

        def make():
            calls = []

            def answer(prompts):
                calls.append(1)
                if len(calls) <= busy:
                    raise boundary.Busy
                return ["no" if len(calls) == busy + 1 else "yes"] * len(prompts)

            return answer

        return boundary.ask(df, "prompt", "answer", make, tries=tries, accept=lambda a: a == "yes", sleep=lambda s: None, patience=4).first().answer

    assert asked(4, 2) == "yes" and asked(0, 1) == "no"
    with pytest.raises(Exception, match="Busy"):
        asked(5, 3)


def test_calls_in_flight(spark):
    """Answers in the order of the rows, from several calls at once, no more than the window; every third call is turned away."""
    df = spark.range(200).select("id", F.concat(F.lit("p"), "id").alias("prompt")).repartition(2)

    def make():
        lock, now, most, calls = threading.Lock(), [0], [0], [0]

        def client(prompts):
            with lock:
                calls[0] += 1
                now[0] += 1
                most[0] = max(most[0], now[0])
                turned = calls[0] % 3 == 0
            time.sleep(0.002 * (len(prompts) + calls[0] % 4))
            with lock:
                now[0] -= 1
            if turned:
                raise boundary.Busy
            return [f"{p} {most[0]}" for p in prompts]

        return client

    got = boundary.ask(df, "prompt", "answer", make, window=3, size=7, sleep=lambda s: None, patience=50).collect()
    assert len(got) == 200 and all(r.answer.split()[0] == r.prompt for r in got)
    assert {int(r.answer.split()[1]) for r in got} <= {1, 2, 3} and max(int(r.answer.split()[1]) for r in got) > 1


def test_pauses_and_rates():
    slept = []
    gate = boundary.Gate(2.0, 4, 3, slept.append)
    for _ in range(10):  # four at once, then two a second
        gate.enter()
    assert sum(slept) == pytest.approx(3, abs=0.2)
    gate = boundary.Gate(None, 4, 3, slept.append)
    seen = [gate.enter() for _ in range(4)]
    slept.clear()
    for k in seen:  # four calls of one moment are turned away together: one pause
        gate.busy(k, boundary.Busy())
    k = gate.enter()
    assert sum(slept) == pytest.approx(5, abs=0.2)
    gate.busy(k, boundary.Busy())
    k = gate.enter()
    assert sum(slept) == pytest.approx(15, abs=0.4)
    gate.answered()
    for _ in range(3):
        gate.busy(gate.enter(), boundary.Busy())
    with pytest.raises(boundary.Busy):
        gate.busy(gate.enter(), boundary.Busy())


def test_refused_prompts_stay_without_an_answer(spark):
    def make():
        def client(prompts):
            if "p3" in prompts:
                raise boundary.Refused
            return ["yes"] * len(prompts)

        return client

    df = spark.createDataFrame([(f"p{i}",) for i in range(6)], "prompt string").coalesce(1)
    assert [r.answer for r in boundary.ask(df, "prompt", "answer", make, size=1, window=2).collect()] == ["yes"] * 3 + [None] + ["yes"] * 2
    assert boundary.ask(df.limit(0), "prompt", "answer", make, size=1, window=2).count() == 0


@pytest.fixture()
def counted(spark):
    """A function that makes a frame whose rows are counted each time they are computed, and the counter."""

    def make(df):
        seen = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return df.mapInPandas(run, df.schema), seen

    return make


def test_counts_are_taken_in_the_pass_that_writes(spark, counted, tmp_path):
    texts = ["same text here", None, "", "   ", "nine char", "ten chars.", "  8 strip  ", "same text here", None]
    df, seen = counted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ordinal long, review_text string").repartition(3))
    kept, counts = clean.clean_counted(df)
    kept.write.parquet(str(tmp_path / "kept"))
    assert counts() == {"n_rows": 9, "n_present": 7, "n_not_blank": 5, "n_long": 4, "n_unique": 3} and seen.value == 9
    assert sorted(r.ordinal for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [0, 5, 6]


def test_reports_scan_once(spark, counted, tmp_path):
    """Every row of the input is computed once for the statistics, the judge's report, shares, annotations and metrics."""
    aspects = "array<struct<term:string,category:string,polarity:string>>"
    rows = [(f"r{i}", i, [("t", "c" if i % 2 else None, "positive" if i % 3 else None)] * (i % 3), None if i % 11 == 0 else f"d{i % 4}", "include" if i % 5 == 0 else "unjudged" if i % 5 == 1 else "exclude", i % 3) for i in range(120)]
    plain = spark.createDataFrame(rows, f"review_id string, ordinal int, aspects {aspects}, business_category string, quality_tier string, num_aspects int").withColumns({f"judge_{s}": (F.col("ordinal") % 5).cast("int") for s in SCORES})
    df, seen = counted(plain)
    got = assemble.dataset_stats(df).first()
    assert seen.value == 120 and (got.total, got.included, got.n_domains, got.total_aspects) == (120, 24, 4, 120)
    assert got.polarity_counts == {"positive": 80, "unknown": 40} or sum(got.polarity_counts.values()) == 120
    assert got.business_category_counts == {k: sum((r[3] or "unknown") == k for r in rows) for k in ("d0", "d1", "d2", "d3", "unknown")}
    assert got.included_counts == {k: n for k in ("d0", "d1", "d2", "d3", "unknown") if (n := sum((r[3] or "unknown") == k and r[4] == "include" for r in rows))}
    assert sum(got.top_categories.values()) == 120 and got.avg_overall == pytest.approx(2.0)
    df, seen = counted(plain)
    assert sum(r.pct for r in stats.shares(df, "business_category").collect()) == pytest.approx(100) and seen.value == 120
    judged = plain.select("business_category", F.when(F.col("ordinal") % 7 > 0, F.struct(*[(F.col("ordinal") % 5 + 1).cast("int").alias(s) for s in SCORES], F.lit("").alias("explanation"))).alias("judge_scores"))
    df, seen = counted(judged)
    report = writers.judge_report(df).first()
    assert seen.value == 120 and (report.total_judged, report.parse_failures) == (120, 18) and sum(d["count"] for d in report.domain_averages) == 102
    assert sum(report.score_distribution["overall"]) == 102 and sum(report.quality_tiers) == 102 and set(report.score_distribution) == set(SCORES)
    df, seen = counted(plain.select("review_id", "business_category", "num_aspects", (F.col("ordinal") % 2 == 0).alias("parse_success"), F.lit("x").alias("raw_output")))
    writers.save_annotations(df, str(tmp_path / "a"), "s")
    assert seen.value == 120 and spark.read.json(str(tmp_path / "a/annotation_stats")).first().total == 120
    chat = plain.select("review_id", chatml.training_text(F.lit("some text"), F.col("aspects")).alias("chatml"), F.lit('{"aspects": []}').alias("raw_output"))
    df, seen = counted(chat)
    found = pipelines.evaluate_outputs(df)
    assert [f.count() for f in found.values()] == [1] * len(found) and seen.value == 120
    assert tuple(found["skipped"].first()) == (120, 0)


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "review_id string, ordinal int, aspects array<struct<term:string,category:string,polarity:string>>, business_category string, quality_tier string").withColumns({f"judge_{s}": F.lit(1) for s in SCORES})
    got = assemble.dataset_stats(none).first()
    assert (got.total, got.judged, got.n_domains, got.avg_aspects, got.top_categories) == (0, 0, 0, None, {})
    report = writers.judge_report(none.select("business_category", F.lit(None).cast("struct<" + ",".join(f"{s}:int" for s in SCORES) + ">").alias("judge_scores"))).first()
    assert (report.total_judged, report.overall_averages, report.domain_averages) == (0, None, [])


def test_medians_by_selection(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(-(2**40), 2**40), rnd.choice([0, 1, 2, None]), None) for _ in range(501)] + [(-(2**63), 2**62, None), (2**63 - 1, 5, None)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    for some in (df, df.limit(0)):
        got = stats.medians(some, "a", "b", "c")
        for c in "abc":
            want = sorted(r[c] for r in some.collect() if r[c] is not None)
            assert got[c] == ((want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2 if want else None)
    assert stats.at_ranks(df, ["a"], lambda n: [0, n - 1]) == {"a": [-(2**63), 2**63 - 1]}
    texts = spark.createDataFrame([("a b",), ("a",), ("a b c d",), ("a b c",), (None,)], "t string")
    assert tuple(stats.text_stats(texts, "t", median=True).select("n", "median_words", "median_chars").first()) == (4, 2, 4)
    assert stats.text_stats(texts.limit(0), "t", median=True).first().median_words is None


def test_spearman(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1.0, 2.0, 3.5, None]), float(rnd.randint(0, 400))) for _ in range(700)]
    pairs = [r for r in rows if r[0] is not None]

    def ranks(values):
        order = sorted(values)
        return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(values)}

    x, y = ([ranks([p[k] for p in pairs])[p[k]] for p in pairs] for k in range(2))
    mean = lambda v: sum(v) / len(v)
    cov = lambda a, b: sum((p - mean(a)) * (q - mean(b)) for p, q in zip(a, b, strict=True))
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = stats.spearman(df, "a", "b").first()
    assert got.n == len(pairs) and got.rho == pytest.approx(cov(x, y) / (cov(x, x) * cov(y, y)) ** 0.5)
    assert stats.spearman(df, "b", "b").first().rho == pytest.approx(1)
    assert tuple(stats.spearman(df.limit(0), "a", "b").first()) == (0, None) and stats.spearman(df.withColumn("c", F.lit(1)), "a", "c").first().rho is None
    assert {r.value: r.rank for r in stats.average_ranks(df, "b").collect()} == ranks([r[1] for r in rows])


def test_samples_hand_on_a_bounded_number_of_rows(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("d"), F.col("id") % 7)).otherwise("big").alias("business_category")).repartition(4)
    got = sample.stratified(df, "id", size=60, targets={"d1": 5})
    wanted = {r.domain: r.target for r in sample.allocation(df, size=60, targets={"d1": 5}).collect()}
    by = {}
    for r in df.select("id", "business_category", sample.draw(42, "id").alias("w")).collect():
        by.setdefault(r.business_category, []).append((r.w, r.id))
    assert {r.id for r in got.collect()} == {i for d, rows in by.items() for _, i in sorted(rows)[: wanted[d]]}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_live_history_is_what_the_table_says(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(f"r{i % 3}", i, i * 10, None if i % 7 == 0 else round(rnd.random(), 3), None) for i in range(300)]
    kind = "run_id string, seq long, step long, train_loss double, eval_loss double"
    source = str(tmp_path / "log")
    for k in range(0, 300, 60):
        part = rows[max(0, k - 5) : k + 60]  # a few come twice
        rnd.shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
        stream = spark.readStream.schema(kind).parquet(source)
        incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    after = incremental.results(spark, str(tmp_path / "out"))
    last = after.groupBy("run_id").agg(F.max_by(F.struct("n", "ema", "best", "best_step"), "batch").alias("s")).select("run_id", "s.*")
    table = spark.createDataFrame(rows, kind)
    want = {r.run_id: (r.n, r.ema) for r in history.ema_last(table).collect()}
    least = {r.run_id: r for r in table.groupBy("run_id").agg(F.min("train_loss").alias("m"), F.min_by("step", F.struct("train_loss", "seq")).alias("x")).collect()}
    counts = {r.run_id: r.n for r in table.groupBy("run_id").agg(F.count("train_loss").alias("n")).collect()}
    got = {r.run_id: r for r in last.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.n == counts[k] and r.ema == pytest.approx(want[k][1]) and r.best == least[k].m
        assert r.best_step in {s for run, _, s, v, _ in rows if run == k and v == least[k].m}
