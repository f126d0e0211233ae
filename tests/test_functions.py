"""Functions against Python's own behaviour and published values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import aspects, jsonx, mathx, taxonomy, text
from tallyloom.operators import chatml

TEXTS = [None, "", "   ", "\t x \n", "nine char", "ten chars.", "\x1ca b\x1f", "Bu juda yaxshi", "Жуда яхши", "Очень хорошо", "ўзбек", "ok жуда", "12 34", "ʻʼ", "a👩‍👩‍👧b", "İstanbul"]


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r.v for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_strip_words_length(spark):
    assert values(spark, text.strip, TEXTS) == [t if t is None else t.strip() for t in TEXTS]
    assert values(spark, text.word_count, TEXTS[1:]) == [len(t.split()) for t in TEXTS[1:]]
    assert values(spark, F.length, TEXTS[1:]) == [len(t) for t in TEXTS[1:]]


def script_of(t):
    cy = sum(0x400 <= ord(c) <= 0x4FF for c in t)
    la = sum("a" <= c.lower() <= "z" or c in "ʻʼ" for c in t)
    if not cy + la or la / (cy + la) > 0.7:
        return text.LATIN
    if cy / (cy + la) > 0.7:
        words = [w for w in "".join(c if 0x400 <= ord(c) <= 0x4FF else " " for c in t.lower()).split()]
        known = sum(w in text.UZBEK_WORDS for w in words) / len(words)
        return text.UZBEK if any(c in text.UZBEK_LETTERS for c in t) or known > 0.05 else text.RUSSIAN
    return text.MIXED


def test_script_class(spark):
    rnd = random.Random(1)
    rows = TEXTS[1:-1] + ["".join(rnd.choice("abжуиўқ 1ʻ.") for _ in range(rnd.randint(0, 12))) for _ in range(200)] + ["a" * 7 + "ж" * 3, "a" * 71 + "ж" * 29]
    assert values(spark, text.script_class, rows) == [script_of(t) for t in rows]


def test_rounding_like_python(spark):
    rnd = random.Random(2)
    rows = [2.675, 0.125, 2.5, 1234567.895, 0.0, -1.005] + [rnd.random() * 100 for _ in range(300)] + [round(rnd.random(), 3) for _ in range(300)]
    for digits in (2, 4, 6):
        assert values(spark, lambda c, d=digits: mathx.half_even(c, d), rows, "double") == [round(x, digits) for x in rows]


def test_guards_tiers_clamps(spark):
    r = spark.range(1).select(mathx.ratio(F.lit(1), F.lit(0)).alias("a"), mathx.f1(F.lit(0.0), F.lit(0.0)).alias("b"), mathx.clamp(F.lit(9)).alias("c"), mathx.clamp(F.lit(0)).alias("d"), *[mathx.tier(F.lit(x)).alias(f"t{i}") for i, x in enumerate((4, 3, 2, 3.5, 2.5))]).first()
    assert tuple(r) == (0.0, 0.0, 5, 1, "include", "flag_for_review", "exclude", "include", "flag_for_review")


def test_conversion_of_published_example(spark):
    df = spark.createDataFrame([([("ovqat", "POSITIVE"), ("kayfiyat", None)], [("food", "positive")])], "t array<struct<term:string,polarity:string>>, c array<struct<category:string,polarity:string>>")
    r = df.select(aspects.converted(F.col("t"), F.col("c")).alias("a")).first().a
    assert [tuple(x) for x in r] == [("ovqat", None, "positive"), ("kayfiyat", None, "neutral"), (None, "food", "positive")]


def test_validation_and_counts(spark):
    rows = [[("a", None, "Positive"), (None, None, "positive"), ("b", None, "conflict"), (None, "c", "neutral"), ("", None, None)], None, []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<struct<term:string,category:string,polarity:string>>")
    got = df.select(F.size(aspects.valid(F.col("a"))).alias("v"), F.size(aspects.named(F.col("a"))).alias("n"), aspects.count(F.col("a")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(2, 2, 5), (0, 0, 0), (0, 0, 0)]


def test_json_layout_is_pythons(spark):
    rows = [[("na\"rx\n\x01ў", "c", "negative"), (None, "x", "positive"), ("t", None, None)], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<struct<term:string,category:string,polarity:string>>")
    for indent in (4, 2):
        got = [r.v for r in df.orderBy("i").select(jsonx.aspects_json(F.col("a"), indent).alias("v")).collect()]
        want = [json.dumps({"aspects": [{k: v for k, v in zip(("term", "category", "polarity"), x, strict=True) if v is not None} for x in r or []]}, indent=indent, ensure_ascii=False) for r in rows]
        assert got == want
    assert df.orderBy("i").select(jsonx.python_repr(F.col("a")).alias("v")).collect()[2].v == "{'aspects': []}"


OUTPUTS = {
    '{"aspects": [{"term": "a", "polarity": "negative"}]}<|im_end|>': (True, 1), 'So: {"aspects": []} done': (True, 0), '{"aspects": [{"term": "a", "polarity": "x"}]} {"b": 1}': (False, 0), "{}": (True, 0), '{"aspects": null}': (True, 0),
    "{'aspects': []}": (False, 0), '{"aspects": [],}': (False, 0), 'term: narx, polarity: negative': (True, 1), '"term": "a", "category": "b", "polarity": "positive"': (True, 2), "": (False, 0), "[1]": (False, 0), '{"aspects": [NaN, {"term": 4}]}': (True, 1),
}


def test_output_parser(spark):
    got = values(spark, jsonx.parse_output, [*OUTPUTS, None])
    assert [(g.parse_success, len(g.aspects)) for g in got] == [*OUTPUTS.values(), (False, 0)]
    assert got[-2].aspects[0].term == "4"
    both = got[8].aspects
    assert [b.category for b in both] == ["b", None]


KEYS = ("completeness", "accuracy", "sentiment", "relevance", "overall")


def judged(*v):
    return "{" + ", ".join(f'"{k}": {x}' for k, x in zip(KEYS, v, strict=True)) + "}"


def test_judgement_parser(spark):
    rows = {
        judged(1, 2, 3, 4, 5): [1, 2, 3, 4, 5], f"```json\n{judged(0, 9, 3.9, 4, 5)}\n```": [1, 5, 3, 4, 5], f"Scores {judged(1, 1, 1, 1, 1)} end": [1, 1, 1, 1, 1], judged('"4"', 1, 1, 1, 1): [4, 1, 1, 1, 1], judged('"4.7"', 1, 1, 1, 1): None,
        judged(1, 2, 3, 4, 5).upper()[:-1]: [1, 2, 3, 4, 5], judged("true", 1, 1, 1, 1): [1, 1, 1, 1, 1], '{"overall": 3}': None, "": None, judged(1, 2, 3, 4, 5)[:-1] + ', "explanation": "why"': [1, 2, 3, 4, 5],
    }
    got = values(spark, jsonx.parse_judgement, [*rows, None])
    assert [g and [g[k] for k in KEYS] for g in got] == [*rows.values(), None]
    assert got[-2].explanation == "why"
    native = values(spark, jsonx.lenient_scores, [judged(1, 2, 3, 4, 9), "x"])
    assert [native[0][k] for k in KEYS] == [1, 2, 3, 4, 5] and native[1] is None


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(1, "Narx qimmat", [("narx", "price", "negative")]), (2, 'U "zo\'r" dedi', []), (3, "a\nb", None)], "i int, t string, a array<struct<term:string,category:string,polarity:string>>")
    chat = df.select("i", chatml.training_text(F.col("t"), F.col("a")).alias("text"))
    got = chatml.parse(chat).orderBy("i").collect()
    assert [g.review_text for g in got] == ["Narx qimmat", "U", "a\nb"]
    assert [len(g.gold) for g in got] == [1, 0, 0]
    english = spark.range(1).select(chatml.parse(spark.createDataFrame([("",)], "text string")).columns and chatml.review_text(chatml.inference_prompt(F.lit("x y"), english=True)).alias("r")).first().r
    assert english == "x y"


def test_rules_take_the_first_match(spark):
    rules = [("food", ["bar", "pub"]), ("bank", ["bank"]), ("shop", ["market"])]
    names = ["Baraka market", "Respublika", "Kapitalbank", "Uzum MARKET", "none", None]
    assert values(spark, lambda c: taxonomy.classify(c, rules), names) == ["food", "food", "bank", "shop", "Boshqa", "Boshqa"]
    table = taxonomy.classify_by_table(spark.createDataFrame([(n,) for n in names[:5]], "object_name string"), taxonomy.rules_table(spark, rules))
    assert {r.object_name: r.category for r in table.collect()} == dict(zip(names, ["food", "food", "bank", "shop", "Boshqa"], strict=False))


@pytest.mark.parametrize("rows", [[]])
def test_empty_columns(spark, rows):
    assert values(spark, jsonx.parse_output, rows) == []


ASPECT_VALUES = ['"narx"', '"a \\"b\\" \\u02bb \\n"', '""', "null", "5", "1.50", "true", '"\\ud83d\\ude00"', '"\\ud83d"', '"tab\t"', '"é😀ʻ"', "[1]", "NaN", '"x" 5', "01"]
GAPS = ["", " ", "\n  ", "\t", "\u00a0", "\x0b"]


def made_outputs(n=1500):
    rnd = random.Random(12)
    gap = lambda: rnd.choice(GAPS[:3] if rnd.random() < 0.97 else GAPS)
    value = lambda: rnd.choice(ASPECT_VALUES[:4] if rnd.random() < 0.9 else ASPECT_VALUES)

    def one():
        names = rnd.choices(["term", "category", "polarity"], k=rnd.randint(0, 4)) if rnd.random() < 0.3 else ["term", "category", "polarity"]
        if rnd.random() < 0.05:
            names.append(rnd.choice(["Term", "score", "aspects"]))
        return "{" + gap() + ",".join(f'{gap()}"{k}"{gap()}:{gap()}{value()}' for k in names) + gap() + "}"

    out = []
    for _ in range(n):
        rows = f",{gap()}".join(one() for _ in range(rnd.randint(0, 3)))
        text = f'{{{gap()}"aspects"{gap()}:{gap()}[{gap()}{rows}{gap()}]{gap()}}}'
        k = rnd.random()
        out.append(text if k < 0.6 else f"So: {text}<|im_end|> " if k < 0.7 else text + rnd.choice(["}", " {}", "x", "\x00", ",", '"']) if k < 0.8 else text[: rnd.randrange(len(text))] if k < 0.85 else text.replace('"', "'") if k < 0.88 else rows if k < 0.92 else f"[{rows}]")
    return out + ["", " ", None, "{}", '{"aspects": null}', '{"aspects": [1, {"term": "a"}]}', '{"aspects": [{}]}', '{"aspects": []} {"aspects": []}', '{"aspects": [{"term": "' + "a" * 200_000 + '"}]}', '{"aspects": [{"term": "' + "\\\\" * 100_000 + '"}]}']


def test_two_ways_of_parsing_agree(spark):
    """What the pattern takes from_json reads as the strict parsers do; and it takes well-formed rows, but not the others."""
    rows = made_outputs()
    plain = lambda r: None if r is None else ([tuple(a) for a in r.aspects], r.parse_success) if hasattr(r, "parse_success") else [tuple(a) for a in r]
    want = lambda d: ([(a["term"], a["category"], a["polarity"]) for a in d["aspects"]], d.get("parse_success"))
    for f, strict in ((jsonx.parse_output, jsonx.read_output), (jsonx.parse_gold, jsonx.read_gold)):
        for t, got in zip(rows, values(spark, f, rows), strict=True):
            assert plain(got) == want(strict(t)), t
    for t, got in zip(rows, values(spark, jsonx.parse_aspects, rows), strict=True):
        assert plain(got) == want(jsonx.read_aspects(t))[0], t
    usual = values(spark, lambda c: jsonx.in_braces(c).rlike(jsonx.ASPECTS_TEXT), rows)
    assert 500 < sum(map(bool, usual)) < 1300


def test_two_ways_of_judging_agree(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(600):
        keys = list(jsonx.SCORES) + (["explanation"] if rnd.random() < 0.7 else [])
        rnd.shuffle(keys)
        if rnd.random() < 0.1:
            keys.pop()
        number = lambda: rnd.choice(["1", "3", "5"] if rnd.random() < 0.97 else ["0", "9", "4.7", '"4"', "null", "44"])
        text = "{" + ", ".join(f'"{k}": {number()}' if k != "explanation" else rnd.choice(['"explanation": "good \\"overall\\" {x}"', '"explanation": null', '"explanation": ""']) for k in keys) + "}"
        rows.append(rnd.choice([text, text, f"```json\n{text}\n```", f"```{text}```", f"Here: {text}", text + " x", text.replace("{", "{ \n")]))
    rows += [None, "", "{}"]
    for t, got in zip(rows, values(spark, jsonx.parse_judgement, rows), strict=True):
        want = jsonx.read_judgement(t)
        assert (None if got is None else got.asDict()) == want, t


def test_python_reads_the_rest_only(spark, monkeypatch):
    """The parser counts what it is given: of a hundred well-formed rows and three others, three."""
    seen = spark.sparkContext.accumulator(0)

    def counting(t):
        seen.add(1)
        return jsonx.read_output(t)

    monkeypatch.setattr(jsonx, "strict_output", jsonx.vectorised(counting, jsonx.PARSED, ("aspects", "parse_success")))
    rows = ['{"aspects": [{"term": "a", "category": null, "polarity": "positive"}]}'] * 100 + ["x", '{"aspects": [{"term": 5}]}', "{", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string").repartition(2).select(jsonx.parse_output(F.col("t")).alias("v"))
    assert df.where("v.parse_success").count() == 101 and seen.value == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "from_json" in plan and "RLIKE" in plan


def test_automaton_is_the_chain_of_rules(spark, tmp_path):
    """394 keywords in 22 categories, read from a file, over names made of them: as CASE WHEN says, without a chain in the plan."""
    rnd = random.Random(22)
    word = lambda: "".join(rnd.choice("abcdeou'") for _ in range(rnd.randint(2, 6)))
    rules = [(f"category {i}", [word() for _ in range(18)] + (["BAR "] if i == 3 else [])) for i in range(22)]
    path = str(tmp_path / "rules")
    spark.sparkContext.parallelize([json.dumps([{"category": c, "keywords": ks} for c, ks in rules])]).coalesce(1).saveAsTextFile(path)
    read = taxonomy.read_rules(spark, path)
    assert [(c, list(k)) for c, k in read] == rules and sum(len(k) for _, k in read) == 397
    names = [" ".join(rnd.choice([word(), rnd.choice(rnd.choice(rules)[1]).upper(), "zzz", "xyz"]) for _ in range(rnd.randint(1, 3))) for _ in range(700)] + [None, "", "zzz", "Bar None", "barnone"]
    df = spark.createDataFrame([(n,) for n in names], "object_name string").repartition(3)
    want = df.select("object_name", taxonomy.classify(F.col("object_name"), read).alias("category"))
    got = taxonomy.classify_names(df, read)
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.select("object_name", "category").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan and "contains" not in plan
    for some in ([], [("a", [])], [("a", ["x"]), ("b", [""]), ("c", ["y"])]):
        plain = {r.object_name: r.category for r in df.select("object_name", taxonomy.classify(F.col("object_name"), some).alias("category")).collect()}
        assert {r.object_name: r.category for r in taxonomy.classify_names(df, some).collect() if r.object_name is not None} == {k: v for k, v in plain.items() if k is not None}


def test_script_class_works_its_text_out_once(spark):
    """The text was named in each branch and count, and made anew for each."""
    df = spark.createDataFrame([("адуж",), ("ғоз",), ("hello",), ("ab где",), ("1 2",), (None,)], "t string")
    made = df.select("t", text.script_class(F.reverse("t")).alias("s"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert [r.s for r in made.collect()] == [text.UZBEK, text.UZBEK, text.LATIN, text.MIXED, text.LATIN, text.MIXED]
