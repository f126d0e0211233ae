"""The command line on small files."""

import json

from tallyloom import schemas
from tallyloom.__main__ import main


def test_commands(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "r.csv").write_text("review_text,object_name\nBu juda yaxshi joy,Kapitalbank\nЖуда яхши хизмат,Evos\n,x\n", encoding="utf-8")
    (tmp_path / "rules.json").write_text(json.dumps([{"category": "bank", "keywords": ["bank"]}]))
    main(["profile", p("r.csv"), p("profile"), "--rules", p("rules.json")])
    assert {r.business_category for r in spark.read.json(p("profile/taxonomy")).collect()} == {"bank", "Boshqa"}
    main(["load-raw", p("r.csv"), p("raw")])
    assert spark.read.parquet(p("raw")).count() == 2
    rows = [{"review_id": str(i), "text": "t", "business_category": "c", "aspects": [{"term": "a", "polarity": "positive"}], "num_aspects": 1, "parse_success": True, "judge_scores": dict.fromkeys(schemas.SCORES, 4)} for i in range(9)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    main(["sample", p("a.json"), p("sample"), "--sample-size", "5"])
    assert spark.read.json(p("sample")).count() == 5
    main(["judge-report", p("a.json"), p("report")])
    main(["assemble", p("a.json"), p("out"), "--judge-results", p("a.json")])
    assert spark.read.json(p("out/approved")).count() == 9
    main(["assemble", p("a.json"), p("out2")])
    assert spark.read.json(p("out2/silver")).count() == 9
    spark.createDataFrame([("s1", "narx yaxshi", [("narx", "positive", 0, 4)], None)], schemas.SEMEVAL).write.parquet(p("semeval"))
    main(["prepare", p("semeval"), p("chat"), "--val-size", "0"])
    chat = spark.read.parquet(p("chat"))
    assert chat.count() == 1
    chat.selectExpr("text", """'{"aspects": [{"term": "narx", "polarity": "positive"}]}' as raw_output""").write.parquet(p("outputs"))
    main(["evaluate", p("outputs"), p("scores")])
    assert spark.read.json(p("scores/exact")).first().f1 == 1.0
    main(["memory", "7"])


def test_model_commands(spark, tmp_path):
    """A client by its name: the first commands' answers go through the whole chain."""
    p = lambda n: str(tmp_path / n)
    (tmp_path / "standin.py").write_text(
        "import json\n"
        "def annotator():\n    return lambda ps: [json.dumps({'aspects': [{'term': 'english' if 'sentiment' in p.lower() else 'joy', 'category': 'c', 'polarity': 'positive'}]}) for p in ps]\n"
        "def judge():\n    return lambda ps: [json.dumps(dict.fromkeys(('completeness', 'accuracy', 'sentiment', 'relevance', 'overall'), 4)) for _ in ps]\n"
    )
    spark.sparkContext.addPyFile(p("standin.py"))
    (tmp_path / "r.csv").write_text("review_text,object_name,rating_value\n" + "".join(f"Bu juda yaxshi joy {i},Evos,{i % 5 + 1}\n" for i in range(30)), encoding="utf-8")
    main(["annotate", p("r.csv"), p("annotated"), "--client", "standin:annotator", "--every", "7", "--window", "3", "--call-size", "2"])
    stats = spark.read.json(p("annotated/annotation_stats")).first()
    assert (stats.total, stats.good) == (30, 30) and not (tmp_path / "annotated/checkpoint").exists()
    rows = spark.read.json(p("annotated/annotated")).collect()
    assert len({r.review_id for r in rows}) == 30 and {r.user_rating for r in rows} == {1, 2, 3, 4, 5}
    (tmp_path / "a.json").write_text(json.dumps([r.asDict(True) for r in rows]))
    main(["judge", p("a.json"), p("judged"), "--client", "standin:judge", "--sample-size", "8", "--model", "m"])
    report = spark.read.json(p("judged/judge_report")).first()
    assert report.successfully_scored == 8 and report.overall_averages.overall == 4 and report.model == "m"
    (tmp_path / "lines.txt").write_text("a line\n\n another \n")
    main(["inference", p("lines.txt"), p("inferred"), "--client", "standin:annotator"])
    assert sorted(r.text for r in spark.read.json(p("inferred")).collect()) == ["a line", "another"]
