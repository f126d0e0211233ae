"""Sources and sinks on files, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.plans import pipelines
from tallyloom.sources import readers, writers
from tallyloom.streaming import incremental


def test_csv_needs_its_column(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('review_text,object_name,rating_value,extra\n"a, ""b""\nc",x,4.5,1\nд,y,,2\n', encoding="utf-8")
    rows = readers.read_reviews(spark, str(p)).orderBy("ordinal").collect()
    assert [(r.review_text, r.rating_value, r.extra) for r in rows] == [('a, "b"\nc', 4.5, "1"), ("д", None, "2")]
    with pytest.raises(ValueError):
        readers.read_reviews(spark, str(p), text_column="missing")


def test_json_sources(spark, tmp_path):
    a = tmp_path / "j.json"
    score = dict.fromkeys(schemas.SCORES, 3)
    a.write_text(json.dumps([{"review_id": "a", "judge_scores": score}, {"review_id": "a", "judge_scores": score | {"overall": 5}}, {"review_id": "b", "judge_scores": None}]))
    assert [(r.review_id, r.judge_scores.overall) for r in readers.read_judgements(spark, str(a)).collect()] == [("a", 5)]
    c = tmp_path / "c.json"
    c.write_text(json.dumps([{"object_name": "x", "business_category": "1"}, {"object_name": "x", "business_category": "2"}]))
    assert [tuple(r) for r in readers.read_categories(spark, str(c)).collect()] == [("x", "2")]
    assert readers.read_optional_json(spark, str(tmp_path / "none.json"), schemas.CATEGORY) is None
    for n in ("e_1.json", "e_2.json"):
        (tmp_path / n).write_text(json.dumps({"object_name": n}))
    assert readers.read_latest(spark, str(tmp_path / "e_*.json"), schemas.CATEGORY).first().object_name == "e_2.json"


def test_lines_splits_histories(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\n  b \n")
    assert sorted(r.text for r in readers.read_lines(spark, str(tmp_path / "t.txt")).collect()) == ["a", "b"]
    df = spark.range(4).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("validation"))
    writers.save_splits(df, str(tmp_path / "s"))
    assert readers.pick_split(readers.read_split(spark, str(tmp_path / "s"))).count() == 1
    assert readers.read_or(spark, str(tmp_path / "no"), df).count() == 4
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "training_history.csv").write_text("step,train_loss,eval_loss\n1,0.5,\n2,,0.4\n")
    logs = readers.read_histories(spark, [str(tmp_path / r) for r in ("r1", "r2", "r3")])
    assert logs.count() == 4 and {r.run_id for r in logs.collect()} == {"r1", "r2"}
    writers.save_history(logs, str(tmp_path / "h"))
    assert set(pipelines.compare_runs(logs, ["r1", "r2"])) == {"summary", "ema", "best", "by_step"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "n", "c", 1, [("x", "y", "positive")], 1, "m", True, "raw"), ("b", "t", "n", "c", 1, [], 0, "m", True, "raw")], schemas.ANNOTATION)
    writers.save_annotations(rows, str(tmp_path / "a"), "20260101")
    assert "raw_output" not in spark.read.json(str(tmp_path / "a/annotated")).columns
    assert spark.read.json(str(tmp_path / "a/annotation_stats")).first().good == 1
    writers.append_batch(rows.limit(1), str(tmp_path / "done"))
    assert readers.not_yet_done(rows, spark.read.parquet(str(tmp_path / "done"))).count() == 1
    writers.save_row(rows.limit(1), str(tmp_path / "row"), model="m")
    assert spark.read.json(str(tmp_path / "row")).first().metadata.model == "m"
    assert writers.insert_section("a END", "S ", "END") == "a S END" and "| x |" in writers.card("T", [{"x": 1}])


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    make = lambda i: spark.createDataFrame([(i, f"a review of item {i}", '{"aspects": []}'), (i, "short", "")], "ordinal int, review_text string, raw_output string")
    make(1).write.mode("append").parquet(src)
    schema = make(1).schema
    for i in (2, 3):
        incremental.annotate_stream(spark, src, schema, out, state).awaitTermination()
        make(i).write.mode("append").parquet(src)
    incremental.annotate_stream(spark, src, schema, out, state).awaitTermination()
    assert sorted(r.ordinal for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_arrays_of_bounded_size(spark, tmp_path):
    df = spark.range(2500, numPartitions=3).select("id", F.concat(F.lit('"é\n'), F.col("id").cast("string")).alias("t"))
    writers.save_json_arrays(df, str(tmp_path / "a"), 400)
    files = list((tmp_path / "a").glob("part-*"))
    sizes = [len(json.loads(f.read_text())) for f in files]
    assert sum(sizes) == 2500 and max(sizes) <= 400 and len(sizes) == 9
    back = readers.read_json_array(spark, str(tmp_path / "a"), schemas.T.StructType().add("id", "long").add("t", "string"))
    assert back.select("id", "t").exceptAll(df).isEmpty() and back.count() == 2500


def test_lines_of_json_split(spark, tmp_path):
    spark.range(5).select(F.col("id").cast("string").alias("object_name")).write.json(str(tmp_path / "l"))
    rows = readers.read_json_array(spark, str(tmp_path / "l"), schemas.CATEGORY, lines=True)
    assert sorted(r.object_name for r in rows.collect()) == list("01234")


def test_batches_go_on_where_a_failure_left_them(spark, tmp_path):
    rows, path = spark.range(40).withColumnRenamed("id", "review_id"), str(tmp_path / "done")
    seen = []

    def work(part):
        seen.append(part.count())
        if len(seen) == 2:
            raise RuntimeError("down")
        return part.withColumn("x", F.lit(1))

    with pytest.raises(RuntimeError):
        writers.in_batches(rows, path, work, every=10)
    first = spark.read.parquet(path).count()
    assert first == seen[0]
    done = writers.in_batches(rows, path, work, every=100)
    assert seen[-1] == 40 - first and done.select("review_id").distinct().count() == done.count() == 40
    writers.finish(done, path, str(tmp_path / "out"))
    assert not readers.exists(spark, path) and spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_a_stopped_run_goes_on_behind_its_batches(spark, tmp_path):
    """Each row is read once for all batches of both runs, and done once, but for those of the batch that broke."""
    path, read, tried = str(tmp_path / "done"), spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(90).withColumnRenamed("id", "review_id").repartition(3).mapInPandas(counted, "review_id long")

    def work(part):
        tried.append(sorted(r.review_id for r in part.collect()))
        if len(tried) == 2:
            part.withColumn("x", F.lit("half")).limit(1).write.parquet(f"{path}/half")  # what a broken batch may leave elsewhere
            readers.remove(spark, f"{path}/half")
            raise RuntimeError("down")
        return part.withColumn("x", F.lit("done"))

    with pytest.raises(Exception, match="down"):
        incremental.resumable(rows, path, work, every=20)
    assert incremental.results(spark, path).count() == len(tried[0]) > 0 and read.value == 90
    done = incremental.resumable(rows, path, work, every=20)
    assert sorted(r.review_id for r in done.collect()) == list(range(90)) and done.where("x = 'done'").count() == 90
    assert tried[1] == tried[2] and sorted(sum(tried[:1] + tried[2:], [])) == list(range(90)) and all(len(t) <= 20 for t in tried)
    assert not readers.exists(spark, f"{path}_todo")
    more = spark.range(85, 95).withColumnRenamed("id", "review_id")
    again = incremental.resumable(more, path, work, every=100)
    assert sorted(r.review_id for r in again.collect()) == list(range(95)) and sorted(sum(tried[-2:], [])[-5:]) == list(range(90, 95))
    assert incremental.resumable(more, path, work).count() == 95
    assert incremental.resumable(more.limit(0), str(tmp_path / "none"), lambda p: p.withColumn("x", F.lit(1))).columns == ["review_id", "x"]


def test_union_keeps_the_order_of_columns(spark):
    frames = [spark.range(1).selectExpr("id as b", "1 as a"), spark.range(1).selectExpr("2 as c", "id as b")]
    assert readers.union_of(frames).columns == ["b", "a", "c"]
