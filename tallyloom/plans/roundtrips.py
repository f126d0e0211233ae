"""The driver's queries for sources, sinks, model boundaries and configuration, each with its SQL twin.

Sources and sinks are checked on files: a query writes a table to the shared folder by a sink and returns what a source
reads back. Models are stood in for by answers made from the prompt.
"""

from __future__ import annotations

import atexit
import json
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import aspects as A
from tallyloom.functions import jsonx, mathx, taxonomy
from tallyloom.functions.domains import DOMAINS
from tallyloom.operators import assemble, boundary, chatml, clean, config, evaluate, sample
from tallyloom.plans import pipelines, registry
from tallyloom.plans.registry import ANN_SQL, JUDGED_SQL, LOGS_SQL, MERGED_SQL, SCORES, annotations, judgements, logs, merged, one_aspect, query, r4, scored, table
from tallyloom.sources import readers, writers
from tallyloom.streaming import incremental
from tallyloom.workers import ship


def folder(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones, which goes when the application ends."""
    path = f"{readers.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        with suppress(Exception):  # the JVM may be gone
            readers.remove(spark, path)

    atexit.register(clear)
    return path


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def raw_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("text").alias("review_text"), F.col("source").alias("object_name"), F.col("doc_id").cast("double").alias("rating_value"), F.col("lang").alias("reviewer_name"))


@query("SELECT CAST(doc_id AS DOUBLE) AS rating_value, source AS object_name, md5(nullif(text, '')) AS text_md5 FROM documents")
def csv_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1: texts with quotes and line breaks through a CSV file."""
    path = folder(spark, "reviews")
    writers.save_reviews(raw_reviews(spark, sf), path)
    return readers.read_reviews(spark, path).select("rating_value", "object_name", F.md5("review_text").alias("text_md5"))


@query("SELECT source AS object_name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def csv_profile(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2, FLT4: no column is asked for, the text is projected."""
    path = folder(spark, "reviews")
    writers.save_reviews(raw_reviews(spark, sf), path)
    rows = readers.read_reviews(spark, path, None).select("object_name", F.col("review_text").alias("text"))
    return rows.groupBy("object_name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def as_text_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("review_id", F.col("review_id").cast("string"))


@query(f"WITH {ANN_SQL} SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS business_name, num_aspects, num_aspects AS n, ok AS parse_success, CASE WHEN num_aspects >= 2 THEN 't2' END AS second FROM a")
def json_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3, JS8: arrays of objects in JSON files."""
    path = folder(spark, "annotations")
    writers.save_json_arrays(as_text_ids(annotations(spark, sf)).drop("ordinal"), path, 500)
    rows = readers.read_annotations(spark, path)
    return rows.select("review_id", "business_name", "num_aspects", F.size("aspects").alias("n"), "parse_success", F.get("aspects", F.lit(1))["term"].alias("second"))


@query(f"WITH j AS ({JUDGED_SQL}) SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(6 - overall AS INT) AS overall FROM j WHERE doc_id % 3 <> 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), overall FROM j WHERE doc_id % 3 = 0")
def json_judgements(spark: SparkSession, sf: str) -> DataFrame:
    """SRC4: of two judgements of an id the later counts; rows without one are left out."""
    path = folder(spark, "judged")
    rows = as_text_ids(judgements(spark, sf))
    late = rows.withColumn("judge_scores", F.when(F.col("review_id") % 3 != 0, F.col("judge_scores").withField("overall", 6 - F.col("judge_scores.overall"))))
    both = rows.withColumn("k", F.lit(0)).unionByName(late.withColumn("k", F.lit(1))).repartition("review_id").sortWithinPartitions("review_id", "k").drop("k")
    writers.save_json_arrays(both, path, 1 << 30)
    return readers.read_judgements(spark, path).select("review_id", F.col("judge_scores.overall").alias("overall"))


@query("SELECT 'there' AS place, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'absent', count(*) FROM labels")
def table_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """SRC6, SRC7, SRC9: one split of a table on disk, and the fallback where there is none."""
    path = folder(spark, "hub")
    writers.save_splits(documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split")), path)
    there = readers.read_or(spark, path, None).where("split = 'train'")
    same = readers.read_split(spark, path, "train").select("doc_id").intersect(there.select("doc_id"))
    absent = readers.read_or(spark, f"{path}-absent", table(spark, sf, "labels"))
    return same.agg(F.lit("there").alias("place"), F.count("*").alias("n")).unionByName(absent.agg(F.lit("absent").alias("place"), F.count("*").alias("n")))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, 'validation' AS split FROM r WHERE place <= ceil(n * 0.1)")
def split_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    """SNK1, SRC8: without a test split the validation split is taken."""
    path = folder(spark, "splits")
    writers.save_splits(sample.split(documents(spark, sf).select("doc_id"), "doc_id"), path)
    return readers.pick_split(readers.read_split(spark, path)).select("doc_id", "split")


STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT text FROM (SELECT {STRIPPED.format('line')} AS text FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents)) WHERE text <> ''")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SRC10: the lines of all texts, stripped, without blank ones."""
    path = folder(spark, "lines")
    documents(spark, sf).select("text").write.text(path)
    return readers.read_lines(spark, path)


@query("SELECT DISTINCT source AS object_name, lang AS business_category FROM documents")
def latest_results(spark: SparkSession, sf: str) -> DataFrame:
    """SRC11: of several results the last by name."""
    path = folder(spark, "results")
    pairs = documents(spark, sf).select(F.col("source").alias("object_name"), F.col("lang").alias("business_category")).distinct()
    for stamp, rows in (("20250101", pairs.limit(1)), ("20250301", pairs), ("20250201", pairs.limit(2))):
        writers.save_json_arrays(rows, f"{path}/eval_{stamp}")
    return readers.read_latest(spark, f"{path}/eval_*", schemas.CATEGORY)


@query("SELECT count(*) AS n_train, true AS absent FROM events WHERE event_id % 10 <> 0")
def optional_summary(spark: SparkSession, sf: str) -> DataFrame:
    """SRC12, SNK12: a summary that is there, and one that isn't."""
    path = folder(spark, "summary")
    writers.save_row(logs(spark, sf).agg(F.count("train_loss").alias("n_train")), path, model="stand-in")
    absent = readers.read_optional_json(spark, f"{path}-absent", schemas.CATEGORY) is None
    return readers.read_optional_json(spark, path, schemas.T.StructType().add("n_train", "long")).select("n_train", F.lit(absent).alias("absent"))


@query("WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)) SELECT event_type AS run_id, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS steps, CASE WHEN any_value(i) % 2 = 1 THEN count(*) FILTER (event_id % 10 = 0) ELSE 0 END AS evals FROM events JOIN t USING (event_type) GROUP BY event_type")
def run_histories(spark: SparkSession, sf: str) -> DataFrame:
    """SRC13, SNK7, SET4: logs of a folder for each run, with different columns by turns; a folder without one is skipped."""
    path = folder(spark, "runs")
    runs = sorted(r.run_id for r in logs(spark, sf).select("run_id").distinct().collect())  # a run for each type of event
    for i, run in enumerate(runs):
        columns = ["step", "train_loss", "eval_loss"] if i % 2 == 0 else ["train_loss", "step"]
        logs(spark, sf).where(F.col("run_id") == run).select(*columns).write.option("header", True).csv(f"{path}/{run}/training_history.csv")
    rows = readers.read_histories(spark, [f"{path}/{r}" for r in ("none", *runs)])
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.count("eval_loss").alias("evals"))


@query("SELECT doc_id, lang, NULL AS source FROM documents UNION ALL SELECT doc_id, NULL, source FROM documents")
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    """SET4: columns in the order in which frames have them."""
    docs = documents(spark, sf)
    return readers.union_of([docs.select("doc_id", "lang"), docs.select("source", "doc_id")]).select("doc_id", "lang", "source")


@query(f"WITH {ANN_SQL}, g AS (SELECT source AS business_category, count(*) AS n, CAST(sum(num_aspects) AS BIGINT) AS total_aspects FROM a GROUP BY 1) SELECT g.*, (SELECT count(*) FROM a) AS n_rows, (SELECT count(*) FILTER (ok AND num_aspects > 0) FROM a) AS good, true AS raw_dropped, true AS full_has_raw FROM g")
def saved_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """SNK2, ALT1: annotations without their raw output, the full copy, counts and domains."""
    path = folder(spark, "annotated")
    writers.save_annotations(as_text_ids(annotations(spark, sf)), path, "20250101")
    kept, full = spark.read.json(f"{path}/annotated"), spark.read.json(f"{path}/annotated_full_20250101")
    counts = kept.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(spark.read.json(f"{path}/annotation_stats").select("good")))  # one row each
    return spark.read.json(f"{path}/domain_distribution").select("business_category", "n", "total_aspects").crossJoin(F.broadcast(counts)).withColumns({"raw_dropped": F.lit("raw_output" not in kept.columns), "full_has_raw": F.lit("raw_output" in full.columns)})


@query(f"WITH {MERGED_SQL} SELECT 'full' AS part, count(*) AS n FROM m UNION ALL SELECT 'silver', count(*) FROM m WHERE quality_tier IN ('include', 'unjudged') UNION ALL SELECT 'approved', count(*) FROM m WHERE quality_tier = 'include' UNION ALL SELECT 'flagged', count(*) FROM m WHERE quality_tier = 'flag_for_review' UNION ALL SELECT 'records', count(*) FROM m WHERE quality_tier IN ('include', 'unjudged') UNION ALL SELECT 'stats', count(*) FROM m")
def saved_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3: the files of an assembled data set."""
    path = folder(spark, "assembled")
    writers.save_assembled(merged(spark, sf), path, "20250101")
    parts = [spark.read.json(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("full", "silver", "approved", "flagged", "records")]
    return readers.union_of([*parts, spark.read.json(f"{path}/stats").select(F.lit("stats").alias("part"), F.col("total").alias("n"))])


@query(f"WITH {MERGED_SQL} SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS business_category, CAST(doc_id % 5 + 1 AS BIGINT) AS user_rating, quality_tier, CAST(doc_id % 8 AS BIGINT) AS n FROM (SELECT d.doc_id, d.source, m.quality_tier FROM documents d JOIN m ON d.doc_id = m.doc_id) WHERE quality_tier IN ('include', 'unjudged')")
def published_records(spark: SparkSession, sf: str) -> DataFrame:
    """ALT2: the published columns, a line of JSON each."""
    path = folder(spark, "records")
    assemble.published(assemble.silver(as_text_ids(merged(spark, sf)))).write.json(path)
    return spark.read.json(path).select("review_id", "business_category", "user_rating", "quality_tier", F.size("aspects").cast("long").alias("n"))


@query(f"WITH j AS ({JUDGED_SQL}), d AS (SELECT j.*, source FROM j JOIN documents USING (doc_id)) SELECT count(*) AS total_judged, count(*) AS successfully_scored, CAST(0 AS BIGINT) AS parse_failures, round(avg(overall), 2) AS overall, round(avg(accuracy), 2) AS accuracy, count(*) FILTER (overall = 5) AS fives, count(*) FILTER (accuracy = 1) AS ones, count(*) FILTER (overall >= 3.5) AS included, count(*) FILTER (overall < 2.5) AS excluded, count(DISTINCT source) AS domains, (SELECT max(n) FROM (SELECT count(*) AS n FROM d GROUP BY source)) AS largest, 'p' AS provider FROM d")
def judge_report(spark: SparkSession, sf: str) -> DataFrame:
    """SNK4: results, report and summary of a judge."""
    path = folder(spark, "judge")
    rows = judgements(spark, sf).join(documents(spark, sf).select(F.col("doc_id").alias("review_id"), F.col("source").alias("business_category")), "review_id")
    writers.save_judgements(rows, path, "p", "m")
    r = spark.read.json(f"{path}/judge_report")
    return r.select("total_judged", "successfully_scored", "parse_failures", "overall_averages.overall", "overall_averages.accuracy", F.col("score_distribution.overall.5").alias("fives"), F.col("score_distribution.accuracy.1").alias("ones"), F.col("quality_tiers")["include_gte_3.5"].alias("included"), F.col("quality_tiers")["exclude_lt_2.5"].alias("excluded"), F.size("domain_averages").cast("long").alias("domains"), F.col("domain_averages")[0]["count"].alias("largest"), "provider")


@query("SELECT n, n_aspects, 'run' AS name FROM (" + registry.SQL["converted_stats"] + ")")
def conversion_report(spark: SparkSession, sf: str) -> DataFrame:
    """SNK5: statistics of a conversion and its metadata."""
    path = folder(spark, "conversion")
    writers.save_conversion(chatml.convert(registry.sentences(spark, sf)), path, name="run")
    return spark.read.json(f"{path}/metadata").join(spark.read.json(f"{path}/conversion_stats").select("n"), "n").select("n", "n_aspects", "metadata.name")


@query("SELECT tp, fp, fn, f1, 'model' AS model FROM (" + registry.SQL["ate_exact"] + ")")
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """SNK9: metrics with a metadata block."""
    path = folder(spark, "evaluation")
    writers.save_row(registry.rounded(evaluate.term_metrics(scored(spark, sf))), path, model="model")
    return spark.read.json(path).select("tp", "fp", "fn", "f1", "metadata.model")


@query(f"WITH l AS ({LOGS_SQL}) SELECT run_id, count(train_loss) AS total_steps, count(train_loss) AS train_logs, count(eval_loss) AS eval_logs, round(min(eval_loss), 4) AS best_eval_loss, CAST(arg_min(step, CASE WHEN eval_loss IS NOT NULL THEN row(eval_loss, seq) END) AS BIGINT) AS best_eval_step, round(arg_min(train_loss, seq), 4) AS first_loss FROM l GROUP BY 1")
def history_files(spark: SparkSession, sf: str) -> DataFrame:
    """SNK6: a run's logs and best evaluation as JSON."""
    path = folder(spark, "history")
    writers.save_history(logs(spark, sf), path, "20250101")
    return spark.read.json(f"{path}/json").select("run_id", "total_steps", F.size("train_logs").cast("long").alias("train_logs"), F.size("eval_logs").cast("long").alias("eval_logs"), r4("best_eval_loss"), "best_eval_step", r4(F.col("train_logs")[0]["train_loss"], "first_loss"))


@query("SELECT doc_id AS review_id, doc_id % 3 = 0 AS earlier, true AS cleared FROM documents")
def resumed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """SNK8, SRC14: a third is done, the rest follows some rows at a time, and the checkpoint goes at the end."""
    path = folder(spark, "resume")
    rows = documents(spark, sf).select(F.col("doc_id").alias("review_id"))
    writers.append_batch(rows.where("review_id % 3 = 0").withColumn("earlier", F.lit(True)), f"{path}/checkpoint")
    done = writers.in_batches(rows, f"{path}/checkpoint", lambda part: part.withColumn("earlier", F.lit(False)), every=max(1, rows.count() // 3))
    writers.finish(done, f"{path}/checkpoint", f"{path}/result")
    return spark.read.parquet(f"{path}/result").withColumn("cleared", F.lit(not readers.exists(spark, f"{path}/checkpoint")))


@query("SELECT DISTINCT lang AS business_category, source AS object_name, CAST(" + str(sum(len(s) for _, s in DOMAINS.values())) + " AS BIGINT) AS subcategories FROM documents")
def taxonomy_files(spark: SparkSession, sf: str) -> DataFrame:
    """SNK10: pairs of category and name, and the taxonomy beside them."""
    path = folder(spark, "taxonomy")
    writers.save_taxonomy(documents(spark, sf).select(F.col("lang").alias("business_category"), F.col("source").alias("object_name")), path, taxonomy.domains(spark))
    n = spark.read.json(f"{path}_domains").agg(F.count("*").alias("subcategories"))
    return spark.read.json(path).crossJoin(F.broadcast(n))  # n is one row


@query("WITH d AS (SELECT DISTINCT lang, source FROM documents) SELECT lang, source, CAST(row_number() OVER (ORDER BY lang, source) AS BIGINT) AS place FROM d")
def sorted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """SRT2, WIN2: two keys ascending, as places in the order."""
    pairs = documents(spark, sf).select("lang", "source").distinct().orderBy("lang", "source")
    rows = pairs.withColumn("key", F.struct("lang", "source"))
    return readers.dense_ordinal(rows, "key").select("lang", "source", (F.col("position") + 1).cast("long").alias("place"))


@query("SELECT 'A' || chr(10) || '# Languages' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) || chr(10) || 'END' AS log FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def research_log(spark: SparkSession, sf: str) -> DataFrame:
    """SNK11, SNK13: a card of computed rows, put before a marker of a log."""
    rows = [r.asDict() for r in documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]  # a row for each language
    return spark.createDataFrame([(writers.insert_section("A\nEND", writers.card("Languages", rows), "END"),)], "log string")


def odd_aspects():
    """doc_id % 4 aspects, whose terms need escapes, the even ones without a category."""
    one = lambda i: A.aspect(F.concat(F.lit('t"'), i.cast("string"), F.lit("\n\\é")), F.when(i % 2 == 1, F.lit("c'")), F.lit("neutral"))
    n = (F.col("doc_id") % 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)).otherwise(A.empty())


def many_sql(indent: int) -> str:
    """The JSON of odd_aspects, laid out with that indent, over rows of doc_id joined with their aspects' numbers i."""
    one, two, three = (" " * indent * k for k in (1, 2, 3))
    rows = f"string_agg('{two}{{' || chr(10) || '{three}\"term\": \"t\\\"' || i || '\\n\\\\é\",' || chr(10) || CASE WHEN i % 2 = 1 THEN '{three}\"category\": \"c''\",' || chr(10) ELSE '' END || '{three}\"polarity\": \"neutral\"' || chr(10) || '{two}}}', ',' || chr(10) ORDER BY i)"
    return f"CASE WHEN doc_id % 4 = 0 THEN '{{' || chr(10) || '{one}\"aspects\": []' || chr(10) || '}}' ELSE '{{' || chr(10) || '{one}\"aspects\": [' || chr(10) || {rows} || chr(10) || '{one}]' || chr(10) || '}}' END"


@query(f"SELECT doc_id, {many_sql(4)} AS json FROM documents LEFT JOIN range(1, 4) r(i) ON i <= doc_id % 4 GROUP BY doc_id")
def aspect_json_many(spark: SparkSession, sf: str) -> DataFrame:
    """JS1: several aspects, escapes, and absent categories."""
    return documents(spark, sf).select("doc_id", jsonx.aspects_json(odd_aspects()).alias("json"))


@query("SELECT doc_id, '{''aspects'': [' || coalesce(string_agg('{''term'': ''t\"' || i || '\\n\\\\é'', ' || CASE WHEN i % 2 = 1 THEN '''category'': \"c''\", ' ELSE '' END || '''polarity'': ''neutral''}', ', ' ORDER BY i), '') || ']}' AS repr FROM documents LEFT JOIN range(1, 4) r(i) ON i <= doc_id % 4 GROUP BY doc_id")
def aspect_repr(spark: SparkSession, sf: str) -> DataFrame:
    """JS2: aspects as Python writes them."""
    return documents(spark, sf).select("doc_id", jsonx.python_repr(odd_aspects()).alias("repr"))


LAST_SQL = "SELECT doc_id, true AS parse_success, CAST(doc_id % 4 AS INT) AS n, CASE WHEN doc_id % 4 > 0 THEN 't\"' || (doc_id % 4) || chr(10) || '\\é' END AS last FROM documents"


@query(LAST_SQL)
def output_parse_many(spark: SparkSession, sf: str) -> DataFrame:
    """JS4: several aspects with escapes, out of prose."""
    raw = F.concat(F.lit("Here: "), jsonx.aspects_json(odd_aspects()), F.lit(" that's all"))
    held = documents(spark, sf).select("doc_id", jsonx.parse_output(raw).alias("p"))
    return held.select("doc_id", "p.parse_success", F.size("p.aspects").alias("n"), F.try_element_at("p.aspects", F.lit(-1))["term"].alias("last"))


@query(LAST_SQL)
def output_parse_many_native(spark: SparkSession, sf: str) -> DataFrame:
    """JS4's lenient form on the same."""
    held = documents(spark, sf).select("doc_id", jsonx.lenient_output(jsonx.aspects_json(odd_aspects())).alias("p"))
    return held.select("doc_id", "p.parse_success", F.size("p.aspects").alias("n"), F.try_element_at("p.aspects", F.lit(-1))["term"].alias("last"))


@query(f"SELECT doc_id, md5({registry.sql_text(chatml.JUDGE_OPENING)} || chr(10) || chr(10) || '== REVIEW ==' || chr(10) || 'Text: \"' || any_value(text) || '\"' || chr(10) || 'Business: \"Unknown\" (Category: Boshqa)' || chr(10) || 'User rating: N/A/5' || chr(10) || chr(10) || '== MODEL PREDICTION ==' || chr(10) || {many_sql(2)} || chr(10) || chr(10) || {registry.sql_text(chatml.JUDGE_RUBRIC)}) AS prompt_md5 FROM documents LEFT JOIN range(1, 4) r(i) ON i <= doc_id % 4 GROUP BY doc_id")
def judge_prompt_many(spark: SparkSession, sf: str) -> DataFrame:
    """ST5: several aspects, and nothing known of the business."""
    nothing = F.lit(None).cast("string")
    return documents(spark, sf).select("doc_id", F.md5(chatml.judge_prompt(F.col("text"), nothing, nothing, nothing, odd_aspects())).alias("prompt_md5"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 4 END AS INT) AS n, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 > 0 THEN 't\"1' || chr(10) || '\\é' END AS term FROM documents")
def aspects_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """JS3: aspects held as JSON text, every fifth of them broken."""
    text = F.when(F.col("doc_id") % 5 == 0, "[{").otherwise(F.to_json(odd_aspects()))
    held = documents(spark, sf).select("doc_id", jsonx.parse_aspects(text).alias("a"))
    return held.select("doc_id", F.size("a").alias("n"), F.get("a", F.lit(0))["term"].alias("term"))


@query("SELECT 'chat' AS name, true AS chat, count(*) FILTER (doc_id % 3 <> 0) AS aspects FROM documents UNION ALL SELECT 'rows', false, CAST(sum(doc_id % 8) AS BIGINT) FROM documents UNION ALL SELECT 'other', false, 0 FROM documents HAVING count(*) > 0")
def chat_or_rows(spark: SparkSession, sf: str) -> DataFrame:
    """JS9: chat text is parsed, rows of aspects are taken as they are, and other frames have none."""
    from tallyloom.__main__ import is_chat

    docs = documents(spark, sf)
    held = F.when(F.col("doc_id") % 3 == 0, A.empty()).otherwise(one_aspect())
    frames = {"chat": docs.select(chatml.training_text(F.col("source"), held).alias("text")), "rows": annotations(spark, sf), "other": docs.select("lang")}
    out = []
    for name, f in frames.items():
        of = chatml.parse(f).select(F.size("gold").alias("n")) if is_chat(f) else f.select((F.size("aspects") if "aspects" in f.columns else F.lit(0)).alias("n"))
        out.append(of.agg(F.lit(name).alias("name"), F.lit(is_chat(f)).alias("chat"), F.sum("n").alias("aspects")))
    return readers.union_of(out)


@query("SELECT event_id, CAST(event_id % 10 AS INT) AS attempt, CAST(least(60, 5 * pow(2, event_id % 10)) AS DOUBLE) AS seconds FROM events")
def back_off(spark: SparkSession, sf: str) -> DataFrame:
    """MA5: the pause before each attempt."""
    attempt = (F.col("event_id") % 10).cast("int")
    return table(spark, sf, "events").select("event_id", attempt.alias("attempt"), boundary.pause(attempt).alias("seconds"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size * 2 >= 90 THEN 8 WHEN p_size * 2 >= 40 THEN 4 WHEN p_size * 2 >= 24 THEN 2 ELSE 1 END AS INT) AS batch FROM part")
def batch_by_memory(spark: SparkSession, sf: str) -> DataFrame:
    """MA9."""
    return table(spark, sf, "part").select("p_partkey", config.batch_for_memory(F.col("p_size") * 2).alias("batch"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'unsloth/Qwen2.5-7B-Instruct-bnb-4bit' WHEN 1 THEN 'unsloth/gemma-2-9b-it-bnb-4bit' ELSE p_name END AS model FROM part")
def model_alias(spark: SparkSession, sf: str) -> DataFrame:
    """MA10: an alias stands for its model, any other name for itself."""
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select("p_partkey", config.resolve(F.when(k == 0, "qwen2.5-7b").when(k == 1, "gemma2-9b").otherwise(F.col("p_name"))).alias("model"))


@query("SELECT l_linestatus AS part, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS trainable_params, CAST(sum(l_quantity) AS BIGINT) AS total_params, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) * 100.0 / sum(l_quantity), 4) AS trainable_percent FROM lineitem GROUP BY 1")
def parameter_shares(spark: SparkSession, sf: str) -> DataFrame:
    """AG21: lines stand for tensors."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("part"), F.col("l_quantity").cast("long").alias("numel"), (F.col("l_returnflag") == "A").alias("trainable"))
    return config.parameter_shares(rows, "part").withColumn("trainable_percent", F.round("trainable_percent", 4))


@query("SELECT position, \"column\", kind, (SELECT count(*) FROM documents) AS n_rows FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'lang', 'string'), (2, 'n', 'double')) t(position, \"column\", kind)")
def schema_inspection(spark: SparkSession, sf: str) -> DataFrame:
    """ALT3."""
    return readers.inspect(documents(spark, sf).select("doc_id", "lang", F.col("n_chars").cast("double").alias("n"))).drop("first")


class Repeater:
    """A stand-in for a model: answers from the rating in a prompt, the first time with an apology.

    It knows the prompts that wait for their answer, and no others."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out = []
        for p in prompts:
            rating = re.search(r"User rating: (\d)/5", p)[1]
            out.append(json.dumps(dict.fromkeys(SCORES, int(rating))) if p in self.asked else "Sorry, not now")
        self.asked.symmetric_difference_update(prompts)
        return out


@query("SELECT doc_id AS review_id, CAST(doc_id % 5 + 1 AS INT) AS overall FROM documents")
def judged_again(spark: SparkSession, sf: str) -> DataFrame:
    """UD8, UD9: an answer that doesn't parse is asked for again."""
    rows = boundary.judge(annotations(spark, sf).drop("raw_output"), Repeater)
    return rows.select("review_id", F.col("judge_scores.overall").alias("overall"))


def echo() -> boundary.Answer:
    """Answers an aspect for the last word of the review; none, in prose, for reviews without one."""

    def answer(prompts: list[str]) -> list[str | None]:
        reviews = [p.split('Matn: "', 1)[1].rsplit('"<|im_end|>', 1)[0] for p in prompts]
        return [json.dumps({"aspects": [{"term": r.split()[-1], "category": "c", "polarity": "positive"}]}) if r.split() else "nothing" for r in reviews]

    return answer


def often_busy(every: int = 5) -> Callable[[], boundary.Answer]:
    """echo behind a service that turns every so many-th call away."""

    def make() -> boundary.Answer:
        answer, calls, lock = echo(), [0], threading.Lock()

        def client(prompts: list[str]) -> list[str | None]:
            with lock:
                calls[0] += 1
                if calls[0] % every == 0:
                    raise boundary.Busy
            return answer(prompts)

        return client

    return make


#: Calls of 16 prompts, 4 in flight; pauses are pretended.
CALLS = {"window": 4, "size": 16, "sleep": lambda seconds: None}
LAST_WORD = r"regexp_extract(text, '(\S+)\s*$', 1)"


@query(f"SELECT doc_id, {LAST_WORD} <> '' AS parse_success, CAST({LAST_WORD} <> '' AS INT) AS num_aspects, nullif({LAST_WORD}, '') AS term FROM documents")
def annotated_by_client(spark: SparkSession, sf: str) -> DataFrame:
    """UD4, UD5, MA5: an annotator in each partition, with calls in flight that are turned away now and then."""
    rows = documents(spark, sf).select("doc_id", "text")
    return boundary.annotate(rows, often_busy(), **CALLS).select("doc_id", "parse_success", "num_aspects", F.get("aspects", F.lit(0))["term"].alias("term"))


@query(f"SELECT count(*) AS total, count(*) FILTER ({LAST_WORD} <> '') AS good, count(*) FILTER ({LAST_WORD} = '') AS failed, count(*) AS written FROM documents")
def annotated_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """UD7: annotation some rows at a time, with its counts."""
    path = folder(spark, "annotating")
    rows = documents(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    done, counts = boundary.annotate_all(rows, path, often_busy(), every=max(1, rows.count() // 2), **CALLS)
    return counts.select("total", "good", "failed").crossJoin(F.broadcast(done.agg(F.count("*").alias("written"))))  # one row each


@query(f"SELECT doc_id AS review_id, nullif({LAST_WORD}, '') AS term, true AS stopped, true AS cleared FROM documents")
def stopped_and_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """SNK8, SRC14: a run that breaks off behind its first batch, and another that goes on from there."""
    path, begun = folder(spark, "stopped"), []
    rows = documents(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    every = max(1, rows.count() // 3)

    def work(part: DataFrame) -> DataFrame:
        begun.append(1)
        if len(begun) == 2:
            raise ConnectionError("the service is gone")
        return boundary.annotate(part, often_busy(), **CALLS)

    stopped = False
    try:
        incremental.resumable(rows, path, work, every=every)
    except StreamingQueryException:
        stopped = incremental.results(spark, path).limit(1).count() == 1
    done = incremental.resumable(rows, path, work, every=every)
    return done.select("review_id", F.get("aspects", F.lit(0))["term"].alias("term"), F.lit(stopped).alias("stopped"), F.lit(not readers.exists(spark, f"{path}_todo")).alias("cleared"))


@query(f"SELECT {LAST_WORD} AS term, true AS parse_success FROM (SELECT arg_max(text, row(length(text), -doc_id)) AS text FROM documents)")
def single_text(spark: SparkSession, sf: str) -> DataFrame:
    """UD6: the longest text by itself."""
    longest = documents(spark, sf).agg(F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("text")).first().text
    return boundary.analyze(spark, longest, echo).select(F.col("aspects")[0]["term"].alias("term"), "parse_success")


KEPT = f"doc_id % 7 <> 0 AND {STRIPPED.format('text')} <> ''"


@query(f"SELECT count(*) FILTER ({KEPT}) AS n, count(*) FILTER ({KEPT} AND doc_id % 4 <> 0) AS parsed, count(*) FILTER ({KEPT} AND doc_id % 4 = 0) AS failed, count(*) FILTER (NOT ({KEPT})) AS skipped, count(*) FILTER ({KEPT} AND doc_id % 4 <> 0) AS tp, count(*) FILTER ({KEPT} AND doc_id % 4 = 0) AS fn FROM documents")
def evaluation_flow(spark: SparkSession, sf: str) -> DataFrame:
    """UD10, FLT10, JN8, AG17: outputs beside their gold, some without review text, some that don't parse."""
    k, aspects = F.col("doc_id"), one_aspect()
    review = F.when(k % 7 == 0, " ").otherwise(F.col("text"))
    rows = documents(spark, sf).select("doc_id", chatml.training_text(review, aspects).alias("chatml"), F.when(k % 4 == 0, "none").otherwise(jsonx.aspects_json(aspects)).alias("raw_output"))
    found = pipelines.evaluate_outputs(rows)
    parts = found["parse_rate"].select("n", "parsed", "failed").crossJoin(F.broadcast(found["skipped"].select(F.col("skipped_empty_gold").alias("skipped"))))
    return parts.crossJoin(F.broadcast(found["exact"].select("tp", "fn")))  # one row each


@query("SELECT CAST(event_id AS INT) AS step, event_id / 10 AS epoch, CASE WHEN event_id % 5 <> 4 THEN round(value, 4) END AS train_loss, CASE WHEN event_id % 5 = 4 THEN round(value, 4) END AS eval_loss, true AS ended FROM events")
def captured_logs(spark: SparkSession, sf: str) -> DataFrame:
    """UD11: what a trainer in each task logs, as rows of the training log."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            capture = boundary.LogCapture("run")
            for i, v in zip(rows["event_id"].tolist(), rows["value"].tolist(), strict=True):
                if i % 5 == 4:
                    capture.on_evaluate(i, i / 10, {"eval_loss": v})
                else:
                    capture.on_log(i, i / 10, {"loss": v, "unknown": 3.0})
            capture.on_train_end()
            held = pd.DataFrame(capture.rows).reindex(columns=["step", "epoch", "train_loss", "eval_loss"])
            yield held.assign(ended=capture.ended)

    ship(spark)
    rows = table(spark, sf, "events").select("event_id", "value").mapInPandas(train, "step int, epoch double, train_loss double, eval_loss double, ended boolean")
    return rows.select("step", "epoch", r4("train_loss"), r4("eval_loss"), "ended")


LIVE_SQL = f"WITH l AS ({LOGS_SQL}), v AS (SELECT run_id, step, train_loss AS v, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM l WHERE train_loss IS NOT NULL) SELECT run_id, max(n) AS n, round(sum(v * CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END), 4) AS ema, round(min(v), 4) AS best, CAST(arg_min(step, row(v, i)) AS BIGINT) AS best_step FROM v GROUP BY 1"


@query(LIVE_SQL)
def live_history(spark: SparkSession, sf: str) -> DataFrame:
    """WIN1, WIN4, AG18 over a log that grows: the state of each run after four parts of it have come."""
    path, last = folder(spark, "live"), table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    rows, parts = logs(spark, sf), 4
    for k in range(parts):
        rows.where((F.col("seq") * parts >= k * (last + 1)) & (F.col("seq") * parts < (k + 1) * (last + 1))).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/log")
        incremental.follow(stream, f"{path}/out", f"{path}/state").awaitTermination()
    after = incremental.results(spark, f"{path}/out")
    held = after.groupBy("run_id").agg(F.max_by(F.struct("n", "ema", "best", "best_step"), "batch").alias("s")).select("run_id", "s.*")
    return held.select("run_id", "n", r4("ema"), r4("best"), "best_step")


@query("SELECT count(*) AS n_rows, count(text) AS n_present, count(*) FILTER (" + STRIPPED.format("text") + " <> '') AS n_not_blank, count(*) FILTER (" + STRIPPED.format("text") + " <> '' AND length(text) >= 10) AS n_long, count(DISTINCT CASE WHEN " + STRIPPED.format("text") + " <> '' AND length(text) >= 10 THEN text END) AS n_unique, count(DISTINCT CASE WHEN " + STRIPPED.format("text") + " <> '' AND length(text) >= 10 THEN text END) AS written FROM documents")
def observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """FLT1, FLT10: the counts of each step, taken while the cleaned reviews are written."""
    path = folder(spark, "cleaned")
    kept, counts = clean.clean_counted(registry.reviews(spark, sf))
    kept.write.parquet(path)
    return spark.read.parquet(path).agg(*[F.lit(v).cast("long").alias(k) for k, v in counts().items()], F.count("*").alias("written"))


@query("SELECT p_partkey, round(p_retailprice / 7, 2) AS two, round(p_retailprice / 7, 4) AS four, round(p_retailprice / 7, 6) AS six FROM part")
def rounded_prices(spark: SparkSession, sf: str) -> DataFrame:
    """MA4."""
    x = F.col("p_retailprice") / 7
    return table(spark, sf, "part").select("p_partkey", *[mathx.half_even(x, n).alias(k) for k, n in (("two", 2), ("four", 4), ("six", 6))])
