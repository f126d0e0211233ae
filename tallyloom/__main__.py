"""Commands over files: python -m tallyloom COMMAND ... (each is one flow or one operator with its source and sink)."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import taxonomy, text
from tallyloom.operators import assemble, boundary, clean, config, sample, stats
from tallyloom.plans import pipelines
from tallyloom.sources import readers, writers
from tallyloom.streaming import incremental


def is_chat(df: DataFrame) -> bool:
    """Chat text rather than rows of aspects."""
    return "aspects" not in df.columns and "text" in df.columns


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.schema(schemas.SEMEVAL).parquet(a.input)
    writers.save_splits(pipelines.prepare(rows, a.val_size, a.seed, a.max_examples), a.output)


def profile(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = clean.explore_clean(readers.read_reviews(spark, a.input, None))
    rules = taxonomy.read_rules(spark, a.rules) if a.rules else []
    rows = rows.withColumns({"script": text.script_class(F.col("review_text")), "business_category": taxonomy.classify(F.col("object_name"), rules)})
    stats.text_stats(rows, median=True).write.mode("overwrite").json(f"{a.output}/text")
    stats.shares(rows, "script").write.mode("overwrite").json(f"{a.output}/scripts")
    stats.category_stats(rows).write.mode("overwrite").json(f"{a.output}/categories")
    writers.save_taxonomy(rows, f"{a.output}/taxonomy", taxonomy.domains(spark))


def load_raw(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_reviews(spark, a.input, "review_text")
    clean.clean(rows).select(F.col("review_text").alias("text")).write.mode("overwrite").parquet(a.output)


def client_of(name: str) -> Callable[[], boundary.Answer]:
    """What builds a client, by MODULE:FUNCTION; it is looked up where it is used, in each task."""
    module, _, function = name.partition(":")
    return lambda: getattr(importlib.import_module(module), function)()


def calls_of(a: argparse.Namespace) -> dict:
    return {"window": a.window, "size": a.call_size, "rate": a.rate}


def annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reviews cleaned, numbered and annotated in batches; a run that was stopped goes on when it is started again."""
    none = spark.createDataFrame([], "object_name string, business_category string")
    rows = clean.prepare(readers.read_reviews(spark, a.input), readers.read_categories(spark, a.categories) if a.categories else none)
    ready = pipelines.as_annotations(rows).drop("ordinal")
    done, _ = boundary.annotate_all(ready, f"{a.output}/checkpoint", client_of(a.client), every=a.every, english=a.use_english, **calls_of(a))
    writers.save_annotations(done, a.output, a.stamp)
    readers.remove(spark, f"{a.output}/checkpoint")


def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    """A sample of annotations judged in batches, with its report."""
    drawn = sample.stratified(clean.scoreable(readers.read_annotations(spark, a.input)), "review_id", size=a.sample_size, seed=a.seed)
    judged = incremental.resumable(drawn, f"{a.output}/checkpoint", lambda rows: boundary.judge(rows, client_of(a.client), **calls_of(a)), every=a.every)
    writers.save_judgements(judged, a.output, a.client, a.model)
    readers.remove(spark, f"{a.output}/checkpoint")


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """The aspects of each line of a text file."""
    rows = readers.read_lines(spark, a.input)
    boundary.annotate(rows, client_of(a.client), english=a.use_english, **calls_of(a)).write.mode("overwrite").json(a.output)


def draw(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = clean.scoreable(readers.read_annotations(spark, a.input))
    (rows if a.no_sample else sample.stratified(rows, "review_id", size=a.sample_size, seed=a.seed)).write.mode("overwrite").json(a.output)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.save_judgements(readers.read_json_array(spark, a.input, schemas.JUDGE_RESULT), a.output, "recorded", "recorded")


def assembled(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_annotations(spark, a.input)
    scores = readers.read_judgements(spark, a.judge_results) if a.judge_results else spark.createDataFrame([], "review_id string, judge_scores struct<" + ",".join(f"{s}:int" for s in schemas.SCORES) + ",explanation:string>")
    writers.save_assembled(assemble.merge_scores(rows, scores, include=a.include_threshold), a.output, a.stamp)


def evaluated(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows of chat text (text) and model output (raw_output)."""
    rows = spark.read.parquet(a.input)
    if not is_chat(rows):
        raise ValueError("the input needs a column text with chat text")
    for name, scores in pipelines.evaluate_outputs(rows if a.max_samples is None else rows.limit(a.max_samples), "text").items():
        writers.save_row(scores, f"{a.output}/{name}", source=a.input)


def histories(spark: SparkSession, a: argparse.Namespace) -> None:
    logs = readers.read_histories(spark, a.folders)
    runs = [f.rstrip("/").split("/")[-1] for f in a.folders]
    for name, df in pipelines.compare_runs(logs, runs).items():
        df.write.mode("overwrite").option("header", True).csv(f"{a.output}/{name}")


def estimate(spark: SparkSession, a: argparse.Namespace) -> None:
    m = config.memory(F.lit(a.billions), F.lit(a.sequence), F.lit(a.batch), F.lit(a.bits))
    spark.range(1).select(*[F.round(m[k], 2).alias(k) for k in ("weights_gb", "optimizer_gb", "activations_gb", "total_gb")]).show()


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, files: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if files:
            p.add_argument("input")
            p.add_argument("output")
        return p

    p = command("prepare", prepare)
    p.add_argument("--val-size", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--max-examples", type=int)
    command("profile", profile).add_argument("--rules")
    for name, run in (("annotate", annotate), ("judge", judge), ("inference", infer)):
        p = command(name, run)
        p.add_argument("--client", required=True, help="MODULE:FUNCTION that builds a client")
        p.add_argument("--every", type=int, default=1000)
        p.add_argument("--window", type=int, default=1)
        p.add_argument("--call-size", type=int, default=1)
        p.add_argument("--rate", type=float)
        p.add_argument("--use-english", action="store_true")
        p.add_argument("--categories")
        p.add_argument("--stamp", default="")
        p.add_argument("--model", default="")
        p.add_argument("--sample-size", type=int, default=300)
        p.add_argument("--seed", type=int, default=42)
    command("load-raw", load_raw)
    p = command("sample", draw)
    p.add_argument("--sample-size", type=int, default=300)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--no-sample", action="store_true")
    command("judge-report", report)
    p = command("assemble", assembled)
    p.add_argument("--judge-results")
    p.add_argument("--include-threshold", type=float, default=3.5)
    p.add_argument("--stamp", default="")
    command("evaluate", evaluated).add_argument("--max-samples", type=int)
    p = command("histories", histories, files=False)
    p.add_argument("output")
    p.add_argument("folders", nargs="+")
    p = command("memory", estimate, files=False)
    p.add_argument("billions", type=float)
    for name, default in (("--sequence", 2048), ("--batch", 1), ("--bits", 4)):
        p.add_argument(name, type=int, default=default)
    return top


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    a.run(SparkSession.builder.appName("tallyloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
