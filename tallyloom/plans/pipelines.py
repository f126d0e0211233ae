"""The four flows end to end: preparation, annotation to data set, evaluation, training histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.jsonx import parse_output
from tallyloom.operators import assemble, boundary, chatml, clean, evaluate, history, sample, stats
from tallyloom.sources.readers import once


def prepare(semeval: DataFrame, validation: float = 0.1, seed: int = 42, most: int | None = None, key: str = "sentence_id") -> DataFrame:
    """Annotated sentences as chat text with a split."""
    rows = semeval if most is None else semeval.orderBy(key).limit(most)
    chat = chatml.convert(rows).select(key, chatml.training_text(F.col("text"), F.col("aspects")).alias("text"))
    return sample.split(chat, key, validation, seed)


def as_annotations(ready: DataFrame) -> DataFrame:
    """Reviews ready to annotate under the names that annotations have; recorded answers stay."""
    rating = F.col("rating_value").cast("int") if "rating_value" in ready.columns else F.lit(None).cast("int")
    return ready.select("review_id", "ordinal", F.col("review_text").alias("text"), F.col("object_name").alias("business_name"), "business_category", rating.alias("user_rating"), *[c for c in ("raw_output", "judge_raw") if c in ready.columns])


def build_dataset(reviews: DataFrame, categories: DataFrame, annotator: Callable | None = None, judge: Callable | None = None, size: int = 300, seed: int = 42) -> DataFrame:
    """Raw reviews cleaned, annotated, sampled, judged and merged with their scores."""
    ready = as_annotations(clean.prepare(reviews, categories))
    annotated = boundary.annotate(ready, annotator)
    drawn = sample.stratified(clean.scoreable(annotated), "review_id", size=size, seed=seed)
    judged = boundary.judge(drawn, judge).where("judge_scores is not null").select("review_id", "judge_scores")
    return assemble.merge_scores(annotated.drop("judge_raw"), judged)


def evaluate_outputs(df: DataFrame, chat: str = "chatml", output: str = "raw_output") -> dict[str, DataFrame]:
    """All metrics of model outputs against the gold in chat text; rows without review text are left out and counted.

    Chat text and outputs are parsed once, and the rows' counts are taken in that pass; the metrics read what it wrote.
    """
    parsed = chatml.parse(df, chat)
    counted, seen = stats.observed(parsed, F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("review_text"), F.lit("")) == "").alias("skipped_empty_gold"))
    rows = counted.where("review_text <> ''").withColumn("__p", parse_output(F.col(output)))
    rows = once(rows.withColumns({"predicted": F.col("__p.aspects"), "parse_success": F.col("__p.parse_success")}).drop("__p"))
    matched = evaluate.matched_polarities(rows)
    return {"exact": evaluate.term_metrics(rows), "partial": evaluate.term_metrics(rows, partial=True), "pairs": evaluate.pair_metrics(rows), "accuracy": evaluate.sentiment_accuracy(matched), "macro_f1": evaluate.sentiment_macro_f1(matched), "parse_rate": stats.parse_rate(rows, aspects="predicted"), "skipped": stats.observed_row(df, seen)}


def compare_runs(logs: DataFrame, runs: list[str]) -> dict[str, DataFrame]:
    return {"summary": history.summary(logs), "ema": history.ema(logs), "best": history.running_best(logs), "by_step": history.by_step(logs, runs)}
