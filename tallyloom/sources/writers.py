"""Sinks (SNK1 to SNK12). Time stamps are given by the caller, so that results repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.mathx import FLAG, INCLUDE
from tallyloom.operators import assemble, stats
from tallyloom.schemas import SCORES
from tallyloom.sources.readers import exists, not_yet_done, once, remove


def save_reviews(reviews: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled, that read_reviews reads; an empty text comes back as null."""
    reviews.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def save_json_arrays(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Files of one JSON array each, of so many rows at most; each task makes those of its rows."""
    number = F.monotonically_increasing_id()
    held = df.select(F.to_json(F.struct(*df.columns)).alias("one"), number.alias("n")).withColumn("array", F.struct(F.shiftright("n", 33), F.floor(F.col("n").bitwiseAND((1 << 33) - 1) / F.lit(rows))))
    made = held.groupBy("array").agg(F.sort_array(F.collect_list(F.struct("n", "one"))).alias("all"))
    lines = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["one"]), ",\n"), F.lit("]"))
    made.select(lines.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def save_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def save_annotations(annotations: DataFrame, folder: str, stamp: str) -> None:
    """Annotations without their raw output, all of them under the stamp, their counts and their domains.

    The annotations are computed once, which also counts them; the files are made from what was written then.
    """
    counted, seen = stats.observed(annotations, *stats.quality_counts())
    held = once(counted)
    held.drop("raw_output").write.mode("overwrite").json(f"{folder}/annotated")
    held.write.mode("overwrite").json(f"{folder}/annotated_full_{stamp}")
    stats.with_usable_rate(stats.observed_row(held, seen)).write.mode("overwrite").json(f"{folder}/annotation_stats")
    stats.domain_distribution(held).write.mode("overwrite").json(f"{folder}/domain_distribution")


def save_assembled(merged: DataFrame, folder: str, stamp: str) -> None:
    """All rows, the silver and approved sets, what is flagged if anything is, statistics and the published columns."""
    merged = merged.persist()
    try:
        merged.write.mode("overwrite").json(f"{folder}/full")
        assemble.silver(merged).write.mode("overwrite").json(f"{folder}/silver")
        merged.where("quality_tier = 'include'").write.mode("overwrite").json(f"{folder}/approved")
        flagged = merged.where("quality_tier = 'flag_for_review'")
        if not flagged.isEmpty():
            flagged.write.mode("overwrite").json(f"{folder}/flagged")
        assemble.dataset_stats(merged).withColumn("generated_at", F.lit(stamp)).write.mode("overwrite").json(f"{folder}/stats")
        assemble.published(assemble.silver(merged)).write.mode("overwrite").json(f"{folder}/records")
    finally:
        merged.unpersist()


def judge_report(results: DataFrame) -> DataFrame:
    """One row: counts, overall means, means by domain, the histogram of each score, and the tiers, from one scan.

    Everything is summed up by domain first; the whole is the sum of the domains.
    """
    scored, overall = F.col("judge_scores").isNotNull(), F.coalesce("judge_scores.overall", F.lit(0))
    score = lambda s: F.when(scored, F.col(f"judge_scores.{s}"))
    tiers = {"include_gte_3.5": overall >= INCLUDE, "flag_2.5_to_3.5": (overall >= FLAG) & (overall < INCLUDE), "exclude_lt_2.5": overall < FLAG}
    by = results.groupBy("business_category").agg(
        F.count("*").alias("total"), F.count_if(scored).alias("scored"), *[x for s in SCORES for x in (F.sum(score(s)).alias(f"sum_{s}"), F.count(score(s)).alias(f"n_{s}"))],
        *[F.count_if(score(s) == k).alias(f"{s}_{k}") for s in SCORES for k in range(1, 6)], *[F.count_if(scored & c).alias(f"tier_{i}") for i, c in enumerate(tiers.values())],
    )
    mean = lambda total, n, s: F.round(F.try_divide(total, n), 2).alias(s)
    own = F.struct((-F.col("scored")).alias("order"), "business_category", F.col("scored").alias("count"), *[mean(F.col(f"sum_{s}"), F.col(f"n_{s}"), s) for s in SCORES])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    means = F.when(total("scored") > 0, F.struct(*[mean(F.sum(f"sum_{s}"), F.sum(f"n_{s}"), s) for s in SCORES]))
    shape = F.create_map(*[x for s in sorted(SCORES) for x in (F.lit(s), F.struct(*[total(f"{s}_{k}").alias(str(k)) for k in range(1, 6)]))])
    domains = F.transform(F.sort_array(F.collect_list(F.when(F.col("scored") > 0, own))), lambda r: r.dropFields("order"))
    return by.agg(total("total").alias("total_judged"), total("scored").alias("successfully_scored"), (total("total") - total("scored")).alias("parse_failures"), means.alias("overall_averages"), domains.alias("domain_averages"), shape.alias("score_distribution"), F.struct(*[total(f"tier_{i}").alias(k) for i, k in enumerate(tiers)]).alias("quality_tiers"))


def save_judgements(results: DataFrame, folder: str, provider: str, model: str) -> None:
    results.write.mode("overwrite").json(f"{folder}/judge_results")
    judge_report(results).withColumns({"provider": F.lit(provider), "model": F.lit(model)}).write.mode("overwrite").json(f"{folder}/judge_report")
    stats.report_lines(stats.judge_means(results)).write.mode("overwrite").text(f"{folder}/judge_summary")


def save_conversion(converted: DataFrame, folder: str, **about: str) -> None:
    """The statistics of converted examples, and the same with what is known of the run."""
    save_row(stats.converted_stats(converted), f"{folder}/conversion_stats")
    save_row(stats.converted_stats(converted), f"{folder}/metadata", **about)


def save_row(df: DataFrame, path: str, **about: str) -> None:
    """A one-row report with a metadata block."""
    out = df.withColumn("metadata", F.struct(*[F.lit(v).alias(k) for k, v in about.items()])) if about else df
    out.write.mode("overwrite").json(path)


def save_history(history: DataFrame, path: str, stamp: str = "") -> None:
    """CSV of all columns, and JSON: for each run its training and evaluation logs, with all metrics, and the best evaluation."""
    history.orderBy("run_id", "seq").write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    record = F.struct("seq", *[c for c in history.columns if c not in ("run_id", "seq")])
    logs = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), record)))
    best = F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "seq"))
    runs = history.groupBy("run_id").agg(logs("train_loss").alias("train_logs"), logs("eval_loss").alias("eval_logs"), F.min("eval_loss").alias("best_eval_loss"), F.min_by("step", best).alias("best_eval_step"), F.count("train_loss").alias("total_steps"))
    runs.withColumn("exported_at", F.lit(stamp)).write.mode("overwrite").json(f"{path}/json")


def in_batches(df: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "review_id", every: int = 1000) -> DataFrame:
    """work(df) for about every rows at a time, appended to path; what an earlier run has written is left out."""
    spark = df.sparkSession
    todo = not_yet_done(df, spark.read.parquet(path) if exists(spark, path) else None, key)
    parts = max(1, -(-todo.count() // every))
    for k in range(parts):  # each waits for the one before, for what is written must outlive a failure
        append_batch(work(todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)), path)
    return spark.read.parquet(path)


def finish(df: DataFrame, checkpoint: str, target: str) -> None:
    """The results under target; only when they are there the checkpoint goes."""
    df.write.mode("overwrite").parquet(target)
    remove(df.sparkSession, checkpoint)


def append_batch(df: DataFrame, path: str) -> None:
    """A checkpoint: rows that a later run will find done."""
    df.write.mode("append").parquet(path)


def save_taxonomy(names: DataFrame, path: str, taxonomy: DataFrame | None = None) -> None:
    """Distinct (business_category, object_name), sorted; and, beside it, the taxonomy (domain, position, subcategory) if given."""
    names.select("business_category", "object_name").distinct().orderBy("business_category", "object_name").write.mode("overwrite").json(path)
    if taxonomy is not None:
        taxonomy.orderBy("domain", "position").write.mode("overwrite").json(f"{path}_domains")


def insert_section(log: str, section: str, marker: str) -> str:
    """A section put before an end marker of a text, at its end where there is none."""
    at = log.rfind(marker)
    return log + section if at < 0 else log[:at] + section + log[at:]


def card(title: str, rows: list[dict]) -> str:
    """A Markdown card with a table of metrics, from rows that were computed."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(r.get(n, "")) for n in names) + " |" for r in rows]) + "\n"
