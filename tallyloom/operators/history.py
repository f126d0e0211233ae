"""Training histories (AG18, WIN1, WIN4, JN10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.readers import once

ALPHA = 0.1


def summary(history: DataFrame) -> DataFrame:
    """A row for each run: counts, first, last, extremes and reduction of the training loss, and the best evaluation."""
    loss, ev = F.col("train_loss"), F.col("eval_loss")
    at = lambda c: F.when(c.isNotNull(), F.col("seq"))
    step = F.when(F.col("train_runtime").isNull(), loss) if "train_runtime" in history.columns else loss
    rows = history.groupBy("run_id").agg(
        F.count(loss).alias("n_train"), F.count(ev).alias("n_eval"), F.min_by(loss, at(loss)).alias("first_loss"), F.max_by(loss, at(loss)).alias("final_loss"), F.max_by(step, at(step)).alias("last_step_loss"), F.min(loss).alias("min_loss"), F.max(loss).alias("max_loss"),
        F.min(ev).alias("best_eval_loss"), F.min_by("step", F.when(ev.isNotNull(), F.struct(ev, F.col("seq")))).alias("best_eval_step"),
        *([F.max("learning_rate").alias("peak_learning_rate")] if "learning_rate" in history.columns else []),
    )
    return rows.withColumn("reduction", F.col("first_loss") - F.col("final_loss")).withColumn("reduction_pct", F.coalesce(F.try_divide(F.col("reduction") * 100, F.col("first_loss")), F.lit(0.0)))


def in_ranges(history: DataFrame, value: str) -> DataFrame:
    """(run_id, seq, value, __part): the points of all runs dealt by ranges of run and seq, so one long run is many parts."""
    points = history.where(F.col(value).isNotNull()).select("run_id", "seq", F.col(value).cast("double").alias("value"))
    return points.repartitionByRange("run_id", "seq").withColumn("__part", F.spark_partition_id())


def folded(parts: DataFrame, alpha: float) -> DataFrame:
    """(run_id, __part, n, first, weight, share): over a part, a state s becomes weight * s + share."""
    whole = Window.partitionBy("run_id", "__part")
    left = F.count("*").over(whole) - F.row_number().over(whole.orderBy("seq"))
    points = parts.withColumn("__share", F.col("value") * alpha * F.pow(F.lit(1 - alpha), left))
    return points.groupBy("run_id", "__part").agg(F.count("*").alias("n"), F.min_by("value", "seq").alias("first"), F.pow(F.lit(1 - alpha), F.count("*")).alias("weight"), F.sum("__share").alias("share"))


def ema_last(history: DataFrame, value: str = "train_loss", alpha: float = ALPHA) -> DataFrame:
    """The last exponential moving average of each run, which starts from its first value.

    The average is a fold that composes: parts of a run are summed up where they are, and a run is a few parts.
    """
    steps = folded(in_ranges(history, value), alpha)
    runs = steps.groupBy("run_id").agg(F.sum("n").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("__part", "first", "weight", "share"))).alias("parts"))
    return runs.select("run_id", "n", F.aggregate("parts", F.element_at("parts", 1)["first"], lambda s, p: s * p["weight"] + p["share"]).alias("ema"))


def ema(history: DataFrame, value: str = "train_loss", alpha: float = ALPHA) -> DataFrame:
    """(run_id, seq, value, ema) for all points: each part goes on from the state that the parts before it leave."""
    parts = once(in_ranges(history, value))
    before = Window.partitionBy("run_id").orderBy("__part")
    listed = F.collect_list(F.struct("weight", "share")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    state = F.aggregate(listed, F.first("first").over(before), lambda s, p: s * p["weight"] + p["share"])
    starts = folded(parts, alpha).select("run_id", "__part", state.alias("__state"))  # a row for each part of a run

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        chain = pd.concat([rows["__state"].iloc[:1], rows["value"]], ignore_index=True).ewm(alpha=alpha, adjust=False).mean()
        return rows.assign(ema=chain.iloc[1:].to_numpy())[["run_id", "seq", "value", "ema"]]

    return parts.join(starts, ["run_id", "__part"]).groupBy("run_id", "__part").applyInPandas(run, "run_id string, seq long, value double, ema double")


def running_best(history: DataFrame, value: str = "eval_loss") -> DataFrame:
    """The least value so far: within each part of a run, and over the parts before it."""
    parts = once(in_ranges(history, value))
    earlier = F.min("least").over(Window.partitionBy("run_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("run_id", "__part").agg(F.min("value").alias("least")).select("run_id", "__part", earlier.alias("__before"))
    within = F.min("value").over(Window.partitionBy("run_id", "__part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(starts, ["run_id", "__part"]).select("run_id", "seq", F.col("value").alias(value), F.least(within, "__before").alias("best"))


def by_step(history: DataFrame, runs: list[str], value: str = "eval_loss") -> DataFrame:
    """A row for each step and a column for each run."""
    return history.where(F.col(value).isNotNull()).groupBy("step").pivot("run_id", runs).agg(F.min_by(value, "seq"))
