"""Work in small batches as a stream: rows of a table for dear calls, and new reviews as they come (an extension).

Spark's checkpoint tells which batches are done, so that a run that was stopped goes on behind the last of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tallyloom.functions.jsonx import parse_output
from tallyloom.operators.clean import LEAST_CHARS, has_text
from tallyloom.operators.history import ALPHA
from tallyloom.sources.readers import children, exists, not_yet_done, remove
from tallyloom.workers import ship


def annotate_stream(spark: SparkSession, source: str, schema: StructType, target: str, state: str, text: str = "review_text", raw: str = "raw_output") -> StreamingQuery:
    """Reads Parquet files as they come and appends parsed rows to target; a file is handled once."""
    rows = spark.readStream.schema(schema).parquet(source)
    kept = rows.where(has_text(F.col(text)) & (F.length(text) >= LEAST_CHARS)).withColumn("parsed", parse_output(F.col(raw)))
    return kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, with a watermark for late events; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def resumable(df: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "review_id", every: int = 1000) -> DataFrame:
    """All that work makes of df, about every rows at a time, under path; what an earlier run has written is left out.

    The rows to be done are read once and written in small files, which a stream takes some at a time; a batch's results
    are written under the batch's number, so that one that is done again replaces its own half. A run that was stopped
    goes on with the rows and the batches it had; then what df has besides follows. The rows' files and the stream's
    state go when all is done. An empty df gives work's columns. Rows of one key are done once if a run has finished
    with one of them; within a run each row is done.
    """
    spark = df.sparkSession
    todo, slots = f"{path}_todo", max(1, spark.sparkContext.defaultParallelism)
    fresh = False
    while not fresh:
        run = next(iter(children(spark, todo)), None)
        if run is None:
            run, fresh = uuid.uuid4().hex, True
            left = not_yet_done(df, results(spark, path) if exists(spark, path) else None, key)
            left.write.option("maxRecordsPerFile", max(1, every // slots)).parquet(f"{todo}/{run}/rows")
        if not fresh and not exists(spark, f"{todo}/{run}/rows/_SUCCESS"):  # stopped while it wrote them
            remove(spark, f"{todo}/{run}")
            continue

        def one(rows: DataFrame, number: int, run: str = run) -> None:
            work(rows).write.mode("overwrite").parquet(f"{path}/{run}/{number}")

        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", slots).parquet(f"{todo}/{run}/rows")
        source.writeStream.foreachBatch(one).option("checkpointLocation", f"{todo}/{run}/state").trigger(availableNow=True).start().awaitTermination()
        remove(spark, todo)
    if not exists(spark, path):
        work(df.limit(0)).write.parquet(f"{path}/none")
    return results(spark, path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """What is written under path, in whatever folders."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


LIVE = "run_id string, n long, ema double, best double, best_step long, last_seq long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunState(StatefulProcessor):
    """What is kept of each run: its count, moving average, least value and where that was, whatever the log's length."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, ema double, best double, best_step long, last_seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(rows).sort_values("seq")
        n, ema, best, step, last = self.held.get() if self.held.exists() else (0, None, None, None, -1)
        new = new[new["seq"] > last]  # what a file brings again is not counted again
        if len(new):
            chain = new["value"] if n == 0 else pd.concat([pd.Series([ema]), new["value"]])
            ema = float(chain.ewm(alpha=self.alpha, adjust=False).mean().iloc[-1])
            least = float(new["value"].min())
            if best is None or least < best:
                best, step = least, int(new["step"].loc[new["value"] == least].iloc[0])
            n, last = n + len(new), int(new["seq"].iloc[-1])
            self.held.update((n, ema, best, step, last))
        yield pd.DataFrame({"run_id": [key[0]], "n": [n], "ema": [ema], "best": [best], "best_step": [step], "last_seq": [last]})

    def close(self) -> None:
        pass


def live_history(log: DataFrame, value: str = "train_loss", alpha: float = ALPHA) -> DataFrame:
    """(run_id, n, ema, best, best_step, last_seq) of each run that a batch of a training log brings points of.

    log: a stream with run_id, seq, step and value; a run's points come in the order of seq from batch to batch, those of
    one batch in any. Points without a value, and points up to the last one seen, change nothing. The state of a run is
    five numbers, kept in RocksDB, so runs may be many and long.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(log.sparkSession)
    points = log.where(F.col(value).isNotNull()).select(F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), F.col("step").cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return points.groupBy("run_id").transformWithStateInPandas(RunState(alpha), LIVE, "Update", "None")


def follow(log: DataFrame, target: str, state: str, value: str = "train_loss", alpha: float = ALPHA) -> StreamingQuery:
    """Writes what live_history says after each batch under target, by the batch's number; the last of each run is its state."""

    def one(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/{number}")

    return live_history(log, value, alpha).writeStream.foreachBatch(one).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
