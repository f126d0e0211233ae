"""Calls to models outside the engine (UD3 to UD9): a protocol, a replay of recorded answers, and batch annotation.

An annotator takes batches of rows with a prompt and adds raw text; Spark runs one for each partition. Results must be
written and left out of later runs, for calls are dear and not repeatable.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.functions.jsonx import parse_judgement, parse_output, read_judgement
from tallyloom.operators.chatml import inference_prompt, judge_prompt
from tallyloom.operators.stats import annotation_quality
from tallyloom.schemas import ANNOTATION_SOURCE, TRAIN_LOG
from tallyloom.streaming.incremental import resumable
from tallyloom.workers import ship

Answer = Callable[[list[str]], list[str | None]]
#: Rows that a worker takes out of a batch at a time.
ROWS = 256


def backoff(attempt: int, first: float = 5, most: float = 60) -> float:
    return min(most, first * 2**attempt)


def pause(attempt: Column, first: float = 5, most: float = 60) -> Column:
    """backoff() of a column of attempts."""
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), attempt))


class Busy(Exception):
    """The service asks to come again later."""


class Refused(Exception):
    """The service will not answer these prompts; the rows stay without an answer."""


class Gate:
    """What the calls of one task share: a rate, and a pause that one busy answer makes all of them take.

    Tokens come at a rate a second, up to burst of them; a call takes one. A busy answer to a call that began after the
    last pause makes the next, longer one; calls in flight that are turned away with it wait for the same. Any answer
    ends the row of pauses; after patience of them the error goes on.
    """

    def __init__(self, rate: float | None, burst: int, patience: int, sleep: Callable[[float], None]):
        self.rate, self.burst, self.patience, self.sleep = rate, burst, patience, sleep
        self.lock, self.ahead, self.pauses, self.row = threading.Lock(), 0.0, 0, 0
        self.tokens, self.at, self.until = float(burst), time.monotonic(), 0.0

    def now(self) -> float:
        return time.monotonic() + self.ahead

    def enter(self) -> int:
        """Waits for the pause and for a token; which pause a call follows."""
        while True:
            with self.lock:
                now = self.now()
                wait = self.until - now
                if wait <= 0 and self.rate:
                    self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
                    wait = (1 - self.tokens) / self.rate
                if wait <= 0:
                    self.tokens -= 1
                    return self.pauses
            self.sleep(wait)
            with self.lock:  # a sleep that only pretends to last counts as if it had
                self.ahead = max(self.ahead, now + wait - time.monotonic())

    def answered(self) -> None:
        with self.lock:
            self.row = 0

    def busy(self, seen: int, error: Busy) -> None:
        with self.lock:
            if seen == self.pauses:
                if self.row >= self.patience:
                    raise error
                self.until = self.now() + backoff(self.row)
                self.pauses, self.row = self.pauses + 1, self.row + 1


def ask(
    df: DataFrame, prompt: str, answer: str, make: Callable[[], Answer], tries: int = 3, accept: Callable[[str | None], bool] = lambda a: a is not None,
    sleep: Callable[[float], None] = time.sleep, patience: int = 8, window: int = 1, size: int | None = None, rate: float | None = None,
) -> DataFrame:
    """df with a column of answers. make builds a client in each partition; an answer not accepted is asked for again.

    A call has size prompts (None: as many as are taken out of a batch at a time, ROWS at most), and window calls of a partition are in flight at a time, rate of them a
    second begun at most; the client is called from as many threads. Answers come in the order of the rows. A busy service
    is no try: all calls wait a growing pause, and after patience pauses in a row the job ends with its error, as with any
    other but Refused, which leaves the rows of its call without an answer. The last answer stays, accepted or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, gate, step = make(), Gate(rate, window, patience, sleep), size or ROWS
        taken = max(ROWS, 8 * window * size) if size else ROWS

        def asked(prompts: list[str]) -> list[str | None]:
            answers: list[str | None] = [None] * len(prompts)
            todo, tried = list(range(len(prompts))), 0
            while todo and tried < tries:
                seen = gate.enter()
                try:
                    got = client([prompts[i] for i in todo])
                except Busy as e:
                    gate.busy(seen, e)
                    continue
                except Refused:
                    break
                gate.answered()
                tried += 1
                for i, a in zip(todo, got, strict=True):
                    answers[i] = a
                todo = [i for i in todo if not accept(answers[i])]
            return answers

        with ThreadPoolExecutor(window) as pool:
            for batch in batches:
                # some calls at a time: as Python's strings a whole batch of long texts takes many times its bytes
                for first in range(0, batch.num_rows, taken):
                    rows = batch.slice(first, taken)
                    prompts = rows.column(prompt).to_pylist()
                    got = pool.map(asked, [prompts[i : i + step] for i in range(0, len(prompts), step)])
                    columns = dict(zip(rows.schema.names, rows.columns, strict=True))
                    columns[answer] = pa.array([a for part in got for a in part], rows.column(prompt).type)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.withColumn(answer, F.lit(None).cast("string")).schema)


def annotate(df: DataFrame, make: Callable[[], Answer] | None = None, text: str = "text", recorded: str = "raw_output", english: bool = False, **calls) -> DataFrame:
    """df with raw_output, aspects, num_aspects and parse_success; without a client recorded answers are read again."""
    asked = df if make is None else ask(df.withColumn("prompt", inference_prompt(F.col(text), english)), "prompt", recorded, make, **calls).drop("prompt")
    held = asked.withColumn("__parsed", parse_output(F.col(recorded)))
    return held.select(*[c for c in asked.columns if c not in ("aspects", "num_aspects", "parse_success", "annotation_source")], F.col("__parsed.aspects").alias("aspects"), F.size("__parsed.aspects").alias("num_aspects"), F.lit(ANNOTATION_SOURCE).alias("annotation_source"), F.col("__parsed.parse_success").alias("parse_success"))


def judge(df: DataFrame, make: Callable[[], Answer] | None = None, recorded: str = "judge_raw", **calls) -> DataFrame:
    """df with judge_raw and judge_scores; an answer that is no judgement is asked for again. calls: as ask() takes them."""
    prompt = judge_prompt(F.col("text"), F.col("business_name"), F.col("business_category"), F.col("user_rating"), F.col("aspects"))
    asked = df if make is None else ask(df.withColumn("prompt", prompt), "prompt", recorded, make, accept=lambda a: read_judgement(a) is not None, **calls).drop("prompt")
    return asked.withColumn("judge_scores", parse_judgement(F.col(recorded)))


def annotate_all(df: DataFrame, path: str, make: Callable[[], Answer] | None = None, every: int = 1000, **calls) -> tuple[DataFrame, DataFrame]:
    """All annotations, written to path some rows at a time so that a later run goes on from there, and their counts."""
    done = resumable(df, path, lambda rows: annotate(rows, make, **calls), every=every)
    return done, annotation_quality(done)


def analyze(spark: SparkSession, text: str, make: Callable[[], Answer]) -> DataFrame:
    """The one row of a single text's annotation."""
    return annotate(spark.createDataFrame([(text,)], "text string"), make)


class LogCapture:
    """Collects a trainer's log records, for tables of the training log; a run logs some thousands of them."""

    def __init__(self, run_id: str):
        self.run_id, self.rows, self.ended = run_id, [], False

    def on_log(self, step: int, epoch: float | None, logs: dict[str, float] | None) -> None:
        """A training record; the trainer's loss is named train_loss, and metrics that a log has no column for go."""
        if logs is not None:
            named = {("train_loss" if k == "loss" else k): v for k, v in logs.items()}
            rounded = {k: round(float(v), 6) if k in ("train_loss", "grad_norm") else float(v) for k, v in named.items() if k in TRAIN_LOG.names}
            self.rows.append({"step": step, "epoch": None if epoch is None else round(epoch, 4)} | rounded)

    on_evaluate = on_log

    def on_train_end(self) -> None:
        self.ended = True

    def frame(self, spark: SparkSession) -> DataFrame:
        whole = [{f: r.get(f) for f in TRAIN_LOG.names} | {"run_id": self.run_id, "seq": i} for i, r in enumerate(self.rows)]
        return spark.createDataFrame(whole, StructType([*TRAIN_LOG.fields, StructField("run_id", StringType()), StructField("seq", LongType())]))
