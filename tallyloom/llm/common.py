"""Helpers shared by the operators: scratch tables in the cluster's shared folder, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.readers import shared_folder
from tallyloom.workers import ship

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 1 << 20
#: Rows and bytes that the JVM hands to a worker at a time, and the session's settings for them: both sides hold whole
#: batches.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a read and not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)  # results may be read until the application ends

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.delete(f"{self.root}/{name}")

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of finished steps: it does when the driver's objects for them are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        with suppress(Exception):  # the JVM may be gone
            self.delete(self.root)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of that column, of one row at least."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lens):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    with suppress(Exception):  # a setting of later versions
        if spark.conf.get(BYTES_SETTING) != str(BATCH_BYTES):
            spark.conf.set(BYTES_SETTING, BATCH_BYTES)


def give_back() -> None:
    """Free memory goes back to the system, for a worker stays after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: str | None = None, most: int = SLICE_BYTES, rows: int = 10_000) -> DataFrame:
    """mapInArrow with state made once for each task; batches are cut by the bytes of column text and by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, most) if text else [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)]:
                if part.num_rows and (out := work(part)) is not None:
                    yield out
        del work
        give_back()

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def hash_order(*columns: str):
    """A number below 2 ** 52 by which rows are drawn, from some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52))


def least_hashed(rows: DataFrame, key: str, salt: str, most: int, total: int) -> DataFrame:
    """The rows of least hash of their key, at most so many of a known total.

    A bound that twice as many are expected to pass comes first, so that tasks hand over a few rows each, not most.
    """
    order = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52))
    bound = int((1 << 52) * min(1.0, (2 * most + 200) / max(1, total)))
    return rows.where(order < bound).orderBy(order, key).limit(most)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
