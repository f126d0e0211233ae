"""Sources (SRC1 to SRC14): explicit schemas, no inference, paths that Spark's readers resolve."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom import schemas
from tallyloom.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none of one that isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)) if exists(spark, path) else []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset (tests, one machine)."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if held:
        return held.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def once(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, where its rows stand whatever becomes of executors.

    The files go when the application ends, for the frame may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may be gone
        remove(spark, path)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """The rows with numbers that ascend in file order. They have gaps; operators ask for order only."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_reviews(spark: SparkSession, path: str, text_column: str | None = "review_text", schema: StructType = schemas.RAW_REVIEW) -> DataFrame:
    """A CSV file with a header; ValueError if it lacks text_column (None: not asked)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    names = reader.csv(path).columns
    if text_column is not None and text_column not in names:
        raise ValueError(f"no column {text_column!r}; there are {names}")
    kinds = {f.name: f for f in schema}
    whole = StructType([kinds.get(n, StructType().add(n, "string")[0]) for n in names])
    return with_ordinal(reader.schema(whole).csv(path))


def read_json_array(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """JSON arrays, of which a task reads a whole file; or, if so told, an object on each line, which split."""
    return with_ordinal(spark.read.option("multiLine", not lines).schema(schema).json(path))


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_json_array(spark, path, schemas.ANNOTATION, lines)


def read_judgements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(review_id, judge_scores) of judged rows, the last of each id."""
    return last_of_each(read_json_array(spark, path, schemas.JUDGE_RESULT, lines).where("judge_scores is not null"), "review_id", "judge_scores")


def last_of_each(df: DataFrame, key: str, value: str, ordinal: str = "ordinal") -> DataFrame:
    """Like a dict built row by row: the last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def read_categories(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(object_name, business_category), the last of each name."""
    rows = read_json_array(spark, path, schemas.CATEGORY, lines)
    return last_of_each(rows, "object_name", "business_category")


def read_split(spark: SparkSession, path: str, split: str | None = None, prefer: Sequence[str] = ("test", "validation")) -> DataFrame:
    """A table partitioned by split: the split named, or all; see pick_split for a default."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def pick_split(df: DataFrame, prefer: Sequence[str] = ("test", "validation")) -> DataFrame:
    """The first preferred split that there is, else the first by name; splits are few."""
    there = sorted(r.split for r in df.select("split").distinct().collect())
    chosen = next((s for s in prefer if s in there), there[0] if there else None)
    return df.where(F.col("split") == chosen)


def read_or(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """The table at path; where there is none, the fallback, which stands for a remote data set."""
    if exists(spark, path):
        return spark.read.parquet(path)
    if fallback is None:
        raise FileNotFoundError(path)
    return fallback


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file, stripped, without blank ones."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")


def read_latest(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """The rows of the last file, or folder, by name; only that one is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    names = sorted((f.getPath().getName(), f.getPath().toString()) for f in found)
    if not names:
        raise FileNotFoundError(pattern)
    return spark.read.option("multiLine", True).schema(schema).json(names[-1][1])


def read_optional_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    return spark.read.option("multiLine", True).schema(schema).json(path) if exists(spark, path) else None


def read_histories(spark: SparkSession, folders: Sequence[str], name: str = "training_history.csv") -> DataFrame:
    """The training logs of those folders that have one, with run_id (the folder's name) and seq (file order)."""
    paths = [f"{f.rstrip('/')}/{name}" for f in folders]
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schemas.TRAIN_LOG).withColumn("run_id", F.lit("")).withColumn("seq", F.lit(0).cast("long"))
    frames = []
    for p in paths:
        names = spark.read.option("header", True).csv(p).columns
        kinds = {f.name: f for f in schemas.TRAIN_LOG}
        one = spark.read.option("header", True).schema(StructType([kinds[n] if n in kinds else StructType().add(n, "string")[0] for n in names])).csv(p)
        one = with_ordinal(one, "seq").withColumn("run_id", F.lit(p.split("/")[-2]))
        frames.append(one)
    return union_of(frames)


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, with every column that any frame has, in the order in which they are first seen."""
    out = frames[0]
    for one in frames[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def inspect(df: DataFrame) -> DataFrame:
    """(position, column, kind, n_rows, first): a row for each column, with the first row's value as text of 100 characters."""
    one = df.limit(1).select(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.substring((F.to_json(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name).cast("string")), 1, 100).alias("first")) for i, f in enumerate(df.schema)]).alias("__c"))
    kinds = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "position int, column string, kind string")
    seen = one.select(F.explode("__c").alias("c")).select("c.position", "c.first")
    return kinds.join(seen, "position", "left").crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows")))).select("position", "column", "kind", "n_rows", "first")  # n_rows is one row


def not_yet_done(df: DataFrame, done: DataFrame | None, key: str = "review_id") -> DataFrame:
    """Rows whose key an earlier run has not written."""
    return df if done is None else df.join(done.select(key).distinct(), key, "left_anti")


def first_rows(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def dense_ordinal(df: DataFrame, order: str = "ordinal", name: str = "position") -> DataFrame:
    """0, 1, 2, ... in the order of a column, without one task for all rows.

    Rows are put in ranges of the order; each range's rows are counted, and the counts before it added to the ranks in it.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    ranged = once(ranged)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("__rank", rank).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before")
