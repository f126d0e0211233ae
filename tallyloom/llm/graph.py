"""Connected components of a table of links, and comparison of the members of groups tile by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, partitions, small_batches
from tallyloom.workers import ship

#: Rows of a group in one tile at most; a larger group is split, and each two parts meet in a tile of their own.
TILE = 512


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the least node reachable.

    Labels pass along links and then to the label of the label, until none changes. Every round reads written
    tables, so a hot node's rows meet its one label in a join that can be split, and minima combine before a shuffle.
    """
    pairs = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = scratch.save(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), f"{name}-0")
    total, step = None, 0
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first().s
        if now == total:
            scratch.drop(f"{name}-links")
            return labels.select("node", F.col("label").alias("component"))
        total, step = now, step + 1
        passed = pairs.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        met = scratch.save(labels.union(passed).groupBy("node").agg(F.min("label").alias("label")), f"{name}-{step}a")
        further = met.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = scratch.save(met.join(further, "label", "left").select("node", F.least("label", "next").alias("label")), f"{name}-{step}")
        scratch.drop(f"{name}-{step}a", f"{name}-{step - 1}")
        labels = jumped


def deal(members: DataFrame, scratch: Scratch, name: str, key: str = "key", member: str = "id") -> DataFrame:
    """The members of groups of two or more, a row for each tile (__tile) that compares them.

    A group's members fall into parts (__own) of TILE or so; a tile holds one part (__same) or two, and every two
    members meet in exactly one tile of their group.
    """
    sizes = scratch.save(members.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1"), f"{name}-sizes")
    parts = F.ceil(F.col("__n") / TILE).cast("int")
    held = members.join(sizes, key).withColumn("__parts", parts).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__parts")).cast("int"))
    return held.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).withColumn("__tile", F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other"))).withColumn("__same", F.col("__own") == F.col("__other")).drop("__n", "__parts", "__other")


def tiles(dealt: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """What judge makes of each tile.

    judge(rows, left, right): a record batch and two arrays of row numbers; every one of left is to be compared with
    every one of right, or, if they are the same object, each two of them once. It returns a record batch or None;
    with a few rows for each of the tile's, what leaves a tile is linear in what enters it.
    """
    spark = dealt.sparkSession
    ship(spark)
    small_batches(spark)

    def tile(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        own, same = rows.column(rows.schema.names.index("__own")).to_numpy(), rows.column(rows.schema.names.index("__same")).to_numpy(zero_copy_only=False)
        if same[0]:
            at = np.arange(rows.num_rows)
            return judge(rows, at, at) if len(at) > 1 else None
        first = own == own.min()
        return judge(rows, np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            rows = table.combine_chunks().to_batches()[0] if table.num_rows else None
            if rows is None:
                continue
            key_at = rows.column(rows.schema.names.index("__tile")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key_at)) + 1).tolist()]
            yield from (out for s, e in zip(cuts, cuts[1:], strict=False) if (out := tile(rows.slice(s, e - s))) is not None)
            rest = pa.Table.from_batches([rows.slice(cuts[-1])])
        if rest is not None and rest.num_rows and (out := tile(rest.combine_chunks().to_batches()[0])) is not None:
            yield out

    return dealt.repartition(partitions(spark), "__tile").sortWithinPartitions("__tile").mapInArrow(run, schema)


def lowest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the least id that the links between rows i and j reach."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new
