"""Hard negatives by a full sort of every anchor's scores (operator 11).

Anchors and rows are packed into blocks of bounded bytes, and each block of anchors meets each block of rows once, in a
join whose keys are dealt evenly. There the integer scores of the block are sorted for each anchor by score and id. A
first round gives the best rows of the anchor's own label, its positives; in a second a binary search in the sorted
scores finds where each positive's range begins, and the first rows of other labels are read off. What a block hands
on is a few rows for each anchor; the best of them are kept before the shuffle and once more after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, give_back, partitions, small_batches
from tallyloom.workers import ship

#: Rows of a block at most, of anchors and of all rows, and bytes of a block's components.
ANCHORS, ROWS, BYTES = 256, 8192, 4 << 20
MOST = (1 << 63) - 1


def numbered(vectors: DataFrame, is_anchor: Column, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(rid, id, label, e, anchor): usable rows with a number each and their scaled components."""
    e = F.transform(F.col(embedding), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), e.alias("e"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where("id is not null and label is not null and e is not null")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).withColumn("rid", F.monotonically_increasing_id())


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(block, body): rows of a task in Arrow's stream format, at most so many and BYTES together, one at least.

    Components are rounded down here. A block's number tells its task and its place there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(task << 31) + made]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])

        count = 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.list_value_length(batch.column(batch.schema.names.index("e"))).to_pylist()):
                if count and (size + 8 * n > BYTES or count >= most):
                    held.append(batch.slice(start, i - start))
                    yield block()
                    made, held, size, count, start = made + 1, [], 0, 0, i
                size, count = size + 8 * n, count + 1
            held.append(batch.slice(start))
        if count:
            yield block()
        give_back()

    ship(rows.sparkSession)
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "block long, body binary")


class Block:
    """The rows of a packed block; components as doubles that hold whole numbers, padded with zeros."""

    def __init__(self, body: bytes):
        with pa.ipc.open_stream(body) as s:
            table = s.read_all().combine_chunks()
        self.table = table
        self.rid, self.id = table["rid"].to_numpy(), table["id"].to_numpy()
        lists = table["e"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
        self.x = np.zeros((len(sizes), int(sizes.max(initial=0))))
        self.x[np.arange(self.x.shape[1]) < sizes[:, None]] = flat


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond a long's range the nearest long."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    return np.array([[max(-MOST, min(MOST, sum(map(int.__mul__, p, q)))) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def ranges(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """For each positive's score the least and the greatest score of a negative, in whole per cent of it."""
    return [(max(-MOST, -((-low * s) // 100)), min(MOST, (high * s) // 100)) for s in scores]


def cells(anchors: DataFrame, rows: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """What judge makes of (a block of anchors, a block of rows) for each two of them.

    A block of anchors goes to as many places as there are partitions, a block of rows to one of them for each block
    of anchors: no place gets more than its share, however few the anchors are.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    keys = [r.block for r in anchors.select("block").collect()]  # a number for each ANCHORS anchors
    places = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = anchors.select(F.col("block").alias("to"), F.col("body").alias("anchors"), F.explode(places).alias("place"))
    at = F.pmod(F.shiftright("block", 31) + F.col("block").bitwiseAND(MOST >> 32), F.lit(n))
    right = rows.select(at.alias("place"), "body", F.explode(F.array(*[F.lit(k) for k in keys])).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, block = None, None
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                if seen != (now := a.as_py()):
                    seen, block = now, Block(now)
                if (out := judge(block, Block(b.as_py()))) is not None and out.num_rows:
                    yield out
        give_back()

    return left.join(right.hint("merge"), ["to", "place"]).select("anchors", "body").mapInArrow(run, schema)


def sorted_scores(a: Block, b: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, row numbers by score, the greatest first, then id, their scores negated) for each anchor."""
    down = -inner(a.x, b.x)
    for i in range(len(down)):
        order = np.lexsort((b.rid, b.id, down[i]))
        yield i, order, down[i][order]


def labels_of(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    codes = pa.chunked_array([a.table["label"].combine_chunks(), b.table["label"].combine_chunks()]).combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[: len(a.rid)], codes[len(a.rid) :]


def best(rows: DataFrame, keys: list[str], score: str, id_: str, most: int) -> DataFrame:
    """The first most rows of each key with their rank; Spark keeps so many in each task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    A score is the inner product of the components, each times scale and rounded down. An anchor's positives are its
    best other rows of the same label; a positive's negatives the best rows of other labels whose score lies between
    low and high per cent of the positive's (none if that is negative). Ties go by id.

    is_anchor: a condition on the columns of vectors; null is no. Rows with a null label or vector, or with null or non-finite components,
    also after scaling, take no part; nor do rows with a null id. Of vectors of unequal lengths the shorter is filled up
    with zeros. Rows are told apart by more than their id, so a repeated row is another row, and a repeated anchor gives
    its rows again. Anchors without a positive, and positives without a negative, give no row; so does an empty table.
    Scores beyond a long's range become its nearest end. Ids are whole numbers, cast to long; labels are compared as text.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    n = partitions(spark)
    rows = scratch.save(numbered(vectors, is_anchor, vec_id, embedding, label, scale), "rows")
    chosen = rows.where("anchor").drop("anchor")
    blocks = scratch.save(packed(rows.drop("anchor").repartition(n), ROWS), "blocks")
    asked = scratch.save(packed(chosen.repartition(max(1, -(-chosen.count() // ANCHORS))), ANCHORS), "anchors")
    if asked.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def own_label(a: Block, b: Block) -> pa.RecordBatch:
        mine_, theirs = labels_of(a, b)
        out: list[tuple] = []
        for i, order, down in sorted_scores(a, b):
            same = np.flatnonzero((theirs[order] == mine_[i]) & (b.rid[order] != a.rid[i]))[:positives]
            out += zip([int(a.rid[i])] * len(same), (-down[same]).tolist(), b.id[order[same]].tolist(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], ["rid", "positive_score", "positive_id"])

    near = scratch.save(best(cells(asked, blocks, own_label, "rid long, positive_score long, positive_id long"), ["rid"], "positive_score", "positive_id", positives), "positives")
    lists = near.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("positives"))
    ready = chosen.join(lists, "rid")
    asked = scratch.save(packed(ready.repartition(max(1, -(-ready.count() // ANCHORS))), ANCHORS), "ready")
    if asked.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def other_labels(a: Block, b: Block) -> pa.RecordBatch:
        mine_, theirs = labels_of(a, b)
        held = a.table["positives"].to_pylist()
        out: list[tuple] = []
        for i, order, down in sorted_scores(a, b):
            other = np.flatnonzero(theirs[order] != mine_[i])
            down = down[other]
            for p, (least, greatest) in zip(held[i], ranges([p["positive_score"] for p in held[i]], low, high), strict=True):
                first = int(np.searchsorted(down, -greatest, "left"))
                last = min(first + negatives, int(np.searchsorted(down, -least, "right")))
                if first < last:
                    found = other[first:last]
                    out += zip([int(a.rid[i])] * len(found), [int(a.id[i])] * len(found), [p["rank"]] * len(found), [p["positive_score"]] * len(found), [p["positive_id"]] * len(found), (-down[first:last]).tolist(), b.id[order[found]].tolist(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 7)], ["rid", "anchor_id", "place", "positive_score", "positive_id", "negative_score", "negative_id"])

    found = cells(asked, blocks, other_labels, "rid long, anchor_id long, place long, positive_score long, positive_id long, negative_score long, negative_id long")
    return best(found, ["rid", "place"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

