"""Packing of documents into sequences by cutting-stock column generation (operator 3).

A document longer than a sequence is cut into full sequences and one tail. The tails' length histogram, in
classes of a few tokens, is the demand of a cutting-stock problem: a linear program over patterns (which
classes share a sequence) whose columns come from a knapsack dynamic program priced with the program's duals.
Rounded patterns take documents by their rank within a length class. Only the histogram, of a size fixed by
the sequence length, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import table_of
from tallyloom.llm.common import Scratch, map_arrow, texts_of
from tallyloom.llm.tokenizing import vocabulary

#: Length classes of the linear program at most; lengths are rounded up to a multiple of capacity / CLASSES.
CLASSES = 256
#: The linear program stops when its value is within this share of Farley's lower bound.
GAP = 5e-4


def knapsack(value: np.ndarray, length: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within capacity, by dynamic programming; length ascends."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(length, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            got = value[:n] + best[c - length[:n]]
            if got[k := int(got.argmax())] > best[c] + 1e-12:
                best[c], choice[c] = got[k], k
    taken, c = np.zeros(len(length), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= length[choice[c]]
    return float(best[capacity]), taken


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss and Jordan's elimination, a row at a time: no threads that wait for each other."""
    m = len(a)
    x = np.hstack([a.astype(float), np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(x[k:, k]).argmax())
        x[[k, p]] = x[[p, k]]
        x[k] /= x[k, k]
        others = x[:, k].copy()
        others[k] = 0
        x -= others[:, None] * x[k]
    return x[:, m:]


def solve(demand: np.ndarray, length: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, of the relaxed cutting-stock problem.

    Revised simplex with an explicit inverse; a column enters where the knapsack finds one worth over 1. Columns are
    priced at a mean of the basis duals and of the duals with the best bound so far, at first each class's share of
    a sequence, for basis duals alone jump about.
    """
    m = len(length)
    columns = np.diag(capacity // length).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand
    centre, weight = length / capacity, 0.9
    bound = float(centre @ demand)
    step = 0
    while use.sum() > bound * (1 + gap) and step < 100 * m:
        duals = inverse.sum(0)
        priced = weight * centre + (1 - weight) * duals
        worth, taken = knapsack(priced, length, capacity)
        if (got := float(priced @ demand) / max(worth, 1.0)) > bound:
            bound, centre = got, priced / max(worth, 1.0)
        if duals @ taken <= 1 + 1e-9:
            if weight == 0:
                break
            weight = 0 if weight < 0.05 else weight * 0.6
            continue
        weight = min(0.9, weight + 0.05)
        step += 1
        d = inverse @ taken
        ok = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = use[ok] / d[ok]
        out = int(ratio.argmin())
        columns[:, out] = taken
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        use = use - d * ratio[out]
        use[out] = ratio[out]
        if step % 500 == 0:
            inverse = inverted(columns)
            use = np.maximum(inverse @ demand, 0)
    return columns.astype(np.int64), np.maximum(use, 0)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns, as pieces of each length class, and their copies; together they take exactly counts."""
    if not counts:
        return []
    length = np.array(sorted(counts))
    demand = np.array([counts[x] for x in length.tolist()])
    columns, use = solve(demand.astype(float), length, capacity)
    copies = np.floor(use + 1e-9).astype(np.int64)
    out, left = [], demand.copy()
    for k in np.argsort(-use, kind="stable").tolist():
        a = columns[:, k]
        if n := int(min([copies[k], *(left[a > 0] // a[a > 0])])) if a.any() else 0:
            left -= n * a
            out.append(({int(length[i]): int(a[i]) for i in np.flatnonzero(a)}, n))
    bins: list[tuple[Counter, int]] = []  # what rounding left: best fit, longest first
    room: dict[int, list[Counter]] = {}
    for i in range(len(length) - 1, -1, -1):
        for _ in range(int(left[i])):
            size = int(length[i])
            at = min((r for r in room if r >= size and room[r]), default=None)
            if at is None:
                held, at = Counter(), capacity
                bins.append((held, 1))
            else:
                held = room[at].pop()
            held[size] += 1
            room.setdefault(at - size, []).append(held)
    same = Counter(tuple(sorted(held.items())) for held, _ in bins)
    return out + [(dict(items), n) for items, n in sorted(same.items())]


def pieces_of(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """A row for each piece: full ones of capacity tokens, then the tail; with its rank in its task and class."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    unit = max(1, capacity // CLASSES)

    def make():
        table = table_of(held.value)
        last, seen, part = np.array([end], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), table.encode(texts_of(batch.column(1))), strict=True):
                ids = own.astype("<u4").tobytes() + last
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    kind = -(-len(piece) // 4 // unit)
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, part, kind, seen[kind]))
                    seen[kind] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "kind", "nth"])

        return work

    return map_arrow(docs, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, kind int, nth long", "text")


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 1) -> DataFrame:
    """Pieces of all documents, each in a sequence of at most capacity tokens, at an offset without gaps.

    path: a vocabulary file. Each document is its ids and the id end; a null text is an empty one, so it is one
    token. Repeated rows are packed each for itself, a null id stays null, an empty table gives no pieces. Ids are whole
    numbers, cast to long; text that is none fails.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces_of(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), path, capacity, end), "pieces")
    counted = scratch.save(pieces.groupBy("kind", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # CLASSES rows at most
    slots, ranked, base = [], Counter(), 0
    for items, copies in plan(histogram, capacity // max(1, capacity // CLASSES)):
        order = 0
        for kind, n in sorted(items.items()):
            slots.append((kind, ranked[kind], n, base, order))
            ranked[kind] += n * copies
            order += n
        base += copies
    table = np.array(sorted(slots) or [(0, 0, 1, 0, 0)], np.int64)
    wide = 1 << 44
    table = np.column_stack([table[:, 0] * wide + table[:, 1], table])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            kind, rank = (batch.column(names.index(c)).to_numpy().astype(np.int64) for c in ("kind", "rank"))
            found = table[np.searchsorted(table[:, 0], kind * wide + rank, "right") - 1]
            nth = rank - found[:, 2]
            sequence, order = found[:, 4] + nth // found[:, 3], found[:, 5] + nth % found[:, 3]
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(order)], [*names[:5], "sequence_id", "slot"])

        return work

    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("kind", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked_pieces = pieces.join(offsets, ["kind", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", (F.col("before") + F.col("nth")).alias("rank"))
    placed = map_arrow(ranked_pieces, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(offset, F.lit(0)).alias("offset"))
