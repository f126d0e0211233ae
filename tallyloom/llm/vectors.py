"""Near-duplicate embeddings by iterative quantisation (operator 7).

Rotations learned on a bounded sample turn centred vectors into balanced binary codes. Codes are cut into substrings,
each the index of a Hamming table; vectors of one label that agree on a substring meet and are compared by the cosine
of their original components. The larger the largest label, the longer the substrings, so that strangers meet no more
often; rotations are added until vectors at the threshold, made from the sample, meet with a probability of 0.99.
Vectors longer than all of the sample, and all if no number of rotations allowed does, are compared with every vector of
their label and length instead. What is found is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, least_hashed, map_arrow
from tallyloom.llm.graph import components, deal, lowest, tiles

#: Vectors that a fit takes at most, those with the least hash of their id; every vector is indexed.
SAMPLE = 8192
#: Rotations at least and at most, bits of a code at most (of each), bits of a substring at least and at most.
ROTATIONS, MOST_ROTATIONS, BITS, SUBSTRING, MOST_SUBSTRING = 4, 48, 64, 16, 30
RECALL, PROBES = 0.99, 4000
ITERATIONS = 40


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray
    rotations: tuple[np.ndarray, ...]  # components x bits
    substring: int = SUBSTRING
    enough: bool = True  # whether pairs at the threshold meet as often as RECALL says

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row for each vector: the substrings of its codes, one for each table."""
        d = len(self.mean)
        x = np.pad(x[:, :d], ((0, 0), (0, max(0, d - x.shape[1])))) - self.mean
        tables = []
        for r in self.rotations:
            bits = (x @ r) > 0
            for at in range(0, max(1, bits.shape[1] - self.substring + 1), self.substring):
                part = bits[:, at : at + self.substring]
                tables.append(part @ (1 << np.arange(part.shape[1])))
        return np.column_stack(tables).astype(np.int32)


def substring_for(rows: int) -> int:
    """As many bits as number the rows of a label, so that a bucket of strangers has a few, whatever the corpus."""
    return min(MOST_SUBSTRING, max(SUBSTRING, int(rows).bit_length()))


def learn(x: np.ndarray, rows: int = 0, least: float = 0.98, bits: int = BITS, seed: int = 5) -> Quantiser:
    """Principal directions, then for each random start the rotation that brings their signs nearest to them.

    x: unit vectors; rows: of the largest label. Rotations are added until pairs at the cosine least share a substring
    often enough, ROTATIONS at least and MOST_ROTATIONS at most; if so many don't do, the codes say so.
    """
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    k = min(bits, x.shape[1])
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean)) if len(x) else (None, np.eye(x.shape[1]))
    directions = vectors[:, ::-1][:, :k]
    v, rng, out = (x - mean) @ directions, np.random.default_rng(seed), []
    near = x[3::4][:PROBES] if len(x) >= 64 else x  # not what the rotations are fitted to
    v = v[np.arange(len(x)) % 4 != 3] if len(x) >= 64 else v
    side = rng.standard_normal(near.shape)
    side -= (side * near).sum(1, keepdims=True) * near
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    moved = least * near + np.sqrt(1 - least**2) * side
    met = np.zeros(len(near), bool)
    while len(out) < ROTATIONS or (len(out) < MOST_ROTATIONS and len(near) and met.mean() < RECALL):
        r, _ = np.linalg.qr(rng.standard_normal((k, k)))
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(directions @ r)
        one = Quantiser(mean, (out[-1],), substring_for(rows))
        met |= (one.codes(near) == one.codes(moved)).any(1)
    return Quantiser(mean, tuple(out), substring_for(rows), not len(near) or met.mean() >= RECALL)


def stacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, scaled to length 1 and padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if len(sizes) and (sizes == width).all():
        out = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        for i, r in enumerate(column.to_pylist()):
            out[i, : min(width, len(r))] = r[:width]
    scale = np.abs(out).max(1, keepdims=True)
    out /= np.where(scale > 0, scale, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Rows link when their labels are equal and not null, their vectors of one length, and the cosine at least least.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors of a
    label are one class, compared once and counted as often as they occur. Classes are numbered, so ids may repeat with
    other vectors, or be null: such a row keeps its links, and its component is that of its class. An empty table gives
    none. Ids are whole numbers, cast to long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0)).alias("e"), F.col(label).alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("e", lambda x: x == 0)
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~F.coalesce(bad, F.lit(True))
    marked = rows.withColumn("g1", F.when(usable, F.xxhash64("label", "e"))).withColumn("g2", F.when(usable, F.xxhash64(F.lit(11), "e", "label")))
    grouped = marked.where("g1 is not null").groupBy("g1", "g2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("e").alias("e"), F.first("label").cast("string").alias("label"))
    classes = scratch.save(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    drawn = least_hashed(classes.select("g1", "e"), "g1", "fit", SAMPLE, classes.count()).toArrow()
    if not drawn.num_rows:
        return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(map(len, drawn.column("e").to_pylist()))
    largest = classes.groupBy("label").count().agg(F.max("count").alias("n")).first().n
    model = spark.sparkContext.broadcast(learn(stacked(drawn.column("e").combine_chunks(), width), largest, least))

    def index():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes = model.value.codes(stacked(batch.column(1), width))
            coded = (np.diff(batch.column(1).offsets.to_numpy()) <= width) & model.value.enough
            n = np.where(coded, codes.shape[1], 1)  # others share one code, and so meet all of their label and length
            flat = np.where(coded[:, None], codes, 0)[np.arange(codes.shape[1]) < n[:, None]]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), flat)], ["node", "codes"])

        return work

    coded = scratch.save(map_arrow(classes.select("node", "e"), index, "node long, codes array<int>").join(classes.select("node", "label", F.size("e").alias("d")), "node"), "coded")
    keys = coded.select("node", "label", "d", F.posexplode("codes").alias("at", "part")).select(F.xxhash64("label", "d", "at", "part").alias("key"), "at", "node")
    met = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "met")
    dealt = deal(keys.join(met, "key"), scratch, "tiles", member="node")
    dealt = dealt.join(classes.select("node", "copies", "e"), "node").join(coded.select("node", "codes"), "node")  # vectors travel once

    def judge(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        column = lambda c: batch.column(batch.schema.names.index(c))
        ids, copies, at = column("node").to_numpy(), column("copies").to_numpy(), int(column("at")[0].as_py())
        lists = column("e")
        x = stacked(lists, len(lists[0]))
        codes = column("codes").flatten().to_numpy().reshape(len(ids), -1)
        linked = (x[left] @ x[right].T) >= least
        if left is right:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if not len(i):
            return None
        i, j = left[i], right[j]
        fresh = ~(codes[i, :at] == codes[j, :at]).any(1)  # no earlier table has counted the pair
        links = np.bincount(i[fresh], weights=copies[j[fresh]], minlength=len(ids))
        if left is not right:
            links += np.bincount(j[fresh], weights=copies[i[fresh]], minlength=len(ids))
        low = lowest(ids, i, j)
        some = np.flatnonzero((links > 0) | (low != ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])], ["node", "links", "low"])

    found = scratch.save(tiles(dealt, judge, "node long, links long, low long"), "found")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")), scratch, "parts")
    held = classes.join(counted, "node", "left").join(comps, "node", "left").select("g1", "g2", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least_ids = held.groupBy("component").agg(F.min("id").alias("component_id"))
    placed = scratch.save(held.join(least_ids, "component").select("g1", "g2", "n_links", "component_id"), "placed")
    scratch.drop("classes", "coded", "met", "tiles-sizes", "found")
    scratch.tidy()
    done = marked.select("vec_id", "g1", "g2").join(placed, ["g1", "g2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
