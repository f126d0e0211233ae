"""Document fingerprints by content-defined chunking (operator 10).

A gear hash over the last 32 bytes ends a chunk where its masked bits are 0; the mask is strict before a chunk's
target length and loose after it (normalised chunking). Inserted or removed text shifts boundaries only nearby, so the
set of chunk digests, each weighted by its length, measures how much of one text another contains.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow, partitions, slices, small_batches

LEAST, TARGET, MOST = 16, 64, 256
#: Low bits of the hash that must be 0 before and after TARGET.
STRICT, LOOSE = (1 << 8) - 1, (1 << 4) - 1
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 97) for b in range(256)], np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a byte string."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # doubles the window: the hash of w bytes and, shifted, of the w before them
        if n > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    high = h >> np.uint32(20)
    loose = np.flatnonzero((high & np.uint32(LOOSE)) == 0)
    strict = loose[(high[loose] & np.uint32(STRICT)) == 0].tolist()
    loose = loose.tolist()
    ends, at = [], 0
    while n - at > LEAST:
        k = bisect_left(strict, at + LEAST - 1)
        if k < len(strict) and strict[k] < at + TARGET - 1:
            end = strict[k] + 1
        else:
            k = bisect_left(loose, at + TARGET - 1)
            end = loose[k] + 1 if k < len(loose) and loose[k] < at + MOST - 1 else at + MOST
        at = min(end, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[int, int]:
    """Lengths of a text's chunks by their 48-bit digests; empty for an empty text."""
    data = text.encode()
    out, at = {}, 0
    for end in boundaries(data) if data else ():
        out[xxhash.xxh3_64_intdigest(data[at:end]) >> 16] = end - at
        at = end
    return out


def written(own: dict[int, int]) -> str:
    return " ".join([f"{d:012x}:{n}" for d, n in own.items()])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes in chunks of both, of the bytes in chunks of the smaller; 1 for two empty sets, 0 if one is empty."""
    if not a or not b:
        return float(a == b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum([n for d, n in small.items() if d in large]) / min(sum(a.values()), sum(b.values()))


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint of each text: digest:length of its distinct chunks in their order.

    Null and empty texts have an empty fingerprint; equal texts have equal ones. No shuffle.
    """
    kept = docs.drop(name)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([written(chunks(t or "")) for t in batch.column(text).to_pylist()], pa.string())], [*batch.schema.names, name])

        return work

    return map_arrow(kept, make, kept.withColumn(name, F.lit("")).schema, text)


def similarity(a: str, b: str) -> float:
    """The containment of two fingerprints as written."""
    read = lambda s: {int(d, 16): int(n) for d, n in (x.split(":") for x in s.split())}
    return containment(read(a), read(b))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document, its edited text (the last half replaced from the next document's start) and their likeness.

    The next document is that of the next id (ties by text, null ids first, the first after the last). Ids are dealt
    into ranges by quantiles; the first row of a range is also sent to the range before it, so that each range finds
    its neighbours alone. Only a range's bounds and first id reach the driver: a few values for each partition. Ids are
    whole numbers, cast to long; bounds are doubles, so beyond 2 ** 53 ranges may be less even.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(spark)
    small_batches(spark)
    bounds = np.unique(np.array(rows.select("k").approxQuantile("k", (np.arange(1, 4 * n) / (4 * n)).tolist(), 0.1 / (4 * n)), np.float64).astype(np.int64)) if n else np.zeros(0, np.int64)

    def numbered():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            k = batch.column(0).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, k, "right").astype(np.int64)), batch.column(0)], ["range", "k"])

        return work

    firsts = sorted((r["range"], r.k) for r in map_arrow(rows.select("k"), numbered, "range long, k long").groupBy("range").agg(F.min("k").alias("k")).collect())
    before = {k: (firsts[i - 1][0], firsts[i][0]) for i, (_, k) in enumerate(firsts)}

    def deal():
        first_ids = np.array(sorted(before), np.int64)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            k = batch.column(0).to_numpy()
            own = np.searchsorted(bounds, k, "right").astype(np.int64)
            again = np.flatnonzero(np.isin(k, first_ids))
            both = pa.Table.from_batches([batch, batch.take(pa.array(again))]).combine_chunks().to_batches()[0] if len(again) else batch
            places = np.concatenate([own, np.array([before[x][0] for x in k[again].tolist()], np.int64)])
            look = np.concatenate([np.zeros(len(own), np.int32), np.ones(len(again), np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(places), pa.array(look), *both.columns], ["range", "look", "k", "doc_id", "text"])

        return work

    dealt = map_arrow(rows, deal, "range long, look int, k long, doc_id long, text string", "text")
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        prev = None  # range, id, text, chunks of the row that awaits its next one
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for place, look, doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if look and (prev is None or prev[0] != place):
                        continue  # a further row with the id of the first
                    own = chunks(t)
                    if prev is not None and prev[0] == place:
                        _, prev_doc, prev_text, prev_chunks = prev
                        new = edited(prev_text, t)
                        changed = prev_chunks if new == prev_text else chunks(new)
                        out.append((prev_doc, len(prev_text), new, written(prev_chunks), written(changed), containment(prev_chunks, changed), containment(prev_chunks, own)))
                    prev = None if look else (place, doc, t, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.repartition(n, "range").sortWithinPartitions("range", "look", "k", "text").select("range", "look", "doc_id", "text").mapInArrow(run, schema)
