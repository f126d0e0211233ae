"""BPE encoding and decoding of a text column (operator 1)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import PartCache, cache_of, load
from tallyloom.llm.common import map_arrow, texts_of


def vocabulary(path: str) -> str:
    """The text of a vocabulary file (about 2 MB whatever the corpus); read on the driver, carried by the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and an array of token ids. A null text encodes as an empty one; rows stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        cache = PartCache(load(held.value), lambda ids, at: [ids[s:e] for s, e in zip(at, at[1:], strict=False)], lambda xs: np.concatenate([np.zeros(0, np.int64), *xs]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [cache.bpe.cut(t) for t in texts_of(batch.column(text))]
            at = cache.take(cut)
            rows = [np.concatenate([at[w] for w in ws]) if ws else np.zeros(0, np.int64) for ws in cut]
            column = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate(rows).astype(np.int32))
            return pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != ids], column], [*[n for n in batch.schema.names if n != ids], ids])

        return work

    kept = docs.drop(ids)
    return map_arrow(kept, make, kept.withColumn(ids, F.lit(None).cast("array<int>")).schema, text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the text of the ids, special tokens included; null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        bpe = load(held.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text], column], [*[n for n in batch.schema.names if n != text], text])

        return work

    kept = encoded.drop(text)
    return map_arrow(kept, make, kept.withColumn(text, F.lit(None).cast("string")).schema)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: its id, token count, and digests of its ids and of their decoding.

    The ids are those of encode(), the decoded text that of decode(); neither leaves the worker.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        bpe = load(held.value)

        def values(ids: np.ndarray, at: list[int]) -> list[tuple]:
            names = list(map(str, ids.tolist()))
            if bpe.joined:
                back = list(map(bpe.token.__getitem__, ids.tolist()))
                return [(e - s, " ".join(names[s:e]), " ".join(back[s:e])) for s, e in zip(at, at[1:], strict=False)]
            back = [bpe.raw[i] or bpe.token[i].encode() for i in ids.tolist()]
            return [(e - s, " ".join(names[s:e]), b"".join(back[s:e])) for s, e in zip(at, at[1:], strict=False)]

        def joined(values: list[tuple]) -> tuple:
            between = " " if bpe.joined else b""
            return sum([v[0] for v in values]), " ".join([v[1] for v in values]), between.join([v[2] for v in values])

        cache = cache_of(held.value, "digests", values, joined, 200_000)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [bpe.cut(t) for t in texts_of(batch.column(1))]
            at = cache.take(cut)
            counts, ids, back = [], [], []
            for words in cut:
                found = [at[w] for w in words]
                counts.append(sum([x[0] for x in found]))
                ids.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                decoded = " ".join([x[2] for x in found]) if bpe.joined else b"".join([x[2] for x in found]).decode(errors="replace")
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")
