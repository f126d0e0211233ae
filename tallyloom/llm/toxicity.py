"""Toxicity by cumulative-link ordinal regression over sparse text features (operator 4).

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector for all ordered thresholds. Features are the distinct
lower-cased words of a text and their prefixes, those that the labels speak for or against beyond doubt. Near copies
count once, for a group of them would make evidence of any of its words. The expected severity is the sum of
P(grade >= k) over k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, least_hashed, map_arrow, texts_of

#: Labelled rows of each class that a fit takes at most, those with the least hash of their id.
SAMPLE = 4000
#: Length of the prefixes that are features beside whole words.
PREFIXES = (4, 5)
#: A feature counts if so many sampled documents have it, and the root of its likelihood ratio is so large.
LEAST_DOCS, LEAST_EVIDENCE = 6, 6.0
#: Documents whose so many words of least hash are the same count as near copies of one another.
SIGNATURE = 4
#: Features of a model at most, those of strongest evidence.
FEATURES = 100_000
#: Weight of the squared weights in the loss.
RIDGE = 1e-5
#: Share of the classes in the loss and in the choice of the cut: a false alarm costs a document, so clean ones weigh more.
TOXIC, CLEAN = 0.35, 0.65
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def features(word: str) -> set[str]:
    return {word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)}


def code(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) >> 1


@dataclass(frozen=True)
class Ordinal:
    """Thresholds ascend; weights are by feature code; a text counts as toxic from cut on, a P(grade >= 1)."""

    thresholds: tuple[float, ...]
    weights: dict[int, float]
    cut: float = 1.0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most so many labelled documents (id, text, y) of each class of an integer label; their ids fit a broadcast.

    Of rows that share an id the least text is taken, the greatest of its labels counts.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.other: r.n for r in known.groupBy((F.col("y") != 0).alias("other")).agg(F.count("*").alias("n")).collect()}
    chosen = least_hashed(known.where("y = 0"), "doc_id", label, most, sizes.get(False, 0)).unionByName(least_hashed(known.where("y <> 0"), "doc_id", label, most, sizes.get(True, 0)))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


@dataclass(frozen=True)
class Evidence:
    """Sampled documents with the features that tell: sorted codes and word count of each, its label, which codes speak for 1."""

    codes: list[np.ndarray]
    n_words: list[int]
    y: np.ndarray
    names: np.ndarray
    marked: np.ndarray


def gather(chosen: DataFrame, most: int = FEATURES) -> Evidence:
    """Features are counted and tested where the texts are; only those that pass come to the driver, most at most."""
    spark = chosen.sparkSession
    scratch = Scratch(spark, "toxicity")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, counts, signatures = [], [], []
            for t in texts_of(batch.column(1)):
                words = WORDS(t.lower())
                found = set().union(*map(features, set(words))) if words else set()
                rows.append(sorted(map(code, found)))
                counts.append(len(words))
                signatures.append(sorted(map(code, set(words)))[:SIGNATURE])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64())), pa.array(counts, pa.int64()), batch.column(2), pa.array(signatures, pa.list_(pa.int64()))], ["doc_id", "codes", "n_words", "y", "signature"])

        return work

    kind = chosen.schema["doc_id"].dataType.simpleString()
    every = scratch.save(map_arrow(chosen.select("doc_id", "text", "y"), make, f"doc_id {kind}, codes array<long>, n_words long, y int, signature array<long>", "text"), "every")
    first = every.groupBy("signature", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    held = scratch.save(every.drop("signature").join(first, "doc_id"), "features")
    sizes = held.agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg")).first()
    counted = held.select(F.explode("codes").alias("code"), (F.col("y") > 0).cast("long").alias("hit")).groupBy("code").agg(F.count("*").alias("df"), F.sum("hit").alias("hits")).where(F.col("df") >= LEAST_DOCS)
    total, pos, neg = float(max(1, sizes.pos + sizes.neg)), float(sizes.pos), float(sizes.neg)
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    n, h = F.col("df").cast("double"), F.col("hits").cast("double")
    ratio = part(h, n * pos / total) + part(n - h, n * neg / total) + part(pos - h, (total - n) * pos / total) + part(neg - n + h, (total - n) * neg / total)
    tested = counted.withColumn("z", F.sqrt(F.greatest(2 * ratio, F.lit(0.0))) * F.signum(h / n - pos / total)).where(F.abs("z") >= LEAST_EVIDENCE)
    passed = sorted((r.code, r.z) for r in tested.orderBy(F.desc(F.abs("z")), "code").limit(most).select("code", "z").collect())
    names, z = np.array([c for c, _ in passed], np.int64), np.array([z for _, z in passed])
    keep = spark.sparkContext.broadcast(names)  # most codes at most

    def known():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.intersect1d(np.array(c, np.int64), keep.value, assume_unique=True) for c in batch.column(1).to_pylist()]
            return batch.set_column(1, "codes", pa.array(rows, pa.list_(pa.int64())))

        return work

    rows = map_arrow(held, known, held.schema).collect()  # a bounded number of documents and features
    rows.sort(key=lambda r: (r.doc_id, r.codes))
    scratch.drop("every", "features")
    return Evidence([np.array(r.codes, np.int64) for r in rows], [r.n_words for r in rows], np.array([r.y for r in rows], np.int64), names, names[z > 0] if len(z) else names)


def grade(codes: list[np.ndarray], n_words: list[int], y: np.ndarray, marked: np.ndarray, levels: int) -> np.ndarray:
    """Severity grades of 0/1 labels: 0 if clean, else 1 to levels by the share of marked features, in equal parts."""
    share = np.array([np.isin(c, marked, assume_unique=True).sum() / max(n, 1) for c, n in zip(codes, n_words, strict=True)])
    bad = share[y > 0]
    cuts = np.quantile(bad, np.arange(1, levels) / levels) if len(bad) else []
    return np.where(y > 0, 1 + np.searchsorted(cuts, share, "left"), 0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE, levels: int = 3) -> Ordinal:
    """A model from at most 2 * most labelled rows. Labels over 1 are taken as grades, 0/1 labels graded by density.

    Without labelled rows of both kinds every text scores 0.
    """
    seen = gather(sample(docs, labels, label, most, doc_id, text))
    y = seen.y
    if not len(y) or y.max() == 0 or y.min() > 0:
        return Ordinal((50.0,), {})
    grades = y if y.max() > 1 else grade(seen.codes, seen.n_words, y, seen.marked, levels)
    weights, theta = descend(seen, grades)
    return Ordinal(tuple(theta.tolist()), dict(zip(seen.names.tolist(), weights.tolist(), strict=True)), cut_of(seen, weights, theta))


def cut_of(seen: Evidence, weights: np.ndarray, theta: np.ndarray) -> float:
    """The P(grade >= 1) that best tells the sample's classes apart, halfway between two that occur; of equals the highest."""
    row = np.repeat(np.arange(len(seen.codes)), list(map(len, seen.codes)))
    col = np.searchsorted(seen.names, np.concatenate([np.zeros(0, np.int64), *seen.codes]))
    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weights[col], minlength=len(seen.y)) - theta[0], -40, 40)))
    levels = np.unique(p)
    cuts = np.append((levels[1:] + levels[:-1]) / 2, 1.0)
    bad, good = np.sort(p[seen.y > 0]), np.sort(p[seen.y == 0])
    told = TOXIC * (1 - np.searchsorted(bad, cuts) / len(bad)) + CLEAN * np.searchsorted(good, cuts) / len(good)
    return float(cuts[len(cuts) - 1 - int(told[::-1].argmax())])


def loss_of(weights: np.ndarray, theta: np.ndarray, row: np.ndarray, col: np.ndarray, target: np.ndarray, balance: np.ndarray) -> float:
    """The weighted log-loss over thresholds with a small ridge, which descend() makes small."""
    margin = np.bincount(row, weights=weights[col], minlength=len(balance))
    z = margin[:, None] - theta[None, :]
    return float((balance[:, None] * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * RIDGE * (weights**2).sum())


def design(seen: Evidence, grades: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row and column of each feature of a document, which thresholds its grade reaches, and its weight."""
    row = np.repeat(np.arange(len(seen.codes)), list(map(len, seen.codes)))
    col = np.searchsorted(seen.names, np.concatenate([np.zeros(0, np.int64), *seen.codes]))
    target = grades[:, None] >= np.arange(1, int(grades.max()) + 1)[None, :]
    return row, col, target, np.where(seen.y > 0, TOXIC / (seen.y > 0).sum(), CLEAN / (seen.y == 0).sum())


def descend(seen: Evidence, grades: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, by Adam."""
    row, col, target, balance = design(seen, grades)
    m, top = len(seen.names), target.shape[1]
    weights, theta = np.zeros(m), np.linspace(0.5, 1.5, top)
    moments = [np.zeros(m + top), np.zeros(m + top)]
    for t in range(1, steps + 1):
        margin = np.bincount(row, weights=weights[col], minlength=len(balance))
        off = (1 / (1 + np.exp(-np.clip(margin[:, None] - theta[None, :], -40, 40))) - target) * balance[:, None]
        g = np.concatenate([np.bincount(col, weights=off.sum(1)[row], minlength=m) + RIDGE * weights, -off.sum(0)])
        moments = [0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g * g]
        change = 0.05 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        weights, theta = weights - change[:m], np.sort(theta - change[m:])
    return weights, theta


def score(docs: DataFrame, model: Ordinal, text: str = "text", severity: str = "severity", chance: str = "p_toxic") -> DataFrame:
    """All columns of docs, the expected severity (0 to the number of thresholds) and P(grade >= 1).

    A null or empty text has no features, so it scores as low as the thresholds say; rows are neither dropped nor merged.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of the bounded sample
    kept = docs.drop(severity, chance)

    def make():
        weights, theta, cache = held.value.weights, np.array(held.value.thresholds), {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            margins = []
            for t in texts_of(batch.column(text)):
                found = set(WORDS(t.lower()))
                prefixes, total = set(), 0.0
                if len(cache) > 400_000:
                    cache.clear()
                for w in found:
                    hit = cache.get(w)
                    if hit is None:
                        hit = cache[w] = [(f, weights[c]) for f in sorted(features(w)) if (c := code(f)) in weights]
                    for f, weight in hit:
                        if f not in prefixes:
                            prefixes.add(f)
                            total += weight
                margins.append(total)
            p = 1 / (1 + np.exp(-np.clip(np.array(margins)[:, None] - theta[None, :], -40, 40)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, 0])], [*batch.schema.names, severity, chance])

        return work

    return map_arrow(kept, make, kept.withColumn(severity, F.lit(0.0)).withColumn(chance, F.lit(0.0)).schema, text)
