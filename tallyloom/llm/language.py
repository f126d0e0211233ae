"""Language identification by rank-order n-gram profiles (operator 6).

A profile is a language's most frequent character n-grams by rank. A text's own most frequent n-grams are compared
with each profile by the out-of-place distance: the sum of rank differences, with the profile's size for an n-gram
that it lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, hash_order, map_arrow, texts_of

#: Ranks of a profile.
PROFILE = 400
#: Documents of each language that a fit takes at most, those with the least hash of their id.
SAMPLE = 2000
#: Letters of a word beyond which its n-grams are not kept for the next time it occurs.
LONG_WORD = 64
LETTERS = regex.compile(r"[\p{L}\p{M}]+").findall
LETTER = regex.compile(r"\p{L}").search


#: Bits of a code point in the number of an n-gram, whose first character stands highest.
POINT = 21


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 letters of each word with its ends marked, as numbers, and how many each word has.

    Numbers stand in the order of the n-grams' code points; the mark alone is no n-gram.
    """
    size = np.array(list(map(len, words))) + 2
    c = np.frombuffer("".join([f"_{w}_" for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(c)) - (end - size)[word]
    n = 3 * size - 5
    out = np.empty(int(n.sum()), np.int64)
    base = (np.cumsum(n) - n)[word]
    one = (place > 0) & (place < size[word] - 1)
    out[(base + place - 1)[one]] = c[one] << 2 * POINT
    two = np.flatnonzero(place < size[word] - 1)
    out[(base + size[word] - 2 + place)[two]] = c[two] << 2 * POINT | c[two + 1] << POINT
    three = np.flatnonzero(place < size[word] - 2)
    out[(base + 2 * size[word] - 3 + place)[three]] = c[three] << 2 * POINT | c[three + 1] << POINT | c[three + 2]
    return out, n


def gram_of(code: int) -> str:
    return "".join(chr(p) for p in (code >> 2 * POINT, code >> POINT & (1 << POINT) - 1, code & (1 << POINT) - 1) if p)


def code_of(gram: str) -> int:
    return sum(ord(c) << POINT * (2 - i) for i, c in enumerate(gram))


class Counts:
    """n-gram counts of texts over the n-grams met lately, which have numbers: codes and ranks are by number."""

    def __init__(self, ranks: dict[str, dict[str, int]] | None = None, most: int = 100_000):
        self.most, self.profiles = most, [{code_of(g): r for g, r in p.items()} for p in (ranks or {}).values()]
        self.clear()

    def clear(self) -> None:
        self.ids: dict[int, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.codes = np.zeros(0, np.int64)
        self.places = np.zeros((len(self.profiles), 0), np.int64)

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The numbers of each text's n-grams, ascending, and how often each occurs there."""
        if len(self.ids) > self.most or len(self.words) > 4 * self.most:
            self.clear()
        cut = [LETTERS(t.lower()) for t in texts]
        ids, held, long = self.ids, self.words, {}
        fresh = [w for w in set().union(*cut) if w not in held] if cut else []
        if fresh:
            codes, n = gram_codes(fresh)
            seen, where = np.unique(codes, return_inverse=True)
            numbers = np.array([ids.setdefault(c, len(ids)) for c in seen.tolist()], np.int32)[where]
            ends = np.cumsum(n)
            for w, s, e in zip(fresh, (ends - n).tolist(), ends.tolist(), strict=True):
                (held if len(w) <= LONG_WORD else long)[w] = numbers[s:e].copy()
        new = list(ids)[len(self.codes) :]
        if new:
            self.codes = np.concatenate((self.codes, np.array(new, np.int64)))
            self.places = np.concatenate((self.places, np.array([[p.get(c, -1) for c in new] for p in self.profiles], np.int64).reshape(len(self.profiles), len(new))), axis=1)
        none = np.zeros(0, np.int64)
        find = lambda w: held[w] if w in held else long[w]
        return [np.unique(np.concatenate([find(w) for w in ws] if long else [held[w] for w in ws]), return_counts=True) if ws else (none, none) for ws in cut]


def ranked(found: np.ndarray, n: np.ndarray, codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams; ties by the n-gram itself, so that equal counts give one order."""
    if len(found) > most:
        keep = n >= np.partition(n, -most)[-most]
        found, n = found[keep], n[keep]
    return found[np.lexsort((codes[found], -n))][:most]


@dataclass(frozen=True)
class Profiles:
    ranks: dict[str, dict[str, int]]
    most: int


def fit(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", most: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles of every language from the n-gram counts of at most sample documents of each.

    Languages are few by nature; the sample of each is those of least hash of id and text, rows equal in both once. All
    languages go through the same jobs: a bound on the hash that twice the sample passes comes first, and only hashes
    are ranked.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").withColumn("order", hash_order("doc_id", "lang", "text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))  # a row for each language
    near = known.select("lang", "order").join(F.broadcast(sizes), "lang").where(F.col("order") < F.lit(float(1 << 52)) * F.least(F.lit(1.0), F.lit(2.0 * sample + 200) / F.col("size")))
    drawn = near.select("lang", "order").distinct().withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("at") <= sample)
    # the last hash that is drawn says which texts are taken, so that few texts are shuffled: a row for each language
    last = drawn.groupBy("lang").agg(F.max("order").alias("last"))
    chosen = known.join(F.broadcast(last), "lang").where(F.col("order") <= F.col("last")).groupBy("lang", "order").agg(F.min("text").alias("text")).select("lang", "text")

    def make():
        held = Counts()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: dict[str, np.ndarray] = {}
            counts = held.of(texts_of(batch.column(1)))
            for name, (found, n) in zip(batch.column(0).to_pylist(), counts, strict=True):
                np.add.at(total.setdefault(name, np.zeros(len(held.codes), np.int64)), found, n)
            names = list(map(gram_of, held.codes.tolist()))
            rows = [(name, names[i], int(c[i])) for name, c in sorted(total.items()) for i in np.flatnonzero(c).tolist()]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64()], strict=True)], ["lang", "gram", "n"])

        return work

    scratch = Scratch(docs.sparkSession, "language")
    counted = scratch.save(map_arrow(chosen, make, "lang string, gram string, n long", "text").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranks: dict[str, dict[str, int]] = {}
    for r in counted.withColumn("at", F.row_number().over(by_count)).where(F.col("at") <= most).orderBy("lang", "at").collect():  # most rows a language
        ranks.setdefault(r.lang, {})[r.gram] = r["at"] - 1
    for r in sizes.select("lang").collect():
        ranks.setdefault(r.lang, {})  # a language without a letter
    scratch.drop("counts")
    return Profiles(dict(sorted(ranks.items())), most)


def distance(own: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """own: n-grams by rank; places: for each profile the rank of each n-gram, or -1; most: the ranks of a profile."""
    there = places[:, own]
    return np.where(there < 0, most, np.abs(there - np.arange(len(own)))).sum(1)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All columns of docs but text, lang_pred and score.

    score: how much nearer the best profile is than the next, as a share of the next's distance. A text that is null
    or has no letter gives `und` and 0; with one language or none learned, 1 or `und`. Ties go to the first name.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # most n-grams a language
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = docs.select(*kept, F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def make():
        ranks, most = held.value.ranks, held.value.most
        names, counter = list(ranks), Counts(ranks)

        def one(t: str | None, found: np.ndarray, n: np.ndarray) -> tuple[str, float]:
            if not t or not names or not LETTER(t):
                return "und", 0.0
            far = distance(ranked(found, n, counter.codes, most), counter.places, most)
            best = int(far.argmin())  # the first of equals, and names are in order
            if len(far) == 1:
                return names[0], 1.0
            second = int(np.delete(far, best).min())
            return names[best], min(1.0, max(0.0, 1 - int(far[best]) / second)) if second else 0.0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text).to_pylist()
            got = [one(t, *c) for t, c in zip(texts, counter.of([t or "" for t in texts]), strict=True)]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*kept, "lang_pred", "score"])

        return work

    return map_arrow(docs.select(*kept, text), make, schema, text)
