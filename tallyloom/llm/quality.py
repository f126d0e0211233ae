"""Quality scores from a sparse rule ensemble (operator 5).

Shallow trees over text statistics are grown on reweighted samples; every path from a root is a conjunctive rule.
A lasso logistic regression weights the rules, most of them by 0, and the rest are compiled to one Spark column.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow, texts_of
from tallyloom.llm.toxicity import sample

#: Labelled rows of each class that a fit takes at most, those with the least hash of their id.
SAMPLE = 6000
STATISTICS = ("n_words", "word_length", "upper", "digits", "symbols", "word_ends", "pipes", "distinct", "top_word", "repeats", "line_repeats", "line_words", "short_words", "stops", "long_words")
Rule = tuple[tuple[str, bool, float], ...]


def statistics_of(text: str) -> list[float]:
    """STATISTICS of a text; all 0 if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = max(1, sum(map(len, words)))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(str.isalpha, text))
    low = text.lower()
    low = low if len(low) == len(text) else [c.lower() for c in text]  # a letter may have two in lower case
    upper = 0 if low == text else len(text) - sum(map(str.__eq__, text, low))
    digits = len(text) - len(text.translate(DIGITS))
    ends = Counter([w[-1] for w in words])
    return [
        float(n), chars / n, upper / max(1, letters), digits / chars, (chars - letters - digits) / chars,
        sum(v for k, v in ends.items() if not k.isalnum() and k not in ",.") / n, counts.get("|", 0) / n,
        len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), sum([1 for w in words if len(w) < 3]) / n,
        (ends.get(".", 0) + ends.get("?", 0)) / n, sum([1 for w in words if len(w) > 20]) / n,
    ]


DIGITS = {ord(c): None for c in "0123456789"}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """A frame's columns but text, and the STATISTICS of text; a null text counts as empty."""
    kept = [c for c in docs.columns if c != text and c not in STATISTICS]
    schema = docs.select(*kept, *[F.lit(0.0).alias(s) for s in STATISTICS]).schema

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([statistics_of(t) for t in texts_of(batch.column(text))])
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c) for c in got.T]], [*kept, *STATISTICS])

        return work

    return map_arrow(docs.select(*kept, text), make, schema, text)


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def margin(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, path: Rule, cuts: list[np.ndarray], out: dict[Rule, None], names: list[int], least: int) -> None:
    """A least-squares tree by the best of candidate cuts; every path is put in out."""
    if path:
        out[path] = None
    if depth == 0 or len(rows) < 2 * least:
        return
    r, w = residual[rows], weight[rows]
    best = (1e-12, -1, 0.0)
    total, mass = (r * w).sum(), w.sum()
    for j in names:
        v = x[rows, j]
        bins = np.searchsorted(cuts[j], v, "left")
        k = len(cuts[j]) + 1
        s, m, n = (np.cumsum(np.bincount(bins, weights=z, minlength=k))[:-1] for z in (r * w, w, np.ones(len(rows))))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s * s / m + (total - s) ** 2 / (mass - m) - total * total / mass
        gain[(n < least) | (len(rows) - n < least) | ~np.isfinite(gain)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), j, float(cuts[j][int(gain.argmax())]))
    _, j, cut = best
    if j < 0:
        return
    above = x[rows, j] > cut
    for side in (False, True):
        grow(x, residual, weight, rows[above == side], depth - 1, (*path, (STATISTICS[j], side, cut)), cuts, out, names, least)


def applies(x: np.ndarray, rule: Rule) -> np.ndarray:
    at = np.ones(len(x), bool)
    for name, above, cut in rule:
        v = x[:, STATISTICS.index(name)]
        at &= (v > cut) if above else (v <= cut)
    return at


def fit_arrays(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-4) -> RuleEnsemble:
    """weight: of each row, to sum to 1, so that a sample by class still has the classes' true shares."""
    share = float(np.clip((weight * y).sum(), 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return RuleEnsemble(bias, ())
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.005, 0.995, 64))) for j in range(x.shape[1])]
    margin, found = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        own: dict[Rule, None] = {}
        grow(x, y - p, weight, rows, depth, (), cuts, own, sorted(rng.choice(x.shape[1], 8, replace=False).tolist()), 10)
        found |= own
        for rule in own:
            at = applies(x, rule)
            if len(rule) == depth or not any(r[: len(rule)] == rule and len(r) > len(rule) for r in own):
                mass = (weight * p * (1 - p))[at].sum()
                margin[at] += 0.3 * float((weight * (y - p))[at].sum() / max(mass, 1e-6))
    rules = list(found)
    made = np.column_stack([applies(x, r) for r in rules]).astype(float)
    _, first = np.unique(made, axis=1, return_index=True)
    first = np.sort(first)
    made, rules = made[:, first], [rules[i] for i in first]
    # each rule is scaled by its support's standard deviation
    mean = weight @ made
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    w, b = lasso((made - mean) / scale, y, weight, penalty, bias)
    coefficient = w / scale
    kept = [(r, float(c)) for r, c in zip(rules, coefficient, strict=True) if abs(c) > 1e-6]
    return RuleEnsemble(float(b - (mean * coefficient).sum()), tuple(kept))


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, bias: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of least weighted log-loss and penalty times the weights' sizes, by FISTA."""
    step = 4 / max(1e-9, float(np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1]))
    w = v = np.zeros(z.shape[1])
    b = bias
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + b, -40, 40)))
        off = weight * (p - y)
        new = v - step * (z.T @ off)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 2 * off.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / after * (new - w), after
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> RuleEnsemble:
    """An ensemble from at most 2 * most labelled rows; without any, every text scores 0.5.

    Rows without a label of 0 or 1 teach nothing, repeated rows as often as they are drawn; a null text counts as empty.
    """
    known = labels.where(F.col(label).isNotNull())
    shares = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("int")).count().collect() if r[0] in (0, 1)}
    chosen = with_statistics(sample(docs, known, label, most, doc_id, text).where("y in (0, 1)"))
    rows = sorted(tuple(r) for r in chosen.select("y", *STATISTICS, "doc_id").collect())
    if not rows:
        return RuleEnsemble(0.0, ())
    x, y = np.array([r[1:-1] for r in rows], float), np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, shares.get(1, 0) / max(1, (y == 1).sum()), shares.get(0, 0) / max(1, (y == 0).sum()))
    return fit_arrays(x, y, weight / weight.sum())


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """A frame's columns but text, the STATISTICS and score in 0 to 1, a column compiled from the rules."""
    return with_statistics(docs, text).withColumn("score", model.score())
