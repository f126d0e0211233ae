"""Profiles and aggregates (AG1 to AG12, AG17, AG20), each from one scan of its input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyloom.functions.aspects import count
from tallyloom.functions.mathx import FLAG, INCLUDE
from tallyloom.functions.text import word_count
from tallyloom.schemas import POLARITIES, SCORES
from tallyloom.sources.readers import once

MANY_ASPECTS = 5


#: Bits of a value that a round of selection settles.
DIGIT = 16


def at_ranks(df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]]) -> dict[str, list[int]]:
    """The values of whole-number columns at some ranks, from 0, of their sorted values without nulls; [] if there are none.

    Each round counts the next DIGIT bits of the values that agree with what is settled, by column and rank at once: counts
    combine in the tasks, and a histogram of 2 ** DIGIT rows for each is all that anyone sees.
    """
    flip = 1 << 63  # so that negative numbers come first as unsigned ones
    values = df.select(*[F.col(c).cast("long").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value is not null")
    bits = F.col("value").bitwiseXOR(F.lit(-flip))
    digit = lambda shift: F.shiftrightunsigned(bits, shift).bitwiseAND((1 << DIGIT) - 1).cast("int")
    open_: dict[str, list[list[int]]] = {}  # column to [settled, rank within it]
    for k, shift in enumerate(range(64 - DIGIT, -1, -DIGIT)):
        if k == 0:
            seen, key = values, F.lit(0).cast("long")
        else:
            key = F.shiftrightunsigned(bits, shift + DIGIT)
            alike = F.lit(False)
            for c, settled in sorted({(c, s) for c, held in open_.items() for s, _ in held}):
                alike = alike | ((F.col("column") == c) & (key == settled))
            seen = values.where(alike)
        counted = seen.groupBy("column", key.alias("settled"), digit(shift).alias("digit")).agg(F.count("*").alias("n")).toArrow().to_pylist()
        histogram: dict[tuple[str, int], dict[int, int]] = {}
        for r in counted:
            histogram.setdefault((r["column"], r["settled"]), {})[r["digit"]] = r["n"]
        if k == 0:
            open_ = {c: [[0, rank] for rank in ranks(sum(h.values()))] for (c, _), h in histogram.items()}
        for c, held in open_.items():
            for one in held:
                left = one[1]
                for d in sorted(h := histogram[c, one[0]]):
                    if left < h[d]:
                        break
                    left -= h[d]
                one[:] = [one[0] << DIGIT | d, left]
    return {c: [s - flip for s, _ in open_.get(c, [])] for c in columns}


def medians(df: DataFrame, *columns: str) -> dict[str, float | None]:
    """Exact medians, the mean of the middle two of an even number of values; None of no values."""
    found = at_ranks(df, columns, lambda n: [(n - 1) // 2, n // 2])
    return {c: sum(v) / 2 if v else None for c, v in found.items()}


def text_stats(df: DataFrame, text: str = "review_text", median: bool = False) -> DataFrame:
    """Counts, means and extremes of words and characters, and exact medians, cut to integers, if asked."""
    sized = df.where(F.col(text).isNotNull()).select(word_count(F.col(text)).alias("words"), F.length(text).alias("chars"))
    out, held = [F.count("*").alias("n")], {}
    if median:
        sized = once(sized)
        held = medians(sized, "words", "chars")
    for c in ("words", "chars"):
        out += [F.avg(c).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        out += [F.lit(held[c]).cast("int").alias(f"median_{c}")] if median else []
    return sized.agg(*out)


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): the mean place, from 1, of the rows that have a value, in the order of the values.

    Values are counted, dealt by ranges, and numbered within each; what the ranges before one hold is added, a row a range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = once(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("held"))
    before = sums.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))  # a row for each range
    within = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    return ranged.withColumn("upto", within).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, the correlation of the average ranks of two columns where both are there, and the number of rows.

    Equal pairs are counted first, so a frequent value is one row, not a hot key, where ranks are looked up. rho is null for
    less than two rows, or where a column has one value alone.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    counted = once(pairs.groupBy("x", "y").agg(F.count("*").alias("w")))
    both = counted
    for c in ("x", "y"):
        ranks = average_ranks(pairs, c)
        both = both.join(ranks.select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")), c)
    w = F.col("w").cast("double")
    sums = both.agg(F.sum("w").alias("n"), *[F.sum(w * a).alias(k) for k, a in {"sx": F.col("rx"), "sy": F.col("ry"), "xx": F.col("rx") * F.col("rx"), "yy": F.col("ry") * F.col("ry"), "xy": F.col("rx") * F.col("ry")}.items()])
    spread = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    rho = spread("sx", "sy", "xy") / F.nullif(F.sqrt(spread("sx", "sx", "xx") * spread("sy", "sy", "yy")), F.lit(0.0))
    return sums.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), rho.alias("rho"))


def percent_of_all(n: str) -> Column:
    """A count's share in percent of the sum of all: over counted rows, a row for each class."""
    return F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(0))) * 100


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows and their share in percent by key, from one scan."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("pct", percent_of_all("n"))


def category_stats(df: DataFrame, category: str = "business_category", name: str = "object_name") -> DataFrame:
    counted = df.groupBy(category).agg(F.count("*").alias("review_count"), F.count_distinct(name).alias("unique_businesses"))
    return counted.withColumn("pct", percent_of_all("review_count"))


def domain_distribution(annotations: DataFrame, domain: str = "business_category") -> DataFrame:
    n = F.coalesce(F.col("num_aspects"), F.lit(0)).cast("long")
    return annotations.groupBy(domain).agg(F.count("*").alias("n"), F.sum(n).alias("total_aspects"), F.avg(n).alias("avg_aspects"))


def quality_counts() -> list[Column]:
    """Annotations that are good, without aspects, failed, and flagged (good, with more than five aspects)."""
    ok, n = F.coalesce(F.col("parse_success"), F.lit(False)), F.coalesce(F.col("num_aspects"), F.lit(0))
    good = ok & (n > 0)
    return [F.count("*").alias("total"), F.count_if(good).alias("good"), F.count_if(ok & (n == 0)).alias("no_aspects"), F.count_if(~ok).alias("failed"), F.count_if(good & (n > MANY_ASPECTS)).alias("flagged")]


def with_usable_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn("usable_rate", F.coalesce(F.try_divide(F.col("good") * 100.0, F.col("total").cast("double")), F.lit(0.0)))


def annotation_quality(annotations: DataFrame) -> DataFrame:
    return with_usable_rate(annotations.agg(*quality_counts()))


def observed(df: DataFrame, *counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what its rows count up to in the pass of whatever action is run on it first: no scan of its own."""
    seen = Observation()
    return df.observe(seen, *counts), seen


def observed_row(df: DataFrame, seen: Observation) -> DataFrame:
    """The one row of what was counted; waits for the action."""
    found = seen.get
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in found.items()))


def converted_stats(df: DataFrame, text: str = "text", aspects: str = "aspects") -> DataFrame:
    """Totals, means and the polarity histogram of converted examples; other polarities count as aspects alone."""
    of = lambda p: F.size(F.filter(F.coalesce(F.col(aspects), F.array()), lambda a: F.lower(a["polarity"]) == p)).cast("long")
    return df.agg(
        F.count("*").alias("n"), F.sum(count(F.col(aspects)).cast("long")).alias("n_aspects"), F.avg(count(F.col(aspects))).alias("avg_aspects"), F.avg(word_count(F.col(text))).alias("avg_words"),
        F.count_if(count(F.col(aspects)) > 0).alias("n_with_aspects"), *[F.sum(of(p)).alias(p) for p in POLARITIES],
    )


def judge_means(results: DataFrame, domain: str = "business_category", scores: str = "judge_scores") -> DataFrame:
    """Means of the five scores over all judged rows (domain null) and by domain, in one pass of grouping sets."""
    flat = results.where(F.col(scores).isNotNull()).select(domain, *[F.col(f"{scores}.{s}").alias(s) for s in SCORES])
    grouped = flat.groupingSets([[], [F.col(domain)]], F.col(domain))
    return grouped.agg(F.grouping(domain).cast("int").alias("over_all"), F.count("*").alias("n"), *[F.avg(s).alias(s) for s in SCORES])


def score_histogram(results: DataFrame, scores: str = "judge_scores") -> DataFrame:
    """(dimension, n1 .. n5): how often each score was given, 0 included."""
    flat = results.where(F.col(scores).isNotNull()).select(*[F.col(f"{scores}.{s}").alias(s) for s in SCORES])
    long = flat.unpivot([], list(SCORES), "dimension", "score")
    return long.groupBy("dimension").agg(*[F.count_if(F.col("score") == k).alias(f"n{k}") for k in range(1, 6)])


def tier_counts(results: DataFrame, scores: str = "judge_scores") -> DataFrame:
    o = F.coalesce(F.col(f"{scores}.overall"), F.lit(0))
    return results.where(F.col(scores).isNotNull()).agg(F.count_if(o >= INCLUDE).alias("include"), F.count_if((o >= FLAG) & (o < INCLUDE)).alias("flag_for_review"), F.count_if(o < FLAG).alias("exclude"))


def parse_rate(df: DataFrame, ok: str = "parse_success", aspects: str = "aspects") -> DataFrame:
    good = F.coalesce(F.col(ok), F.lit(False))
    out = df.agg(F.count("*").alias("n"), F.count_if(good).alias("parsed"), F.count_if(~good).alias("failed"), F.count_if(count(F.col(aspects)) == 0).alias("empty"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("parsed") * 100.0, F.col("n").cast("double")), F.lit(0.0)))


def report_lines(means: DataFrame, domain: str = "business_category") -> DataFrame:
    """A line of fixed width for each row of judge_means."""
    name = F.when(F.col("over_all") == 1, "all").otherwise(F.coalesce(domain, F.lit("")))
    return means.orderBy(F.desc("over_all"), F.desc("n")).select(F.format_string("%-30s %6d" + " %6.2f" * len(SCORES), name, "n", *SCORES).alias("value"))
