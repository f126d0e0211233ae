"""Scoring predictions against gold aspects (AG13 to AG17, JN6 to JN8, SET3). Rows meet by key, never by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.aspects import pairs, partial_hits, terms
from tallyloom.functions.mathx import f1, ratio


def term_counts(df: DataFrame, predicted: str = "predicted", gold: str = "gold", partial: bool = False) -> DataFrame:
    """df with tp, fp and fn of each row's distinct normalised terms."""
    held = df.withColumns({"__p": terms(F.col(predicted)), "__g": terms(F.col(gold))})
    tp = partial_hits(F.col("__p"), F.col("__g")) if partial else F.size(F.array_intersect("__p", "__g"))
    out = held.withColumn("tp", tp.cast("long"))
    return out.withColumns({"fp": F.greatest(F.size("__p") - F.col("tp"), F.lit(0)), "fn": F.size("__g") - F.col("tp")}).drop("__p", "__g")


def micro(counts: DataFrame) -> DataFrame:
    """One row: summed counts, precision, recall and F1, 0 where undefined."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    s = counts.agg(zero("tp"), zero("fp"), zero("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def term_metrics(df: DataFrame, predicted: str = "predicted", gold: str = "gold", partial: bool = False) -> DataFrame:
    return micro(term_counts(df, predicted, gold, partial))


def with_pairs(df: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    return df.withColumns({"__p": pairs(F.col(predicted)), "__g": pairs(F.col(gold))})


def pair_metrics(df: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Micro scores of distinct (term, polarity) pairs and their totals."""
    held = with_pairs(df, predicted, gold).withColumn("tp", F.size(F.array_intersect("__p", "__g")).cast("long"))
    out = micro(held.withColumns({"fp": F.size("__p") - F.col("tp"), "fn": F.size("__g") - F.col("tp")}))
    return out.withColumns({"total_predictions": F.col("tp") + F.col("fp"), "total_references": F.col("tp") + F.col("fn")})


def matched_polarities(df: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """(is, should) for each term of a row that both sides have; of several polarities the least; empty ones are left out."""
    held = with_pairs(df, predicted, gold)
    common = F.array_intersect(F.transform("__p", lambda a: a["term"]), F.transform("__g", lambda a: a["term"]))
    least = lambda side, t: F.array_min(F.transform(F.filter(F.col(side), lambda a: a["term"] == t), lambda a: a["polarity"]))
    both = F.transform(F.array_distinct(common), lambda t: F.struct(least("__p", t).alias("is"), least("__g", t).alias("should")))
    return held.select(F.explode(both).alias("m")).select("m.is", "m.should").where("`is` <> '' and should <> ''")


def sentiment_accuracy(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("is") == F.col("should")).cast("int")), F.lit(0.0)).alias("accuracy"))


def sentiment_by_label(matched: DataFrame) -> DataFrame:
    """(label, tp, wrong, f1) for every label on either side; counts combine before the shuffle."""
    sides = matched.select(F.explode(F.array_distinct(F.array("is", "should"))).alias("label"), "is", "should")
    counted = sides.groupBy("label").agg(F.count_if((F.col("is") == F.col("label")) & (F.col("should") == F.col("label"))).alias("tp"), F.count_if(F.col("is") != F.col("should")).alias("wrong"))
    return counted.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")))


def sentiment_macro_f1(matched: DataFrame) -> DataFrame:
    return sentiment_by_label(matched).agg(F.count("*").alias("labels"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance (an extension). Labels are few, so the marginals are one array."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra")).withColumnRenamed("a", "label")
    columns = cells.groupBy("b").agg(F.sum("n").alias("rb")).withColumnRenamed("b", "label")
    chance = rows.join(columns, "label").agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("rb")), F.lit(0.0)).alias("chance"))
    seen = cells.agg(total.alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return seen.crossJoin(F.broadcast(chance)).select("n", po.alias("agreement"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))  # one row each
