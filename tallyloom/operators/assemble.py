"""Joining scores to annotations, tiers and the data set's statistics (JN1, JN5, AG8, SET1, SET2, ALT2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.aspects import count, empty
from tallyloom.functions.mathx import FLAG, INCLUDE, tier
from tallyloom.schemas import ANNOTATION_SOURCE, NO_CATEGORY, SCORES
from tallyloom.sources.readers import once

TIERS = ("include", "flag_for_review", "exclude", "unjudged")


def merge_scores(annotations: DataFrame, scores: DataFrame, include: float = INCLUDE, flag: float = FLAG) -> DataFrame:
    """Annotations with their scores and tier; a row without scores is unjudged. scores: a row for each review_id at most."""
    joined = annotations.join(scores.withColumnRenamed("judge_scores", "__s"), "review_id", "left")
    judged = F.col("__s").isNotNull()
    fields = {f"judge_{s}": F.when(judged, F.coalesce(F.col(f"__s.{s}"), F.lit(0)) if s == "overall" else F.col(f"__s.{s}")) for s in SCORES}
    out = joined.withColumns(fields | {"judge_explanation": F.col("__s.explanation"), "human_verified": F.lit(False), "quality_tier": F.when(judged, tier(F.coalesce(F.col("__s.overall"), F.lit(0)), include, flag)).otherwise("unjudged")})
    defaults = {"business_name": F.lit(""), "business_category": F.lit(NO_CATEGORY), "annotation_source": F.lit(ANNOTATION_SOURCE), "aspects": empty()}
    return out.drop("__s", "parse_success", "raw_output").withColumns({c: F.coalesce(c, d) for c, d in defaults.items() if c in out.columns})


def split_tiers(merged: DataFrame) -> dict[str, DataFrame]:
    known = F.col("quality_tier").isin(*TIERS[:3])
    return {t: merged.where(F.col("quality_tier") == t) for t in TIERS[:3]} | {"unjudged": merged.where(~F.coalesce(known, F.lit(False)))}


def silver(merged: DataFrame) -> DataFrame:
    """Included and unjudged rows, the former first by `bucket`."""
    kept = split_tiers(merged)
    return kept["include"].withColumn("bucket", F.lit(0)).unionByName(kept["unjudged"].withColumn("bucket", F.lit(1)))


def usable(annotations: DataFrame) -> DataFrame:
    """Parsed annotations with aspects, then those without, told apart by `bucket`."""
    ok, n = F.coalesce(F.col("parse_success"), F.lit(False)), F.coalesce(F.col("num_aspects"), F.lit(0))
    return annotations.where(ok & (n > 0)).withColumn("bucket", F.lit(0)).unionByName(annotations.where(ok & (n == 0)).withColumn("bucket", F.lit(1)))


def published(merged: DataFrame) -> DataFrame:
    """The nine columns that are published."""
    return merged.select("review_id", "text", "business_name", F.coalesce("business_category", F.lit(NO_CATEGORY)).alias("business_category"), "user_rating", F.coalesce("aspects", empty()).alias("aspects"), "num_aspects", "annotation_source", "quality_tier")


SUMS = ("judged", "unjudged", "included", "flagged", "excluded", "silver", "total_aspects")


def facts(merged: DataFrame) -> DataFrame:
    """(kind, key, n, first_seen, sums): how often each domain, included domain, polarity and category stands, from one scan.

    A row gives a fact of its own (kind row, which alone is summed up), one of its domain, a further one if it is
    included, and two for each aspect; equal facts combine before the shuffle.
    """
    tier, aspects, domain = F.col("quality_tier"), F.coalesce("aspects", empty()), F.col("business_category")
    numbers = (tier != "unjudged", tier == "unjudged", tier == "include", tier == "flag_for_review", tier == "exclude", tier.isin("include", "unjudged"))
    sums = dict(zip(SUMS, [*(F.coalesce(c, F.lit(False)).cast("long") for c in numbers), count(F.col("aspects")).cast("long")], strict=True))
    fact = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    of = lambda kind, field: F.transform(aspects, lambda a: fact(kind, F.coalesce(a[field], F.lit("unknown"))))
    own = F.filter(F.array(fact("row", F.lit("")), fact("domain", domain), fact("included", domain)), lambda f: (f["kind"] != "included") | F.coalesce(tier == "include", F.lit(False)))
    held = merged.select("ordinal", *[c.alias(k) for k, c in sums.items()], *[F.col(f"judge_{s}") for s in SCORES], F.explode(F.concat(own, of("polarity", "polarity"), of("category", "category"))).alias("f")).select("*", "f.kind", "f.key")
    own_row = lambda c: F.when(F.col("kind") == "row", F.col(c))
    return held.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_seen"), *[F.sum(own_row(c)).alias(c) for c in SUMS], *[F.avg(own_row(f"judge_{s}")).alias(f"avg_{s}") for s in SCORES])


def dataset_stats(merged: DataFrame) -> DataFrame:
    """One row: totals, tiers, aspects, judge means, and maps of domains, polarities and the 20 most frequent categories.

    merged is scanned once; what is then put together is a row for each domain, polarity and category.
    """
    found = once(facts(merged))
    whole = lambda c: F.max(F.when(F.col("kind") == "row", F.col(c)))
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.coalesce("key", F.lit("unknown")), "n"))))
    total, zero = F.coalesce(whole("n"), F.lit(0).cast("long")), F.lit(0).cast("long")
    rows = found.where("kind <> 'category'").agg(
        total.alias("total"), *[F.coalesce(whole(c), zero).alias(c) for c in SUMS[:-1]], whole(SUMS[-1]).alias(SUMS[-1]), F.try_divide(whole(SUMS[-1]), total).alias("avg_aspects"), F.count(F.when(F.col("kind") == "domain", F.col("key"))).alias("n_domains"),
        *[whole(f"avg_{s}").alias(f"avg_{s}") for s in SCORES], of("domain").alias("business_category_counts"), of("included").alias("included_counts"), of("polarity").alias("polarity_counts"),
    )
    first = found.where("kind = 'category'").orderBy(F.desc("n"), "first_seen").limit(20)
    categories = first.agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("top_categories"))
    return rows.crossJoin(F.broadcast(categories))  # one row each
