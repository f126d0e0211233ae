"""Stratified samples and splits (SMP1 to SMP3, AG19). Draws are by the digest of seed and id, so they repeat anywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.schemas import NO_CATEGORY

#: Rows of each priority domain.
TARGETS = {"Restoran/Ovqatlanish": 50, "Bank/Moliya": 30, "Telekommunikatsiya": 25, "Tibbiyot/Sog'liqni saqlash": 25, "Ta'lim": 20, "E-tijorat": 20, "Transport/Logistika": 15, "Mehmonxona/Turizm": 15}
FLOOR = 3


def draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def allocation(df: DataFrame, domain: str = "business_category", size: int = 300, targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """(domain, available, target): fixed targets first, the rest in proportion, FLOOR at least; the sum may pass size."""
    counts = df.groupBy(F.coalesce(F.col(domain), F.lit(NO_CATEGORY)).alias("domain")).agg(F.count("*").alias("available"))
    fixed = F.lit(None).cast("long")
    for name, n in reversed(targets.items()):
        fixed = F.when(F.col("domain") == name, F.lit(n).cast("long")).otherwise(fixed)
    held = counts.withColumn("__fixed", F.when(fixed.isNotNull(), F.least(fixed, F.col("available")))).withColumn("__free", F.col("__fixed").isNull() | (F.col("__fixed") == 0))
    sums = held.agg(F.coalesce(F.sum(F.when(~F.col("__free"), F.col("__fixed"))), F.lit(0)).alias("used"), F.coalesce(F.sum(F.when(F.col("__free"), F.col("available"))), F.lit(0)).alias("other"))
    rest = F.greatest(F.lit(size) - F.col("used"), F.lit(0))
    share = F.floor(rest * F.col("available") / F.col("other")).cast("long")
    target = F.when(~F.col("__free"), F.col("__fixed")).when(rest > 0, F.greatest(F.lit(FLOOR), F.least(share, F.col("available"))))
    return held.crossJoin(F.broadcast(sums)).withColumn("target", target).where("target is not null").select("domain", "available", "target")  # sums is one row


def stratified(df: DataFrame, key: str, domain: str = "business_category", size: int = 300, seed: int = 42, targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """As many rows of each domain as allocated, or all if fewer: those of least digests.

    No domain is allocated more than most, so a task hands on its most rows of least digest of each domain, and these are
    merged: what is shuffled is bounded by tasks and domains, not by rows.
    """
    most = max(size, FLOOR, *targets.values()) if targets else max(size, FLOOR)
    held = df.withColumn("domain", F.coalesce(F.col(domain), F.lit(NO_CATEGORY))).withColumn("__draw", draw(seed, key))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("__draw", key))
    least = held.withColumn("__place", place).where(F.col("__place") <= most)
    wanted = allocation(df, domain, size, targets).withColumnRenamed("available", "__available")
    return least.join(wanted, "domain").where(F.col("__place") <= F.col("target")).drop("__place", "__draw", "__available", "target")


def split(df: DataFrame, key: str, validation: float = 0.1, seed: int = 42, test: float = 0.0) -> DataFrame:
    """df with a split column of exact sizes: ceil(n * validation) rows, ceil(n * test), and the rest train.

    Rows stand in the order of their digests. Counts by the digest's first two bytes say in which of 65,536 parts each
    share ends; only the rows of those parts are ranked, all others follow from their part. A null key comes last.
    """
    first_bytes = F.coalesce(F.conv(F.substring("__draw", 1, 4), 16, 10).cast("int"), F.lit(1 << 16))
    drawn = df.withColumn("__draw", draw(seed, key)).withColumn("__part", first_bytes)
    counts = {r.part: r.n for r in drawn.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")).collect()}  # 65,537 rows at most
    n = sum(counts.values())
    ends = [-int(-n * validation // 1)]
    ends.append(ends[0] - int(-n * test // 1))
    seen, edges = 0, {}  # of the parts in which a share ends: the last rank of each share there
    last = [-1, -1]
    for part in sorted(counts):
        for k, end in enumerate(ends):
            if seen < end <= seen + counts[part]:
                last[k], edges[part] = part, [max(0, min(e - seen, counts[part])) for e in ends]
        seen += counts[part]
    by_part = F.when(F.col("__part") <= last[0], "validation").when(F.col("__part") <= last[1], "test").otherwise("train")
    at_edge = F.col("__part").isin(*edges) if edges else F.lit(False)
    ranked = drawn.where(at_edge).withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__draw", key)))
    chosen = F.lit("train")
    for part, (most_val, most_test) in edges.items():
        own = F.when(F.col("__rank") <= most_val, "validation").when(F.col("__rank") <= most_test, "test").otherwise("train")
        chosen = F.when(F.col("__part") == part, own).otherwise(chosen)
    return drawn.where(~at_edge).withColumn("split", by_part).unionByName(ranked.withColumn("split", chosen).drop("__rank")).drop("__draw", "__part")
