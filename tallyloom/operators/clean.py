"""Cleaning, deduplication and ids of raw reviews (FLT1 to FLT5, FLT9, FLT10, DED1, DED2, LIM1 to LIM3, WIN2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import script_class, snippet, strip
from tallyloom.operators.stats import observed
from tallyloom.sources.readers import dense_ordinal

LEAST_CHARS = 10


def has_text(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def first_of_each(df: DataFrame, *keys: str, ordinal: str = "ordinal") -> DataFrame:
    """The first row of each key by ordinal; nulls are equal. Minima combine before the shuffle, so a hot key is one row of each task."""
    others = [c for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.min_by(F.struct(*others), ordinal).alias("__row"))
    return held.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def clean(df: DataFrame, text: str = "review_text", least: int = LEAST_CHARS, unique: bool = True, ordinal: str = "ordinal") -> DataFrame:
    """Rows with a text that isn't blank and, unstripped, long enough; the first of equal texts."""
    kept = df.where(has_text(F.col(text)) & (F.length(text) >= least))
    return first_of_each(kept, text, ordinal=ordinal) if unique else kept


def stage_counts(df: DataFrame, text: str = "review_text", least: int = LEAST_CHARS) -> DataFrame:
    """Rows left after each step of clean(), in one pass."""
    there, full = F.col(text).isNotNull(), has_text(F.col(text))
    long = full & (F.length(text) >= least)
    return df.agg(F.count("*").alias("n_rows"), F.count_if(there).alias("n_present"), F.count_if(full).alias("n_not_blank"), F.count_if(long).alias("n_long"), F.count_distinct(F.when(long, F.col(text))).alias("n_unique"))


def clean_counted(df: DataFrame, text: str = "review_text", least: int = LEAST_CHARS, ordinal: str = "ordinal") -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """clean(df), and a function that gives the counts of stage_counts() once an action on the frame has run.

    The counts are taken in the pass that makes the result, before and after the shuffle; the input isn't read for them.
    """
    there, full = F.col(text).isNotNull(), has_text(F.col(text))
    before, first = observed(df, F.count("*").alias("n_rows"), F.count_if(there).alias("n_present"), F.count_if(full).alias("n_not_blank"), F.count_if(full & (F.length(text) >= least)).alias("n_long"))
    after, last = observed(clean(before, text, least, ordinal=ordinal), F.count("*").alias("n_unique"))
    return after, lambda: {**first.get, **last.get}


def explore_clean(df: DataFrame, text: str = "review_text") -> DataFrame:
    return df.where(has_text(F.col(text)))


def with_category(df: DataFrame, categories: DataFrame, name: str = "object_name") -> DataFrame:
    """A category for each name; null where there is none. The dimension is broadcast if Spark finds it small enough."""
    return df.join(categories, name, "left")


def prepare(df: DataFrame, categories: DataFrame, text: str = "review_text", least: int = LEAST_CHARS, ordinal: str = "ordinal") -> DataFrame:
    """Reviews ready to annotate: categories, the first of equal texts, long enough, with ids rev_00000 and on."""
    kept = first_of_each(with_category(df, categories), text, ordinal=ordinal).where(F.length(text) >= least)
    return dense_ordinal(kept, ordinal).withColumn("review_id", review_id(F.col("position")))


def review_id(position: Column) -> Column:
    return F.format_string("rev_%05d", position)


def scoreable(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.coalesce(F.col("parse_success"), F.lit(False)) & (F.coalesce(F.col("num_aspects"), F.lit(0)) > 0))


def is_chatml(c: Column) -> Column:
    return F.coalesce(c.contains("<|im_start|>") & c.contains("<|im_end|>") & c.contains("assistant"), F.lit(False))


def top_per_group(df: DataFrame, group: str, item: str, k: int, ordinal: str = "ordinal") -> DataFrame:
    """The k most frequent items of each group; ties by first occurrence."""
    counted = df.groupBy(group, item).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first_seen"))
    return counted.withColumn("place", rank).where(F.col("place") <= k)


def top(df: DataFrame, item: str, k: int, ordinal: str = "ordinal") -> DataFrame:
    counted = df.groupBy(item).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(k)


def samples_per_class(df: DataFrame, text: str, k: int = 2, size: int = 120, ordinal: str = "ordinal") -> DataFrame:
    """The first k texts of each script class, shortened. Only the least ordinals of a class are kept in the aggregate."""
    classed = df.select(script_class(F.col(text)).alias("script"), ordinal, snippet(F.col(text), size).alias("snippet"))
    place = F.row_number().over(Window.partitionBy("script").orderBy(ordinal))
    return classed.withColumn("place", place).where(F.col("place") <= k)
