"""Arrays of aspects: conversion, validation and the set operations of scoring (ARR1 to ARR6, FLT6, FLT7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.schemas import POLARITIES


def aspect(term: Column, category: Column, polarity: Column) -> Column:
    return F.struct(term.cast("string").alias("term"), category.cast("string").alias("category"), polarity.cast("string").alias("polarity"))


def empty() -> Column:
    return F.array().cast("array<struct<term:string,category:string,polarity:string>>")


def converted(terms: Column, categories: Column, keep_category: bool = False) -> Column:
    """Terms, then categories, as one array of aspects; a missing name is "", a missing polarity neutral.

    keep_category: terms have a category of their own, which stays.
    """
    polarity = lambda a: F.lower(F.coalesce(a["polarity"], F.lit("neutral")))
    first = F.transform(terms, lambda a: aspect(F.coalesce(a["term"], F.lit("")), a["category"] if keep_category else F.lit(None), polarity(a)))
    second = F.transform(categories, lambda a: aspect(F.lit(None), F.coalesce(a["category"], F.lit("")), polarity(a)))
    return F.concat(F.coalesce(first, empty()), F.coalesce(second, empty()))


def is_valid(a: Column) -> Column:
    return F.coalesce((a["term"].isNotNull() | a["category"].isNotNull()) & F.lower(a["polarity"]).isin(*POLARITIES), F.lit(False))


def valid(aspects: Column) -> Column:
    return F.coalesce(F.filter(aspects, is_valid), empty())


def named(aspects: Column) -> Column:
    """Those with a term that is neither null nor empty."""
    return F.coalesce(F.filter(aspects, lambda a: F.coalesce(a["term"] != "", F.lit(False))), empty())


def normal(c: Column) -> Column:
    return F.lower(strip(c))


def terms(aspects: Column) -> Column:
    return F.array_distinct(F.transform(named(aspects), lambda a: normal(a["term"])))


def pairs(aspects: Column) -> Column:
    """Distinct (term, polarity), both normalised; a missing polarity is ""."""
    return F.array_distinct(F.transform(named(aspects), lambda a: F.struct(normal(a["term"]).alias("term"), normal(F.coalesce(a["polarity"], F.lit(""))).alias("polarity"))))


def partial_hits(predicted: Column, gold: Column) -> Column:
    """How many distinct gold terms are credited, when each prediction credits the least that holds it or is held by it."""
    best = F.transform(predicted, lambda p: F.array_min(F.filter(gold, lambda g: p.contains(g) | g.contains(p))))
    return F.size(F.array_distinct(F.array_compact(best)))


def count(aspects: Column) -> Column:
    return F.coalesce(F.size(aspects), F.lit(0))
