"""Arithmetic with the reference results' rounding, guards and thresholds (MA1 to MA4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCLUDE, FLAG = 3.5, 2.5


def half_even(c: Column, digits: int) -> Column:
    """Rounds the exact binary value, ties to even, as Python does; F.round rounds the decimal digits shown."""
    return F.replace(F.format_number(c.cast("double"), digits), F.lit(","), F.lit("")).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def tier(overall: Column, include: float = INCLUDE, flag: float = FLAG) -> Column:
    return F.when(overall >= include, "include").when(overall >= flag, "flag_for_review").otherwise("exclude")


def clamp(c: Column, low: int = 1, high: int = 5) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
