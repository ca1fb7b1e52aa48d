"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 where the denominator is 0."""
    return F.when(
        denominator != 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def reduction_percent(before: Column, after: Column) -> Column:
    """By how many percent ``after`` is smaller than ``before``, to two decimals."""
    kept = after.cast("double") / before.cast("double")
    return F.when(before != 0, F.round((F.lit(1.0) - kept) * 100, 2)).otherwise(F.lit(0.0))
