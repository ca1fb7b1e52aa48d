"""Profiles as sets of rules, and banks with one row per distinct text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_sizes(rules: DataFrame, key: str) -> DataFrame:
    """``(key, rules)``: number of distinct rules per profile."""
    return rules.distinct().groupBy(key).agg(F.count("line").alias("rules"))


def last_wins(rules: DataFrame, label: str, source: str) -> DataFrame:
    """Rules of the greatest ``source`` per label; the other sources drop out whole."""
    latest = rules.groupBy(label).agg(F.max(source).alias(source))
    return rules.join(latest, [label, source], "left_semi")


def first_rows(bank: DataFrame) -> DataFrame:
    """``(device, text, row_id)``: the first row of each distinct text of a device."""
    return bank.groupBy("device", "text").agg(F.min("row_id").alias("row_id"))
