"""Sizes before and after compaction, and corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.numbers import reduction_percent


def flattened_sizes(lines: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, flattened_size)``: characters of the lines joined by line feeds."""
    return lines.groupBy(*keys).agg(
        (F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("flattened_size")
    )


def reduction_stats(documents: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """Characters per document before and after, difference and percent.

    Parsed documents bring their ``original_size``, others their ``text``.
    """
    known = "original_size" in documents.columns
    size = F.col("original_size") if known else F.length("text").cast("long")
    sizes = documents.select(key, size.alias("original_size"))
    after = F.coalesce("flattened_size", F.lit(0)).cast("long")
    joined = sizes.join(flattened_sizes(lines, key), key, "left").withColumn(
        "flattened_size", after
    )
    before, after = F.col("original_size"), F.col("flattened_size")
    return joined.select(
        key,
        before,
        after,
        (before - after).alias("reduction_bytes"),
        reduction_percent(before, after).alias("reduction_percent"),
    )


def reduction_summary(stats: DataFrame) -> DataFrame:
    """Totals over all documents; the percent is that of the totals."""
    totals = stats.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_original_size"),
        F.coalesce(F.sum("flattened_size"), F.lit(0)).alias("total_flattened_size"),
    )
    before, after = F.col("total_original_size"), F.col("total_flattened_size")
    return totals.select(
        "*",
        (before - after).alias("total_reduction_bytes"),
        reduction_percent(before, after).alias("total_reduction_percent"),
    )


def corpus_counts(lines: DataFrame, key: str) -> DataFrame:
    """Profiles, rule instances and unique rules. Counted in two steps per rule."""
    per_rule = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    rules = per_rule.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rule_instances"),
        F.count(F.lit(1)).alias("unique_rules"),
    )
    profiles = lines.select(key).distinct().agg(F.count(F.lit(1)).alias("profiles"))
    # One row each.
    return profiles.withColumn("one", F.lit(1)).join(
        rules.withColumn("one", F.lit(1)), "one"
    ).drop("one")


# Sketches of 2 ** SKETCH_BITS registers; the standard error of a merged one is about
# 1.04 / sqrt(2 ** SKETCH_BITS), 0.8 percent.
SKETCH_BITS = 14


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """Standard error of an estimate, as a share of the true count."""
    return 1.04 / 2 ** (bits / 2)


def corpus_sketches(lines: DataFrame, key: str, *batch: str, bits: int = SKETCH_BITS) -> DataFrame:
    """``(*batch, rule_instances, rules, profiles)``: one mergeable row per batch of profiles.

    ``rules`` and ``profiles`` are sketches of the distinct rules and keys. They are made per
    task and merged, so a batch of any size ships a few kilobytes per task, and a stored row
    stands for its batch in every later count.
    """
    grouped = lines.groupBy(*batch) if batch else lines.groupBy()
    return grouped.agg(
        F.count("line").alias("rule_instances"),
        F.hll_sketch_agg("line", bits).alias("rules"),
        F.hll_sketch_agg(F.col(key).cast("string"), bits).alias("profiles"),
    )


def estimated_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """Rows of ``corpus_sketches`` merged: exact instances, estimated rules and profiles.

    The counterpart of ``corpus_counts`` without reading the profiles again. Batches may
    overlap in rules and profiles, not in instances.
    """
    grouped = sketches.groupBy(*by) if by else sketches.groupBy()
    merged = grouped.agg(
        F.coalesce(F.sum("rule_instances"), F.lit(0)).alias("rule_instances"),
        F.hll_union_agg("rules").alias("rules"),
        F.hll_union_agg("profiles").alias("profiles"),
    )

    def estimate(name):
        return F.coalesce(F.hll_sketch_estimate(name), F.lit(0)).cast("long")

    return merged.select(
        *by, "rule_instances", estimate("rules").alias("unique_rules"),
        estimate("profiles").alias("profiles"),
    )
