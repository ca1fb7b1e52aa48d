"""Writers. Every sink is a Spark dataset, written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.labels import file_stem


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """The canonical form of compacted profiles: ``(path, *order, line)`` as parquet.

    A profile without rules has one row whose order and line are NULL.
    """
    lines.write.mode("overwrite").parquet(path)


def write_rule_texts(lines: DataFrame, path: str, order: list[str]) -> None:
    """One folder per profile, named by its relative path, one rule per row of text.

    The readers of rule texts take the profile's name from the folder. A profile
    without rules is one blank row. Rows are ranged by profile and place, so that a very large profile is written by
    several tasks, as several files whose names are in order.
    """
    stem = file_stem(F.col("path"))
    folder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)))
    named = lines.withColumn("profile", F.concat(folder, stem, F.lit("_compact")))
    (
        named.repartitionByRange("profile", *order)
        .sortWithinPartitions("profile", *order)
        .select("profile", F.coalesce("line", F.lit("")).alias("value"))
        .write.mode("overwrite")
        .partitionBy("profile")
        .text(path)
    )


def write_bank(bank: DataFrame, path: str, *partition_by: str) -> None:
    """A vector bank as parquet, for instance by encoder and representation."""
    bank.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Reports and statistics as JSON rows."""
    report.write.mode("overwrite").json(path)
