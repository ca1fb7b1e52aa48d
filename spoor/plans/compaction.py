"""Profile documents to rule lines, with size statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spoor.operators.flatten import (
    document_sizes, entries, ordered_distinct, parse_documents, reasoned, render,
)
from spoor.operators.stats import reduction_stats, reduction_summary
from spoor.session import stored
from spoor.sources.listing import Opener
from spoor.sources.profiles import read_documents
from spoor.sources.sinks import write_lines, write_report, write_rule_texts

ORDER = ["acl_pos", "ace_pos"]


@dataclass(frozen=True)
class Compacted:
    lines: DataFrame  # (key, acl_pos, ace_pos, line)
    stats: DataFrame  # one row per document
    summary: DataFrame  # one row
    quarantine: DataFrame  # (key, text, reason) of documents without access lists


def compact(documents: DataFrame, key: str = "path") -> Compacted:
    """``documents (key, text)`` to distinct lines in first-occurrence order."""
    parsed, bad = parse_documents(documents)
    lines = ordered_distinct(render(entries(parsed, key), key), [key], ORDER)
    stats = reduction_stats(document_sizes(parsed, key), lines, key)
    return Compacted(lines, stats, reduction_summary(stats), bad)


def compact_folder(
    spark: SparkSession, source: str, target: str, opener: Opener | None = None
) -> Compacted:
    """Compact every profile below ``source``; results go below ``target``.

    A profile without rules keeps a row with a NULL line, and a text without rules. Documents
    are read and parsed once. With an ``opener`` their folders are listed by tasks, see
    ``sources.listing``.
    """
    parsed = stored(reasoned(read_documents(spark, source, opener)))
    profiles = parsed.filter("reason is null")
    found = ordered_distinct(render(entries(profiles, "path"), "path"), ["path"], ORDER)
    write_lines(profiles.select("path").join(found, "path", "left"), f"{target}/lines", ORDER)
    quarantine = parsed.filter("reason is not null").select("path", "text", "reason")
    write_report(quarantine, f"{target}/quarantine")
    # The other sinks read the lines just written instead of rendering again.
    written = spark.read.parquet(f"{target}/lines")
    lines = written.filter("line is not null")
    stats = reduction_stats(profiles, lines)
    write_rule_texts(written, f"{target}/texts", ORDER)
    write_report(stats, f"{target}/reduction_stats")
    stats = spark.read.schema(stats.schema).json(f"{target}/reduction_stats")
    write_report(reduction_summary(stats), f"{target}/reduction_summary")
    return Compacted(lines, stats, reduction_summary(stats), quarantine)
