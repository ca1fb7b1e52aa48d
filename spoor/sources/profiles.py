"""Scans of profile documents (JSON) and rule texts, one file per profile."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.labels import clean_label, expected_label, file_stem
from spoor.functions.text import lines, strip
from spoor.sources.guards import require_rows
from spoor.sources.listing import Opener, list_files, read_listed


def _relative(folder: str, file: Column | None = None) -> Column:
    """Path of the scanned file below ``folder``, percent escapes undone."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/")
    file = F.col("_metadata.file_path") if file is None else file
    escaped = F.replace(file, F.lit("+"), F.lit("%2B"))
    prefix = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?" + re.escape(base) + "/+"
    return F.regexp_replace(F.url_decode(escaped), prefix, "")


def _files(
    spark: SparkSession, folder: str, glob: str, opener: Opener | None = None
) -> DataFrame:
    """``(path, text)`` of all matching files below ``folder``, those of zero bytes included.

    With an ``opener`` the files are listed and read by tasks, and the driver sees no name.
    Without one Spark's scan reads them, from any store that Spark knows. The scan leaves out
    files of zero bytes, but its file index, which is on the driver, lists them.
    """
    if opener is not None:
        return read_listed(list_files(spark, folder, glob, opener), folder, opener)
    scan = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    found = scan.select(_relative(folder).alias("path"), F.col("value").alias("text"))
    listed = spark.createDataFrame([(name,) for name in scan.inputFiles()], "file string")
    names = listed.select(_relative(folder, F.col("file")).alias("path"))
    blank = names.join(found.select("path"), "path", "left_anti")
    return found.unionByName(blank.withColumn("text", F.lit("")))


def _joined_parts(files: DataFrame) -> DataFrame:
    """Texts written as ``profile=<name>/part-*`` as one text each, named ``<name>.txt``."""
    layout = r"^(?:.*/)?profile=([^/]*)/part-[^/]*$"
    name = F.concat(F.url_decode(F.regexp_extract("path", layout, 1)), F.lit(".txt"))
    in_order = F.array_sort(F.collect_list(F.struct("path", "text")))
    parts = (
        files.filter(F.col("path").rlike(layout))
        .groupBy(name.alias("name"))
        .agg(F.array_join(F.transform(in_order, lambda p: p["text"]), "").alias("text"))
    )
    plain = files.filter(~F.col("path").rlike(layout))
    return plain.unionByName(parts.withColumnRenamed("name", "path"))


def read_documents(
    spark: SparkSession, folder: str, opener: Opener | None = None
) -> DataFrame:
    """``(path, text)`` of every ``*.json`` below ``folder``.

    Give an ``opener`` such as ``listing.arrow_files`` where there are very many files.
    """
    return require_rows(_files(spark, folder, "*.json", opener), f"no profiles in {folder}")


def read_rule_files(
    spark: SparkSession, folder: str, recursive: bool = True, opener: Opener | None = None
) -> DataFrame:
    """``(path, text)`` of every ``*.txt``; the whole text in one string.

    A blank file counts as a profile, also one of zero bytes. Folders written by
    ``write_rule_texts`` count as one file per profile.
    """
    files = _joined_parts(_files(spark, folder, "*.txt", opener))
    if not recursive:
        files = files.filter(~F.col("path").contains("/"))
    return require_rows(files, f"no rule texts in {folder}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ..., line)`` as written by ``write_lines``."""
    return require_rows(spark.read.parquet(path), f"no profiles in {path}")


def line_reference_sets(lines: DataFrame) -> DataFrame:
    """``(device, line)`` of compacted profiles; the last path of a cleaned name wins whole."""
    named = lines.select(
        clean_label(file_stem(F.col("path"))).alias("device"), "path", "line"
    )
    latest = named.groupBy("device").agg(F.max("path").alias("path"))
    return named.join(latest, ["device", "path"], "left_semi").select("device", "line").distinct()


def line_query_sets(lines: DataFrame) -> DataFrame:
    """``(query, expected, line)`` of compacted profiles; key = their path."""
    return lines.select(
        F.col("path").alias("query"), expected_label(F.col("path")).alias("expected"), "line"
    ).distinct()


def rule_lines(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``(*keys, pos, line)``: stripped non-blank lines, duplicates kept."""
    return (
        files.select(*keys, F.posexplode(lines(F.col(text))).alias("pos", "line"))
        .withColumn("line", strip(F.col("line")))
        .filter(F.col("line") != "")
    )


def rule_sets(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, line)`` without duplicates; a blank file keeps one row with a NULL line."""
    kept = F.filter(F.transform(lines(F.col(text)), strip), lambda line: line != "")
    return files.select(key, F.explode_outer(kept).alias("line")).distinct()


def read_reference_sets(spark: SparkSession, folder: str) -> DataFrame:
    """``(device, line)`` of the texts directly in ``folder``.

    If several files share one cleaned name, the last path in order wins whole.
    """
    files = read_rule_files(spark, folder, recursive=False)
    return rule_sets(last_file_wins(files), "device")


def last_file_wins(files: DataFrame) -> DataFrame:
    """``(device, path, text)``: one file per cleaned name, the greatest path."""
    return (
        files.withColumn("device", clean_label(file_stem(F.col("path"))))
        .groupBy("device")
        .agg(F.max("path").alias("path"), F.max_by("text", "path").alias("text"))
    )


def read_query_sets(spark: SparkSession, folder: str) -> DataFrame:
    """``(query, expected, line)`` of all texts below ``folder``; key = relative path."""
    files = read_rule_files(spark, folder)
    sets = rule_sets(files.withColumnRenamed("path", "query"), "query")
    return sets.select("query", expected_label(F.col("query")).alias("expected"), "line")
