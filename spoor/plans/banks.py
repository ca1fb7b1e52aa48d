"""Make vector banks: embed rule texts, whiten banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions.labels import file_stem
from spoor.operators.encode import Encoder, embed
from spoor.operators.whiten import DEFAULT_K, WhiteningModel, fit_whitening
from spoor.sources.banks import read_bank
from spoor.sources.guards import require_rows
from spoor.sources.profiles import read_lines, read_rule_files, rule_lines
from spoor.sources.sinks import write_bank, write_report


def embed_folder(
    spark: SparkSession, folder: str, encoder: Encoder, target: str, pool: str = "per-rule"
) -> DataFrame:
    """Bank of the rule texts below ``folder``; labels are file stems.

    ``row_id`` is a hash of the row's place, unique up to 64-bit collisions within
    one bank, and the same in every run.
    """
    files = read_rule_files(spark, folder)
    lines = rule_lines(files, "path")
    if pool != "whole":
        require_rows(lines, f"no rules in {folder}")
    return _write_embedded(spark, files, lines, encoder, target, pool)


def embed_lines(
    spark: SparkSession, path: str, encoder: Encoder, target: str, pool: str = "per-rule"
) -> DataFrame:
    """The same for compacted profiles, as ``write_lines`` left them."""
    found = read_lines(spark, path)
    order = F.struct("acl_pos", "ace_pos")
    place = Window.partitionBy("path").orderBy("acl_pos", "ace_pos")
    lines = found.filter("line is not null").select(
        "path", (F.row_number().over(place) - 1).alias("pos"), "line"
    )
    in_order = F.array_sort(F.collect_list(F.when(
        F.col("line").isNotNull(), F.struct(order.alias("at"), "line")
    )))
    files = found.groupBy("path").agg(
        F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("text")
    )
    return _write_embedded(spark, files, lines, encoder, target, pool)


def _write_embedded(spark, files, lines, encoder, target, pool) -> DataFrame:
    bank = embed(files, lines, encoder, "path", ["pos"], pool)
    place = [c for c in ("path", "pos") if c in bank.columns]
    bank = bank.withColumns(
        {"device": file_stem(F.col("path")), "row_id": F.xxhash64(*place)}
    ).withColumnsRenamed({"line": "text"})
    write_bank(bank, target)
    return spark.read.parquet(target)


def whiten_bank(
    spark: SparkSession,
    reference: str | WhiteningModel,
    source: str,
    target: str,
    metadata: str | None = None,
    k: int = DEFAULT_K,
) -> WhiteningModel:
    """Whiten the bank at ``source``; pass the model on to whiten further banks."""
    model = reference
    if isinstance(reference, str):
        model = fit_whitening(read_bank(spark, reference))
    bank = read_bank(spark, source)
    write_bank(model.transform(bank, k), target)
    if metadata:
        rows = bank.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        row = spark.createDataFrame([model.metadata(rows, k)])
        names = [F.lit(x).alias(n) for n, x in (("input", source), ("output", target))]
        write_report(row.select("*", *names), metadata)
    return model
