"""Clean a corpus and pack it: quality rules, near-dedup, decontamination, pseudonyms, packing.

Each stage takes the rows that the stage before kept, as they were written to Parquet and read
again. All but the last return the columns of ``documents``.

* Rows of null or empty text, having fewer than 50 words, go with the quality rules.
* A null id is an id like others; it only comes last where one row of a group is chosen.
* An empty table passes all stages; other columns pass unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import Scratch, table
from spoor.llm.decontaminate import drop_leaks
from spoor.llm.fuzzy import keep_one
from spoor.llm.packing import pack
from spoor.llm.pseudonyms import pseudonymise
from spoor.llm.quality import keep_good
from spoor.llm.queries import secret_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses are replaced; the length column follows."""
    out = pseudonymise(docs, key=secret_key(spark))
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

#: Hashes, a code and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = scratch.put(docs)
    return docs
