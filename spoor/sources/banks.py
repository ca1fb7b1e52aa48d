"""Vector banks: one row per vector, label and text beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions.labels import clean_label
from spoor.sources.guards import first_column, require_columns, require_rows

# Column names accepted for vectors and labels, in order of preference.
VECTOR_COLUMNS = ("embedding", "embeddings", "original_embeddings")
LABEL_COLUMNS = ("label", "device", "devices", "name", "names")
TEXT_COLUMNS = ("text", "ace_text", "ace_texts")

# Fields of a whole-profile embedding file.
WHOLE_SCHEMA = T.StructType(
    [
        T.StructField("device", T.StringType()),
        T.StructField("encoder", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def resolve_bank(df: DataFrame, with_texts: bool = False) -> DataFrame:
    """Rename the vector, label and text columns to ``embedding, label, text``.

    All other columns pass through. ``clean_label`` is added. ``with_texts`` makes
    the text column required.
    """
    require_columns(df, "row_id")
    out = df.withColumnRenamed(first_column(df, *VECTOR_COLUMNS), "embedding")
    out = out.withColumnRenamed(first_column(df, *LABEL_COLUMNS), "label")
    if with_texts or any(name in df.columns for name in TEXT_COLUMNS):
        out = out.withColumnRenamed(first_column(df, *TEXT_COLUMNS), "text")
    return out.withColumn("clean_label", clean_label(F.col("label").cast("string")))


def read_bank(spark: SparkSession, path: str, with_texts: bool = False) -> DataFrame:
    bank = resolve_bank(spark.read.parquet(path), with_texts)
    return require_rows(bank, f"no vectors in {path}")


def reference_bank(bank: DataFrame) -> DataFrame:
    """``(device, row_id, embedding[, text])``; variants merge under the cleaned label."""
    kept = [c for c in ("row_id", "embedding", "text") if c in bank.columns]
    return bank.select(F.col("clean_label").alias("device"), *kept)


def query_bank(bank: DataFrame) -> DataFrame:
    """``(query, expected, row_id, embedding)``; queries keep their raw label."""
    return bank.select(
        F.col("label").cast("string").alias("query"),
        F.col("clean_label").alias("expected"),
        "row_id",
        "embedding",
    )


def read_whole_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-profile vectors, one JSON file each; a wrong length fails the job."""
    files = (
        spark.read.schema(WHOLE_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
    )
    n = F.size("embedding")
    checked = F.when(n == F.col("embedding_dim"), F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit("wrong embedding length for "), F.col("device")))
    )
    return files.withColumn("embedding", checked)
