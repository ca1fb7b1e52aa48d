"""Runtime flow traces: one CSV per device, one timed rule per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a trace, in file order.
FLOW_SCHEMA = T.StructType(
    [
        T.StructField("flow_idx", T.IntegerType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("device_ip", T.StringType()),
        T.StructField("remote_ip", T.StringType()),
        T.StructField("ip_protocol", T.IntegerType()),
        T.StructField("device_port", T.IntegerType()),
        T.StructField("remote_port", T.IntegerType()),
        T.StructField("direction", T.StringType()),
        T.StructField("device_initiated", T.BooleanType()),
        T.StructField("tcp_initiated_by_device", T.BooleanType()),
        T.StructField("runtime_ace", T.StringType()),
    ]
)
# Fixed value: end of a trace's file name, after the name and address of the device.
TRACE_SUFFIX = "_runtime_aces.csv"


def _with_trace(df: DataFrame) -> DataFrame:
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return df.withColumn("trace", F.regexp_replace(file, TRACE_SUFFIX + "$", ""))


def _options(reader):
    return (
        reader.schema(FLOW_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*" + TRACE_SUFFIX)
    )


def read_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The traces below ``folder``, with the file's ``trace`` name."""
    return _with_trace(_options(spark.read).csv(folder))


def stream_flows(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """As ``read_flows``, following files that appear in ``folder``."""
    reader = _options(spark.readStream).option("maxFilesPerTrigger", files_per_trigger)
    return _with_trace(reader.csv(folder))


def flow_rules(flows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``(entity, ts, line)``; ``aliases`` maps trace names to reference labels."""
    entity = F.col("trace")
    if aliases:
        pairs = [F.lit(x) for pair in aliases.items() for x in pair]
        entity = F.coalesce(F.try_element_at(F.create_map(*pairs), entity), entity)
    return flows.select(
        entity.alias("entity"), F.col("first_seen").alias("ts"), F.col("runtime_ace").alias("line")
    ).filter(F.col("line").isNotNull())
