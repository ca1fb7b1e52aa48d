"""What several of the operators share: tables, words, tables in the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spoor.session import shared_dir, ship_package

#: White space between words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns on the way that no column of ``df`` has, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any(f"{mark}{name}" in taken for name in names):
        mark += "_"
    return [f"{mark}{name}" for name in names]


def over_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table],
    schema: str | StructType,
) -> DataFrame:
    """Map Arrow batches; Spark bounds a batch by rows and by bytes."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


class Scratch:
    """Tables of one job in the folder that all executors share.

    A written table is the cut of a lineage: a lost executor costs a re-read, never a
    re-run of what came before. ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/spoor-llm-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, **options: int) -> DataFrame:
        """``options`` are those of the Parquet writer, such as ``parquet.block.size``."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_rank(df: DataFrame, group: str, tie: list, rows: int, name: str) -> DataFrame:
    """Gapless ranks from 0 within ``group``, however many rows a group has.

    Rows of a group are dealt over salts; a rank is the row's place within its salt plus the
    rows of the salts before. The order is arbitrary but fixed by the columns in ``tie``.
    """
    salts = max(256, rows // 20_000)
    df = df.withColumn("__salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))

    own = Window.partitionBy(group, "__salt").orderBy(*tie)
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(group, "__salt")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(group, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    placed = df.withColumn("__own", F.row_number().over(own) - 1)
    return placed.join(starts, [group, "__salt"]).withColumn(
        name, F.col("__start") + F.col("__own")
    ).drop("__salt", "__own", "__start")
