"""Total order per query, top-k, order statistics of names, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.session import stored


def order_score(score: Column) -> Column:
    """Scores that differ by summation order only must tie, so that names decide."""
    return F.round(score, 9)


def is_ahead(score: Column, name: Column, than_score: Column, than_name: Column) -> Column:
    """Score descending, then name ascending."""
    return (score > than_score) | ((score == than_score) & (name < than_name))


def top_k(scored: DataFrame, keys: list[str], k: int, score: Column | None = None) -> DataFrame:
    """The k best rows per key with a 1-based ``rank``.

    The rank filter becomes a group limit below the shuffle, so that a key with
    very many rows ships k rows per task.
    """
    by = order_score(F.col("score")) if score is None else score
    order = Window.partitionBy(*keys).orderBy(by.desc(), "device")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def name_positions(names: DataFrame, column: str) -> DataFrame:
    """``(column, position)``: how many names sort before this one.

    Names are sorted in ranges, one per task. A position is the place in the range
    plus the names of the ranges before, of which there are as many as tasks.
    """
    ranged = stored(
        names.select(column)
        .repartitionByRange(column)
        .sortWithinPartitions(column)
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
        .select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    return ranged.join(starts, "part").select(
        column, (F.col("row") + F.col("shift")).alias("position")
    )


def retrieval_metrics(ranks: DataFrame, *by: str, k: int = 5) -> DataFrame:
    """Share of queries with the expected entity first or in the top k, and MRR.

    The shares count every query; MRR and mean rank only those that have a rank.
    """
    rank = F.col("rank")
    grouped = ranks.groupBy(*by) if by else ranks.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.avg(F.coalesce((rank == 1).cast("int"), F.lit(0))), F.lit(0.0)).alias("top1"),
        F.coalesce(F.avg(F.coalesce((rank <= k).cast("int"), F.lit(0))), F.lit(0.0)).alias("topk"),
        F.coalesce(F.avg(F.lit(1.0) / rank), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(rank), F.lit(0.0)).alias("mean_rank"),
    )
