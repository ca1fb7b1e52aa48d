"""Rank reference profiles for query profiles and report the outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators.dense import dense_ranks, dense_topk, pooled
from spoor.operators.overlap import SCORERS, overlap_ranks, overlap_topk, prepared
from spoor.operators.ranking import retrieval_metrics
from spoor.session import stored
from spoor.sources.banks import query_bank, read_bank, reference_bank
from spoor.sources.profiles import (
    line_query_sets,
    line_reference_sets,
    read_lines,
    read_query_sets,
    read_reference_sets,
)
from spoor.sources.sinks import write_report

VECTOR_SCORERS = ("asymmetric_maxsim", "mean_pool")


@dataclass(frozen=True)
class Retrieval:
    """Stored results: the report and the metrics read them again."""

    top: DataFrame  # (query, device, score[, hit_count], rank)
    ranks: DataFrame  # (query, expected, score, rank)
    metrics: DataFrame  # one row

    def report(self) -> DataFrame:
        """``(query, expected, rank, top)``; ``top`` holds at most k devices."""
        fields = [c for c in ("device", "score", "hit_count") if c in self.top.columns]
        best = F.array_sort(F.collect_list(F.struct("rank", *fields)))
        entry = F.transform(best, lambda r: F.struct(*[r[f].alias(f) for f in fields]))
        tops = self.top.groupBy("query").agg(entry.alias("top"))
        return self.ranks.join(tops, "query", "left").select("query", "expected", "rank", "top")

    def write(self, path: str) -> None:
        write_report(self.metrics, f"{path}/metrics")
        write_report(self.report(), f"{path}/results")


def _metrics(ranks: DataFrame, method: str, k: int) -> DataFrame:
    row = retrieval_metrics(ranks, k=k)
    return row.select(
        F.lit(method).alias("method"), "queries",
        F.col("top1").alias("top1_accuracy"), F.col("topk").alias(f"top{k}_accuracy"), "mrr",
    )


def rank_sets(
    queries: DataFrame, references: DataFrame, method: str = "jaccard", k: int = 5, **options
) -> Retrieval:
    """``queries (query, expected, line)`` against ``references (device, line)``."""
    if method not in SCORERS:
        raise ValueError(f"method must be one of {sorted(SCORERS)}")
    expected = queries.select("query", "expected").distinct()
    references = prepared(references)
    top = stored(overlap_topk(queries, references, method, k, **options))
    ranks = stored(overlap_ranks(queries, references, expected, method, **options))
    return Retrieval(top, ranks, _metrics(ranks, method, k))


def rank_vectors(
    queries: DataFrame,
    references: DataFrame,
    method: str = "asymmetric_maxsim",
    k: int = 5,
    **options,
) -> Retrieval:
    """Banks as made by ``query_bank`` and ``reference_bank``."""
    if method not in VECTOR_SCORERS:
        raise ValueError(f"method must be one of {VECTOR_SCORERS}")
    if method == "mean_pool":
        queries, references = pooled(queries, references)
    top = stored(dense_topk(queries, references, k=k, **options).drop("method"))
    ranks = stored(dense_ranks(queries, references, **options).drop("method"))
    return Retrieval(top, ranks, _metrics(ranks, method, k))


def rank_text_folders(
    spark: SparkSession, reference_dir: str, query_dir: str, method: str = "jaccard", k: int = 5
) -> Retrieval:
    """Rule texts directly in ``reference_dir`` against all below ``query_dir``."""
    return rank_sets(
        read_query_sets(spark, query_dir), read_reference_sets(spark, reference_dir), method, k
    )


def rank_lines(
    spark: SparkSession, reference_path: str, query_path: str, method: str = "jaccard", k: int = 5
) -> Retrieval:
    """Compacted profiles against each other, as ``write_lines`` left them."""
    return rank_sets(
        line_query_sets(read_lines(spark, query_path)),
        line_reference_sets(read_lines(spark, reference_path)),
        method,
        k,
    )


def rank_banks(
    spark: SparkSession,
    reference_path: str,
    query_path: str,
    method: str = "asymmetric_maxsim",
    k: int = 5,
) -> Retrieval:
    return rank_vectors(
        query_bank(read_bank(spark, query_path)),
        reference_bank(read_bank(spark, reference_path)),
        method,
        k,
    )
