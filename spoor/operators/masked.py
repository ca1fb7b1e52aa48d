"""Set scores of queries that take some of their texts out of every reference.

The references are stored once, unmasked. What a query changes is counted by joins: a text that
stays is a hit in every device that holds it, a text taken out makes such a device one smaller.
Only devices with a hit are looked at; all others score zero and follow in name order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.operators.overlap import SCORERS, References, join_lines
from spoor.operators.ranking import is_ahead, name_positions, top_k
from spoor.session import stored

SET_METHODS = tuple(SCORERS)


class _Masked:
    """``queries (query, expected, text, unseen)`` against ``bank (device, text)``."""

    def __init__(self, queries: DataFrame, bank: DataFrame):
        self.ready = References(bank.select("device", F.col("text").alias("line")))
        self.devices = self.ready.profiles
        texts = queries.filter("text is not null").groupBy("query", F.col("text").alias("line"))
        lines = texts.agg(F.max("unseen").alias("unseen"))
        sizes = lines.groupBy("query").agg(F.count(F.lit(1)).alias("n_q"))
        self.queries = (
            queries.select("query", "expected").distinct().join(sizes, "query", "left")
            .withColumn("n_q", F.coalesce("n_q", F.lit(0)))
        )
        kept = lines.filter(~F.col("unseen")).select("query", "line")
        hits = join_lines(kept, self.ready).groupBy("query", "device").agg(
            F.count(F.lit(1)).alias("hits")
        )
        # Texts taken out count only where something else hits.
        gone = lines.filter("unseen").select("query", "line")
        lost = (
            hits.join(gone, "query").join(self.ready.rules, ["device", "line"])
            .groupBy("query", "device").agg(F.count(F.lit(1)).alias("lost"))
        )
        self.pairs = stored(
            hits.join(lost, ["query", "device"], "left").join(self.devices, "device")
            .join(self.queries.select("query", "n_q"), "query")
            .select("query", "device", "hits", "n_q",
                    (F.col("n_r") - F.coalesce("lost", F.lit(0))).alias("n_r"))
        )


def _scores(methods: Sequence[str], name: str = "score") -> Column:
    """One row per method from ``hits, n_q, n_r``."""
    found = [
        F.struct(F.lit(m).alias("method"),
                 SCORERS[m](F.col("hits"), F.col("n_q"), F.col("n_r")).alias(name))
        for m in methods
    ]
    return F.explode(F.array(*found)).alias("found")


def masked_topk(
    queries: DataFrame, bank: DataFrame, methods: Sequence[str] = SET_METHODS, k: int = 5
) -> DataFrame:
    """``(query, method, device, score, rank)`` for the k best devices per query and method."""
    masked = _Masked(queries, bank)
    hit = masked.pairs.select("query", "device", _scores(methods)).select("query", "device", "found.*")
    best = top_k(hit, ["query", "method"], k, F.col("score")).drop("rank")
    # k names at most.
    first = [row["device"] for row in masked.devices.orderBy("device").limit(k).collect()]
    none = masked.queries.select(
        "query", F.explode(F.array(*[F.lit(n) for n in first]).cast("array<string>")).alias("device"),
    ).select("query", "device", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    every = best.unionByName(none.withColumn("score", F.lit(0.0)))
    scored = every.groupBy("query", "method", "device").agg(F.max("score").alias("score"))
    return top_k(scored, ["query", "method"], k, F.col("score"))


def masked_ranks(
    queries: DataFrame, bank: DataFrame, methods: Sequence[str] = SET_METHODS
) -> DataFrame:
    """``(query, expected, method, score, rank)`` of the expected device, from 1.

    Score and rank are NULL for an unknown device. Devices without a hit are counted by the
    place of their name, not listed.
    """
    masked = _Masked(queries, bank)
    places = name_positions(masked.devices, "device").select(
        F.col("device").alias("expected"), "position"
    )
    own_pair = masked.pairs.select("query", F.col("device").alias("expected"), "hits", "n_r")
    own = (
        masked.queries.join(places, "expected", "left")
        .join(own_pair, ["query", "expected"], "left")
        .withColumns({"hits": F.coalesce("hits", F.lit(0)), "n_r": F.coalesce("n_r", F.lit(0))})
        .select("query", "expected", "position", _scores(methods, "own"))
        .select("query", "expected", "position", "found.method",
                F.when(F.col("position").isNotNull(), F.col("found.own")).alias("own"))
    )
    own = stored(own)
    hit = masked.pairs.select("query", "device", _scores(methods)).select("query", "device", "found.*")
    # A hit scores more than zero, so behind zero only names without a hit are left to count.
    ahead = is_ahead(F.col("score"), F.col("device"), F.col("own"), F.col("expected")).cast("int")
    named = (F.col("device") < F.col("expected")).cast("int")
    change = F.when(F.col("own") == 0, ahead - named).otherwise(ahead)
    counted = (
        hit.join(own.filter("own is not null"), ["query", "method"])
        .groupBy("query", "method").agg(F.sum(change).alias("ahead"))
    )
    before = F.when(F.col("own") == 0, F.col("position")).otherwise(0)
    rank = (F.coalesce("ahead", F.lit(0)) + before + 1).cast("long")
    return own.join(counted, ["query", "method"], "left").select(
        "query", "expected", "method", F.col("own").alias("score"),
        F.when(F.col("own").isNotNull(), rank).alias("rank"),
    )
