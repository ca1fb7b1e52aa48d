"""Connected components of a graph given by its links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import Scratch


def _contract(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (hi, lo) with hi > lo.

    Each node ties its larger (``large``) or smaller neighbours to its least neighbour. Only the
    least neighbour of a node is gathered, so a hub's links are combined before the shuffle,
    and the join that hands it out can split a hub's rows.
    """
    ways = links.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    if large:
        ways = ways.unionByName(links.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = ways.groupBy("node").agg(F.min("other").alias("least")).withColumn(
        "least", F.least("least", "node")
    )
    met = ways.join(least, "node")
    if large:
        out = met.filter("other > node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    else:
        out = met.filter("other > least").select(
            F.col("other").alias("hi"), F.col("least").alias("lo")
        ).unionByName(least.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
    return out.filter("hi > lo").distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of a link, the label being the least node it reaches.

    ``links`` has the long columns ``a`` and ``b``, in any order, loops and repeats allowed.
    Each round is written to the shared folder. It ends when a round changes nothing, after a
    number of rounds that grows with the logarithm of the longest path.
    """
    now = scratch.put(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )

    def state(df):
        return df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum"),
        ).first()

    mark = state(now)
    for _ in range(rounds if mark["n"] else 0):
        half = scratch.put(_contract(now, large=True))
        scratch.drop(now)
        now = scratch.put(_contract(half, large=False))
        scratch.drop(half)
        before, mark = mark, state(now)
        if before == mark:
            break
    else:
        if mark["n"]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)
