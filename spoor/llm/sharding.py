"""Shards of nearly equal bytes by histogram sort.

Rows are sorted by a hash of their text, then by a hash of their id and row, so equal texts
stand together. Splitters are found before any row moves: in each round the exact bytes below many
candidate boundaries are counted in one pass over the keys, and only the interval that holds a
splitter's target is probed again, until each splitter is within the tolerance. A boundary
between two texts is preferred; a group of equal texts is cut, by its ids, only where no such
boundary is near enough. Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import Scratch

SHARDS = 24
#: Largest distance of a splitter from its target, as a share of a shard's bytes.
TOLERANCE = 0.005
#: Boundaries probed in a round, over all intervals that are open.
PROBES = 4096
#: Hashes have 62 bits, so that differences stay within a long.
_SPACE = 1 << 62


@dataclass
class _Open:
    """An interval of keys that holds the target of a splitter, and the bytes below it."""

    low: int
    high: int
    below: int
    text: int | None = None  # the text hash, if the interval is one of ids within a text


def _hash(column: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 2)


def _probe(keys: DataFrame, intervals: list[_Open]) -> list[list[tuple[int, int, int]]]:
    """For each interval its cells that hold rows: least key, greatest key, exact bytes."""
    probes = max(16, PROBES // len(intervals))
    place = F.lit(None).cast("struct<interval:int,value:bigint,step:bigint>")
    for n, i in enumerate(intervals):
        value = F.col("by_text") if i.text is None else F.col("by_id")
        inside = (value >= i.low) & (value < i.high)
        if i.text is not None:
            inside &= F.col("by_text") == i.text
        step = -(-(i.high - i.low) // probes)
        place = F.when(inside, F.struct(
            F.lit(n).alias("interval"), value.alias("value"), F.lit(step).cast("long").alias("step")
        )).otherwise(place)
    rows = (
        keys.select(place.alias("place"), "size").filter("place is not null")
        .select("place.*", "size")
        .groupBy("interval", F.expr("value div step").alias("cell"))
        .agg(F.sum("size").alias("bytes"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    found: list[list[tuple[int, int, int]]] = [[] for _ in intervals]
    for r in sorted(rows, key=lambda r: r["low"]):
        found[r["interval"]].append((r["low"], r["high"], r["bytes"]))
    return found


def find_splitters(
    keys: DataFrame, total: int, shards: int, tolerance: float = TOLERANCE
) -> list[tuple[int, int]]:
    """Keys (text hash, id hash) that start the second and each later shard."""
    done: dict[int, tuple[int, int]] = {}
    allowed = tolerance * total / shards
    waiting = {n: _Open(0, _SPACE, 0) for n in range(1, shards)} if total else {}
    while waiting:
        intervals: list[_Open] = []
        for i in waiting.values():
            if i not in intervals:
                intervals.append(i)
        found = _probe(keys, intervals)
        for n, i in list(waiting.items()):
            target = total * n / shards
            below, best, holds = i.below, None, None
            # Boundaries stand right above the last key of a cell; the first is the low end.
            for low, high, size in [(i.low, i.low - 1, 0), *found[intervals.index(i)]]:
                if holds is None and below + size > target:
                    holds = _Open(low, high + 1, below, i.text)
                below += size
                if best is None or abs(below - target) < abs(best[0] - target):
                    best = (below, high + 1)
            if abs(best[0] - target) <= allowed or holds is None:
                done[n] = (best[1], 0) if i.text is None else (i.text, best[1])
            elif holds.high - holds.low > 1:
                waiting[n] = holds
                continue
            elif i.text is None:
                # One text holds the target, and neither of its ends is near enough.
                waiting[n] = _Open(0, _SPACE, holds.below, holds.low)
                continue
            else:
                done[n] = (i.text, best[1])
            del waiting[n]
    return [done[n] for n in sorted(done)]


def shard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``key, size, text_crc32, shard, slot``, one row per document; slots follow the sort.

    A null text has no bytes, and 8 like each row. Null ids and repeated rows are rows like
    others, and rows with both text and id in common are parted where a splitter falls among them.
    Shards may be empty in a small table; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    keys = scratch.put(docs.select(
        key,
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        _hash(body).alias("by_text"),
        # The row's number, written with it, tells rows with one text and one id apart.
        _hash(F.struct(F.col(key), F.monotonically_increasing_id())).alias("by_id"),
    ))
    total = keys.agg(F.sum("size")).first()[0] or 0
    number = F.lit(0)
    for by_text, by_id in find_splitters(keys, total, shards, tolerance):
        after = (F.col("by_text") > by_text) | (
            (F.col("by_text") == by_text) & (F.col("by_id") >= by_id)
        )
        number = number + after.cast("int")
    # The one exchange: sorted ranges, each within one shard or over a few.
    order = ["shard", "by_text", "by_id"]
    sorted_rows = scratch.put(
        keys.withColumn("shard", number)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, key)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
        .drop("by_text", "by_id")
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        sorted_rows.groupBy("part", "shard")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
        .select("part", "shard", (
            F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
        ).alias("shift"))
    )
    return sorted_rows.join(starts, ["part", "shard"]).select(
        key, "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot")
    )
