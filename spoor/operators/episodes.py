"""Evaluation episodes: some behaviour of a device is taken out of every profile.

A ``strict-unseen`` episode samples rules of a device, uses them as the query and
removes their texts everywhere. A ``partial`` episode keeps the first few.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.operators.dense import TILE_ROWS, VECTOR_METHODS, dense_ranks, dense_topk
from spoor.operators.masked import SET_METHODS, masked_ranks, masked_topk
from spoor.operators.profiles import first_rows
from spoor.session import stored

METHODS = (*SET_METHODS, *VECTOR_METHODS)
STRICT, PARTIAL = "strict-unseen", "partial"
# Defaults of the demonstration runs.
SEED = 1729
EPISODES_PER_DEVICE = 5
QUERY_SIZE = 3
EXACT_COUNT = 2
UNSEEN_COUNT = 2
EXAMPLES = 3


def sample_size(mode: str, query_size: int, exact_count: int, unseen_count: int) -> tuple[int, int]:
    """How many rules of a sample stay in the references, and how many are taken out."""
    sizes = {STRICT: (0, query_size), PARTIAL: (exact_count, unseen_count)}
    if mode not in sizes:
        raise ValueError(f"unknown mode: {mode}")
    if mode == PARTIAL and sum(sizes[mode]) <= 0:
        raise ValueError("partial mode needs at least one exact or unseen rule")
    return sizes[mode]


def sample_episodes(
    bank: DataFrame,
    mode: str = STRICT,
    episodes_per_device: int = EPISODES_PER_DEVICE,
    query_size: int = QUERY_SIZE,
    exact_count: int = EXACT_COUNT,
    unseen_count: int = UNSEEN_COUNT,
    seed: int = SEED,
) -> DataFrame:
    """``(episode_id, mode, expected, pos, role, text, row_id)``, one row per query rule.

    ``bank (device, row_id, text, ...)``. The sample is the head of a hash order of
    the device's distinct texts, a different order per episode. A device needs more
    distinct texts than the sample holds, so one row more is taken and then checked.
    """
    kept, removed = sample_size(mode, query_size, exact_count, unseen_count)
    size = kept + removed
    if episodes_per_device < 1:
        raise ValueError("episodes_per_device must be at least 1")
    numbered = first_rows(bank).withColumn(
        "episode", F.explode(F.sequence(F.lit(0), F.lit(episodes_per_device - 1)))
    )
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "device", F.col("episode").cast("string"), "text"))
    order = Window.partitionBy("device", "episode").orderBy("draw", "text")
    head = (
        numbered.withColumn("draw", draw)
        # Numbered from 1 and filtered on that: then a group limit runs below the shuffle.
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= size + 1)
        .withColumn("pos", F.col("place") - 1)
    )
    taken = F.count(F.lit(1)).over(Window.partitionBy("device", "episode"))
    return (
        head.withColumn("taken", taken)
        .filter((F.col("taken") > size) & (F.col("pos") < size))
        .select(
            F.format_string(f"%s/{mode}/%03d", "device", "episode").alias("episode_id"),
            F.lit(mode).alias("mode"),
            F.col("device").alias("expected"),
            "pos",
            F.when(F.col("pos") < kept, "exact").otherwise("unseen").alias("role"),
            "text",
            "row_id",
        )
    )


def masked_counts(bank: DataFrame, episodes: DataFrame) -> DataFrame:
    """``(episode_id, rows_removed, rows_left)`` of the masked bank, for every episode.

    The rows of a text are counted first, so that no pair of an episode and a
    removed row is built.
    """
    per_text = bank.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    removed = (
        episodes.filter("role = 'unseen'")
        .join(per_text, "text")
        .groupBy("episode_id")
        .agg(F.sum("n").alias("rows_removed"))
    )
    total = bank.count()
    gone = F.coalesce("rows_removed", F.lit(0).cast("long"))
    every = episodes.select("episode_id").distinct().join(removed, "episode_id", "left")
    return every.select(
        "episode_id", gone.alias("rows_removed"), (F.lit(total) - gone).alias("rows_left")
    )


def masked_own_profile(bank: DataFrame, episodes: DataFrame) -> DataFrame:
    """``(episode_id, text)``: texts the expected device keeps after masking."""
    texts = bank.select(F.col("device").alias("expected"), "text").distinct()
    keys = episodes.select("episode_id", "expected").distinct()
    gone = episodes.filter("role = 'unseen'").select("episode_id", "text")
    return keys.join(texts, "expected").select("episode_id", "text").join(
        gone, ["episode_id", "text"], "left_anti"
    )


def episode_queries(bank: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes with the vectors of their rules, as input of the dense scorers."""
    vectors = bank.select(F.col("device").alias("expected"), "text", "row_id", "embedding")
    return episodes.join(vectors, ["expected", "text", "row_id"]).select(
        F.col("episode_id").alias("query"),
        "expected",
        "row_id",
        "embedding",
        "text",
        (F.col("role") == "unseen").alias("unseen"),
    )


def episode_topk(
    bank: DataFrame,
    episodes: DataFrame,
    k: int = 5,
    methods: Sequence[str] = METHODS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(query, method, device, score, rank)``; scores to six decimals."""
    sets, vectors = _by_kind(methods)
    episodes, found = stored(episodes), []
    if sets:
        found.append(masked_topk(_sets(episodes), bank, sets, k))
    if vectors:
        found.append(dense_topk(episode_queries(bank, episodes), bank, vectors, k, tile_rows))
    return reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6))


def episode_ranks(
    bank: DataFrame,
    episodes: DataFrame,
    methods: Sequence[str] = METHODS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(query, expected, method, score, rank)`` of the expected device."""
    sets, vectors = _by_kind(methods)
    episodes, found = stored(episodes), []
    if sets:
        found.append(masked_ranks(_sets(episodes), bank, sets))
    if vectors:
        found.append(dense_ranks(episode_queries(bank, episodes), bank, vectors, tile_rows))
    return reduce(DataFrame.unionByName, found)


def _by_kind(methods: Sequence[str]) -> tuple[list[str], list[str]]:
    unknown = set(methods) - set(METHODS)
    if unknown or not methods:
        raise ValueError(f"methods must be some of {METHODS}")
    return [m for m in methods if m in SET_METHODS], [m for m in methods if m in VECTOR_METHODS]


def _sets(episodes: DataFrame) -> DataFrame:
    """Episodes as input of the masked set scores."""
    return episodes.select(
        F.col("episode_id").alias("query"), "expected", "text",
        (F.col("role") == "unseen").alias("unseen"),
    )


def episode_counts(episodes: DataFrame) -> DataFrame:
    """``(episode_count, device_count)``."""
    return episodes.select("episode_id", "expected").distinct().agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.count_distinct("expected").alias("device_count"),
    )


def examples(episodes: DataFrame, tops: DataFrame, ranks: DataFrame, n: int = EXAMPLES):
    """The first ``n`` episodes, their rules by role and their results per method."""
    first = episodes.select("episode_id").distinct().orderBy("episode_id").limit(n)
    by_pos = F.array_sort(F.collect_list(F.struct("pos", "role", "text")))
    rules = (
        episodes.join(F.broadcast(first), "episode_id")
        .groupBy("episode_id", "mode", F.col("expected").alias("expected_device"))
        .agg(by_pos.alias("rules"))
    )

    def texts(role=None):
        kept = F.col("rules") if role is None else F.filter("rules", lambda r: r["role"] == role)
        return F.transform(kept, lambda r: r["text"])

    head = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "device", "score"))),
        lambda r: F.struct(r["device"].alias("device"), r["score"].alias("score")),
    )
    chosen = F.broadcast(first.withColumnRenamed("episode_id", "query"))
    top = tops.join(chosen, "query").groupBy("query", "method").agg(head.alias("top"))
    scores = (
        ranks.join(chosen, "query")
        .select("query", "method", "rank")
        .join(top, ["query", "method"])
        .groupBy(F.col("query").alias("episode_id"))
        .agg(F.map_from_entries(
            F.collect_list(F.struct("method", F.struct("rank", "top")))
        ).alias("scores"))
    )
    return rules.join(scores, "episode_id").select(
        "episode_id",
        "mode",
        "expected_device",
        texts().alias("query_aces"),
        texts("exact").alias("exact_aces"),
        texts("unseen").alias("unseen_aces"),
        "scores",
    )
