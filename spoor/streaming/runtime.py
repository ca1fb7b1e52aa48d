"""Match runtime behaviour against reference profiles, window by window.

Batch and stream build the same window profiles. A stream holds only the distinct
rules of open windows as state, and hands each window on once, when the watermark
has passed it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoor.operators.dense import dense_topk
from spoor.operators.encode import Encoder, encode_distinct
from spoor.operators.overlap import overlap_topk, prepared
from spoor.session import discard_stored, measured, stored
from spoor.streaming.late import window_rules_and_late


WINDOW_KEY = "micros bigint, entity string"
#: A row of the commit table stands for one whole micro-batch.
COMMIT = "batch long, attempt string, closed_rules long, late_rules long"
LATE = "window_start timestamp, entity string, line string, flows long, batch long, attempt string"


def _window_rules(flows: DataFrame, width: str) -> DataFrame:
    """Distinct ``(window_start, entity, line)``, grouped so that it also runs on streams."""
    return (
        flows.groupBy(F.window("ts", width).alias("w"), "entity", "line")
        .agg(F.count(F.lit(1)).alias("flows"))
        .select(F.col("w.start").alias("window_start"), "entity", "line")
    )


def _window_key() -> Column:
    """The window and its entity as one text: microseconds, so no time zone can blur them."""
    return F.to_json(F.struct(F.unix_micros("window_start").alias("micros"), "entity"))


def _by_window(found: DataFrame) -> DataFrame:
    key = F.from_json("query", WINDOW_KEY)
    rest = [c for c in found.columns if c not in ("query", "method")]
    return found.select(
        F.timestamp_micros(key["micros"]).alias("window_start"), key["entity"].alias("entity"), *rest
    )


def _ranked(rules: DataFrame, references, method: str, k: int) -> DataFrame:
    queries = rules.select(_window_key().alias("query"), "line")
    found = overlap_topk(queries, references, method, k)
    return _by_window(found).select(
        "window_start", "entity", "device", "score", "hit_count", "rank"
    )


def _ranked_vectors(rules: DataFrame, bank: DataFrame, encoder: Encoder, k: int) -> DataFrame:
    queries = rules.select(_window_key().alias("query"), "line")
    vectors = encode_distinct(queries, encoder, "line").select(
        "query", F.lit(None).cast("string").alias("expected"),
        F.xxhash64("query", "line").alias("row_id"), "embedding",
    )
    # The search reads them several times, and the flows behind them are dear to read.
    return _by_window(dense_topk(stored(vectors), bank, ("maxsim",), k))


def match_windows(
    flows: DataFrame, references: DataFrame, width: str, method: str = "jaccard", k: int = 5
) -> DataFrame:
    """``(window_start, entity, device, score, hit_count, rank)`` of a batch table.

    ``flows (entity, ts, line)``, ``references (device, line)``.
    """
    return _ranked(_window_rules(flows, width), references, method, k)


def match_windows_by_meaning(
    flows: DataFrame, bank: DataFrame, encoder: Encoder, width: str, k: int = 5
) -> DataFrame:
    """``(window_start, entity, device, score, rank)`` by MaxSim of the rules' vectors.

    ``bank (device, row_id, embedding)`` holds the reference vectors of the same encoder.
    """
    return _ranked_vectors(_window_rules(flows, width), bank, encoder, k)


def match_stream(
    flows: DataFrame,
    references: DataFrame,
    width: str,
    delay: str,
    target: str,
    checkpoint: str,
    method: str = "jaccard",
    k: int = 5,
    trigger: dict | None = None,
    late: bool = False,
) -> StreamingQuery:
    """The same as ``match_windows`` for closed windows of a stream, as parquet in ``target``.

    Read the results with ``read_matches``: it gives the rows of committed micro-batches only,
    each once, also while the stream runs or after a batch was repeated. The references are
    made ready once, when the stream starts. With ``late``, flows behind the watermark are kept
    for ``read_late`` instead of dropped.
    """
    with discard_stored(flows.sparkSession) as written:
        ready = prepared(references).leading(k)
        # The names kept were written last; what they come from is not read again.
        del written[-1:]
    return _started(
        flows, width, delay, target, checkpoint, trigger, late,
        lambda rules: _ranked(rules, ready, method, k),
    )


def match_stream_by_meaning(
    flows: DataFrame,
    bank: DataFrame,
    encoder: Encoder,
    width: str,
    delay: str,
    target: str,
    checkpoint: str,
    k: int = 5,
    trigger: dict | None = None,
    late: bool = False,
) -> StreamingQuery:
    """The same as ``match_windows_by_meaning`` for closed windows of a stream."""
    ready = stored(bank)
    return _started(
        flows, width, delay, target, checkpoint, trigger, late,
        lambda rules: _ranked_vectors(rules, ready, encoder, k),
    )


def _started(flows, width, delay, target, checkpoint, trigger, late, rank) -> StreamingQuery:
    if late:
        rules = window_rules_and_late(flows, width, delay)
    else:
        rules = _window_rules(flows.withWatermark("ts", delay), width)
    return (
        rules.writeStream.outputMode("append")
        .foreachBatch(_writer(rank, target))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def _writer(
    rank: Callable[[DataFrame], DataFrame], target: str
) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch into folders of its own, and commits it with one row at the end.

    A batch that was cut off or is repeated leaves or adds a folder under another attempt; its
    rows are equal, and readers take one committed attempt of each batch.
    """

    def write(rules: DataFrame, batch: int) -> None:
        spark = rules.sparkSession
        attempt = f"a-{uuid.uuid4().hex}"
        folder = f"batch={batch}/attempt={attempt}"
        if "late" not in rules.columns:
            rules = rules.withColumns({"flows": F.lit(None).cast("long"), "late": F.lit(False)})
        with discard_stored(spark):
            held, seen = measured(
                rules, closed_rules=F.count_if(~F.col("late")), late_rules=F.count_if("late")
            )
            if seen["closed_rules"]:
                closed = held.filter("not late").select("window_start", "entity", "line")
                rank(closed).write.parquet(f"{target}/{folder}")
            if seen["late_rules"]:
                late = held.filter("late").select("window_start", "entity", "line", "flows")
                late.write.parquet(f"{target}/_late/{folder}")
        if seen["closed_rules"] or seen["late_rules"]:
            row = (batch, attempt, seen["closed_rules"], seen["late_rules"])
            commit = spark.createDataFrame([row], COMMIT).coalesce(1)
            commit.write.mode("append").json(f"{target}/_commits")

    return write


def read_commits(spark: SparkSession, target: str) -> DataFrame:
    """``(batch, attempt, closed_rules, late_rules)``, one row per committed micro-batch."""
    commits = spark.read.schema(COMMIT).json(f"{target}/_commits")
    kept = F.min(F.struct("attempt", "closed_rules", "late_rules")).alias("kept")
    return commits.groupBy("batch").agg(kept).select("batch", "kept.*")


def read_matches(spark: SparkSession, target: str) -> DataFrame:
    """What a stream has matched so far: the rows of whole micro-batches, each once.

    Raises if no batch has written windows yet.
    """
    commits = read_commits(spark, target).select("batch", "attempt")
    rows = spark.read.parquet(target).withColumn("batch", F.col("batch").cast("long"))
    return rows.join(commits, ["batch", "attempt"], "left_semi").drop("batch", "attempt")


def read_late(spark: SparkSession, target: str) -> DataFrame:
    """``(window_start, entity, line, flows)`` of what came after its window had closed.

    Raises if the stream has committed no batch yet; without late rows the table is empty.
    """
    commits = read_commits(spark, target).filter("late_rules > 0").select("batch", "attempt")
    if commits.isEmpty():
        return spark.createDataFrame([], LATE).drop("batch", "attempt")
    rows = spark.read.schema(LATE).parquet(f"{target}/_late")
    return rows.join(commits, ["batch", "attempt"], "left_semi").drop("batch", "attempt")
