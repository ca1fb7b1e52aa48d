"""Rules of windows in a stream that hands on late rows instead of dropping them.

Spark's own streaming aggregation drops rows behind the watermark and only counts them. Here a
stateful processor holds the rules of each open window, hands them on when the watermark has
passed its end, and returns rows for windows it has closed as late.

Calls of Python and of its state are dear, so entities share buckets, and the rules of a bucket
come and stay as Arrow tables in bytes (*chunks*): a call takes thousands of rules, not one.

The processor needs the RocksDB state store, see ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spoor.session import ship_package

#: Setting of the session and the value that it must have.
STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
#: Buckets of entities in a window. The state is found by them, so a checkpoint keeps its number.
BUCKETS = 256
#: Rows that are combined at a time, and rows of a chunk at most.
CHUNK_ROWS = 100_000
#: A bucket holds at most twice its distinct rules and this many more.
SPARE_ROWS = 10_000

RULE = ["entity", "line"]
CHUNK = pa.schema([("entity", pa.string()), ("line", pa.string()), ("flows", pa.int64())])
KEY = ["started", "ended", "bucket"]
PACKED = "started long, ended long, bucket long, chunk binary"
HANDED = "started long, chunk binary, late boolean"
RULES = "started long, entity string, line string, flows long, late boolean"


def _summed(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    """Equal rules as one row."""
    found = pa.concat_tables(tables).group_by(keys).aggregate([("flows", "sum")])
    return found.select([*keys, "flows_sum"]).rename_columns([*keys, "flows"])


def _to_bytes(rules: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CHUNK) as writer:
        writer.write_table(rules.select(CHUNK.names).cast(CHUNK))
    return sink.getvalue().to_pybytes()


def _from_bytes(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(chunk).read_all()


def _chunks(rules: pa.Table) -> list[bytes]:
    return [_to_bytes(rules.slice(at, CHUNK_ROWS)) for at in range(0, len(rules), CHUNK_ROWS)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rules of many rows, one chunk for each bucket of a window."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(_summed([pa.Table.from_batches([batch])], [*KEY, *RULE]))
        if sum(map(len, held)) >= CHUNK_ROWS:
            yield _pack(held)
            held = []
    if held:
        yield _pack(held)


def _pack(held: list[pa.Table]) -> pa.RecordBatch:
    rules = _summed(held, [*KEY, *RULE]).sort_by([(name, "ascending") for name in KEY])
    keys = np.column_stack([rules[name].to_numpy() for name in KEY])
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][: len(keys)])
    ends = np.r_[starts[1:], len(keys)].astype(np.int64)
    chunks = [_to_bytes(rules.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(column, pa.int64()) for column in keys[starts].T), pa.array(chunks, pa.binary())],
        names=[*KEY, "chunk"],
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules = _from_bytes(row["chunk"])
            out = pa.table({
                "started": pa.repeat(pa.scalar(row["started"], pa.int64()), len(rules)),
                **{name: rules[name] for name in CHUNK.names},
                "late": pa.repeat(row["late"], len(rules)),
            })
            yield from out.to_batches()


class OpenWindow(StatefulProcessor):
    """One window of a bucket of entities: its rules and how many flows had each, until it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "chunk binary")
        self.sizes = handle.getValueState("sizes", "held long, least long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, ended, _ = key
        end_ms = -(-int(ended) // 1000)
        # A window that the watermark has passed stays open until its timer has run.
        is_open = timerValues.getCurrentWatermarkInMs() < end_ms or self.chunks.exists()
        for batch in rows:
            if is_open:
                self._hold(_summed([_from_bytes(chunk) for chunk in batch["chunk"]], RULE))
            else:
                yield _handed(started, list(batch["chunk"]), True)
        if is_open:
            self.handle.registerTimer(end_ms)

    def _hold(self, rules: pa.Table) -> None:
        held, least = self.sizes.get() if self.sizes.exists() else (0, 0)
        held += len(rules)
        if held > 2 * least + SPARE_ROWS:
            rules = self._distinct(rules)
            held = least = len(rules)
            self.chunks.put([(chunk,) for chunk in _chunks(rules)])
        else:
            for chunk in _chunks(rules):
                self.chunks.appendValue((chunk,))
        self.sizes.update((held, least))

    def _distinct(self, *more: pa.Table) -> pa.Table:
        held = [_from_bytes(chunk) for (chunk,) in self.chunks.get()] if self.chunks.exists() else []
        return _summed([*held, *more], RULE) if held or more else CHUNK.empty_table()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rules = self._distinct()
        self.chunks.clear()
        self.sizes.clear()
        for chunk in _chunks(rules):
            yield _handed(key[0], [chunk], False)

    def close(self) -> None:
        pass


def _handed(started, chunks: list[bytes], late: bool) -> pd.DataFrame:
    return pd.DataFrame({"started": started, "chunk": chunks, "late": late})


def window_rules_and_late(flows: DataFrame, width: str, delay: str) -> DataFrame:
    """``(window_start, entity, line, flows, late)`` of the stream ``flows (entity, ts, line)``.

    Rows that are not late are the distinct rules of a window that has closed, given once.
    Late rows belong to a window that closed before they came; they may repeat. Every flow with
    a time, an entity and a rule is counted in exactly one row, once its window has closed.
    """
    spark = flows.sparkSession
    if spark.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"late rows need {STORE[0]}={STORE[1]}")
    ship_package(spark)
    timed = flows.filter("entity is not null and line is not null").withWatermark("ts", delay)
    # Whole numbers carry no mark of event time, by which Spark would drop the late rows.
    bucket = F.pmod(F.xxhash64("entity"), F.lit(BUCKETS)).alias("bucket")
    rows = timed.select(F.window("ts", width).alias("w"), "entity", "line").select(
        F.unix_micros("w.start").alias("started"), F.unix_micros("w.end").alias("ended"),
        bucket, "entity", "line", F.lit(1).cast("long").alias("flows"),
    )
    found = (
        rows.mapInArrow(_packed, PACKED)
        .groupBy(*KEY)
        .transformWithStateInPandas(OpenWindow(), HANDED, "Append", "EventTime")
        .mapInArrow(_unpacked, RULES)
    )
    return found.select(
        F.timestamp_micros("started").alias("window_start"), "entity", "line", "flows", "late"
    )
