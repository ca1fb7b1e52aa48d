"""Runtime traces: schema, window matching, and the stream against the batch."""

import os
import shutil
from datetime import datetime
from types import SimpleNamespace
from urllib.parse import urlparse

import pyarrow as pa
import pytest

from spoor.operators.overlap import prepared
from spoor.session import discard_stored, shared_dir
from spoor.sources.flows import flow_rules, read_flows, stream_flows
from spoor.operators.encode import hashed_encoder
from spoor.streaming.runtime import (
    match_stream,
    match_stream_by_meaning,
    match_windows,
    match_windows_by_meaning,
    read_commits,
    read_late,
    read_matches,
)
from spoor.streaming import late
from spoor.streaming.late import STORE

HEADER = (
    "flow_idx,first_seen,device_ip,remote_ip,ip_protocol,device_port,remote_port,direction,"
    "device_initiated,tcp_initiated_by_device,runtime_ace\n"
)


def row(i, day, rule, tcp="True"):
    return f"{i},2020-01-{day:02d} 10:00:00.123456,10.0.0.1,10.0.0.2,6,1,2,egress,True,{tcp},{rule}\n"


def write_traces(folder):
    cam = [(1, "a"), (1, "a"), (2, "b"), (9, "c"), (10, "a"), (20, "b"), (27, "z")]
    plug = [(1, "z"), (9, "z"), (10, "d"), (25, "d")]
    for name, rows in (("Cam_0011", cam), ("Plug_0022", plug)):
        text = HEADER + "".join(row(i, d, r, "" if i == 0 else "True") for i, (d, r) in enumerate(rows))
        (folder / f"{name}_runtime_aces.csv").write_text(text)


def references(spark):
    rows = [("cam", "a"), ("cam", "b"), ("cam", "c"), ("plug", "d"), ("empty", None)]
    return spark.createDataFrame(rows, "device string, line string")


def test_flows(spark, tmp_path):
    write_traces(tmp_path)
    flows = read_flows(spark, str(tmp_path))
    first = flows.filter("trace = 'Cam_0011'").orderBy("flow_idx").first()
    assert first["tcp_initiated_by_device"] is None and first["device_initiated"] is True
    assert first["first_seen"].microsecond == 123456
    rules = flow_rules(flows, {"Cam_0011": "cam"})
    assert {r["entity"] for r in rules.collect()} == {"cam", "Plug_0022"}


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_traces(source)
    batch = match_windows(
        flow_rules(read_flows(spark, str(source))), references(spark), "7 days", k=2
    ).collect()
    before = set(os.listdir(urlparse(shared_dir(spark)).path))
    query = match_stream(
        flow_rules(stream_flows(spark, str(source))), references(spark), "7 days", "1 day",
        str(tmp_path / "out"), str(tmp_path / "state"), k=2, trigger={"availableNow": True},
    )
    query.awaitTermination()
    # The micro-batches leave nothing behind in the shared folder but the rules of the
    # references, which were made ready once.
    left = set(os.listdir(urlparse(shared_dir(spark)).path)) - before
    assert len([name for name in left if name.startswith("spoor-")]) == 1
    columns = ["window_start", "entity", "device", "score", "hit_count", "rank"]
    stream = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    best = {(r["window_start"], r["entity"]): (r["device"], r["score"]) for r in batch if r["rank"] == 1}
    assert best[datetime(2019, 12, 26), "Cam_0011"] == ("cam", 1 / 3)
    assert best[datetime(2019, 12, 26), "Plug_0022"] == ("cam", 0.0)
    # The watermark stands at the 26th: the window from the 23rd is still open.
    closed = {tuple(r) for r in batch if r["window_start"] < datetime(2020, 1, 23)}
    assert {tuple(r) for r in stream} == closed and len(closed) < len(batch)


def flow_table(spark, rows):
    df = spark.createDataFrame(rows, "entity string, ts string, line string")
    return df.selectExpr("entity", "timestamp(ts) as ts", "line")


def test_windows_below_a_second_stay_apart(spark):
    flows = flow_table(spark, [
        ("cam", "2020-01-01 00:00:00.1", "a"), ("cam", "2020-01-01 00:00:00.7", "b"),
        (None, "2020-01-01 00:00:00.7", "d"),
    ])
    found = match_windows(flows, references(spark), "500 milliseconds", k=1).collect()
    assert sorted((r["window_start"].microsecond, str(r["entity"]), r["device"]) for r in found) == [
        (0, "cam", "cam"), (500_000, "None", "plug"), (500_000, "cam", "cam"),
    ]


def test_windows_at_a_clock_change_stay_apart(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    flows = flow_table(spark, [
        ("cam", "2020-11-01 05:30:00Z", "a"), ("cam", "2020-11-01 06:30:00Z", "b"),
    ])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert match_windows(flows, references(spark), "1 hour", k=1).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_matching_by_meaning_in_batch_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_traces(source)
    encoder = hashed_encoder(16)
    rows = references(spark).filter("line is not null")
    vectors = encoder(rows.selectExpr("line as text").distinct()).withColumnRenamed("text", "line")
    bank = rows.join(vectors, "line").selectExpr("device", "xxhash64(device, line) as row_id", "embedding")
    batch = match_windows_by_meaning(
        flow_rules(read_flows(spark, str(source))), bank, encoder, "7 days", k=2
    ).collect()
    best = {(r["window_start"], r["entity"]): (r["device"], r["score"]) for r in batch if r["rank"] == 1}
    assert best[datetime(2019, 12, 26), "Cam_0011"][0] == "cam"
    assert abs(best[datetime(2019, 12, 26), "Cam_0011"][1] - 1) < 1e-6
    query = match_stream_by_meaning(
        flow_rules(stream_flows(spark, str(source))), bank, encoder, "7 days", "1 day",
        str(tmp_path / "out"), str(tmp_path / "state"), k=2, trigger={"availableNow": True},
    )
    query.awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out")).collect()
    closed = {
        (r["window_start"], r["entity"], r["device"], round(r["score"], 6)) for r in batch
        if r["window_start"] < datetime(2020, 1, 23)
    }
    assert {(r["window_start"], r["entity"], r["device"], round(r["score"], 6)) for r in stream} == closed


def trace_file(folder, name, rows):
    """``rows`` are (day, rule); several files of one entity are told apart by their folder."""
    folder.mkdir(parents=True, exist_ok=True)
    text = HEADER + "".join(row(i, d, r) for i, (d, r) in enumerate(rows))
    (folder / f"{name}_runtime_aces.csv").write_text(text)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    yield
    spark.conf.set(STORE[0], before)


def run_stream(spark, source, out, state, **options):
    query = match_stream(
        flow_rules(stream_flows(spark, str(source))), references(spark), "7 days", "1 day",
        str(out), str(state), k=2, trigger={"availableNow": True}, **options,
    )
    query.awaitTermination()
    return query


def test_late_rows_are_handed_on(spark, tmp_path, rocks):
    """Every flow of a closed window is matched once or late once; nothing is dropped."""
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    columns = ["window_start", "entity", "device", "score", "hit_count", "rank"]
    first = [(1, "a"), (1, "a"), (2, "b"), (9, "c"), (27, "z")]
    trace_file(source / "1", "Cam_0011", first)
    run_stream(spark, source, out, state, late=True)
    batch = match_windows(
        flow_rules(read_flows(spark, str(source))), references(spark), "7 days", k=2
    ).filter("window_start < '2020-01-23'")
    closed = sorted(batch.collect())
    assert sorted(read_matches(spark, str(out)).select(columns).collect()) == closed
    assert read_late(spark, str(out)).count() == 0

    # The windows from 26 December and 2 January have closed; that from the 23rd is open.
    trace_file(source / "2", "Cam_0011", [(1, "a"), (1, "a"), (3, "q"), (28, "b")])
    trace_file(source / "2", "Plug_0022", [(1, "d"), (28, "d")])
    run_stream(spark, source, out, state, late=True)
    late = {(r["window_start"].day, r["entity"], r["line"]): r["flows"] for r in
            read_late(spark, str(out)).collect()}
    assert late == {
        (26, "Cam_0011", "a"): 2, (2, "Cam_0011", "q"): 1, (26, "Plug_0022", "d"): 1,
    }
    assert sorted(read_matches(spark, str(out)).select(columns).collect()) == closed
    assert sum(r["late_rules"] for r in read_commits(spark, str(out)).collect()) == 3

    # A last file closes the window from the 23rd, with the rules of all runs in it.
    (source / "3").mkdir()
    far = HEADER + "0,2020-03-01 10:00:00.0,10.0.0.1,10.0.0.2,6,1,2,egress,True,True,a\n"
    (source / "3" / "Cam_0011_runtime_aces.csv").write_text(far)
    run_stream(spark, source, out, state, late=True)
    last = read_matches(spark, str(out)).filter("window_start = '2020-01-23' and rank = 1")
    assert {(r["entity"], r["device"], r["score"]) for r in last.collect()} == {
        ("Cam_0011", "cam", 1 / 4), ("Plug_0022", "plug", 1.0),
    }


def test_late_rows_need_their_state_store(spark, tmp_path):
    source = tmp_path / "in"
    trace_file(source, "Cam_0011", [(1, "a")])
    with pytest.raises(ValueError, match="RocksDB"):
        run_stream(spark, source, tmp_path / "out", tmp_path / "state", late=True)


def test_readers_see_whole_batches_once(spark, tmp_path):
    """Attempts without a commit do not count, and of two committed ones one does."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write_traces(source)
    run_stream(spark, source, out, tmp_path / "state")
    want = sorted(read_matches(spark, str(out)).collect())
    assert want
    done = read_commits(spark, str(out)).first()
    written = out / f"batch={done['batch']}" / f"attempt={done['attempt']}"
    shutil.copytree(written, out / f"batch={done['batch']}" / "attempt=a-cut-off")
    shutil.copytree(written, out / "batch=77" / "attempt=a-not-there-yet")
    assert sorted(read_matches(spark, str(out)).collect()) == want
    again = spark.createDataFrame([(done["batch"], "a-cut-off", 1, 0)], read_commits(spark, str(out)).schema)
    again.write.mode("append").json(f"{out}/_commits")
    assert sorted(read_matches(spark, str(out)).collect()) == want


class _Calls:
    """List, value and timer state of one key, with the number of calls."""

    def __init__(self):
        self.values, self.calls = [], 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        self.sizes = _Calls()
        return self.sizes

    def registerTimer(self, _):
        self.calls += 1

    def exists(self):
        self.calls += 1
        return bool(self.values)

    def get(self):
        self.calls += 1
        return iter(self.values) if hasattr(self, "sizes") else self.values[0]

    def put(self, values):
        self.calls, self.values = self.calls + 1, list(values)

    def appendValue(self, value):
        self.calls += 1
        self.values.append(value)

    def update(self, value):
        self.put([value])

    def clear(self):
        self.put([])


def test_rules_of_a_window_take_few_calls_of_state(monkeypatch):
    """Calls follow the batches, not the rules, and what is held follows the distinct rules."""
    monkeypatch.setattr(late, "SPARE_ROWS", 50)
    n, state, processor = 300, _Calls(), late.OpenWindow()
    processor.init(state)
    rows = pa.RecordBatch.from_pydict({
        "started": [0] * n, "ended": [10**6] * n, "bucket": [3] * n,
        "entity": [f"e{i % 30}" for i in range(n)], "line": [f"r{i % 10}" for i in range(n)],
        "flows": [1] * n,
    })
    packed = pa.Table.from_batches(late._packed(iter([rows, rows])))
    assert len(packed) == 1
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for _ in range(20):
        key = (0, 10**6, 3)
        assert not list(processor.handleInputRows(key, iter([packed.to_pandas()]), times))
    assert state.calls + state.sizes.calls < 20 * 8
    assert sum(len(late._from_bytes(chunk)) for (chunk,) in state.values) <= 2 * 30 + 50
    closed = list(processor.handleExpiredTimer(key, times, None))
    found = pa.concat_tables([late._from_bytes(c) for df in closed for c in df["chunk"]])
    assert len(found) == 30 and set(found["flows"].to_pylist()) == {20 * 2 * n // 30}
    assert not state.values and not any(df["late"].any() for df in closed)


def test_only_the_names_kept_stay_of_references(spark):
    """What references come from is deleted once a stream has made them ready; they stay readable."""
    folder = urlparse(shared_dir(spark)).path
    before = set(os.listdir(folder))
    with discard_stored(spark) as written:
        ready = prepared(references(spark)).leading(1)
        assert len(written) > 1
        del written[-1:]
    assert len(set(os.listdir(folder)) - before) == 1
    assert ready.every.count() and ready.profiles.count()
