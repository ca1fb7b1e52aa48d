"""Miniature profile documents through flattening, rendering, statistics and sinks."""

import json

import pytest

from spoor.functions.labels import clean_label, expected_label, file_stem
from spoor.operators.flatten import entries, parse_documents, render
from spoor.operators.encode import hashed_encoder
from spoor.plans.banks import embed_folder, embed_lines
from spoor.plans.compaction import compact, compact_folder
from spoor.plans.retrieval import rank_lines
from spoor.sources.profiles import (
    line_query_sets,
    read_lines,
    read_query_sets,
    read_reference_sets,
)
from pyspark.sql import functions as F

ROOT = "ietf-access-control-list:access-lists"


def doc(*acls):
    return json.dumps({ROOT: {"acl": list(acls)}})


def acl(name, *aces):
    return {"name": name, "aces": {"ace": list(aces)}}


def ace(**blocks):
    return {"matches": {k.replace("mud", "ietf-mud:mud"): v for k, v in blocks.items()}}


EQ = {"operator": "eq", "port": 53}
RANGE = {"operator": "range", "lower-port": 1, "upper-port": 9}
SIDE = "ietf-mud:direction-initiated"
SRC, DST = "ietf-acldns:src-dnsname", "ietf-acldns:dst-dnsname"

CASES = [
    ("from-a", ace(mud={"controller": "urn:ietf:params:mud:dns"}), "egress controller:dns"),
    ("to-a", ace(mud={"controller": "plain"}), "ingress controller:plain"),
    ("a", ace(mud={"controller": "", "local-networks": [None]}), "local"),
    ("a", ace(mud={"controller": None, "local-networks": None}), "local"),
    ("a", ace(eth={"ethertype": "0x888e", "destination-mac-address": "ff:ff"}),
     "eth:0x888e mac:ff:ff"),
    ("a", ace(eth={"ethertype": None}), "eth:None"),
    ("a", ace(mud={"controller": 0, "local-networks": 0}), "local"),
    ("a", ace(mud={"controller": "0"}), "controller:0"),
    ("a", ace(mud={"controller": False}, ipv4={"protocol": 6}, tcp={SIDE: []}), "ipv4 tcp"),
    ("a", ace(ipv4={SRC: {}, DST: 0.0, "source-ipv4-network": "s"}), "ipv4 src:s"),
    ("a", ace(ipv4={}), None),
    ("a", ace(ipv4={"unknown": 1}), "ipv4"),
    ("a", ace(ipv4={"protocol": 2}), "ipv4 igmp"),
    ("a", ace(ipv4={"protocol": 6}), "ipv4 tcp"),
    ("a", ace(ipv4={"protocol": "6"}), "ipv4 tcp"),
    ("a", ace(ipv4={"protocol": "gre"}), "ipv4 gre"),
    ("a", ace(ipv4={"protocol": 17}), "ipv4 udp"),
    ("a", ace(ipv6={"protocol": 58}), "ipv6 icmpv6"),
    ("a", ace(ipv4={"protocol": 1}), "ipv4 1"),
    ("a", ace(ipv4={SRC: "s.example", "source-ipv4-network": "1.2.3.4/32"}),
     "ipv4 src:s.example"),
    ("a", ace(ipv4={DST: "", "destination-ipv4-network": "1.2.3.4/32"}), "ipv4 dst:1.2.3.4/32"),
    ("a", ace(ipv6={"destination-ipv6-network": "fe80::/10", SRC: "x"}),
     "ipv6 src:x dst:fe80::/10"),
    ("a", ace(ipv4={"protocol": 17}, udp={"source-port": EQ, "destination-port": RANGE}),
     "ipv4 udp src-port:53"),
    ("a", ace(ipv4={"protocol": 6}, tcp={SIDE: "from-device", "destination-port": EQ}),
     "ipv4 tcp (direction-initiated:from-device) dst-port:53"),
    ("a", ace(ipv4={"protocol": 6}, ipv6={"protocol": 6}, tcp={SIDE: "to-device"}),
     "ipv4 tcp (direction-initiated:to-device) ipv6 tcp"),
    ("a", ace(ipv4={"protocol": 1}, ipv6={"protocol": 6}, tcp={SIDE: "to-device"}),
     "ipv4 1 ipv6 tcp (direction-initiated:to-device)"),
    ("a", ace(ipv4={"protocol": 1}, tcp={SIDE: "to-device", "source-port": EQ}),
     "ipv4 1 src-port:53"),
    ("a", ace(ipv4={"protocol": 6}, tcp={SIDE: ""}), "ipv4 tcp"),
    ("a", ace(tcp={"source-port": 53}, icmp={"type": 8}), None),
    ("a", {"actions": {}}, None),
    ("a", {"matches": None}, None),
]


def test_render_cases(spark):
    rows = [(i, doc(acl(name, entry))) for i, (name, entry, _) in enumerate(CASES)]
    parsed, bad = parse_documents(spark.createDataFrame(rows, "id int, text string"))
    got = {r["id"]: r["line"] for r in render(entries(parsed, "id"), "id").collect()}
    want = {i: line for i, (_, _, line) in enumerate(CASES) if line is not None}
    assert got == want
    assert bad.count() == 0


def test_entries_skip_what_is_no_object_and_quarantine_the_rest(spark):
    rows = [
        ("a", doc(acl("from-x", "text", 3, None, ace(ipv4={"protocol": 6})))),
        ("b", doc({"name": "x", "aces": None}, {"aces": {"ace": [ace(ipv4={"protocol": 2})]}})),
        ("c", "{no json"),
        ("d", json.dumps({"other": 1})),
        ("e", json.dumps({ROOT: {"acl": None}})),
    ]
    done = compact(spark.createDataFrame(rows, "path string, text string"))
    got = [tuple(r) for r in done.lines.orderBy("path").collect()]
    assert got == [("a", 0, 3, "egress ipv4 tcp"), ("b", 1, 0, "ipv4 igmp")]
    assert {r["path"] for r in done.quarantine.collect()} == {"c", "d", "e"}
    assert done.summary.first()["file_count"] == 2


def test_folder_keeps_order_layout_and_sizes(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub dir").mkdir(parents=True)
    twice = ace(ipv4={"protocol": 6})
    first = doc(acl("to-z", twice, ace(eth={"ethertype": "é"}), twice), acl("from-z", twice))
    (source / "one.json").write_text(first, encoding="utf-8")
    (source / "sub dir" / "two.json").write_text(doc(acl("x", ace(ipv4={"protocol": 2}))))
    (source / "note.txt").write_text("ignored")
    done = compact_folder(spark, str(source), str(target))
    lines = ["ingress ipv4 tcp", "ingress eth:é", "egress ipv4 tcp"]
    written = spark.read.text(f"{target}/texts/profile=one_compact").collect()
    assert [r["value"] for r in written] == lines
    paths = {r["path"] for r in done.lines.select("path").distinct().collect()}
    assert paths == {"one.json", "sub dir/two.json"}
    stats = {r["path"]: r for r in done.stats.collect()}
    original = len(json.loads(json.dumps(first)))
    flat = len("\n".join(lines))
    assert stats["one.json"]["original_size"] == original
    assert stats["one.json"]["flattened_size"] == flat
    assert stats["one.json"]["reduction_percent"] == pytest.approx(
        round((1 - flat / original) * 100, 2)
    )
    total = done.summary.first()
    assert total["file_count"] == 2
    assert total["total_reduction_bytes"] == sum(r["reduction_bytes"] for r in stats.values())


def test_repeated_keys_and_reasons(spark):
    good = doc(acl("from-x", ace(ipv4={"protocol": 6})))
    rows = [
        ("twice", good[:-1] + ', "other": 1, "other": 2}'), ("cut", good[:-5]), ("none", "{}"),
        ("text", "plain"),
    ]
    done = compact(spark.createDataFrame(rows, "path string, text string"))
    assert [(r["path"], r["line"]) for r in done.lines.collect()] == [("twice", "egress ipv4 tcp")]
    reasons = {r["path"]: r["reason"] for r in done.quarantine.collect()}
    assert reasons == {
        "cut": "no JSON object", "none": "no access lists", "text": "no JSON object",
    }


def test_stages_chain(spark, tmp_path):
    """Compacted profiles feed ranking and embedding, those without rules included."""
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    ports = {"cam": [1, 2], "plug": [2, 3], "sub/deep": [4], "empty": []}
    for name, protocols in ports.items():
        text = doc(acl("from-x", *[ace(ipv4={"protocol": 100 + p}) for p in protocols]))
        (source / f"{name}.json").write_text(text)
    (source / "bad.json").write_text("{no")
    compact_folder(spark, str(source), str(out))
    assert spark.read.json(f"{out}/quarantine").first()["reason"] == "no JSON object"

    result = rank_lines(spark, f"{out}/lines", f"{out}/lines")
    metrics = result.metrics.first()
    assert metrics["queries"] == 4
    ranks = {r["query"]: r["rank"] for r in result.ranks.collect()}
    assert {ranks[f"{n}.json"] for n in ("cam", "plug")} == {1}
    assert line_query_sets(read_lines(spark, f"{out}/lines")).filter("line is null").count() == 1

    references = read_reference_sets(spark, f"{out}/texts").collect()
    assert {r["device"] for r in references} == {"cam", "plug", "empty"}
    queries = read_query_sets(spark, f"{out}/texts").collect()
    assert {r["query"] for r in queries} == {
        "cam_compact.txt", "plug_compact.txt", "sub/deep_compact.txt", "empty_compact.txt"
    }
    assert {r["line"] for r in queries if r["query"].startswith("empty")} == {None}

    encoder = hashed_encoder(8)
    texts = embed_folder(spark, f"{out}/texts", encoder, str(tmp_path / "a"))
    lines = embed_lines(spark, f"{out}/lines", encoder, str(tmp_path / "b"))
    want = [("cam", 101), ("cam", 102), ("deep", 104), ("plug", 102), ("plug", 103)]
    for bank, tail in ((texts, "_compact"), (lines, "")):
        got = sorted((r["device"], r["text"]) for r in bank.collect())
        assert got == [(d + tail, f"egress ipv4 {p}") for d, p in want]
    whole = embed_lines(spark, f"{out}/lines", encoder, str(tmp_path / "c"), "whole")
    assert {r["device"] for r in whole.collect()} == {"cam", "plug", "deep", "empty"}


def test_files_of_zero_bytes_are_profiles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "em pty.txt").write_text("")
    found = {(r["device"], r["line"]) for r in read_reference_sets(spark, str(tmp_path)).collect()}
    assert found == {("a", "x"), ("a", "y"), ("em pty", None)}


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        compact_folder(spark, str(tmp_path), str(tmp_path / "out"))


def test_labels(spark):
    names = {
        "cam": "cam", "cam_compact": "cam", "cam_test_1_compact": "cam",
        "a_loo_b_test_c": "a_loo_b", "a_ipbits8_family_x": "a_ipbits8", "_compact": "",
        "x_compact_y": "x_compact_y", "a_ipbits": "a", "_test_": "",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1] for r in df.select("n", clean_label(F.col("n"))).collect()}
    assert got == names
    paths = {
        "cam_compact.txt": "cam", "cam_test_1/deep/x.txt": "cam", "a.b.txt": "a.b",
        ".hidden": ".hidden",
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", expected_label(F.col("p"))).collect()} == paths
    assert df.select(file_stem(F.lit("d/.x.txt"))).first()[0] == ".x"


def test_documents_are_parsed_once_and_not_in_the_scan(spark):
    """No filter on the parsed lists is pushed below them, where it would parse them again."""
    texts = [(1, '{"ietf-access-control-list:access-lists":{"acl":[]}}'), (2, "{"), (3, None)]
    documents = spark.createDataFrame(texts, "path long, text string").repartition(2, "path")
    found = compact(documents)
    for df, parses in ((found.lines, 1), (found.stats, 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sum("parseJson" in line for line in plan) == parses
        assert not any("parseJson" in line and "Filter" in line for line in plan)
    assert [r["path"] for r in found.stats.collect()] == [1]
