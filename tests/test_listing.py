"""Folders listed and read by tasks, against Spark's own scan."""

import json

import pytest

from spoor.plans.compaction import compact_folder
from spoor.sources.listing import arrow_files, list_files, read_listed
from spoor.sources.profiles import read_documents, read_rule_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a b+c%20"
    for name, text in {
        "one.txt": "x\ny", "em pty.txt": "", "deep/er/two.txt": "\u00e9 \U0001f600", "deep/3.json": "{}",
        "_hidden/no.txt": "no", ".dot.txt": "no", "_no.txt": "no", "lang=de/part.txt": "ja",
        "deep/cr.txt": "a\r\nb\r",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "nothing").mkdir()
    return str(root)


def test_listing_gives_sizes_and_empty_files(spark, tree):
    found = {r["path"]: r["size"] for r in list_files(spark, tree, "*.txt").collect()}
    assert found == {
        "one.txt": 3, "em pty.txt": 0, "deep/er/two.txt": 7, "lang=de/part.txt": 2, "deep/cr.txt": 5,
    }
    assert list_files(spark, tree + "/nowhere").count() == 0
    assert list_files(spark, tree, "*.csv").count() == 0


def test_reading_equals_a_scan(spark, tree):
    scanned = read_rule_files(spark, tree).collect()
    assert sorted(read_rule_files(spark, tree, opener=arrow_files).collect()) == sorted(scanned)
    top = read_rule_files(spark, "file:" + tree, recursive=False, opener=arrow_files)
    assert {r["path"] for r in top.collect()} == {"one.txt", "em pty.txt"}
    with pytest.raises(ValueError, match="no profiles"):
        read_documents(spark, tree + "/nowhere", arrow_files)


def test_files_are_dealt_by_their_bytes(spark, tree):
    manifest = list_files(spark, tree, "*.txt")
    read = read_listed(manifest, tree, task_bytes=6)
    assert read.rdd.getNumPartitions() == 3
    assert read.count() == 5
    assert read_listed(manifest.filter("size < 0"), tree).count() == 0


def test_compaction_from_a_listing(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    ace = {"matches": {"ipv4": {"protocol": 6}}}
    good = {"ietf-access-control-list:access-lists": {"acl": [{"name": "from-x", "aces": {"ace": [ace]}}]}}
    (source / "sub" / "one.json").write_text(json.dumps(good))
    (source / "empty.json").write_text("")
    results = {}
    for name, opener in (("scan", None), ("listed", arrow_files)):
        done = compact_folder(spark, str(source), str(tmp_path / name), opener)
        results[name] = [
            sorted(df.collect()) for df in (done.lines, done.stats, done.quarantine, done.summary)
        ]
    assert results["listed"] == results["scan"]
    lines, stats, quarantine, _ = results["listed"]
    assert [r["line"] for r in lines] == ["egress ipv4 tcp"]
    assert [r["path"] for r in stats] == ["sub/one.json"]
    assert [(r["path"], r["text"], r["reason"]) for r in quarantine] == [
        ("empty.json", "", "no JSON object")
    ]
