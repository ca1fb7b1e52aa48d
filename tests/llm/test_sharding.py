import random
import zlib
from collections import defaultdict

from spoor.llm.sharding import shard


def check(rows, docs, shards):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs
    )
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(shard(odd_docs, shards=5).collect(), docs, 5)
    assert shard(no_docs).collect() == []


def test_bytes_are_near_equal_and_equal_texts_stay_together(spark):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randint(0, 90) + str(i // 3)) for i in range(9000)]
    # One text holds a third of all rows, and one document is long.
    docs += [(i, "hot text " * 5) for i in range(9000, 13500)] + [(99_999, "y" * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = shard(df, shards=8).collect()
    check(rows, docs, 8)
    sizes, places = defaultdict(int), defaultdict(set)
    texts = dict(docs)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        places[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) <= 0.011 * mean + 900 for s in sizes.values())
    # Each splitter parts at most one group of equal texts.
    assert sum(len(p) - 1 for t, p in places.items() if not t.startswith("hot")) <= 7
    assert len(places["hot text " * 5]) <= 5


def test_equal_rows_are_parted_to_keep_the_law(spark):
    """Rows with one text and one id may be a third of all and still fill shards evenly."""
    docs = [(None, "hot text " * 9)] * 3000 + [(i, f"text {i} " * (i % 15)) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = shard(df, shards=8).collect()
    check(rows, docs, 8)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) <= 0.011 * mean + 200 for s in sizes.values())
