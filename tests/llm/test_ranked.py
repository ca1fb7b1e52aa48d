import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from spoor.llm import ranked
from spoor.llm.ranked import Opened, search, terms_of

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain_terms(text):
    return PATTERN.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    """Every document scored for every item, in Python integers."""
    counts = [Counter(plain_terms(text)) for _, text in docs]
    n = sum(1 for c in counts if c)
    total = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts):
            length, score = sum(c.values()), 0
            for t in plain_terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * length * n) // total
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scored[:k])]
    return sorted(out, key=str)


def topics(rng, docs, words=400, topics=12):
    """Documents that draw most words from one of a few topics, with copies and ties."""
    vocabulary = [f"w{i}" for i in range(words)]
    per = [rng.sample(vocabulary, 40) for _ in range(topics)]
    out = []
    for i in range(docs):
        own = per[i % topics]
        length = rng.randint(3, 120)
        out.append(" ".join(rng.choice(own if rng.random() < 0.7 else vocabulary) for _ in range(length)))
    return out + out[:30] + [out[7]] * 40


def frames(spark, docs, items):
    d = spark.createDataFrame(
        [(i, t, 1, "q") for i, t in docs], "doc_id long, text string, score int, query string"
    ).repartition(3)
    q = spark.createDataFrame(
        [(i, t, 3) for i, t in items], "item_id long, text string, doc int"
    )
    return d, q


def run(spark, docs, items, **options):
    found = search(*frames(spark, docs, items), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("text", [
    None, "", "Ab-c_d9 É é x", "ÀÉ ΑΒΓ straße", "\x00\x7f~`{[@/:0z", "a b 1２3", "😀x😀 y",
])
def test_terms(text):
    assert [t.decode() for t in terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("shard,block,seeds", [(4096, 32, 8192), (50, 4, 0)])
def test_against_brute_force(spark, monkeypatch, shard, block, seeds):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "SEED_POSTINGS", seeds)
    rng = random.Random(4)
    texts = topics(rng, 250)
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    items = [(i, " ".join(texts[i * 3].split()[:40])) for i in range(20)]
    items += [(90, "W1 w1 w1 w2"), (91, "none of these"), (92, None), (90, "W1 w1 w1 w2")]
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_documents(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, docs[8][1]), (None, "alpha Beta"), (3, "one same"), (4, "word " * 5000), (5, "x" * 70_000)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a"), (2, None)], []) == []
    assert run(spark, [(1, ""), (2, None)], [(1, "a")]) == []


def test_sets_of_queries_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranked, "TERMS", 25)
    rng = random.Random(2)
    docs = list(enumerate(topics(rng, 60)))
    items = [(i, docs[i][1]) for i in range(9)]
    _, q = frames(spark, docs, items)
    scratch = ranked.Scratch(spark)
    sets, names = ranked._query_sets(
        q.selectExpr("item_id as query", "text"), scratch
    )
    assert len(names) > 2
    sizes = {}
    for row in sets.collect():
        sizes.setdefault(tuple(row["set"]), []).append(len(row["terms"]))
    assert all(sum(x) - max(x) <= 25 + max(x) for x in sizes.values())
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_are_skipped_and_bounds_hold():
    """A shard by hand: summaries bound every member, and most blocks stay closed."""
    rng = random.Random(8)
    texts = topics(rng, 1200)
    counts = [Counter(terms_of(t)) for t in texts]
    rows = [
        {"query": i, "terms": list(c), "counts": list(c.values())}
        for i, c in ((i, Counter(terms_of(texts[i]))) for i in range(0, 60, 5))
    ]
    queries = ranked._Queries(rows)
    n, total = len(texts), sum(sum(c.values()) for c in counts)
    numbers = {t: i for t, i in queries.vocabulary.items()}
    vectors = [
        {numbers[t]: ranked.impacts(tf, sum(c.values()), n, total) for t, tf in c.items() if t in numbers}
        for c in counts
    ]
    df = Counter(t for v in vectors for t in v)
    peak = {t: max(v.get(t, 0) for v in vectors) for t in df}
    queries.weigh(n, total, df, peak)
    exact = []
    for q in range(len(rows)):
        pairs = list(zip(queries.terms[q].tolist(), queries.weights[q].tolist()))
        exact.append(sorted((sum(w * v.get(t, 0) for t, w in pairs) for v in vectors), reverse=True))
        queries.floor[q] = exact[q][19]
    queries.choose_lists()
    table = pa.table({
        "doc": pa.array(range(n), pa.int64()),
        "length": pa.array([sum(c.values()) for c in counts], pa.int64()),
        "terms": pa.array([list(v) for v in vectors], pa.list_(pa.int32())),
        "counts": pa.array(
            [[c[t] for t in c if t in numbers] for c in counts], pa.list_(pa.int64())
        ),
    })
    shard = ranked.unpack(ranked.make_shard(queries, pa.int64())(table), 0)
    at = doc = 0
    sizes = iter(shard["sizes"].tolist())
    for term, blocks in zip(shard["lists"].tolist(), shard["blocks"].tolist()):
        coordinates = queries.lists[term][1].tolist()
        seen = []
        for _ in range(blocks):
            peaks = shard["peaks"][at : at + len(coordinates)].tolist()
            members = shard["members"][doc : doc + next(sizes)].tolist()
            at, doc, seen = at + len(coordinates), doc + len(members), seen + members
            for c, top in zip(coordinates, peaks):
                assert top == max(vectors[d].get(c, 0) for d in members)
        assert sorted(seen) == [i for i, v in enumerate(vectors) if term in v]
    best, found = ranked._Best(queries.floor, 20), Opened()
    ranked.search_shard(shard, queries, best, found)
    for q, rows_ in enumerate(best.rows):
        assert [-x[0] for x in rows_] == exact[q][:20]
    assert found.open < found.blocks / 2
    assert found.scored < len(rows) * n / 2
