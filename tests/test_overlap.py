"""Exact overlap ranking against brute force, with and without hot rules."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spoor.functions.vectors import best_columns
from spoor.operators import overlap
from spoor.operators.overlap import overlap_ranks, overlap_topk
from spoor.operators.ranking import name_positions, retrieval_metrics
from spoor.plans.retrieval import rank_sets, rank_text_folders
from spoor.sources.profiles import read_query_sets, read_reference_sets


def profiles(seed, n, prefix):
    rnd = random.Random(seed)
    cold = [f"c{j}" for j in range(30)]
    return {
        f"{prefix}{i}": set(rnd.sample(cold, rnd.randint(0, 5)))
        | {f"h{j}" for j in range(4) if rnd.random() < 0.5}
        for i in range(n)
    }


QUERIES, REFERENCES = profiles(1, 30, "q"), profiles(2, 40, "d")
# Copies of one profile: a third of all references tie everywhere.
REFERENCES |= {f"copy{i:02d}": {"h0", "c1"} for i in range(20)}
EXPECTED = {q: random.Random(q).choice([*REFERENCES, "unknown"]) for q in QUERIES}


def frame(spark, sets, key):
    rows = [(name, line) for name, lines in sets.items() for line in (lines or [None])]
    return spark.createDataFrame(rows, f"{key} string, line string")


def brute(method):
    tops, ranks = {}, {}
    for name, query in QUERIES.items():
        scored = []
        for device, rules in REFERENCES.items():
            hits, union = len(query & rules), len(query | rules)
            score = float(hits) if method == "exact_hit_count" else hits / union if union else 0.0
            scored.append((-score, device, hits))
        scored.sort()
        tops[name] = [(d, -s, h) for s, d, h in scored[:5]]
        names = [d for _, d, _ in scored]
        ranks[name] = names.index(EXPECTED[name]) + 1 if EXPECTED[name] in names else None
    return tops, ranks


@pytest.mark.parametrize("method", ["jaccard", "exact_hit_count"])
@pytest.mark.parametrize(
    "budget,max_hot,limit,large,seeds",
    [(10**9, 4096, 1 << 26, 2000, 1024), (30, 4096, 0, 2000, 5), (30, 2, 1 << 26, 3, 0)],
)
def test_against_brute_force(spark, monkeypatch, method, budget, max_hot, limit, large, seeds):
    monkeypatch.setattr(overlap, "QUERY_RULES_PER_TASK", large)
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(overlap, "PAIRS_PER_TASK", 200)
    monkeypatch.setattr(overlap, "SEED_PAIRS", seeds)
    monkeypatch.setattr(overlap, "GRID_ROWS", 13)
    monkeypatch.setattr(overlap, "BLOCK", 7)
    queries, references = frame(spark, QUERIES, "query"), frame(spark, REFERENCES, "device")
    expected = spark.createDataFrame(list(EXPECTED.items()), "query string, expected string")
    tops, ranks = brute(method)
    options = {"pair_budget": budget, "max_hot": max_hot}
    got = {}
    for r in overlap_topk(queries, references, method, 5, **options).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r["device"], r["score"], r["hit_count"]))
    assert got == tops
    found = overlap_ranks(queries, references, expected, method, **options).collect()
    assert {r["query"]: r["rank"] for r in found} == ranks


def test_topk_is_a_prefix_of_a_larger_topk(spark):
    queries, references = frame(spark, QUERIES, "query"), frame(spark, REFERENCES, "device")
    small = overlap_topk(queries, references, k=3).collect()
    large = overlap_topk(queries, references, k=7).filter("rank <= 3").collect()
    assert set(small) == set(large)


def test_name_positions(spark):
    names = [f"n{i % 37}x{i}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "device string")
    got = {r["device"]: r["position"] for r in name_positions(df, "device").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_metrics_count_unranked_queries_in_the_shares_only(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 4), ("c", None), ("d", 9)], "query string, rank int")
    row = retrieval_metrics(ranks).first()
    assert (row["queries"], row["top1"], row["topk"]) == (4, 0.25, 0.5)
    assert row["mrr"] == pytest.approx((1 + 1 / 4 + 1 / 9) / 3)
    assert row["mean_rank"] == pytest.approx(14 / 3)
    none = retrieval_metrics(ranks.filter("rank is null")).first()
    assert (none["top1"], none["mrr"], none["mean_rank"]) == (0.0, 0.0, 0.0)


def test_text_folders(spark, tmp_path):
    refs, queries = tmp_path / "refs", tmp_path / "queries"
    (queries / "cam_test_1").mkdir(parents=True)
    refs.mkdir()
    (refs / "cam_compact.txt").write_text("old\n")
    (refs / "cam_test_2.txt").write_text("  a b \r\n\n b c\x1cd")
    (refs / "plug_compact.txt").write_text("a b\na b")
    (refs / "blank.txt").write_text("\n \n")
    (queries / "cam_test_1" / "x.txt").write_text("a b\nc\nzz")
    (queries / "plug.txt").write_text("\n")
    sets = {}
    for r in read_reference_sets(spark, str(refs)).collect():
        sets.setdefault(r["device"], set()).add(r["line"])
    assert sets == {"cam": {"a b", "b", "c", "d"}, "plug": {"a b"}, "blank": {None}}
    found = {(r["query"], r["expected"]) for r in read_query_sets(spark, str(queries)).collect()}
    assert found == {("cam_test_1/x.txt", "cam"), ("plug.txt", "plug")}
    result = rank_text_folders(spark, str(refs), str(queries), k=2)
    report = {r["query"]: r for r in result.report().collect()}
    cam, plug = report["cam_test_1/x.txt"], report["plug.txt"]
    assert cam["rank"] == 1 and cam["top"][0]["score"] == pytest.approx(2 / 5)
    assert plug["rank"] == 3 and [t["device"] for t in plug["top"]] == ["blank", "cam"]
    metrics = result.metrics.first()
    assert metrics["queries"] == 2 and metrics["top1_accuracy"] == 0.5
    assert metrics["mrr"] == pytest.approx((1 + 1 / 3) / 2)
    result.write(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "results")).count() == 2


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        rank_sets(frame(spark, QUERIES, "query"), frame(spark, REFERENCES, "device"), "cosine")


def test_heavy_rules_are_cut_into_cells(spark, monkeypatch):
    """Many rules beyond the words: no cell holds more than about the budget of pairs."""
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(overlap, "PAIRS_PER_TASK", 50)
    wide = {f"w{j}" for j in range(30)}
    queries = {name: rules | wide for name, rules in QUERIES.items()}
    references = {name: rules | wide for name, rules in REFERENCES.items()}
    q, r = frame(spark, queries, "query"), frame(spark, references, "device")
    ready = overlap.prepared(r)
    lines = q.filter("line is not null")
    pairs = overlap.join_lines(lines, ready)
    assert pairs.count() == sum(len(a & b) for a in queries.values() for b in references.values())
    n_q, n_r = len(queries), len(references)
    heavy = overlap._grids(overlap.rule_pairs(lines, ready.per_rule))
    for row in heavy.filter("line like 'w%'").collect():
        assert n_q / row["parts_q"] * n_r / row["parts_r"] <= 60
    found = overlap_topk(q, ready, k=5, max_hot=1).orderBy("rank").collect()
    for name, rules in queries.items():
        scored = sorted(
            (-len(rules & other) / len(rules | other), device) for device, other in references.items()
        )
        assert [x["device"] for x in found if x["query"] == name] == [d for _, d in scored[:5]]


def many_profiles(n, prefix, seed):
    """Families of profiles: a few rules that all hold, many that a family holds, some of their own."""
    rnd = random.Random(seed)
    return {
        f"{prefix}{i}": {f"all{j}" for j in range(6)}
        | {f"family{i % 10}-{j}" for j in rnd.sample(range(30), 24)}
        | {f"own{i % 37}-{j}" for j in range(4)}
        for i in range(n)
    }


def test_few_pairs_are_emitted(spark, monkeypatch):
    """Common rules emit no pair, and a score to beat keeps most others from being emitted."""
    monkeypatch.setattr(overlap, "SEED_PAIRS", 20)
    queries, references = many_profiles(60, "q", 1), many_profiles(200, "d", 2)
    q, r = frame(spark, queries, "query"), frame(spark, references, "device")
    sides = overlap._Sides(q, r, 8000, 4096)
    assert sorted(sides.hot) == [f"all{j}" for j in range(6)]
    every = sum(len(a & b) for a in queries.values() for b in references.values())
    best = overlap_topk(q, r, k=3, pair_budget=8000)
    floors = overlap._floors(best, 3)
    seeds = sides.emitted(sides.seeds(), "jaccard").count()
    rest = sides.emitted(sides.prefixes(floors, "jaccard"), "jaccard").count()
    assert seeds + rest < every / 5
    got = {}
    for row in best.orderBy("rank").collect():
        got.setdefault(row["query"], []).append(row["device"])
    for name, rules in queries.items():
        scored = sorted(
            (-len(rules & other) / len(rules | other), device) for device, other in references.items()
        )
        assert got[name] == [d for _, d in scored[:3]]


def test_bits_fill_several_words(spark):
    """The last bit of a word is a bit like the others."""
    rules = [f"r{j:03d}" for j in range(130)]
    queries = {"q": set(rules), "one": {rules[63]}}
    references = {"a": set(rules[:70]), "b": {rules[63], rules[129]}, "c": {rules[128]}}
    q, r = frame(spark, queries, "query"), frame(spark, references, "device")
    sides = overlap._Sides(q, r, 0, 4096)
    assert len(sides.hot) == 71 + 1
    found = overlap_topk(q, r, "exact_hit_count", 3, pair_budget=0).orderBy("query", "rank").collect()
    assert [(x["query"], x["device"], x["hit_count"]) for x in found] == [
        ("one", "a", 1), ("one", "b", 1), ("one", "c", 0), ("q", "a", 70), ("q", "b", 2), ("q", "c", 1),
    ]


def test_pairs_beyond_64_bits(spark):
    counts = overlap.rule_pairs(
        spark.createDataFrame([("q", "a")], "query string, line string"),
        spark.createDataFrame([("a", 9_000_000_000_000_000_000)], "line string, n_r long"),
    )
    doubled = counts.union(counts).union(counts)
    assert overlap.hot_rules(doubled, 1e20, 1) == ([], pytest.approx(2.7e19))


@pytest.mark.parametrize("method", ["jaccard", "exact_hit_count"])
def test_copies_of_profiles_meet_once(spark, monkeypatch, method):
    """Pairs that are emitted follow the different profiles, not their copies."""
    seen = []

    class Spy(overlap._Sides):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self.rare_pairs)

    monkeypatch.setattr(overlap, "_Sides", Spy)
    monkeypatch.setattr(overlap, "BLOCK", 3)
    monkeypatch.setattr(overlap, "PAIRS_PER_TASK", 20)

    def copies(sets, n):
        return {f"{name}-{i:02d}": rules for name, rules in sets.items() for i in range(n)}

    few = {n: QUERIES[n] for n in sorted(QUERIES)[:8]}, {n: REFERENCES[n] for n in sorted(REFERENCES)[:30:2]}
    tops, ranks = {}, {}
    for n in (5, 12):
        queries, references = (copies(sets, n) for sets in few)
        # Members of a class ask for different names, of the same class and of others.
        names = sorted(references)
        expected = {q: names[(7 * i) % len(names)] if i % 9 else "unknown" for i, q in enumerate(queries)}
        q, r = frame(spark, queries, "query"), frame(spark, references, "device")
        asked = spark.createDataFrame(list(expected.items()), "query string, expected string")
        options = {"pair_budget": 0, "max_hot": 3}
        top = overlap_topk(q, r, method, 5, **options).orderBy("query", "rank").collect()
        rank = overlap_ranks(q, r, asked, method, **options).collect()
        for name, query in queries.items():
            scored = []
            for device, rules in references.items():
                hits, union = len(query & rules), len(query | rules)
                score = float(hits) if method == "exact_hit_count" else hits / union if union else 0.0
                scored.append((-score, device))
            scored.sort()
            tops[name] = [d for _, d in scored[:5]]
            order = [d for _, d in scored]
            ranks[name] = order.index(expected[name]) + 1 if expected[name] in references else None
        assert all([t["device"] for t in top if t["query"] == name] == tops[name] for name in queries)
        assert {t["query"]: t["rank"] for t in rank} == {name: ranks[name] for name in queries}
    # Five names of a class of references stand for any number; ranks have a name for each.
    assert seen[0] == seen[2]
    assert seen[1] <= 8 * 15 * 9 and seen[3] <= 8 * 15 * 9 * 2


def test_kernels_of_the_grid_keep_no_table_of_words():
    """Common bits are counted some rows at a time, and a list needs no partition of all scores."""
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 62, size=(n, 5), dtype=np.uint64) for n in (300, 2_000))
    tracemalloc.start()
    hits = overlap._popcounts(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * hits.nbytes
    plain = np.array([[sum(bin(int(x & y)).count("1") for x, y in zip(p, q)) for q in b[:50]] for p in a[:20]])
    assert (hits[:20, :50] == plain).all()
    rng = np.random.default_rng(3)
    for scores in (hits.astype(float), np.zeros((3, 2_000)), rng.random((40, 1_999))):
        row, column = best_columns(scores, 5)
        wanted = [sorted(np.lexsort((np.arange(len(x)), -x))[:5]) for x in scores]
        assert (column.reshape(-1, 5) == wanted).all() and (row == np.repeat(np.arange(len(scores)), 5)).all()


def brute_order(method, query, references):
    """Devices of one query from the best on, with score and hits."""
    scored = []
    for device, rules in references.items():
        hits, union = len(query & rules), len(query | rules)
        score = float(hits) if method == "exact_hit_count" else hits / union if union else 0.0
        scored.append((-score, device, hits))
    return [(device, -score, hits) for score, device, hits in sorted(scored)]


@pytest.mark.parametrize("method", ["jaccard", "exact_hit_count"])
@pytest.mark.parametrize("columns,rules", [(131_072, 1 << 23), (9, 1 << 23), (131_072, 40)])
def test_rules_with_many_pairs_do_not_join(spark, monkeypatch, method, columns, rules):
    """Rules beyond the common ones that would emit too many pairs are counted in the grid."""
    def joined(*_):
        raise AssertionError("pairs are emitted")

    monkeypatch.setattr(overlap, "JOIN_PAIRS", 10)
    monkeypatch.setattr(overlap, "GRID_ROWS", 6)
    monkeypatch.setattr(overlap, "GRID_COLUMNS", columns)
    monkeypatch.setattr(overlap, "GRID_RULES", rules)
    monkeypatch.setattr(overlap, "join_lines", joined)
    q, r = frame(spark, QUERIES, "query"), frame(spark, REFERENCES, "device")
    expected = spark.createDataFrame(list(EXPECTED.items()), "query string, expected string")
    options = {"pair_budget": 30, "max_hot": 2}
    tops, ranks = brute(method)
    got = {}
    for row in overlap_topk(q, r, method, 5, **options).orderBy("rank").collect():
        got.setdefault(row["query"], []).append((row["device"], row["score"], row["hit_count"]))
    assert got == tops
    found = overlap_ranks(q, r, expected, method, **options).collect()
    assert {x["query"]: x["rank"] for x in found} == ranks


@pytest.mark.parametrize("method", ["jaccard", "exact_hit_count"])
@pytest.mark.parametrize("n_rules,most", [(40, 30), (900, 60)])
def test_kernels_against_brute_force(method, n_rules, most):
    """Columns of several words a size, rules that few and that many columns hold, long ties."""
    rnd = random.Random(n_rules)
    def sets(n):
        some = {i: set(rnd.sample(range(n_rules), rnd.randint(0, most))) for i in range(n)}
        return some | {n + i: {1, 2, 3} for i in range(n // 3)}

    queries, held = sets(40), {f"d{i:04d}": x for i, x in sets(600).items()}
    names = sorted(held)
    q = pa.table({
        "query": pa.array([str(i) for i in queries]),
        "n_q": pa.array([len(x) for x in queries.values()], pa.int64()),
        "bits_q": pa.array([sorted(x) for x in queries.values()], pa.list_(pa.int32())),
    })
    bits = pa.array([sorted(held[d]) for d in names], pa.list_(pa.int32()))
    n_r = pa.array([len(held[d]) for d in names], pa.int64())
    r = pa.table({"device": pa.array(names), "n_r": n_r, "bits_r": bits})
    order = {i: brute_order(method, x, held) for i, x in queries.items()}
    got = {}
    for row in overlap._best_kernel(method, 7)((0, 0), q, r).to_pylist():
        got.setdefault(int(row["query"]), []).append((row["device"], row["hits"]))
    for i, best in order.items():
        assert sorted(got.get(i, [])) == sorted((d, h) for d, s, h in best[:7] if h)
    places = {i: sorted(rnd.sample(range(len(names)), 3)) for i in queries}
    own = {i: rnd.choice(best)[1] if i % 5 else 0.0 for i, best in order.items()}
    asked = q.append_column("places", pa.array(list(places.values()), pa.list_(pa.int64())))
    asked = asked.append_column("own", pa.array(list(own.values()), pa.float64()))
    known = pa.table({
        "positions": pa.array([[i] for i in range(len(names))], pa.list_(pa.int64())),
        "n_r": n_r, "bits_r": bits,
    })
    found = overlap._ahead_kernel(method)((0, 0), asked, known).to_pylist()
    found = {(int(x["query"]), x["place"]): x["ahead"] for x in found}
    for i, best in order.items():
        for place in places[i]:
            ahead = sum(s > own[i] or (s == own[i] and d < names[place]) for d, s, _ in best)
            assert found.get((i, place), 0) == ahead - (place if own[i] == 0 else 0)
