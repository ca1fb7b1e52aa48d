"""Vector scoring against brute force: masks, split labels, tiles, unknown labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoor.functions.vectors import best_columns
from spoor.operators import balls, dense, episodes
from spoor.operators.dense import VECTOR_METHODS, DenseSearch, dense_ranks, dense_topk
from spoor.operators.episodes import METHODS
from spoor.operators.masked import SET_METHODS, masked_ranks, masked_topk

RNG, RND = np.random.default_rng(3), random.Random(3)
TEXTS = [f"t{i}" for i in range(40)]
VECTORS = {t: RNG.normal(size=6).astype(np.float32).astype(float) for t in TEXTS}
VECTORS["t0"] = np.zeros(6)


def make_bank():
    rows = []
    for d in range(10):
        for t in RND.choices(TEXTS, k=50 if d == 3 else RND.randint(1, 6)):
            rows.append((f"d{d}", len(rows), t, VECTORS[t].tolist()))
    return rows


BANK = make_bank()
DEVICES = sorted({r[0] for r in BANK})


def make_queries():
    rows = []
    for e in range(12):
        expected = RND.choice(DEVICES) if e % 5 else "unknown"
        own = sorted({b[2] for b in BANK if b[0] == expected}) or TEXTS
        for j, t in enumerate(RND.sample(own, min(4, len(own)))):
            rows.append((f"q{e}", expected, 1000 + len(rows), VECTORS[t].tolist(), t, j >= 2))
    for t in sorted({b[2] for b in BANK if b[0] == "d5"}):  # masking empties d5
        rows.append(("all", "d5", 1000 + len(rows), VECTORS[t].tolist(), t, True))
    return rows


QUERIES = make_queries()


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def brute():
    tops, ranks = {}, {}
    for name in {q[0] for q in QUERIES}:
        rows = [q for q in QUERIES if q[0] == name]
        removed, texts = {q[4] for q in rows if q[5]}, {q[4] for q in rows}
        q = np.array([unit(np.array(r[3])) for r in rows])
        for method in METHODS:
            scored = []
            for device in DEVICES:
                kept = [b for b in BANK if b[0] == device and b[2] not in removed]
                have = {b[2] for b in kept}
                r = np.array([unit(np.array(b[3])) for b in kept]).reshape(-1, 6)
                if method == "jaccard":
                    score = len(texts & have) / len(texts | have)
                elif method == "exact_hit_count":
                    score = float(len(texts & have))
                elif method == "maxsim":
                    score = (q @ r.T).max(axis=1).mean() if len(r) else 0.0
                else:
                    score = unit(q.mean(0)) @ unit(r.mean(0)) if len(r) else 0.0
                scored.append((-round(float(score), 9), device))
            scored.sort()
            names = [d for _, d in scored]
            tops[name, method] = names[:4]
            expected = rows[0][1]
            ranks[name, method] = names.index(expected) + 1 if expected in names else None
    return tops, ranks


def frames(spark):
    bank = spark.createDataFrame(
        BANK, "device string, row_id long, text string, embedding array<float>"
    )
    queries = spark.createDataFrame(
        QUERIES,
        "query string, expected string, row_id long, embedding array<float>, text string,"
        " unseen boolean",
    )
    return queries, bank


def same_as_brute(top, ranks, methods):
    tops, places = brute()
    got = {}
    for r in top.orderBy("rank").collect():
        got.setdefault((r["query"], r["method"]), []).append(r["device"])
    assert got == {key: names for key, names in tops.items() if key[1] in methods}
    found = {(r["query"], r["method"]): r["rank"] for r in ranks.collect()}
    assert found == {key: rank for key, rank in places.items() if key[1] in methods}


@pytest.mark.parametrize("tile_rows", [16_384, 15])
def test_against_brute_force(spark, tile_rows):
    queries, bank = frames(spark)
    same_as_brute(
        dense_topk(queries, bank, VECTOR_METHODS, 4, tile_rows),
        dense_ranks(queries, bank, VECTOR_METHODS, tile_rows), VECTOR_METHODS,
    )


def test_set_scores_against_brute_force(spark):
    queries, bank = frames(spark)
    same_as_brute(masked_topk(queries, bank, k=4), masked_ranks(queries, bank), SET_METHODS)


def clustered(seed=11, devices=240, groups=12, dim=16):
    """Devices whose vectors lie around one of a few directions, and queries of the same kind."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))

    def rows(prefix, n, size):
        return [
            (f"{prefix}{i:03d}", f"d{i * 7 % devices:03d}", j, (centres[i % groups] + 0.15 * rng.normal(size=dim)).tolist())
            for i in range(n) for j in range(size)
        ]

    queries = rows("q", 60, 4)
    bank = [(name, j, v) for name, _, j, v in rows("d", devices, 5)]
    return queries, bank


def test_far_tiles_stay_closed(spark):
    """Results are those of comparing everything, and most pairs are not compared."""
    queries, bank = clustered()
    q = spark.createDataFrame(queries, "query string, expected string, row_id long, embedding array<double>")
    r = spark.createDataFrame(bank, "device string, row_id long, embedding array<double>")
    outcomes = []
    for prune in (True, False):
        search = DenseSearch(q, r, tile_rows=60, block_rows=40, prune=prune)
        top = search.topk(5).select("query", "device", "rank", F.round("score", 9)).collect()
        opened = [search.pruning()]
        ranks = search.ranks().select("query", "rank", F.round("score", 9)).collect()
        opened.append(search.pruning())
        outcomes.append((set(top), set(ranks), opened))
    assert outcomes[0][:2] == outcomes[1][:2]
    (top, ranks), everything = outcomes[0][2], outcomes[1][2][0]
    assert everything.opened == everything.pairs
    assert top.pairs == everything.pairs and top.opened < top.pairs / 2
    assert ranks.opened < ranks.pairs


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = (rng.normal(size=(n, 5)) for n in (300, 40))
    x[0] = q[0] = 0
    x, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, q))
    centres = x[1:9]
    away = balls.angles(x, centres)
    ball = np.argmin(away, axis=1)
    ball[0] = balls.ZERO
    angle = np.where(ball >= 0, away[np.arange(len(x)), ball], 0.0)
    held = np.unique(ball)
    low = np.array([angle[ball == b].min() for b in held])
    high = np.array([angle[ball == b].max() for b in held])
    bounds = balls.upper_bounds(balls.angles(q, centres), ~q.any(axis=1), held, low, high)
    for column, b in enumerate(held):
        best = (q @ x[ball == b].T).max(axis=1)
        assert (bounds[:, column] >= best - 1e-9).all()
    assert (bounds < 0.999).any()


def test_balls_share_groups_until_full():
    groups, count = balls.group_balls({-1: 2, 0: 5, 1: 30, 2: 4, 3: 4}, [-1, 0, 1, 2, 3], 10)
    assert groups == {-1: (0, 1), 0: (0, 1), 1: (1, 3), 2: (4, 1), 3: (4, 1)} and count == 5


def test_empty_sides(spark):
    queries, bank = frames(spark)
    assert dense_topk(queries, bank.limit(0), VECTOR_METHODS).count() == 0
    assert dense_topk(queries.limit(0), bank, VECTOR_METHODS).count() == 0
    assert {r["rank"] for r in dense_ranks(queries, bank.limit(0)).collect()} == {None}


def test_a_query_larger_than_a_tile(spark):
    bank = spark.createDataFrame(
        [(b[0], b[1], b[3]) for b in BANK], "device string, row_id long, embedding array<float>"
    )
    queries = spark.createDataFrame(
        [("big", "d7", q[2], q[3]) for q in QUERIES],
        "query string, expected string, row_id long, embedding array<float>",
    )
    whole = dense_topk(queries, bank, k=10).orderBy("rank").collect()
    tiled = dense_topk(queries, bank, k=10, tile_rows=15).orderBy("rank").collect()
    assert [r["device"] for r in whole] == [r["device"] for r in tiled]
    assert [r["score"] for r in tiled] == pytest.approx([r["score"] for r in whole])
    rank = [r["device"] for r in whole].index("d7") + 1
    assert dense_ranks(queries, bank, tile_rows=15).first()["rank"] == rank


def test_large_queries_with_all_methods(spark):
    """A query of more rows than a block stays whole where its scores do not add up."""
    bank = spark.createDataFrame(
        BANK, "device string, row_id long, text string, embedding array<float>"
    )
    queries = spark.createDataFrame(
        [("big", "d7", *q[2:]) for q in QUERIES],
        "query string, expected string, row_id long, embedding array<float>, text string,"
        " unseen boolean",
    )
    order = ["method", "rank"]
    whole = dense_topk(queries, bank, VECTOR_METHODS, 10).orderBy(order).collect()
    tiled = dense_topk(queries, bank, VECTOR_METHODS, 10, tile_rows=15).orderBy(order).collect()
    assert [(r["method"], r["device"]) for r in whole] == [(r["method"], r["device"]) for r in tiled]
    assert [r["score"] for r in tiled] == pytest.approx([r["score"] for r in whole])


def test_episodes_that_remove_nothing_are_counted(spark):
    rows = [("a", i, f"t{i}") for i in range(6)]
    bank = spark.createDataFrame(rows, "device string, row_id long, text string")
    drawn = episodes.sample_episodes(bank, episodes.PARTIAL, unseen_count=0)
    found = episodes.masked_counts(bank, drawn).collect()
    assert [(r["rows_removed"], r["rows_left"]) for r in found] == [(0, 6)] * 5
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_repeated_row_ids_keep_their_device(spark):
    rows = [("a", i, f"t{i}", [1.0, float(i)]) for i in range(6)]
    rows += [("b", i, f"u{i}", [-1.0, float(i)]) for i in range(6)]
    bank = spark.createDataFrame(
        rows, "device string, row_id long, text string, embedding array<double>"
    )
    drawn = episodes.sample_episodes(bank)
    assert episodes.episode_queries(bank, drawn).count() == drawn.count()


def test_repeated_reference_rows_do_not_change_maxsim(spark):
    bank = spark.createDataFrame(
        [(b[0], b[1], b[3]) for b in BANK], "device string, row_id long, embedding array<float>"
    )
    queries = spark.createDataFrame(
        [(q[0], q[1], q[2], q[3]) for q in QUERIES],
        "query string, expected string, row_id long, embedding array<float>",
    )
    doubled = bank.union(bank.withColumn("row_id", F.col("row_id") + 5000))
    a, b = (dense_topk(queries, x).orderBy("query", "rank").collect() for x in (bank, doubled))
    assert [r["device"] for r in a] == [r["device"] for r in b]


def test_copies_of_banks_meet_once(spark, monkeypatch):
    """What is compared follows the different banks, not their copies."""
    seen = []

    class Spy(dense.DenseSearch):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self.tiles.rows.count())

    monkeypatch.setattr(dense, "DenseSearch", Spy)
    rnd = np.random.default_rng(5)
    banks = {f"b{i}": rnd.normal(size=(2, 4)).round(2) for i in range(5)}
    names = [f"{name}-{i}" for name in banks for i in range(6)]
    wanted = {q: names[(5 * i) % len(names)] if i % 7 else "unknown" for i, q in enumerate(names)}
    rows = [
        (name, wanted[name], at, [float(x) for x in vector])
        for name in names for at, vector in enumerate(banks[name[:-2]])
    ]
    bank = spark.createDataFrame(rows, "query string, expected string, row_id long, embedding array<double>")
    references = bank.select(F.col("query").alias("device"), "row_id", "embedding")
    ranks = {r["query"]: r["rank"] for r in dense_ranks(bank, references).collect()}
    unit = {name: b / np.linalg.norm(b, axis=1, keepdims=True) for name, b in banks.items()}
    for query in names:
        best = {r: (unit[query[:-2]] @ unit[r].T).max(axis=1).mean().round(9) for r in banks}
        order = sorted(names, key=lambda d: (-best[d[:-2]], d))
        assert ranks[query] == (order.index(wanted[query]) + 1 if wanted[query] != "unknown" else None)
    # Five banks of two rows.
    assert seen == [10]


def test_pooled_means_are_those_of_one_run(spark):
    """Rows that arrive in another order in each run give means that differ in their last bits."""
    arrival = F.udf(lambda: random.random(), "double").asNondeterministic()
    numbers = np.random.default_rng(5).normal(size=(400, 8)) * 10.0 ** np.arange(-4, 4)
    bank = spark.createDataFrame(
        [(f"d{i % 4}", i, v.tolist()) for i, v in enumerate(numbers)],
        "device string, row_id long, embedding array<double>",
    )
    shuffled = bank.withColumn("at", arrival()).repartitionByRange(6, "at").drop("at")
    queries = shuffled.withColumnRenamed("device", "query").withColumn("expected", F.col("query"))
    banks = dense.pooled(queries, shuffled)
    assert dense_topk(*banks, k=2).count() == 8
    assert {(r["expected"], r["rank"]) for r in dense_ranks(*banks).collect()} == {
        (f"d{i}", 1) for i in range(4)
    }


def test_tiles_travel_as_packs(spark):
    """A tile goes to many blocks, so its rows are packed; nothing is lost by that."""
    queries, bank = clustered()
    q = spark.createDataFrame(queries, "query string, expected string, row_id long, embedding array<double>")
    r = spark.createDataFrame(bank, "device string, row_id long, embedding array<double>")
    search = DenseSearch(q, r, tile_rows=300)
    held = search.held.toArrow()
    assert len(held) < len(bank) / 20
    rows = dense._unpacked(held)
    assert rows["copies"].drop_null().to_pylist() == [1] * len(bank)
    assert len(rows) - rows["embedding"].null_count == len(set(rows["vid"].to_pylist()))


def test_own_scores_meet_the_expected_device_only(spark, monkeypatch):
    """The first pass of a rank compares no query with devices that it does not expect."""
    rng = np.random.default_rng(5)
    bank = [(f"d{i % 7}", i, rng.normal(size=4).tolist()) for i in range(60)]
    asked = [(f"q{i % 5}", f"d{i % 5}", i, rng.normal(size=4).tolist()) for i in range(40)]
    q = spark.createDataFrame(asked, "query string, expected string, row_id long, embedding array<double>")
    r = spark.createDataFrame(bank, "device string, row_id long, embedding array<double>")
    search = DenseSearch(q, r)
    left = search.blocks.with_vectors(search.rows, "block").toArrow()
    key = tuple(pa.scalar(x) for x in (0, 0, 0))
    monkeypatch.setattr(dense._Tile, "best", lambda *_: pytest.fail("all devices are compared"))
    found = dense._kernel("own", ["maxsim"], 0, False)(key, left, search.held.toArrow())
    for row in found.to_pylist():
        a, b = (
            np.array([unit(np.array(x[-1])) for x in rows if x[at] == row[name]])
            for rows, at, name in ((asked, 0, "query"), (bank, 0, "device"))
        )
        assert row["device"] == "d" + row["query"][1:]
        assert row["best"] == pytest.approx((a @ b.T).max(axis=1).mean())
    assert len(found) == 5


def test_products_are_taken_once_for_a_block(spark, monkeypatch):
    """Queries of a block share the best products of their vectors, however many steps they take."""
    calls = []

    class Spy(dense._Tile):
        def best(self, some):
            calls.append(len(some))
            return super().best(some)

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(9, 4))
    def side(label, n):
        rows = [(f"{label}{i:03d}", int(v)) for i in range(n) for v in rng.choice(9, 4, replace=False)]
        return rows, pa.table({
            label: pa.array([r[0] for r in rows]), "vid": pa.array([r[1] for r in rows], pa.int64()),
            "copies": pa.array([1] * len(rows), pa.int64()), "whole": pa.array([True] * len(rows)),
            "embedding": pa.nulls(len(rows), pa.list_(pa.float64())),
            **{c: pa.nulls(len(rows), pa.string()) for c in ("text", "expected")},
            "unseen": pa.nulls(len(rows), pa.bool_()),
        })

    held = pa.table({"vid": pa.array(range(9), pa.int64()), "embedding": pa.array(vectors.tolist())})
    (asked, q), (known, r) = side("query", 40), side("device", 90)
    q, r = (pa.concat_tables([t, held], promote_options="default") for t in (q, r))
    r = r.append_column("unit", pa.array([0] * len(r), pa.int64()))
    r = r.append_column("part", pa.array([0] * len(r), pa.int32()))
    monkeypatch.setattr(dense, "_Tile", Spy)
    monkeypatch.setattr(dense, "STEP_QUERIES", 6)
    packs = pa.Table.from_batches(list(dense._packs(r)))
    key = tuple(pa.scalar(0) for _ in range(3))
    found = dense._kernel("top", ["maxsim"], 3, False)(key, q, packs).to_pylist()
    assert sum(calls) == 9
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    def of(rows):
        names = {}
        for name, v in rows:
            names.setdefault(name, []).append(v)
        return names
    for name, vids in of(asked).items():
        scores = {d: np.mean((units[vids] @ units[w].T).max(axis=1)) for d, w in of(known).items()}
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:3]
        assert sorted(x["device"] for x in found if x["query"] == name) == sorted(best)


def test_rounded_scores_tie_in_lists():
    """Scores that differ beyond the digits tie, and the first columns win, by either way of taking them."""
    rng = np.random.default_rng(6)
    for levels in (3, 400, 10**6):
        scores = rng.integers(0, levels, (30, 700)) / levels + rng.uniform(-4e-10, 4e-10, (30, 700))
        row, column = best_columns(scores, 4, 9)
        plain = np.round(scores, 9)
        wanted = [sorted(np.lexsort((np.arange(700), -x))[:4]) for x in plain]
        assert (column.reshape(-1, 4) == wanted).all() and (row == np.repeat(np.arange(30), 4)).all()
