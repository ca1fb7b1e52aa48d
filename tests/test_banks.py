"""Encoding, pooling, whitening, episodes and bank sources."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from spoor.operators import episodes as ep
from spoor.operators.dense import dense_topk
from spoor.operators.encode import (
    VectorStore,
    embed_mean,
    embed_rules,
    encode_distinct,
    hashed_encoder,
    model_encoder,
)
from spoor.operators.stats import corpus_sketches, estimated_counts, sketch_error
from spoor.operators.whiten import WhiteningModel, fit_leading, fit_whitening
from spoor.plans.banks import embed_folder, whiten_bank
from spoor.plans.evaluation import evaluate
from spoor.plans.retrieval import rank_banks
from spoor.plans.whitening import Whitening
from spoor.sources.banks import read_whole_embeddings, resolve_bank


def encoder_factory():
    """A local function, so that workers need not import this module."""

    def make_predict():
        import numpy

        def predict(texts):
            return numpy.array([[len(t), t.count("a"), 1.0] for t in texts], dtype="float32")

        return predict

    return make_predict


def vector(text):
    v = np.array([len(text), text.count("a"), 1.0])
    return v / np.linalg.norm(v)


@pytest.fixture
def rules_folder(tmp_path):
    folder = tmp_path / "rules"
    (folder / "sub").mkdir(parents=True)
    (folder / "cam_compact.txt").write_text("a b\nc\na b\n")
    (folder / "sub" / "plug_compact.txt").write_text("c\nd e f")
    (folder / "blank.txt").write_text("\n")
    return str(folder)


def test_embed_folder_by_pool(spark, rules_folder, tmp_path):
    encoder = model_encoder(encoder_factory())
    rules = embed_folder(spark, rules_folder, encoder, str(tmp_path / "per"))
    rows = rules.orderBy("path", "pos").collect()
    assert [(r["device"], r["text"]) for r in rows] == [
        ("cam_compact", "a b"), ("cam_compact", "c"), ("cam_compact", "a b"),
        ("plug_compact", "c"), ("plug_compact", "d e f"),
    ]
    for r in rows:
        assert r["embedding"] == pytest.approx(vector(r["text"]), abs=1e-6)
    mean = embed_folder(spark, rules_folder, encoder, str(tmp_path / "mean"), "mean")
    found = {r["device"]: np.array(r["embedding"]) for r in mean.collect()}
    want = 2 * vector("a b") + vector("c")
    assert set(found) == {"cam_compact", "plug_compact"}
    assert found["cam_compact"] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    whole = embed_folder(spark, rules_folder, encoder, str(tmp_path / "whole"), "whole")
    assert {r["device"] for r in whole.collect()} == {"cam_compact", "plug_compact", "blank"}
    result = rank_banks(spark, str(tmp_path / "per"), str(tmp_path / "per"))
    assert {r["rank"] for r in result.ranks.collect()} == {1}


def test_empty_rules_are_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text(" \n")
    with pytest.raises(ValueError):
        embed_folder(spark, str(tmp_path), hashed_encoder(), str(tmp_path / "out"))


def test_a_text_that_most_rows_hold_is_encoded_once(spark):
    rows = [(i, "hot" if i % 3 else f"cold{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, line string")
    seen = spark.sparkContext.accumulator(0)
    plain = hashed_encoder(4)

    def encoder(texts):
        seen.add(texts.count())
        return plain(texts)

    out = encode_distinct(df, encoder, "line").collect()
    assert sorted((r["id"], r["line"]) for r in out) == rows
    assert seen.value == 31


def test_hashed_encoder_is_unit_and_blank_is_zero(spark):
    df = spark.createDataFrame([("a", 0, "x y x"), ("a", 1, "z"), ("b", 0, "x y x")],
                               "key string, pos int, line string")
    out = embed_rules(df, hashed_encoder(16), "key", ["pos"]).collect()
    assert len(out) == 3
    for r in out:
        assert np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-6)
    blank = hashed_encoder(4)(spark.createDataFrame([("  ",)], "text string")).first()
    assert blank["embedding"] == [0.0] * 4
    assert embed_mean(df, hashed_encoder(16), "key").count() == 2


def test_whitening_by_its_invariants(spark, tmp_path):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(60, 8)) * np.arange(1, 9)
    matrix[:, 7] = matrix[:, 6]  # one direction less
    matrix = matrix.astype(np.float32).astype(float)
    rows = [(i, f"d{i % 4}", v.tolist()) for i, v in enumerate(matrix)]
    spark.createDataFrame(rows, "row_id long, device string, embedding array<float>").write.parquet(
        str(tmp_path / "bank")
    )
    model = whiten_bank(
        spark, str(tmp_path / "bank"), str(tmp_path / "bank"), str(tmp_path / "white"),
        str(tmp_path / "meta"), k=5,
    )
    assert model.rank == 7 and model.metadata(0)["dropped"] == 1
    fitted = spark.read.parquet(str(tmp_path / "bank"))
    out = np.array([r["embedding"] for r in model.project(fitted).orderBy("row_id").collect()])
    assert out.mean(0) == pytest.approx(np.zeros(7), abs=1e-6)
    assert np.cov(out.T) == pytest.approx(np.eye(7), abs=1e-4)
    # With all directions, inner products are those of the inverse covariance.
    unit = matrix / np.sqrt((matrix**2).sum(1))[:, None]
    centred = unit - unit.mean(0)
    inverse = np.linalg.pinv(np.cov(unit.T), rcond=1e-6)
    assert out @ out.T == pytest.approx(centred @ inverse @ centred.T, abs=1e-3)
    want = out[:, :5] / np.sqrt((out[:, :5] ** 2).sum(1))[:, None]
    white = spark.read.parquet(str(tmp_path / "white")).orderBy("row_id").collect()
    got = np.array([r["embedding"] for r in white])
    assert got @ got.T == pytest.approx(want @ want.T, abs=1e-5)
    assert [r["label"] for r in white][:2] == ["d0", "d1"]
    meta = spark.read.json(str(tmp_path / "meta")).first()
    assert (meta["reference_rows"], meta["input_dim"], meta["rank"], meta["k"]) == (60, 8, 7, 5)
    model.save(spark, str(tmp_path / "model"))
    again = WhiteningModel.load(spark, str(tmp_path / "model"))
    assert again.components == pytest.approx(model.components)
    other = spark.createDataFrame([(0, [0.0] * 8), (1, [1.0] * 8)], "row_id int, embedding array<float>")
    assert again.transform(other, 3).count() == 2
    assert again.rcond == model.rcond
    with pytest.raises(ValueError):
        fit_whitening(other.limit(0))


def test_rank_does_not_depend_on_the_number_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [((rng.normal(size=4) * [1, 1, 1, 0.004]).tolist(),) for _ in range(40)]
    small = spark.createDataFrame(rows, "embedding array<double>")
    large = small.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("again")
    assert fit_whitening(small).rank == fit_whitening(large).rank == 4
    assert fit_whitening(large, rcond="rows").rank == 3


@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0] * 4])
def test_vectors_of_another_length_raise(spark, bad):
    good = [("a", 0, [1.0, 0.0, 0.0]), ("b", 1, [0.0, 1.0, 0.0])]
    schema = "device string, row_id long, embedding array<double>"
    bank = spark.createDataFrame([*good, ("c", 2, bad)], schema)
    queries = spark.createDataFrame(good, schema).withColumnRenamed("device", "query").withColumn(
        "expected", F.col("query")
    )
    with pytest.raises(Exception, match="vector is NULL or has not"):
        dense_topk(queries, bank).collect()
    model = fit_whitening(spark.createDataFrame(good, schema))
    with pytest.raises(Exception, match="vector is NULL or has not"):
        model.transform(bank).collect()


BANK = [
    (f"d{d}", d * 100 + i, f"t{(d * 3 + i) % 17}", np.random.default_rng((d * 3 + i) % 17).normal(size=5).tolist())
    for d in range(6)
    for i in range(d + 2)
]


def bank(spark):
    return spark.createDataFrame(
        BANK + [("d5", 999, "t15", BANK[0][3])],
        "device string, row_id long, text string, embedding array<float>",
    )


def test_episodes(spark):
    rows = ep.sample_episodes(bank(spark), ep.PARTIAL, episodes_per_device=3).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["episode_id"], []).append(r)
    # More than four distinct texts are needed: d3, d4 and d5 have five or more.
    assert {r["expected"] for r in rows} == {"d3", "d4", "d5"}
    assert len(by_id) == 9 and "d3/partial/000" in by_id
    for found in by_id.values():
        assert sorted(r["role"] for r in found) == ["exact", "exact", "unseen", "unseen"]
        assert len({r["text"] for r in found}) == 4
    again = ep.sample_episodes(bank(spark), ep.PARTIAL, episodes_per_device=3).collect()
    assert set(rows) == set(again)
    other = ep.sample_episodes(bank(spark), ep.PARTIAL, episodes_per_device=3, seed=1).collect()
    assert set(rows) != set(other)
    with pytest.raises(ValueError):
        ep.sample_episodes(bank(spark), ep.PARTIAL, exact_count=0, unseen_count=0)
    with pytest.raises(ValueError):
        ep.sample_episodes(bank(spark), "other")


def test_masked_texts_are_gone(spark):
    episodes = ep.sample_episodes(bank(spark))
    gone = {(r["episode_id"], r["text"]) for r in episodes.collect()}
    left = {tuple(r) for r in ep.masked_own_profile(bank(spark), episodes).collect()}
    assert left and not gone & left
    for r in ep.masked_counts(bank(spark), episodes).collect():
        texts = {t for e, t in gone if e == r["episode_id"]}
        n = sum(b[2] in texts for b in BANK) + ("t15" in texts)
        assert (r["rows_removed"], r["rows_left"]) == (n, len(BANK) + 1 - n)


def test_evaluation(spark, tmp_path):
    done = evaluate(bank(spark), episodes_per_device=2, k=3, examples=2)
    summary = {r["method"]: r for r in done.summary.collect()}
    assert set(summary) == {"jaccard", "exact_hit_count", "mean_pool", "maxsim"}
    # Nothing is left to overlap with, so exact scores rank by name alone.
    devices = sorted({b[0] for b in BANK})
    eligible = [d for d in devices if len({b[2] for b in BANK if b[0] == d}) > 3]
    want = np.mean([devices.index(d) + 1 for d in eligible])
    assert summary["jaccard"]["mean_rank"] == pytest.approx(want)
    assert summary["exact_hit_count"]["mean_rank"] == pytest.approx(want)
    examples = done.examples.collect()
    assert len(examples) == 2
    for r in examples:
        assert len(r["query_aces"]) == 3 and r["exact_aces"] == []
        assert len(r["scores"]["maxsim"]["top"]) == 3
    done.write(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "config")).first()["unseen_count"] == 3
    with pytest.raises(ValueError):
        evaluate(bank(spark), query_size=50)


def test_bank_columns(spark):
    df = spark.createDataFrame([(1, "x_compact", [1.0], 7)],
                               "row_id int, names string, original_embeddings array<float>, extra int")
    row = resolve_bank(df).first()
    assert (row["label"], row["clean_label"], row["extra"]) == ("x_compact", "x", 7)
    with pytest.raises(ValueError):
        resolve_bank(df, with_texts=True)
    with pytest.raises(ValueError):
        resolve_bank(df.drop("names"))


def test_whole_embeddings(spark, tmp_path):
    item = {"device": "cam", "encoder": "e", "source_type": "whole_compact", "source_file": "f",
            "embedding_dim": 3, "embedding": [1, 2.5, 3]}
    (tmp_path / "a.json").write_text(json.dumps(item, indent=2))
    assert read_whole_embeddings(spark, str(tmp_path)).first()["embedding"] == [1.0, 2.5, 3.0]
    (tmp_path / "b.json").write_text(json.dumps({**item, "embedding_dim": 4}))
    with pytest.raises(Exception, match="wrong embedding length"):
        read_whole_embeddings(spark, str(tmp_path)).select("embedding").collect()


def test_leading_directions_equal_those_of_the_whole_fit(spark):
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = (rng.normal(size=(400, 24)) * 0.7 ** np.arange(24)) @ basis + 0.3
    bank = spark.createDataFrame(
        [(i, r.tolist()) for i, r in enumerate(rows)], "row_id long, embedding array<double>"
    ).repartition(5)
    whole, few = fit_whitening(bank), fit_leading(bank, 4, oversample=2, passes=3)
    assert few.components.shape == (4, 24) and few.reference_rows == 400
    assert few.singular_values == pytest.approx(whole.singular_values[:4], rel=1e-6)
    overlap = np.abs((few.components * whole.components[:4]).sum(axis=1))
    assert overlap == pytest.approx(np.ones(4), abs=1e-5)
    white = np.array([r["embedding"] for r in few.project(bank, 4).collect()])
    assert np.cov(white.T) == pytest.approx(np.eye(4), abs=1e-8)


def test_leading_directions_of_a_flat_bank(spark):
    """A bank of lower rank than asked for: directions without energy are dropped."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 9))
    bank = spark.createDataFrame(
        [(i, r.tolist()) for i, r in enumerate(rows)], "row_id long, embedding array<double>"
    )
    assert fit_leading(bank, 6).rank == fit_whitening(bank).rank == 2


def test_whitening_as_a_pipeline_stage(spark, tmp_path):
    rng = np.random.default_rng(6)
    bank = spark.createDataFrame(
        [(i, r.tolist(), "x") for i, r in enumerate(rng.normal(size=(80, 6)))],
        "row_id long, vec array<double>, note string",
    )
    for leading in (False, True):
        fitted = Pipeline(stages=[Whitening(vectorCol="vec", k=3, leadingOnly=leading)]).fit(bank)
        path = str(tmp_path / f"stage-{leading}")
        fitted.write().save(path)
        again = PipelineModel.load(path)
        a, b = (m.transform(bank).orderBy("row_id").collect() for m in (fitted, again))
        assert a == b and {len(r["vec"]) for r in a} == {3} and a[0]["note"] == "x"
    stage = Whitening(vectorCol="vec", k=3)
    stage.write().save(str(tmp_path / "unfitted"))
    assert Whitening.load(str(tmp_path / "unfitted")).getOrDefault("k") == 3


def test_known_texts_are_not_encoded_again(spark, tmp_path):
    asked = []

    def encoder(texts):
        asked.append(sorted(r["text"] for r in texts.collect()))
        return hashed_encoder(8)(texts)

    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b")], "id long, line string")
    more = rows.union(spark.createDataFrame([(4, "d"), (5, "c")], "id long, line string"))
    store = VectorStore(spark, str(tmp_path / "vectors"))
    first = store.encode(rows, encoder, "line").orderBy("id").collect()
    assert store.encoded == 2 and asked == [["a b", "c"]]
    assert first == encode_distinct(rows, hashed_encoder(8), "line").orderBy("id").collect()
    assert store.encode(rows, encoder, "line").orderBy("id").collect() == first
    assert store.encoded == 0 and len(asked) == 1
    again = VectorStore(spark, str(tmp_path / "vectors"))
    found = again.encode(more, encoder, "line").orderBy("id").collect()
    assert again.encoded == 1 and asked[1:] == [["d"]]
    assert found == encode_distinct(more, hashed_encoder(8), "line").orderBy("id").collect()


def test_sketches_of_batches_merge(spark):
    rows = [(i % 3, f"p{i % 500}", f"r{i * 7 % 4000}") for i in range(9000)]
    rows += [(0, "p0", None)]
    lines = spark.createDataFrame(rows, "batch int, profile string, line string").repartition(4)
    stored_rows = corpus_sketches(lines, "profile", "batch")
    assert stored_rows.count() == 3
    merged, exact = estimated_counts(stored_rows).first(), (9000, 4000, 500)
    assert merged["rule_instances"] == exact[0]
    assert merged["unique_rules"] == pytest.approx(exact[1], rel=4 * sketch_error())
    assert merged["profiles"] == pytest.approx(exact[2], rel=4 * sketch_error())
    none = estimated_counts(corpus_sketches(lines.limit(0), "profile", "batch")).first()
    assert tuple(none) == (0, 0, 0)
    per = estimated_counts(stored_rows, "batch").collect()
    assert sum(r["rule_instances"] for r in per) == 9000


def test_texts_are_encoded_without_shuffling_their_tokens(spark):
    """Rows, distinct texts and vectors are shuffled, once each; a blank text has a zero vector."""
    lines = spark.createDataFrame(
        [(1, 0, "a b a"), (1, 1, "c"), (2, 0, "a b a"), (2, 1, " "), (3, 0, "")],
        "doc long, pos int, line string",
    )
    found = encode_distinct(lines, hashed_encoder(8), "line")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "token" in plan
    rows = {(r["doc"], r["pos"]): r["embedding"] for r in found.collect()}
    assert len(rows) == 5 and rows[1, 0] == rows[2, 0] != rows[1, 1]
    assert not any(rows[2, 1]) and not any(rows[3, 0])
    assert abs(sum(x * x for x in rows[1, 0]) - 1) < 1e-6
