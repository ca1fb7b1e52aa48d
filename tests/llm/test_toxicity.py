import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spoor.llm.toxicity import LabelModel, score, score_toxicity, wanted_words, words

PLAIN = [f"{a}{b}" for a in "ba ko li mu ne po ra su ti vo".split() for b in "na ro st li mer den".split()]
BAD = ["idiot", "scum", "pathetic", "zorgish", "zorgable"]


def made(rng, toxic):
    words = rng.choices(PLAIN, k=rng.randint(20, 80))
    for w in rng.choices(BAD, k=rng.randint(2, 4)) if toxic else []:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


def corpus(rng, n):
    toxic = [rng.random() < 0.2 for _ in range(n)]
    return [(i, made(rng, t)) for i, t in enumerate(toxic)], [(i, 1, int(t)) for i, t in enumerate(toxic)]


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(random.Random(1), 1200)
    rows = score_toxicity(*frames(spark, docs, labels)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(rows) == 1200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(random.Random(2), 400)
    flipped = [
        (i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels
    ]
    runs = [
        {r["doc_id"]: round(r["score"], 9) for r in score_toxicity(*frames(spark, docs, x)).collect()}
        for x in (labels, flipped)
    ]
    assert runs[0] == runs[1]


def test_odd_rows(spark, odd_docs, no_docs):
    _, labels = corpus(random.Random(3), 10)
    labels += [(None, 1, 1), (3, 1, None), (2, None, 1), (2, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = score_toxicity(odd_docs, table).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["score"] is not None and r["held_out"] is not None for r in rows)
    assert score_toxicity(no_docs, table).collect() == []
    assert len(score_toxicity(odd_docs, table.limit(0)).collect()) == len(rows)


def test_label_model_recovers_accuracies_and_joins_copies():
    rng = np.random.default_rng(1)
    y = rng.random(30_000) < 0.2
    rates = [(0.02, 0.7), (0.05, 0.8), (0.01, 0.75), (0.03, 0.65), (0.02, 0.8), (0.04, 0.7)]
    votes = [np.where(y, rng.random(len(y)) < b, rng.random(len(y)) < a) for a, b in rates]
    votes.append(np.where(rng.random(len(y)) < 0.95, votes[0], ~votes[0]))  # nearly a copy
    codes = sum(v.astype(np.int64) << i for i, v in enumerate(votes))
    patterns, counts = np.unique(codes, return_counts=True)
    model = LabelModel(list("abcdefg")).fit(
        patterns, counts.astype(float), np.full(len(patterns), -1)
    )
    assert abs(model.balance - 0.2) < 0.02
    assert model.groups == [(0, 6), (1,), (2,), (3,), (4,), (5,)]
    found = model.accuracies()
    for name, (a, b) in zip("bcdef", rates[1:]):
        assert abs(found[name][0] - a) < 0.02 and abs(found[name][1] - b) < 0.03
    got = model.posterior(codes) > 0.5
    assert (got == y).mean() > 0.97


def test_wanted_words_are_those_of_all_words(spark, odd_docs):
    more = spark.createDataFrame(
        [("𝒜bcdefgh 𝒜bcd abcdefg𝒜 abcd ab_cd1 a-bcdef",), ("*abcd* abcde*",)], "text string"
    )
    body = F.coalesce("text", F.lit(""))
    texts = odd_docs.select("text").union(more).withColumn("every", words(body)).localCheckpoint()
    every = sorted({w for r in texts.collect() for w in r["every"]})
    for wanted in (every, every[::2], every[1::3], [w for w in every if "*" in w][:2], []):
        kept = F.array_intersect("every", F.array(*map(F.lit, wanted)).cast("array<string>"))
        rows = texts.select(wanted_words(body, wanted).alias("ours"), kept.alias("theirs")).collect()
        assert all(r["ours"] == r["theirs"] for r in rows)


def test_a_score_makes_no_stems_that_have_no_weight(spark):
    texts = spark.createDataFrame([("some words",)], "text string")
    plan = texts.select(score(F.col("text"), {"idiot": 1.0, "zorg*": 2.0}, 0.0))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "{4}" in text and "{5}" not in text and "{6}" not in text and "filter(" not in text
