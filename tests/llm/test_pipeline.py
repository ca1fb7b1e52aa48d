import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from spoor.llm.common import Scratch  # noqa: E402
from spoor.llm.packing import SIZE  # noqa: E402
from spoor.llm.quality import measure  # noqa: E402

from .test_decontaminate import brute  # noqa: E402
from .test_packing import ids_of  # noqa: E402
from .test_simhash import brute_components, brute_fingerprint  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    scratch, out = Scratch(spark), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, folder))
        out.append(docs)
    return out


def rows_of(df):
    return sorted(df.collect(), key=str)


def check_stages(spark, docs, folder):
    """Each stage against a brute force on its own input."""
    items = [r.asDict() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    good, one, clean, private = stages(spark, docs, folder)
    assert rows_of(good) == [r for r in rows_of(docs) if measure(r["text"])[6]]

    rows = rows_of(good)
    labels = brute_components([brute_fingerprint(r["text"]) for r in rows])
    groups = {}
    for r, label in zip(rows, labels):
        groups.setdefault(label, []).append(r)
    last = 1 << 62
    kept = rows_of(one)
    assert len(kept) == len(groups)
    least = sorted(
        min(last if r["doc_id"] is None else r["doc_id"] for r in g) for g in groups.values()
    )
    assert sorted(last if r["doc_id"] is None else r["doc_id"] for r in kept) == least
    assert set(kept) <= set(rows)

    from pyspark.sql import Row

    leaks = brute([Row(item=i["item_id"], text=i["text"]) for i in items], [r["text"] for r in kept])
    held = {n for n, _ in leaks}
    assert rows_of(clean) == [r for n, r in enumerate(kept) if n not in held]

    assert private.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in private.collect()) == sorted(
        str(r["doc_id"]) for r in clean.collect()
    )
    return private


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    private = check_stages(spark, docs, FOLDER)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    tokens = {r["doc_id"]: len(ids_of(r["text"])) for r in private.collect()}
    found, filled = {}, {}
    for r in got:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert found == tokens
    assert max(filled.values()) <= SIZE


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_odd_rows(spark, odd_docs, no_docs):
    private = check_stages(spark, odd_docs, FOLDER)
    assert private.count() > 0
    assert [df.count() for df in stages(spark, no_docs, FOLDER)] == [0] * 4
