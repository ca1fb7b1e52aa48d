from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from spoor.llm import manifest as m
from spoor.llm.manifest import Manifest, build_log, fold, height_of, position, proof


def h(text):
    return sha256(text.encode()).hexdigest()


def levels(leaves):
    """All levels of the tree, by the rule itself."""
    out = [leaves]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([h("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return out


def postorder(tree, level, index):
    if level:
        for child in (2 * index, 2 * index + 1):
            if child < len(tree[level - 1]):
                yield from postorder(tree, level - 1, child)
    yield level, index


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 11, 16, 17, 33, 100])
def test_log_is_the_postorder_of_the_tree(n):
    tree = levels([h(str(i)) for i in range(n)])
    order = list(postorder(tree, len(tree) - 1, 0))
    log = build_log(tree[0], height_of(n))
    assert log == [tree[level][index] for level, index in order]
    assert [position(level, index, n) for level, index in order] == list(range(len(log)))
    for i in range(n):
        steps = proof(log, i, n, height_of(n))
        assert fold(tree[0][i], steps) == tree[-1][0]


def test_a_short_log_grows_to_the_height_of_its_run():
    leaves = [h("a"), h("b"), h("c")]
    log = build_log(leaves, 5)
    top = levels(leaves)[-1][0]
    for _ in range(3):
        top = h(top)
    assert log[-1] == top and len(log) == position(5, 0, 3) + 1


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if values[3] is not None:
        values[3] += more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows):
    """Rows of (doc_id, leaf, subroot, root, proof hash), one per document, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"], leaf_of(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        members = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        groups[name] = members
        trees[name] = levels([leaf for _, leaf in members])
    top = levels([trees[name][-1][0] for name in names])

    def siblings(tree, i):
        out = []
        for level in tree[:-1]:
            if i ^ 1 < len(level):
                out.append(level[i ^ 1])
            i >>= 1
        return out

    out = []
    for g, name in enumerate(names):
        for i, (doc_id, leaf) in enumerate(groups[name]):
            steps = siblings(trees[name], i) + siblings(top, g)
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], h("".join(steps))))
    return sorted(out, key=str)


def check(spark, docs, presented=None):
    rows = docs.collect()
    found = Manifest(docs, presented=presented).proofs().collect()
    got = sorted(
        ((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found),
        key=str,
    )
    assert got == brute(rows)
    return found


def test_odd_documents(spark, odd_docs):
    for row in check(spark, odd_docs):
        assert row["verified"] and row["folded_root"] == row["root"]


@pytest.mark.parametrize("height", [2])
def test_many_layers(spark, monkeypatch, height):
    """Small runs: several layers of builders below and above the group roots."""
    monkeypatch.setattr(m, "HEIGHT", height)
    monkeypatch.setattr(m, "RUN", 1 << height)
    rows = [(i, f"text {i}", ["en", "de", None, "a", "", "zz", "é"][i * i % 7], None, i) for i in range(83)]
    rows += [(5, "text 5", "en", None, 5)] * 9
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(5)
    assert all(r["verified"] for r in check(spark, docs))
    found = Manifest(docs)
    counts = {}
    for r in docs.groupBy("lang").count().collect():
        counts["" if r["lang"] is None else "=" + r["lang"]] = r["count"]
    logs = {}
    for r in found.nodes().collect():
        logs.setdefault(r["grp"], []).append((r["position"], r["level"], r["digest"]))
    subroots = {r["grp"]: r["subroot"] for r in found.subroots.collect()}
    for grp, n in counts.items():
        log = sorted(logs[grp])
        assert [x[0] for x in log] == list(range(len(log)))
        leaves = [x[2] for x in log if x[1] == 0]
        assert [x[2] for x in log] == build_log(leaves, height_of(n))
        assert len(leaves) == n and log[-1][2] == subroots[grp]


def test_changed_rows_fail(spark, odd_docs):
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    wanted = {}
    for row in odd_docs.collect():
        same = row["doc_id"] is None or row["doc_id"] % 3 != 0 or row["n_chars"] is None
        wanted.setdefault(row["doc_id"], set()).add(same)
    for row in check(spark, odd_docs, {"n_chars": changed}):
        assert row["verified"] in wanted[row["doc_id"]]
        assert row["verified"] == (row["folded_root"] == row["root"])
        if not row["verified"]:
            original = next(x for x in odd_docs.collect() if x["doc_id"] == row["doc_id"])
            assert row["folded_root"] == fold(leaf_of(original, 1), row["proof"])


def test_one_row_and_none(spark, odd_docs, no_docs):
    one = check(spark, odd_docs.filter("doc_id = 4"))
    assert one[0]["root"] == one[0]["leaf"] and one[0]["proof_sha256"] == h("")
    empty = Manifest(no_docs)
    assert empty.root is None and empty.proofs().count() == 0


def test_no_groups(spark, odd_docs):
    table = Manifest(odd_docs, group=None)
    assert {r["subroot"] for r in table.proofs(steps=False).collect()} == {table.root}
